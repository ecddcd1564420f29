"""The pipeline against plain versions of its stages, on the small test documents and planted cases."""

import hashlib
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from taskframe.llm import common, toxicity

from .test_decontaminate import plain as aligned
from .test_near_dups import brute as classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    import re

    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def cut(rows):
    """Texts without bytes of 100-byte strings that occur earlier in doc_id order."""
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest())):
        raw, lost = (r["text"] or "").encode(), set()
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                lost.update(range(p, p + 100))
            seen.add(raw[p : p + 100])
        out[r["doc_id"]] = None if r["text"] is None else bytes(b for p, b in enumerate(raw) if p not in lost).decode("utf-8", "ignore")
    return out


def test_all_stages(spark, tmp_path):
    rng = random.Random(12)
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    rows = [r.asDict() for r in read("documents").filter("n_chars < 6000").collect()]
    items = [r.asDict() for r in read("benchmark").collect()][:12]
    base = rows[3]["text"].split(" ")
    near = list(base)
    near[len(near) // 2] = "changed"
    passage = " ".join(rng.choices("some of the words that stand in a passage which many texts share again and again".split(), k=40))
    extra = [" ".join(near), rows[3]["text"], "own words here " + passage, passage + " other words there", " ".join(rng.choices(base, k=30)) + " " + items[2]["text"], "", None]
    rows += [{"doc_id": 5000 + i, "text": t, "lang": "en", "source": "s", "n_chars": len(t or "")} for i, t in enumerate(extra)]
    spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i["item_id"], i["text"]) for i in items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read("labels").write.parquet(f"{tmp_path}/labels.parquet")

    docs, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = common.kept(stage(spark, docs, f"{tmp_path}"), "stage")
        at[name] = [r.asDict() for r in docs.collect()]
        assert name == "packing" or docs.columns == COLUMNS
    whole = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, f"{tmp_path}").collect()}

    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scored = toxicity.score(source, toxicity.train(source, read("labels"))).collect()
    one = [r for r in rows if r["doc_id"] in {s.doc_id for s in scored if s.predicted == 0}]
    assert sorted(at["toxicity"], key=lambda r: r["doc_id"]) == sorted(one, key=lambda r: r["doc_id"])
    of = classes([(r["doc_id"], r["text"]) for r in one])
    two = [r for k, r in enumerate(one) if of[k] == r["doc_id"]]
    assert {5000, 5001}.isdisjoint(r["doc_id"] for r in two) and {r["doc_id"]: r for r in at["minhash_near_dedup"]} == {r["doc_id"]: r for r in two}
    left = cut(two)
    three = [r | {"text": left[r["doc_id"]], "n_chars": None if left[r["doc_id"]] is None else len(left[r["doc_id"]])} for r in two]
    assert {r["doc_id"]: r for r in at["suffix_array_dedup"]} == {r["doc_id"]: r for r in three}
    tests = [words(i["text"]) for i in items]
    bad = {r["doc_id"] for r in three if any(t and aligned(t, words(r["text"])) >= 0.5 * len(t) for t in tests)}
    four = [r for r in three if r["doc_id"] not in bad]
    assert bad and {r["doc_id"]: r for r in at["benchmark_decontamination"]} == {r["doc_id"]: r for r in four}
    library = Tokenizer.from_file(common.tokenizer_path(common.WORD_TOKENIZER))
    got = {}
    for r in sorted(at["packing"], key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).extend(r["ids"])
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    assert got == {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in four}
    assert whole == {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in at["packing"]}


def test_empty_table(spark, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}").count() == 0


def test_clashing_columns_and_odd_rows(spark, tmp_path):
    more = ["score", "predicted", "_id", "_key", "_doc", "_tie", "row", "key", "doc", "tie", "kept", "keeper", "again", "nth", "long", "bands"]
    text = "a text of some words that stands here twice and is long enough to be cut where it comes again, word for word, in full"
    rows = [(1, text), (1, text), (None, text + " and more words after it, many more than before"), (None, None), (None, None), (2, ""), (2, ""), (3, "!!"), (3, "other words"), (4, "x" * 150), (4, "x" * 150), (5, "short")]
    values = [(i, t, "en", "s", len(t or ""), *[f"{c}{n}" for c in more]) for n, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in more)
    spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such passage stands in any text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 0), (3, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.kept(stage(spark, docs, f"{tmp_path}"), "stage")[0]
        assert docs.columns == before.columns
        at[name] = docs.collect()
        # a row's other columns stay with it
        assert all(len({r[c].removeprefix(c) for c in more}) == 1 for r in at[name])
    assert len(at["toxicity"]) == len(rows)
    kept = at["minhash_near_dedup"]
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "None", "None", "None", "2", "2", "3", "3", "4", "5"]) and len(at["benchmark_decontamination"]) == len(kept)
    cut_ = {(r.doc_id, r.text) for r in at["suffix_array_dedup"]}
    assert (1, text) in cut_ and (None, " and more words after it, many more than before") in cut_


def test_repeated_rows_lose_their_text(spark):
    from taskframe.llm import suffixes

    text = "".join(random.Random(3).choices("abcdefgh ", k=300))
    df = spark.createDataFrame([(7, text, k) for k in range(3)] + [(7, "short", 3), (7, "short", 4)], "doc_id long, text string, k int")
    got = suffixes.remove_repeats(df).collect()
    assert sorted(r.k for r in got) == [0, 1, 2, 3, 4] and sorted(r.text for r in got) == sorted(["", "", text, "short", "short"])
