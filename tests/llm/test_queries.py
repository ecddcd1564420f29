"""Every registered query on the smallest tables, against plain versions of what it has to return."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from taskframe.llm import common, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def ids_of(documents, name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(common.tokenizer_path(name))
    return {i: tokenizer.encode(r.text or "", add_special_tokens=False).ids for i, r in documents.items()}


def test_token_ids(spark, documents):
    ids, at, want = ids_of(documents, common.WORD_TOKENIZER), 0, set()
    for i in sorted(ids):
        own = [*ids[i], 2]
        want.add((i, at, len(own), crc(own)))
        at += len(own)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op1_token_id_output")} == want


def test_packing(spark, documents):
    ids, got = ids_of(documents, common.WORD_TOKENIZER), rows(spark, "op7_packing")
    by, sequences = {}, Counter()
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        sequences[r.sequence_id] += 1
        assert r.bucket == r.length and r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0
    assert set(sequences.values()) == {1}
    for i, own in ids.items():
        own, at = [*own, 2], 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == crc(own[at : at + r.length]) and r.doc_tokens == len(own)
            at += r.length
        assert at == len(own)


def test_token_counts(spark, documents):
    ids = ids_of(documents, common.BYTE_TOKENIZER)
    want = {(i, len((documents[i].text or "").encode()), len(x), len(x) > 1024) for i, x in ids.items()}
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, "op10_token_counts")} == want


@pytest.mark.parametrize(("name", "folds", "out"), [("op3_toxicity", 4, 2), ("op9_language_id", 3, 1)])
def test_folds_of_classifiers(spark, documents, name, folds, out):
    got = rows(spark, name)
    assert sorted(r.doc_id for r in got) == sorted(documents) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) for r in got)
    if name.startswith("op3"):
        assert all(r.predicted == (r.score >= 0.3) for r in got)
    else:
        assert {r.lang_pred for r in got} <= {d.lang for d in documents.values()} | {"und"}
        assert np.mean([r.lang_pred == documents[r.doc_id].lang for r in got if r.held_out]) > 0.9


def test_repeats(spark, documents):
    seen, want = set(), set()
    for i in sorted(documents):
        t, lost = (documents[i].text or "").encode(), set()
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                lost.update(range(p, p + 100))
            seen.add(t[p : p + 100])
        want.add((i, len(t), len(lost), sum(p - 1 not in lost for p in lost), hashlib.sha256(bytes(b for p, b in enumerate(t) if p not in lost)).hexdigest()))
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op5_suffix_array_dedup")} == want


def test_neighbours(spark):
    got = {}
    for r in rows(spark, "op6_nearest_neighbours"):
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    fine = {r.vec_id: np.array(r.embedding, float) for r in table if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)}
    want = {q: sorted((float(np.sqrt(((v - fine[q]) ** 2).sum())), j) for j, v in fine.items() if j != q)[:10] for q in fine if q % 100 == 0}
    assert set(got) == set(want)
    hits = [len({j for _, j in got[q].values()} & {j for _, j in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.95 and all(sorted(g) == list(range(1, len(want[q]) + 1)) for q, g in got.items())


def test_leaks(spark, documents):
    got = rows(spark, "op8_benchmark_decontamination")
    items = {r.item_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    holds = {i for i, d in documents.items() if any(x in " ".join((d.text or "").lower().split()) for x in items.values())}
    assert sorted(r.doc_id for r in got) == sorted(documents) and holds <= {r.doc_id for r in got if r.contaminated}
