import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from taskframe.llm import suffixes

SCHEMA = "doc_id long, text string, tie string, spans string, n int"


def brute(rows, length=100):
    """Digest columns of (doc_id, text) rows from a dictionary of all windows."""
    texts = [(t or "").encode() for _, t in rows]
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.sha256(texts[i]).hexdigest()[:15], i)
    seen, out = set(), []
    for i in sorted(range(len(rows)), key=key):
        t, lost = texts[i], set()
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                lost.update(range(p, p + length))
            seen.add(w)
        runs = sum(p - 1 not in lost for p in lost)
        out.append((rows[i][0], len(t), len(lost), runs, hashlib.sha256(bytes(b for p, b in enumerate(t) if p not in lost)).hexdigest()))
    return Counter(out)


def report(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup_report(df).collect())


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    passages, base = [make(30) for _ in range(3)], make(200)
    rows = [make(rng.randint(1, 60)) for _ in range(15)]
    rows += [make(rng.randint(0, 9)) + rng.choice(passages) + make(rng.randint(0, 9)) for _ in range(25)]
    rows += [base, base, base[:300] + "X" + base[301:], base[50:], base[:99], base[:100], base[10:110]]
    rows += ["ha" * 200, "ha" * 150, "x" * 99, "x" * 100, "x" * 101, "line\n" * 80, "", None, None, make(5), "\x00" * 150, "\x00" * 120 + "a"]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    ids[3] = None
    ids[7] = ids[9]
    return [*zip(ids, rows), (500, base), (500, base), (500, base), (None, "x" * 130)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 3) for i, t in rows], SCHEMA)


def test_against_all_windows(spark):
    rows = corpus()
    assert report(frame(spark, rows).repartition(3)) == brute(rows)


def test_split_anchors_and_small_shards(spark, monkeypatch):
    # in local mode workers are forked from a daemon that reads the module anew, so parameters travel with the functions
    rows = corpus()
    import pyarrow as pa

    texts = [(i, int(hashlib.sha256((t or "").encode()).hexdigest()[:15], 16), (t or "").encode()) for i, t in rows if i is not None]
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 600)
    dealt = []
    for doc, tie, t in dict.fromkeys(texts):
        flat = np.frombuffer(t, np.uint8)
        for _, first, n, anchor, _ in zip(*suffixes.regions(flat, np.array([0, len(flat)]))):
            dealt.append((int(anchor.view(np.int64)), (doc * 7 + tie) % 5, True, doc, tie, int(first), t[first : first + n + 99]))
    dealt.sort()
    names = ["anchor", "part", "split", "doc", "tie", "start", "bytes"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in dealt[at : at + 50]]) for at in range(0, len(dealt), 50)]
    rows_ = [r for b in suffixes._shards(iter(batches)) for r in b.to_pylist()]
    parts = sorted((r for r in rows_ if r["windows"]), key=lambda r: (r["anchor"], r["slot"]))
    merged = suffixes._merge(iter([pa.RecordBatch.from_pylist([{k: r[k] for k in ("anchor", "slot", "windows")} for r in parts])]))
    runs = [(r["doc"], r["tie"], r["start"], r["n"]) for r in rows_ if r["windows"] is None] + [(r["doc"], r["tie"], r["start"], r["n"]) for b in merged for r in b.to_pylist()]
    late = Counter((d, t, s + k) for d, t, s, n in runs for k in range(n))
    seen, want = set(), Counter()
    for doc, tie, t in sorted(dict.fromkeys(texts)):
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                want[doc, tie, p] += 1
            seen.add(t[p : p + 100])
    assert late == want and sum(r["windows"] is not None for r in rows_) > 20


def test_test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert report(df) == brute([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("letters", ["a", "ab", "abcd\x00\xff"])
def test_suffix_array_and_common_prefixes(letters):
    rng = random.Random(2)
    parts = ["".join(rng.choices(letters, k=rng.randint(1, 40))).encode("latin-1") for _ in range(25)] + [b"a" * 60, b"ab" * 20, b"ab" * 20]
    text, ends = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, parts)))])
    # byte b becomes b + parts, terminators are 0 .. parts - 1
    suffix = [([x + len(parts) for x in parts[i][k:]] + [i], int(ends[i]) + k) for i in range(len(parts)) for k in range(len(parts[i]))]
    suffix.sort()
    order = suffixes.suffix_array(text, ends)
    assert order.tolist() == [at for _, at in suffix]
    same = lambda a, b: next(k for k in range(len(a)) if k >= len(b) or a[k] != b[k])
    assert suffixes.common_prefixes(text, ends, order).tolist() == [0] + [same(a[0], b[0]) for a, b in zip(suffix, suffix[1:])]


def test_removed_text(spark):
    passage = "é" * 30 + "the same passage stands in two documents, word for word, and is long enough to be taken out of the later one"
    df = frame(spark, [(1, "first " + passage), (2, "later " + passage + " end"), (3, None), (4, ""), (5, passage), (6, "clean")])
    got = {r.doc_id: r.text for r in suffixes.remove_repeats(df).collect()}
    assert suffixes.remove_repeats(df).columns == df.columns
    assert got[1] == "first " + passage and got[2] == "later end".replace("later", "later") or got[2].startswith("later")
    assert got[3] is None and got[4] == "" and got[5] == "" and got[6] == "clean" and passage not in got[2]
    assert report(df.limit(0)) == Counter() and suffixes.remove_repeats(df.limit(0)).count() == 0


def test_split_anchors_and_small_shards_through_spark(spark):
    rows = corpus()
    got = suffixes.dedup_report(frame(spark, rows).repartition(3), split=1, shard_bytes=600).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_tables_of_windows_meet(seed):
    rng = np.random.default_rng(seed)
    pool = np.array(sorted(rng.bytes(100) for _ in range(40)), "S100")
    tables, first, late = [], {}, Counter()
    for k in range(7):
        own = np.sort(rng.choice(40, rng.integers(1, 30), replace=False))
        t = np.zeros(len(own), suffixes._SORTED)
        t["doc"], t["tie"], t["start"], t["bytes"] = rng.integers(0, 5, len(own)), k, rng.integers(0, 9, len(own)), pool[own]
        tables.append(t)
    everything = np.concatenate(tables)
    for r in sorted(everything.tolist()):
        if r[3] in first:
            late[r[:3]] += 1
        first.setdefault(r[3], r[:3])
    import pyarrow as pa

    batch = pa.record_batch([pa.array([0] * 7), pa.array([1] * 7, pa.int32()), pa.array([t.tobytes() for t in tables], pa.binary())], ["anchor", "slot", "windows"])
    assert Counter((r["doc"], r["tie"], r["start"]) for b in suffixes._merge(iter([batch])) for r in b.to_pylist()) == late


def test_a_very_long_text_comes_in_pieces(spark):
    rng = random.Random(4)
    own = "".join(rng.choices("abcdefghijklmnop ", k=1_200_000))
    text = own + own[300_000:300_500] + "".join(rng.choices("qrst", k=1_300_000)) + own[1_040_000:1_060_000]
    rows = [(1, text), (2, own[1_048_000:1_050_000])]
    assert report(frame(spark, rows)) == brute(rows)
