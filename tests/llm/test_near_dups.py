import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from taskframe.llm import near_dups
from taskframe.llm.graphs import components

SCHEMA = "doc_id long, text string, key string, class_id long, source string"


def grams(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return Counter([tuple(words[i : i + 5]) for i in range(len(words) - 4)] or [tuple(words)] if words else [])


def brute(rows):
    """class_id of each (doc_id, text) row by comparing all pairs."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, all_ = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if all_ and both * 5 >= all_ * 4:
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    out = {}
    for group in members.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[i] = min(ids, default=None)
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(800)]
    make = lambda n: rng.choices(vocabulary, k=n)
    rows, passage = [], make(40)
    for g in range(12):
        base = make(rng.choice([3, 8, 60, 300]))
        for _ in range(rng.choice([1, 2, 6])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rows += [" ".join(make(15) + passage) for _ in range(15)]
    rows += ["word " * n for n in (4, 5, 50, 60, 62)] + ["A b, C d. e f!", "a B c D e F", "", None, "!!", "", "one"] + [rows[0]] * 6
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(i if i != 4 else None, t) for i, t in zip(ids, rows)]


def test_classes_are_those_of_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "k", 1, "s") for i, t in rows], SCHEMA).repartition(3)
    got = near_dups.classes(df).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter((i, want[k]) for k, (i, _) in enumerate(rows))
    left = near_dups.keep_one(df)
    assert left.columns == df.columns
    texts = [i for k, (i, t) in enumerate(rows) if want[k] == i]
    assert Counter(r.doc_id for r in left.collect()) == Counter(texts)


def test_test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in near_dups.classes(df).collect()} == {i: want[k] for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("block", [512, 40])
def test_copies_that_only_their_original_links(spark, monkeypatch, block):
    # each copy is 0.82 similar to the original and 0.69 to another copy
    monkeypatch.setattr(near_dups, "BLOCK", block, raising=False)
    rng, rows = random.Random(8), []
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(220):
            words = list(base)
            for k in range(6):  # far enough apart to change five shingles each
                words[k * 50 + rng.randrange(5, 45)] = f"e{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame([(i, t, "k", 1, "s") for i, t in rows], SCHEMA).repartition(3)
    assert Counter(r.class_id for r in near_dups.classes(df).collect()) == {0: 221, 221: 221, 442: 221}


@pytest.mark.parametrize("left", [0, 7, 20])
def test_links_are_those_of_all_compared_pairs(left):
    rng, sets = random.Random(left), []
    for _ in range(20):
        base = sets[-1] if sets and rng.random() < 0.7 else rng.sample(range(10**6), 60)
        sets.append(sorted({*base[rng.randrange(9) :], *rng.sample(range(10**6), 3)}))
    left = left or 1
    got = {tuple(sorted(x)) for x in near_dups.links([np.array(s, np.uint64) for s in sets], left).tolist()}
    asked = [(i, j) for i in range(left) for j in (range(left, 20) if left < 20 else range(20)) if i != j]
    want = {tuple(sorted((i, j))) for i, j in asked if len({*sets[i]} & {*sets[j]}) * 5 >= len({*sets[i]} | {*sets[j]}) * 4}

    def groups(edges):
        root = list(range(20))
        for i, j in edges:
            root = [root[i] if r == root[j] else r for r in root]
        return sorted(sorted(k for k in range(20) if root[k] == r) for r in set(root))

    assert got <= want and groups(got) == groups(want)


@pytest.mark.parametrize("block", [1024, 2])
def test_no_link_of_a_chain_is_lost(spark, monkeypatch, block):
    # each text is 0.85 similar to the next and 0.71 to the one after it, so one lost link splits the class
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(8 * 250 + 100)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100]), "k", 1, "s") for i in range(250)]
    got = near_dups.classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.class_id for r in got} == {0} and len(got) == 250


def test_very_long_texts(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    near = list(words)
    for k in range(0, len(near), 400):
        near[k] = "other"
    rows = [(1, " ".join(words), "", 0, ""), (2, " ".join(near), "", 0, ""), (3, " ".join(words[:60_000]), "", 0, ""), (4, "w1 " * 200_000, "", 0, ""), (5, "w1 " * 190_000, "", 0, "")]
    assert {r.doc_id: r.class_id for r in near_dups.classes(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", "", 0, "")] * 3 + [(1, "other words stand here in this one", "", 0, "")], SCHEMA)
    assert near_dups.classes(df).count() == 4 and near_dups.keep_one(df).count() == 2
    assert near_dups.classes(df.limit(0)).count() == 0 and near_dups.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [([1] * 60, [1] * 60), ([5, 9, 1, 300] * 10, [7, 3, 1, 200] * 10)])
def test_signatures_estimate_weighted_jaccard(weights):
    a, b = (np.array(w) for w in weights)
    a, b = np.append(a, [0] * 20), np.append([0] * 0, np.append(b, [0] * 20)) if weights[0] != weights[1] else np.append([0] * 20, b)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    seen = []
    for trial in range(30):
        element = np.arange(len(a), dtype=np.uint64) + np.uint64(1000 * trial)
        both = [near_dups.signatures(np.zeros((w > 0).sum(), np.int64), element[w > 0], w[w > 0], 1)[0] for w in (a, b)]
        assert np.isfinite(both).all()
        seen.append((both[0] == both[1]).mean())
    assert abs(np.mean(seen) - want) < 0.03


def test_components(spark):
    edges = [(b"a", b"b"), (b"c", b"b"), (b"d", b"d"), (b"x", b"y"), (b"x", b"y")] + [(b"%03d" % i, b"%03d" % (i + 1)) for i in range(40)]
    got = {bytes(r.u): bytes(r.root) for r in components(spark.createDataFrame(edges, "u binary, v binary")).collect()}
    assert got == {b"a": b"a", b"b": b"a", b"c": b"a", b"x": b"x", b"y": b"x"} | {b"%03d" % i: b"000" for i in range(41)}
    assert components(spark.createDataFrame([], "u binary, v binary")).count() == 0


def test_shingles_of_few_words():
    row, _, count = near_dups.shingles(pa.array(["", None, "one", "a b c d e", "a a a a a a a"]))
    assert row.tolist() == [2, 3, 4] and count.tolist() == [1, 1, 3]
