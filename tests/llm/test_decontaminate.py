import random

import numpy as np
import pyarrow as pa
import pytest

from taskframe.llm import common, decontaminate
from taskframe.llm.features import BATCH_BYTES
from taskframe.llm.graphs import FILTER_BITS

SCHEMA = "doc_id long, text string, score string, item_id string, words int"


def plain(a, b):
    """Smith-Waterman on word lists, cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@pytest.mark.parametrize("seed", range(5))
def test_alignment(seed):
    rng = np.random.default_rng(seed)
    for _ in range(20):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 30))
        assert decontaminate.align(a, b) == plain(a.tolist(), b.tolist())


def test_passages():
    assert decontaminate.passages(np.array([50, 51, 300, -3]), 10, 305) == [(0, 14), (43, 68), (293, 305)]


def test_leaks_are_those_of_full_alignment(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(500)] + ["the"] * 60
    make = lambda n: rng.choices(vocabulary, k=n)
    items = [make(n) for n in (5, 25, 40, 40, 70)]
    docs = [make(rng.randint(0, 200)) for _ in range(30)]
    for item in items:
        for edits in (0, 0.1, 0.15, 0.45):
            words = [w if rng.random() >= edits else rng.choice(vocabulary) for w in item]
            if edits:
                del words[len(words) // 2]
            docs.append(make(rng.randint(0, 300)) + words + make(rng.randint(0, 20)))
    docs += [items[2]] * 20 + [items[4] * 2 + items[3], make(20_000) + items[2] + make(9)]
    rows = [(i, " ".join(d).upper() if i % 3 else ", ".join(d), "", "", 0) for i, d in enumerate(docs)] + [(None, " ".join(items[1]), "", "", 0), (900, None, "", "", 0), (900, "", "", "", 0)] + [(7000, " ".join(items[3]), "", "", 0)] * 2
    tests = [(i, " ".join(t)) for i, t in enumerate(items)] + [(20, None), (21, ""), (22, "the the"), (3, " ".join(items[3]))]
    df, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(tests, "item_id long, text string")
    got = decontaminate.contamination(df, bench).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, d in enumerate(docs[:-1]):
        full = [plain(t, d) / len(t) for t in items]
        # never a false one; a seed stands in every copy that is not heavily edited
        assert max(full) >= 0.5 or not by[i].contaminated, (i, full)
        if by[i].contaminated:
            assert by[i].score <= max(full) and full[by[i].item_id] == by[i].score
        if max(f for f, t in zip(full, items) if len(t) > 5 or f == 1 or f < 0.5) >= 0.65:
            assert by[i].contaminated and by[i].score == max(full), (i, full)
    assert by[len(docs) - 1].item_id == 2 and by[None].item_id == 1 and not by[900].contaminated and by[7000].item_id == 3
    clean = decontaminate.keep_clean(df, bench)
    assert clean.columns == df.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in got if not r.contaminated)
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.contamination(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("kind", ["substituted", "inserted"])
def test_single_edited_copies_are_found(spark, kind):
    rng, rows, items, want = random.Random(9), [], [], set()
    for i in range(120):
        n = rng.choice([20, 40, 60])
        items.append([f"w{rng.randrange(10**6)}" for _ in range(n)])
        words, edits = list(items[-1]), rng.choice([n // 5, n // 4])
        if kind == "substituted":
            for k in rng.sample(range(n), edits):
                words[k] = f"x{rng.randrange(10**6)}"
        else:
            for k in sorted(rng.sample(range(1, n), edits), reverse=True):
                words.insert(k, f"x{rng.randrange(10**6)}")
        # the corpus holds one copy of each item
        rows.append((i, " ".join([f"y{rng.randrange(10**6)}" for _ in range(30)] + words), "", "", 0))
        if plain(items[-1], words) >= 0.5 * n:
            want.add((i, i))
    df, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(df, bench).collect() if r.contaminated}
    assert len(want) > 100 and got == want


def test_short_items_match_texts_of_the_same_words(spark):
    items = [(1, "Paris"), (2, "yes, of course"), (3, "one two three four"), (4, "one two three four five"), (None, "null id here"), (9, "paris!")]
    rows = [(1, "paris"), (2, "Paris is large"), (3, "Yes of course."), (4, "one  two three FOUR"), (5, "so one two three four five it is"), (6, "null id here"), (7, ""), (8, None), (None, "PARIS"), (1, "clean text")]
    df = spark.createDataFrame([(i, t, 1, 2, "r", 4) for i, t in rows], "doc_id long, text string, doc int, tie int, `row` string, _doc int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, bench).collect()
    assert sorted((str(r.doc_id), r.contaminated, r.score, str(r.item_id), r.n_items) for r in got) == sorted(
        [("1", True, 1.0, "1", 2), ("2", False, 0.0, "None", 0), ("3", True, 1.0, "2", 1), ("4", True, 1.0, "3", 2), ("5", True, 1.0, "4", 1), ("6", True, 1.0, "None", 1), ("7", False, 0.0, "None", 0), ("8", False, 0.0, "None", 0), ("None", True, 1.0, "1", 2), ("1", False, 0.0, "None", 0)]
    )
    clean = decontaminate.keep_clean(df, bench)
    assert clean.columns == df.columns and sorted(str(r.text) for r in clean.collect()) == ["", "None", "Paris is large", "clean text"]


def test_a_leaked_item_and_its_repeats_in_most_texts(spark):
    item, other = "a rose is a rose is a rose is a rose in any other garden of words".split(), "quite another item of twelve words that only one text ever holds".split()
    rows = [(i, f"text {i} says " + " ".join(item * (1 + i % 3)), "", "", 0) for i in range(60)] + [(100, "rose is a rose is a " * 300, "", "", 0), (101, " ".join(other[:9]), "", "", 0)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item).upper()), (3, " ".join(other))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    words = rows[60][1].split()
    assert all(got[i].score == 1 and got[i].item_id == 1 and got[i].n_items == 2 for i in range(60))
    assert got[100].contaminated == (plain(item, words[:200]) / len(item) >= 0.5) and got[101].item_id == 3 and got[101].score == 0.75


def test_matching_a_batch_of_long_texts_takes_little_memory():
    import tracemalloc

    batch = pa.record_batch([pa.array([f"w{k} some words of a text. " * 800 for k in range(400)])], ["text"])  # 9 MB
    tracemalloc.start()
    try:
        for part in common.slices(batch, 0, BATCH_BYTES):
            decontaminate._hits(part.column(0), np.zeros(FILTER_BITS // 64, np.uint64))
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()
