"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

A text that holds enough seeds of a test item is aligned with the item around the places the seeds point at. The score
is the best local alignment (match 1, mismatch and gap -1) over the item's length: 1 for a verbatim copy, 1 - 2 e where
a share e of the words is changed.

Seeds are an item's word pairs but its most frequent ones. An alignment of score s has m matches and at most m - s
edits, which cut the matches into at most m - s + 1 runs, so at least s - 1 word pairs of the item stand in the text as
they are. Of these pairs' places about half may be left out as too frequent; the rest must be seeds that the text holds.
No text at the threshold is lost by that, however often the item leaked and whether or not its other pairs occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .features import BATCH_BYTES, Words
from .graphs import FILTER_BITS, key_filter, may_hold
from .suffixes import _doc, _texts, _tie

SEED, THRESHOLD = 2, 0.5
#: Items of fewer words are too short to be evidence inside a text: they match a text that has the same words and no others.
LEAST_WORDS = 5


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """Best local alignment score of two word sequences. A row of the matrix is one array step: gaps along the row are
    a running maximum, as each costs 1 per word."""
    if not len(item) or not len(passage):
        return 0
    step = np.arange(len(passage) + 1)
    row, best = np.zeros(len(passage) + 1, np.int64), 0
    for word in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == word, 1, -1), row[1:] - 1, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + step) - step
        best = max(best, int(row.max()))
    return best


def diagonals(at: np.ndarray, n: np.ndarray, item_at: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Distinct text places at which seeds would make the item begin: seed k stands at the next n[k] places `at` of the
    text and the next m[k] places `item_at` of the item. Grows by the text's length for each place of a repeated seed."""
    out, ends, item_ends = np.zeros(0, np.int64), np.cumsum(n), np.cumsum(m)
    once = np.repeat(m == 1, n)
    if once.any():
        out = np.unique(at[once] - np.repeat(item_at[item_ends - m], n)[once])
    for k in np.flatnonzero(m > 1):
        for place in item_at[item_ends[k] - m[k] : item_ends[k]]:
            out = np.union1d(out, at[ends[k] - n[k] : ends[k]] - place)
    return out


def passages(diagonals: np.ndarray, length: int, n_words: int, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Word ranges to align: around each text place where seeds would make the item begin, joined where they meet. An
    alignment at the threshold has at most 1 - threshold of the item's length in gaps."""
    at = np.unique(diagonals)
    margin = int(length * (1 - threshold)) + 2
    low, high = np.maximum(at - margin, 0), np.minimum(at + length + margin, n_words)
    new = np.concatenate([[True], low[1:] > np.maximum.accumulate(high)[:-1]])
    head = np.flatnonzero(new)
    stop = np.maximum.accumulate(high)
    return list(zip(low[head].tolist(), stop[np.append(head[1:], len(at)) - 1].tolist()))


def _item_words(benchmark: DataFrame) -> DataFrame:
    """(item, words, item_id, copies): items of the same words are one. `item` is their digest, item_id the smallest id."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 1, BATCH_BYTES):
                w = Words(batch.column(1))
                packed = [w.hash[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:])]
                yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary())], ["item_id", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = items.mapInArrow(common.tidied(split), "item_id long, words binary").filter(F.octet_length("words") > 0)
    return words.groupBy("words").agg(F.min("item_id").alias("item_id"), F.greatest(F.countDistinct("item_id"), F.lit(1)).alias("copies")).withColumn("item", _tie(F.sha2("words", 256)))


def _grams(words: np.ndarray) -> np.ndarray:
    h = np.full(max(len(words) - SEED + 1, 0), SEED, np.uint64)
    for k in range(SEED):
        h = common.mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)])
    return h


def _item_grams(items: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [_grams(np.frombuffer(w.as_py(), np.uint64)) for w in batch.column(1)]
            n = np.array([len(g) for g in grams], np.int64)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.concatenate([*grams, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(at), pa.array(np.repeat(n + SEED - 1, n))], ["item", "gram", "at", "length"])

    return items.mapInArrow(common.tidied(cut), "item long, gram long, at long, length long")


def _gram_filter(grams: DataFrame) -> Broadcast:
    """A filter of fixed size, broadcast."""
    bits = [F.col("gram").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("gram", 32).bitwiseAND(FILTER_BITS - 1)]
    return grams.sparkSession.sparkContext.broadcast(key_filter(grams.select("gram").distinct(), "gram", bits))


def _hits(texts: pa.Array, words: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, gram, row, place of its first word in the row's text) of the grams in texts that the filter may hold."""
    mask = np.uint64(FILTER_BITS - 1)
    w = Words(texts)
    h = _grams(w.hash)
    hit = np.flatnonzero(may_hold(words, (h & mask).astype(np.int64), (h >> np.uint64(32) & mask).astype(np.int64)))
    hit = hit[w.doc[hit] == w.doc[hit + SEED - 1]]
    row = w.doc[hit]
    return w, h[hit].view(np.int64), row, hit - w.first[row]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, tie, item_id, copies, score) of every text and item whose alignment reaches the threshold. Items of the same
    words are one: item_id is their smallest id, copies their number.

    Test grams reach the texts as filters of fixed size, matches meet the items in a join, so neither table has to be
    small. A first pass only counts the grams in its tasks; a second one sends the seeds' places, a row for each text and
    gram. Null texts are empty. Items without words take no part; null item_ids stay null. An item of fewer than LEAST_WORDS words matches, with
    score 1, the texts that consist of its words.
    """
    spark = docs.sparkSession
    texts = _texts(docs)
    every, _ = common.kept(_item_words(benchmark), "items")
    items = every.filter(F.octet_length("words") >= 8 * LEAST_WORDS)
    grams, _ = common.kept(_item_grams(items.select("item", "words")), "item-grams")
    item_filter = _gram_filter(grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 2, BATCH_BYTES):
                w, h, _, _ = _hits(batch.column(2), item_filter.value)
                gram, n = np.unique(h, return_counts=True)
                size = np.diff(w.first)
                few = np.flatnonzero((size > 0) & (size < LEAST_WORDS))
                packed = [w.hash[w.first[i] : w.first[i + 1]].tobytes() for i in few]
                take = pa.array(np.concatenate([np.full(len(gram), -1), few]))
                take = pa.array(np.asarray(take), mask=np.asarray(take) < 0)
                yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array([None] * len(gram) + packed, pa.binary()), pa.array([*gram.tolist(), *[None] * len(few)], pa.int64()), pa.array([*n.tolist(), *[None] * len(few)], pa.int64())], ["doc", "tie", "words", "gram", "n"])

    counted, _ = common.kept(texts.mapInArrow(common.tidied(count), "doc long, tie long, words binary, gram long, n long"), "gram-counts")
    item_filter.destroy()
    counts = counted.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n"))
    ranked = grams.join(counts, "gram", "left").na.fill(0, ["n"])
    # of an item's pairs that every text at the threshold holds, the first half may be left out; the others are needed
    shared = F.greatest(F.ceil(F.col("length") * threshold - 1e-9) - 1, F.lit(1))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "gram", "at")))  # bounded by the item's length
    ranked = ranked.withColumn("out", F.floor(shared / 2)).withColumn("need", shared - F.col("out"))
    seeds = ranked.filter("rank > out AND n > 0").groupBy("gram", "item", "need").agg(F.collect_list("at").alias("item_at"))
    seeds, _ = common.kept(seeds, "seeds")
    seed_filter = _gram_filter(seeds)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 2, BATCH_BYTES):
                _, h, row, at = _hits(batch.column(2), seed_filter.value)
                by = np.lexsort((at, h, row))
                h, row, at = h[by], row[by], at[by]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
                take = pa.array(row[first])
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)), pa.int32()), pa.array(at))
                yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(h[first]), places], ["doc", "tie", "gram", "at"])

    hits = texts.mapInArrow(common.tidied(match), "doc long, tie long, gram long, at array<long>")
    # a list of the text's distinct grams that the item has too
    found = hits.join(seeds, "gram").groupBy("doc", "tie", "item", "need").agg(F.collect_list(F.struct("at", "item_at")).alias("places"), F.sum(F.size("item_at")).alias("held"))
    found, _ = common.kept(found.filter("held >= need").select("doc", "tie", "item", "places"), "candidates")
    seed_filter.destroy()
    near = found.select("doc", "tie").distinct()
    bits = [F.pmod(F.xxhash64("doc", "tie", F.lit(s)), F.lit(FILTER_BITS)) for s in (1, 2)]
    doc_filter = spark.sparkContext.broadcast(key_filter(near, "doc", bits))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            hit = np.flatnonzero(may_hold(doc_filter.value, np.asarray(whole.column(3)), np.asarray(whole.column(4))))
            for batch in common.slices(whole.take(pa.array(hit)), 2, BATCH_BYTES):
                w = Words(batch.column(2))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array([w.hash[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:])], pa.binary())], ["doc", "tie", "words"])

    words = texts.select("doc", "tie", "text", *[b.alias(f"bit{i}") for i, b in enumerate(bits)]).mapInArrow(common.tidied(again), "doc long, tie long, words binary")
    words = words.join(near, ["doc", "tie"], "left_semi").groupBy("doc", "tie").agg(F.min("words").alias("words"))
    pairs = found.join(words, ["doc", "tie"]).join(items.select("item", "item_id", "copies", F.col("words").alias("item_words")), "item")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, passage, places in zip(batch.column(4), batch.column(5), batch.column(6)):
                a, b = np.frombuffer(item.as_py(), np.uint64), np.frombuffer(passage.as_py(), np.uint64)
                at, item_at = (np.asarray(places.values.field(k).flatten(), np.int64) for k in (0, 1))
                n, m = (np.asarray(places.values.field(k).value_lengths(), np.int64) for k in (0, 1))
                best = max(align(a, b[x:y]) for x, y in passages(diagonals(at, n, item_at, m), len(a), len(b), threshold))
                out.append(best / len(a))
            yield pa.record_batch([*batch.columns[:4], pa.array(out, pa.float64())], ["doc", "tie", "item_id", "copies", "score"])

    aligned = pairs.select("doc", "tie", "item_id", "copies", "item_words", "words", "places").mapInArrow(common.tidied(score), "doc long, tie long, item_id long, copies long, score double").filter(F.col("score") >= threshold)
    few = every.filter(F.octet_length("words") < 8 * LEAST_WORDS)
    whole = counted.filter("words IS NOT NULL").select("doc", "tie", "words").distinct().join(few, "words").select("doc", "tie", "item_id", "copies", F.lit(1.0).alias("score"))
    return aligned.unionByName(whole)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, contaminated, score (of the best item, 0 if none reaches the threshold), item_id (null if none;
    ties: the smallest), n_items. Rows with null or repeated doc_id are kept; an empty benchmark flags nothing."""
    best = leaks(docs, benchmark, threshold).groupBy("doc", "tie").agg(F.max(F.struct("score", (-F.col("item_id")).alias("minus"))).alias("best"), F.sum("copies").alias("n_items"))
    best, _ = common.kept(best, "leaks")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _doc().alias("doc"), _tie(F.sha2(text.cast("binary"), 256)).alias("tie"))
    return rows.join(best, ["doc", "tie"], "left").select(
        "doc_id",
        F.col("best").isNotNull().alias("contaminated"),
        F.coalesce("best.score", F.lit(0.0)).alias("score"),
        (-F.col("best.minus")).alias("item_id"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text holds no test item. A row travels as one struct, so no column clashes."""
    bad, _ = common.kept(leaks(docs, benchmark, threshold).select("doc", "tie").distinct(), "leaks")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _doc().alias("doc"), _tie(F.sha2(text.cast("binary"), 256)).alias("tie"))
    return tagged.join(bad, ["doc", "tie"], "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
