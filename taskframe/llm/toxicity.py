"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs with one word between them. Training goes
through a bounded sample of labelled rows in one task, since the method is sequential; its per-coordinate rates and L1
term leave a few thousand weights, which are broadcast. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .features import BATCH_BYTES, Words

#: Weights are hashed into 2**BITS places.
BITS = 20
#: The documented bound of the training sample: most rows of each label, picked by a hash of doc_id.
MOST_TOXIC, MOST_CLEAN = 6_000, 12_000
#: And most bytes of their features, 4 each: rows are taken in the order of the hash until these are full.
MOST_BYTES = 512 << 20
#: Learning rate, its offset, L1, L2 and passes: strong L1 and many passes keep few, large weights.
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 5.0, 0.01, 15
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    place: np.ndarray
    weight: np.ndarray
    bias: float


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """For a batch of texts: (row, hashed place) of all words, pairs and skip pairs, with repeats; number of rows."""
    words = Words(texts)
    parts = [(words.doc, words.hash)]
    for skip in (0, 1):
        h, at = words.grams(2, skip)
        parts.append((words.doc[at], h))
    return np.concatenate([d for d, _ in parts]), (np.concatenate([h for _, h in parts]) >> np.uint64(64 - BITS)).astype(np.int64), len(texts)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) after PASSES passes in a fixed random order. Without rows every score is next to 0."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last place is the bias, which has no L1

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
        w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA + L2)
        return w

    rng = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            at = np.append(rows[i], size)
            z_at, n_at = z[at], n[at]
            w = weights(z_at, n_at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            grown = n_at + g * g
            z[at] = z_at + g - (np.sqrt(grown) - np.sqrt(n_at)) / ALPHA * w
            n[at] = grown
    w = weights(z, n)
    return w[:-1], float(w[-1]) if len(rows) else -35.0


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled texts: labels(doc_id, toxic). Labels other than 0 and 1 and null ids are ignored; a doc_id
    labelled twice counts as toxic if once so; of texts with one doc_id the smallest is taken. No labels: score 0."""
    label = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    label = label.withColumn("rank", F.xxhash64("doc_id"))
    taken = [label.filter(F.col("toxic") == t).orderBy("rank", "doc_id").limit(most) for t, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    sample = taken[0].unionByName(taken[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")  # bounded by the sample

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 2, BATCH_BYTES):
                row, place, n = features(batch.column(2))
                both = np.unique(row << BITS | place)
                ends = np.searchsorted(both >> BITS, np.arange(n + 1))
                place = (both & ((1 << BITS) - 1)).astype("<u4")
                packed = [place[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["rank", "toxic", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, size = [], [], 0
        for b in batches:
            for t, p in zip(b.column(1), b.column(2)):
                if size <= MOST_BYTES:
                    rows.append(np.frombuffer(p.as_py(), "<u4"))
                    labels.append(t.as_py())
                    size += rows[-1].nbytes
        w, bias = fit(rows, np.array(labels))
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias))], ["place", "weight"])

    one = texts.groupBy("doc_id", "toxic", "rank").agg(F.min("text").alias("text")).select("rank", "toxic", "text")
    got = one.mapInArrow(common.tidied(extract), "rank long, toxic int, places binary").repartition(1).sortWithinPartitions("rank", "toxic", "places").mapInArrow(common.tidied(learn), "place long, weight double").toPandas()
    bias = got[got.place < 0].weight
    got = got[got.place >= 0].sort_values("place")
    return Model(got.place.to_numpy(), got.weight.to_numpy(), float(bias.iloc[0]) if len(bias) else -35.0)


def _scorer(model: Broadcast, threshold: float) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Of texts: (score, predicted)."""
    m = model.value
    dense = np.zeros(1 << BITS)
    dense[m.place] = m.weight

    def of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        row, place, n = features(texts)
        hit = dense[place] != 0
        both = np.unique(row[hit] << BITS | place[hit])
        total = m.bias + np.bincount(both >> BITS, dense[both & ((1 << BITS) - 1)], n)
        p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return p, (p >= threshold).astype(np.int32)

    return of


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (score >= threshold) of every row.

    Null text counts as empty, and an empty text scores by the bias alone. Rows with null or repeated doc_id are kept.
    Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(shared, threshold)
        for whole in batches:
            for batch in common.slices(whole, 1, BATCH_BYTES):
                yield pa.record_batch([batch.column(0), *map(pa.array, of(batch.column(1)))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidied(apply), "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold. A row travels as one struct, so no column clashes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(shared, threshold)
        for whole in batches:
            row = whole.column(0)
            both = pa.record_batch([row, row.field(at).cast(pa.string())], ["row", "text"])
            for batch in common.slices(both, 1, BATCH_BYTES):
                yield pa.record_batch([batch.column(0).filter(pa.array(of(batch.column(1))[1] == 0))], ["row"])

    return rows.mapInArrow(common.tidied(apply), rows.schema).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a model that learns only outside fold 2 of 4."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(crc_fold(F.col("doc_id"), 4) != 2))
    scored = score(docs, model)
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
