"""Language identification by multinomial naive Bayes over hashed character n-grams.

Features are the hashed runs of 2 and 3 characters of the lower-case text, and its single characters. The model is the
matrix of log-probabilities, places by languages; scoring adds up its entries at the places a text has, with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .features import BATCH_BYTES, characters, per_row
from .toxicity import crc_fold

BITS, ORDERS, SMOOTHING = 16, (1, 2, 3), 0.5
#: The documented bound of the training sample: most documents of each language.
MOST_DOCS = 4_000
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    langs: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # places by languages; 512 KB a language


def places(code: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (hashed place of the n-gram at each character, mask of those inside one text)."""
    doc_end = np.repeat(ends[1:], np.diff(ends))
    at = np.arange(len(code))
    wide = code.astype(np.uint32)
    for n in ORDERS:
        m = max(len(code) - n + 1, 0)
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ wide[k : k + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        yield (h * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int64), at[:m] + n <= doc_end[:m]


def train(docs: DataFrame) -> Model:
    """Learns every language of docs(doc_id, text, lang). Rows with null text, lang or doc_id are ignored. About
    MOST_DOCS rows of each language at most, picked by a hash of doc_id."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    known = known.withColumn("rank", F.xxhash64("doc_id"))
    # the rank up to which a language's rows are taken, from the ids alone; a hash spreads them evenly
    count = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    if not count:
        return Model([], np.zeros(0), np.zeros((1 << BITS, 0)))
    langs = sorted(r["lang"] for r in count)
    share = {r["lang"]: min(1.0, MOST_DOCS / r["n"]) for r in count}
    upto = F.create_map(*[F.lit(x) for k, s in share.items() for x in (k, int(-(2**63) + s * (2**64 - 1)) if s < 1 else 2**63 - 1)])
    sample = known.withColumn("upto", F.element_at(upto, F.col("lang"))).filter("rank <= upto").select("text", "lang")
    number = {k: i for i, k in enumerate(langs)}

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 0, BATCH_BYTES):
                lang = np.array([number[x.as_py()] for x in batch.column(1)])
                code, ends = characters(batch.column(0))
                of = np.repeat(lang, np.diff(ends))
                key, n = np.unique(np.concatenate([(of[: len(place)] << BITS | place)[inside] for place, inside in places(code, ends)]), return_counts=True)
                yield pa.record_batch([pa.array(key), pa.array(n)], ["key", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([np.asarray(c, "<i8").tobytes()], pa.binary()) for c in batch.columns], ["keys", "counts"])

    counts = np.full(len(langs) << BITS, SMOOTHING)
    totals = sample.mapInArrow(count_grams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    for row in totals.mapInArrow(pack, "keys binary, counts binary").collect():  # at most 2**BITS counts a language
        counts[np.frombuffer(row.keys, "<i8")] += np.frombuffer(row.counts, "<i8")
    counts = counts.reshape(len(langs), -1)
    seen = np.array([dict((r["lang"], r["n"]) for r in count)[k] for k in langs], float)  # priors count all rows
    return Model(langs, np.log(seen / seen.sum()), np.log(counts / counts.sum(1, keepdims=True)).T)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (posterior probability) of every row.

    Null text, or no letter in it: `und`, score 0; so is everything where nothing was learned. Ties go to the language
    that is first in alphabetical order. Rows with null or repeated doc_id are kept; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 512 KB a language

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        columns = np.ascontiguousarray(m.log_prob.T)
        for whole in batches:
            for batch in common.slices(whole, 1, BATCH_BYTES):
                texts = pc.fill_null(batch.column(1), "")
                best, p = np.full(len(texts), len(m.langs)), np.zeros(len(texts))
                if m.langs:
                    code, ends = characters(texts)
                    total = np.tile(m.log_prior, (len(texts), 1))
                    for place, inside in places(code, ends):
                        stop = np.minimum(ends, len(place))
                        for k in range(len(m.langs)):
                            total[:, k] += per_row(np.where(inside, columns[k][place], 0.0), stop)
                    best = total.argmax(1)
                    p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                    none = ~np.asarray(pc.match_substring_regex(texts, r"\p{L}"), bool)
                    best[none], p[none] = len(m.langs), 0.0
                yield pa.record_batch([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(p)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(apply, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a model that learns only outside fold 1 of 3."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs.filter(crc_fold(F.col("doc_id"), 3) != 1))
    return predict(docs, model).select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
