"""Near-duplicates by BagMinHash signatures, banding and verified multiset overlap.

A text is the multiset of its runs of SHINGLE words. Each (shingle, weight level) owns a Poisson process; levels are
grouped into dyadic intervals [0, 1), [1, 2), [2, 4), ... whose processes run at the rate of their length, a point
counting for a text if its level lies below the shingle's weight there. The smallest point in each of the REGISTERS
agrees between two texts with a probability equal to their weighted Jaccard similarity. A text only looks at points
before a time by which its registers are full almost surely, and goes on where one is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .features import BATCH_BYTES, Words
from .graphs import components, filter_bits, key_filter, may_hold

SHINGLE, SIMILARITY = 5, 0.8
#: 20 bands of 5: a pair at similarity 0.8 shares a band with probability 0.9996.
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
#: Members of a block, and bytes of its texts: both about, as members of larger buckets are dealt by a hash.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Sets of which all pairs are looked at one by one, and bytes of multisets that a task keeps for their next group.
FEW, CACHE_BYTES = 12, 32 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xC2B2AE3D27D4EB4F)


def _times(k: int) -> np.uint64:
    return np.uint64(k * int(_STEP) & (1 << 64) - 1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of at most 4,096 texts. A text of fewer words is one shingle."""
    words = Words(texts)
    h, at = words.grams(SHINGLE)
    doc = words.doc[at]
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            more = n[short] > k
            few[more] = common.mix64(few[more] * _STEP + words.hash[words.first[short[more]] + k])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, few])
    key = np.sort(doc.astype(np.uint64) << np.uint64(52) | h >> np.uint64(12))
    first = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1)) != 0)
    return (key[first] >> np.uint64(52)).astype(np.int64), key[first] & np.uint64((1 << 52) - 1), np.diff(first, append=len(key))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n by REGISTERS smallest points of weighted sets; infinite for a row without elements."""
    out = np.full(n * REGISTERS, np.inf)
    total = np.bincount(row, weight, n)
    # dyadic intervals of levels: number 0 is [0, 1), number j is [2**(j-1), 2**j)
    parts = np.frexp(weight - 0.5)[1].clip(0) + 1
    item = np.repeat(np.arange(len(row)), parts)
    level = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
    seed = common.mix64(element[item] + level.astype(np.uint64) * _LEVEL)
    low = np.where(level > 0, np.int64(1) << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    own, most = row[item], weight[item] - low
    todo, reach = total > 0, (np.log(REGISTERS) + 4) / np.maximum(total, 1)
    while todo.any():
        live = np.flatnonzero(todo[own])
        time, k = np.zeros(len(live)), 0
        while len(live):
            h = common.mix64(seed[live] + _times(2 * k))
            time = time - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (width[live] * float(REGISTERS))
            inside = time <= reach[own[live]]
            live, time = live[inside], time[inside]
            spot = common.mix64(seed[live] + _times(2 * k + 1))
            counts = (spot >> np.uint64(32)).astype(np.int64) % width[live] < most[live]
            np.minimum.at(out, own[live[counts]] * REGISTERS + ((spot & np.uint64(0xFFFFFFFF)) % np.uint64(REGISTERS)).astype(np.int64)[counts], time[counts])
            k += 1
        todo &= np.isinf(out.reshape(n, -1)).any(1)
        reach = reach * 2
    return out.reshape(n, REGISTERS)


def band_keys(points: np.ndarray) -> np.ndarray:
    """rows by BANDS 64-bit keys."""
    bits = points.view(np.uint64).reshape(len(points), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bits.shape[:2])
    for k in range(ROWS):
        key = common.mix64(key * _STEP + bits[:, :, k])
    return key


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batch, column, BATCH_BYTES):
        for at in range(0, part.num_rows, 4096):
            yield part.slice(at, 4096)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(text).alias("key"), text.alias("text"))


def _key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _runs(whole, 2):
            row, element, count = shingles(batch.column(2))
            n = batch.num_rows
            keys = band_keys(signatures(row, element, count, n)).view(np.int64)
            some = np.bincount(row, minlength=n) > 0
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.ravel()), mask=pa.array(~some))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.asarray(pc.binary_length(batch.column(2)), np.int64)), bands], ["doc_id", "key", "size", "bands"])


def _expanded(texts: pa.Array) -> list[np.ndarray]:
    """Each text's multiset as a sorted array: the k-th occurrence of a shingle is an element of its own."""
    row, element, count = shingles(texts)
    which = np.repeat(np.arange(len(row)), count)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    value = common.mix64(element[which] * _STEP + nth.astype(np.uint64) * _LEVEL)
    ends = np.searchsorted(row[which], np.arange(len(texts) + 1))
    return [np.sort(value[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _packed(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, str]:
    """(key, packed) of the texts with given keys, compressed. A bounded key filter keeps most other texts out."""
    words = docs.sparkSession.sparkContext.broadcast(key_filter(keys, "key"))  # of fixed size

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, seen = zstandard.ZstdCompressor(level=3), set()
        for whole in batches:
            hit = may_hold(words.value, *(np.asarray(whole.column(c)) for c in (2, 3)))
            key = whole.column(0).to_pylist()
            take = []
            for i in np.flatnonzero(hit):  # copies go once from a task
                if key[i] not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(key[i])
                    take.append(i)
            for batch in _runs(whole.take(pa.array(take, pa.int64())), 1):
                yield pa.record_batch([batch.column(0), pa.array([zip_.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], ["key", "packed"])

    near = _keyed(docs).select("key", "text", *filter_bits("key")).mapInArrow(common.tidied(press), "key binary, packed binary")
    kept = common.kept(near.groupBy("key").agg(F.min("packed").alias("packed")), "packed", "none")
    words.destroy()
    return kept


class _Sets:
    """Multisets of compressed texts; a bounded number of them stays for the next batch."""

    def __init__(self) -> None:
        self.press, self.held, self.size = zstandard.ZstdDecompressor(), {}, 0

    def of(self, keys: list[bytes], packed: pa.Array) -> list[np.ndarray]:
        if self.size > CACHE_BYTES:
            self.held, self.size = {}, 0
        new, out = {}, dict.fromkeys(keys)
        for i, key in enumerate(keys):
            if key in self.held:
                out[key] = self.held[key]
            else:
                new[key] = i
        names, texts, size = [], [], 0
        for n, (key, i) in enumerate(new.items(), 1):
            names.append(key)
            texts.append(self.press.decompress(packed[i].as_py()))
            size += len(texts[-1])
            if size > BATCH_BYTES or len(texts) == 4096 or n == len(new):
                out.update(zip(names, _expanded(pa.array(texts, pa.binary()).cast(pa.string()))))
                names, texts, size = [], [], 0
        for key in new:
            self.held[key] = out[key]
            self.size += out[key].nbytes
        return [out[key] for key in keys]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(b) else 0


def _near(both: float | np.ndarray, a: int | np.ndarray, b: int | np.ndarray) -> bool | np.ndarray:
    return both >= SIMILARITY * (a + b - both) - 1e-9


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of similarity SIMILARITY or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_ = _Sets()
        for whole in batches:
            for batch in common.slices(whole, 2, BATCH_BYTES):
                us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                near = [_near(_shared(a, b), len(a), len(b)) for a, b in zip(sets_.of(us, batch.column(2)), sets_.of(vs, batch.column(3)))]
                yield pa.record_batch([pa.array([x for x, y in zip(c, near) if y], pa.binary()) for c in (us, vs)], ["u", "v"])

    rows = pairs.join(sets.select(F.col("key").alias("u"), F.col("packed").alias("u_packed")), "u").join(sets.select(F.col("key").alias("v"), F.col("packed").alias("v_packed")), "v")
    return rows.select("u", "v", "u_packed", "v_packed").mapInArrow(common.tidied(compare), "u binary, v binary")


def links(values: list[np.ndarray], left: int) -> np.ndarray:
    """Rows (i, j) that join all sets (sorted distinct 64-bit elements) linked by a similarity of SIMILARITY or more:
    a spanning forest. The first `left` sets are compared with the others, or with each other if there are no others."""
    size, n = np.array([len(v) for v in values]), len(values)
    if n <= FEW:
        root, out = list(range(n)), []
        for i in range(left):
            for j in range(left if left < n else i + 1, n):
                if root[i] != root[j] and min(size[i], size[j]) >= SIMILARITY * max(size[i], size[j]) and _near(_shared(values[i], values[j]), size[i], size[j]):
                    root = [root[i] if r == root[j] else r for r in root]
                    out.append((i, j))
        return np.array(out, np.int64).reshape(-1, 2)
    own, element = np.repeat(np.arange(n), size), np.concatenate(values)
    _, element, count = np.unique(element, return_inverse=True, return_counts=True)
    often = np.cumsum(count > 1) - 1
    own, element = own[count[element] > 1], often[element[count[element] > 1]]
    order = np.argsort(element, kind="stable")
    own, element = own[order], element[order]
    right = slice(left, n) if left < n else slice(0, n)
    both = np.zeros((left, right.stop - right.start), np.float32)
    for at in range(0, int(often[-1]) + 1 if n else 0, 4096):
        a, b = np.searchsorted(element, (at, at + 4096))
        holds = np.zeros((n, 4096), np.float32)
        holds[own[a:b], element[a:b] - at] = 1
        both += holds[:left] @ holds[right].T
    near = np.zeros((n, n), bool)
    near[:left, right] = _near(both.astype(np.float64), size[:left, None], size[None, right])
    near |= near.T
    todo, out = np.ones(n, bool), []
    for start in range(n):
        queue = [start] if todo[start] else []
        todo[start] = False
        while queue:
            i = queue.pop()
            new = np.flatnonzero(near[i] & todo)
            todo[new] = False
            queue += new.tolist()
            out += [(i, j) for j in new.tolist()]
    return np.array(out, np.int64).reshape(-1, 2)


def _parts(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")


def _large(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks of buckets of more than one block, links (u, v) found on the way).

    A bucket's centre is the member that meets most others in all its large buckets. Each member is compared with the
    best of its buckets' centres; what this links gets one label. Then the members of a bucket's largest class are dealt
    to blocks of their own, and every two blocks meet but two of the largest class."""
    weight = members.groupBy("key").agg(F.sum("n").alias("weight"))
    centre = members.join(weight, "key").groupBy("bucket").agg(F.max(F.struct("weight", "key")).alias("c"))
    pairs = members.join(centre, "bucket").groupBy("key").agg(F.max("c").alias("c")).filter("key <> c.key")
    found, _ = common.kept(_verified(pairs.select(F.col("key").alias("u"), F.col("c.key").alias("v")), sets), "links")
    # centres lead to centres of more weight: one step further gives nearly every class one label, and any label is right
    label = found.alias("a").join(found.alias("b"), F.col("a.v") == F.col("b.u"), "left").select(F.col("a.u").alias("key"), F.coalesce("b.v", "a.v").alias("root"))
    members, _ = common.kept(members.join(label, "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root"), "size"), "members")
    by_class = members.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    main = by_class.groupBy("bucket").agg(F.max(F.struct("n", "root", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    main = main.filter("n > top.n").select("bucket", F.col("top.root").alias("main"), _parts(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("rest"), _parts(F.col("top.n"), F.col("top.bytes")).alias("more"))
    inside = F.col("root") == F.col("main")
    dealt = members.join(main, "bucket").withColumn("own", F.when(inside, F.col("rest") + F.pmod(F.xxhash64("key"), F.col("more"))).otherwise(F.pmod(F.xxhash64("key"), F.col("rest"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("rest") - 1).otherwise(F.col("rest") + F.col("more") - 1))))
    return dealt.select("bucket", "key", "root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side")), found


def _joined(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): classes of the blocks that a pair of similarity SIMILARITY or more joins, if not through others."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_, of, left, roots, values = _Sets(), None, 0, [], []

        def joined() -> set[tuple[bytes, bytes]]:
            if left == 0 or left == len(roots) and of[1] != of[2]:
                return set()  # the other block is empty
            return {(roots[i], roots[j]) for i, j in links(values, left).tolist() if roots[i] != roots[j]}

        for whole in batches:
            for batch in common.slices(whole, 6, BATCH_BYTES):
                found = set()
                *group, root, key = (batch.column(c).to_pylist() for c in range(6))
                for bucket, low, high, side, r, own in zip(*group, root, sets_.of(key, batch.column(6))):
                    if (bucket, low, high) != of:
                        if of:
                            found |= joined()
                        of, left, roots, values = (bucket, low, high), 0, [], []
                    left += not side
                    roots.append(r)
                    values.append(own)
                yield pa.record_batch([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["u", "v"])
        if of:
            found = joined()
            yield pa.record_batch([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["u", "v"])

    group = ["bucket", "low", "high"]
    rows = blocks.join(sets.select("key", "packed"), "key").select(*group, "side", "root", "key", "packed")
    rows = rows.repartition(common.shuffle_partitions(blocks.sparkSession), *group).sortWithinPartitions(*group, "side")
    return rows.mapInArrow(common.tidied(compare), "u binary, v binary")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, class_id, class_key, keeper, class_size) of every row: rows whose texts are linked, directly or
    through others, by a weighted Jaccard similarity of word 5-gram multisets of 0.8 or more share a class.

    class_id is the class's smallest doc_id (null if it has none), class_key its smallest text digest. `keeper` marks
    exactly the rows with the class's smallest (doc_id, digest), nulls last. Exact copies are one node. A text without
    words (null, empty, punctuation) is similar to nothing: it is a class by itself, with a null class_key and class_id
    = doc_id. Rows with one doc_id but different texts are different nodes. An empty table gives no rows.

    Candidates: every two members of a bucket of a band. Buckets with the same members count once. A bucket of at most
    one block is one group, in which all pairs are looked at; larger ones are dealt to blocks. Nothing is left out.
    """
    spark = docs.sparkSession
    rows, _ = common.kept(_keyed(docs).mapInArrow(common.tidied(_sketch), "doc_id long, key binary, size long, bands array<long>"), "sketches")
    nodes = rows.filter("bands IS NOT NULL").groupBy("key").agg(F.min("bands").alias("bands"), F.min("size").alias("size"))
    members = nodes.select("key", "size", F.explode("bands").alias("bucket"))
    mark = [F.bit_xor(F.xxhash64("key", F.lit(s))).alias(f"mark{s}") for s in (1, 2)]  # of the set of members
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *mark).filter("n > 1")
    shared = shared.groupBy("n", "mark1", "mark2").agg(F.min(F.struct("bucket", "bytes")).alias("b")).select("b.bucket", "n", _parts(F.col("n"), F.col("b.bytes")).alias("parts"))
    members, _ = common.kept(members.join(shared, "bucket").select("bucket", "key", "size", "n", "parts"), "buckets")
    common.release(spark)
    sets, _ = _packed(docs, members.select("key"))
    common.release(spark)
    zero = F.lit(0)
    blocks = members.filter("parts = 1").select("bucket", "key", F.col("key").alias("root"), zero.alias("low"), zero.alias("high"), zero.alias("side"))
    large = members.filter("parts > 1")
    if large.isEmpty():
        roots = components(_joined(blocks, sets))
    else:
        dealt, found = _large(large.select("bucket", "key", "size", "n"), sets)
        roots = components(_joined(blocks.unionByName(dealt), sets).unionByName(found))
    common.release(spark)
    some = rows.filter("bands IS NOT NULL").select("doc_id", "key").join(roots.withColumnRenamed("u", "key"), "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("class_key"))
    best = some.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"), F.count("*").alias("n"))
    out = some.join(best, "class_key").select("doc_id", "key", F.col("best.doc_id").alias("class_id"), "class_key", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))).alias("keeper"), F.col("n").alias("class_size"))
    # a text without words meets no other row
    alone = rows.filter("bands IS NULL").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(None).cast("binary").alias("class_key"), F.lit(True).alias("keeper"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each class one row with its smallest doc_id stays.
    Rows whose text has no words stay. Of several rows with one doc_id and one text, one stays. The row travels as one
    struct, so that no column of docs can clash with the operator's own."""
    spark = docs.sparkSession
    found, _ = common.kept(classes(docs).select("doc_id", "key", "keeper", "class_size"), "classes")
    # a row that meets no other stays; of the rest, only the keepers, once each
    crowded = found.filter("class_size > 1").groupBy(F.col("doc_id").alias("id"), F.col("key").alias("digest")).agg(F.max("keeper").alias("keeper"))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), _key(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own_digest"))
    joined = tagged.join(crowded, (F.col("own_digest") == F.col("digest")) & F.col("own_id").eqNullSafe(F.col("id")), "left")
    alone = joined.filter("digest IS NULL").select("row.*")
    once = joined.filter("keeper").dropDuplicates(["digest"]).select("row.*")
    common.release(spark)
    return alone.unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class: class_id is the smallest doc_id of the class."""
    return classes(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


#: All pairs that share a shingle, for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g FROM w),
m AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS total FROM m GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS shared FROM m a JOIN m b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE shared * 5 >= 4 * (x.total + y.total - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM c
"""
