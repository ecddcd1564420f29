"""Analytics on task graphs: edges (src, dst) say that dst needs src.

Recursion is a driver loop over DataFrames. Each round joins a frontier to the edges and is written to the shared
folder, which counts it; the loop ends when a round adds nothing. The number of rounds is the depth of the graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import counted, kept, release, remove, scratch

#: Rounds after which a loop's rows are written as one table; most rows of a broadcast.
COMPACT, BROADCAST = 12, 50_000
#: Nodes for each block of a set of ancestors; bytes of sets in a batch.
BLOCK, BATCH = 4_000_000, 16 << 20


class CycleError(ValueError):
    pass


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes(id)."""
    ids = nodes.select("id").hint("merge")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


class _Rounds:
    """The rows of all rounds of a loop. Now and then they are written as one table, so that plans stay short."""

    def __init__(self, rows: DataFrame):
        self.rows, self.n, self.path = rows, 0, None

    def add(self, rows: DataFrame) -> None:
        self.rows, self.n = self.rows.unionByName(rows), self.n + 1
        if self.n % COMPACT == 0:
            old = self.path
            self.rows, self.path = kept(self.rows, "rounds")
            if old:
                remove(self.rows.sparkSession, old)


def _followed(front: DataFrame, n: int, edges: DataFrame) -> DataFrame:
    """Edges that start at one of the n different nodes of front(id). Only few nodes are broadcast: Spark would go by the
    size of files, in which many rows are small."""
    return edges.join(front.withColumnRenamed("id", "src").hint("broadcast" if n <= BROADCAST else "shuffle_hash"), "src")


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, distance) of all nodes reachable from start(id), those at distance 0 included, up to `depth` steps."""
    spark = edges.sparkSession
    front, n, _ = counted(start.select("id").distinct(), "front")
    seen, distance = _Rounds(front.withColumn("distance", F.lit(0))), 0
    while n and (depth is None or distance < depth):
        distance += 1
        step = _followed(front, n, edges).select(F.col("dst").alias("id")).distinct()
        front, n, _ = counted(step.join(seen.rows.select("id").hint("merge"), "id", "left_anti"), "front")
        if n:
            seen.add(front.withColumn("distance", F.lit(distance)))
    release(spark)
    return seen.rows


def at_distance(edges: DataFrame, source: int, distance: int) -> DataFrame:
    """Nodes whose shortest path from `source` has exactly so many edges."""
    start = edges.sparkSession.range(source, source + 1)
    return reach(edges, start, distance).filter(F.col("distance") == distance).select("id")


def _distinct(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (group, value), in order. Where both fit into one number, that is sorted, which is several times faster."""
    low = int(value.min()) if len(value) else 0
    span = int(value.max()) - low + 1 if len(value) else 1
    if span * (int(group.max()) + 1 if len(group) else 1) < 1 << 62:
        key = np.sort(group * span + (value - low))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
        return key // span, key % span + low
    by = np.lexsort((value, group))
    group, value = group[by], value[by]
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])])[: len(value)]
    return group[new], value[new]


def _packed(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, count of each row) of binary rows of packed 64-bit numbers; null counts as empty."""
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    data = ids.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.int64) if data is not None and ends[-1] > ends[0] else np.zeros(0, np.int64)
    return flat, np.diff(ends) // 8


def _unions(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by (id, block): first the sets that reach it (level null), then what to do with their union: level -1
    puts it out, with its numbers only if `whole`, others send it to `dsts`. `own` adds the id itself. One union is held
    between batches, so a node's many sets need no room at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept_ = None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            id_, block = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            level = np.asarray(pc.fill_null(batch.column(2), -2))
            own = np.flatnonzero(np.asarray(batch.column(5).cast(pa.int8())))
            group = np.cumsum(np.concatenate([[False], (id_[1:] != id_[:-1]) | (block[1:] != block[:-1])]).astype(np.int64))
            flat, n = _packed(batch.column(4))
            if last != (id_[0], block[0]):
                kept_ = kept_[:0]
            which, value = _distinct(np.concatenate([np.zeros(len(kept_), np.int64), np.repeat(group, n), group[own]]), np.concatenate([kept_, flat, id_[own]]))
            n = np.bincount(which, minlength=group[-1] + 1)
            last, kept_ = (id_[-1], block[-1]), value[len(value) - n[-1] :].copy()
            sets = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.concatenate([[0], np.cumsum(n)]) * 8).astype(np.int32)), pa.py_buffer(value)])
            at = np.flatnonzero((level == -1) | (level >= 0) & (n[group] > 0))
            bare = (level[at] == -1) & (not whole)
            size = np.cumsum(np.where(bare, 0, n[group[at]] * 8))
            start = 0
            while start < len(at):
                stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + BATCH, "right")))
                rows, take = pa.array(at[start:stop]), pa.array(group[at[start:stop]], mask=bare[start:stop])
                yield pa.record_batch([*(c.take(rows) for c in batch.columns[:4]), sets.take(take), pa.array(n[group[at[start:stop]]])], ["id", "block", "level", "dsts", "ids", "n"])
                start = stop

    return run


def _ancestors(edges: DataFrame, whole: bool) -> DataFrame:
    """(id, block, ids, n): of every node, the number and, if `whole`, the packed numbers of itself and its ancestors.

    Nodes are taken by levels. A node's set is the union of its parents' sets, so a set is sent once along each edge, and
    no pair is looked up among those found before. Until its turn a set waits with its receivers, once for each of their
    levels. Sets are cut in blocks by a hash, one for BLOCK nodes, and so are lists of receivers.
    """
    spark = edges.sparkSession
    once = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    level = levels(once, once.select(F.col("src").alias("id")).union(once.select("dst")).distinct())
    n, top = level.agg(F.count("*"), F.max("level")).first()
    blocks, path = 1 + n // BLOCK, scratch(spark, "ancestors")
    schema = "id long, block int, level int, dsts array<long>, ids binary, n long"
    if not n:
        return spark.createDataFrame([], schema).select("id", "block", "ids", "n")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    to = once.join(level.select(F.col("id").alias("dst"), "level").hint("merge"), "dst").groupBy(F.col("src").alias("id"), "level", place("dst").alias("part")).agg(F.collect_list("dst").alias("dsts"))
    to = to.join(level.select("id", F.col("level").alias("at")).hint("merge"), "id").select("id", "level", "dsts", "at")
    own = level.select("id", F.lit(-1).alias("level"), F.lit(None).cast("array<long>").alias("dsts"), F.col("level").alias("at"))
    todo, _ = kept(to.unionByName(own).sortWithinPartitions("at"), "receivers")
    for k in range(top + 1):
        rows = todo.filter(F.col("at") == k).select("id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "level", "dsts", F.lit(None).cast("binary").alias("ids"))
        rows = rows.withColumn("own", (F.col("level") == -1) & (F.col("block") == place("id")))
        if k:
            sent = spark.read.schema("dsts array<long>, block int, ids binary").parquet(f"{path}/level={k}")
            rows = rows.unionByName(sent.select(F.explode("dsts").alias("id"), "block", F.lit(None).cast("int").alias("level"), F.lit(None).cast("array<long>").alias("dsts"), "ids", F.lit(False).alias("own")))
        rows = rows.repartition("id", "block").sortWithinPartitions("id", "block", "level")
        rows.mapInArrow(_unions(whole), schema).write.mode("append").option("compression", "zstd").partitionBy("level").parquet(path)
        if k:
            remove(spark, f"{path}/level={k}")
    release(spark)
    return spark.read.schema("id long, block int, ids binary, n long").parquet(f"{path}/level=-1")


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every path. Nodes are whole numbers; an edge with a null end is none."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, n = _packed(batch.column(1))
            dst = np.repeat(np.asarray(batch.column(0)), n)
            at = np.flatnonzero(src != dst)
            for k in range(0, len(at), BATCH // 16):
                yield pa.record_batch([pa.array(src[at[k : k + BATCH // 16]]), pa.array(dst[at[k : k + BATCH // 16]])], ["src", "dst"])

    return _ancestors(edges, True).select("id", "ids").mapInArrow(pairs, "src long, dst long").select(*[F.col(c).cast(edges.schema[c].dataType) for c in ("src", "dst")])


def ancestor_counts(edges: DataFrame) -> DataFrame:
    """(id, n_ancestors) of every node that has ancestors: how many pairs of `closure` end in it."""
    rows = _ancestors(edges, False).groupBy("id").agg((F.sum("n") - 1).alias("n_ancestors"))
    return rows.filter("n_ancestors > 0").select(F.col("id").cast(edges.schema["dst"].dataType), "n_ancestors")


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, level): the number of edges on the longest path that ends in the node.

    A round places the nodes whose dependencies are all placed. It follows only the edges of the nodes that the last one
    placed, and counts for each node how many of its dependencies are met; an edge is followed once. If edges are left
    over, there is a cycle, or they start at unknown nodes: paths from those do not count.
    """
    spark = nodes.sparkSession
    once = edges.select("src", "dst").distinct()
    need = once.groupBy("dst").agg(F.count("*").alias("need"))
    edges, left, _ = counted(once.join(need.hint("merge"), "dst").select("src", "dst", "need"), "edges")
    entries = nodes.select("id").distinct().join(edges.select(F.col("dst").alias("id")).distinct().hint("merge"), "id", "left_anti")
    now, path, level = entries.select("id", F.lit(0).cast("long").alias("need"), F.lit(0).cast("long").alias("met")), scratch(spark, "levels"), 0
    while True:
        seen = Observation()
        free = F.col("met") == F.col("need")
        now.observe(seen, F.count_if(free).alias("n"), F.sum(F.when(free, F.col("need"))).alias("edges")).write.option("compression", "zstd").parquet(f"{path}/level={level}")
        n, left = seen.get["n"], left - (seen.get["edges"] or 0)
        if not n:
            break
        now = spark.read.schema(now.schema).parquet(f"{path}/level={level}")
        met = _followed(now.filter(free).select("id"), n, edges).select(F.col("dst").alias("id"), "need", F.lit(1).cast("long").alias("met"))
        now = met.unionByName(now.filter(~free)).groupBy("id").agg(F.max("need").alias("need"), F.sum("met").alias("met"))
        level += 1
    release(spark)
    if left:
        known = nodes.select("id").distinct()
        unknown = edges.join(known.select(F.col("id").alias("src")).hint("merge"), "src", "left_anti")
        if unknown.isEmpty():
            raise CycleError("the graph has a cycle")
        levels(edges, known.union(unknown.select("src")))  # raises if there is a cycle
        whole = edges.join(known.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi")
        live = reach(whole, entries).select("id")
        return levels(induced(whole, live), live)
    return spark.read.schema(now.schema.add("level", "integer")).parquet(path).filter("met = need").select("id", "level")


def t_level(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Longest path from an entry: a task's scheduling priority."""
    return levels(edges, nodes)


def b_level(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Longest path to an exit."""
    return levels(reverse(edges), nodes)


def has_cycle(edges: DataFrame) -> bool:
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    try:
        levels(edges, nodes)
    except CycleError:
        return True
    return False


def target_nodes(edges: DataFrame, target: DataFrame) -> DataFrame:
    """The targets and everything they need, by walking backwards from them."""
    return reach(reverse(edges), target).select("id")


def unmet(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, unmet): how many dependencies each node has."""
    count = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("unmet"))
    return nodes.select("id").join(count, "id", "left").select("id", F.coalesce("unmet", F.lit(0)).cast("long").alias("unmet"))


def order_violations(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(src, dst) where order(id, position) does not put src before dst, or misses one of them."""
    at = order.select("id", "position")
    both = edges.join(at.withColumnsRenamed({"id": "src", "position": "p_src"}), "src", "left").join(at.withColumnsRenamed({"id": "dst", "position": "p_dst"}), "dst", "left")
    return both.filter("p_src IS NULL OR p_dst IS NULL OR p_src >= p_dst").select("src", "dst")


def prune_completed(edges: DataFrame, nodes: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without done(id): an edge from a done task is met, so it goes with it."""
    left = nodes.join(done.select("id"), "id", "left_anti")
    return left, induced(edges, left)


def prune_failed(edges: DataFrame, nodes: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without failed(id) and all that needs them."""
    gone = reach(edges, nodes.join(failed.select("id"), "id", "left_semi"))
    left = nodes.join(gone.select("id"), "id", "left_anti")
    return left, induced(edges, left)
