"""Scheduling state as relations: what is ready, blocked, running or over, and in which order it goes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import reach

#: Seconds below which a failure counts as a fizzle, and the codes of outcomes without an exit status.
FIZZLE_SECONDS = 5
CANCELLED, DISCONNECTED, SPAWN_FAILED, REMOTE_SPAWN_FAILED, TERMINATED = -10, -1, -1, 13, -15


def initial_ready(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def released(edges: DataFrame, finished: DataFrame) -> DataFrame:
    """Tasks of which every dependency is in finished(id, success) and succeeded."""
    state = edges.join(finished.select(F.col("id").alias("src"), "success"), "src", "left")
    met = state.groupBy(F.col("dst").alias("id")).agg(F.bool_and(F.coalesce("success", F.lit(False))).alias("met"))
    return met.filter("met").select("id")


def outcomes(edges: DataFrame, nodes: DataFrame, failing: DataFrame) -> DataFrame:
    """(id, outcome) once everything has run: a task that any failing task leads to never starts, so it is `blocked`,
    a failing task that does start is `failed`, the rest `success`. Equal to marking children failure by failure."""
    first = edges.join(failing.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    below = reach(edges, first).select("id")  # from the children on, so that a failing task below another is found too
    bad = nodes.select("id").join(failing.select("id", F.lit(True).alias("fails")), "id", "left").join(below.withColumn("below", F.lit(True)), "id", "left")
    return bad.select("id", F.when(F.col("below"), "blocked").when(F.col("fails"), "failed").otherwise("success").alias("outcome"))


def queues(affinity: Column) -> Column:
    """The numbers of the set bits; bit 63 is the sign bit of a BIGINT, so bits are tested one by one."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.bit_get(affinity, i) == 1)


def dispatch(ready: DataFrame, per_queue: int) -> DataFrame:
    """(queue, rank, id): the first tasks of every queue, larger priority first, then id. A task that several queues
    would take goes to the lowest of them only."""
    rows = ready.select("id", "priority", F.explode(queues(F.col("affinity"))).alias("queue"))
    by = Window.partitionBy("queue").orderBy(F.col("priority").desc(), "id")
    top = rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= per_queue)
    return top.groupBy("id").agg(F.min(F.struct("queue", "rank")).alias("q")).select("q.queue", "q.rank", "id")


def unservable(tasks: DataFrame, served_mask: int) -> DataFrame:
    """Tasks that no served queue takes."""
    return tasks.filter(F.col("affinity").bitwiseAND(F.lit(served_mask)) == 0)


def queue_status(states: DataFrame) -> DataFrame:
    """(affinity, num_ready, num_inflight) from states(affinity, state)."""
    return states.groupBy("affinity").agg(F.count_if(F.col("state") == "ready").alias("num_ready"), F.count_if(F.col("state") == "inflight").alias("num_inflight"))


def exit_code(kind: Column, value: Column) -> Column:
    """One integer for how a task ended. Lossy: -1 and -10 each mean more than one thing, so keep `kind` beside it."""
    return (
        F.when(kind == "code", value)
        .when(kind == "signal", -value)
        .when(kind == "cancelled", F.lit(CANCELLED))
        .when(kind == "disconnected", F.lit(DISCONNECTED))
        .when(kind == "spawn", F.lit(SPAWN_FAILED))
        .when(kind == "remote_spawn", F.lit(REMOTE_SPAWN_FAILED))
        .when(kind == "terminated", F.lit(TERMINATED))
    ).cast("int")


def failure_label(kind: Column, started: Column, finished: Column) -> Column:
    """What a failure is called: by its kind, else FIZZLED below FIZZLE_SECONDS after its start, else FAILED."""
    quick = F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp")) < FIZZLE_SECONDS * 1_000_000
    return F.when(kind == "cancelled", "CANCELLED").when(kind == "disconnected", "DISCONNECTED").when(quick, "FIZZLED").otherwise("FAILED")


def progress(finished: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Running counts of finished(…, success) in each group."""
    by = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return finished.withColumns({"done": F.count("*").over(by), "failed": F.count_if(~F.col("success")).over(by)})


def fizzle_cutoff(finished: DataFrame, group: str, order: list[str], allowed: int) -> DataFrame:
    """(group, the row's order columns) where the number of fizzles of a group first reaches `allowed`; 0 is no limit."""
    by = Window.partitionBy(group).orderBy(*order)
    fizzles = finished.filter("label = 'FIZZLED'").withColumn("n", F.row_number().over(by))
    return fizzles.filter(F.col("n") == (allowed or 2**32 - 1)).drop("n")


def drained(started: DataFrame, ready: DataFrame, finished: DataFrame) -> DataFrame:
    """Rows to append for runs that were handed out and never came back: a Finished as disconnected for each, after a
    Started where that is missing too. Tables have (session, key)."""
    by = ["session", "key"]
    open_ = ready.select(*by).join(finished.select(*by), by, "left_anti")
    missing = open_.join(started.select(*by), by, "left_anti")
    return missing.select(*by, F.lit("Started").alias("tag"), F.lit(None).cast("int").alias("status")).unionByName(open_.select(*by, F.lit("Finished").alias("tag"), F.lit(DISCONNECTED).alias("status")))


def cancellation(requests: DataFrame, group: str) -> DataFrame:
    """The state that several requests(kind soft|hard, at) lead to: hard stays hard, of soft times the earliest counts."""
    return requests.groupBy(group).agg(F.bool_or(F.col("kind") == "hard").alias("hard"), F.min(F.when(F.col("kind") == "soft", F.col("at"))).alias("soft_at"))


def completion_order(finished: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """(group, keys in the order they finished)."""
    got = finished.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, key))).alias("rows"))
    return got.select(group, F.transform("rows", lambda r: r[key]).alias("keys"))
