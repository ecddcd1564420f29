"""Rates, means, quantiles, admission times and silences of event streams, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of the decayed rate, runs in the mean, heartbeat interval and timeout in seconds.
RATE_SECONDS, RECENT_RUNS, PING_SECONDS, SILENCE_SECONDS = 30.0, 100, 15, 35


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def decayed_rate(events: DataFrame, group: list[str], ts: str, now_us: int, start_us: int, tau: float = RATE_SECONDS) -> DataFrame:
    """Events a second as of now_us, weighted by exp(-age / tau), for a counter that began at start_us. The fold over
    single events has this closed form, so it is one aggregation."""
    age = (F.lit(now_us) - micros(ts)) / 1e6
    scale = 1 - F.exp(F.lit(-(now_us - start_us) / 1e6 / tau))
    weight = F.exp(-age / tau) / tau
    rate = F.sum(F.when(micros(ts) <= now_us, weight).otherwise(0.0))
    return events.groupBy(*group).agg(F.when(scale > 0, rate / scale).otherwise(0.0).alias("rate"))


def recent_mean(runs: DataFrame, group: list[str], order: list[str], ms: str, last: int = RECENT_RUNS) -> DataFrame:
    """Integer mean of the last `last` runtimes in milliseconds."""
    by = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    top = runs.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= last)
    return top.groupBy(*group).agg(F.expr(f"coalesce(sum({ms}) div count({ms}), 0)").cast("long").alias("mean_ms"))


def quantiles(rows: DataFrame, group: list[str], value: str, exact: bool = False, error: float = 0.01) -> DataFrame:
    """p50 and p99 of each group: exact, or within `error` of the rank by a mergeable sketch."""
    if exact:
        p = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(n) for q, n in ((0.5, "p50"), (0.99, "p99"))]
    else:
        both = F.percentile_approx(value, [0.5, 0.99], int(1 / error))
        p = [both[0].alias("p50"), both[1].alias("p99")]
    return rows.groupBy(*group).agg(*p)


def admissions(requests: DataFrame, group: list[str], at_ns: str, order: list[str], per_second: int) -> DataFrame:
    """When a rate limiter with a burst of one second, empty at first, lets each request through, first come first
    served. The limiter's state after request i is i tau + max(tau rate, max over j <= i of t_j - (j - 1) tau), a
    running maximum. 0 a second is no limit."""
    if not per_second:
        return requests.withColumn("admit_ns", F.col(at_ns))
    second = 1_000_000_000
    tau = second // per_second
    by = Window.partitionBy(*group).orderBy(at_ns, *order)
    rows = requests.withColumn("_n", F.row_number().over(by).cast("long"))
    high = F.max(F.col(at_ns) - (F.col("_n") - 1) * tau).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tat = F.col("_n") * tau + F.greatest(F.lit(per_second * tau), high)
    return rows.withColumn("admit_ns", F.greatest(F.col(at_ns), tat - second)).drop("_n")


def silences(pings: DataFrame, by: str, ts: str, seconds: float = SILENCE_SECONDS) -> DataFrame:
    """(by, last_seen, next_seen): a worker's silences longer than the timeout. The one after its last ping is open and
    not listed."""
    order = Window.partitionBy(by).orderBy(ts)
    return pings.select(by, F.col(ts).alias("last_seen"), F.lead(ts).over(order).alias("next_seen")).filter(micros("next_seen") - micros("last_seen") > int(seconds * 1e6))


def sessions(pings: DataFrame, by: str, ts: str, seconds: int = SILENCE_SECONDS) -> DataFrame:
    """(by, first_seen, n): runs of pings without a silence, by the engine's session windows."""
    window = F.session_window(F.col(ts).cast("timestamp"), f"{seconds} seconds")
    return pings.groupBy(by, window.alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("first_seen"), "n")


def worker_averages(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*group).agg(*[F.avg(c).alias(f"avg_{c}") for c in columns])


def newer_than(status: DataFrame, etag: int) -> DataFrame:
    """A poller that has seen `etag` gets only later versions."""
    return status.filter(F.col("etag") > etag)


def long_polls(polls: DataFrame, versions: DataFrame, group: str) -> DataFrame:
    """polls(group, poll, etag, at, least, most) with `reply_at` and the `version` they then see: as soon as the counter
    is above etag, at the latest after `most`, never before `least`. versions(group, etag, at) is how the counter grew.
    A later poll with the version it got waits for the next one. Times and spans share one unit."""
    asked = polls.select(group, "etag", F.lit(None).cast("long").alias("seen"), F.struct("poll", "at", "least", "most").alias("p"))
    grown = versions.select(group, "etag", F.col("at").cast("long").alias("seen"), F.lit(None).cast(asked.schema["p"].dataType).alias("p"))
    later = Window.partitionBy(group).orderBy("etag").rangeBetween(1, Window.unboundedFollowing)
    waiting = asked.unionByName(grown).withColumn("above", F.min("seen").over(later)).filter("p IS NOT NULL")
    end = F.col("p.at") + F.col("p.most")
    reply = F.greatest(F.col("p.at") + F.col("p.least"), F.least(F.when(F.col("above").isNotNull(), F.greatest("above", F.col("p.at"))), end))  # least leaves null out
    replies = waiting.select(group, F.col("p.poll").alias("poll"), reply.alias("at"), F.lit(None).cast("long").alias("etag"))
    both = replies.unionByName(versions.select(group, F.lit(None).cast(replies.schema["poll"].dataType).alias("poll"), F.col("at").cast("long").alias("at"), F.col("etag").cast("long").alias("etag")))
    upto = Window.partitionBy(group).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("version", F.coalesce(F.max("etag").over(upto), F.lit(0))).filter("poll IS NOT NULL").select(group, "poll", F.col("at").alias("reply_at"), "version")
