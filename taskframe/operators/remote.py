"""What remote workers and an administrator ask, as relations: replies by HTTP code, the events they lead to, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics
from .schedule import cancellation

#: How long a claim is held before it is sent away, and the endpoints whose latency is kept.
HELD_MS = 30_000
TIMED = ["start", "begun", "end", "ping"]


def claim_code(authorized: Column, job: Column, job_cancelled: Column, shutdown: Column, runner_known: Column, wait_ms: Column) -> Column:
    """The reply to a worker that asks for a task: first failed check first. wait_ms is the time until a task was there
    for it, null for never."""
    return (
        F.when(~authorized, 401)
        .when(job.isNull(), 400)
        .when(job_cancelled | shutdown, 410)
        .when(~runner_known, 404)
        .when(F.coalesce(wait_ms >= HELD_MS, F.lit(True)), 429)
        .otherwise(200)
    )


def transaction_replies(requests: DataFrame, transactions: DataFrame) -> DataFrame:
    """requests(seq, endpoint begun|end|ping, transaction, job, authorized, …) with `code`, `key` and `event`.

    transactions(transaction, key, job, since) are the claims. The first authorized end that names a job, the right one
    or not, closes a transaction; begun and end of one that is closed or was never open get 404, and so does an end with
    another job. A ping is always welcome. `event` is Started or Finished where the reply is 200 and it means one.
    """
    closed = requests.filter((F.col("endpoint") == "end") & F.col("authorized") & F.col("job").isNotNull())
    # an end before the claim closes nothing
    opened = transactions.select("transaction", "key", F.col("job").alias("own_job"), "since")
    closed = closed.join(opened.select("transaction", "since"), "transaction").filter("seq > since").groupBy("transaction").agg(F.min("seq").alias("until"))
    rows = requests.join(opened, "transaction", "left").join(closed, "transaction", "left")
    alive = F.coalesce(F.col("seq") > F.col("since"), F.lit(False)) & F.coalesce(F.col("seq") <= F.col("until"), F.lit(True))
    end, begun = F.col("endpoint") == "end", F.col("endpoint") == "begun"
    code = (
        F.when(~F.col("authorized"), 401)
        .when(~(end | begun), 200)
        .when(end & F.col("job").isNull(), 400)
        .when(~alive, 404)
        .when(F.col("job").isNull(), 400)
        .when(end & (F.col("job") != F.col("own_job")), 404)
        .otherwise(200)
    )
    event = F.when((F.col("code") == 200) & begun, "Started").when((F.col("code") == 200) & end, "Finished")
    return rows.withColumn("code", code).withColumn("event", event).drop("own_job", "since", "until")


def mark_cancelled(requested: DataFrame, running: DataFrame, cancelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the requested job ids that are not running, all that are cancelled by then). Tables have (job)."""
    reply = requested.select("job").join(running.select("job"), "job", "left_anti")
    return reply, cancelled.select("job").union(reply).distinct()


def settings(commands: DataFrame, group: str) -> DataFrame:
    """(group, per_second, provisioner_info, hard, soft_at) after an administrator's commands(seq, at, kind ratelimit|
    provisioner_info|soft|hard, value): of a setting the last counts, of shutdowns as in `cancellation`."""
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, F.col("seq")))
    of = commands.groupBy(group).agg(last("ratelimit").cast("long").alias("per_second"), last("provisioner_info").alias("provisioner_info"))
    return of.join(cancellation(commands.filter(F.col("kind").isin("soft", "hard")), group), group, "left").withColumn("hard", F.coalesce("hard", F.lit(False)))


def latencies(requests: DataFrame, exact: bool = False) -> DataFrame:
    """(endpoint, p50, p99) of requests(endpoint, us) in microseconds, 0 for a timed endpoint that nobody asked."""
    found = metrics.quantiles(requests.filter(F.col("endpoint").isin(TIMED)), ["endpoint"], "us", exact)
    all_ = requests.sparkSession.createDataFrame([(e,) for e in TIMED], "endpoint string")
    return all_.join(found, "endpoint", "left").select("endpoint", *[F.coalesce(p, F.lit(0)).cast("long").alias(p) for p in ("p50", "p99")])
