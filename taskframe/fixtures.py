"""Task graphs, logs and streams derived from the TPC-H-like tables, so that queries have real inputs.

Task graph: a task per part, needing the tasks numbered half and a third of it. Log: a session per year of orders,
a run per customer and year. Streams: the events table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import LOG_VERSION, TAGS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("part-"), "p_partkey").alias("key"), F.expr("shiftleft(1L, p_size % 3)").alias("affinity"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "part").filter("p_partkey >= 1").select(F.col("p_partkey").alias("dst"))
    return ids.select(F.explode(F.array_distinct(F.array(F.expr("dst div 2"), F.expr("dst div 3")))).alias("src"), "dst")


def failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).filter("id % 97 = 13").select("id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per customer and year: the first order. again: an earlier run of the customer succeeded."""
    orders = read(spark, sf_dir, "orders")
    rows = orders.select(F.year("o_orderdate").cast("long").alias("session"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("command"), (F.col("o_orderpriority") == "1-URGENT").alias("bad"))
    first = rows.groupBy("session", "key").agg(F.min(F.struct("at", "ord", "state", "command", "bad")).alias("r")).select("session", "key", "r.*")
    won = first.filter("state = 'F' AND NOT bad").groupBy("key").agg(F.min("session").alias("won"))
    return first.join(won, "key", "left").withColumn("again", F.coalesce(F.col("won") < F.col("session"), F.lit(False))).drop("won")


def seq(at: str, ord_: str, phase: str) -> str:
    """One number that orders a log: day, order, phase."""
    return f"shiftleft(CAST(unix_date(CAST({at} AS DATE)) AS BIGINT), 40) + {ord_} * 8 + {phase}"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, tag, key, session and the five records."""
    r = runs(spark, sf_dir)
    steps = F.expr("CASE WHEN again THEN array(named_struct('phase', 4, 'tag', 'Backref')) ELSE filter(array(named_struct('phase', 1, 'tag', 'Ready'), named_struct('phase', 2, 'tag', 'Started'), named_struct('phase', 3, 'tag', 'Finished')), s -> s.phase = 1 OR s.phase = 2 AND state IN ('P', 'F') OR s.phase = 3 AND state = 'F') END")
    rows = r.withColumn("s", F.explode(steps)).select("session", "key", "at", "command", "bad", F.expr(seq("at", "ord", "s.phase")).alias("seq"), F.col("s.tag").alias("tag"))
    years = read(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("session")).distinct()  # as in runs
    heads = years.select("session", F.lit(None).cast("string").alias("key"), F.expr("make_date(int(session), 1, 1)").cast("timestamp_ntz").alias("at"), F.lit(None).cast("string").alias("command"), F.lit(None).cast("boolean").alias("bad"), F.expr(seq("make_date(int(session), 1, 1)", "0L", "0")).alias("seq"), F.lit("Header").alias("tag"))
    both = rows.unionByName(heads.select(*rows.columns))
    when = "named_struct('secs_since_epoch', unix_seconds(CAST(at AS TIMESTAMP)), 'nanos_since_epoch', 0)"
    record = {
        "Header": f"named_struct('version', {LOG_VERSION}L, 'time', {when}, 'user', 'user', 'hostname', 'host', 'workflow_key', 'orders', 'cmdline', array('run'), 'workdir', '/w', 'pid', session, 'storage_roots', array('', concat('out/', session)))",
        "Ready": f"named_struct('time', {when}, 'key', key, 'runcount', 0L, 'command', command, 'r', 0L)",
        "Started": f"named_struct('time', {when}, 'key', key, 'host', 'host', 'pid', session, 'slurm_jobid', '')",
        "Finished": f"named_struct('time', {when}, 'key', key, 'status', IF(bad, 1, 0), 'values', array(map('priority', command)))",
        "Backref": "named_struct('key', key)",
    }
    return both.select("seq", "tag", "key", "session", *[F.expr(f"CASE WHEN tag = '{t}' THEN {record[t]} END").alias(t) for t in TAGS])


#: DuckDB forms of the same fixtures, as common table expressions.
SQL_TASKS = """tasks AS (SELECT p_partkey AS id, 'part-' || p_partkey AS key, CAST(1 << (p_size % 3) AS BIGINT) AS affinity FROM part),
edges AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey >= 1 UNION ALL SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey >= 1))"""
SQL_CLOSURE = "closure AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM closure c JOIN edges e ON c.dst = e.src)"
SQL_LEVELS = "steps AS (SELECT id, 0 AS level FROM tasks WHERE id NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, s.level + 1 FROM steps s JOIN edges e ON s.id = e.src), tlevel AS (SELECT id, max(level) AS level FROM steps GROUP BY id)"
SQL_LOG = """firsts AS (SELECT year(o_orderdate) AS session, CAST(o_custkey AS VARCHAR) AS key, o_orderdate AS moment, o_orderkey AS ord, o_orderstatus AS state, o_orderpriority AS command, o_orderpriority = '1-URGENT' AS bad
  FROM orders QUALIFY row_number() OVER (PARTITION BY year(o_orderdate), o_custkey ORDER BY o_orderdate, o_orderkey) = 1),
won AS (SELECT key, min(session) AS won FROM firsts WHERE state = 'F' AND NOT bad GROUP BY key),
runs AS (SELECT f.*, coalesce(w.won < f.session, false) AS again FROM firsts f LEFT JOIN won w USING (key)),
phases AS (SELECT * FROM (VALUES (1, 'Ready'), (2, 'Started'), (3, 'Finished'), (4, 'Backref')) p(phase, tag)),
log AS (
  SELECT (CAST(date_diff('day', DATE '1970-01-01', CAST(moment AS DATE)) AS BIGINT) << 40) + ord * 8 + phase AS seq, tag, key, session, moment, command, bad
  FROM runs JOIN phases ON CASE WHEN again THEN phase = 4 ELSE phase = 1 OR phase = 2 AND state IN ('P', 'F') OR phase = 3 AND state = 'F' END
  UNION ALL
  SELECT CAST(date_diff('day', DATE '1970-01-01', make_date(session, 1, 1)) AS BIGINT) << 40, 'Header', NULL, session, CAST(make_date(session, 1, 1) AS TIMESTAMP), NULL, NULL FROM (SELECT DISTINCT session FROM firsts))"""
