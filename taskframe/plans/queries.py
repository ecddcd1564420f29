"""name -> (query, DuckDB SQL). Every query reads whole tables; SQL is None where it cannot express the query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixtures as fx
from .. import functions as fn
from ..functions import values
from ..operators import graph, metrics, remote, schedule, tasks
from ..sources import runlog

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}

RECURSIVE = f"WITH RECURSIVE {fx.SQL_TASKS}"
LOG = f"WITH {fx.SQL_LOG}"
OUTCOME = f"""{fx.SQL_CLOSURE}, blocked AS (SELECT DISTINCT dst AS id FROM closure WHERE src % 97 = 13),
outcome AS (SELECT id, affinity, CASE WHEN id IN (SELECT id FROM blocked) THEN 'blocked' WHEN id % 97 = 13 THEN 'failed' ELSE 'success' END AS outcome FROM tasks)"""


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return keep


# --- submitting and looking up ---------------------------------------------------------------------------------------


@query("SELECT o_custkey AS key, o_orderkey AS id, o_orderpriority AS command, n AS n_submitted FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def task_dedupe(spark, d):
    rows = fx.read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("command"))
    return tasks.first_by_key(rows, "key", "id")


RAW = "CASE WHEN p_partkey % 50 = 7 THEN p_partkey WHEN p_partkey % 50 = 9 THEN p_partkey + 100000000 WHEN p_partkey % 50 = 11 AND p_partkey + 1 IN (SELECT p_partkey FROM part) THEN p_partkey + 1"


@query(f"SELECT dst, src, CASE WHEN src = dst THEN 'self' WHEN src NOT IN (SELECT p_partkey FROM part) THEN 'missing' ELSE 'later' END AS reason FROM (SELECT p_partkey AS dst, {RAW} ELSE p_partkey // 2 END AS src FROM part WHERE p_partkey >= 1) WHERE src >= dst OR src NOT IN (SELECT p_partkey FROM part)")
def dep_validate(spark, d):
    ids = fx.tasks(spark, d)
    last = ids.agg(F.max("id").alias("last"))
    deps = ids.filter("id >= 1").crossJoin(F.broadcast(last))  # one row
    src = F.expr("CASE WHEN id % 50 = 7 THEN id WHEN id % 50 = 9 THEN id + 100000000 WHEN id % 50 = 11 AND id < last THEN id + 1 ELSE id div 2 END")
    return tasks.bad_dependencies(ids, deps.select(F.col("id").alias("dst"), src.alias("src")))


@query("SELECT count(*) AS ntasks FROM part")
def ntasks(spark, d):
    return fx.tasks(spark, d).agg(F.count("*").alias("ntasks"))


@query("SELECT 'run ' || p_name || ' ' || p_type AS display, 'part-' || p_partkey AS key FROM part WHERE p_partkey = 42")
def get_task(spark, d):
    part = fx.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("part-"), "p_partkey").alias("key"), F.array(F.lit("run"), "p_name", "p_type").alias("cmdline"), F.lit(None).cast("string").alias("display"))
    return tasks.task_by_id(part, 42).select("display", "key")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT p_name, p_brand, p_type FROM part)")
def command_equality(spark, d):
    part = fx.read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return tasks.same_command(part, ["p_partkey"]).agg(F.count("*").alias("n"))


# --- graphs ----------------------------------------------------------------------------------------------------------


@query(f"{RECURSIVE} SELECT id, count(src) AS unmet FROM tasks LEFT JOIN edges ON id = dst GROUP BY id")
def unmet_deps(spark, d):
    return graph.unmet(fx.edges(spark, d), fx.tasks(spark, d))


@query(f"{RECURSIVE} SELECT id, key FROM tasks WHERE id NOT IN (SELECT dst FROM edges)")
def initial_ready(spark, d):
    return schedule.initial_ready(fx.edges(spark, d), fx.tasks(spark, d)).select("id", "key")


@query(f"{RECURSIVE}, one AS (SELECT dst FROM edges WHERE src = 3), two AS (SELECT DISTINCT e.dst FROM edges e JOIN one ON e.src = one.dst) SELECT dst AS id FROM two WHERE dst NOT IN (SELECT dst FROM one) AND dst <> 3")
def descendants_d2(spark, d):
    return graph.at_distance(fx.edges(spark, d), 3, 2)


@query(f"{RECURSIVE}, {fx.SQL_CLOSURE} SELECT dst AS id, count(*) AS n_ancestors FROM closure GROUP BY dst")
def closure_counts(spark, d):
    return graph.ancestor_counts(fx.edges(spark, d))


@query(f"{RECURSIVE}, {fx.SQL_LEVELS} SELECT id, level FROM tlevel")
def tlevel(spark, d):
    return graph.t_level(fx.edges(spark, d), fx.tasks(spark, d))


@query(f"{RECURSIVE}, steps AS (SELECT id, 0 AS level FROM tasks WHERE id NOT IN (SELECT src FROM edges) UNION SELECT e.src, s.level + 1 FROM steps s JOIN edges e ON s.id = e.dst) SELECT id, max(level) AS level FROM steps GROUP BY id")
def blevel(spark, d):
    return graph.b_level(fx.edges(spark, d), fx.tasks(spark, d))


@query(f"{RECURSIVE}, up AS (SELECT max(id) AS id FROM tasks UNION SELECT e.src FROM edges e JOIN up ON e.dst = up.id) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM up) AND dst IN (SELECT id FROM up)")
def target_subgraph(spark, d):
    edges = fx.edges(spark, d)
    return graph.induced(edges, graph.target_nodes(edges, fx.tasks(spark, d).agg(F.max("id").alias("id"))))


@query(f"{RECURSIVE} SELECT id, count(src) AS unmet FROM (SELECT * FROM tasks WHERE id % 5 <> 0) LEFT JOIN (SELECT * FROM edges WHERE src % 5 <> 0) ON id = dst GROUP BY id")
def prune_completed(spark, d):
    nodes = fx.tasks(spark, d)
    left, edges = graph.prune_completed(fx.edges(spark, d), nodes, nodes.filter("id % 5 = 0"))
    return graph.unmet(edges, left)


@query(f"{RECURSIVE}, {OUTCOME} SELECT id, key FROM tasks WHERE id NOT IN (SELECT id FROM blocked) AND id % 97 <> 13")
def prune_failed(spark, d):
    left, _ = graph.prune_failed(fx.edges(spark, d), fx.tasks(spark, d), fx.failing(spark, d))
    return left.select("id", "key")


@query(f"{RECURSIVE} SELECT src, dst FROM edges WHERE src % 1000 >= dst % 1000")
def order_violations(spark, d):
    order = fx.tasks(spark, d).select("id", (F.col("id") % 1000).alias("position"))
    return graph.order_violations(fx.edges(spark, d), order)


@query("SELECT false AS before, true AS after")
def cycle_check(spark, d):
    edges = fx.edges(spark, d)
    closed = edges.unionByName(spark.createDataFrame([(0, 0), (9, 4)], "src long, dst long").filter("src > dst"))
    return spark.createDataFrame([(graph.has_cycle(edges), graph.has_cycle(closed))], "before boolean, after boolean")


@query("WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS level FROM (SELECT DISTINCT conv_id, turn FROM conversations)) SELECT conv_id, turn, level FROM t")
def conversation_chain(spark, d):
    turns = fx.read(spark, d, "conversations").select("conv_id", "turn").distinct().withColumn("id", F.col("conv_id") * 100_000 + F.col("turn"))
    before = F.lag("id").over(Window.partitionBy("conv_id").orderBy("turn"))
    edges = turns.select(before.alias("src"), F.col("id").alias("dst")).filter("src IS NOT NULL")
    return graph.t_level(edges, turns).join(turns, "id").select("conv_id", "turn", F.col("level").cast("long").alias("level"))


# --- scheduling ------------------------------------------------------------------------------------------------------


@query(f"{RECURSIVE}, {OUTCOME} SELECT id, outcome FROM outcome")
def task_outcomes(spark, d):
    return schedule.outcomes(fx.edges(spark, d), fx.tasks(spark, d), fx.failing(spark, d))


DONE = "id % 3 <> 2 AND id < (SELECT max(p_partkey) FROM part) // 2"


@query(f"{RECURSIVE}, done AS (SELECT id, id % 97 <> 13 AS success FROM tasks WHERE {DONE}) SELECT dst AS id FROM edges LEFT JOIN done ON src = id GROUP BY dst HAVING bool_and(coalesce(success, false))")
def dependency_release(spark, d):
    nodes = fx.tasks(spark, d)
    top = nodes.agg(F.max("id").alias("top"))
    done = nodes.crossJoin(F.broadcast(top)).filter("id % 3 <> 2 AND id < top div 2")  # one row
    return schedule.released(fx.edges(spark, d), done.select("id", (F.col("id") % 97 != 13).alias("success")))


@query(f"""{RECURSIVE}, {fx.SQL_LEVELS}, rows AS (SELECT t.id, level, q.queue FROM tasks t JOIN tlevel USING (id), (SELECT unnest(range(64)) AS queue) q WHERE (t.affinity | 1) >> q.queue & 1 = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY level DESC, id) AS rank FROM rows), top AS (SELECT * FROM ranked WHERE rank <= 20)
SELECT CAST(queue AS INTEGER) AS queue, CAST(rank AS INTEGER) AS rank, id FROM top QUALIFY row_number() OVER (PARTITION BY id ORDER BY queue, rank) = 1""")
def ready_topk(spark, d):
    nodes = fx.tasks(spark, d)
    level = graph.t_level(fx.edges(spark, d), nodes).select("id", F.col("level").alias("priority"))
    # a second bit makes tasks stand in two queues
    return schedule.dispatch(nodes.withColumn("affinity", F.col("affinity").bitwiseOR(F.lit(1))).join(level.hint("merge"), "id"), 20)


@query(f"{RECURSIVE}, {OUTCOME} SELECT affinity, count(*) FILTER (outcome = 'success' AND id % 7 < 3) AS num_ready, count(*) FILTER (outcome = 'success' AND id % 7 = 3) AS num_inflight FROM outcome GROUP BY affinity")
def queue_status(spark, d):
    nodes = fx.tasks(spark, d)
    out = schedule.outcomes(fx.edges(spark, d), nodes, fx.failing(spark, d)).join(nodes, "id")
    state = F.when(F.col("outcome") != "success", "done").when(F.col("id") % 7 < 3, "ready").when(F.col("id") % 7 == 3, "inflight")
    return schedule.queue_status(out.select("affinity", state.alias("state")))


@query(f"""{RECURSIVE}, {OUTCOME}, s AS (SELECT *, CASE WHEN outcome <> 'success' THEN outcome WHEN id % 7 < 3 THEN 'ready' WHEN id % 7 = 3 THEN 'inflight' ELSE 'done' END AS state FROM outcome)
SELECT affinity, count(*) FILTER (state = 'ready') AS num_ready, count(*) FILTER (state = 'inflight') AS num_inflight, count(*) FILTER (state = 'failed') AS num_failed, count(*) FILTER (state = 'blocked') AS num_unready, count(*) AS num_tasks FROM s GROUP BY affinity""")
def status_reply(spark, d):
    """The flagship: what a status poll answers, for every queue."""
    nodes = fx.tasks(spark, d)
    out = schedule.outcomes(fx.edges(spark, d), nodes, fx.failing(spark, d)).join(nodes, "id")
    state = F.when(F.col("outcome") != "success", F.col("outcome")).when(F.col("id") % 7 < 3, "ready").when(F.col("id") % 7 == 3, "inflight").otherwise("done")
    count = lambda s: F.count_if(F.col("state") == s)
    return out.withColumn("state", state).groupBy("affinity").agg(count("ready").alias("num_ready"), count("inflight").alias("num_inflight"), count("failed").alias("num_failed"), count("blocked").alias("num_unready"), F.count("*").alias("num_tasks"))


@query(f"{RECURSIVE} SELECT id, affinity FROM tasks WHERE affinity & 5 = 0")
def unservable_tasks(spark, d):
    return schedule.unservable(fx.tasks(spark, d), 5).select("id", "affinity")


FINISHED = "SELECT session, key, seq, NOT bad AS success FROM log WHERE tag = 'Finished'"


@query(f"{LOG}, f AS ({FINISHED}) SELECT session, key, count(*) OVER w AS done, count(*) FILTER (NOT success) OVER w AS failed FROM f WINDOW w AS (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def progress_running(spark, d):
    done = fx.log(spark, d).filter("tag = 'Finished'").select("session", "key", "seq", (F.col("Finished.status") == 0).alias("success"))
    return schedule.progress(done, "session", ["seq"]).select("session", "key", "done", "failed")


@query(f"{LOG}, f AS ({FINISHED}) SELECT session, string_agg(key, ',' ORDER BY seq) AS keys FROM f GROUP BY session")
def completion_order(spark, d):
    done = fx.log(spark, d).filter("tag = 'Finished'").select("session", "key", "seq")
    return schedule.completion_order(done, "session", "seq", "key").select("session", F.array_join("keys", ",").alias("keys"))


KIND = "CASE event_type WHEN 'error' THEN 'code' WHEN 'click' THEN 'signal' WHEN 'view' THEN 'cancelled' ELSE 'disconnected' END"


@query(f"SELECT event_id, {KIND} AS kind, CAST(CASE {KIND} WHEN 'code' THEN event_id % 256 WHEN 'signal' THEN -(event_id % 32) WHEN 'cancelled' THEN -10 ELSE -1 END AS INTEGER) AS status FROM events")
def status_codes(spark, d):
    rows = fx.read(spark, d, "events").select("event_id", F.expr(KIND).alias("kind"))
    value = F.when(F.col("kind") == "code", F.col("event_id") % 256).otherwise(F.col("event_id") % 32)
    return rows.select("event_id", "kind", schedule.exit_code(F.col("kind"), value).alias("status"))


LABEL = f"CASE WHEN {KIND} = 'cancelled' THEN 'CANCELLED' WHEN {KIND} = 'disconnected' THEN 'DISCONNECTED' WHEN event_id % 9 < 5 THEN 'FIZZLED' ELSE 'FAILED' END"


def _labelled(spark, d):
    rows = fx.read(spark, d, "events").select("event_id", "user_id", F.expr(KIND).alias("kind"), F.col("ts").alias("started"), F.expr("ts + make_dt_interval(0, 0, 0, CAST(event_id % 9 AS DECIMAL(18, 6)))").alias("finished"))
    return rows.withColumn("label", schedule.failure_label(F.col("kind"), F.col("started"), F.col("finished")))


@query(f"SELECT event_id, {LABEL} AS label FROM events")
def failure_labels(spark, d):
    return _labelled(spark, d).select("event_id", "label")


@query(f"SELECT user_id, event_id FROM events WHERE {LABEL} = 'FIZZLED' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 3")
def fizzle_cutoff(spark, d):
    return schedule.fizzle_cutoff(_labelled(spark, d), "user_id", ["started", "event_id"], 3).select("user_id", "event_id")


@query(f"""{LOG}, r AS (SELECT session, key FROM log WHERE tag = 'Ready'), s AS (SELECT session, key FROM log WHERE tag = 'Started'), f AS (SELECT session, key FROM log WHERE tag = 'Finished'),
o AS (SELECT * FROM r WHERE (session, key) NOT IN (SELECT (session, key) FROM f))
SELECT session, key, 'Finished' AS tag, -1 AS status FROM o UNION ALL SELECT session, key, 'Started', NULL FROM o WHERE (session, key) NOT IN (SELECT (session, key) FROM s)""")
def drain_rows(spark, d):
    log = fx.log(spark, d)
    part = lambda t: log.filter(F.col("tag") == t).select("session", "key")
    return schedule.drained(part("Started"), part("Ready"), part("Finished"))


@query("SELECT user_id, bool_or(event_type = 'error') AS hard, min(ts) FILTER (event_type = 'click') AS soft_at FROM events GROUP BY user_id")
def cancellation_state(spark, d):
    asked = fx.read(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", "hard").when(F.col("event_type") == "click", "soft").otherwise("none").alias("kind"), F.col("ts").alias("at"))
    return schedule.cancellation(asked, "user_id")


# --- run log ---------------------------------------------------------------------------------------------------------


@query(f"{LOG} SELECT tag, count(*) AS n, count(DISTINCT key) AS n_keys FROM log GROUP BY tag")
def log_records(spark, d):
    return fx.log(spark, d).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


@query(f"{LOG} SELECT key, tag, CASE WHEN tag = 'Finished' THEN NOT bad END AS success FROM log WHERE tag IN ('Ready', 'Started', 'Finished') QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def log_state(spark, d):
    return runlog.states(fx.log(spark, d))


@query(f"""{LOG}, l AS (SELECT *, lag(tag) OVER (PARTITION BY key ORDER BY seq) AS before FROM log WHERE tag IN ('Ready', 'Started', 'Finished') AND NOT (tag = 'Started' AND (seq >> 3) % 5 = 0))
SELECT key, tag, before, count(*) AS n FROM l WHERE tag = 'Started' AND before IS DISTINCT FROM 'Ready' OR tag = 'Finished' AND before IS DISTINCT FROM 'Started' GROUP BY ALL""")
def log_violations(spark, d):
    broken = fx.log(spark, d).filter("NOT (tag = 'Started' AND shiftright(seq, 3) % 5 = 0)")
    return runlog.violations(broken).groupBy("key", "tag", "before").agg(F.count("*").alias("n"))


@query(f"{LOG} SELECT key, count(*) FILTER (tag = 'Started') - count(*) FILTER (tag = 'Finished' AND NOT bad) AS runcount FROM log WHERE key IS NOT NULL GROUP BY key")
def next_runcount(spark, d):
    return runlog.next_runcount(fx.log(spark, d))


SPLIT = f"""{LOG}, last AS (SELECT max(seq) AS last FROM log WHERE tag = 'Header'), refs AS (SELECT DISTINCT key FROM log, last WHERE tag = 'Backref' AND seq > last),
ready AS (SELECT key, max(seq) AS ready FROM log, last WHERE tag = 'Ready' AND seq < last GROUP BY key),
current AS (SELECT log.* FROM log, last WHERE seq >= last AND tag <> 'Backref' UNION ALL SELECT log.* FROM log JOIN refs USING (key) JOIN ready USING (key), last WHERE seq < last AND seq >= ready AND tag <> 'Backref'),
outdated AS (SELECT log.* FROM log, last WHERE seq < last AND seq NOT IN (SELECT seq FROM current) AND (key IS NULL OR key NOT IN (SELECT key FROM current WHERE key IS NOT NULL)))"""


@query(f"{SPLIT} SELECT seq, tag, key FROM current")
def log_current(spark, d):
    return runlog.split(fx.log(spark, d)).filter("part = 'current'").select("seq", "tag", "key")


@query(f"{SPLIT} SELECT seq, tag, key FROM outdated")
def log_outdated(spark, d):
    return runlog.split(fx.log(spark, d)).filter("part = 'outdated'").select("seq", "tag", "key")


@query(f"{LOG} SELECT count(*) AS n, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS made FROM log")
def log_roundtrip_diff(spark, d):
    """Records turned into JSON lines and parsed again: none is lost, none is new."""
    n, lost, made = runlog.roundtrip(fx.log(spark, d))
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(lost).cast("long").alias("lost"), F.lit(made).cast("long").alias("made"))


@query(f"{LOG}, ok AS (SELECT key, bool_or(tag = 'Finished' AND NOT bad) AS ok FROM log WHERE key IS NOT NULL GROUP BY key), s AS (SELECT key FROM log WHERE tag IN ('Ready', 'Started', 'Finished') QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1 AND tag = 'Finished' AND NOT bad) SELECT key FROM s")
def log_backrefs(spark, d):
    log = fx.log(spark, d)
    return runlog.backrefs(log, log.filter("key IS NOT NULL").select("key").distinct())


@query(f"{LOG}, last AS (SELECT session FROM log WHERE tag = 'Header' ORDER BY seq DESC LIMIT 1) SELECT CAST(0 AS INTEGER) AS id, '/logs' AS path UNION ALL SELECT 1, '/logs/out/' || session FROM last")
def storage_roots(spark, d):
    return runlog.storage_roots(fx.log(spark, d), "/logs")


@query(f"{LOG} SELECT 'orders' AS workflow_key, CAST(4 AS BIGINT) AS version, count(*) AS n FROM log WHERE tag = 'Header'")
def header_fields(spark, d):
    heads = fx.log(spark, d).filter("tag = 'Header'")
    return heads.groupBy("Header.workflow_key", "Header.version").agg(F.count("*").alias("n"))


# --- metrics ---------------------------------------------------------------------------------------------------------


MS = "CAST(l_quantity * 100 + l_linenumber AS BIGINT)"


@query(f"WITH t AS (SELECT l_suppkey, {MS} AS ms, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem) SELECT l_suppkey, CAST(sum(ms) // count(ms) AS BIGINT) AS mean_ms FROM t WHERE n <= 100 GROUP BY l_suppkey")
def recent_mean(spark, d):
    rows = fx.read(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", F.expr(MS).alias("ms"))
    return metrics.recent_mean(rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], "ms")


@query("SELECT event_type, quantile_disc(CAST(round(value * 1000) AS BIGINT), 0.5) AS p50, quantile_disc(CAST(round(value * 1000) AS BIGINT), 0.99) AS p99 FROM events GROUP BY event_type")
def latency_quantiles(spark, d):
    rows = fx.read(spark, d, "events").select("event_type", F.round(F.col("value") * 1000).cast("long").alias("us"))
    exact = metrics.quantiles(rows, ["event_type"], "us", exact=True)
    return exact.select("event_type", F.col("p50").cast("long").alias("p50"), F.col("p99").cast("long").alias("p99"))


@query(None)
def latency_quantiles_sketch(spark, d):
    rows = fx.read(spark, d, "events").select("event_type", F.round(F.col("value") * 1000).cast("long").alias("us"))
    return metrics.quantiles(rows, ["event_type"], "us")


NOW, BEGAN, TAU = 1706659200_000000, 1704067200_000000, 21600.0


@query(f"SELECT event_type, round(sum(CASE WHEN epoch_us(ts) <= {NOW} THEN exp(-(({NOW} - epoch_us(ts)) / 1e6) / {TAU}) / {TAU} ELSE 0 END) / (1 - exp(-({NOW} - {BEGAN}) / 1e6 / {TAU})), 9) AS rate FROM events GROUP BY event_type")
def decayed_rate(spark, d):
    return metrics.decayed_rate(fx.read(spark, d, "events"), ["event_type"], "ts", NOW, BEGAN, TAU).select("event_type", F.round("rate", 9).alias("rate"))


@query("SELECT user_id, ts AS last_seen, next_seen FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next_seen FROM events) WHERE date_diff('microsecond', ts, next_seen) > 86400000000")
def heartbeat_gaps(spark, d):
    return metrics.silences(fx.read(spark, d, "events"), "user_id", "ts", 86_400)


@query("WITH t AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('microsecond', lag(ts) OVER w, ts) >= 86400000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM t) SELECT user_id, epoch_us(min(ts)) AS first_us, count(*) AS n FROM s GROUP BY user_id, s")
def ping_sessions(spark, d):
    return metrics.sessions(fx.read(spark, d, "events"), "user_id", "ts", 86_400).select("user_id", F.unix_micros("first_seen").alias("first_us"), "n")


@query("""WITH r AS (SELECT user_id, event_id, epoch_us(ts) * 10 - 17040672000000000 AS t FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM r),
h AS (SELECT *, max(t - (i - 1) * 333333333) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS high FROM n)
SELECT event_id, greatest(t, i * 333333333 + greatest(999999999, high) - 1000000000) AS admit_ns FROM h""")
def gcra_admit(spark, d):
    """Three a second; event times are compressed so that requests pile up."""
    asked = fx.read(spark, d, "events").select("user_id", "event_id", (metrics.micros("ts") * 10 - 17040672000000000).alias("t"))
    return metrics.admissions(asked, ["user_id"], "t", ["event_id"], 3).select("event_id", "admit_ns")


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS avg_l_quantity, round(avg(l_tax), 6) AS avg_l_tax FROM lineitem GROUP BY l_returnflag")
def worker_timing(spark, d):
    got = metrics.worker_averages(fx.read(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_tax"])
    return got.select("l_returnflag", F.round("avg_l_quantity", 6).alias("avg_l_quantity"), F.round("avg_l_tax", 6).alias("avg_l_tax"))


@query("SELECT user_id, max(event_id) AS etag FROM events GROUP BY user_id HAVING max(event_id) > 9000")
def etag_poll(spark, d):
    status = fx.read(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("etag"))
    return metrics.newer_than(status, 9000)


@query("""WITH v AS (SELECT user_id, event_id AS etag, epoch_us(ts) AS moment FROM events),
p AS (SELECT user_id, event_id AS poll, event_id - 40 AS etag, epoch_us(ts) - 86400000000 AS moment, (event_id % 3) * 3600000000 AS least, (event_id % 11) * 21600000000 AS most FROM events WHERE event_id % 5 = 0),
f AS (SELECT *, (SELECT min(v.moment) FROM v WHERE v.user_id = p.user_id AND v.etag > p.etag) AS above FROM p),
r AS (SELECT *, greatest(moment + least, CASE WHEN above IS NULL THEN moment + most ELSE least(greatest(above, moment), moment + most) END) AS reply_at FROM f)
SELECT user_id, poll, reply_at, coalesce((SELECT max(v.etag) FROM v WHERE v.user_id = r.user_id AND v.moment <= r.reply_at), 0) AS version FROM r""")
def etag_long_poll(spark, d):
    """Each fifth event polls a day before it happens, with an older version, holding times and deadlines of some hours."""
    us = fx.read(spark, d, "events").select("user_id", "event_id", metrics.micros("ts").alias("us"))
    polls = us.filter("event_id % 5 = 0").select("user_id", F.col("event_id").alias("poll"), (F.col("event_id") - 40).alias("etag"), (F.col("us") - 86_400_000_000).alias("at"), (F.col("event_id") % 3 * 3_600_000_000).alias("least"), (F.col("event_id") % 11 * 21_600_000_000).alias("most"))
    return metrics.long_polls(polls, us.select("user_id", F.col("event_id").alias("etag"), F.col("us").alias("at")), "user_id")


@query(f"WITH {fx.SQL_TASKS} SELECT key FROM tasks")
def task_keys(spark, d):
    return tasks.task_keys(fx.tasks(spark, d))


@query(f"{LOG} SELECT session, (SELECT count(DISTINCT key) FROM firsts) - count(DISTINCT key) AS unready FROM log WHERE tag = 'Ready' GROUP BY session")
def unready_counter(spark, d):
    log = fx.log(spark, d)
    total = fx.runs(spark, d).agg(F.countDistinct("key").alias("total"))
    return log.filter("tag = 'Ready'").groupBy("session").agg(F.countDistinct("key").alias("ready")).crossJoin(F.broadcast(total)).select("session", (F.col("total") - F.col("ready")).alias("unready"))  # one row


# --- remote workers and the administrator ------------------------------------------------------------------------------


#: Fixture: a transaction per customer, claimed at its number; a request per order.
SQL_REMOTE = """t AS (SELECT c_custkey AS transaction, 'task-' || c_custkey AS key, 'job-' || c_nationkey AS job, c_custkey AS since FROM customer),
q AS (SELECT o_orderkey AS seq, CASE o_orderkey % 5 WHEN 0 THEN 'end' WHEN 1 THEN 'begun' ELSE 'ping' END AS endpoint, o_custkey + CASE WHEN o_orderkey % 29 = 0 THEN 100000000 ELSE 0 END AS transaction,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'job-x' ELSE 'job-' || c_nationkey END AS job, o_orderkey % 31 <> 0 AS authorized FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _transactions(spark, d):
    return fx.read(spark, d, "customer").select(F.col("c_custkey").alias("transaction"), F.concat(F.lit("task-"), "c_custkey").alias("key"), F.concat(F.lit("job-"), "c_nationkey").alias("job"), F.col("c_custkey").alias("since"))


def _requests(spark, d):
    rows = fx.read(spark, d, "orders").join(fx.read(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("seq"),
        F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'end' WHEN 1 THEN 'begun' ELSE 'ping' END").alias("endpoint"),
        F.expr("o_custkey + IF(o_orderkey % 29 = 0, 100000000, 0)").alias("transaction"),
        F.expr("CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'job-x' ELSE concat('job-', c_nationkey) END").alias("job"),
        F.expr("o_orderkey % 31 <> 0").alias("authorized"),
    )


@query(f"""WITH {SQL_REMOTE}, e AS (SELECT q.transaction, min(seq) AS until FROM q JOIN t USING (transaction) WHERE endpoint = 'end' AND authorized AND q.job IS NOT NULL AND seq > since GROUP BY q.transaction),
r AS (SELECT q.*, t.key, t.job AS own, coalesce(seq > since, false) AND coalesce(seq <= until, true) AS alive FROM q LEFT JOIN t USING (transaction) LEFT JOIN e USING (transaction)),
c AS (SELECT *, CASE WHEN NOT authorized THEN 401 WHEN endpoint = 'ping' THEN 200 WHEN endpoint = 'end' AND job IS NULL THEN 400 WHEN NOT alive THEN 404 WHEN job IS NULL THEN 400 WHEN endpoint = 'end' AND job <> own THEN 404 ELSE 200 END AS code FROM r)
SELECT seq, endpoint, key, code, CASE WHEN code = 200 AND endpoint = 'begun' THEN 'Started' WHEN code = 200 AND endpoint = 'end' THEN 'Finished' END AS event FROM c""")
def transaction_replies(spark, d):
    return remote.transaction_replies(_requests(spark, d), _transactions(spark, d)).select("seq", "endpoint", "key", "code", "event")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 401 WHEN o_orderkey % 23 = 0 THEN 400 WHEN o_custkey % 17 = 0 OR o_orderkey % 41 = 0 THEN 410 WHEN o_orderkey % 13 = 0 THEN 404
WHEN o_orderstatus = 'P' OR CAST(floor(o_totalprice) AS BIGINT) % 40000 >= 30000 THEN 429 ELSE 200 END AS code FROM orders""")
def claim_replies(spark, d):
    job = F.expr("IF(o_orderkey % 23 = 0, NULL, o_custkey)")
    wait = F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice") % 40000)
    code = remote.claim_code(F.expr("o_orderkey % 31 <> 0"), job, F.expr("o_custkey % 17 = 0"), F.expr("o_orderkey % 41 = 0"), F.expr("o_orderkey % 13 <> 0"), wait)
    return fx.read(spark, d, "orders").select("o_orderkey", code.alias("code"))


@query("SELECT job, bool_or(asked) AS replied FROM (SELECT s_suppkey AS job, true AS asked FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) UNION ALL SELECT s_suppkey, false FROM supplier WHERE s_suppkey % 7 = 0) GROUP BY job")
def cancelled_jobs(spark, d):
    """All suppliers' jobs are to be cancelled; those of nation 3 run, every seventh was cancelled before."""
    jobs = fx.read(spark, d, "supplier").withColumn("job", F.col("s_suppkey"))
    reply, all_ = remote.mark_cancelled(jobs, jobs.filter("s_nationkey = 3"), jobs.filter("job % 7 = 0"))
    return all_.join(reply.withColumn("asked", F.lit(True)), "job", "left").select("job", F.coalesce("asked", F.lit(False)).alias("replied"))


ADMIN_KIND = "CASE event_id % 11 WHEN 0 THEN 'ratelimit' WHEN 1 THEN 'provisioner_info' WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'soft' ELSE 'hard' END ELSE 'none' END"


@query(f"""WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS moment, {ADMIN_KIND} AS kind FROM events)
SELECT user_id, arg_max(event_id % 1000, event_id) FILTER (kind = 'ratelimit') AS per_second, 'info ' || arg_max(event_id, event_id) FILTER (kind = 'provisioner_info') AS provisioner_info,
coalesce(bool_or(kind = 'hard') FILTER (kind IN ('soft', 'hard')), false) AS hard, min(moment) FILTER (kind = 'soft') AS soft_us FROM c GROUP BY user_id""")
def admin_settings(spark, d):
    value = F.expr("IF(event_id % 11 = 0, string(event_id % 1000), concat('info ', event_id))")
    commands = fx.read(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), metrics.micros("ts").alias("at"), F.expr(ADMIN_KIND).alias("kind"), value.alias("value"))
    return remote.settings(commands, "user_id").withColumnRenamed("soft_at", "soft_us")


US = "CAST(round(value * 1000) AS BIGINT)"


@query(f"""WITH q AS (SELECT CASE event_id % 4 WHEN 0 THEN 'ping' WHEN 1 THEN 'start' WHEN 2 THEN 'begun' ELSE 'status' END AS endpoint, {US} AS us FROM events)
SELECT a.endpoint, coalesce(quantile_disc(us, 0.5), 0) AS p50, coalesce(quantile_disc(us, 0.99), 0) AS p99 FROM (VALUES ('start'), ('begun'), ('end'), ('ping')) a(endpoint) LEFT JOIN q USING (endpoint) GROUP BY a.endpoint""")
def request_latency(spark, d):
    return remote.latencies(_timed(spark, d), exact=True)


def _timed(spark, d):
    endpoint = F.expr("CASE event_id % 4 WHEN 0 THEN 'ping' WHEN 1 THEN 'start' WHEN 2 THEN 'begun' ELSE 'status' END")
    return fx.read(spark, d, "events").select(endpoint.alias("endpoint"), F.round(F.col("value") * 1000).cast("long").alias("us"))


@query(f"""{RECURSIVE}, {OUTCOME}, s AS (SELECT *, CASE WHEN outcome <> 'success' THEN outcome WHEN id % 7 < 3 THEN 'ready' WHEN id % 7 = 3 THEN 'inflight' ELSE 'done' END AS state FROM outcome),
queues AS (SELECT affinity, count(*) FILTER (state = 'ready') AS num_ready, count(*) FILTER (state = 'inflight') AS num_inflight FROM s GROUP BY affinity),
totals AS (SELECT count(*) AS num_total_tasks, count(*) FILTER (state = 'blocked') AS num_unready_tasks FROM s),
latest AS (SELECT max(event_id) AS etag, round(sum(CASE WHEN epoch_us(ts) <= {NOW} THEN exp(-(({NOW} - epoch_us(ts)) / 1e6) / {TAU}) / {TAU} ELSE 0 END) / (1 - exp(-({NOW} - {BEGAN}) / 1e6 / {TAU})), 9) AS rate,
  arg_max(event_id % 1000, event_id) FILTER (event_id % 11 = 0) AS ratelimit, 'info ' || max(event_id) FILTER (event_id % 11 = 1) AS provisioner_info FROM events),
recent AS (SELECT CAST(sum(ms) // count(ms) AS BIGINT) AS average_recent_ms FROM (SELECT {MS} AS ms FROM lineitem ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC LIMIT 100)),
lat AS (SELECT {", ".join(f"coalesce(quantile_disc({US}, {q}) FILTER (event_id % 4 = {k}), 0) AS {e}_{n}" for e, k in (("start", 1), ("begun", 2), ("end", 9), ("ping", 0)) for q, n in ((0.5, "p50"), (0.99, "p99")))} FROM events)
SELECT * FROM queues, totals, latest, recent, lat""")
def status_reply_full(spark, d):
    """All that a status poll answers: a row for each queue, with what holds for the whole server beside it."""
    nodes = fx.tasks(spark, d)
    out = schedule.outcomes(fx.edges(spark, d), nodes, fx.failing(spark, d)).join(nodes, "id")
    state = F.when(F.col("outcome") != "success", F.col("outcome")).when(F.col("id") % 7 < 3, "ready").when(F.col("id") % 7 == 3, "inflight").otherwise("done")
    # counted by queue once; the totals are sums of a few rows
    by = out.groupBy("affinity").agg(*[F.count_if(state == s).alias(f"num_{s}") for s in ("ready", "inflight", "blocked")], F.count("*").alias("n"))
    all_ = Window.partitionBy()
    queues = by.select("affinity", "num_ready", "num_inflight", F.sum("n").over(all_).alias("num_total_tasks"), F.sum("num_blocked").over(all_).alias("num_unready_tasks"))
    events = fx.read(spark, d, "events").withColumn("server", F.lit(0))
    rate = metrics.decayed_rate(events, ["server"], "ts", NOW, BEGAN, TAU).select(F.round("rate", 9).alias("rate"))
    kind, value = F.expr("CASE event_id % 11 WHEN 0 THEN 'ratelimit' WHEN 1 THEN 'provisioner_info' END"), F.expr("IF(event_id % 11 = 0, string(event_id % 1000), concat('info ', event_id))")
    config = remote.settings(events.select("server", F.col("event_id").alias("seq"), metrics.micros("ts").alias("at"), kind.alias("kind"), value.alias("value")), "server").select(F.col("per_second").alias("ratelimit"), "provisioner_info")
    etag = events.agg(F.max("event_id").alias("etag"))
    recent = metrics.recent_mean(fx.read(spark, d, "lineitem").select(F.lit(0).alias("server"), "l_shipdate", "l_orderkey", "l_linenumber", F.expr(MS).alias("ms")), ["server"], ["l_shipdate", "l_orderkey", "l_linenumber"], "ms").select(F.col("mean_ms").alias("average_recent_ms"))
    lat = remote.latencies(_timed(spark, d), exact=True)
    lat = lat.agg(*[F.max(F.when(F.col("endpoint") == e, F.col(p))).alias(f"{e}_{p}") for e in remote.TIMED for p in ("p50", "p99")])
    for one in (etag, rate, config, recent, lat):  # one row each
        queues = queues.crossJoin(F.broadcast(one))
    return queues


# --- values and scalars ----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, '{\"order\":\"' || o_orderkey || '\",\"prio\":\"' || o_orderpriority || '\"}' AS pairs FROM orders")
def value_maps(spark, d):
    text = fx.read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("order="), "o_orderkey", F.lit(' prio="'), "o_orderpriority", F.lit('" flag')).alias("text"))
    return text.select("o_orderkey", F.to_json(values.parse_simple(F.col("text"))[0]).alias("pairs"))


@query("SELECT o_orderkey, '[{\"a\":\"' || o_orderpriority || ' x\",\"b\":\"2\"},{}]' AS pairs FROM orders")
def value_maps_quoted(spark, d):
    text = F.concat(F.lit("a=1 'a="), "o_orderpriority", F.lit(" x' b=2 c\n\"open\nplain words\n"))
    return fx.read(spark, d, "orders").select("o_orderkey", F.to_json(values.parse_values(text)).alias("pairs"))


@query("SELECT p_partkey, string_agg(q, ',' ORDER BY q) AS queues FROM part, (SELECT unnest(range(64)) AS q) WHERE (CAST(p_size AS BIGINT) >> q) & 1 = 1 GROUP BY p_partkey")
def affinity_bits(spark, d):
    bits = schedule.queues(F.col("p_size").cast("long"))
    return fx.read(spark, d, "part").select("p_partkey", F.array_join(F.transform(bits, lambda b: b.cast("string")), ",").alias("queues")).filter("queues <> ''")


@query(r"SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_brand ELSE 'run ' || p_name || ' \t' || p_type END AS display FROM part")
def display_text(spark, d):
    args = F.array(F.lit("run"), "p_name", F.concat(F.lit("\t"), "p_type"))
    rows = fx.read(spark, d, "part").select("p_partkey", args.alias("cmdline"), F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).alias("display"))
    return rows.select("p_partkey", tasks.display().alias("display"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '/abs/' || s_name WHEN s_suppkey % 3 = 1 THEN '/logs/wf/' || s_name ELSE '/logs' END AS path FROM supplier")
def path_resolve(spark, d):
    root = F.expr("CASE WHEN s_suppkey % 3 = 0 THEN concat('/abs/', s_name) WHEN s_suppkey % 3 = 1 THEN concat('$KEY/', s_name) ELSE '' END")
    return fx.read(spark, d, "supplier").select("s_suppkey", fn.resolve(fn.with_workflow_key(root, F.lit("wf")), F.lit("/logs")).alias("path"))


@query("SELECT c_custkey, 'out-' || c_name || '-' || c_custkey || '.log' AS file FROM customer")
def fill_template(spark, d):
    return fx.read(spark, d, "customer").select("c_custkey", fn.fill_template(F.lit("out-%u-%j.log"), {"user": F.col("c_name"), "job": F.col("c_custkey").cast("string")}).alias("file"))


@query("SELECT event_id FROM events WHERE regexp_matches(upper(event_type) || ' ' || props, 'CANCELLED|FAILED|ERROR')")
def alert_lines(spark, d):
    return fx.read(spark, d, "events").filter(fn.is_alert(F.concat_ws(" ", F.upper("event_type"), "props"))).select("event_id")


@query("SELECT o_orderkey, lower(to_hex(o_orderkey)) AS hex, to_base64(CAST(o_orderpriority AS BLOB)) AS token FROM orders")
def small_encodings(spark, d):
    return fx.read(spark, d, "orders").select("o_orderkey", fn.hex_count(F.col("o_orderkey")).alias("hex"), fn.token(F.col("o_orderpriority").cast("binary")).alias("token"))


@query("SELECT p_partkey, p_brand || '|' || p_name AS joined FROM part")
def map_pairs(spark, d):
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(v).alias("value")) for k, v in (("b", "p_type"), ("a", "p_brand"), ("b", "p_name"))])
    back = fn.pairs(fn.from_pairs(entries))
    return fx.read(spark, d, "part").select("p_partkey", F.array_join(F.transform(back, lambda e: e["value"]), "|").alias("joined"))


@query("SELECT n_nationkey, n_name || chr(65533) AS text FROM nation")
def lossy_decode(spark, d):
    raw = F.concat(F.col("n_name").cast("binary"), F.lit(bytearray(b"\xff")))
    return fx.read(spark, d, "nation").select("n_nationkey", values.lossy_text(raw).alias("text"))
