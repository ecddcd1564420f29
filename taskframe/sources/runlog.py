"""The run log: JSON lines, one of five records each, whose order matters.

Spark keeps no order of lines, so a log is read with a sequence value per line: its file's name, the offset of the
split it was read from, and its place within the split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import LOG, LOG_VERSION, TAGS


class BadLog(ValueError):
    pass


def tag(prefix: str = "") -> Column:
    """The name of the record that a parsed line holds; null for none."""
    return F.coalesce(*[F.when(F.col(f"{prefix}{t}").isNotNull(), t) for t in TAGS])


def key(prefix: str = "") -> Column:
    return F.coalesce(*[F.col(f"{prefix}{t}.key") for t in TAGS if t != "Header"])


def _parsed(lines: DataFrame) -> DataFrame:
    """Every line with its records; all are null in lines that hold none."""
    rows = lines.withColumn("e", F.from_json("value", LOG)).select("seq", "value", *[F.col(f"e.{t}").alias(t) for t in TAGS])
    ready = F.when(F.col("Ready").isNotNull(), F.struct("Ready.time", "Ready.key", "Ready.runcount", "Ready.command", F.coalesce("Ready.r", F.lit(0).cast("long")).alias("r")))
    return rows.withColumns({"tag": tag(), "key": key(), "Ready": ready})


def parse_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """lines(seq, value) as records with seq, tag and key. Lenient: lines of unknown kind or without JSON are dropped.
    Strict: any such line raises BadLog. Missing fields take their defaults, unknown fields are ignored."""
    rows = _parsed(lines)
    if strict:
        head = F.col("Header").isNotNull()
        wrong = F.when(head & ~F.col("Header.version").eqNullSafe(LOG_VERSION), F.struct("seq", F.col("Header.version").alias("version")))
        keys = F.when(head, F.coalesce("Header.workflow_key", F.lit("")))
        seen = rows.agg(F.min(F.when(F.col("tag").isNull(), F.col("seq"))).alias("bad"), F.min(wrong).alias("other"), F.min(keys).alias("low"), F.max(keys).alias("high")).collect()[0]
        if seen["bad"] is not None:
            raise BadLog(f"line {seen['bad']} is not a log record")
        if seen["other"] is not None:
            raise BadLog(f"log version {seen['other']['version']}, not {LOG_VERSION}")
        if seen["low"] != seen["high"]:
            raise BadLog("headers have different workflow keys")
        if not violations(rows).isEmpty():
            raise BadLog("a run's records are out of order")
    return rows.filter("tag IS NOT NULL").drop("value")


def numbered(lines: DataFrame) -> DataFrame:
    """(seq, value) of text lines with file metadata: a line's file, its split's offset and its place in the split."""
    return lines.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("seq"), "value")


def read_log(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A log of one or more files, in the order of their names; large files are read in splits."""
    return parse_lines(numbered(spark.read.option("wholetext", False).text(path)), strict)


def to_lines(rows: DataFrame) -> DataFrame:
    """(seq, value): each record as its JSON line."""
    body = F.coalesce(*[F.when(F.col(t).isNotNull(), F.to_json(F.struct(F.col(t).alias(t)), {"ignoreNullFields": "true"})) for t in TAGS])
    return rows.select("seq", body.alias("value"))


def roundtrip(rows: DataFrame) -> tuple[int, int, int]:
    """How many records there are, how many lines of theirs are lost when they are parsed and written again, and how many
    are made. Each record is held against its own line in one pass; only if one differs, all lines are compared as bags."""
    lines = to_lines(rows)
    own = to_lines(_parsed(lines.select(F.struct("seq", "value").alias("seq"), "value")))
    differs = F.coalesce(F.col("seq.value") != F.col("value"), F.lit(True))
    n, differing = own.agg(F.count("*"), F.count_if(differs)).collect()[0]
    if not differing:
        return n, 0, 0
    back = to_lines(parse_lines(lines))
    return n, lines.exceptAll(back).count(), back.exceptAll(lines).count()


def write_log(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes records in the order of seq as JSON lines, side by side: ranges of seq go to files whose names have the same
    order. Each append is a folder of its own, numbered from 1 on, so that names tell the order; one writer at a time."""
    spark = rows.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    if old and mode == "ignore":
        return
    if old and mode in ("error", "errorifexists"):
        raise FileExistsError(path)
    if mode == "overwrite":
        fs.delete(folder, True)
        old = []
    last = max((int(x.removeprefix("append=")) for x in old if x.startswith("append=")), default=0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    to_lines(rows).repartitionByRange(parts, "seq").sortWithinPartitions("seq").select("value").write.text(f"{path}/append={last + 1:09d}")


def violations(rows: DataFrame) -> DataFrame:
    """Records that cannot follow the one before them with the same key: Started needs Ready, Finished needs Started."""
    before = F.lag("tag").over(Window.partitionBy("key").orderBy("seq"))
    runs = rows.filter(F.col("tag").isin("Ready", "Started", "Finished")).withColumn("before", before)
    wrong = (F.col("tag") == "Started") & ~F.col("before").eqNullSafe("Ready") | (F.col("tag") == "Finished") & ~F.col("before").eqNullSafe("Started")
    return runs.filter(wrong).select("seq", "key", "tag", "before")


def states(rows: DataFrame) -> DataFrame:
    """(key, tag, success) of each key's latest record; success is null before it has finished."""
    runs = rows.filter(F.col("tag").isin("Ready", "Started", "Finished"))
    last = runs.groupBy("key").agg(F.max(F.struct("seq", "tag", F.col("Finished.status").alias("status"))).alias("l"))
    return last.select("key", F.col("l.tag").alias("tag"), F.when(F.col("l.tag") == "Finished", F.col("l.status") == 0).alias("success"))


def next_runcount(rows: DataFrame) -> DataFrame:
    """(key, runcount): the number of its runs that started and did not succeed."""
    n = F.count_if(F.col("tag") == "Started") - F.count_if((F.col("tag") == "Finished") & (F.col("Finished.status") == 0))
    return rows.filter(F.col("key").isNotNull()).groupBy("key").agg(n.alias("runcount"))


def split(rows: DataFrame) -> DataFrame:
    """rows with `part`: current, outdated or null for records that are in neither.

    Current are the last Header, what follows it except Backrefs, and of each key that a Backref after it names the
    records from the key's latest Ready before it on. All else is outdated, unless its key is current; Backrefs of the
    last session are in neither. Without a Header all is current.
    """
    last = rows.agg(F.max(F.when(F.col("tag") == "Header", F.col("seq"))).alias("last"))
    marked = rows.crossJoin(F.broadcast(last))  # one row
    after, ref = F.col("last").isNull() | (F.col("seq") >= F.col("last")), F.col("tag") == "Backref"
    own = after & (~ref | F.col("last").isNull())
    # one row for each key, combined in the tasks
    keys = marked.filter("key IS NOT NULL").groupBy("key").agg(
        F.bool_or(own).alias("own"),
        F.bool_or(ref & F.coalesce(F.col("seq") > F.col("last"), F.lit(False))).alias("named"),
        F.max(F.when((F.col("tag") == "Ready") & (F.col("seq") < F.col("last")), F.col("seq"))).alias("ready_seq"),
    )
    tagged = marked.join(keys, "key", "left")
    again = ~after & F.col("named") & ~ref & (F.col("seq") >= F.col("ready_seq"))
    is_current = F.coalesce(F.col("own") | F.col("named") & F.col("ready_seq").isNotNull(), F.lit(False))
    part = F.when(own | F.coalesce(again, F.lit(False)), "current").when(~after & ~is_current, "outdated")
    return tagged.withColumn("part", part).select(*rows.columns, "part")


def storage_roots(rows: DataFrame, log_dir: str) -> DataFrame:
    """(id, path) of the last Header's storage roots, relative ones below the log's folder."""
    from ..functions import resolve

    last = rows.filter("tag = 'Header'").agg(F.max_by(F.col("Header.storage_roots"), "seq").alias("roots"))
    return last.select(F.posexplode("roots").alias("id", "root")).select("id", resolve(F.col("root"), F.lit(log_dir)).alias("path"))


def backrefs(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """(key) of tasks that the log says succeeded: they are not run again and get a Backref."""
    return tasks.join(states(rows).filter("success"), "key", "left_semi").select("key")
