"""Submitting tasks: first submission of a key wins, dependencies are checked, and the graph can be looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, with the number of submissions. A minimum of structs is combined before the shuffle,
    so a key that is submitted very often does not gather in one task."""
    rest = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("row"), F.count("*").alias("n_submitted"))
    return best.select(key, *[F.col(f"row.{c}").alias(c) for c in [order, *rest]], "n_submitted")


def same_command(rows: DataFrame, ignored: list[str]) -> DataFrame:
    """Distinct rows as to every column but `ignored`."""
    return rows.dropDuplicates([c for c in rows.columns if c not in ignored])


def bad_dependencies(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(dst, src, reason) of dependencies that must be refused: on itself, on a missing task, or on a later one."""
    known = deps.join(tasks.select(F.col("id").alias("src"), F.lit(True).alias("known")), "src", "left")
    reason = F.when(F.col("src") == F.col("dst"), "self").when(F.col("known").isNull(), "missing").when(F.col("src") > F.col("dst"), "later")
    return known.select("dst", "src", reason.alias("reason")).filter("reason IS NOT NULL")


def task_by_id(tasks: DataFrame, task_id: int) -> DataFrame:
    return tasks.filter(F.col("id") == task_id).select("cmdline", "key", display().alias("display"))


def task_keys(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy("id").select("key")


def display(cmdline: str = "cmdline", shown: str = "display") -> Column:
    """The given display text, or the arguments on one line: line ends after a backslash vanish, tabs become \\t."""
    line = F.concat_ws(" ", F.col(cmdline))
    line = F.replace(line, F.lit("\\\n"), F.lit(" "))
    return F.coalesce(F.col(shown), F.replace(line, F.lit("\t"), F.lit("\\t")))
