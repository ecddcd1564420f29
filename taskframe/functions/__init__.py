"""Column functions: values that tasks report, templates, paths and small encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholders of file name templates, and words that mark trouble in a worker's log.
PLACEHOLDERS = {"%u": "user", "%j": "job", "%x": "name", "%c": "cluster", "%h": "host"}
ALERT = "CANCELLED|FAILED|ERROR"


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """The template with each placeholder replaced, one after the other, in the order of PLACEHOLDERS."""
    for mark, name in PLACEHOLDERS.items():
        if name in values:
            template = F.replace(template, F.lit(mark), values[name])
    return template


def with_workflow_key(root: Column, key: Column) -> Column:
    return F.replace(root, F.lit("$KEY"), key)


def resolve(path: Column, base: Column) -> Column:
    """A relative path lies below base; an absolute one is itself; the empty one is base."""
    return F.when(path.startswith("/"), path).when(path == "", base).otherwise(F.concat(base, F.lit("/"), path))


def is_alert(line: Column) -> Column:
    return line.rlike(ALERT)


def hex_count(n: Column) -> Column:
    return F.lower(F.hex(n))


def token(raw: Column) -> Column:
    return F.base64(raw)


def pairs(values: Column) -> Column:
    """A map as a list of its entries in key order."""
    return F.array_sort(F.map_entries(values))


def from_pairs(entries: Column) -> Column:
    """The map of a list of (key, value); of equal keys the last counts, whatever the session does about them."""
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)
