"""Key=value lines that tasks write, as arrays of maps.

A line is split into words like a POSIX shell does. A word with `=` is a pair, split at the first; other words are
dropped; of equal keys the last counts. A line without pairs is an empty map, a line that cannot be split (an open
quote) is dropped, and text that is not UTF-8 gives an empty array.
"""

from __future__ import annotations

import shlex

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUES = T.ArrayType(T.MapType(T.StringType(), T.StringType()))


def parse(text: bytes | str | None) -> list[dict[str, str]]:
    """One text. No comments: `#` is a character like any other."""
    if text is None:
        return []
    if isinstance(text, (bytes, bytearray)):
        try:
            text = bytes(text).decode("utf-8")
        except UnicodeDecodeError:
            return []
    out = []
    for line in text.removesuffix("\n").split("\n") if text else []:
        try:
            words = shlex.split(line, comments=False, posix=True)
        except ValueError:
            continue
        out.append(dict(w.split("=", 1) for w in words if "=" in w))
    return out


@F.pandas_udf(VALUES)
def parse_values(texts: pd.Series) -> pd.Series:
    return texts.map(parse)


def parse_simple(text: Column) -> Column:
    """The same for one line whose words have no backslash and quotes only around a whole value; all in the JVM."""
    words = F.regexp_extract_all(text, F.lit(r'([^\s="]+=(?:"[^"]*"|[^\s"]*))'), F.lit(1))
    entry = F.transform(words, lambda w: F.struct(F.substring_index(w, "=", 1).alias("key"), F.replace(F.regexp_replace(w, r"^[^=]*=", ""), F.lit('"'), F.lit("")).alias("value")))
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + F.lit(2), F.size(entry)), lambda x: x["key"] == e["key"]))
    return F.array(F.map_from_entries(last))


@F.pandas_udf(T.StringType())
def lossy_text(raw: pd.Series) -> pd.Series:
    """Bytes as text; what is not UTF-8 becomes the replacement character."""
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))
