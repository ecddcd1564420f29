"""Streaming forms of the metrics: state per key, fed by micro-batches. Needs the RocksDB state store for timers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.metrics import RATE_SECONDS, SILENCE_SECONDS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DecayedRate(StatefulProcessor):
    """Keeps (rate, last, first) per key and gives the rate as of each micro-batch's latest event."""

    def __init__(self, seconds: float):
        self.k = 1 / seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rate", "rate double, last_us long, first_us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        times = sorted(t for pdf in rows for t in pdf["us"].tolist())
        rate, last, first = old if old else (0.0, times[0], times[0])
        for t in times:  # decays to the event, then counts it; an event that comes late decays what it missed
            step = (t - last) / 1e6
            rate = rate * math.exp(-self.k * step) + self.k if step >= 0 else rate + self.k * math.exp(self.k * step)
            last = max(last, t)
        self.state.update((rate, last, first))
        scale = 1 - math.exp(-self.k * (last - first) / 1e6)
        yield pd.DataFrame({"key": [key[0]], "as_of_us": [last], "rate": [rate / scale if scale > 0 else 0.0]})

    def close(self) -> None:
        pass


def decayed_rate(events: DataFrame, key: str, ts: str, seconds: float = RATE_SECONDS) -> DataFrame:
    """(key, as_of_us, rate) after every micro-batch that has events of the key."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(DecayedRate(seconds), "key string, as_of_us long, rate double", "Update", "None")


class Silence(StatefulProcessor):
    """A worker that sends no ping for `millis` of event time is given up; a later ping begins anew. Pings of one batch
    are compared with each other too, since timers only fire once the batch's pings have been handled."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None:
            self.handle.deleteTimer(self._due(last))
        lost = []
        for t in sorted(t for pdf in rows for t in pdf["us"].tolist()):
            if last is not None and t - last > self.millis * 1000:
                lost.append(last)
            last = t if last is None else max(last, t)
        self.last.update((last,))
        self.handle.registerTimer(self._due(last))
        yield pd.DataFrame({"worker": [key[0]] * len(lost), "last_seen_us": lost})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        self.last.clear()
        yield pd.DataFrame({"worker": [key[0]] * (last is not None), "last_seen_us": [last] * (last is not None)})

    def _due(self, us: int) -> int:
        return us // 1000 + self.millis + 1

    def close(self) -> None:
        pass


def silences(pings: DataFrame, worker: str, ts: str, seconds: float = SILENCE_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """(worker, last_seen_us) of every silence longer than the timeout, as soon as event time shows it."""
    rows = pings.select(F.col(worker).cast("string").alias("worker"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    rows = rows.withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("worker").transformWithStateInPandas(Silence(int(seconds * 1000)), "worker string, last_seen_us long", "Append", "EventTime")


class Limiter(StatefulProcessor):
    """One limiter per key with the state of the last admission. A rate that arrives with a request holds from then on;
    a change keeps what has been used of the burst."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tat", "tat long, per_second long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["at_ns", "request"])
        tat, rate = self.state.get() if self.state.exists() else (None, None)
        admitted = []
        second = 1_000_000_000
        for at, per_second in zip(asked["at_ns"].tolist(), asked["per_second"].tolist()):
            if not per_second:
                admitted.append(at)
                tat, rate = None, 0
                continue
            tau = second // per_second
            if tat is None or rate == 0:
                tat = max(per_second * tau, at) if rate is None else at  # empty at the very beginning
            tat, rate = max(tat, at) + tau, per_second
            admitted.append(max(at, tat - second))
        self.state.update((tat if tat is not None else 0, rate))
        yield pd.DataFrame({"request": asked["request"].tolist(), "admit_ns": admitted})

    def close(self) -> None:
        pass


def admissions(requests: DataFrame, key: str, request: str, at_ns: str, per_second: str) -> DataFrame:
    """(request, admit_ns): like metrics.admissions, with a rate that may change from request to request."""
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(request).cast("long").alias("request"), F.col(at_ns).cast("long").alias("at_ns"), F.col(per_second).cast("long").alias("per_second"))
    return rows.groupBy("key").transformWithStateInPandas(Limiter(), "request long, admit_ns long", "Append", "None")


def alert_lines(spark, folder: str) -> DataFrame:
    """(value) of lines in growing text files that speak of trouble."""
    from ..functions import is_alert

    return spark.readStream.text(folder).filter(is_alert(F.col("value")))


def log_records(spark, folder: str) -> DataFrame:
    """A run log as a stream: records of every new file, unknown ones dropped. seq is a line's file and place in it."""
    from ..sources.runlog import parse_lines

    files = spark.readStream.option("wholetext", True).text(folder).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))
    return parse_lines(files.filter("value <> ''").select(F.struct("file", "at").alias("seq"), "value"))
