"""Limits of the feed as streams: rows wait until the watermark has passed them, so that they are judged in order of time.

A key's rows may come in any order and in any files, as long as they are no later than the watermark allows; later
ones are dropped by the engine, as the watermark says.  State is what still waits, what the rule carries on, and the
time from which that means nothing; timers of event time replay the first and clear the others.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

MICROS = 1_000_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclasses.dataclass(frozen=True)
class Anchored:
    """A row opens a window if it comes ``seconds`` or more after the last that did; only such rows are told."""

    seconds: int
    fields = ""

    def __call__(self, due: list[tuple[int, int]], carry: list[int]) -> tuple[list[tuple], list[int], int]:
        last, out = (carry or [None])[0], []
        for t, i in due:
            if last is None or t - last >= self.seconds * MICROS:
                last = t
                out.append((i, t))
        return out, [last], last + self.seconds * MICROS


@dataclasses.dataclass(frozen=True)
class Limited:
    """Whether a row is among the first ``per_minute`` of its minute and the first ``per_day`` of its day, counted before any refusal."""

    per_minute: int
    per_day: int
    fields = "allowed boolean"

    def __call__(self, due: list[tuple[int, int]], carry: list[int]) -> tuple[list[tuple], list[int], int]:
        minute, in_minute, day, in_day = carry or [None, 0, None, 0]
        out = []
        for t, i in due:
            m, d = t // (60 * MICROS), t // (86_400 * MICROS)
            in_minute, in_day = in_minute + 1 if m == minute else 1, in_day + 1 if d == day else 1
            minute, day = m, d
            out.append((i, t, in_minute <= self.per_minute and in_day <= self.per_day))
        return out, [minute, in_minute, day, in_day], (day + 1) * 86_400 * MICROS


@dataclasses.dataclass(frozen=True)
class Throttled:
    """How many rows came in the ``seconds`` up to each row, rows of its own time included, and whether that is more than ``most``."""

    seconds: int
    most: int
    fields = "recent bigint, throttled boolean"

    def __call__(self, due: list[tuple[int, int]], carry: list[int]) -> tuple[list[tuple], list[int], int]:
        times, out, low, high = [*carry, *(t for t, _ in due)], [], 0, len(carry)
        for t, i in due:
            while times[low] < t - self.seconds * MICROS:
                low += 1
            while high < len(times) and times[high] <= t:
                high += 1
            out.append((i, t, high - low, high - low > self.most))
        return out, times[low:], times[-1] + (self.seconds + 1) * MICROS


class Replay(StatefulProcessor):
    """Keeps rows until the watermark has passed them, then hands them to a rule in order of time and id."""

    def __init__(self, rule, columns: list[str]):
        self.rule, self.columns = rule, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t bigint, id bigint")
        self.carry = handle.getListState("carry", "value bigint")
        self.until = handle.getValueState("until", "t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            rows_ = list(zip(frame["t_"].tolist(), frame["id_"].tolist(), strict=True))
            if rows_:
                self.waiting.appendList(rows_)
                self._wake(min(rows_)[0])
        return iter(())

    def _wake(self, first: int) -> None:
        """A timer for the minute of the first row that waits: when it fires, the next is set for what still waits."""
        self.handle.registerTimer((first // (60 * MICROS) + 1) * 60_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [(t, i) for t, i in self.waiting.get()] if self.waiting.exists() else []
        due, rest = sorted(r for r in rows if r[0] < now), [r for r in rows if r[0] >= now]
        if due:
            carry = [v for (v,) in self.carry.get()] if self.carry.exists() else []
            out, carry, until = self.rule(due, carry)
            if rest:
                self.waiting.put(rest)
                self._wake(min(rest)[0])
            else:
                self.waiting.clear()
            if until < now:
                self.carry.clear()
                self.until.clear()
            else:
                self.carry.put([(v,) for v in carry])
                self.until.update((until,))
                self.handle.registerTimer(-(-until // 1000) + 1)
            if out:
                told = pd.DataFrame(out, columns=self.columns)
                told.insert(0, "key_", key[0])
                told["t_"] = pd.to_datetime(told["t_"], unit="us")
                yield told
        elif self.until.exists() and self.until.get()[0] < now:
            self.carry.clear()
            self.until.clear()

    def close(self) -> None:
        pass


def replayed(rows: DataFrame, key: list[str], at: str, id_: str, rule) -> DataFrame:
    """(key, id, at, the rule's fields) of a stream with a watermark on ``at``.  Rows without a time or id are left out."""
    names = {f.name: f.dataType.simpleString() for f in rows.schema}
    shown = rows.where(F.col(at).isNotNull() & F.col(id_).isNotNull())
    # one text names the key: groups of keys that may be null do not keep apart on their way to Python
    moved = shown.select(F.to_json(F.struct(*key)).alias("key_"), at, F.unix_micros(at).alias("t_"), F.col(id_).cast("bigint").alias("id_"))
    extra = [f.split()[0] for f in rule.fields.split(", ") if f]
    schema = ", ".join(["key_ string", "id_ bigint", "t_ timestamp", *([rule.fields] if rule.fields else [])])
    out = moved.groupBy("key_").transformWithStateInPandas(Replay(rule, ["id_", "t_", *extra]), schema, "Append", "EventTime", eventTimeColumnName="t_")
    told = F.from_json("key_", ", ".join(f"{k} {names[k]}" for k in key))
    return out.select(*(told[k].alias(k) for k in key), F.col("id_").alias(id_), F.col("t_").alias(at), *extra)


def durable(spark: SparkSession) -> None:
    """Such streams need the state store that keeps several variables and timers of a key on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
