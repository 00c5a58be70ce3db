"""Observation grids: the times at which labels are taken.

All label operators meet the grid through positions ("slots"), never through a
join of events with grid times: the slots an event touches follow from its time
by arithmetic (even steps) or by a binary search in a literal array.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import from_micros, micros, to_micros


@dataclass(frozen=True)
class Grid:
    """`n` times from `start` every `step`; or the explicit sorted `times`."""

    start: datetime
    step: timedelta
    n: int
    times: tuple[datetime, ...] | None = None

    @classmethod
    def regular(cls, start: datetime, step: timedelta, n: int) -> "Grid":
        if step <= timedelta(0):
            raise ValueError("The grid step must be positive.")
        return cls(start, step, max(0, n))

    @classmethod
    def between(cls, first: datetime, last: datetime, step: timedelta) -> "Grid":
        return cls.regular(first, step, (last - first) // step + 1 if last >= first else 0)

    @classmethod
    def of(cls, times: Sequence[datetime], *, distinct: bool = True) -> "Grid":
        ordered = sorted(set(times)) if distinct else sorted(times)
        if not ordered:
            raise ValueError("A grid needs at least one time.")
        steps = {b - a for a, b in zip(ordered, ordered[1:])}
        if len(steps) == 1 and timedelta(0) not in steps:
            return cls.regular(ordered[0], steps.pop(), len(ordered))
        return cls(ordered[0], timedelta(0), len(ordered), tuple(ordered))

    def joins(self, other: "Grid") -> bool:
        """True if `other` goes on where this even grid ends."""
        even = self.times is None and other.times is None and self.step == other.step
        return even and self.start + self.step * self.n == other.start

    def slot_from(self, at: Column) -> Column:
        """Number of grid times strictly before `at` = first slot at or after it."""
        return self._before(to_micros(at))

    def slot_after(self, at: Column) -> Column:
        """First slot strictly after `at`."""
        return self._before(to_micros(at) + 1)

    def slot_from_shifted(self, at: Column, shift: timedelta) -> Column:
        return self._before(to_micros(at) + micros(shift))

    def _before(self, at: Column) -> Column:
        if self.times is None:
            step = micros(self.step)
            offset = at - F.lit(micros(self.start))
            slot = ((offset + F.pmod(-offset, F.lit(step))) / step).cast("long")
            return F.greatest(F.lit(0), F.least(F.lit(self.n), slot)).cast("int")
        ordered = self._literal()
        power = 1 << (self.n.bit_length() - 1)
        strides = []
        while power:
            strides.append(F.lit(power))
            power >>= 1
        return F.aggregate(
            F.array(*strides),
            F.lit(0),
            lambda pos, stride: F.when(
                (pos + stride <= self.n)
                & (F.get(ordered, F.least(pos + stride, F.lit(self.n)) - 1) < at),
                pos + stride,
            ).otherwise(pos),
        )

    def time_of(self, slot: Column) -> Column:
        if self.times is None:
            return from_micros(F.lit(micros(self.start)) + slot.cast("long") * micros(self.step))
        return from_micros(F.get(self._literal(), slot))

    def _literal(self) -> Column:
        """All times as one constant: the plan does not grow with their number. (Times in a table: see `functions.asof`.)"""
        return F.from_json(F.lit(json.dumps([micros(t) for t in self.times])), "array<bigint>")

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.n).select(
            F.col("id").cast("int").alias("slot"), self.time_of(F.col("id").cast("int")).alias("time")
        )


def span(df: DataFrame, first: Column, last: Column, name: str = "slot") -> DataFrame:
    """One row per slot in [first, last]; rows with an empty range vanish."""
    return (
        df.withColumns({"_first": first, "_last": last})
        .where(F.col("_first") <= F.col("_last"))
        .withColumn(name, F.explode(F.sequence("_first", "_last")))
        .drop("_first", "_last")
    )
