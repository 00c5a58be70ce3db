"""Order statistics that never gather a whole group in one task.

A plain window over `partitionBy(key)` sends all rows of a hot key to one task,
and an exact percentile keeps all of a group's values in one buffer. The helpers
here split a group into ordered buckets, work inside (group, bucket), and stitch
the buckets together over one small row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, written

#: Rows of one key that a task may hold and sort.
HEAVY = 1 << 14
# Logarithmic buckets, so the bucket order is the value order. A group then has a
# few hundred thousand buckets at most, and values within one percent of each
# other still fall into some sixty of them.
_PER_DOUBLING = 4096
_CHUNK = 1_000_000

def _bucket(value: Column) -> Column:
    size = F.floor(F.log2(F.abs(value)) * _PER_DOUBLING) + 10_000_000
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("int")


def day_of(time: str) -> Column:
    """The calendar day of a time; rows without a time lie in a day before all others."""
    return F.coalesce(F.date_trunc("day", F.col(time)).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))


def fold(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """Aggregates per key, meant to be joined back to the rows they come from.

    Grouping by a struct of the key hides the aggregation's partitioning from the
    join: both sides then get an exchange of their own, which is what Spark needs
    to split the rows of a hot key over several tasks.
    """
    grouped = df.groupBy(F.struct(F.col(key).alias("key")).alias("_k")).agg(*aggregates)
    return grouped.select(F.col("_k.key").alias(key), *[c for c in grouped.columns if c != "_k"])


def by_weight(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys with at most `most` of them, and all others (None: there are none); rows without a key are others.

    One job counts the rows of keys where they lie: a row for each key travels, one for each heavy key is stored. What is
    light fits a window by key, which needs no second exchange of the rows.
    """
    counted = rows.groupBy(F.col(key).alias("_heavy")).agg(F.count(F.lit(1)).alias("_n"))
    found, seen, _ = written(counted.where((F.col("_n") > most) | F.col("_heavy").isNull()).select("_heavy"), "heavy", n=F.count(F.lit(1)))
    if not seen["n"]:
        return rows, None
    light = rows.where(F.col(key).isNotNull()).join(found, F.col(key) == F.col("_heavy"), "left_anti")
    return light, rows.join(found, F.col(key).eqNullSafe(F.col("_heavy"))).drop("_heavy")


def cumulative(hist: DataFrame, groups: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """Running totals in ascending order of `value` within each group.

    `hist` has one row per (group, value). Adds `<c>_upto` (inclusive) and
    `<c>_all` (group total) for each column of `sums`, and `<value>_least`, the
    smallest value of the group.
    """
    # A struct is a null-safe key: the join below reuses the window's partitioning.
    hist = hist.withColumn("_key", F.struct(*groups, _bucket(F.col(value)).alias("_bucket")))
    inner = Window.partitionBy("_key").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = hist.withColumns({f"_{c}_run": F.sum(c).over(inner) for c in sums})
    # One row per (group, bucket): at most a few hundred thousand buckets exist.
    totals = hist.groupBy("_key").agg(F.min(value).alias("_low"), *[F.sum(c).alias(f"_{c}_sum") for c in sums])
    whole = Window.partitionBy(*[F.col("_key")[g] for g in groups])
    before = whole.orderBy(F.col("_key._bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "_key",
        *[F.coalesce(F.sum(f"_{c}_sum").over(before), F.lit(0)).alias(f"_{c}_before") for c in sums],
        *[F.sum(f"_{c}_sum").over(whole).alias(f"{c}_all") for c in sums],
        F.min("_low").over(whole).alias(f"{value}_least"),
    )
    joined = running.join(totals, "_key")
    return joined.select(
        *[c for c in hist.columns if c != "_key"],
        *[(F.col(f"_{c}_before") + F.col(f"_{c}_run")).alias(f"{c}_upto") for c in sums],
        *[f"{c}_all" for c in sums],
        f"{value}_least",
    )


def spread() -> Column:
    """Sum of squared distances from the mean, as an `extra` aggregate of `quantiles`.

    Distances from the group's smallest value are summed, not the values, so
    values that are large against their spread lose no digits, and partial sums
    of any split of the group merge.
    """
    n, away = F.col("_n"), F.col("_value") - F.col("_value_least")
    total = F.sum(away * n)
    return F.greatest(F.lit(0.0), F.sum(away * away * n) - total * total / F.sum(n))


def quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: Column,
    probs: dict[str, float],
    *,
    weight: Column | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, plus `n`.

    Nulls are dropped. `weight` is a whole number of repetitions. `extra` are
    aggregates over the histogram columns `_value` (the value), `_n` (its count)
    and `_value_least` (the group's smallest value).
    """
    n = F.count(F.lit(1)) if weight is None else F.sum("_weight")
    cols = [*groups, value.cast("double").alias("_value")]
    if weight is not None:
        cols.append(weight.cast("long").alias("_weight"))
    hist = df.select(*cols).where(F.col("_value").isNotNull()).groupBy(*groups, "_value").agg(
        n.alias("_n")
    )
    if weight is not None:
        hist = hist.where(F.col("_n") > 0)
    ranked = cumulative(hist, groups, "_value", ["_n"])
    first, last, top = F.col("_n_upto") - F.col("_n"), F.col("_n_upto"), F.col("_n_all") - 1
    picks = []
    for name, p in probs.items():
        low, high = F.floor(top * p), F.ceil(top * p)
        picks.append(F.max(F.when((first <= low) & (low < last), F.col("_value"))).alias(f"_{name}_lo"))
        picks.append(F.max(F.when((first <= high) & (high < last), F.col("_value"))).alias(f"_{name}_hi"))
    found = ranked.groupBy(*groups).agg(F.sum("_n").alias("n"), *picks, *extra)
    position = {name: (F.col("n") - 1) * p for name, p in probs.items()}
    names = [c for c in found.columns if not c.startswith("_")]
    return found.select(
        *names,
        *[
            (
                F.col(f"_{name}_lo")
                + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (position[name] - F.floor(position[name]))
            ).alias(name)
            for name in probs
        ],
    )


def summary(df: DataFrame, groups: Sequence[str], value: Column, name: str, unit: str = "hours") -> DataFrame:
    """n, mean, median and 90th percentile of a duration per group; nulls dropped."""
    return quantiles(
        df,
        groups,
        value,
        {f"{name}_p50_{unit}": 0.5, f"{name}_p90_{unit}": 0.9},
        extra=[(F.sum(F.col("_value") * F.col("_n")) / F.sum("_n")).alias(f"{name}_mean_{unit}")],
    )


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "row_id") -> DataFrame:
    """Contiguous numbers 0..n-1 in the given total order.

    A range-partitioned sort, then position in the partition plus the sizes of
    the partitions before it. The sorted rows are checkpointed so both parts see
    the same partitions even when a task is run again.
    """
    position = (1 << 33) - 1
    placed = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns(
        {"_part": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND(F.lit(position))}
    )
    # One row per sort partition, whose number is a session setting.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_offset") + F.col("_pos")
    ).drop("_at", "_part", "_pos", "_offset")


def lagged(
    df: DataFrame, key: str, order: Sequence[str], time: str, k: int, *, base: DataFrame | None = None
) -> DataFrame:
    """Adds `lag_1..lag_k`: the `time` of the 1st..k-th row before, per key.

    Rows are windowed per (key, day), whatever their number; what lies before a
    day's first rows comes from a small side table with the last k times of each
    day. `order` starts with `time`. `base` may give the same (key, time) rows from
    an earlier, cheaper step.
    """
    days = (df if base is None else base).select(key, time).withColumn("_day", day_of(time))
    inner = Window.partitionBy(key, "_day").orderBy(*order)
    local = df.withColumn("_day", day_of(time)).withColumns(
        {**{f"_lag_{i}": F.lag(time, i).over(inner) for i in range(1, k + 1)}, "_head": F.row_number().over(inner)}
    )
    joined = local.join(_times_before(days, key, time, k), [key, "_day"], "left")
    return joined.select(
        *df.columns,
        *[
            F.when(F.col("_head") > i, F.col(f"_lag_{i}"))
            .otherwise(F.get("_before", F.lit(i) - F.col("_head")))
            .alias(f"lag_{i}")
            for i in range(1, k + 1)
        ],
    )


def _times_before(df: DataFrame, key: str, time: str, k: int) -> DataFrame:
    """key, _day, _before: the latest k times of earlier days, latest first."""
    if k == 1:
        last = df.groupBy(key, "_day").agg(F.array(F.max(time)).alias("_times"))
    else:
        # Spark keeps k rows per (key, day) on the map side.
        rank = F.row_number().over(Window.partitionBy(key, "_day").orderBy(F.col(time).desc()))
        top = df.select(key, "_day", time).withColumn("_rank", rank).where(F.col("_rank") <= k)
        last = top.groupBy(key, "_day").agg(F.collect_list(time).alias("_times"))
    earlier = Window.partitionBy(key).orderBy("_day").rowsBetween(-k, -1)
    times = F.sort_array(F.flatten(F.collect_list("_times").over(earlier)), asc=False)
    return last.select(key, "_day", F.slice(times, 1, k).alias("_before"))


def densify(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """One row per whole number in [first, last]; long ranges are cut in chunks."""
    chunks = df.withColumns({"_first": first.cast("long"), "_last": last.cast("long")}).where(
        F.col("_first") <= F.col("_last")
    )
    chunks = chunks.withColumn("_from", F.explode(F.sequence("_first", "_last", F.lit(_CHUNK).cast("long"))))
    # One small row per chunk: spread them before they grow.
    return chunks.repartition("_from").withColumn(
        name, F.explode(F.sequence("_from", F.least("_last", F.col("_from") + (_CHUNK - 1))))
    ).drop("_first", "_last", "_from")
