"""Composition, coverage curves, activity over time, window sizes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta
from functools import reduce
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import with_rank
from ..functions.columns import from_micros, micros, to_micros
from ..functions.ordered import HEAVY, by_weight, densify, fold, number_rows, quantiles, spread
from ..grid import span
from ..model import ObjectLog, quoted

_KEYS = ("event_id", "object_id", "time")
_OTHER = {"event": ("event_id", "object_id"), "object": ("object_id", "event_id")}
_DEGREE = {"event": ("objects_per_event", "num_events"), "object": ("events_per_object", "num_objects")}


def type_counts(log: ObjectLog, entity: str) -> DataFrame:
    label = f"{entity}_type"
    kind = F.coalesce(F.col("type").cast("string"), F.lit("nan")).alias(label)
    return log[entity].groupBy(kind).agg(F.count(F.lit(1)).alias("count"))


def degrees(log: ObjectLog, entity: str) -> DataFrame:
    """Distinct partners of each linked event or object."""
    key, other = _OTHER[entity]
    return log.e2o.groupBy(key).agg(F.count_distinct(other).alias(_DEGREE[entity][0]))


def degree_distribution(log: ObjectLog, entity: str) -> DataFrame:
    value, count = _DEGREE[entity]
    return degrees(log, entity).groupBy(value).agg(F.count(F.lit(1)).alias(count))


def degree_summary(log: ObjectLog) -> DataFrame:
    """count, mean, std, min, p50, p90, max of both degrees."""
    both = reduce(
        DataFrame.unionByName,
        [
            degrees(log, entity).select(
                F.lit(_DEGREE[entity][0]).alias("metric"), F.col(_DEGREE[entity][0]).alias("degree")
            )
            for entity in ("event", "object")
        ],
    )
    value, n = F.col("_value"), F.col("_n")
    return quantiles(
        both,
        ["metric"],
        F.col("degree"),
        {"p50": 0.5, "p90": 0.9},
        extra=[
            (F.sum(value * n) / F.sum(n)).alias("mean"),
            F.when(F.sum(n) > 1, F.sqrt(spread() / (F.sum(n) - 1))).alias("std"),
            F.min("_value").cast("long").alias("min"),
            F.max("_value").cast("long").alias("max"),
        ],
    ).withColumnRenamed("n", "count")


def trace_lengths(log: ObjectLog) -> DataFrame:
    linked = log.e2o.where("event_id IS NOT NULL AND object_id IS NOT NULL")
    return fold(linked, "object_id", F.count_distinct("event_id").alias("object_trace_length"))


def coverage_by_min_length(log: ObjectLog) -> DataFrame:
    """Events and objects still covered when objects shorter than k are left out.

    The running totals run over the lengths that occur (at most about the square
    root of twice the number of links); the steps between are filled in after.

    The events of an object are told apart and counted where its links meet; the links of heavy objects (see
    `by_weight`) are counted pair by pair and joined to the counts.
    """
    links = log.e2o.select("event_id", "object_id").where("object_id IS NOT NULL")
    light, heavy = by_weight(links, "object_id", HEAVY)
    count = F.count("event_id").over(Window.partitionBy("object_id")).alias("object_trace_length")
    met = light.repartition("object_id").dropDuplicates(["object_id", "event_id"]).select("object_id", "event_id", count)
    met = met.where("object_trace_length > 0")
    lengths = met.groupBy("object_id").agg(F.max("object_trace_length").alias("object_trace_length"))
    if heavy is not None:
        crowds = trace_lengths(log.replace(e2o=heavy))
        met = met.unionByName(heavy.join(crowds, "object_id"))
        lengths = lengths.unionByName(crowds)
    per_event = met.groupBy("event_id").agg(F.max("object_trace_length").alias("length"))
    sides = per_event.groupBy("length").agg(
        F.count(F.lit(1)).alias("events"), F.lit(0).cast("long").alias("objects")
    ).unionByName(
        lengths.groupBy(F.col("object_trace_length").alias("length")).agg(
            F.lit(0).cast("long").alias("events"), F.count(F.lit(1)).alias("objects")
        )
    )
    hist = sides.groupBy("length").agg(F.sum("events").alias("events"), F.sum("objects").alias("objects"))
    longer = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.col("length").desc()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    shorter = F.lead("length", 1, -1).over(Window.orderBy(F.col("length").desc()))
    steps = hist.select(
        "length",
        (shorter + 1).alias("from_length"),
        F.sum("events").over(longer).alias("event_count"),
        F.sum("events").over(everything).alias("total_event_count"),
        F.sum("objects").over(longer).alias("object_count"),
        F.sum("objects").over(everything).alias("total_object_count"),
    )
    curve = densify(steps, F.col("from_length"), F.col("length"), "min_object_trace_length")
    return curve.select(
        "min_object_trace_length",
        "event_count",
        "total_event_count",
        (F.col("event_count") / F.col("total_event_count")).alias("event_share"),
        (F.col("event_count") / F.col("total_event_count") * 100).alias("event_share_pct"),
        "object_count",
        "total_object_count",
        (F.col("object_count") / F.col("total_object_count")).alias("object_share"),
        (F.col("object_count") / F.col("total_object_count") * 100).alias("object_share_pct"),
    )


def _above_steps(hist: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Rows of lengths that occur -> ranges of thresholds with what lies above."""
    up = Window.orderBy("length")
    upto = up.rowsBetween(Window.unboundedPreceding, 0)
    everything = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Thresholds below the shortest length form one more range: nothing excluded.
    start = hist.agg(
        F.lit(0).cast("long").alias("length"), *[F.lit(0).cast("long").alias(c) for c in counts]
    )
    known = hist.unionByName(start).groupBy("length").agg(*[F.sum(c).alias(c) for c in counts])
    return known.select(
        "length",
        (F.lead("length").over(up) - 1).alias("_until"),
        *[(F.sum(c).over(everything) - F.sum(c).over(upto)).alias(f"{c}_above") for c in counts],
        *[F.sum(c).over(everything).alias(f"{c}_total") for c in counts],
    ).withColumn("until", F.coalesce("_until", "length"))


def objects_above_length(log: ObjectLog) -> DataFrame:
    """Share of objects whose trace is strictly longer than each threshold."""
    hist = trace_lengths(log).groupBy(F.col("object_trace_length").alias("length")).agg(
        F.count(F.lit(1)).alias("objects")
    )
    curve = densify(_above_steps(hist, ["objects"]), F.col("length"), F.col("until"), "trace_length_threshold")
    share = F.col("objects_above") / F.col("objects_total")
    return curve.select(
        "trace_length_threshold",
        F.col("objects_above").alias("object_count_above_threshold"),
        F.col("objects_total").alias("total_object_count"),
        share.alias("object_share_above_threshold"),
        (share * 100).alias("object_share_above_threshold_pct"),
    ).where("total_object_count > 0")


def type_mix_above_length(log: ObjectLog, object_types: Iterable[str] | None = None) -> DataFrame:
    """Object-type shares among the objects longer than each threshold.

    Types become columns while totals run, so the window sees one row per length
    that occurs. The type list is a small vocabulary, read first if not given.
    """
    typed = trace_lengths(log).join(log.object.select("object_id", "type"), "object_id", "left").select(
        F.col("object_trace_length").alias("length"), F.coalesce(F.col("type").cast("string"), F.lit("unknown")).alias("type")
    )
    if object_types is None:
        object_types = {r[0] for r in log.object.select(F.col("type").cast("string")).distinct().collect()} - {None}
        object_types |= {"unknown"}
    names = {f"t{i}": kind for i, kind in enumerate(sorted(object_types))}
    hist = typed.groupBy("length").agg(*[F.count_if(F.col("type") == kind).alias(c) for c, kind in names.items()])
    steps = _above_steps(hist, list(names))
    above = reduce(lambda a, b: a + b, [F.col(f"{c}_above") for c in names])
    total = reduce(lambda a, b: a + b, [F.col(f"{c}_total") for c in names])
    rows = F.array(
        *[
            F.struct(F.lit(kind).alias("object_type"), F.col(f"{c}_above").alias("n"), F.col(f"{c}_total").alias("of_type"))
            for c, kind in names.items()
        ]
    )
    curve = densify(
        steps.select("length", "until", above.alias("above"), total.alias("total"), rows.alias("rows")),
        F.col("length"),
        F.col("until"),
        "trace_length_threshold",
    )
    share = F.when(F.col("above") > 0, F.col("n") / F.col("above")).otherwise(F.lit(0.0))
    long = curve.select("trace_length_threshold", "above", "total", F.inline("rows")).where("of_type > 0")
    return long.select(
        "trace_length_threshold",
        "object_type",
        F.col("n").alias("object_count_above_threshold"),
        F.col("above").alias("total_object_count_above_threshold"),
        share.alias("type_share_within_threshold"),
        (share * 100).alias("type_share_within_threshold_pct"),
        (F.col("above") / F.col("total") * 100).alias("global_object_share_pct"),
    )


def time_histogram(df: DataFrame, every: timedelta, by: str | None = None) -> DataFrame:
    """Rows per time bucket, and per value of `by`; rows without a time are left out."""
    width = micros(every)
    at = to_micros(F.col("time"))
    bucket = from_micros(at - F.pmod(at, F.lit(width))).alias("bucket")
    keys = [bucket] if by is None else [bucket, F.col(by)]
    return df.where(F.col("time").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def entity_histogram(log: ObjectLog, entity: str, every: timedelta = timedelta(days=1), by_type: bool = True) -> DataFrame:
    return time_histogram(log[entity], every, "type" if by_type else None)


def weekly_stability(events: DataFrame, hours: int, min_events: int = 200) -> DataFrame:
    """How alike the weekly activity profiles are, for hour bins of one width.

    Weeks run from Tuesday to Monday. All work after the first aggregation is on
    one row per week and cell (at most 168 cells).
    """
    if hours <= 0 or 24 % hours:
        raise ValueError(f"hours must divide 24, got {hours}.")
    day = F.expr("INTERVAL 1 DAY")
    counts = events.where(F.col("time").isNotNull()).groupBy(
        (F.date_trunc("week", F.col("time") - day).cast("timestamp_ntz") + day).alias("week"),
        F.weekday("time").alias("weekday"),
        (F.floor(F.hour("time") / hours) * hours).cast("int").alias("bucket"),
    ).agg(F.count(F.lit(1)).alias("n"))
    kept = counts.withColumn("total", F.sum("n").over(Window.partitionBy("week"))).where(
        F.col("total") >= max(min_events, 1)
    )
    cells = F.explode(F.sequence(F.lit(0), F.lit(7 * (24 // hours) - 1))).alias("cell")
    dense = kept.select("week", "total").distinct().select("week", "total", cells)
    code = F.col("weekday") * (24 // hours) + (F.col("bucket") / hours).cast("int")
    filled = dense.join(kept.select("week", code.alias("cell"), "n"), ["week", "cell"], "left").select(
        "week", "cell", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("p")
    )
    left, right = filled.alias("a"), filled.alias("b")
    pairs = (
        left.join(right, F.expr("a.cell = b.cell AND a.week < b.week"))
        .groupBy(F.col("a.week").alias("week"), F.col("b.week").alias("other"))
        .agg(
            F.when(
                (F.stddev_pop("a.p") > 0) & (F.stddev_pop("b.p") > 0), F.corr("a.p", "b.p")
            ).alias("r")
        )
    )
    # The correlation is symmetric: each pair counts for both of its orders.
    value, n = F.col("_value"), F.col("_n")
    alike = quantiles(
        pairs,
        [],
        F.col("r"),
        {"corr_p10": 0.1, "corr_p50": 0.5, "corr_p90": 0.9},
        weight=F.lit(2),
        extra=[
            (F.sum(value * n) / F.sum(n)).alias("corr_mean"),
            F.sqrt(spread() / (F.sum(n) - 1)).alias("corr_std"),
            F.min(value).alias("corr_min"),
        ],
    )
    size = kept.agg(
        F.lit(hours).alias("interval_hours"),
        F.count_distinct("week").alias("weeks_ge_min_events"),
        F.count_distinct("weekday", "bucket").alias("active_cells"),
    )
    # Two single-row frames.
    return size.join(alike, F.lit(True), "left").select(
        "interval_hours",
        "weeks_ge_min_events",
        "corr_mean",
        "corr_std",
        "corr_min",
        "corr_p10",
        "corr_p50",
        "corr_p90",
        "active_cells",
    )


def attribute_completeness(log: ObjectLog, kind: str) -> DataFrame | None:
    """table, column, rows, non_null, non_null_rate; one pass per table."""
    parts = []
    for name, df in log.attribute_tables(kind).items():
        columns = [c for c in df.columns if c not in _KEYS]
        if not columns:
            continue
        counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(quoted(c)).alias(f"_{i}") for i, c in enumerate(columns)])
        rows = F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("non_null")) for i, c in enumerate(columns)]
        )
        parts.append(counted.select(F.lit(name).alias("table"), F.col("_rows").alias("rows"), F.inline(rows)))
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).select(
        "table",
        "column",
        "rows",
        "non_null",
        F.when(F.col("rows") > 0, F.col("non_null") / F.col("rows")).alias("non_null_rate"),
    )


def table_overview(log: ObjectLog) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns")
        )
        for name, df in log.tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def column_types(log: ObjectLog) -> list[tuple[str, str, str]]:
    """(table, column, type) from the schemas; runs no job."""
    return sorted((name, f.name, f.dataType.simpleString()) for name, df in log.tables.items() for f in df.schema.fields)


def find_columns(log: ObjectLog, names: Iterable[str], preview_rows: int = 10) -> dict[str, tuple[list, DataFrame]]:
    """Tables with columns of these names (any case): their types and first rows."""
    wanted = {n.lower() for n in names}
    found = {}
    for table, df in log.tables.items():
        chosen = [f for f in df.schema.fields if f.name.lower() in wanted]
        if chosen:
            kinds = [(f.name, f.dataType.simpleString()) for f in chosen]
            found[table] = (kinds, df.select(*[quoted(f.name) for f in chosen]).limit(preview_rows))
    return found


def sample_root_times(log: ObjectLog, num_roots: int = 64, seed: int = 0) -> DataFrame:
    """time of a repeatable sample of links, without replacement: those with the smallest md5 of (seed, ids, time)."""
    timed = log.e2o.where("event_id IS NOT NULL AND object_id IS NOT NULL AND time IS NOT NULL")
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), "event_id", "object_id", to_micros(F.col("time"))))
    return timed.orderBy(code, "event_id", "object_id", "time").limit(num_roots).select("time")


def window_sizes(log: ObjectLog, deltas: Sequence[timedelta], roots: DataFrame) -> DataFrame:
    """Distinct events and objects in the closed window [t, t + delta] from each root (column time; repeated ones count).

    Roots are numbered in order. Where a link's windows begin and end among them are ranks of its time (less each delta)
    among the roots, so a link meets only the roots whose widest window holds it. Per root and id the narrowest window
    that holds it is kept, and counts add up from narrow to wide.
    """
    spans = sorted(set(deltas))
    if not spans or spans[0] <= timedelta(0):
        raise ValueError("deltas must be positive.")
    numbered = number_rows(roots.where("time IS NOT NULL").select("time"), ["time"], "root_index")
    spine = numbered.select(F.col("root_index").cast("int").alias("root_index"), F.col("time").cast("timestamp_ntz").alias("root_time"))
    held = numbered.select(to_micros(F.col("time")).alias("at"))
    timed = log.e2o.where("event_id IS NOT NULL AND object_id IS NOT NULL AND time IS NOT NULL")
    at = to_micros(F.col("time"))
    # Distinct times meet the roots; links only take over what their time has found.
    edges = [F.struct(F.lit(f"_from{i}").alias("edge"), (F.col("_time") - micros(d)).alias("_at")) for i, d in enumerate(spans)]
    edges.append(F.struct(F.lit("_to").alias("edge"), (F.col("_time") + 1).alias("_at")))
    names = [f"_from{i}" for i in range(len(spans))] + ["_to"]
    asked = timed.select(at.alias("_time")).distinct().select("_time", F.inline(F.array(*edges)))
    moments = (
        with_rank(asked, "_at", held, "rank")
        .groupBy("_time")
        .agg(*[F.max(F.when(F.col("edge") == name, F.col("rank"))).alias(name) for name in names])
        .where(F.col(f"_from{len(spans) - 1}") < F.col("_to"))
    )
    known = moments.select(F.struct("_time").alias("_moment"), *names)
    met = timed.select("event_id", "object_id", F.struct(at.alias("_time")).alias("_moment")).join(known, "_moment")
    hits = span(met, F.col(f"_from{len(spans) - 1}"), F.col("_to") - 1, "root_index")
    rank = reduce(lambda acc, i: acc + F.when(F.col("root_index") < F.col(f"_from{i}"), 1).otherwise(0), range(len(spans)), F.lit(0))
    hits = hits.select(F.col("root_index").cast("int").alias("root_index"), "event_id", "object_id", rank.alias("rank"))
    sizes = []
    for key in ("event_id", "object_id"):
        narrowest = hits.groupBy("root_index", key).agg(F.min("rank").alias("rank"))
        sizes.append(
            narrowest.groupBy("root_index", "rank").agg(
                F.count(F.lit(1) if key == "event_id" else F.lit(None)).alias("event_count"),
                F.count(F.lit(1) if key == "object_id" else F.lit(None)).alias("object_count"),
            )
        )
    table = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(micros(d)).alias("delta_us")) for i, d in enumerate(spans)])
    spine = spine.select("root_index", "root_time", F.inline(table))
    counted = sizes[0].unionByName(sizes[1]).groupBy("root_index", "rank").agg(
        F.sum("event_count").alias("event_count"), F.sum("object_count").alias("object_count")
    )
    upto = Window.partitionBy("root_index").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(counted, ["root_index", "rank"], "left").select(
        "root_index",
        "root_time",
        (F.col("delta_us") / F.lit(1e6)).alias("delta_seconds"),
        (F.col("delta_us") / F.lit(8.64e10)).alias("delta_days"),
        F.coalesce(F.sum("event_count").over(upto), F.lit(0)).alias("event_count"),
        F.coalesce(F.sum("object_count").over(upto), F.lit(0)).alias("object_count"),
    )


def window_size_bands(samples: DataFrame, ci: float = 0.95) -> DataFrame:
    """Mean window size per delta with a normal confidence band."""
    if not 0 < ci < 1:
        raise ValueError(f"ci must lie between 0 and 1, got {ci}.")
    z = NormalDist().inv_cdf((1 + ci) / 2)
    pairs = F.array(
        F.struct(F.lit("event").alias("metric"), F.col("event_count").alias("size")),
        F.struct(F.lit("object").alias("metric"), F.col("object_count").alias("size")),
    )
    stats = samples.select("delta_seconds", "delta_days", F.inline(pairs)).groupBy(
        "delta_seconds", "delta_days", "metric"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("size").alias("mean"),
        F.coalesce(F.stddev_samp("size"), F.lit(0.0)).alias("std"),
    )
    sem = F.col("std") / F.sqrt(F.col("n"))
    return stats.withColumn("sem", sem).withColumns(
        {"ci_lower": F.col("mean") - z * F.col("sem"), "ci_upper": F.col("mean") + z * F.col("sem")}
    )
