"""Label tables: what happens to a candidate after its observation time.

Most builders find candidates and their future in one pass over the links (see
`observe.staged`); the others fold the future to one row per (key, slot) and join.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import class_index, seconds_between
from ..functions.ordered import number_rows
from ..functions.sieve import sieve
from ..grid import Grid
from ..model import ObjectLog, quoted
from . import observe
from .observe import AHEAD, PAIR, SINGLE, timed
from .transform import upto_time


def _ahead(value: Column) -> Column:
    return F.when(F.col(AHEAD), value)


def stage_transition(
    log: ObjectLog,
    object_type: str,
    grid: Grid,
    delta: timedelta,
    source: str,
    target: str,
    max_age: timedelta | None = None,
) -> DataFrame:
    """1 if `target` happens in `(t, t + delta]`, else 0."""
    counted = stage_event_count(log, object_type, grid, delta, source, target, max_age)
    return counted.withColumn("target", (F.col("target") > 0).cast("int"))


def stage_next_event(
    log: ObjectLog,
    object_type: str,
    grid: Grid,
    delta: timedelta,
    source: str,
    classes: Sequence[str],
    max_age: timedelta | None = None,
) -> DataFrame:
    """Class of the very next event within delta; other next events drop the row."""
    following = F.min_by("type", _ahead(F.struct("time", "event_id"))).alias("following")
    links, members = log.links_and_members(object_type)
    rows = observe.staged(
        links, SINGLE, grid, source, max_age, members=members, looks_ahead=F.lit(True), delta=delta, found=[following]
    )
    rows = rows.where(F.col("following").isin(list(classes)))
    return timed(rows, SINGLE, grid, class_index(F.col("following"), classes).alias("target"))


def stage_event_count(
    log: ObjectLog,
    object_type: str,
    grid: Grid,
    delta: timedelta,
    source: str,
    target: str,
    max_age: timedelta | None = None,
) -> DataFrame:
    """Number of `target` links in `(t, t + delta]`; duplicate links count."""
    links, members = log.links_and_members(object_type)
    return _event_count(links, members, SINGLE, grid, delta, source, target, max_age)


def _event_count(
    links: DataFrame,
    members: DataFrame | None,
    keys: Sequence[str],
    grid: Grid,
    delta: timedelta,
    source: str,
    target: str,
    max_age: timedelta | None,
) -> DataFrame:
    rows = observe.staged(
        links,
        keys,
        grid,
        source,
        max_age,
        members=members,
        looks_ahead=F.col("type") == target,
        delta=delta,
        found=[F.count_if(F.col(AHEAD)).alias("n")],
    )
    return timed(rows, keys, grid, F.coalesce("n", F.lit(0)).cast("double").alias("target"))


def stage_related_count(
    log: ObjectLog,
    object_type: str,
    related_type: str,
    grid: Grid,
    delta: timedelta,
    source: str,
    target: str,
    max_age: timedelta | None = None,
) -> DataFrame:
    """Distinct other objects of a type that share a `target` event in the window.

    Links are cut to the windows of candidates before they meet the related objects
    of their events.
    """
    candidates = observe.stage_candidates(log, object_type, grid, source, max_age)
    future = observe.future_slots(log.links_of(object_type, target).select("object_id", "event_id", "time"), grid, delta)
    own = candidates.join(future, ["object_id", "slot"]).select("object_id", "slot", "event_id").distinct()
    related = log.links_of(related_type, target).select("event_id", F.col("object_id").alias("other")).distinct()
    met = observe.meet(own, related).where(F.col("object_id") != F.col("other"))
    counts = met.groupBy("object_id", "slot").agg(F.count_distinct("other").alias("n"))
    joined = candidates.join(counts, ["object_id", "slot"], "left")
    return timed(joined, SINGLE, grid, F.coalesce("n", F.lit(0)).cast("double").alias("target"))


def stage_attribute_value(
    log: ObjectLog,
    object_type: str,
    grid: Grid,
    delta: timedelta,
    source: str,
    target: str,
    table: str,
    column: str,
    max_age: timedelta | None = None,
) -> DataFrame:
    """Numeric attribute of the first `target` event in the window."""
    first = F.min_by("event_id", _ahead(F.struct("time", "event_id"))).alias("event_id")
    links, members = log.links_and_members(object_type)
    rows = observe.staged(
        links,
        SINGLE,
        grid,
        source,
        max_age,
        members=members,
        looks_ahead=F.col("type") == target,
        delta=delta,
        found=[first],
    )
    values = log[table].select("event_id", quoted(column).cast("double").alias("target"))
    return timed(rows.where("event_id IS NOT NULL").join(values, "event_id"), SINGLE, grid, "target")


def stage_time_to_event(
    log: ObjectLog,
    object_type: str,
    grid: Grid,
    source: str,
    target: str,
    max_age: timedelta | None = None,
) -> DataFrame:
    """Seconds to the next `target`, however far; rows without one are dropped."""
    candidates = observe.stage_candidates(log, object_type, grid, source, max_age)
    # An event follows all slots up to the last one before it.
    ahead = log.links(target).select(
        "object_id", (grid.slot_from(F.col("time")) - 1).alias("slot"), "time"
    )
    ahead = ahead.where("slot >= 0").groupBy("object_id", "slot").agg(F.min("time").alias("next"))
    both = candidates.withColumn("seen", F.lit(True)).join(ahead, ["object_id", "slot"], "full_outer")
    onward = Window.partitionBy("object_id").orderBy("slot").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("next", F.min("next").over(onward)).where("seen AND next IS NOT NULL")
    gap = seconds_between(F.col("next"), grid.time_of(F.col("slot")))
    return timed(found, SINGLE, grid, gap.alias("target"))


def stage_attribute_class(
    log: ObjectLog,
    object_type: str,
    grid: Grid,
    source: str,
    table: str,
    column: str,
    classes: Sequence[str],
    max_age: timedelta | None = None,
) -> DataFrame:
    """Class of the latest object attribute row at or before t whose value is a class.

    Equal attribute times are settled by the greatest value.
    """
    candidates = observe.stage_candidates(log, object_type, grid, source, max_age)
    values = log[table].select("object_id", "time", quoted(column).alias("value")).where(
        F.col("value").isin(list(classes))
    )
    values = values.withColumn("slot", grid.slot_from(F.col("time"))).where(F.col("slot") < grid.n)
    values = values.groupBy("object_id", "slot").agg(F.max(F.struct("time", "value")).alias("latest"))
    both = candidates.withColumn("seen", F.lit(True)).join(values, ["object_id", "slot"], "full_outer")
    so_far = Window.partitionBy("object_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("latest", F.last("latest", ignorenulls=True).over(so_far))
    found = found.where("seen AND latest IS NOT NULL")
    return timed(found, SINGLE, grid, class_index(F.col("latest.value"), classes).alias("target"))


def pair_event_within(
    log: ObjectLog,
    object_types: tuple[str, str],
    grid: Grid,
    delta: timedelta,
    source: str,
    target: str,
    max_age: timedelta | None = None,
) -> DataFrame:
    """1 if the pair meets in a `target` event in the window, else 0."""
    counted = pair_event_count(log, object_types, grid, delta, source, target, max_age)
    return counted.withColumn("target", (F.col("target") > 0).cast("int"))


def pair_event_count(
    log: ObjectLog,
    object_types: tuple[str, str],
    grid: Grid,
    delta: timedelta,
    source: str,
    target: str,
    max_age: timedelta | None = None,
) -> DataFrame:
    """Number of distinct `target` events of the pair in the window."""
    return _event_count(observe.pair_links(log, object_types), None, PAIR, grid, delta, source, target, max_age)


# -- window counts ---------------------------------------------------------


def window_event_counts(
    log: ObjectLog,
    object_types: str | tuple[str, str],
    grid: Grid,
    delta: timedelta,
    event_types: Sequence[str],
    pair_mode: str = "observed",
) -> DataFrame:
    """Wide counts per event type in the future window; zero rows are kept."""
    names = {f"_n{i}": t for i, t in enumerate(event_types)}
    if isinstance(object_types, str):
        keys = SINGLE
        found = [F.count_if(F.col(AHEAD) & (F.col("type") == t)).alias(n) for n, t in names.items()]
        rows = observe.active(
            log, object_types, grid, delta, looks_ahead=F.col("type").isin(list(event_types)), found=found
        )
    else:
        keys = PAIR
        build = {
            "observed": observe.observed_pair_candidates,
            "cartesian": observe.cartesian_pair_candidates,
        }[pair_mode]
        future = observe.future_slots(observe.pair_links(log, object_types, event_types), grid, delta)
        counts = future.groupBy(*keys, "slot").agg(
            *[F.sum(F.when(F.col("type") == t, F.col("weight"))).alias(n) for n, t in names.items()]
        )
        rows = build(log, object_types, grid, delta, counts=counts)
    return timed(rows, keys, grid, *[F.coalesce(n, F.lit(0)).cast("long").alias(t) for n, t in names.items()])


def target_column(event_types: Sequence[str], mode: str, specific: str | None = None) -> Column:
    """The target of one mode as an expression over the wide counts."""
    if mode.startswith("specific") and specific is None:
        raise ValueError(f"mode {mode!r} needs a specific type.")
    total = reduce(lambda a, b: a + b, [quoted(t) for t in event_types])
    if mode == "total_count":
        return total.cast("double")
    if mode == "any":
        return (total > 0).cast("int")
    if mode == "specific_count":
        return quoted(specific).cast("double")
    if mode == "specific_any":
        return (quoted(specific) > 0).cast("int")
    if mode == "multilabel":
        return F.array(*[(quoted(t) > 0).cast("float") for t in event_types])
    raise ValueError(f"Unknown mode: {mode!r}")


def counts_to_target(
    counts: DataFrame, event_types: Sequence[str], mode: str, specific: str | None = None
) -> DataFrame:
    """Fold wide counts into one `target` column."""
    keys = [c for c in counts.columns if c not in set(event_types)]
    return counts.select(*keys, target_column(event_types, mode, specific).alias("target"))


# -- label tables ----------------------------------------------------------


def known_at(log: ObjectLog, at: datetime) -> DataFrame:
    """Ids of the objects known at a time."""
    return upto_time(log, at).object.select("object_id")


def drop_unknown(labels: DataFrame, objects: DataFrame, keys: Sequence[str] = SINGLE) -> DataFrame:
    """Labels whose every entity is among the given object ids.

    Labels of other entities mostly go by a sieve, before any exchange; ids may repeat.
    """
    for key in keys:
        ids = objects.select(F.col("object_id").alias(key))
        labels = sieve(labels, ids, key, sinks=True).join(ids, key, "left_semi")
    return labels


def stack_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits in one frame with a `split` column."""
    return reduce(
        DataFrame.unionByName,
        [df.withColumn("split", F.lit(name)) for name, df in splits.items()],
    )


def label_nodes(
    splits: dict[str, DataFrame], keys: Sequence[str] = SINGLE
) -> tuple[DataFrame, DataFrame]:
    """(nodes, targets): the stacked labels without target, and the targets by id.

    Ids are contiguous and ascend by split (in the given order), time and entity.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split"))
    numbered = number_rows(stack_splits(splits), [order, "time", *keys], "label_id")
    nodes = numbered.select("label_id", "split", "time", *keys)
    return nodes, numbered.select("label_id", "target")


def split_labels(log: ObjectLog, grids: dict[str, Grid], test: datetime, build) -> dict[str, DataFrame]:
    """Labels per split: train and val see the log only up to the test cut.

    `build(log, grid)` is one of the builders above with its parameters bound.
    Train and val lie on one even grid and are built in one go.
    """
    past = upto_time(log, test)
    known = past.object.select("object_id")

    def built(source: ObjectLog, grid: Grid) -> DataFrame:
        labels = build(source, grid)
        return drop_unknown(labels, known, [k for k in (*SINGLE, *PAIR) if k in labels.columns])

    train, val = grids["train"], grids["val"]
    cut = F.lit(val.start).cast("timestamp_ntz")
    if train.joins(val):
        both = built(past, Grid.regular(train.start, train.step, train.n + val.n))
        out = {"train": both.where(F.col("time") < cut), "val": both.where(F.col("time") >= cut)}
    else:
        out = {"train": built(past, train), "val": built(past, val)}
    return {**out, "test": built(log, grids["test"])}
