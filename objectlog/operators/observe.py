"""Who can be labelled when: candidates on an observation grid.

Everything is folded to one row per (key, slot) by aggregates that combine on the
map side, so a hot object is cut down to at most one row per grid time before it
meets a window or a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import whole_seconds
from ..grid import Grid, span
from ..model import ObjectLog

SINGLE = ("object_id",)
PAIR = ("object_id_src", "object_id_dst")
SPLITS = ("train", "val", "test")
#: Rows of one event and side that meet in one task.
BLOCK = 2048


# -- grids -----------------------------------------------------------------


def split_grids(
    first_event: datetime,
    last_event: datetime,
    val: datetime,
    test: datetime,
    delta: timedelta,
    num_eval: int = 1000,
) -> dict[str, Grid]:
    """Grids whose label windows end before the next split begins.

    Train steps back from `val - delta` to the first event; val and test step
    forward from their anchors, at most `num_eval` times.
    """
    steps_back = (val - delta - first_event) // delta
    train = Grid.regular(val - delta * (steps_back + 1), delta, steps_back + 1)

    def forward(start: datetime, end: datetime) -> Grid:
        return Grid.between(start, min(start + delta * (num_eval - 1), end - delta), delta)

    return {"train": train, "val": forward(val, test), "test": forward(test, last_event)}


def event_bounds(log: ObjectLog) -> tuple[datetime, datetime]:
    row = log.event.agg(F.min("time"), F.max("time")).first()
    return row[0], row[1]


def grid_frame(spark: SparkSession, grids: dict[str, Grid]) -> DataFrame:
    """split, time of every observation."""
    parts = [grid.frame(spark).select(F.lit(split).alias("split"), "time") for split, grid in grids.items()]
    return reduce(DataFrame.unionByName, parts)


# -- slots -----------------------------------------------------------------


def past_runs(links: DataFrame, keys: Sequence[str], grid: Grid, delta: timedelta) -> DataFrame:
    """(keys, _a, _b): runs of slots with an event in `(t - delta, t]`; they may overlap."""
    first = grid.slot_from(F.col("time"))
    last = grid.slot_from_shifted(F.col("time"), whole_seconds(delta)) - 1
    runs = links.withColumns({"_a": first, "_b": last}).where("_a <= _b")
    return runs.groupBy(*keys, "_a").agg(F.max("_b").alias("_b"))


def disjoint(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs (`_a` to `_b`) without the slots that earlier ones of the same key cover."""
    order = Window.partitionBy(*keys).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_covered", F.max("_b").over(order))
    start = F.greatest(F.col("_a"), F.coalesce(F.col("_covered") + 1, F.col("_a")))
    return runs.withColumn("_a", start).where("_a <= _b").drop("_covered")


def islands(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs (keys, `_a` to `_b`) that overlap or touch made one, so a key that is always active is one row."""
    order = Window.partitionBy(*keys).orderBy("_a", "_b")
    covered = F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("_a") <= F.col("_covered") + 1, 0).otherwise(1)
    number = F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = runs.withColumn("_covered", covered).withColumn("_opens", opens).withColumn("_island", number)
    return numbered.groupBy(*keys, "_island").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")).drop("_island")


def future_slots(links: DataFrame, grid: Grid, delta: timedelta) -> DataFrame:
    """Each event once per slot that has it in its window `(t, t + delta]`."""
    first = grid.slot_from_shifted(F.col("time"), -whole_seconds(delta))
    return span(links, first, grid.slot_from(F.col("time")) - 1)


# -- links of pairs --------------------------------------------------------


def meet(src: DataFrame, dst: DataFrame, block: int = BLOCK) -> DataFrame:
    """The equi-join of both sides on `event_id`, heavy events in blocks.

    An event with more than `block` rows on a side is cut: its rows go to blocks of
    about that many, each copied once for every block of the other side. So no task
    forms more than about block² rows of one event, and a row is copied once for every
    `block` partners that it has. Only heavy events enter the table of block counts.
    """
    heavy = [
        side.groupBy("event_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(
            "event_id", F.ceil(F.col("_n") / block).cast("int").alias(f"_of{i}")
        )
        for i, side in enumerate((src, dst))
    ]
    blocks = heavy[0].join(heavy[1], "event_id", "full_outer")

    def placed(side: DataFrame, own: int, other: int) -> DataFrame:
        parts, copies = (F.coalesce(f"_of{i}", F.lit(1)) for i in (own, other))
        return side.join(blocks, "event_id", "left").select(
            *side.columns,
            F.pmod(F.xxhash64(*side.columns), parts).cast("int").alias(f"_block{own}"),
            F.explode(F.sequence(F.lit(0), copies - 1)).alias(f"_block{other}"),
        )

    keys = ["event_id", "_block0", "_block1"]
    return placed(src, 0, 1).join(placed(dst, 1, 0), keys).drop("_block0", "_block1")


def pair_links(
    log: ObjectLog,
    object_types: tuple[str, str],
    event_types: str | Sequence[str] | None = None,
) -> DataFrame:
    """One row per event and pair of two different objects of the given types.

    `weight` counts the combinations of duplicate links. Both sides are reduced
    to their type, and duplicates folded, before they meet; heavy events meet in
    blocks.
    """
    sides = []
    for kind, name in zip(object_types, PAIR):
        links = log.links_of(kind, event_types)
        sides.append(
            links.groupBy("event_id", "type", "time", F.col("object_id").alias(name)).agg(
                F.min("first_seen").alias(f"_seen_{name}"),
                F.count(F.lit(1)).alias(f"_n_{name}"),
            )
        )
    src, dst = sides[0], sides[1].drop("type", "time")
    return (
        meet(src, dst)
        .where(F.col(PAIR[0]) != F.col(PAIR[1]))
        .withColumn("weight", F.col(f"_n_{PAIR[0]}") * F.col(f"_n_{PAIR[1]}"))
        .drop(f"_n_{PAIR[0]}", f"_n_{PAIR[1]}")
    )


# -- candidates ------------------------------------------------------------


AHEAD = "_ahead"


def staged(
    links: DataFrame,
    keys: Sequence[str],
    grid: Grid,
    source: str,
    max_age: timedelta | None = None,
    *,
    members: DataFrame | None = None,
    looks_ahead: Column | None = None,
    delta: timedelta | None = None,
    found: Sequence[Column] = (),
) -> DataFrame:
    """(keys, slot) where the latest event is `source`, with what follows in `delta`.

    One pass over the links. An event at time x settles the state of the first
    slot at or after x, and lies in the window of the slots before it down to
    `x - delta`: a run of slots of which the last is the past and the others are
    ahead. Folding to (keys, slot) keeps the latest past event (equal times: the
    greatest id) and the aggregates `found`, which read rows where `AHEAD` holds.
    A state then holds up to the slot before the key's next row, while it is not
    older than `max_age`. Slots between rows have nothing ahead: `found` is null.
    `members` restricts the keys after the folding.
    """
    here = grid.slot_from(F.col("time"))
    first = here
    if looks_ahead is not None:
        first = F.when(looks_ahead, grid.slot_from_shifted(F.col("time"), -whole_seconds(delta))).otherwise(here)
    rows = span(links.withColumn("_here", here), first, F.col("_here")).where(F.col("slot") < grid.n)
    rows = rows.withColumn(AHEAD, F.col("slot") < F.col("_here"))
    past = ~F.col(AHEAD)
    cells = rows.groupBy(*keys, "slot").agg(
        F.max_by(
            F.struct((F.col("type") == source).alias("is_source"), "time"),
            F.when(past, F.struct("time", "event_id")),
        ).alias("_state"),
        *found,
    )
    names = [c for c in cells.columns if c not in (*keys, "slot", "_state")]
    if members is not None:
        cells = cells.join(members.select(*keys), list(keys), "left_semi")
    order = Window.partitionBy(*keys).orderBy("slot")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    held = cells.withColumns(
        {
            "_state": F.last("_state", ignorenulls=True).over(so_far),
            "_until": F.lead("slot", 1, grid.n).over(order) - 1,
        }
    ).where("_state.is_source")
    return _hold(held, keys, grid, names, max_age)


def _hold(held: DataFrame, keys: Sequence[str], grid: Grid, names: Sequence[str], max_age: timedelta | None) -> DataFrame:
    """Spread rows over the slots they hold; their values belong to the first one."""
    until = F.col("_until")
    if max_age is not None:
        until = F.least(until, grid.slot_from_shifted(F.col("_state.time"), whole_seconds(max_age)) - 1)
    spread = span(held.withColumnRenamed("slot", "_slot"), F.col("_slot"), until)
    own = F.col("slot") == F.col("_slot")
    return spread.select(*keys, "slot", *[F.when(own, F.col(n)).alias(n) for n in names])


def stage_candidates(
    log: ObjectLog, object_type: str, grid: Grid, source: str, max_age: timedelta | None = None
) -> DataFrame:
    links, members = log.links_and_members(object_type)
    return staged(links, SINGLE, grid, source, max_age, members=members)


def active(
    log: ObjectLog,
    object_type: str,
    grid: Grid,
    delta: timedelta,
    *,
    looks_ahead: Column | None = None,
    found: Sequence[Column] = (),
) -> DataFrame:
    """(object_id, slot) with an event in `(t - delta, t]`, object first seen by t.

    One pass, as in `staged`: an event keeps its object active from the first slot
    at or after it to the last one before `time + delta`.
    """
    here = grid.slot_from(F.col("time"))
    first = here
    if looks_ahead is not None:
        first = F.when(looks_ahead, grid.slot_from_shifted(F.col("time"), -whole_seconds(delta))).otherwise(here)
    links, members = log.links_and_members(object_type)
    seen = links.withColumns(
        {"_here": here, "_reach": grid.slot_from_shifted(F.col("time"), whole_seconds(delta)) - 1}
    )
    rows = span(seen, first, F.col("_here")).where(F.col("slot") < grid.n)
    rows = rows.withColumn(AHEAD, F.col("slot") < F.col("_here"))
    cells = rows.groupBy("object_id", "slot").agg(
        F.max(F.when(~F.col(AHEAD), F.col("_reach"))).alias("_reach"),
        *found,
        *([F.min("first_seen").alias("first_seen")] if members is None else []),
    )
    if members is not None:
        cells = cells.join(members, "object_id")
    cells = cells.where(F.col("first_seen").isNotNull())
    names = [c for c in cells.columns if c not in ("object_id", "slot", "_reach", "first_seen")]
    order = Window.partitionBy("object_id").orderBy("slot")
    reach = F.max("_reach").over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = cells.withColumns(
        {"_until": F.least(F.lead("slot", 1, grid.n).over(order) - 1, reach)}
    ).withColumnRenamed("slot", "_slot")
    start = F.greatest("_slot", grid.slot_from(F.col("first_seen")))
    own = F.col("slot") == F.col("_slot")
    return span(held, start, F.col("_until")).select(
        "object_id", "slot", *[F.when(own, F.col(n)).alias(n) for n in names]
    )


def active_candidates(log: ObjectLog, object_type: str, grid: Grid, delta: timedelta) -> DataFrame:
    return active(log, object_type, grid, delta)


def _active(log: ObjectLog, object_type: str, grid: Grid, delta: timedelta, name: str) -> DataFrame:
    """(name, _a, _b): the longest runs of slots in which an object is active."""
    links, members = log.links_and_members(object_type)
    runs = past_runs(links, SINGLE, grid, delta)
    if members is not None:
        runs = runs.join(members.select("object_id"), "object_id", "left_semi")
    return islands(runs, SINGLE).withColumnRenamed("object_id", name)


def _spread_pairs(runs: Sequence[DataFrame], counts: DataFrame | None = None) -> DataFrame:
    """(src, dst, slot) of runs of both sides: overlaps go while rows are runs, slots come last.

    `counts` (src, dst, slot, numbers; one row per slot) adds its numbers, null for slots without them. Such a row ends the
    run it lies in and begins what is left of it, so slots are made where the runs meet and travel no more.
    """
    whole = reduce(DataFrame.unionByName, runs).where("_a <= _b")
    if counts is None:
        return span(disjoint(whole, PAIR), F.col("_a"), F.col("_b")).select(*PAIR, "slot")
    names = [c for c in counts.columns if c not in (*PAIR, "slot")]
    rows = whole.unionByName(counts.withColumnRenamed("slot", "_a"), allowMissingColumns=True)
    # At one slot the runs come first: their rows are empty then, and the slot is held with its numbers.
    order = Window.partitionBy(*PAIR).orderBy("_a", F.col("_b").asc_nulls_last())
    reach = F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = rows.withColumns({"_reach": reach, "_next": F.lead("_a").over(order)}).where("_reach IS NOT NULL")
    slots = span(held, F.col("_a"), F.least("_reach", F.col("_next") - 1))
    own = F.col("slot") == F.col("_a")
    return slots.select(*PAIR, "slot", *[F.when(own, F.col(n)).alias(n) for n in names])


def observed_pair_candidates(
    log: ObjectLog, object_types: tuple[str, str], grid: Grid, delta: timedelta, counts: DataFrame | None = None
) -> DataFrame:
    """(src, dst, slot): met strictly before t, both seen by t, one of them active.

    Pairs are folded to their first meeting, then meet the active runs of either
    side; grid times without activity never appear. `counts` as in `_spread_pairs`.
    """
    src, dst = PAIR
    met = pair_links(log, object_types).groupBy(src, dst).agg(
        F.min("time").alias("met"), F.min(f"_seen_{src}").alias("_s"), F.min(f"_seen_{dst}").alias("_d")
    )
    known = met.where("_s IS NOT NULL AND _d IS NOT NULL").select(
        src,
        dst,
        F.greatest(
            grid.slot_after(F.col("met")), grid.slot_from(F.col("_s")), grid.slot_from(F.col("_d"))
        ).alias("_from"),
    )
    start = F.greatest("_from", "_a").alias("_a")
    return _spread_pairs(
        [
            known.join(_active(log, kind, grid, delta, name), name).select(*PAIR, start, "_b")
            for kind, name in zip(object_types, PAIR)
        ],
        counts,
    )


def cartesian_pair_candidates(
    log: ObjectLog,
    object_types: tuple[str, str],
    grid: Grid,
    delta: timedelta,
    spread: int = 16,
    counts: DataFrame | None = None,
) -> DataFrame:
    """(src, dst, slot): both seen by t, different, at least one active.

    The result is a product by definition. Only active × seen combinations are
    formed: active runs of slots meet the objects seen before they end, in
    `spread` × `spread` blocks of both sides. No object is copied for a slot before
    the pairs are formed and their runs merged. `counts` as in `_spread_pairs`.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    seen, active = {}, {}
    for kind, name in zip(object_types, PAIR):
        first = log.objects_of(kind).groupBy(F.col("object_id").alias(name)).agg(F.min("time").alias("_seen"))
        first = first.where("_seen IS NOT NULL").select(name, grid.slot_from(F.col("_seen")).alias("_from"))
        seen[name] = first
        active[name] = _active(log, kind, grid, delta, name).join(first, name).select(
            name, F.greatest("_a", "_from").alias("_a"), "_b"
        )
    parts = []
    for one, other in (PAIR, PAIR[::-1]):
        own = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(spread)).cast("int")
        runs = active[one].where("_a <= _b").select("*", own(one, "_a").alias("_block0"), every.alias("_block1"))
        objects = seen[other].select("*", own(other).alias("_block1"), every.alias("_block0"))
        met = runs.join(objects, ["_block0", "_block1"]).where((F.col("_from") <= F.col("_b")) & (F.col(one) != F.col(other)))
        parts.append(met.select(*PAIR, F.greatest("_a", "_from").alias("_a"), "_b"))
    return _spread_pairs(parts, counts)


def timed(slots: DataFrame, keys: Sequence[str], grid: Grid, *columns: Column | str) -> DataFrame:
    """Slots replaced by their times."""
    return slots.select(*keys, grid.time_of(F.col("slot")).alias("time"), *columns)
