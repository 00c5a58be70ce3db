"""Label builders against brute force: ties, duplicate links, any grid, hot objects."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from objectlog import Grid
from objectlog.operators import labels, observe

from .conftest import HOUR, START

TYPES = ("a", "b", "c")


def brute(events, objects, times, source, target, delta, age):
    """{(object, t): (count, first type ahead, seconds to target)} of all candidates."""
    out = {}
    for obj in objects:
        own = sorted((t, e, k) for e, k, t, ids in events for i in ids if i == obj)
        for at in times:
            past = [x for x in own if x[0] <= at]
            if not past or past[-1][2] != source or (age is not None and past[-1][0] <= at - age):
                continue
            ahead = [x for x in own if at < x[0] <= at + delta]
            later = [x[0] for x in own if x[0] > at and x[2] == target]
            out[obj, at] = (
                sum(x[2] == target for x in ahead),
                ahead[0][2] if ahead else None,
                (min(later) - at).total_seconds() if later else None,
            )
    return out


def compare(log, events, objects, grid, times, source, target, delta, age):
    want = brute(events, objects, times, source, target, delta, age)
    counts = labels.stage_event_count(log, "T", grid, delta, source, target, age).collect()
    assert {(r.object_id, r.time): r.target for r in counts} == {k: v[0] for k, v in want.items()}
    assert len(counts) == len(want)
    hits = labels.stage_transition(log, "T", grid, delta, source, target, age).collect()
    assert {(r.object_id, r.time): r.target for r in hits} == {k: int(v[0] > 0) for k, v in want.items()}
    following = labels.stage_next_event(log, "T", grid, delta, source, ["b", "c"], age).collect()
    assert {(r.object_id, r.time): r.target for r in following} == {
        k: "bc".index(v[1]) for k, v in want.items() if v[1] in ("b", "c")
    }
    gaps = labels.stage_time_to_event(log, "T", grid, source, target, age).collect()
    assert {(r.object_id, r.time): r.target for r in gaps} == {k: v[2] for k, v in want.items() if v[2] is not None}


@st.composite
def cases(draw):
    event = st.tuples(st.sampled_from(TYPES), st.integers(0, 30), st.lists(st.sampled_from("uvw"), min_size=1, max_size=3))
    rows = draw(st.lists(event, min_size=1, max_size=25))
    events = [(f"e{i:02d}", k, START + HOUR * h, ids) for i, (k, h, ids) in enumerate(rows)]
    offsets = sorted(draw(st.sets(st.integers(-2, 34), min_size=1, max_size=6)))
    step = draw(st.integers(1, 5))
    even = draw(st.booleans())
    delta = HOUR * draw(st.integers(1, 9))
    age = draw(st.one_of(st.none(), st.integers(1, 12).map(lambda h: HOUR * h)))
    return events, offsets, step, even, delta, age


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(case=cases())
def test_stage_labels_match_brute_force(make_log, case):
    events, offsets, step, even, delta, age = case
    objects = {o: "T" for o in "uvw"}
    if even:
        grid = Grid.regular(START, HOUR * step, 7)
        times = [START + HOUR * step * i for i in range(7)]
    else:
        times = [START + HOUR * h for h in offsets]
        grid = Grid.of(times)
    compare(make_log(objects, events), events, objects, grid, times, "a", "b", delta, age)


def test_hot_object_takes_a_third_of_all_links(make_log):
    rng = random.Random(5)
    objects = {f"o{i}": "T" for i in range(40)} | {"hot": "T", "other": "U"}
    names = [o for o in objects if o.startswith("o")]
    events = []
    for i in range(900):
        ids = [rng.choice(names), rng.choice(names)] + ["hot"]
        events.append((f"e{i:03d}", rng.choice(TYPES), START + timedelta(minutes=rng.randrange(60 * 72)), ids))
    typed = {o: t for o, t in objects.items() if t == "T"}
    grid = Grid.regular(START + 6 * HOUR, 6 * HOUR, 10)
    times = [START + 6 * HOUR * (i + 1) for i in range(10)]
    compare(make_log(objects, events), events, typed, grid, times, "a", "b", 12 * HOUR, 3 * HOUR)


def test_nothing_after_the_horizon_matters(make_log):
    rng = random.Random(1)
    objects = {o: "T" for o in "uvwxyz"} | {o: "U" for o in "klmn"}
    events = [
        (f"e{i:03d}", rng.choice(TYPES), START + timedelta(minutes=rng.randrange(60 * 50)), rng.sample(list(objects), 3))
        for i in range(200)
    ]
    at, delta = START + 20 * HOUR, 10 * HOUR
    grid = Grid.regular(at, HOUR, 1)
    builders = (
        lambda log: labels.stage_event_count(log, "T", grid, delta, "a", "b"),
        lambda log: labels.stage_next_event(log, "T", grid, delta, "a", ["b", "c"]),
        lambda log: labels.stage_related_count(log, "T", "U", grid, delta, "a", "b"),
        lambda log: labels.pair_event_within(log, ("T", "U"), grid, delta, "a", "b"),
        lambda log: labels.window_event_counts(log, "T", grid, delta, TYPES),
        lambda log: labels.window_event_counts(log, ("T", "U"), grid, delta, TYPES, pair_mode="observed"),
    )
    whole = make_log(objects, events)
    cut = whole.replace(
        event=whole.event.where(F.col("time") <= F.lit(at + delta)), e2o=whole.e2o.where(F.col("time") <= F.lit(at + delta))
    )
    for build in builders:
        assert sorted(map(tuple, build(whole).collect())) == sorted(map(tuple, build(cut).collect()))
    past = whole.replace(event=whole.event.where(F.col("time") <= F.lit(at)), e2o=whole.e2o.where(F.col("time") <= F.lit(at)))
    for find in (
        lambda log: observe.stage_candidates(log, "T", grid, "a", 5 * HOUR),
        lambda log: observe.active_candidates(log, "T", grid, 5 * HOUR),
        lambda log: observe.observed_pair_candidates(log, ("T", "U"), grid, 5 * HOUR),
        lambda log: observe.cartesian_pair_candidates(log, ("T", "U"), grid, 5 * HOUR),
    ):
        assert sorted(map(tuple, find(whole).collect())) == sorted(map(tuple, find(past).collect()))


def test_pair_counts_multiply_duplicate_links(make_log):
    events = [("e0", "a", START, ["u", "k"]), ("e1", "b", START + 2 * HOUR, ["u", "u", "k", "k"])]
    log = make_log({"u": "T", "k": "U"}, events)
    grid = Grid.regular(START + HOUR, HOUR, 1)
    row = labels.window_event_counts(log, ("T", "U"), grid, 2 * HOUR, ["b"]).collect()[0]
    assert row.b == 4
    assert labels.pair_event_count(log, ("T", "U"), grid, 2 * HOUR, "a", "b").collect()[0].target == 1.0


def test_stored_typed_links_give_the_same_labels(make_log, spark, tmp_path):
    from objectlog.sources import store

    rng = random.Random(2)
    objects = {o: "T" for o in "uvw"} | {"k": "U"}
    events = [(f"e{i}", rng.choice(TYPES), START + HOUR * rng.randrange(40), rng.sample(list(objects), 2)) for i in range(60)]
    log = make_log(objects, events)
    store.save(log, str(tmp_path / "log"), typed_links=True)
    back = store.load(spark, str(tmp_path / "log"), normalized=False)
    grid = Grid.regular(START, 4 * HOUR, 10)
    args = ("T", grid, 8 * HOUR, "a", "b")
    assert sorted(map(tuple, labels.stage_event_count(back, *args).collect())) == sorted(
        map(tuple, labels.stage_event_count(log, *args).collect())
    )
    plan = labels.stage_event_count(back, *args)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "PartitionFilters: [isnotnull(object_type" in plan
    day = store.load(spark, str(tmp_path / "log"), until=START.date(), normalized=False)
    assert day.event.where(F.col("time") >= F.lit(START + timedelta(days=1))).count() == 0


def test_grid_positions():
    import datetime as dt

    assert Grid.of([START, START + HOUR]).times is None
    assert Grid.between(START, START + 5 * HOUR, 2 * HOUR).n == 3
    with pytest.raises(ValueError):
        Grid.regular(START, dt.timedelta(0), 3)
    with pytest.raises(ValueError):
        Grid.of([])
    train, val, test = observe.split_grids(START, START + 100 * HOUR, START + 50 * HOUR, START + 80 * HOUR, 7 * HOUR).values()
    assert train.joins(val) and train.start >= START and train.start - 7 * HOUR < START
    assert val.start + val.step * (val.n - 1) <= START + 73 * HOUR
    assert test.start == START + 80 * HOUR and test.n == 2


def test_heavy_events_meet_in_blocks(spark):
    """An event with a third of all links: the plain join's rows, but never more than a block of them under one key."""
    at = F.pmod(F.xxhash64("id"), F.lit(3))
    event = F.when(at == 0, "hot").otherwise(F.concat(F.lit("e"), F.pmod("id", F.lit(300)).cast("string")))
    src = spark.range(900).select(event.alias("event_id"), F.col("id").alias("s"))
    dst = spark.range(600).select(event.alias("event_id"), (-F.col("id")).alias("d"))
    met = observe.meet(src, dst, block=50).cache()
    plain = src.join(dst, "event_id")
    assert met.columns == ["event_id", "s", "d"] and met.count() == plain.count() == met.distinct().count()
    assert met.exceptAll(plain).count() == 0
    assert "_block0" in met._jdf.queryExecution().optimizedPlan().toString()
    assert observe.meet(src.where("false"), dst, block=50).count() == 0


def test_pairs_of_a_heavy_event(make_log, monkeypatch):
    """Labels over pairs do not depend on the size of the blocks."""
    rng = random.Random(8)
    objects = {f"u{i}": "T" for i in range(12)} | {f"k{i}": "U" for i in range(9)}
    events = [("hot", "b", START + 30 * HOUR, list(objects))]
    events += [(f"e{i}", rng.choice(TYPES), START + HOUR * rng.randrange(48), rng.sample(list(objects), 3)) for i in range(30)]
    log = make_log(objects, events)
    grid = Grid.regular(START + 10 * HOUR, 5 * HOUR, 7)
    builders = (
        lambda: labels.stage_related_count(log, "T", "U", grid, 9 * HOUR, "a", "b"),
        lambda: labels.pair_event_count(log, ("T", "U"), grid, 9 * HOUR, "a", "b"),
        lambda: labels.window_event_counts(log, ("T", "U"), grid, 9 * HOUR, TYPES, pair_mode="cartesian"),
    )
    whole = [sorted(map(tuple, build().collect())) for build in builders]
    plain, used = observe.meet, []

    def small(src, dst):
        used.append(1)
        return plain(src, dst, block=4)

    monkeypatch.setattr(observe, "meet", small)
    assert [sorted(map(tuple, build().collect())) for build in builders] == whole and len(used) == 3 and all(whole)


def test_cartesian_pairs_by_brute_force(make_log):
    rng = random.Random(9)
    objects = {f"u{i}": "T" for i in range(5)} | {f"k{i}": "U" for i in range(4)}
    events = [(f"e{i:02d}", "a", START + HOUR * rng.randrange(60), rng.sample(list(objects), 2)) for i in range(25)]
    log = make_log(objects, events)
    grid, delta = Grid.regular(START + 3 * HOUR, 4 * HOUR, 14), 6 * HOUR
    seen = {o: min((t for _, _, t, ids in events if o in ids), default=START) for o in objects}
    times = [grid.start + grid.step * i for i in range(grid.n)]
    active = {(o, i) for i, t in enumerate(times) for _, _, m, ids in events for o in ids if t - delta < m <= t}
    want = sorted(
        (s, d, i)
        for s in objects for d in objects for i, t in enumerate(times)
        if objects[s] == "T" and objects[d] == "U" and seen[s] <= t and seen[d] <= t and {(s, i), (d, i)} & active
    )
    got = observe.cartesian_pair_candidates(log, ("T", "U"), grid, delta)
    assert sorted(map(tuple, got.collect())) == want
