"""What one task holds, and what travels, does not grow with the input."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from objectlog import Grid, configure
from objectlog.operators import labels, observe
from objectlog.sources import json_docs

from .conftest import HOUR, START

SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.mark.parametrize("given, files, shuffled", [("128MB", 32 << 20, 16 << 20), ("64m", 32 << 20, 16 << 20), ("2g", 32 << 20, 16 << 20), ("8m", 8 << 20, 8 << 20), ("500000b", 500_000, 500_000)])
def test_tasks_read_bounded_parts(spark, given, files, shuffled):
    before = {k: spark.conf.get(k) for k in SIZES}
    try:
        for name in SIZES:
            spark.conf.set(name, given)
        configure(spark)
        sizes = [spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(k)) for k in SIZES]
        assert sizes == [files, shuffled]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_catalogue_counts_keys_without_sets_of_them(spark, monkeypatch):
    kinds = ["BIGINT", "BIGINT", "DECIMAL(3,1)", "DOUBLE", "BOOLEAN", "STRING", "VOID", None]
    rng = random.Random(5)
    rows = []
    for kind in ("s", "t", "u", None):
        for name in "abcdef":
            some = rng.sample(kinds, 2) if name > "c" else ["BIGINT"]
            for key in (*range(12), None, None):
                rows += [(key, kind, n, name, "1", rng.choice(some)) for n in range(rng.randrange(3) if name > "a" else 2)]
    rows += [(1, "v", 0, "one", "1", "BIGINT"), (2, "v", 0, "two", "1", "VOID")]
    frame = spark.createDataFrame(rows, "event_id int, type string, pos int, name string, value string, kind string")
    want = {}
    for kind in "stuv":
        mine = [r for r in rows if r[1] == kind]
        for name in sorted({r[3] for r in mine}):
            known = [(r[0], r[5]) for r in mine if r[3] == name and r[5] not in (None, "VOID")]
            column = "string"
            if known and all(k == "BIGINT" for _, k in known) and len({i for i, _ in known}) == len({r[0] for r in mine}):
                column = "long"
            elif known and all(k.startswith(("BIGINT", "DECIMAL", "DOUBLE")) for _, k in known):
                column = "double"
            elif known and all(k == "BOOLEAN" for _, k in known):
                column = "boolean"
            want.setdefault(kind, {})[name] = column
    plans, plain = [], type(frame).collect

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df)

    monkeypatch.setattr(type(frame), "collect", seen)
    assert json_docs.attribute_catalogue(frame, ["event_id"]) == want
    assert {c for names in want.values() for c in names.values()} >= {"long", "double", "string"}
    assert len(plans) == 1 and "Expand" not in plans[0]


def _pairs_log(make_log):
    rng = random.Random(17)
    objects = {f"u{i}": "T" for i in range(6)} | {f"k{i}": "U" for i in range(5)}
    events = [(f"e{i:02d}", rng.choice("abc"), START + HOUR * rng.randrange(70), rng.choices(list(objects), k=3)) for i in range(40)]
    return objects, events, make_log(objects, events)


@pytest.mark.parametrize("mode", ["observed", "cartesian"])
def test_window_counts_of_pairs_by_brute_force(make_log, mode):
    objects, events, log = _pairs_log(make_log)
    grid, delta = Grid.regular(START + 5 * HOUR, 4 * HOUR, 15), 9 * HOUR
    seen = {o: min((t for _, _, t, ids in events if o in ids), default=START) for o in objects}
    want = []
    for s in (o for o in objects if objects[o] == "T"):
        for d in (o for o in objects if objects[o] == "U"):
            both = [(kind, m, ids.count(s) * ids.count(d)) for _, kind, m, ids in events if s in ids and d in ids]
            for i in range(grid.n):
                t = grid.start + grid.step * i
                busy = any(t - delta < m <= t and (s in ids or d in ids) for _, _, m, ids in events)
                met = mode == "cartesian" or any(m < t for _, m, _ in both)
                if busy and met and seen[s] <= t and seen[d] <= t:
                    n = Counter()
                    for kind, m, weight in both:
                        n[kind] += weight if t < m <= t + delta else 0
                    want.append((s, d, t, n["a"], n["b"]))
    got = labels.window_event_counts(log, ("T", "U"), grid, delta, ["a", "b"], pair_mode=mode)
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[3] + r[4] for r in want)


@pytest.mark.parametrize("mode", ["observed", "cartesian"])
def test_slots_of_pairs_do_not_travel(make_log, mode):
    _, _, log = _pairs_log(make_log)
    counts = labels.window_event_counts(log, ("T", "U"), Grid.regular(START, HOUR, 15), 9 * HOUR, ["a", "b"], pair_mode=mode)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window") < plan.index("Join")


def test_runs_that_touch_are_one(spark):
    rng = random.Random(2)
    rows = [(k, a, a + rng.randrange(4)) for k in ("x", "y", "z") for a in rng.choices(range(60), k=15)]
    got = {(r.k, r._a, r._b) for r in observe.islands(spark.createDataFrame(rows, "k string, _a int, _b int"), ["k"]).collect()}
    covered = {(k, i) for k, a, b in rows for i in range(a, b + 1)}
    first = sorted((k, i) for k, i in covered if (k, i - 1) not in covered)
    last = sorted((k, i) for k, i in covered if (k, i + 1) not in covered)
    assert got == {(k, a, b) for (k, a), (_, b) in zip(first, last)}
