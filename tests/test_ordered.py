"""Order statistics on hot groups against numpy."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from objectlog.functions.ordered import cumulative, densify, lagged, number_rows, quantiles
from objectlog.operators import metrics
from objectlog.sources.normalize import fill_forward

from .conftest import HOUR, START


def test_quantiles_of_any_values(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([0.0, -1.5, 2.25, rng.uniform(-1e6, 1e6), rng.gauss(0, 1e-6)])) for _ in range(3000)]
    rows += [(None, float(i)) for i in range(7)] + [("one", 5.0), ("gone", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.g: r for r in quantiles(df, ["g"], F.col("v"), probs).collect()}
    assert set(got) == {"hot", None, "one"}
    for g, row in got.items():
        values = [v for k, v in rows if k == g]
        assert row.n == len(values)
        for name, p in probs.items():
            assert np.isclose(row[name], np.quantile(values, p), rtol=1e-9, atol=1e-15), (g, name)


def test_quantiles_with_weights(spark):
    df = spark.createDataFrame([("g", 1.0, 3), ("g", 2.0, 0), ("g", 4.0, 2)], "g string, v double, w int")
    row = quantiles(df, ["g"], F.col("v"), {"m": 0.5, "q": 0.75}, weight=F.col("w")).first()
    assert (row.n, row.m, row.q) == (5, np.quantile([1, 1, 1, 4, 4], 0.5), np.quantile([1, 1, 1, 4, 4], 0.75))


def test_cumulative_order(spark):
    values = [-3.0, -0.5, 0.0, 1e-9, 0.75, 1.0, 1e12]
    df = spark.createDataFrame([("g", v, 1) for v in values], "g string, v double, n long")
    rows = sorted(cumulative(df, ["g"], "v", ["n"]).collect(), key=lambda r: r.v)
    assert [r.n_upto for r in rows] == list(range(1, 8)) and {r.n_all for r in rows} == {7}


def test_lags_cross_days(spark):
    rng = random.Random(4)
    rows = [(k, START + HOUR * rng.randrange(400), f"e{i:04d}") for i, k in enumerate(["hot"] * 300 + ["cold"] * 20)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, e string")
    got = {r.e: (r.lag_1, r.lag_2, r.lag_3) for r in lagged(df, "k", ["t", "e"], "t", 3).collect()}
    one = {r.e: r.lag_1 for r in lagged(df, "k", ["t", "e"], "t", 1).collect()}
    for key in ("hot", "cold"):
        own = sorted((t, e) for k, t, e in rows if k == key)
        for i, (_t, e) in enumerate(own):
            want = tuple(own[i - j][0] if i >= j else None for j in (1, 2, 3))
            assert got[e] == want and one[e] == want[0]


def test_values_carry_over_days(spark):
    rng = random.Random(8)
    rows = [
        (k, START + HOUR * rng.randrange(400), i, rng.choice([None, None, None, f"v{i}"]), rng.choice([None, float(i)]))
        for i, k in enumerate(["hot"] * 300 + ["cold"] * 20)
    ]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i int, a string, b double")
    want = {}
    for key in ("hot", "cold"):
        a = b = None
        for _k, t, i, va, vb in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            a, b = va if va is not None else a, vb if vb is not None else b
            want[i] = (a, b)
    out = fill_forward(df, "k", ["t", "i"], "t", ["a", "b"])
    assert out.columns == df.columns
    assert {r.i: (r.a, r.b) for r in out.collect()} == want


def test_values_without_a_time_come_first(spark):
    rows = [("k", None, "x"), *[("k", START + HOUR * 24 * d, None) for d in range(3)]]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, a string")
    assert [r.a for r in fill_forward(df, "k", ["t"], "t", ["a"]).collect()] == ["x"] * 4
    lags = {r.t: r.lag_1 for r in lagged(df, "k", ["t"], "t", 1).collect()}
    assert lags == {None: None, START: None, START + HOUR * 24: START, START + HOUR * 48: START + HOUR * 24}


def test_row_numbers_are_contiguous(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"))
    rows = number_rows(df, ["v"]).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(5000))
    assert [r.v for r in rows] == sorted(r.v for r in rows)


def test_densify_cuts_long_ranges(spark):
    df = spark.createDataFrame([(1, 0, 2_500_000), (2, 5, 4)], "k int, a long, b long")
    out = densify(df, F.col("a"), F.col("b"), "x").groupBy("k").agg(
        F.count("*").alias("n"), F.count_distinct("x").alias("d"), F.max("x").alias("m")
    )
    assert [tuple(r) for r in out.collect()] == [(1, 2_500_001, 2_500_001, 2_500_000)]


def test_ranking_with_ties(spark):
    rng = random.Random(6)
    rows = [(rng.random() < 0.3, round(rng.random(), 1)) for _ in range(400)]
    df = spark.createDataFrame([(int(t), p) for t, p in rows], "target int, pred double")
    row = metrics.binary(df).first()
    pos = [p for t, p in rows if t]
    neg = [p for t, p in rows if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert np.isclose(row.roc_auc, auc)
    gain, seen = 0.0, 0.0
    for cut in sorted({p for _, p in rows}, reverse=True):
        tp = sum(p >= cut for p in pos)
        gain += (tp / len(pos) - seen) * tp / (tp + sum(p >= cut for p in neg))
        seen = tp / len(pos)
    assert np.isclose(row.auprc, gain)
    assert metrics.binary(df.where("target = 1")).first().roc_auc is None


def test_multiclass_edge_cases(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "target int, pred array<double>")

    two = frame([(0, [0.9, 0.1, 0.0]), (2, [0.1, 0.1, 0.8]), (0, [0.2, 0.2, 0.6])])
    assert metrics.softmax_macro_auc(two).first().roc_auc == 1.0
    assert metrics.observed_macro_auc(two).first().roc_auc == 1.0
    one = frame([(1, [0.9, 0.1])])
    assert metrics.softmax_macro_auc(one).first().roc_auc is None
    assert metrics.observed_macro_auc(one).first().roc_auc is None
    zero = frame([(0, [0.0, 0.0]), (1, [0.0, 0.0])])
    assert metrics.observed_macro_auc(zero).first().roc_auc == 0.5
    wide = frame([(0, [1.0]), (1, [0.0]), (2, [0.0])])
    assert metrics.observed_macro_auc(wide).first().roc_auc is not None


def test_ranks_among_very_many_uneven_times(spark):
    """200,000 times and as many values, a third of them equal; against numpy."""
    import numpy as np

    from objectlog.functions.asof import with_rank

    rng = np.random.default_rng(2)
    times = rng.integers(0, 10**9, 200_000)
    values = np.where(np.arange(200_000) % 3 == 0, times[7], rng.integers(-5, 10**9, 200_000))
    held = spark.createDataFrame([(int(t),) for t in times], "at long")
    asked = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)] + [(-1, None)], "i int, v long")
    got = {r["i"]: r["rank"] for r in with_rank(asked, "v", held, "rank").collect()}
    want = np.searchsorted(np.sort(times), values, side="left")
    assert got.pop(-1) is None and got == {i: int(w) for i, w in enumerate(want)}


def test_a_grid_of_very_many_uneven_times(spark):
    from bisect import bisect_left
    from datetime import datetime, timedelta

    from objectlog import Grid

    start = datetime(2024, 1, 1)
    times = [start + timedelta(seconds=k * 7 + k % 3) for k in range(200_000)]
    grid = Grid.of(times)
    asked = [start + timedelta(seconds=s) for s in (-5, 0, 1, 7, 8, 700_003, 1_399_990, 10**7)]
    rows = spark.createDataFrame([(a,) for a in asked], "time timestamp_ntz").select("time", grid.slot_from(F.col("time")).alias("slot")).collect()
    assert [r["slot"] for r in rows] == [bisect_left(times, a) for a in asked]
    assert grid.frame(spark).where("slot = 199999").first()["time"] == times[-1]
