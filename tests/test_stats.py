"""Bootstrap by multinomial splitting and merged moments against numpy."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from objectlog.functions.ordered import quantiles, spread
from objectlog.operators import baselines, stats

ROOT = Path(__file__).resolve().parents[1]


def histogram(spark, values, split="train"):
    found, counts = np.unique(np.asarray(values, float), return_counts=True)
    return spark.createDataFrame([(split, float(v), int(n)) for v, n in zip(found, counts)], "split string, target double, n long")


@pytest.mark.parametrize("values", [[1.0] * 7, [1.0, 2.0], list(range(37)), [0.0] * 900 + [1.0] * 90 + [2.0] * 9 + [5.0]])
def test_resamples_hold_n_draws_with_multinomial_moments(spark, values):
    resamples = 400
    rows = stats.resampled_counts(histogram(spark, values), resamples, 7).collect()
    found, counts = np.unique(np.asarray(values, float), return_counts=True)
    drawn = np.zeros((resamples, len(found)))
    for r in rows:
        drawn[r["replicate"] - 1, np.searchsorted(found, r["target"])] += r["w"]
    n, p = len(values), counts / len(values)
    assert (drawn.sum(axis=1) == n).all()
    error = np.sqrt(n * p * (1 - p) / resamples)
    assert (np.abs(drawn.mean(axis=0) - n * p) <= 5 * error + 1e-9).all()
    assert np.allclose(drawn.var(axis=0), n * p * (1 - p), rtol=0.4, atol=0.05)
    if len(found) > 1:
        covariance = np.cov(drawn[:, 0], drawn[:, 1])[0, 1]
        assert abs(covariance + n * p[0] * p[1]) <= 5 * n * np.sqrt(p[0] * p[1] / resamples) + 0.1


def test_intervals_match_a_plain_bootstrap(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.gamma(2.0, 3.0, 3000), 1)
    labels = spark.createDataFrame([("train", float(v)) for v in values], "split string, target double")
    got = {r["statistic"]: r for r in stats.bootstrap(labels, []).collect()}
    plain = rng.choice(values, (2000, len(values)))
    for name, of in (("mean", plain.mean(axis=1)), ("std", plain.std(axis=1)), ("q50", np.median(plain, axis=1))):
        low, high = np.quantile(of, [0.025, 0.975])
        assert abs(got[name]["lower"] - low) < 0.25 * (high - low) + 0.051 and abs(got[name]["upper"] - high) < 0.25 * (high - low) + 0.051
    assert got["mean"]["point"] == pytest.approx(values.mean()) and got["std"]["point"] == pytest.approx(values.std())


def test_spread_keeps_its_digits_far_from_zero(spark):
    values = [1e9 + k % 5 / 8 for k in range(1000)]
    rows = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    found = quantiles(rows, ["g"], F.col("v"), {"p50": 0.5}, extra=[F.sqrt(spread() / F.sum("_n")).alias("std")]).first()
    assert found["std"] == pytest.approx(np.std(np.array(values) - 1e9), rel=1e-6)
    labels = spark.createDataFrame([("train", v) for v in values], "split string, target double")
    got = {r["statistic"]: r for r in stats.bootstrap(labels, [], resamples=50).collect()}
    assert got["std"]["point"] == pytest.approx(np.std(np.array(values) - 1e9), rel=1e-6)
    assert 0.16 < got["std"]["lower"] < 0.1768 < got["std"]["upper"] < 0.19


def test_a_class_that_holds_nearly_all_labels(spark):
    labels = spark.createDataFrame([("train", 0.0 if k % 50 else 1.0) for k in range(20_000)], "split string, target double")
    got = {r["statistic"]: r for r in stats.bootstrap(labels, [], classes=(0, 1)).collect()}
    assert got["class 1"]["point"] == pytest.approx(0.02) and 0.0175 < got["class 1"]["lower"] < 0.02 < got["class 1"]["upper"] < 0.0225


def test_the_rest_imports_without_the_text_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"
    told = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert int(told[0]) > 100 and told[1:] == ["False", "False"]


def test_given_predictions_must_belong_to_the_labels(spark):
    labels = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 1.0), ("c", 2, 1.0)], "id string, at int, target double")
    said = spark.createDataFrame([("c", 2, 0.9), ("a", 1, 0.2), ("b", 1, 0.4)], "id string, at int, pred double")
    found = baselines.evaluate_predictions(labels, said, ["id", "at"], "binary").first()
    assert found["roc_auc"] == 1.0 and found["accuracy"] == pytest.approx(2 / 3)
    assert baselines.evaluate_predictions(labels, said, ["id", "at"], "regression").first()["mae"] == pytest.approx(0.3)
    for wrong in (said.where("id <> 'a'"), said.unionByName(said.limit(1)), said.withColumn("at", F.lit(1))):
        with pytest.raises(ValueError):
            baselines.evaluate_predictions(labels, wrong, ["id", "at"], "binary")
    with pytest.raises(ValueError):
        baselines.evaluate_predictions(labels, said, ["id", "at"], "ranking")
    many = labels.select("id", "at", F.array(F.col("target"), 1 - F.col("target")).alias("target"))
    scores = said.select("id", "at", F.array(F.col("pred"), 1 - F.col("pred")).alias("pred"))
    assert baselines.evaluate_predictions(many, scores, ["id", "at"], "multilabel").first()["multilabel_accuracy"] == pytest.approx(2 / 3)
