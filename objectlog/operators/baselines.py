"""Simple predictors, scored per split without any driver loop over data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normalized, one_hot, to_micros, uniform
from ..functions.ordered import quantiles
from ..session import cut_lineage
from . import metrics
from .labels import stack_splits

# The baselines of each kind of task, and those that look at the
# entity and therefore leak.
BASELINES = {
    "regression": ("global_zero", "global_mean", "global_median", "entity_mean", "entity_median"),
    "binary": ("random", "majority", "entity_mean", "entity_median"),
    "multiclass": ("random", "majority", "entity_majority_multiclass"),
}
LEAKY = ("entity_mean", "entity_median", "entity_majority_multiclass")
REGRESSION_METRICS = ("mae", "mse", "rmse", "r2")
CLASSIFICATION_METRICS = ("accuracy", "f1", "auprc", "roc_auc", "multiclass_f1", "multiclass_roc_auc")
RESULT_KEYS = ("dataset", "task", "seed", "baseline", "split")
TIE = 1e-12

# Which rows a split's predictors are fitted on.
_FITTED_ON = {"train": "train", "val": "train", "test": "trainval"}


def combine(train: DataFrame, val: DataFrame) -> DataFrame:
    return train.unionByName(val)


def fit(labels: DataFrame, groups: Sequence[str]) -> DataFrame:
    """mean, median and majority (ties: the smallest) of the target per group."""
    return quantiles(
        labels,
        groups,
        F.col("target"),
        {"median": 0.5},
        extra=[
            (F.sum(F.col("_value") * F.col("_n")) / F.sum("_n")).alias("mean"),
            F.max_by("_value", F.struct("_n", -F.col("_value"))).alias("majority"),
        ],
    ).drop("n")


def fitted(stacked: DataFrame, key: str) -> DataFrame:
    """Labels of all splits with the global and entity values they are predicted by.

    Adds `mean`, `median`, `majority` and, where the entity was seen, `entity_*`.
    """
    used = F.when(F.col("split") == "train", F.array(F.lit("train"), F.lit("trainval"))).otherwise(
        F.array(F.lit("trainval"))
    )
    rows = stacked.where(F.col("split").isin("train", "val")).withColumn("fit", F.explode(used))
    overall = fit(rows, ["fit"])
    entity = fit(rows, ["fit", key])
    # Joined on a struct, so that a hot entity's labels can be split (see `fold`).
    own = F.struct("fit", key).alias("_own")
    entity = entity.select(own, *[F.col(c).alias(f"entity_{c}") for c in ("mean", "median", "majority")])
    source = F.create_map(*[F.lit(x) for pair in _FITTED_ON.items() for x in pair])
    scored = stacked.withColumn("fit", source[F.col("split")])
    # `overall` has two rows, one per fit.
    scored = scored.join(F.broadcast(overall), "fit", "left").withColumn("_own", own)
    return scored.join(entity, "_own", "left").drop("_own")


def predict(
    stacked: DataFrame, keys: Sequence[str], task_type: str, *, num_classes: int = 0, seeds: Sequence[int] = (42,)
) -> DataFrame:
    """Long frame (baseline, seed, split, target, pred) of every baseline of the task type.

    The random baseline has a row for each seed; the others do not depend on it and stand under the first one.
    """
    rows = fitted(stacked, keys[0])
    own = [to_micros(F.col("time")), *keys]
    value = {
        "global_zero": F.lit(0.0),
        "global_mean": F.col("mean"),
        "global_median": F.col("median"),
        "entity_mean": F.coalesce("entity_mean", "mean"),
        "entity_median": F.coalesce("entity_median", "median"),
        "majority": F.col("majority"),
    }
    drawn = {s: uniform(s, *own) for s in seeds}
    if task_type == "multiclass":
        value = {
            "majority": one_hot(F.col("majority"), num_classes),
            "entity_majority_multiclass": one_hot(F.coalesce("entity_majority", "majority"), num_classes),
        }
        drawn = {s: normalized(F.array(*[uniform(s, F.lit(k), *own) for k in range(num_classes)])) for s in seeds}
    said = [(name, seeds[0], value[name]) for name in BASELINES[task_type] if name != "random"]
    if "random" in BASELINES[task_type]:
        said += [("random", s, drawn[s]) for s in seeds]
    pairs = F.array(*[F.struct(F.lit(n).alias("baseline"), F.lit(s).alias("seed"), p.alias("pred")) for n, s, p in said])
    return rows.select("split", "target", F.inline(pairs))


def class_count(stacked: DataFrame, declared: int) -> int:
    """Width of class vectors: the declared number, or more if a label exceeds it."""
    largest = stacked.agg(F.max("target")).first()[0]
    return max(declared, 0 if largest is None else int(largest) + 1)


def score(predictions: DataFrame, task_type: str, groups: Sequence[str] = ("baseline", "seed", "split")) -> DataFrame:
    groups = list(groups)
    if task_type == "regression":
        return metrics.regression(predictions, groups)
    if task_type == "binary":
        return metrics.binary(predictions, groups)
    predictions = cut_lineage(predictions)
    parts = [
        metrics.accuracy(predictions, groups),
        metrics.macro_f1(predictions, groups),
        metrics.weighted_ovr_auc(predictions, groups),
        metrics.observed_macro_auc(predictions, groups),
    ]
    return reduce(lambda a, b: a.join(b, groups, "left"), parts)


def evaluate(
    splits: dict[str, DataFrame],
    keys: Sequence[str],
    task_type: str,
    *,
    dataset: str,
    task: str,
    num_classes: int = 0,
    seeds: Sequence[int] = (42,),
) -> DataFrame:
    """One row per seed, baseline and split: train and val scored by predictors fitted
    on train, test by predictors fitted on train and val together.

    Labels are built, and baselines without chance scored, once for all seeds."""
    # Label tables are small next to the log; they are built once for all baselines.
    stacked = cut_lineage(stack_splits(splits))
    if task_type == "multiclass":
        num_classes = class_count(stacked, num_classes)
    scored = score(predict(stacked, keys, task_type, num_classes=num_classes, seeds=seeds), task_type)
    every = F.array(*[F.lit(s) for s in seeds])
    scored = scored.withColumn("seed", F.explode(F.when(F.col("baseline") == "random", F.array("seed")).otherwise(every)))
    sizes = stacked.agg(
        F.struct(*[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in _FITTED_ON])
    ).scalar()
    names = REGRESSION_METRICS if task_type == "regression" else CLASSIFICATION_METRICS
    values = [F.col(m) if m in scored.columns else F.lit(None).cast("double").alias(m) for m in names]
    return scored.select(
        F.lit(dataset).alias("dataset"),
        F.lit(task).alias("task"),
        F.lit(task_type).alias("task_type"),
        "seed",
        *[sizes.getField(f"{s}_rows").alias(f"{s}_rows") for s in _FITTED_ON],
        "baseline",
        "split",
        *values,
    )


def best(results: DataFrame, metric: str, *, higher: bool) -> DataFrame:
    """Test rows of the baselines that do not leak, with the best one(s) flagged."""
    rows = results.where((F.col("split") == "test") & ~F.col("baseline").isin(*LEAKY))
    group = Window.partitionBy("dataset", "task", "seed")
    top = (F.max(metric) if higher else F.min(metric)).over(group)
    return rows.select(
        "dataset", "task", "seed", "baseline", metric, F.coalesce(F.abs(F.col(metric) - top) <= TIE, F.lit(False)).alias("is_best")
    )


def evaluate_predictions(labels: DataFrame, predictions: DataFrame, keys: Sequence[str], task_type: str) -> DataFrame:
    """The metrics of given predictions (keys, pred) against labels (keys, target), chosen by the task type; one row.

    Predictions are joined by key, in whatever order they come. A key without a label, a label without a prediction, or
    a key that occurs twice on either side is an error. regression: numbers; binary: scores; multiclass: a score for
    each class; multilabel: an array of scores, decided at 0.5.
    """
    keys = list(keys)
    for name, side in (("labels", labels), ("predictions", predictions)):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"A key occurs twice in the {name}.")
    missing = metrics.misaligned(predictions, labels, keys).first()
    if missing["without_label"] or missing["without_prediction"]:
        raise ValueError(f"Predictions and labels do not belong together: {missing.asDict()}")
    rows = labels.select(*keys, "target").join(predictions.select(*keys, "pred"), keys).select("target", "pred")
    if task_type == "regression":
        return metrics.regression(rows)
    if task_type == "binary":
        return metrics.binary(rows)
    if task_type == "multilabel":
        return metrics.multilabel(rows)
    if task_type != "multiclass":
        raise ValueError(f"Unknown task type: {task_type!r}")
    rows = cut_lineage(rows)
    parts = [metrics.accuracy(rows), metrics.macro_f1(rows), metrics.softmax_macro_auc(rows).withColumnRenamed("roc_auc", "multiclass_roc_auc")]
    # One row each.
    return reduce(lambda a, b: a.withColumns({c: b.select(c).scalar() for c in b.columns}), parts)


def report(results: Sequence[DataFrame]) -> DataFrame:
    """The rows of many evaluations (see `evaluate`) in one table, in the order of RESULT_KEYS; a metric that a task type
    lacks is null."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
    measured = [m for m in (*REGRESSION_METRICS, *CLASSIFICATION_METRICS) if m in rows.columns]
    return rows.select("dataset", "task", "task_type", "seed", *[f"{s}_rows" for s in _FITTED_ON], "baseline", "split", *measured)


def export_csv(results: DataFrame, path: str) -> None:
    results.orderBy(*RESULT_KEYS).write.mode("overwrite").option("header", True).csv(path)
