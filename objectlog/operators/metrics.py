"""Prediction metrics as single aggregations, per group.

Frames hold `target` and `pred` (a number, or an array of class scores) plus any
grouping columns. Undefined metrics are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import argmax, normalized, softmax
from ..functions.ordered import cumulative

EPS = 1e-15
# Computed probabilities that differ by rounding error only count as ties.
TIE_DIGITS = 12


def regression_columns(target: Column, pred: Column) -> list[Column]:
    error = target - pred
    squared = F.sum(error * error)
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(F.var_pop(target) > 0, 1 - squared / (F.var_pop(target) * F.count(target))).alias("r2"),
    ]


def regression(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    target, pred = F.col("target").cast("double"), F.col("pred").cast("double")
    return df.groupBy(*groups).agg(*regression_columns(target, pred))


def binary_threshold(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Accuracy and F1 of class 1; positive above 0.5."""
    hit, said = F.col("target") == 1, F.col("pred") > 0.5
    tp, wrong = F.count_if(hit & said), F.count_if(hit != said)
    return df.groupBy(*groups).agg(
        F.avg(F.when(hit == said, 1.0).otherwise(0.0)).alias("accuracy"),
        F.when(2 * tp + wrong > 0, 2 * tp / (2 * tp + wrong)).otherwise(F.lit(0.0)).alias("f1"),
    )


def ranking(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """ROC AUC (ties count half) and average precision, with `positives`, `negatives`.

    Rows are folded to one per distinct score before anything is ordered.
    """
    hist = df.groupBy(*groups, F.col("pred").cast("double").alias("_score")).agg(
        F.count_if(F.col("target") == 1).alias("_p"), F.count_if(F.col("target") != 1).alias("_q")
    )
    run = cumulative(hist, groups, "_score", ["_p", "_q"])
    above_p, above_q = F.col("_p_all") - F.col("_p_upto"), F.col("_q_all") - F.col("_q_upto")
    won = F.col("_q") * (above_p + F.col("_p") / 2)
    reached, taken = above_p + F.col("_p"), above_p + F.col("_p") + above_q + F.col("_q")
    sums = run.groupBy(*groups).agg(
        F.sum("_p").alias("positives"),
        F.sum("_q").alias("negatives"),
        F.sum(won).alias("_won"),
        F.sum(F.col("_p") * reached / taken).alias("_gain"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return sums.select(
        *groups,
        "positives",
        "negatives",
        F.when(both, F.col("_won") / F.col("positives") / F.col("negatives")).alias("roc_auc"),
        F.when(F.col("positives") > 0, F.col("_gain") / F.col("positives")).alias("auprc"),
    )


def binary(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """accuracy, f1, auprc, roc_auc."""
    named = list(groups) or ["_all"]
    df = df if groups else df.withColumn("_all", F.lit(0))
    ranked = ranking(df, named).select(*named, "auprc", "roc_auc")
    return binary_threshold(df, named).join(ranked, named).drop("_all")


def _tied(scores: Column) -> Column:
    return F.transform(scores, lambda x: F.round(x, TIE_DIGITS))


def per_class(df: DataFrame, scores: Column, groups: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest ranking metrics per class position."""
    long = df.select(*groups, F.col("target").alias("_label"), F.posexplode(scores).alias("class", "pred"))
    long = long.withColumn("target", (F.col("_label") == F.col("class")).cast("int"))
    return ranking(long, [*groups, "class"])


def weighted_ovr_auc(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest AUC weighted by positives; degenerate classes are left out."""
    auc = per_class(df, F.col("pred"), groups).where("roc_auc IS NOT NULL")
    weighted = F.sum(F.col("roc_auc") * F.col("positives")) / F.sum("positives")
    return auc.groupBy(*groups).agg(weighted.alias("multiclass_roc_auc"))


def softmax_macro_auc(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Macro one-vs-rest AUC after a softmax.

    Two classes present: the AUC of the larger label's column. Fewer: null. More:
    null unless every class can be ranked.
    """
    auc = per_class(df, _tied(softmax(F.col("pred"))), groups)
    present = F.count_if(F.col("positives") > 0)
    larger = F.max_by("roc_auc", F.when(F.col("positives") > 0, F.col("class")))
    return auc.groupBy(*groups).agg(
        F.when(present == 2, larger)
        .when((present > 2) & (F.count("roc_auc") == F.count(F.lit(1))), F.avg("roc_auc"))
        .alias("roc_auc")
    )


def observed_macro_auc(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Macro one-vs-rest AUC over the classes that occur in a group's targets.

    Scores are restricted to those classes and rescaled to sum 1 (all-zero rows
    become uniform). With two classes the larger one is ranked; fewer give null.
    """
    named = list(groups) or ["_all"]
    df = df if groups else df.withColumn("_all", F.lit(0))
    df = df.withColumn("target", F.col("target").cast("int"))
    present = df.groupBy(*named).agg(F.sort_array(F.collect_set("target")).alias("_kept"))
    joined = df.join(present, named)
    scores = normalized(F.transform("_kept", lambda c: F.coalesce(F.get("pred", c), F.lit(0.0))))
    relabelled = joined.withColumn("target", (F.array_position("_kept", F.col("target")) - 1).cast("int"))
    auc = per_class(relabelled, _tied(scores), named)
    n = F.count(F.lit(1))
    value = F.when(n == 2, F.max_by("roc_auc", "class")).when(n > 2, F.avg("roc_auc"))
    return auc.groupBy(*named).agg(value.alias("roc_auc")).drop("_all")


def macro_f1(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Macro F1 of the highest-scored class over labels seen or predicted."""
    said = argmax(F.col("pred"))
    pairs = df.groupBy(*groups, F.col("target").cast("int").alias("t"), said.alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    roles = F.array(
        F.struct(F.col("t").alias("class"), F.when(F.col("t") == F.col("p"), 2 * F.col("n")).otherwise(F.lit(0)).alias("hit"), F.col("n").alias("used")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("hit"), F.col("n").alias("used")),
    )
    by_class = pairs.select(*groups, F.inline(roles)).groupBy(*groups, "class").agg(
        (F.sum("hit") / F.sum("used")).alias("f1")
    )
    return by_class.groupBy(*groups).agg(F.avg("f1").alias("multiclass_f1"))


def accuracy(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    right = argmax(F.col("pred")) == F.col("target")
    return df.groupBy(*groups).agg(F.avg(F.when(right, 1.0).otherwise(0.0)).alias("accuracy"))


def log_loss(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Cross entropy of the softmax probabilities."""
    p = F.get(softmax(F.col("pred")), F.col("target").cast("int"))
    clipped = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return df.groupBy(*groups).agg(F.avg(-F.ln(clipped)).alias("log_loss"))


def multilabel(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Macro F1 and exact-match accuracy at 0.5 of array targets and predictions."""
    pairs = F.arrays_zip(
        F.transform("target", lambda x: x > 0.5).alias("t"), F.transform("pred", lambda x: x > 0.5).alias("p")
    )
    df = df.select(*groups, pairs.alias("pairs"))
    named = list(groups) or ["_all"]
    df = df if groups else df.withColumn("_all", F.lit(0))
    exact = df.groupBy(*named).agg(
        F.avg(F.when(F.forall("pairs", lambda x: x["t"] == x["p"]), 1.0).otherwise(0.0)).alias("multilabel_accuracy")
    )
    flat = df.select(*named, F.posexplode("pairs").alias("class", "pair"))
    hit, said = F.col("pair.t"), F.col("pair.p")
    tp, wrong = F.count_if(hit & said), F.count_if(hit != said)
    per = flat.groupBy(*named, "class").agg(
        F.when(2 * tp + wrong > 0, 2 * tp / (2 * tp + wrong)).otherwise(F.lit(0.0)).alias("f1")
    )
    return exact.join(per.groupBy(*named).agg(F.avg("f1").alias("multilabel_f1_macro")), named).drop("_all")


def misaligned(predictions: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of predictions without a label and labels without a prediction."""
    left = predictions.select(*keys, F.lit(1).alias("_p"))
    right = labels.select(*keys, F.lit(1).alias("_l"))
    both = left.join(right, list(keys), "full_outer")
    return both.agg(
        F.count_if(F.col("_l").isNull()).alias("without_label"),
        F.count_if(F.col("_p").isNull()).alias("without_prediction"),
    )


def class_weights(labels: DataFrame, num_classes: int) -> DataFrame:
    """Inverse class frequencies that sum to 1; an absent class counts once."""
    counts = labels.groupBy(F.col("target").cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    spine = labels.sparkSession.range(num_classes).select(F.col("id").cast("int").alias("class"))
    raw = spine.join(counts, "class", "left").withColumn("_w", 1.0 / F.coalesce("n", F.lit(1)))
    total = raw.agg(F.sum("_w")).scalar()
    return raw.select("class", (F.col("_w") / total).alias("weight"))
