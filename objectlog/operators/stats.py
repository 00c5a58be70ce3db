"""Statistics of label tables and bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import cumulative, quantiles, spread
from ..session import cut_lineage

_KEYS = ["split", "time"]


def split_statistics(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and distinct entities per (split, time), per split, and overall.

    `labels` is stacked with a `split` column; totals have null `time`/`split`.
    Labels are first folded per entity tuple, so the distinct counts of each level
    see as little as possible.
    """
    folded = labels.groupBy(*_KEYS, *keys).agg(F.count(F.lit(1)).alias("_n"))
    tuples = F.count_distinct(F.struct(*keys)).alias("num_unique_entity_tuples")
    single = [F.count_distinct(k).alias(f"num_unique_{k}") for k in keys]
    return folded.rollup(*_KEYS).agg(F.sum("_n").alias("num_rows"), tuples, *single)


def binary_statistics(labels: DataFrame) -> DataFrame:
    return labels.rollup(*_KEYS).agg(
        F.count_if(F.col("target") == 1).alias("num_positives"),
        F.count_if(F.col("target") == 0).alias("num_negatives"),
    )


def _levels(labels: DataFrame) -> DataFrame:
    """Every label once per (split, time), once per split and once overall."""
    none = F.lit(None)
    levels = F.array(
        F.struct(F.col("split").alias("split"), F.col("time").alias("time")),
        F.struct(F.col("split").alias("split"), none.cast("timestamp_ntz").alias("time")),
        F.struct(none.cast("string").alias("split"), none.cast("timestamp_ntz").alias("time")),
    )
    return labels.select(F.inline(levels), "target")


def regression_statistics(labels: DataFrame) -> DataFrame:
    """min, max, mean and quartiles per (split, time), split, and overall."""
    n, value = F.col("_n"), F.col("_value")
    hist = labels.groupBy(*_KEYS, F.col("target").cast("double").alias("target")).agg(F.count(F.lit(1)).alias("_w"))
    levels = _levels(hist.select(*_KEYS, F.struct("target", "_w").alias("target")))
    found = quantiles(
        levels,
        _KEYS,
        F.col("target.target"),
        {"quantile_25_target": 0.25, "median_target": 0.5, "quantile_75_target": 0.75},
        weight=F.col("target._w"),
        extra=[
            F.min("_value").alias("min_target"),
            F.max("_value").alias("max_target"),
            (F.sum(value * n) / F.sum(n)).alias("mean_target"),
        ],
    )
    return found.drop("n")


def multiclass_statistics(labels: DataFrame) -> DataFrame:
    """Classes present, most and least frequent class (ties: the smallest)."""
    hist = labels.groupBy(*_KEYS, "target").agg(F.count(F.lit(1)).alias("_w"))
    counts = _levels(hist.select(*_KEYS, F.struct("target", "_w").alias("target"))).groupBy(
        *_KEYS, F.col("target.target").alias("class")
    ).agg(F.sum("target._w").alias("n"))
    return counts.groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("num_classes_present"),
        F.max_by("class", F.struct("n", -F.col("class"))).alias("majority_class_idx"),
        F.max("n").alias("majority_class_count"),
        F.min_by("class", F.struct("n", "class")).alias("minority_class_idx"),
        F.min("n").alias("minority_class_count"),
    )


def multilabel_statistics(labels: DataFrame) -> DataFrame:
    """Labels per entity, and the most and least frequent label (ties: the first)."""
    size = F.aggregate("target", F.lit(0.0), lambda acc, x: acc + x)
    rows = labels.rollup(*_KEYS).agg(
        F.round(F.avg(size), 4).alias("mean_num_classes_per_entity"),
        F.max(size).alias("max_num_classes_per_entity"),
        F.min(size).alias("min_num_classes_per_entity"),
    )
    each = labels.select(*_KEYS, F.posexplode("target").alias("pos", "on")).groupBy(*_KEYS, "pos").agg(
        F.sum("on").alias("_w")
    )
    counts = _levels(each.select(*_KEYS, F.struct("pos", "_w").alias("target"))).groupBy(
        *_KEYS, F.col("target.pos").alias("pos")
    ).agg(F.sum("target._w").alias("n"))
    classes = counts.groupBy(*_KEYS).agg(
        F.max_by("pos", F.struct("n", -F.col("pos"))).alias("max_num_class_idx"),
        F.max("n").alias("max_num_class_num"),
        F.min_by("pos", F.struct("n", "pos")).alias("min_num_class_idx"),
        F.min("n").alias("min_num_class_num"),
    )
    same = rows["split"].eqNullSafe(classes["split"]) & rows["time"].eqNullSafe(classes["time"])
    return rows.join(classes, same).select(rows["*"], *[c for c in classes.columns if c not in _KEYS])


def entity_overlap(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of test entities that also occur in train; null without test rows."""
    seen = train.select(*keys).distinct().withColumn("_seen", F.lit(1))
    tested = test.select(*keys).distinct().join(seen, list(keys), "left")
    return tested.agg((F.count("_seen") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("ratio_train_test_entity_overlap"))


# A binomial with a smaller mean is walked up from zero, this many steps at most (no mass is left beyond); above, the
# normal quantile with its skewness term is as good as exact.
_WALK_MEAN, _WALK_STEPS = 16, 64
_DIGITS = 12


def _uniform(seed: int, part: int, *columns: str) -> Column:
    """A number between 0 and 1 from an md5 of the columns: digits 12 * part + 1 and on. Any engine can repeat it."""
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))
    number = F.conv(F.substring(code, _DIGITS * part + 1, _DIGITS), 16, 10).cast("long")
    return (number + F.lit(0.5)) / F.lit(float(16**_DIGITS))


def _walked(m: Column, p: Column, u: Column) -> Column:
    """Least k at which the binomial distribution of m tries with chance p reaches u."""
    start = F.pow(1 - p, m)

    def step(at: Column, j: Column) -> Column:
        mass = at["mass"] * (m - j + 1) / j * (p / (1 - p))
        on = F.struct(j.cast("double").alias("k"), mass.alias("mass"), (at["upto"] + mass).alias("upto"))
        return F.when((at["upto"] >= u) | (j > m), at).otherwise(on)

    first = F.struct(F.lit(0.0).alias("k"), start.alias("mass"), start.alias("upto"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK_STEPS)), first, step)["k"]


def _binomial(m: Column, p: Column, u: Column, v: Column) -> Column:
    """A binomial number from two uniform ones."""
    low = F.least(p, 1 - p)
    middle = m * low
    normal = F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)
    skew = (normal * normal - 1) * (1 - 2 * low) / 6
    large = F.floor(middle + normal * F.sqrt(middle * (1 - low)) + skew + 0.5)
    k = F.least(m, F.greatest(F.lit(0), F.when(middle < _WALK_MEAN, _walked(m, low, u)).otherwise(large))).cast("long")
    return F.when(p > 0.5, m - k).otherwise(k)


def resampled_counts(hist: DataFrame, resamples: int, seed: int) -> DataFrame:
    """split, replicate, target, w: how often each value comes in a resample of as many labels as the split has.

    `hist` has split, target, n. A split's values, in order, are the leaves of a binary tree. In each replicate all
    draws stand at the root; at every node a binomial number of its draws goes to the left half, whose chance is its
    share of the node's labels. That is a multinomial draw, without a row for each draw: the work is distinct values
    times replicates. Nodes without draws are left at once.
    """
    ranked = cumulative(hist.withColumn("one", F.lit(1)), ["split"], "target", ["one"]).select(
        "split", "target", "n", (F.col("one_upto") - 1).alias("leaf"), F.col("one_all").alias("values")
    )
    ranked = cut_lineage(ranked)
    depth = max(0, ((ranked.agg(F.max("values")).first()[0] or 1) - 1).bit_length())
    sums = ranked.groupBy("split").agg(F.sum("n").alias("m"))
    draws = sums.select("split", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("replicate"), F.lit(0).cast("long").alias("node"), "m")
    for level in range(depth):
        half = F.shiftright("leaf", depth - level - 1)
        nodes = ranked.groupBy("split", F.shiftright(half, 1).alias("node")).agg(
            F.sum("n").alias("all"), F.sum(F.when(half % 2 == 0, F.col("n")).otherwise(0)).alias("left")
        )
        keys = ("split", "replicate", "level", "node")
        placed = draws.join(nodes, ["split", "node"]).withColumn("level", F.lit(level))
        share = F.col("left") / F.col("all")
        u, v = (_uniform(seed, part, *keys) for part in (0, 1))
        taken = placed.withColumn("taken", F.when(share == 1, F.col("m")).otherwise(_binomial(F.col("m"), share, u, v)))
        sides = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("taken").alias("m")),
            F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("m") - F.col("taken")).alias("m")),
        )
        draws = cut_lineage(taken.select("split", "replicate", F.inline(sides)).where("m > 0"))
    leaves = ranked.select("split", F.col("leaf").alias("node"), "target")
    return draws.join(leaves, ["split", "node"]).select("split", "replicate", "target", F.col("m").alias("w"))


def bootstrap(
    labels: DataFrame,
    keys: Sequence[str],
    *,
    classes: Sequence[int] | None = None,
    resamples: int = 500,
    alpha: float = 0.95,
    seed: int = 42,
    splits: Sequence[str] = ("train", "val", "test"),
) -> DataFrame:
    """split, statistic, point, lower, upper by resampling n of n labels of a split with replacement.

    Statistics: mean, std, q25, q50, q75, or the share of each class. Labels fold to a histogram first; each replicate
    draws counts of its values (see `resampled_counts`). No label is left out.
    """
    wanted = labels.where(F.col("split").isin(list(splits))).select("split", F.col("target").cast("double").alias("target"))
    hist = cut_lineage(wanted.where("target IS NOT NULL").groupBy("split", "target").agg(F.count(F.lit(1)).alias("n")))
    itself = hist.select("split", F.lit(0).alias("replicate"), "target", F.col("n").alias("w"))
    drawn = resampled_counts(hist, resamples, seed).unionByName(itself)
    n, value = F.col("_n"), F.col("_value")
    if classes is None:
        per = quantiles(
            drawn,
            ["split", "replicate"],
            F.col("target"),
            {"q25": 0.25, "q50": 0.5, "q75": 0.75},
            weight=F.col("w"),
            extra=[(F.sum(value * n) / F.sum(n)).alias("mean"), F.sqrt(spread() / F.sum(n)).alias("std")],
        )
        names = {name: name for name in ("mean", "std", "q25", "q50", "q75")}
    else:
        per = drawn.groupBy("split", "replicate").agg(
            *[(F.sum(F.when(F.col("target") == c, F.col("w")).otherwise(0)) / F.sum("w")).alias(f"c{c}") for c in classes]
        )
        names = {f"c{c}": f"class {c}" for c in classes}
    pairs = F.array(*[F.struct(F.lit(label).alias("statistic"), F.col(name).alias("value")) for name, label in names.items()])
    resampled = F.when(F.col("replicate") > 0, F.col("value"))
    edges = F.array(F.lit((1 - alpha) / 2), F.lit((1 + alpha) / 2))
    return (
        per.select("split", "replicate", F.inline(pairs))
        .groupBy("split", "statistic")
        .agg(
            F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("point"),
            F.percentile(resampled, edges).alias("ci"),
        )
        .select("split", "statistic", "point", F.get("ci", F.lit(0)).alias("lower"), F.get("ci", F.lit(1)).alias("upper"))
    )
