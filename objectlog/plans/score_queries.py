"""Label statistics, baselines and metrics on the sample tables."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import argmax, one_hot, postprocess, to_micros, uniform
from ..grid import Grid
from ..operators import baselines, labels, metrics, observe, stats
from ..session import shared_folder
from ..sources import store
from ..sources.fixtures import CLICKS_TEST, CLICKS_VAL, DAY, clicks, table
from .jobs import SAMPLE_JOBS, job
from .label_queries import CLICK_SPLITS, TYPES, click_splits
from .registry import query, rounded
from .views import on_clicks, recursive

KEYS = ("object_id",)
_LEVELS = "GROUP BY GROUPING SETS ((split, time), (split), ())"


def class_splits(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Labels of all splits: the next event within a day after a view, as a class."""
    return job("user_next_event_1d").splits(clicks(spark, folder), CLICKS_VAL, CLICKS_TEST)


def binary_splits(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        split: df.withColumn("target", (F.col("target") > 0).cast("int"))
        for split, df in click_splits(spark, folder).items()
    }


def multilabel_splits(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Which event types follow within a day, for active users."""
    log = clicks(spark, folder)
    low, high = observe.event_bounds(log)
    grids = observe.split_grids(low, high, CLICKS_VAL, CLICKS_TEST, DAY)

    def build(part, grid: Grid) -> DataFrame:
        counts = labels.window_event_counts(part, "user", grid, DAY, TYPES)
        return labels.counts_to_target(counts, TYPES, "multilabel")

    return labels.split_labels(log, grids, CLICKS_TEST, build)


CLASS_LABELS = CLICK_SPLITS + """
, following AS (
  SELECT c.split, c.object_id, c.t, arg_min(k.type, {'a': k.time, 'b': k.event_id}) AS type
  FROM cand c JOIN c_link k ON k.object_id = c.object_id AND k.time > c.t AND k.time <= c.t + INTERVAL 1 DAY
    AND (c.split = 'test' OR k.time <= TIMESTAMP '2024-01-25') GROUP BY ALL),
cls AS (
  SELECT split, object_id, t AS time, CAST(CASE type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS INTEGER) AS target
  FROM following WHERE type IN ('view', 'click', 'purchase'))
"""
BINARY_LABELS = CLICK_SPLITS + ", bin AS (SELECT split, object_id, time, CAST(target > 0 AS INTEGER) AS target FROM lab)\n"
_FLAGS = ", ".join(f"MAX(CASE WHEN k.type = '{t}' THEN 1 ELSE 0 END) AS f{i}" for i, t in enumerate(TYPES))
MULTI_LABELS = CLICK_SPLITS + f"""
, act AS (
  SELECT DISTINCT g.split, k.object_id, g.t FROM s_grid g JOIN c_link k ON k.time > g.t - INTERVAL 1 DAY AND k.time <= g.t AND k.object_type = 'user'
  WHERE k.object_id IN (SELECT object_id FROM c_object WHERE time <= TIMESTAMP '2024-01-25')),
multi AS (
  SELECT a.split, a.object_id, a.t AS time, {_FLAGS} FROM act a LEFT JOIN c_link k
  ON k.object_id = a.object_id AND k.time > a.t AND k.time <= a.t + INTERVAL 1 DAY GROUP BY ALL),
wide AS (SELECT split, time, object_id, unnest([0, 1, 2, 3, 4]) AS pos, unnest([f0, f1, f2, f3, f4]) AS flag FROM multi)
"""


# -- jobs ------------------------------------------------------------------


@query(
    "label_jobs_single",
    on_clicks(BINARY_LABELS.replace(", bin AS", CLASS_LABELS.removeprefix(CLICK_SPLITS) + ", bin AS") + """
, firsts AS (
  SELECT c.split, c.object_id, c.t, arg_min(k.event_id, {'a': k.time, 'b': k.event_id}) AS event_id, COUNT(DISTINCT i.object_id) AS items
  FROM cand c JOIN c_link k ON k.object_id = c.object_id AND k.type = 'purchase' AND k.time > c.t AND k.time <= c.t + INTERVAL 1 DAY
  JOIN c_link i ON i.event_id = k.event_id AND i.object_type = 'item' GROUP BY ALL)
SELECT 'user_purchase_count_1d' AS job, split, object_id, time, target FROM lab
UNION ALL SELECT 'user_next_event_1d', split, object_id, time, CAST(target AS DOUBLE) FROM cls
UNION ALL SELECT 'user_purchase_1d', split, object_id, time, CAST(target AS DOUBLE) FROM bin
UNION ALL SELECT 'user_purchase_value_1d', f.split, f.object_id, f.t, ROUND(p.value, 6) FROM firsts f JOIN c_purchase p ON p.event_id = f.event_id
UNION ALL SELECT 'user_item_count_1d', c.split, c.object_id, c.t, CAST(COALESCE(f.items, 0) AS DOUBLE)
  FROM cand c LEFT JOIN firsts f ON f.split = c.split AND f.object_id = c.object_id AND f.t = c.t
"""),
)
def _(spark, folder):
    log = clicks(spark, folder)
    parts = []
    for one in SAMPLE_JOBS:
        if one.keys == observe.SINGLE:
            stacked = labels.stack_splits(one.splits(log, CLICKS_VAL, CLICKS_TEST))
            parts.append(
                stacked.select(F.lit(one.name).alias("job"), "split", "object_id", "time", F.col("target").cast("double").alias("target"))
            )
    return reduce(DataFrame.unionByName, parts)


@query(
    "label_jobs_pair",
    on_clicks(CLICK_SPLITS + """
, pair AS (
  SELECT a.object_id AS s, b.object_id AS d, a.event_id, a.type, a.time FROM c_link a JOIN c_link b
  ON b.event_id = a.event_id AND a.object_type = 'user' AND b.object_type = 'item'),
known AS (SELECT object_id FROM c_object WHERE time <= TIMESTAMP '2024-01-25'),
now AS (
  SELECT split, s, d, t FROM (
    SELECT g.split, p.s, p.d, g.t, arg_max(p.type, {'a': p.time, 'b': p.event_id}) AS state, MAX(p.time) AS last_at
    FROM s_grid g JOIN pair p ON p.time <= g.t GROUP BY ALL)
  WHERE state = 'view' AND last_at > t - INTERVAL 7 DAY AND s IN (SELECT object_id FROM known) AND d IN (SELECT object_id FROM known)),
n AS (
  SELECT w.split, w.s, w.d, w.t, COUNT(p.event_id) AS n FROM now w LEFT JOIN pair p
  ON p.s = w.s AND p.d = w.d AND p.type = 'purchase' AND p.time > w.t AND p.time <= w.t + INTERVAL 1 DAY GROUP BY ALL)
SELECT 'user_item_purchase_1d' AS job, split, s AS object_id_src, d AS object_id_dst, t AS time, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS target FROM n
UNION ALL SELECT 'user_item_purchase_count_1d', split, s, d, t, CAST(n AS DOUBLE) FROM n
"""),
)
def _(spark, folder):
    log = clicks(spark, folder)
    parts = []
    for one in SAMPLE_JOBS:
        if one.keys == observe.PAIR:
            stacked = labels.stack_splits(one.splits(log, CLICKS_VAL, CLICKS_TEST))
            parts.append(
                stacked.select(F.lit(one.name).alias("job"), "split", *observe.PAIR, "time", F.col("target").cast("double").alias("target"))
            )
    return reduce(DataFrame.unionByName, parts)


# -- statistics ------------------------------------------------------------


@query(
    "label_statistics",
    on_clicks(CLICK_SPLITS + f"""
SELECT split, time, COUNT(*) AS num_rows, COUNT(DISTINCT object_id) AS num_unique_entity_tuples, COUNT(DISTINCT object_id) AS num_unique_object_id
FROM lab {_LEVELS}
"""),
)
def _(spark, folder):
    return stats.split_statistics(labels.stack_splits(click_splits(spark, folder)), KEYS)


@query(
    "label_statistics_binary",
    on_clicks(BINARY_LABELS + f"""
SELECT split, time, COUNT(*) FILTER (WHERE target = 1) AS num_positives, COUNT(*) FILTER (WHERE target = 0) AS num_negatives FROM bin {_LEVELS}
"""),
)
def _(spark, folder):
    return stats.binary_statistics(labels.stack_splits(binary_splits(spark, folder)))


@query(
    "label_statistics_regression",
    on_clicks(CLICK_SPLITS + f"""
SELECT split, time, MIN(target) AS min_target, MAX(target) AS max_target, ROUND(AVG(target), 6) AS mean_target,
  ROUND(quantile_cont(target, 0.25), 6) AS quantile_25_target, ROUND(quantile_cont(target, 0.5), 6) AS median_target,
  ROUND(quantile_cont(target, 0.75), 6) AS quantile_75_target
FROM lab {_LEVELS}
"""),
)
def _(spark, folder):
    return stats.regression_statistics(labels.stack_splits(click_splits(spark, folder)))


@query(
    "label_statistics_multiclass",
    on_clicks(CLASS_LABELS + """
, lv AS (
  SELECT split, time, target FROM cls UNION ALL SELECT split, NULL, target FROM cls UNION ALL SELECT NULL, NULL, target FROM cls),
n AS (SELECT split, time, target, COUNT(*) AS n FROM lv GROUP BY ALL)
SELECT split, time, COUNT(*) AS num_classes_present, arg_max(target, {'n': n, 'c': -target}) AS majority_class_idx,
  MAX(n) AS majority_class_count, arg_min(target, {'n': n, 'c': target}) AS minority_class_idx, MIN(n) AS minority_class_count
FROM n GROUP BY split, time
"""),
)
def _(spark, folder):
    return stats.multiclass_statistics(labels.stack_splits(class_splits(spark, folder)))


@query(
    "label_statistics_multilabel",
    on_clicks(MULTI_LABELS + """
, lv AS (
  SELECT split, time, object_id, time AS own, pos, flag FROM wide
  UNION ALL SELECT split, NULL, object_id, time, pos, flag FROM wide UNION ALL SELECT NULL, NULL, object_id, time, pos, flag FROM wide),
per AS (SELECT split, time, object_id, own, SUM(flag) AS k FROM lv GROUP BY ALL),
a AS (
  SELECT split, time, ROUND(AVG(k), 4) AS mean_num_classes_per_entity, CAST(MAX(k) AS DOUBLE) AS max_num_classes_per_entity,
    CAST(MIN(k) AS DOUBLE) AS min_num_classes_per_entity FROM per GROUP BY split, time),
n AS (SELECT split, time, pos, SUM(flag) AS n FROM lv GROUP BY ALL),
b AS (
  SELECT split, time, arg_max(pos, {'n': n, 'c': -pos}) AS max_num_class_idx, CAST(MAX(n) AS DOUBLE) AS max_num_class_num,
    arg_min(pos, {'n': n, 'c': pos}) AS min_num_class_idx, CAST(MIN(n) AS DOUBLE) AS min_num_class_num FROM n GROUP BY split, time)
SELECT a.*, b.max_num_class_idx, b.max_num_class_num, b.min_num_class_idx, b.min_num_class_num
FROM a JOIN b ON a.split IS NOT DISTINCT FROM b.split AND a.time IS NOT DISTINCT FROM b.time
"""),
)
def _(spark, folder):
    return stats.multilabel_statistics(labels.stack_splits(multilabel_splits(spark, folder)))


@query(
    "entity_overlap",
    on_clicks(CLICK_SPLITS + """
, tr AS (SELECT DISTINCT object_id FROM lab WHERE split = 'train'), te AS (SELECT DISTINCT object_id FROM lab WHERE split = 'test')
SELECT ROUND((SELECT COUNT(*) FROM te WHERE object_id IN (SELECT object_id FROM tr)) / (SELECT COUNT(*) FROM te), 6) AS ratio_train_test_entity_overlap
"""),
)
def _(spark, folder):
    splits = click_splits(spark, folder)
    return stats.entity_overlap(splits["train"], splits["test"], KEYS)


# The binary tree of conditional binomials, level by level; `binomial` takes the draws m, the chance p, and two numbers u, v.
_WALK = (
    "list_reduce(list_transform(range(1, 65), lambda j: [j::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]), lambda a, j: CASE WHEN a[3] >= u OR j[1] > m THEN a "
    "ELSE [j[1], a[2] * (m - j[1] + 1) / j[1] * (low / (1 - low)), a[3] + a[2] * (m - j[1] + 1) / j[1] * (low / (1 - low))] END, "
    "[0.0::DOUBLE, pow(1 - low, m), pow(1 - low, m)])[1]"
)
_LARGE = (
    "floor(m * low + z * sqrt(m * low * (1 - low)) + (z * z - 1) * (1 - 2 * low) / 6 + 0.5)"
)
_DRAWS = """
, hist AS (
  SELECT split, CAST(target AS DOUBLE) AS target, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY split ORDER BY CAST(target AS DOUBLE)) - 1 AS leaf
  FROM {t} WHERE target IS NOT NULL GROUP BY split, CAST(target AS DOUBLE)),
depth AS (SELECT CAST(CEIL(LOG2(MAX(leaf) + 1)) AS BIGINT) AS depth FROM hist),
nodes AS (
  SELECT split, level, leaf // (1::BIGINT << (depth - level)) AS node, SUM(n) AS total,
    SUM(CASE WHEN (leaf // (1::BIGINT << (depth - level - 1))) % 2 = 0 THEN n ELSE 0 END) AS lefts
  FROM hist, depth, (SELECT unnest(range(0, 40)) AS level) WHERE level < depth GROUP BY ALL),
draws AS (
  SELECT split, r AS replicate, 0::BIGINT AS level, 0::BIGINT AS node, m
  FROM (SELECT split, SUM(n)::BIGINT AS m FROM hist GROUP BY 1), (SELECT unnest(range(1, 501)) AS r)
  UNION ALL
  SELECT split, replicate, level + 1, node * 2 + side, CASE side WHEN 0 THEN k ELSE m - k END FROM (
    SELECT *, unnest([0, 1]) AS side FROM (
      SELECT *, CASE WHEN share = 1 THEN m WHEN share > 0.5 THEN m - b ELSE b END AS k FROM (
        SELECT *, least(m, greatest(0, CASE WHEN m * low < 16 THEN {walk} ELSE {large} END))::BIGINT AS b FROM (
          SELECT *, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z FROM (
            SELECT d.split, d.replicate, d.level, d.node, d.m, x.lefts::DOUBLE / x.total AS share, least(x.lefts::DOUBLE / x.total, 1 - x.lefts::DOUBLE / x.total) AS low,
              (CAST('0x' || substr(code, 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
              (CAST('0x' || substr(code, 13, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS v
            FROM (SELECT *, md5('42|' || split || '|' || replicate || '|' || level || '|' || node) AS code FROM draws) d
            JOIN nodes x ON x.split = d.split AND x.level = d.level AND x.node = d.node))))) WHERE CASE side WHEN 0 THEN k ELSE m - k END > 0),
rep AS (
  SELECT d.split, d.replicate, h.target, d.m AS w FROM draws d, depth JOIN hist h ON h.split = d.split AND h.leaf = d.node WHERE d.level = depth.depth
  UNION ALL SELECT split, 0, target, n FROM hist),
val AS (SELECT split, replicate, target FROM (SELECT *, unnest(range(0, w)) AS i FROM rep)),
"""


def _draws(table: str) -> str:
    return _DRAWS.format(t=table, walk=_WALK, large=_LARGE)


_INTERVALS = """
SELECT split, statistic, ROUND(MAX(value) FILTER (replicate = 0), 6) AS point,
  ROUND(quantile_cont(value, 0.025) FILTER (replicate > 0), 6) AS lower,
  ROUND(quantile_cont(value, 0.975) FILTER (replicate > 0), 6) AS upper
FROM stat GROUP BY ALL
"""


@query(
    "bootstrap_regression",
    recursive(CLICK_SPLITS + _draws("lab") + """
wide AS (
  SELECT split, replicate, AVG(target) AS mean, STDDEV_POP(target) AS std, quantile_cont(target, 0.25) AS q25,
    quantile_cont(target, 0.5) AS q50, quantile_cont(target, 0.75) AS q75 FROM val GROUP BY ALL),
stat AS (
  SELECT split, replicate, unnest(['mean', 'std', 'q25', 'q50', 'q75']) AS statistic,
    unnest([mean, std, q25, q50, q75]) AS value FROM wide)
""" + _INTERVALS),
)
def _(spark, folder):
    return stats.bootstrap(labels.stack_splits(click_splits(spark, folder)), KEYS)


@query(
    "bootstrap_classes",
    recursive(CLASS_LABELS + _draws("cls") + """
stat AS (
  SELECT split, replicate, 'class ' || c AS statistic, AVG(CASE WHEN target = c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS value
  FROM val, (SELECT unnest([0, 1, 2]) AS c) GROUP BY ALL)
""" + _INTERVALS),
)
def _(spark, folder):
    return stats.bootstrap(labels.stack_splits(class_splits(spark, folder)), KEYS, classes=(0, 1, 2))


# -- baselines -------------------------------------------------------------

def _random(seed: str, *more: str) -> str:
    """The random baseline's number of a row, as `functions.columns.uniform` makes it."""
    parts = " || '|' || ".join([seed, *more, "epoch_us(time)", "object_id"])
    return f"(CAST('0x' || substr(md5({parts}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def _seeds(seeds: tuple[int, ...]) -> str:
    return f"(SELECT unnest({list(seeds)}) AS s)"


_FITS = """
, fitrow AS (
  SELECT 'train' AS fit, {t}.* FROM {t} WHERE split = 'train' UNION ALL SELECT 'trainval', {t}.* FROM {t} WHERE split IN ('train', 'val')),
use AS (SELECT *, CASE WHEN split = 'test' THEN 'trainval' ELSE 'train' END AS fit FROM {t}),
g AS (SELECT fit, AVG(target) AS mean, quantile_cont(target::DOUBLE, 0.5) AS median FROM fitrow GROUP BY 1),
gm AS (
  SELECT fit, arg_max(target, {{'n': n, 'c': -target}}) AS majority FROM (SELECT fit, target, COUNT(*) AS n FROM fitrow GROUP BY ALL) GROUP BY 1),
e AS (SELECT fit, object_id, AVG(target) AS mean, quantile_cont(target::DOUBLE, 0.5) AS median FROM fitrow GROUP BY 1, 2),
em AS (
  SELECT fit, object_id, arg_max(target, {{'n': n, 'c': -target}}) AS majority
  FROM (SELECT fit, object_id, target, COUNT(*) AS n FROM fitrow GROUP BY ALL) GROUP BY 1, 2),
known AS (
  SELECT u.split, u.object_id, u.time, CAST(u.target AS DOUBLE) AS target, g.mean, g.median, CAST(gm.majority AS DOUBLE) AS majority,
    COALESCE(e.mean, g.mean) AS entity_mean, COALESCE(e.median, g.median) AS entity_median,
    CAST(COALESCE(em.majority, gm.majority) AS DOUBLE) AS entity_majority
  FROM use u JOIN g ON g.fit = u.fit JOIN gm ON gm.fit = u.fit
  LEFT JOIN e ON e.fit = u.fit AND e.object_id = u.object_id LEFT JOIN em ON em.fit = u.fit AND em.object_id = u.object_id)
"""
_REGRESSION_PRED = _FITS.format(t="lab") + """
, pred AS (
  SELECT split, target, unnest(['global_zero', 'global_mean', 'global_median', 'entity_mean', 'entity_median']) AS baseline,
    unnest([0.0, mean, median, entity_mean, entity_median]) AS pred FROM known)
"""


@query("combine_train_val", on_clicks(CLICK_SPLITS + "SELECT object_id, time, target FROM lab WHERE split IN ('train', 'val')"))
def _(spark, folder):
    splits = click_splits(spark, folder)
    return baselines.combine(splits["train"], splits["val"])


@query(
    "baseline_predictions",
    on_clicks(CLICK_SPLITS + _REGRESSION_PRED + "SELECT baseline, split, target, ROUND(pred, 6) AS pred FROM pred"),
)
def _(spark, folder):
    return baselines.predict(labels.stack_splits(click_splits(spark, folder)), KEYS, "regression").drop("seed")


_DRAWN = ", ".join(_random("'42'", f"'{k}'") for k in range(3))
_CLASS_PRED = _FITS.format(t="cls") + f"""
, said AS (
  SELECT split, target, unnest(['majority', 'entity_majority_multiclass']) AS baseline, unnest([majority, entity_majority]) AS c FROM known),
drawn AS (SELECT split, target, [{_DRAWN}] AS r FROM known),
pred AS (
  SELECT split, target, baseline, [CASE WHEN c = 0 THEN 1.0 ELSE 0.0 END, CASE WHEN c = 1 THEN 1.0 ELSE 0.0 END, CASE WHEN c = 2 THEN 1.0 ELSE 0.0 END]::DOUBLE[] AS p FROM said
  UNION ALL SELECT split, target, 'random', [r[1] / (r[1] + r[2] + r[3]), r[2] / (r[1] + r[2] + r[3]), r[3] / (r[1] + r[2] + r[3])] FROM drawn)
"""


@query(
    "baseline_majority_classes",
    on_clicks(CLASS_LABELS + _CLASS_PRED + "SELECT baseline, split, CAST(target AS INTEGER) AS target, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred FROM pred"),
)
def _(spark, folder):
    """The class that each baseline, the random one too, holds most likely."""
    stacked = labels.stack_splits(class_splits(spark, folder))
    pred = baselines.predict(stacked, KEYS, "multiclass", num_classes=baselines.class_count(stacked, 3))
    return pred.select("baseline", "split", "target", argmax(F.col("pred")).alias("pred"))


@query(
    "baseline_random",
    on_clicks(CLASS_LABELS + _CLASS_PRED + """
SELECT split, CAST(target AS INTEGER) AS target, ROUND(p[1], 6) AS p0, ROUND(p[2], 6) AS p1, ROUND(p[3], 6) AS p2 FROM pred WHERE baseline = 'random'
"""),
)
def _(spark, folder):
    stacked = labels.stack_splits(class_splits(spark, folder))
    pred = baselines.predict(stacked, KEYS, "multiclass", num_classes=3).where("baseline = 'random'")
    return pred.select("split", "target", *[F.get("pred", F.lit(k)).alias(f"p{k}") for k in range(3)])


def _sizes(name: str) -> str:
    return ", ".join(f"(SELECT COUNT(*) FROM {name} WHERE split = '{s}') AS {s}_rows" for s in ("train", "val", "test"))


_REGRESSION_RESULT = CLICK_SPLITS + _REGRESSION_PRED + f"""
, result AS (
  SELECT 'clicks' AS dataset, 'user_purchase_count_1d' AS task, 'regression' AS task_type, 42 AS seed, {_sizes('lab')},
    p.baseline, p.split, ROUND(AVG(ABS(p.target - p.pred)), 6) AS mae, ROUND(AVG(POW(p.target - p.pred, 2)), 6) AS mse,
    ROUND(SQRT(AVG(POW(p.target - p.pred, 2))), 6) AS rmse,
    ROUND(1 - SUM(POW(p.target - p.pred, 2)) / SUM(POW(p.target - m.m, 2)), 6) AS r2
  FROM pred p JOIN (SELECT split, AVG(target) AS m FROM lab GROUP BY 1) m ON m.split = p.split GROUP BY p.baseline, p.split)
"""


def evaluated(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return job(name).evaluate(clicks(spark, folder), CLICKS_VAL, CLICKS_TEST)


def regression_results(spark: SparkSession, folder: str) -> DataFrame:
    return evaluated(spark, folder, "user_purchase_count_1d")


@query("evaluate_regression", on_clicks(_REGRESSION_RESULT + "SELECT * FROM result"))
def _(spark, folder):
    return regression_results(spark, folder)


@query("export_results", on_clicks(_REGRESSION_RESULT + "SELECT * FROM result"))
def _(spark, folder):
    path = f"{shared_folder(spark)}/results-{uuid4().hex}"
    results = rounded(regression_results(spark, folder))
    baselines.export_csv(results, path)
    return spark.read.schema(results.schema).option("header", True).csv(path)


def _auc(groups: str, source: str) -> str:
    """Pairwise-free AUC and average precision of (groups, target 0/1, pred)."""
    return f"""
, hist AS (SELECT {groups}, pred, COUNT(*) FILTER (WHERE target = 1) AS p, COUNT(*) FILTER (WHERE target <> 1) AS q FROM {source} GROUP BY ALL),
run AS (
  SELECT *, SUM(p) OVER w - p AS above, SUM(p) OVER w AS tp, SUM(p + q) OVER w AS taken, SUM(p) OVER (PARTITION BY {groups}) AS np,
    SUM(q) OVER (PARTITION BY {groups}) AS nq
  FROM hist WINDOW w AS (PARTITION BY {groups} ORDER BY pred DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
auc AS (
  SELECT {groups}, CASE WHEN ANY_VALUE(np) > 0 AND ANY_VALUE(nq) > 0 THEN SUM(q * (above + p / 2)) / ANY_VALUE(np) / ANY_VALUE(nq) END AS roc_auc,
    CASE WHEN ANY_VALUE(np) > 0 THEN SUM(p * tp / taken) / ANY_VALUE(np) END AS auprc, ANY_VALUE(np) AS np
  FROM run GROUP BY {groups})
"""


_HARD = """
SELECT {g}, AVG(CASE WHEN (pred > 0.5) = (target = 1) THEN 1.0 ELSE 0.0 END) AS accuracy,
  COALESCE(2 * COUNT(*) FILTER (WHERE pred > 0.5 AND target = 1) /
    NULLIF(COUNT(*) FILTER (WHERE pred > 0.5) + COUNT(*) FILTER (WHERE target = 1), 0), 0.0) AS f1 FROM {s} GROUP BY {g}
"""


def _binary_result(seeds: tuple[int, ...]) -> str:
    return BINARY_LABELS + _FITS.format(t="bin") + f"""
, pred AS (
  SELECT split, target, unnest(['majority', 'entity_mean', 'entity_median']) AS baseline, 0 AS draw, unnest([majority, entity_mean, entity_median]) AS pred FROM known
  UNION ALL SELECT split, target, 'random', s, {_random("s")} FROM known, {_seeds(seeds)})
""" + _auc("baseline, draw, split", "pred") + ", hard AS (" + _HARD.format(g="baseline, draw, split", s="pred") + f""")
, result AS (
  SELECT 'clicks' AS dataset, 'user_purchase_1d' AS task, 'binary' AS task_type, s AS seed, {_sizes('bin')}, h.baseline, h.split,
    ROUND(h.accuracy, 6) AS accuracy, ROUND(h.f1, 6) AS f1, ROUND(a.auprc, 6) AS auprc, ROUND(a.roc_auc, 6) AS roc_auc,
    CAST(NULL AS DOUBLE) AS multiclass_f1, CAST(NULL AS DOUBLE) AS multiclass_roc_auc
  FROM hard h JOIN auc a ON a.baseline = h.baseline AND a.split = h.split AND a.draw = h.draw
  JOIN {_seeds(seeds)} ON h.baseline <> 'random' OR h.draw = s)
"""


@query("evaluate_binary", on_clicks(_binary_result((42,)) + "SELECT * FROM result"))
def _(spark, folder):
    return evaluated(spark, folder, "user_purchase_1d")


_OVR = """
, three AS (SELECT baseline, split, target AS label, p, unnest([0, 1, 2]) AS class FROM pred),
one AS (
  SELECT baseline, split, class, CASE WHEN label = class THEN 1 ELSE 0 END AS target, ROUND(p[class + 1], 12) AS pred,
    CASE WHEN list_position(p, list_max(p)) = class + 1 THEN 1.0 ELSE 0.0 END AS hit FROM three)
"""


@query(
    "evaluate_multiclass",
    on_clicks(CLASS_LABELS + _CLASS_PRED + _OVR + _auc("baseline, split, class", "one") + f"""
, f AS (
  SELECT baseline, split, class, 2 * SUM(target * hit) / SUM(target + hit) AS f1 FROM one GROUP BY ALL HAVING SUM(target + hit) > 0),
ff AS (SELECT baseline, split, AVG(f1) AS f1 FROM f GROUP BY ALL),
acc AS (SELECT baseline, split, AVG(CASE WHEN target + 1 = list_position(p, list_max(p)) THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred GROUP BY ALL),
w AS (
  SELECT baseline, split, SUM(roc_auc * np) FILTER (WHERE roc_auc IS NOT NULL) / SUM(np) FILTER (WHERE roc_auc IS NOT NULL) AS weighted, AVG(roc_auc) AS macro
  FROM auc GROUP BY ALL)
SELECT 'clicks' AS dataset, 'user_next_event_1d' AS task, 'multiclass' AS task_type, 42 AS seed, {_sizes('cls')}, acc.baseline, acc.split,
  ROUND(accuracy, 6) AS accuracy, CAST(NULL AS DOUBLE) AS f1, CAST(NULL AS DOUBLE) AS auprc, ROUND(w.macro, 6) AS roc_auc,
  ROUND(ff.f1, 6) AS multiclass_f1, ROUND(w.weighted, 6) AS multiclass_roc_auc
FROM acc JOIN ff ON ff.baseline = acc.baseline AND ff.split = acc.split JOIN w ON w.baseline = acc.baseline AND w.split = acc.split
"""),
)
def _(spark, folder):
    return evaluated(spark, folder, "user_next_event_1d")


@query(
    "best_baseline_auc",
    on_clicks(_binary_result((1, 2)) + """
SELECT dataset, task, seed, baseline, roc_auc, ABS(roc_auc - MAX(roc_auc) OVER (PARTITION BY seed)) <= 1e-12 AS is_best
FROM result WHERE split = 'test' AND baseline NOT LIKE 'entity%'
"""),
)
def _(spark, folder):
    """Classification baselines are compared by the area under the curve, more is better; for each seed."""
    results = job("user_purchase_1d").evaluate(clicks(spark, folder), CLICKS_VAL, CLICKS_TEST, seeds=(1, 2))
    return baselines.best(rounded(results), "roc_auc", higher=True)


_REPORT_SEEDS = (1, 2, 3, 4, 5)

@query(
    "baseline_report",
    on_clicks(_binary_result(_REPORT_SEEDS) + f"""
, fit_r AS (
  SELECT 'train' AS fit, lab.* FROM lab WHERE split = 'train' UNION ALL SELECT 'trainval', lab.* FROM lab WHERE split IN ('train', 'val')),
use_r AS (SELECT *, CASE WHEN split = 'test' THEN 'trainval' ELSE 'train' END AS fit FROM lab),
g_r AS (SELECT fit, AVG(target) AS mean, quantile_cont(target, 0.5) AS median FROM fit_r GROUP BY 1),
e_r AS (SELECT fit, object_id, AVG(target) AS mean, quantile_cont(target, 0.5) AS median FROM fit_r GROUP BY 1, 2),
pred_r AS (
  SELECT u.split, u.target, unnest(['global_zero', 'global_mean', 'global_median', 'entity_mean', 'entity_median']) AS baseline,
    unnest([0.0, g.mean, g.median, COALESCE(e.mean, g.mean), COALESCE(e.median, g.median)]) AS pred
  FROM use_r u JOIN g_r g ON g.fit = u.fit LEFT JOIN e_r e ON e.fit = u.fit AND e.object_id = u.object_id),
result_r AS (
  SELECT 'clicks' AS dataset, 'user_purchase_count_1d' AS task, 'regression' AS task_type, s AS seed, {_sizes('lab')},
    p.baseline, p.split, ROUND(AVG(ABS(p.target - p.pred)), 6) AS mae, ROUND(AVG(POW(p.target - p.pred, 2)), 6) AS mse,
    ROUND(SQRT(AVG(POW(p.target - p.pred, 2))), 6) AS rmse, ROUND(1 - SUM(POW(p.target - p.pred, 2)) / SUM(POW(p.target - m.m, 2)), 6) AS r2
  FROM pred_r p JOIN (SELECT split, AVG(target) AS m FROM lab GROUP BY 1) m ON m.split = p.split, {_seeds(_REPORT_SEEDS)} GROUP BY p.baseline, p.split, s)
SELECT * FROM result_r UNION ALL BY NAME SELECT * FROM result
"""),
)
def _(spark, folder):
    """Two jobs over five seeds, in one table."""
    log = clicks(spark, folder)
    names = ("user_purchase_count_1d", "user_purchase_1d")
    return baselines.report([job(n).evaluate(log, CLICKS_VAL, CLICKS_TEST, seeds=_REPORT_SEEDS) for n in names])


def _given(stacked: DataFrame, *preds) -> DataFrame:
    return stacked.where("split = 'test'").select("object_id", "time", *preds)


@query(
    "evaluate_given_regression",
    on_clicks(CLICK_SPLITS + f"""
, p AS (SELECT target, 3 * {_random("'7'")} AS pred FROM lab WHERE split = 'test')
SELECT ROUND(AVG(ABS(target - pred)), 6) AS mae, ROUND(AVG(POW(target - pred, 2)), 6) AS mse, ROUND(SQRT(AVG(POW(target - pred, 2))), 6) AS rmse,
  ROUND(1 - SUM(POW(target - pred, 2)) / SUM(POW(target - (SELECT AVG(target) FROM p), 2)), 6) AS r2 FROM p
"""),
)
def _(spark, folder):
    stacked = labels.stack_splits(click_splits(spark, folder))
    said = _given(stacked, (3 * uniform(7, to_micros(F.col("time")), "object_id")).alias("pred"))
    return baselines.evaluate_predictions(_given(stacked, "target"), said, ["object_id", "time"], "regression")


_SCORES = ", ".join(f"exp({_random(chr(39) + '7' + chr(39), chr(39) + str(k) + chr(39))})" for k in range(3))


@query(
    "evaluate_given_classes",
    on_clicks(CLASS_LABELS + f"""
, pred AS (SELECT target, [{_SCORES}] AS p FROM cls WHERE split = 'test'),
three AS (SELECT target AS label, p, unnest([0, 1, 2]) AS class FROM pred),
one AS (
  SELECT class, CASE WHEN label = class THEN 1 ELSE 0 END AS target, ROUND(p[class + 1] / list_sum(p), 12) AS pred,
    CASE WHEN list_position(p, list_max(p)) = class + 1 THEN 1.0 ELSE 0.0 END AS hit FROM three)
""" + _auc("class", "one") + """
, f AS (SELECT class, 2 * SUM(target * hit) / SUM(target + hit) AS f1 FROM one GROUP BY ALL HAVING SUM(target + hit) > 0)
SELECT (SELECT ROUND(AVG(CASE WHEN target + 1 = list_position(p, list_max(p)) THEN 1.0 ELSE 0.0 END), 6) FROM pred) AS accuracy,
  (SELECT ROUND(AVG(f1), 6) FROM f) AS multiclass_f1, (SELECT ROUND(AVG(roc_auc), 6) FROM auc) AS multiclass_roc_auc
"""),
)
def _(spark, folder):
    stacked = labels.stack_splits(class_splits(spark, folder))
    scores = F.array(*[uniform(7, F.lit(k), to_micros(F.col("time")), "object_id") for k in range(3)])
    said = _given(stacked, scores.alias("pred"))
    return baselines.evaluate_predictions(_given(stacked, "target"), said, ["object_id", "time"], "multiclass")


@query(
    "best_baseline",
    on_clicks(_REGRESSION_RESULT + """
SELECT dataset, task, seed, baseline, mae, mae <= MIN(mae) OVER () AS is_best FROM result WHERE split = 'test' AND baseline NOT LIKE 'entity%'
"""),
)
def _(spark, folder):
    return baselines.best(regression_results(spark, folder), "mae", higher=False)


# -- metrics ---------------------------------------------------------------


def binary_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs, marks = table(spark, folder, "documents"), table(spark, folder, "labels")
    return docs.select("doc_id", "lang", "n_chars").join(marks, "doc_id").select(
        "lang", F.col("quality").alias("target"), (F.pmod("n_chars", F.lit(97)) / 97.0).alias("pred")
    )


_BINARY = "WITH pred AS (SELECT d.lang, l.quality AS target, (d.n_chars % 97) / 97.0::DOUBLE AS pred FROM documents d JOIN labels l ON l.doc_id = d.doc_id)\n"


@query(
    "metrics_binary",
    _BINARY + _auc("lang", "pred") + ", hard AS (" + _HARD.format(g="lang", s="pred") + """)
SELECT h.lang, ROUND(h.accuracy, 6) AS accuracy, ROUND(h.f1, 6) AS f1, ROUND(a.auprc, 6) AS auprc, ROUND(a.roc_auc, 6) AS roc_auc
FROM hard h JOIN auc a ON a.lang = h.lang
""",
)
def _(spark, folder):
    return metrics.binary(binary_scores(spark, folder), ["lang"])


_PRICES = "pred AS (SELECT o_totalprice AS target, AVG(o_totalprice) OVER (PARTITION BY o_custkey) AS pred, o_orderpriority FROM orders)\n"


@query(
    "metrics_regression",
    "WITH " + _PRICES + """
SELECT p.o_orderpriority, ROUND(AVG(ABS(target - pred)), 6) AS mae, ROUND(AVG(POW(target - pred, 2)), 3) AS mse,
  ROUND(SQRT(AVG(POW(target - pred, 2))), 6) AS rmse, ROUND(1 - SUM(POW(target - pred, 2)) / SUM(POW(target - m, 2)), 6) AS r2
FROM pred p JOIN (SELECT o_orderpriority, AVG(target) AS m FROM pred GROUP BY 1) a ON a.o_orderpriority = p.o_orderpriority GROUP BY 1
""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    means = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("pred"))
    scored = orders.join(means, "o_custkey").withColumnRenamed("o_totalprice", "target")
    return metrics.regression(scored, ["o_orderpriority"]).withColumn("mse", F.round("mse", 3))


def class_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Five scores per event; the target is its type's place in the alphabet."""
    kinds = F.array(*[F.lit(t) for t in sorted(TYPES)])
    scores = F.array(*[F.pmod(F.col("event_id") * (7 + c), F.lit(101)) / 101.0 for c in range(5)])
    return table(spark, folder, "events").select(
        "event_id", (F.array_position(kinds, F.col("event_type")) - 1).cast("int").alias("target"), scores.alias("pred")
    )


_SCORES = "WITH s AS (SELECT event_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS label, [" + ", ".join(
    f"((event_id * {7 + c}) % 101) / 101.0::DOUBLE" for c in range(5)
) + "] AS v FROM events),\nlong AS (SELECT event_id, label, unnest(range(5)) AS class, unnest(v) AS v FROM s)\n"
_SOFT = """
, soft AS (SELECT event_id, label, class, exp(v - MAX(v) OVER (PARTITION BY event_id)) AS x FROM long),
prob AS (SELECT event_id, label, class, ROUND(x / SUM(x) OVER (PARTITION BY event_id), 12) AS p FROM soft)
"""


def _one_vs_rest(score: str, source: str) -> str:
    return f", one AS (SELECT class, CASE WHEN label = class THEN 1 ELSE 0 END AS target, {score} AS pred FROM {source})\n" + _auc("class", "one")


@query(
    "metrics_multiclass_f1",
    _SCORES + """
, top AS (SELECT event_id, ANY_VALUE(label) AS label, arg_max(class, {'v': v, 'c': -class}) AS said FROM long GROUP BY 1),
f AS (
  SELECT c, 2 * COUNT(*) FILTER (WHERE label = c AND said = c) / (COUNT(*) FILTER (WHERE label = c) + COUNT(*) FILTER (WHERE said = c)) AS f1
  FROM top, (SELECT unnest(range(5)) AS c) GROUP BY c)
SELECT ROUND((SELECT AVG(f1) FROM f), 6) AS multiclass_f1, ROUND((SELECT AVG(CASE WHEN label = said THEN 1.0 ELSE 0.0 END) FROM top), 6) AS accuracy
""",
)
def _(spark, folder):
    scored = class_scores(spark, folder)
    return metrics.macro_f1(scored).select("multiclass_f1", metrics.accuracy(scored).scalar().alias("accuracy"))


@query(
    "metrics_auc_weighted",
    _SCORES + _one_vs_rest("v", "long") + "SELECT ROUND(SUM(roc_auc * np) / SUM(np), 6) AS multiclass_roc_auc FROM auc WHERE roc_auc IS NOT NULL",
)
def _(spark, folder):
    return metrics.weighted_ovr_auc(class_scores(spark, folder))


@query(
    "metrics_auc_softmax",
    _SCORES + _SOFT + _one_vs_rest("p", "prob") + "SELECT ROUND(AVG(roc_auc), 6) AS roc_auc FROM auc",
)
def _(spark, folder):
    return metrics.softmax_macro_auc(class_scores(spark, folder))


@query(
    "metrics_auc_observed",
    _SCORES + """
, kept AS (SELECT * FROM long WHERE label <> 2 AND class <> 2),
scaled AS (SELECT class, label, v, SUM(v) OVER (PARTITION BY event_id) AS t FROM kept),
share AS (SELECT class, label, ROUND(CASE WHEN t = 0 THEN 0.25 ELSE v / t END, 12) AS p FROM scaled)
""" + _one_vs_rest("p", "share") + "SELECT ROUND(AVG(roc_auc), 6) AS roc_auc FROM auc",
)
def _(spark, folder):
    return metrics.observed_macro_auc(class_scores(spark, folder).where("target <> 2"))


@query(
    "metrics_log_loss",
    _SCORES + _SOFT + "SELECT ROUND(AVG(-ln(greatest(1e-15, least(1 - 1e-15, p)))), 6) AS log_loss FROM prob WHERE label = class",
)
def _(spark, folder):
    return metrics.log_loss(class_scores(spark, folder))


def multilabel_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Validation labels, predicted by whether a type occurred in the day before."""
    stacked = labels.stack_splits(multilabel_splits(spark, folder))
    after = stacked.where("split = 'val'").select("object_id", "time", "target")
    before = stacked.where("split IN ('train', 'val')").select(
        "object_id", (F.col("time") + F.expr("INTERVAL 1 DAY")).alias("time"), F.col("target").alias("pred")
    )
    return after.join(before, ["object_id", "time"])


@query(
    "metrics_multilabel",
    on_clicks(MULTI_LABELS + """
, pairs AS (
  SELECT a.object_id, a.time, a.pos, a.flag AS t, b.flag AS p FROM wide a
  JOIN wide b ON b.object_id = a.object_id AND b.time + INTERVAL 1 DAY = a.time AND b.pos = a.pos
  WHERE a.split = 'val' AND b.split IN ('train', 'val')),
f AS (SELECT pos, COALESCE(2 * SUM(t * p) / NULLIF(SUM(t + p), 0), 0.0) AS f1 FROM pairs GROUP BY 1),
x AS (SELECT object_id, time, MIN(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) AS same FROM pairs GROUP BY ALL)
SELECT ROUND((SELECT AVG(same) FROM x), 6) AS multilabel_accuracy, ROUND((SELECT AVG(f1) FROM f), 6) AS multilabel_f1_macro
"""),
)
def _(spark, folder):
    return metrics.multilabel(multilabel_scores(spark, folder))


@query(
    "metrics_misaligned",
    on_clicks(CLICK_SPLITS + """
, truth AS (SELECT object_id, time FROM lab WHERE split <> 'test'), said AS (SELECT object_id, time FROM lab WHERE split <> 'train')
SELECT (SELECT COUNT(*) FROM (SELECT * FROM said EXCEPT SELECT * FROM truth)) AS without_label,
  (SELECT COUNT(*) FROM (SELECT * FROM truth EXCEPT SELECT * FROM said)) AS without_prediction
"""),
)
def _(spark, folder):
    stacked = labels.stack_splits(click_splits(spark, folder))
    return metrics.misaligned(stacked.where("split <> 'train'"), stacked.where("split <> 'test'"), ["object_id", "time"])


@query(
    "class_weights",
    on_clicks(CLASS_LABELS + """
, n AS (SELECT c, COUNT(cls.target) AS n FROM (SELECT unnest(range(5)) AS c) LEFT JOIN cls ON cls.target = c AND cls.split = 'train' GROUP BY 1),
w AS (SELECT c, 1.0::DOUBLE / CASE WHEN n = 0 THEN 1 ELSE n END AS w FROM n)
SELECT CAST(c AS INTEGER) AS class, ROUND(w / SUM(w) OVER (), 6) AS weight FROM w
"""),
)
def _(spark, folder):
    return metrics.class_weights(class_splits(spark, folder)["train"], 5)


@query(
    "score_postprocessing",
    _SCORES + _SOFT + """
, top AS (SELECT event_id, arg_max(class, {'p': v, 'c': -class}) AS top, MAX(CASE WHEN class = 0 THEN v END) AS first FROM long GROUP BY 1)
SELECT t.event_id, ROUND(1 / (1 + exp(-t.first)), 6) AS sigmoid, ROUND(p.p, 6) AS softmax, CAST(t.top AS INTEGER) AS top,
  CASE WHEN t.top = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS hot
FROM top t JOIN prob p ON p.event_id = t.event_id AND p.class = 0
""",
)
def _(spark, folder):
    scored = class_scores(spark, folder)
    top = argmax(F.col("pred"))
    return scored.select(
        "event_id",
        postprocess(F.get("pred", F.lit(0)), "binary").alias("sigmoid"),
        F.get(postprocess(F.col("pred"), "multiclass"), F.lit(0)).alias("softmax"),
        top.alias("top"),
        F.get(one_hot(top, 5), F.lit(1)).alias("hot"),
    )


# -- stored labels, job descriptions, recipes ------------------------------


@query(
    "stored_labels",
    on_clicks(BINARY_LABELS.replace(", bin AS", CLASS_LABELS.removeprefix(CLICK_SPLITS) + ", bin AS") + """
SELECT 'user_next_event_1d' AS job, split, object_id, time, CAST(target AS DOUBLE) AS target FROM cls
UNION ALL SELECT 'user_purchase_1d', split, object_id, time, CAST(target AS DOUBLE) FROM bin
"""),
)
def _(spark, folder):
    """Label tables of two jobs, built once, stored by job and split, and read back."""
    log, path = clicks(spark, folder), f"{shared_folder(spark)}/labels-{uuid4().hex}"
    names = ("user_next_event_1d", "user_purchase_1d")
    for name in names:
        store.save_labels(job(name).splits(log, CLICKS_VAL, CLICKS_TEST), path, name)
    read = [labels.stack_splits(store.load_labels(spark, path, n)).withColumn("job", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, read).select("job", "split", "object_id", "time", F.col("target").cast("double").alias("target"))


@query(
    "label_meta",
    on_clicks(CLICK_SPLITS + """
SELECT 'object_id' AS key, 'object' AS refers_to, COUNT(*) AS labels, COUNT(*) - COUNT(o.object_id) AS dangling
FROM lab LEFT JOIN c_object o ON o.object_id = lab.object_id
"""),
)
def _(spark, folder):
    """The foreign keys that a job declares for its label table, checked on its rows."""
    one, log = job("user_purchase_count_1d"), clicks(spark, folder)
    rows = labels.stack_splits(one.splits(log, CLICKS_VAL, CLICKS_TEST))
    found = []
    for key, target in one.meta.fks.items():
        known = log[target].select(F.col(log.meta[target].pk).alias(key), F.lit(1).alias("_known"))
        counts = rows.join(known, key, "left").agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("_known").isNull()).alias("dangling"))
        found.append(counts.select(F.lit(key).alias("key"), F.lit(target).alias("refers_to"), "labels", "dangling"))
    return reduce(DataFrame.unionByName, found)


@query(
    "baseline_sets",
    on_clicks(BINARY_LABELS.replace(", bin AS", CLASS_LABELS.removeprefix(CLICK_SPLITS) + ", bin AS") + """
SELECT 'regression' AS task_type, unnest(['global_zero', 'global_mean', 'global_median', 'entity_mean', 'entity_median']) AS baseline, (SELECT COUNT(*) FROM lab) AS predictions
UNION ALL SELECT 'binary', unnest(['random', 'majority', 'entity_mean', 'entity_median']), (SELECT COUNT(*) FROM bin)
UNION ALL SELECT 'multiclass', unnest(['random', 'majority', 'entity_majority_multiclass']), (SELECT COUNT(*) FROM cls)
"""),
)
def _(spark, folder):
    """Which baselines a task type has: each predicts every label."""
    stacked = {"regression": click_splits(spark, folder), "binary": binary_splits(spark, folder), "multiclass": class_splits(spark, folder)}
    counted = [
        baselines.predict(labels.stack_splits(splits), KEYS, kind, num_classes=3)
        .groupBy("baseline").agg(F.count(F.lit(1)).alias("predictions")).select(F.lit(kind).alias("task_type"), "baseline", "predictions")
        for kind, splits in stacked.items()
    ]
    return reduce(DataFrame.unionByName, counted)
