"""Observation grids, candidates and label tables on the sample tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import class_index, fresh, type_in
from ..grid import Grid
from ..operators import labels, observe
from ..sources.fixtures import CLICKS_GRID, CLICKS_TEST, CLICKS_VAL, DAY, ORDERS_GRID, clicks, orders
from .log_queries import _DOUBLED, doubled_clicks
from .registry import query
from .views import on_clicks, on_orders

ORDERS_AGE = 30 * DAY
TYPES = ("view", "click", "purchase", "signup", "error")
PAIR_GRID = Grid.regular(datetime(2024, 1, 4), DAY, 25)
_PAIR_TIMES = """
, p_grid AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-04', TIMESTAMP '2024-01-28', INTERVAL 1 DAY)) AS t)
"""
_UNEVEN = (
    datetime(2024, 1, 3),
    datetime(2024, 1, 3, 7, 30),
    datetime(2024, 1, 9),
    datetime(2024, 1, 15, 12),
    datetime(2024, 1, 16),
    datetime(2024, 1, 27, 23),
)


def _stage(link: str, grid: str, kind: str, source: str, age_days: float | None, keys: str = "object_id") -> str:
    """Candidates by brute force: every link up to every grid time."""
    where = f"AND last_at > t - INTERVAL {int(age_days * 86400)} SECOND" if age_days is not None else ""
    typed = f"AND k.object_type = '{kind}'" if kind else ""
    return f"""
, cand AS (
  SELECT {keys}, t FROM (
    SELECT {keys}, g.t, arg_max(k.type, {{'a': k.time, 'b': k.event_id}}) AS state, MAX(k.time) AS last_at
    FROM {grid} g JOIN {link} k ON k.time <= g.t {typed} GROUP BY {keys}, g.t)
  WHERE state = '{source}' {where})
"""


def _slots(df: DataFrame, grid: Grid, keys=observe.SINGLE) -> DataFrame:
    return observe.timed(df, keys, grid)


# -- grids and candidates --------------------------------------------------


@query(
    "split_grids",
    on_clicks("""
, b AS (SELECT MIN(time) AS lo, MAX(time) AS hi FROM c_event)
SELECT 'train' AS split, unnest(generate_series(TIMESTAMP '2024-01-19', lo, INTERVAL '-1' DAY)) AS time FROM b
UNION ALL SELECT 'val', unnest(generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-24', INTERVAL 1 DAY)) FROM b
UNION ALL SELECT 'test', unnest(generate_series(TIMESTAMP '2024-01-25', hi - INTERVAL 1 DAY, INTERVAL 1 DAY)) FROM b
"""),
)
def _(spark, folder):
    low, high = observe.event_bounds(clicks(spark, folder))
    return observe.grid_frame(spark, observe.split_grids(low, high, CLICKS_VAL, CLICKS_TEST, DAY))


@query("stage_candidates", on_clicks(_stage("c_link", "c_grid", "user", "view", 1) + "SELECT object_id, t AS time FROM cand"))
def _(spark, folder):
    found = observe.stage_candidates(clicks(spark, folder), "user", CLICKS_GRID, "view", DAY)
    return _slots(found, CLICKS_GRID)


_UNEVEN_SQL = ", u_grid AS (SELECT unnest([{}]) AS t)\n".format(", ".join(f"TIMESTAMP '{t}'" for t in _UNEVEN))


@query(
    "stage_candidates_uneven_grid",
    on_clicks(_UNEVEN_SQL + _stage("c_link", "u_grid", "user", "click", None) + "SELECT object_id, t AS time FROM cand"),
)
def _(spark, folder):
    grid = Grid.of(_UNEVEN)
    return _slots(observe.stage_candidates(clicks(spark, folder), "user", grid, "click"), grid)


@query(
    "stage_candidates_ties",
    on_orders(_stage("o_link", "o_grid", "supplier", "ship A", 30) + "SELECT object_id, t AS time FROM cand"),
)
def _(spark, folder):
    found = observe.stage_candidates(orders(spark, folder), "supplier", ORDERS_GRID, "ship A", ORDERS_AGE)
    return _slots(found, ORDERS_GRID)


@query(
    "active_candidates",
    on_clicks("""
SELECT DISTINCT k.object_id, g.t AS time FROM c_grid g JOIN c_link k
  ON k.time > g.t - INTERVAL 6 HOUR AND k.time <= g.t AND k.object_type = 'user' AND k.seen <= g.t
"""),
)
def _(spark, folder):
    found = observe.active_candidates(clicks(spark, folder), "user", CLICKS_GRID, timedelta(hours=6))
    return _slots(found, CLICKS_GRID)


_OBSERVED = _PAIR_TIMES + """
, met AS (
  SELECT a.object_id AS s, b.object_id AS d, MIN(a.time) AS first, MIN(a.seen) AS s_seen, MIN(b.seen) AS d_seen
  FROM c_link a JOIN c_link b ON a.event_id = b.event_id AND a.object_type = 'user' AND b.object_type = 'item' GROUP BY 1, 2),
act AS (
  SELECT DISTINCT k.object_id, g.t FROM p_grid g JOIN c_link k
  ON k.time > g.t - INTERVAL {hours} HOUR AND k.time <= g.t),
cand AS (
  SELECT m.s AS object_id_src, m.d AS object_id_dst, g.t FROM p_grid g JOIN met m
  ON m.first < g.t AND m.s_seen <= g.t AND m.d_seen <= g.t
  WHERE (m.s, g.t) IN (SELECT (object_id, t) FROM act) OR (m.d, g.t) IN (SELECT (object_id, t) FROM act))
"""
_CARTESIAN = _PAIR_TIMES + """
, act AS (
  SELECT DISTINCT k.object_id, g.t FROM p_grid g JOIN c_link k
  ON k.time > g.t - INTERVAL {hours} HOUR AND k.time <= g.t),
cand AS (
  SELECT a.object_id AS object_id_src, b.object_id AS object_id_dst, g.t
  FROM p_grid g JOIN c_object a ON a.time <= g.t AND a.type = 'user' JOIN c_object b ON b.time <= g.t AND b.type = 'item'
  WHERE (a.object_id, g.t) IN (SELECT (object_id, t) FROM act) OR (b.object_id, g.t) IN (SELECT (object_id, t) FROM act))
"""


@query(
    "observed_pair_candidates",
    on_clicks(_OBSERVED.format(hours=2) + "SELECT object_id_src, object_id_dst, t AS time FROM cand"),
)
def _(spark, folder):
    found = observe.observed_pair_candidates(clicks(spark, folder), ("user", "item"), PAIR_GRID, timedelta(hours=2))
    return _slots(found, PAIR_GRID, observe.PAIR)


@query(
    "cartesian_pair_candidates",
    on_clicks(_CARTESIAN.format(hours=2) + "SELECT object_id_src, object_id_dst, t AS time FROM cand"),
)
def _(spark, folder):
    found = observe.cartesian_pair_candidates(clicks(spark, folder), ("user", "item"), PAIR_GRID, timedelta(hours=2))
    return _slots(found, PAIR_GRID, observe.PAIR)


@query(
    "future_window_events",
    on_clicks(_stage("c_link", "c_grid", "user", "view", 1) + """
SELECT c.object_id, c.t AS time, k.event_id, k.type, k.time AS event_time
FROM cand c JOIN c_link k ON k.object_id = c.object_id AND k.time > c.t AND k.time <= c.t + INTERVAL 1 DAY
"""),
)
def _(spark, folder):
    log = clicks(spark, folder)
    found = observe.stage_candidates(log, "user", CLICKS_GRID, "view", DAY)
    future = observe.future_slots(log.links_of("user"), CLICKS_GRID, DAY)
    joined = found.join(future.withColumnRenamed("time", "event_time"), ["object_id", "slot"])
    return observe.timed(joined, observe.SINGLE, CLICKS_GRID, "event_id", "type", "event_time")


@query(
    "pair_window_events",
    on_clicks(_OBSERVED.format(hours=2) + """
SELECT c.object_id_src, c.object_id_dst, c.t AS time, a.event_id, a.type, a.time AS event_time
FROM cand c JOIN c_link a ON a.object_id = c.object_id_src AND a.time > c.t AND a.time <= c.t + INTERVAL 3 DAY
JOIN c_e2o b ON b.event_id = a.event_id AND b.object_id = c.object_id_dst
"""),
)
def _(spark, folder):
    log = clicks(spark, folder)
    found = observe.observed_pair_candidates(log, ("user", "item"), PAIR_GRID, timedelta(hours=2))
    future = observe.future_slots(observe.pair_links(log, ("user", "item")), PAIR_GRID, 3 * DAY)
    joined = found.join(future.withColumnRenamed("time", "event_time"), [*observe.PAIR, "slot"])
    return observe.timed(joined, observe.PAIR, PAIR_GRID, "event_id", "type", "event_time")


@query(
    "candidate_columns",
    on_clicks("""
SELECT event_id, type, CAST(CASE type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE -1 END AS INTEGER) AS class,
  type IN ('view', 'click') AS listed, time > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AS fresh
FROM c_event
"""),
)
def _(spark, folder):
    at = F.lit(CLICKS_VAL).cast("timestamp_ntz")
    return clicks(spark, folder).event.select(
        "event_id",
        "type",
        F.coalesce(class_index(F.col("type"), ["purchase", "view"]), F.lit(-1)).alias("class"),
        type_in(F.col("type"), ["view", "click"]).alias("listed"),
        fresh(F.col("time"), at, 7 * DAY).alias("fresh"),
    )


# -- stage labels ----------------------------------------------------------


@query(
    "stage_transition",
    on_clicks(_stage("c_link", "c_grid", "user", "view", 1) + """
SELECT c.object_id, c.t AS time, CAST(MAX(CASE WHEN k.type = 'purchase' THEN 1 ELSE 0 END) AS INTEGER) AS target
FROM cand c LEFT JOIN c_link k ON k.object_id = c.object_id AND k.time > c.t AND k.time <= c.t + INTERVAL 1 DAY GROUP BY ALL
"""),
)
def _(spark, folder):
    return labels.stage_transition(clicks(spark, folder), "user", CLICKS_GRID, DAY, "view", "purchase", DAY)


@query(
    "stage_next_event",
    on_orders(_stage("o_link", "o_grid", "supplier", "ship A", 30) + """
, following AS (
  SELECT c.object_id, c.t, arg_min(k.type, {'a': k.time, 'b': k.event_id}) AS type
  FROM cand c JOIN o_link k ON k.object_id = c.object_id AND k.time > c.t AND k.time <= c.t + INTERVAL 30 DAY GROUP BY ALL)
SELECT object_id, t AS time, CAST(CASE type WHEN 'ship R' THEN 0 WHEN 'ship N' THEN 1 END AS INTEGER) AS target
FROM following WHERE type IN ('ship R', 'ship N')
"""),
)
def _(spark, folder):
    return labels.stage_next_event(
        orders(spark, folder), "supplier", ORDERS_GRID, 30 * DAY, "ship A", ["ship R", "ship N"], ORDERS_AGE
    )


@query(
    "stage_event_count",
    on_clicks(_stage("c_link", "c_grid", "user", "view", 1) + """
SELECT c.object_id, c.t AS time, CAST(COUNT(k.event_id) AS DOUBLE) AS target
FROM cand c LEFT JOIN c_link k
  ON k.object_id = c.object_id AND k.type = 'purchase' AND k.time > c.t AND k.time <= c.t + INTERVAL 1 DAY GROUP BY ALL
"""),
)
def _(spark, folder):
    return labels.stage_event_count(clicks(spark, folder), "user", CLICKS_GRID, DAY, "view", "purchase", DAY)


@query(
    "stage_event_count_doubled",
    on_clicks(_DOUBLED + _stage("d_link", "c_grid", "user", "purchase", None) + """
SELECT c.object_id, c.t AS time, CAST(COUNT(k.event_id) AS DOUBLE) AS target
FROM cand c LEFT JOIN d_link k
  ON k.object_id = c.object_id AND k.type = 'purchase' AND k.time > c.t AND k.time <= c.t + INTERVAL 60 HOUR GROUP BY ALL
"""),
)
def _(spark, folder):
    return labels.stage_event_count(
        doubled_clicks(spark, folder), "user", CLICKS_GRID, timedelta(hours=60), "purchase", "purchase"
    )


@query(
    "stage_related_count",
    on_orders(_stage("o_link", "o_grid", "supplier", "ship A", None) + """
SELECT c.object_id, c.t AS time, CAST(COUNT(DISTINCT r.object_id) AS DOUBLE) AS target
FROM cand c
LEFT JOIN o_link k ON k.object_id = c.object_id AND k.type = 'ship R' AND k.time > c.t AND k.time <= c.t + INTERVAL 30 DAY
LEFT JOIN o_link r ON r.event_id = k.event_id AND r.object_type = 'part' AND r.object_id <> c.object_id GROUP BY ALL
"""),
)
def _(spark, folder):
    return labels.stage_related_count(
        orders(spark, folder), "supplier", "part", ORDERS_GRID, 30 * DAY, "ship A", "ship R"
    )


@query(
    "stage_attribute_value",
    on_clicks(_stage("c_link", "c_grid", "user", "view", 1) + """
, hit AS (
  SELECT c.object_id, c.t, arg_min(k.event_id, {'a': k.time, 'b': k.event_id}) AS event_id
  FROM cand c JOIN c_link k
    ON k.object_id = c.object_id AND k.type = 'purchase' AND k.time > c.t AND k.time <= c.t + INTERVAL 1 DAY GROUP BY ALL)
SELECT h.object_id, h.t AS time, ROUND(p.value, 6) AS target FROM hit h JOIN c_purchase p ON p.event_id = h.event_id
"""),
)
def _(spark, folder):
    return labels.stage_attribute_value(
        clicks(spark, folder), "user", CLICKS_GRID, DAY, "view", "purchase", "event_attr_purchase", "value", DAY
    )


@query(
    "stage_time_to_event",
    on_clicks(_stage("c_link", "c_grid", "user", "view", None) + """
SELECT c.object_id, c.t AS time, ROUND((epoch_us(MIN(k.time)) - epoch_us(c.t)) / 1e6, 6) AS target
FROM cand c JOIN c_link k ON k.object_id = c.object_id AND k.type = 'purchase' AND k.time > c.t GROUP BY c.object_id, c.t
"""),
)
def _(spark, folder):
    return labels.stage_time_to_event(clicks(spark, folder), "user", CLICKS_GRID, "view", "purchase")


@query(
    "stage_attribute_class",
    on_orders(_stage("o_link", "o_grid", "customer", "order F", None) + """
SELECT c.object_id, c.t AS time,
  CAST(CASE arg_max(a.priority, {'a': a.time, 'b': a.priority})
    WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS INTEGER) AS target
FROM cand c JOIN o_customer a ON a.object_id = c.object_id AND a.time <= c.t AND a.priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
GROUP BY c.object_id, c.t
"""),
)
def _(spark, folder):
    return labels.stage_attribute_class(
        orders(spark, folder), "customer", ORDERS_GRID, "order F", "object_attr_customer", "priority",
        ["1-URGENT", "2-HIGH", "3-MEDIUM"],
    )


# -- pair labels -----------------------------------------------------------

_PAIRS = """
, pair AS (
  SELECT DISTINCT a.object_id AS object_id_src, b.object_id AS object_id_dst, a.event_id, a.type, a.time
  FROM d_link a JOIN d_link b ON a.event_id = b.event_id AND a.object_id <> b.object_id
    AND a.object_type = 'user' AND b.object_type = 'item')
"""
_BOTH = "object_id_src, object_id_dst"


@query(
    "pair_event_within",
    on_clicks(_DOUBLED + _PAIRS + _stage("pair", "c_grid", "", "view", None, _BOTH) + """
SELECT c.object_id_src, c.object_id_dst, c.t AS time, CAST(MAX(CASE WHEN p.type = 'purchase' THEN 1 ELSE 0 END) AS INTEGER) AS target
FROM cand c LEFT JOIN pair p ON p.object_id_src = c.object_id_src AND p.object_id_dst = c.object_id_dst
  AND p.time > c.t AND p.time <= c.t + INTERVAL 3 DAY GROUP BY ALL
"""),
)
def _(spark, folder):
    return labels.pair_event_within(
        doubled_clicks(spark, folder), ("user", "item"), CLICKS_GRID, 3 * DAY, "view", "purchase"
    )


@query(
    "pair_event_count",
    on_clicks(_DOUBLED + _PAIRS + _stage("pair", "c_grid", "", "purchase", 7, _BOTH) + """
SELECT c.object_id_src, c.object_id_dst, c.t AS time, CAST(COUNT(p.event_id) AS DOUBLE) AS target
FROM cand c LEFT JOIN pair p ON p.object_id_src = c.object_id_src AND p.object_id_dst = c.object_id_dst
  AND p.type = 'purchase' AND p.time > c.t AND p.time <= c.t + INTERVAL 3 DAY GROUP BY ALL
"""),
)
def _(spark, folder):
    return labels.pair_event_count(
        doubled_clicks(spark, folder), ("user", "item"), CLICKS_GRID, 3 * DAY, "purchase", "purchase", 7 * DAY
    )


# -- window counts ---------------------------------------------------------


def _wide(alias: str = "k") -> str:
    return ", ".join(f"COUNT(*) FILTER (WHERE {alias}.type = '{t}') AS \"{t}\"" for t in TYPES)


_SINGLE_COUNTS = f"""
, act AS (
  SELECT DISTINCT k.object_id, g.t FROM c_grid g JOIN c_link k
  ON k.time > g.t - INTERVAL 1 DAY AND k.time <= g.t AND k.object_type = 'user' AND k.seen <= g.t),
counts AS (
  SELECT a.object_id, a.t AS time, {_wide()} FROM act a LEFT JOIN c_link k
  ON k.object_id = a.object_id AND k.time > a.t AND k.time <= a.t + INTERVAL 1 DAY GROUP BY ALL)
"""


def single_counts(spark: SparkSession, folder: str) -> DataFrame:
    return labels.window_event_counts(clicks(spark, folder), "user", CLICKS_GRID, DAY, TYPES)


@query("window_counts_single", on_clicks(_SINGLE_COUNTS + "SELECT * FROM counts"))
def _(spark, folder):
    return single_counts(spark, folder)


def _pair_counts_sql(candidates: str) -> str:
    return candidates.format(hours=72) + f"""
, hits AS (
  SELECT a.object_id AS s, b.object_id AS d, a.type, a.time
  FROM c_link a JOIN c_link b ON b.event_id = a.event_id AND a.object_type = 'user' AND b.object_type = 'item')
SELECT c.object_id_src, c.object_id_dst, c.t AS time, {_wide()} FROM cand c LEFT JOIN hits k
  ON k.s = c.object_id_src AND k.d = c.object_id_dst AND k.time > c.t AND k.time <= c.t + INTERVAL 3 DAY GROUP BY ALL
"""


@query("window_counts_observed", on_clicks(_pair_counts_sql(_OBSERVED)))
def _(spark, folder):
    return labels.window_event_counts(clicks(spark, folder), ("user", "item"), PAIR_GRID, 3 * DAY, TYPES)


@query("window_counts_cartesian", on_clicks(_pair_counts_sql(_CARTESIAN)))
def _(spark, folder):
    return labels.window_event_counts(
        clicks(spark, folder), ("user", "item"), PAIR_GRID, 3 * DAY, TYPES, pair_mode="cartesian"
    )


_TOTAL = " + ".join(f'"{t}"' for t in TYPES)


@query(
    "counts_to_target",
    on_clicks(_SINGLE_COUNTS + f"""
SELECT object_id, time, 'total_count' AS mode, CAST({_TOTAL} AS DOUBLE) AS target FROM counts
UNION ALL SELECT object_id, time, 'any', CASE WHEN {_TOTAL} > 0 THEN 1.0 ELSE 0.0 END FROM counts
UNION ALL SELECT object_id, time, 'specific_count', CAST("click" AS DOUBLE) FROM counts
UNION ALL SELECT object_id, time, 'specific_any', CASE WHEN "click" > 0 THEN 1.0 ELSE 0.0 END FROM counts
"""),
)
def _(spark, folder):
    # One pass over the counts; each mode is a column of it.
    wide = single_counts(spark, folder)
    modes = F.array(
        *[
            F.struct(F.lit(mode).alias("mode"), labels.target_column(TYPES, mode, "click").cast("double").alias("target"))
            for mode in ("total_count", "any", "specific_count", "specific_any")
        ]
    )
    return wide.select("object_id", "time", F.inline(modes))


@query(
    "counts_to_multilabel",
    on_clicks(_SINGLE_COUNTS + "SELECT object_id, time, " + ", ".join(
        f'CASE WHEN "{t}" > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS "{t}"' for t in TYPES) + " FROM counts"),
)
def _(spark, folder):
    wide = labels.counts_to_target(single_counts(spark, folder), TYPES, "multilabel")
    return wide.select("object_id", "time", *[F.get("target", F.lit(i)).cast("double").alias(t) for i, t in enumerate(TYPES)])


# -- split label tables ----------------------------------------------------


def click_splits(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Labels of all splits: purchases within a day after a view."""
    log = clicks(spark, folder)
    low, high = observe.event_bounds(log)
    grids = observe.split_grids(low, high, CLICKS_VAL, CLICKS_TEST, DAY)
    return labels.split_labels(
        log, grids, CLICKS_TEST, lambda part, grid: labels.stage_event_count(part, "user", grid, DAY, "view", "purchase")
    )


CLICK_SPLITS = """
, s_grid AS (
  SELECT 'train' AS split, unnest(generate_series(TIMESTAMP '2024-01-19', (SELECT MIN(time) FROM c_event), INTERVAL '-1' DAY)) AS t
  UNION ALL SELECT 'val', unnest(generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-24', INTERVAL 1 DAY))
  UNION ALL SELECT 'test', unnest(generate_series(TIMESTAMP '2024-01-25', (SELECT MAX(time) FROM c_event) - INTERVAL 1 DAY, INTERVAL 1 DAY))),
cand AS (
  SELECT split, object_id, t FROM (
    SELECT g.split, k.object_id, g.t, arg_max(k.type, {'a': k.time, 'b': k.event_id}) AS state
    FROM s_grid g JOIN c_link k ON k.time <= g.t AND k.object_type = 'user' GROUP BY ALL)
  WHERE state = 'view' AND object_id IN (SELECT object_id FROM c_object WHERE time <= TIMESTAMP '2024-01-25')),
lab AS (
  SELECT c.split, c.object_id, c.t AS time, CAST(COUNT(k.event_id) AS DOUBLE) AS target
  FROM cand c LEFT JOIN c_link k
    ON k.object_id = c.object_id AND k.type = 'purchase' AND k.time > c.t AND k.time <= c.t + INTERVAL 1 DAY GROUP BY ALL)
"""


@query("split_labels", on_clicks(CLICK_SPLITS + "SELECT * FROM lab"))
def _(spark, folder):
    return labels.stack_splits(click_splits(spark, folder))


@query(
    "drop_unknown_entities",
    on_orders("""
SELECT l.object_id, l.event_id, l.time FROM o_link l
WHERE l.object_id IN (SELECT object_id FROM o_object WHERE time <= TIMESTAMP '1995-02-01')
"""),
)
def _(spark, folder):
    log = orders(spark, folder)
    return labels.drop_unknown(
        log.links().select("object_id", "event_id", "time"), labels.known_at(log, datetime(1995, 2, 1))
    )


@query(
    "label_nodes",
    on_clicks(CLICK_SPLITS + """
, n AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, time, object_id) - 1 AS label_id FROM lab)
SELECT label_id, split, time, object_id, target FROM n
"""),
)
def _(spark, folder):
    nodes, targets = labels.label_nodes(click_splits(spark, folder))
    return nodes.join(targets, "label_id")
