"""Composition, coverage, time profiles and timing on the sample tables."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import quantiles
from ..operators import profile, timing
from ..sources.fixtures import DAY, clicks, orders, table
from .log_queries import _DOUBLED, doubled_clicks
from .registry import query
from .views import on_clicks, on_orders

DELTAS = (timedelta(hours=1), timedelta(hours=6), DAY, 7 * DAY)


def _both(fn, **names) -> DataFrame:
    return reduce(DataFrame.unionByName, [fn(e).select(F.lit(e).alias("entity"), *cols) for e, cols in names.items()])


@query(
    "type_counts",
    on_orders("""
SELECT 'event' AS entity, type, COUNT(*) AS n FROM o_event GROUP BY type
UNION ALL SELECT 'object', type, COUNT(*) FROM o_object GROUP BY type
"""),
)
def _(spark, folder):
    log = orders(spark, folder)
    return _both(
        lambda e: profile.type_counts(log, e),
        event=[F.col("event_type").alias("type"), F.col("count").alias("n")],
        object=[F.col("object_type").alias("type"), F.col("count").alias("n")],
    )


_DEGREES = """
, deg AS (
  SELECT 'objects_per_event' AS metric, COUNT(DISTINCT object_id) AS d FROM d_e2o GROUP BY event_id
  UNION ALL SELECT 'events_per_object', COUNT(DISTINCT event_id) FROM d_e2o GROUP BY object_id)
"""


@query("degree_distribution", on_clicks(_DOUBLED + _DEGREES + "SELECT metric, d AS degree, COUNT(*) AS n FROM deg GROUP BY ALL"))
def _(spark, folder):
    log = doubled_clicks(spark, folder)
    parts = []
    for entity, (value, count) in profile._DEGREE.items():
        parts.append(
            profile.degree_distribution(log, entity).select(
                F.lit(value).alias("metric"), F.col(value).alias("degree"), F.col(count).alias("n")
            )
        )
    return parts[0].unionByName(parts[1])


@query(
    "degree_summary",
    on_clicks(_DOUBLED + _DEGREES + """
SELECT metric, COUNT(*) AS count, ROUND(AVG(d), 6) AS mean, ROUND(stddev_samp(d), 6) AS std, MIN(d) AS min, MAX(d) AS max,
  ROUND(quantile_cont(d, 0.5), 6) AS p50, ROUND(quantile_cont(d, 0.9), 6) AS p90 FROM deg GROUP BY metric
"""),
)
def _(spark, folder):
    return profile.degree_summary(doubled_clicks(spark, folder))


_LENGTHS = """
, len AS (SELECT object_id, COUNT(DISTINCT event_id) AS n FROM o_e2o GROUP BY 1),
top AS (SELECT MAX(n) AS k FROM len),
spine AS (SELECT unnest(generate_series(0, (SELECT k FROM top))) AS k)
"""


@query("trace_lengths", on_orders(_LENGTHS + "SELECT object_id, n AS object_trace_length FROM len"))
def _(spark, folder):
    return profile.trace_lengths(orders(spark, folder))


@query(
    "coverage_by_min_length",
    on_orders(_LENGTHS + """
, ev AS (SELECT e.event_id, MAX(l.n) AS n FROM o_e2o e JOIN len l ON l.object_id = e.object_id GROUP BY 1),
eh AS (SELECT n, COUNT(*) AS c FROM ev GROUP BY 1), oh AS (SELECT n, COUNT(*) AS c FROM len GROUP BY 1),
curve AS (
  SELECT k, (SELECT COALESCE(SUM(c), 0) FROM eh WHERE n >= k) AS e, (SELECT SUM(c) FROM eh) AS te,
    (SELECT COALESCE(SUM(c), 0) FROM oh WHERE n >= k) AS o, (SELECT SUM(c) FROM oh) AS t FROM spine)
SELECT k AS min_object_trace_length, e::BIGINT AS event_count, te::BIGINT AS total_event_count, ROUND(e / te, 6) AS event_share,
  ROUND(e / te * 100, 6) AS event_share_pct, o::BIGINT AS object_count, t::BIGINT AS total_object_count,
  ROUND(o / t, 6) AS object_share, ROUND(o / t * 100, 6) AS object_share_pct
FROM curve
"""),
)
def _(spark, folder):
    return profile.coverage_by_min_length(orders(spark, folder))


@query(
    "objects_above_length",
    on_orders(_LENGTHS + """
, curve AS (SELECT k, (SELECT COUNT(*) FROM len WHERE n > k) AS a, (SELECT COUNT(*) FROM len) AS t FROM spine)
SELECT k AS trace_length_threshold, a AS object_count_above_threshold, t AS total_object_count,
  ROUND(a / t, 6) AS object_share_above_threshold, ROUND(a / t * 100, 6) AS object_share_above_threshold_pct
FROM curve
"""),
)
def _(spark, folder):
    return profile.objects_above_length(orders(spark, folder))


@query(
    "type_mix_above_length",
    on_orders(_LENGTHS + """
, kind AS (SELECT l.object_id, l.n, o.type FROM len l JOIN o_object o ON o.object_id = l.object_id),
cell AS (
  SELECT k, t.type, (SELECT COUNT(*) FROM kind WHERE n > k AND kind.type = t.type) AS a,
    (SELECT COUNT(*) FROM kind WHERE n > k) AS total, (SELECT COUNT(*) FROM kind) AS everything
  FROM spine, (SELECT DISTINCT type FROM kind) t)
SELECT k AS trace_length_threshold, type AS object_type, a AS object_count_above_threshold,
  total AS total_object_count_above_threshold,
  CASE WHEN total > 0 THEN ROUND(a / total, 6) ELSE 0.0 END AS type_share_within_threshold,
  CASE WHEN total > 0 THEN ROUND(a / total * 100, 6) ELSE 0.0 END AS type_share_within_threshold_pct,
  ROUND(total / everything * 100, 6) AS global_object_share_pct
FROM cell
"""),
)
def _(spark, folder):
    return profile.type_mix_above_length(orders(spark, folder))


@query(
    "event_histogram_daily",
    on_clicks("SELECT date_trunc('day', time) AS bucket, type, COUNT(*) AS count FROM c_event GROUP BY ALL"),
)
def _(spark, folder):
    return profile.entity_histogram(clicks(spark, folder), "event")


@query(
    "object_histogram_six_hours",
    on_clicks("SELECT time_bucket(INTERVAL 6 HOUR, time) AS bucket, COUNT(*) AS count FROM c_object GROUP BY ALL"),
)
def _(spark, folder):
    return profile.entity_histogram(clicks(spark, folder), "object", timedelta(hours=6), by_type=False)


@query(
    "weekly_stability",
    on_clicks("""
, b AS (
  SELECT date_trunc('week', time - INTERVAL 1 DAY) + INTERVAL 1 DAY AS week, isodow(time) - 1 AS d, (hour(time) // 6) * 6 AS h FROM c_event),
kept AS (SELECT * FROM b WHERE week IN (SELECT week FROM b GROUP BY 1 HAVING COUNT(*) >= 200)),
cells AS (SELECT d, h FROM (SELECT unnest(range(7)) AS d), (SELECT unnest([0, 6, 12, 18]) AS h)),
weeks AS (SELECT week, COUNT(*) AS total FROM kept GROUP BY 1),
p AS (
  SELECT w.week, c.d, c.h, COUNT(k.week) / ANY_VALUE(w.total) AS p
  FROM weeks w CROSS JOIN cells c LEFT JOIN kept k ON k.week = w.week AND k.d = c.d AND k.h = c.h GROUP BY w.week, c.d, c.h),
r AS (SELECT a.week, b.week AS other, corr(a.p, b.p) AS r FROM p a JOIN p b ON a.d = b.d AND a.h = b.h AND a.week <> b.week GROUP BY 1, 2)
SELECT 6 AS interval_hours, (SELECT COUNT(*) FROM weeks) AS weeks_ge_min_events, ROUND(AVG(r), 6) AS corr_mean,
  ROUND(stddev_samp(r), 6) AS corr_std, ROUND(MIN(r), 6) AS corr_min, ROUND(quantile_cont(r, 0.1), 6) AS corr_p10,
  ROUND(quantile_cont(r, 0.5), 6) AS corr_p50, ROUND(quantile_cont(r, 0.9), 6) AS corr_p90,
  (SELECT COUNT(DISTINCT (d, h)) FROM kept) AS active_cells
FROM r
"""),
)
def _(spark, folder):
    return profile.weekly_stability(clicks(spark, folder).event, 6)


@query(
    "attribute_completeness",
    on_orders("""
SELECT 'object_attr_customer' AS "table", c AS "column", COUNT(*) AS "rows", COUNT(v) AS non_null, ROUND(COUNT(v) / COUNT(*), 6) AS non_null_rate
FROM (
  SELECT 'status' AS c, status AS v FROM o_customer UNION ALL SELECT 'priority', CASE WHEN priority <> '5-LOW' THEN priority END FROM o_customer
  UNION ALL SELECT 'price', CASE WHEN status = 'F' THEN CAST(price AS VARCHAR) END FROM o_customer)
GROUP BY c
"""),
)
def _(spark, folder):
    log = orders(spark, folder)
    attrs = log["object_attr_customer"].withColumns(
        {
            "priority": F.when(F.col("priority") != "5-LOW", F.col("priority")),
            "price": F.when(F.col("status") == "F", F.col("price")),
        }
    )
    return profile.attribute_completeness(log.replace(object_attr_customer=attrs), "object")


@query(
    "table_overview",
    on_orders("""
SELECT 'event' AS "table", COUNT(*) AS "rows", 3 AS columns FROM o_event UNION ALL SELECT 'object', COUNT(*), 3 FROM o_object
UNION ALL SELECT 'e2o', COUNT(*), 4 FROM o_e2o UNION ALL SELECT 'object_attr_customer', COUNT(*), 5 FROM o_customer
"""),
)
def _(spark, folder):
    return profile.table_overview(orders(spark, folder))


_WINDOWS = """
, root AS (SELECT i::INTEGER AS root_index, TIMESTAMP '2024-01-02' + i * INTERVAL 37 HOUR AS root_time FROM (SELECT unnest(range(16)) AS i)),
delta AS (SELECT unnest([3600.0, 21600.0, 86400.0, 604800.0])::DOUBLE AS s),
sizes AS (
  SELECT r.root_index, r.root_time, d.s AS delta_seconds, ROUND(d.s / 86400, 6) AS delta_days,
    COUNT(DISTINCT l.event_id) AS event_count, COUNT(DISTINCT l.object_id) AS object_count
  FROM root r CROSS JOIN delta d LEFT JOIN c_e2o l ON l.time >= r.root_time AND l.time <= r.root_time + to_seconds(d.s)
  GROUP BY ALL)
"""


def roots(spark):
    """Every 37 hours, 16 times."""
    return spark.range(16).select((F.lit(datetime(2024, 1, 2)) + F.col("id").cast("int") * F.expr("INTERVAL '37' HOUR")).alias("time"))


@query("window_sizes", on_clicks(_WINDOWS + "SELECT * FROM sizes"))
def _(spark, folder):
    return profile.window_sizes(clicks(spark, folder), DELTAS, roots(spark))


_SAMPLED = """
, root AS (
  SELECT ROW_NUMBER() OVER (ORDER BY time)::INTEGER - 1 AS root_index, time AS root_time FROM (
    SELECT time FROM c_e2o ORDER BY md5('0|' || event_id || '|' || object_id || '|' || epoch_us(time)), event_id, object_id, time LIMIT 64)),
""" + _WINDOWS[_WINDOWS.index("delta AS") :]


@query("window_sizes_sampled", on_clicks(_SAMPLED + "SELECT * FROM sizes"))
def _(spark, folder):
    log = clicks(spark, folder)
    return profile.window_sizes(log, DELTAS, profile.sample_root_times(log))


@query(
    "window_size_bands",
    on_clicks(_WINDOWS + """
, long AS (
  SELECT delta_seconds, delta_days, 'event' AS metric, event_count AS size FROM sizes
  UNION ALL SELECT delta_seconds, delta_days, 'object', object_count FROM sizes),
band AS (
  SELECT delta_seconds, delta_days, metric, COUNT(*) AS n, AVG(size) AS mean, stddev_samp(size) AS std FROM long GROUP BY ALL)
SELECT delta_seconds, delta_days, metric, n, ROUND(mean, 6) AS mean, ROUND(std, 6) AS std, ROUND(std / sqrt(n), 6) AS sem,
  ROUND(mean - 1.959963984540054 * std / sqrt(n), 6) AS ci_lower, ROUND(mean + 1.959963984540054 * std / sqrt(n), 6) AS ci_upper
FROM band
"""),
)
def _(spark, folder):
    return profile.window_size_bands(profile.window_sizes(clicks(spark, folder), DELTAS, roots(spark)))


# -- timing ----------------------------------------------------------------


def _summary(groups: str, value: str, name: str, source: str) -> str:
    return (
        f"SELECT {groups}, COUNT({value}) AS n, ROUND(AVG({value}), 6) AS {name}_mean_hours, "
        f"ROUND(quantile_cont({value}, 0.5), 6) AS {name}_p50_hours, ROUND(quantile_cont({value}, 0.9), 6) AS {name}_p90_hours "
        f"FROM {source} WHERE {value} IS NOT NULL GROUP BY {groups}"
    )


def _hours(late: str, early: str) -> str:
    return f"(epoch_us({late}) - epoch_us({early})) / 3.6e9"


_FRAME = """
, frame AS (
  SELECT l.event_id, l.object_id, l.time AS activity_time, e.type AS event_type, e.time AS event_time, o.type AS object_type, o.time AS object_time
  FROM {e2o} l LEFT JOIN {event} e ON e.event_id = l.event_id LEFT JOIN {object} o ON o.object_id = l.object_id)
"""
_ORDER_FRAME = _FRAME.format(e2o="o_e2o", event="o_event", object="o_object")
_CLICK_FRAME = _FRAME.format(e2o="c_e2o", event="c_event", object="c_object")


@query("event_object_frame", on_clicks(_CLICK_FRAME + "SELECT * FROM frame"))
def _(spark, folder):
    return timing.event_object_frame(clicks(spark, folder))


@query(
    "age_at_event",
    on_orders(_ORDER_FRAME + f", v AS (SELECT *, {_hours('event_time', 'object_time')} AS v FROM frame) "
              + _summary("event_type, object_type", "v", "delta", "v")),
)
def _(spark, folder):
    return timing.age_at_event(orders(spark, folder))


@query(
    "oldest_objects",
    on_orders(_ORDER_FRAME + f"""
, ranked AS (
  SELECT event_type, CAST(ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY object_time, object_id) AS INTEGER) AS rank,
    {_hours('event_time', 'object_time')} AS v FROM frame),
kept AS (SELECT * FROM ranked WHERE rank <= 2)
""" + _summary("event_type, rank", "v", "delta", "kept")),
)
def _(spark, folder):
    return timing.oldest_objects(orders(spark, folder), k=2)


@query(
    "recent_activity",
    on_orders(_ORDER_FRAME + f"""
, v AS (
  SELECT event_type, object_type, {_hours('activity_time', 'LAG(activity_time) OVER (PARTITION BY object_id ORDER BY activity_time, event_id)')} AS v FROM frame)
""" + _summary("event_type, object_type", "v", "prev_delta", "v")),
)
def _(spark, folder):
    return timing.recent_activity(orders(spark, folder))


@query(
    "recent_k_activities",
    on_clicks(_CLICK_FRAME + f"""
, k AS (SELECT unnest(range(1, 6))::INTEGER AS lag_rank),
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY object_id ORDER BY activity_time, event_id) AS r FROM frame),
v AS (
  SELECT a.event_type, k.lag_rank, {_hours('a.activity_time', 'b.activity_time')} AS v
  FROM numbered a CROSS JOIN k JOIN numbered b ON b.object_id = a.object_id AND b.r = a.r - k.lag_rank)
""" + _summary("event_type, lag_rank", "v", "prev_delta", "v")),
)
def _(spark, folder):
    return timing.recent_k_activities(clicks(spark, folder))


@query(
    "grouped_quantiles",
    """
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, ROUND(quantile_cont(o_totalprice, 0.25), 6) AS q25,
  ROUND(quantile_cont(o_totalprice, 0.99), 6) AS q99
FROM orders GROUP BY ALL
""",
)
def _(spark, folder):
    return quantiles(
        table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"], F.col("o_totalprice"), {"q25": 0.25, "q99": 0.99}
    )


@query(
    "find_columns",
    on_clicks("""
SELECT 'event_attr_purchase' AS "table", 'value' AS "column", COUNT(value) AS filled FROM c_purchase
UNION ALL SELECT 'e2o', 'qualifier', COUNT(qualifier) FROM c_e2o UNION ALL SELECT 'o2o', 'qualifier', COUNT(qualifier) FROM c_o2o
"""),
)
def _(spark, folder):
    """Tables with columns of these names, in any case, and how many rows fill them."""
    log, counted = clicks(spark, folder), []
    for name, (kinds, _preview) in profile.find_columns(log, ["VALUE", "Qualifier"]).items():
        for column, _kind in kinds:
            filled = log[name].agg(F.count(column).alias("filled"))
            counted.append(filled.select(F.lit(name).alias("table"), F.lit(column).alias("column"), "filled"))
    return reduce(DataFrame.unionByName, counted)
