"""SQL of the two derived logs, as the common beginning of the check queries."""

from __future__ import annotations

_ITEM = "CONCAT('i', regexp_extract(props, '[0-9]+', 0))"
_SHIP_ID = (
    "CONCAT('l', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey, '_', "
    "EXTRACT(YEAR FROM l_shipdate) * 10000 + EXTRACT(MONTH FROM l_shipdate) * 100 + EXTRACT(DAY FROM l_shipdate))"
)

CLICKS = f"""
c_event AS (SELECT CONCAT('e', event_id) AS event_id, event_type AS type, ts AS time FROM events),
c_e2o AS (
  SELECT CONCAT('e', event_id) AS event_id, CONCAT('u', user_id) AS object_id, 'actor' AS qualifier, ts AS time FROM events
  UNION ALL SELECT CONCAT('e', event_id), {_ITEM}, 'target', ts FROM events),
c_object AS (
  SELECT CONCAT('u', user_id) AS object_id, 'user' AS type, MIN(ts) AS time FROM events GROUP BY ALL
  UNION ALL SELECT {_ITEM}, 'item', MIN(ts) FROM events GROUP BY ALL),
c_o2o AS (
  SELECT CONCAT('u', user_id) AS object_id_src, {_ITEM} AS object_id_dst, 'touched' AS qualifier, MIN(ts) AS time FROM events GROUP BY ALL),
c_purchase AS (SELECT CONCAT('e', event_id) AS event_id, value, ts AS time FROM events WHERE event_type = 'purchase'),
c_link AS (
  SELECT l.object_id, l.event_id, e.type, e.time, o.type AS object_type, o.time AS seen
  FROM c_e2o l JOIN c_event e ON e.event_id = l.event_id JOIN c_object o ON o.object_id = l.object_id),
c_grid AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-29', INTERVAL 1 DAY)) AS t)
"""

ORDERS = f"""
ship AS (
  SELECT {_SHIP_ID} AS event_id, l_orderkey, l_partkey, l_suppkey, l_shipdate, MIN(l_returnflag) AS flag
  FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate),
o_event AS (
  SELECT CONCAT('o', o_orderkey) AS event_id, CONCAT('order ', o_orderstatus) AS type, o_orderdate AS time FROM orders
  UNION ALL SELECT event_id, CONCAT('ship ', flag), l_shipdate FROM ship),
o_e2o AS (
  SELECT CONCAT('o', o_orderkey) AS event_id, CONCAT('cust', o_custkey) AS object_id, 'customer' AS qualifier, o_orderdate AS time FROM orders
  UNION ALL SELECT CONCAT('o', o_orderkey), CONCAT('ord', o_orderkey), 'order', o_orderdate FROM orders
  UNION ALL SELECT event_id, CONCAT('ord', l_orderkey), 'order', l_shipdate FROM ship
  UNION ALL SELECT event_id, CONCAT('part', l_partkey), 'part', l_shipdate FROM ship
  UNION ALL SELECT event_id, CONCAT('supp', l_suppkey), 'supplier', l_shipdate FROM ship),
o_object AS (
  SELECT CONCAT('cust', o_custkey) AS object_id, 'customer' AS type, MIN(o_orderdate) AS time FROM orders GROUP BY ALL
  UNION ALL SELECT CONCAT('ord', o_orderkey), 'order', LEAST(MIN(o_orderdate), MIN(l_shipdate))
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
  UNION ALL SELECT CONCAT('part', l_partkey), 'part', MIN(l_shipdate) FROM lineitem GROUP BY ALL
  UNION ALL SELECT CONCAT('supp', l_suppkey), 'supplier', MIN(l_shipdate) FROM lineitem GROUP BY ALL),
o_o2o_raw AS (
  SELECT CONCAT('ord', o_orderkey) AS object_id_src, CONCAT('cust', o_custkey) AS object_id_dst, 'placed by' AS qualifier FROM orders
  UNION ALL SELECT DISTINCT CONCAT('ord', l_orderkey), CONCAT('part', l_partkey), 'comprises' FROM lineitem),
o_customer AS (
  SELECT CONCAT('cust', o_custkey) AS object_id, o_orderdate AS time, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders),
o_part_raw AS (
  SELECT CONCAT('part', p_partkey) AS object_id, p_brand AS brand, p_size AS size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
o_link AS (
  SELECT l.object_id, l.event_id, e.type, e.time, o.type AS object_type, o.time AS seen
  FROM o_e2o l JOIN o_event e ON e.event_id = l.event_id JOIN o_object o ON o.object_id = l.object_id),
o_grid AS (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2000-12-31', INTERVAL 30 DAY)) AS t)
"""


def on_clicks(body: str) -> str:
    return f"WITH {CLICKS.strip()}{body}"


def on_orders(body: str) -> str:
    return f"WITH {ORDERS.strip()}{body}"


def recursive(body: str) -> str:
    """As `on_clicks`, for bodies with a table that refers to itself."""
    return on_clicks(body).replace("WITH ", "WITH RECURSIVE ", 1)
