"""Ingest, validation, vocabulary and whole-log transforms on the sample tables."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import normalize_token, unix_seconds
from ..functions.ordered import number_rows
from ..model import ObjectLog
from ..operators import components, graph, profile, transform, validate, vocab
from ..session import cut_lineage, shared_folder
from ..sources import fixtures, json_docs, normalize, store
from ..sources.fixtures import clicks, orders, table
from .recipes import BASE_ROLES, Recipe
from .registry import query
from .views import on_clicks, on_orders


def _rows(log: ObjectLog, *tables: str) -> DataFrame:
    """All rows of the core tables in one shape."""
    shapes = {
        "event": ("event_id", "type"),
        "object": ("object_id", "type"),
        "e2o": ("event_id", "object_id"),
        "o2o": ("object_id_src", "object_id_dst"),
    }
    parts = []
    for name in tables:
        first, second = shapes.get(name, (log[name].columns[0], log[name].columns[1]))
        parts.append(
            log[name].select(
                F.lit(name).alias("table"),
                F.col(first).cast("string").alias("id"),
                F.col(second).cast("string").alias("ref"),
                "time",
            )
        )
    return reduce(DataFrame.unionByName, parts)


# -- ingest ----------------------------------------------------------------


def _event_elements(spark: SparkSession, folder: str) -> DataFrame:
    """The clicks log as raw 2.0 elements: one JSON text per event and object."""
    log = clicks(spark, folder)
    links = log.e2o.groupBy("event_id").agg(
        F.collect_list(F.to_json(F.struct(F.col("object_id").alias("objectId"), "qualifier"))).alias("relationships")
    )
    value = table(spark, folder, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), "value", "user_id"
    )
    text = F.concat(
        F.lit('{"id":"'), "event_id", F.lit('","type":" '), "type", F.lit(' ","time":"'),
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('+02:00","relationships":[7,{"objectId":""},'),
        F.concat_ws(",", "relationships"),
        F.lit('],"attributes":[{"name":"value","value":0},{"name":"value","value":'), F.col("value").cast("string"),
        F.lit('},{"name":"rank","value":'), F.col("user_id").cast("string"), F.lit('},{"value":1}]}'),
    )
    events = log.event.join(links, "event_id").join(value, "event_id").select(F.lit("event").alias("kind"), text.alias("raw"))
    touched = log["o2o"].groupBy(F.col("object_id_src").alias("object_id")).agg(
        F.collect_list(F.to_json(F.struct(F.col("object_id_dst").alias("objectId"), "qualifier"))).alias("relationships")
    )
    body = F.concat(
        F.lit('{"id":"'), "object_id", F.lit('","type":"'), "type", F.lit('","relationships":[{"objectId":"nobody"},null'),
        F.when(F.col("relationships").isNull(), "").otherwise(F.concat(F.lit(","), F.concat_ws(",", "relationships"))),
        F.lit('],"attributes":[{"name":"first","value":"'), F.col("time").cast("string"),
        F.lit('"},{"name":"level","value":1,"time":"2024-01-05 00:00:00"},{"name":"level","value":2,"time":"2024-01-05 00:00:00"}]}'),
    )
    objects = log.object.join(touched, "object_id", "left").select(F.lit("object").alias("kind"), body.alias("raw"))
    return events.unionByName(objects)


@query(
    "json_versions",
    """
SELECT event_id, CASE event_type WHEN 'view' THEN '2.0' WHEN 'click' THEN '1.0' WHEN 'signup' THEN '2.0' WHEN 'error' THEN '1.0' END AS version
FROM events
""",
)
def _(spark, folder):
    value = F.col("value").cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(F.lit('{"objectTypes":[],"x":'), value, F.lit(',"eventTypes":[{"name":"ocel:global-log"}]}')))
        .when(kind == "click", F.concat(F.lit('{"ocel:global-log":{"v":'), value, F.lit('},"ocel:events":{}}')))
        .when(kind == "signup", F.concat(F.lit('{"eventTypes":[],"objectTypes":[],"ocel:global-log":'), value, F.lit("}")))
        .when(kind == "error", F.concat(F.lit('{"eventTypes":[],"ocel:global-log":'), value, F.lit(',"objectTypes":[]}')))
        .otherwise(F.concat(F.lit('{"events":['), value, F.lit("]}")))
    )
    return table(spark, folder, "events").select("event_id", json_docs.version_of(text).alias("version"))


@query(
    "store_round_trip",
    on_clicks("""
SELECT 'event' AS "table", event_id AS id, type AS ref, time FROM c_event
UNION ALL SELECT 'object', object_id, type, time FROM c_object
UNION ALL SELECT 'e2o', event_id, object_id, time FROM c_e2o WHERE time < TIMESTAMP '2024-01-11'
UNION ALL SELECT 'o2o', object_id_src, object_id_dst, time FROM c_o2o
"""),
)
def _(spark, folder):
    path = f"{shared_folder(spark)}/clicks-{uuid4().hex}"
    store.save(clicks(spark, folder), path)
    whole = store.load(spark, path)
    part = store.load(spark, path, until=date(2024, 1, 10))
    return _rows(whole.replace(e2o=part.e2o), "event", "object", "e2o", "o2o")


@query(
    "json2_tables",
    on_clicks("""
SELECT 'event' AS "table", event_id AS id, type AS ref, CAST(NULL AS VARCHAR) AS qualifier FROM c_event
UNION ALL SELECT 'object', object_id, type, NULL FROM c_object
UNION ALL SELECT 'e2o', event_id, object_id, qualifier FROM c_e2o
UNION ALL SELECT 'o2o', object_id_src, object_id_dst, qualifier FROM c_o2o
"""),
)
def _(spark, folder):
    raw = json_docs.raw_tables_2(_event_elements(spark, folder))
    none = F.lit(None).cast("string").alias("qualifier")
    return (
        raw.event.select(F.lit("event").alias("table"), F.col("event_id").alias("id"), F.col("type").alias("ref"), none)
        .unionByName(raw.object.select(F.lit("object").alias("table"), F.col("object_id").alias("id"), F.col("type").alias("ref"), none))
        .unionByName(raw.e2o.select(F.lit("e2o").alias("table"), F.col("event_id").alias("id"), F.col("object_id").alias("ref"), "qualifier"))
        .unionByName(raw.o2o.select(F.lit("o2o").alias("table"), F.col("object_id_src").alias("id"), F.col("object_id_dst").alias("ref"), "qualifier"))
    )


#: Lines of a document; more lines make more documents.
_DOCUMENT = 50_000


def _documents(spark: SparkSession, lines: DataFrame, parts: dict[int, str], documents: int = 3) -> str:
    """Write documents below a folder: `lines` (place, line) dealt out by hash, with a fixed text at each place of `parts`.

    At least `documents` of them, and as many as there are times _DOCUMENT lines: a text file is written by one task.
    """
    path = f"{shared_folder(spark)}/documents-{uuid4().hex}"
    lines = cut_lineage(lines)
    documents = max(documents, -(-lines.count() // _DOCUMENT))
    fixed = F.array(*[F.struct(F.lit(at).alias("place"), F.lit(text).alias("line")) for at, text in parts.items()])
    frame = spark.range(documents).select(F.col("id").cast("int").alias("document"), F.inline(fixed))
    dealt = lines.select(F.pmod(F.hash("line"), F.lit(documents)).alias("document"), "place", "line")
    whole = frame.unionByName(dealt).repartition(documents, "document").sortWithinPartitions("document", "place").select("document", "line")
    whole.write.partitionBy("document").text(path)
    return path


@query(
    "read_log_2",
    on_clicks("""
, seen AS (SELECT object_id, type, LEAST(time, TIMESTAMP '2024-01-05') AS time FROM c_object)
SELECT 'event' AS "table", event_id AS id, type AS ref, time FROM c_event
UNION ALL SELECT 'object', object_id, type, time FROM seen
UNION ALL SELECT 'e2o', event_id, object_id, time FROM c_e2o
UNION ALL SELECT 'o2o', l.object_id_src, l.object_id_dst, GREATEST(s.time, d.time)
  FROM c_o2o l JOIN seen s ON s.object_id = l.object_id_src JOIN seen d ON d.object_id = l.object_id_dst
UNION ALL SELECT 'event_attr_purchase', event_id, CAST(user_id AS VARCHAR), ts FROM (SELECT CONCAT('e', event_id) AS event_id, user_id, ts FROM events WHERE event_type = 'purchase')
"""),
)
def _(spark, folder):
    """Documents of the 2.0 shape, written and read end to end: text, elements, tables, times, types."""
    place = F.when(F.col("kind") == "event", 1).otherwise(3).alias("place")
    lines = _event_elements(spark, folder).select(place, F.concat("raw", F.lit(",")).alias("line"))
    path = _documents(spark, lines, {0: '{"eventTypes":[],"objectTypes":[],"events":[', 2: 'null],"objects":[', 4: "null]}"})
    log = json_docs.read_log(spark, path)
    attrs = log["event_attr_purchase"].select("event_id", F.col("rank").cast("string").alias("rank"), "time")
    return _rows(log.replace(event_attr_purchase=attrs), "event", "object", "e2o", "o2o", "event_attr_purchase")


def _elements_1(spark: SparkSession, folder: str) -> DataFrame:
    """The clicks log in the 1.0 shape: (place, line) of its events and objects."""
    log = clicks(spark, folder)
    links = log.e2o.groupBy("event_id").agg(F.collect_list(F.to_json(F.struct(
        F.col("object_id").alias("ocel:oid"), F.col("qualifier").alias("ocel:qualifier")
    ))).alias("links"))
    value = table(spark, folder, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), "user_id")
    event = F.concat(
        F.lit('"'), "event_id", F.lit('":{"ocel:activity":"'), "type", F.lit('","ocel:timestamp":"'), F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        F.lit('","ocel:omap":[],"ocel:typedOmap":['), F.concat_ws(",", "links"), F.lit('],"ocel:vmap":{"rank":'), F.col("user_id").cast("string"), F.lit("}},"),
    )
    events = log.event.join(links, "event_id").join(value, "event_id").select(F.lit(1).alias("place"), event.alias("line"))
    body = F.concat(F.lit('"'), "object_id", F.lit('":{"ocel:type":"'), "type", F.lit('","ocel:ovmap":{}},'))
    return events.unionByName(log.object.select(F.lit(3).alias("place"), body.alias("line")))


@query(
    "read_log_1",
    on_clicks("""
SELECT 'event' AS "table", event_id AS id, type AS ref, time FROM c_event
UNION ALL SELECT 'object', object_id, type, time FROM c_object
UNION ALL SELECT 'e2o', event_id, object_id, time FROM c_e2o
UNION ALL SELECT 'event_attr_click', event_id, CAST(user_id AS VARCHAR), ts FROM (SELECT CONCAT('e', event_id) AS event_id, user_id, ts FROM events WHERE event_type = 'click')
"""),
)
def _(spark, folder):
    """Documents of the 1.0 shape, written and read end to end."""
    parts = {0: '{"ocel:global-log":{"ocel:version":"1.0"},"ocel:events":{', 2: '"_":null},"ocel:objects":{', 4: '"_":null}}'}
    log = json_docs.read_log(spark, _documents(spark, _elements_1(spark, folder), parts))
    attrs = log["event_attr_click"].select("event_id", F.col("rank").cast("string").alias("rank"), "time")
    return _rows(log.replace(event_attr_click=attrs), "event", "object", "e2o", "event_attr_click")


@query(
    "json2_event_attributes",
    on_clicks("""
SELECT CONCAT('e', event_id) AS event_id, event_type AS type, ROUND(value, 6) AS value, user_id AS rank FROM events
"""),
)
def _(spark, folder):
    raw = json_docs.raw_tables_2(_event_elements(spark, folder))
    wide = json_docs.wide_tables(raw.event_attributes, ["event_id"])
    return reduce(
        DataFrame.unionByName,
        [df.select("event_id", F.lit(kind).alias("type"), "value", "rank") for kind, df in wide.items()],
    )


@query(
    "json2_object_attributes",
    on_clicks("""
SELECT object_id, CAST(NULL AS VARCHAR) AS at, CAST(time AS VARCHAR) AS first, CAST(NULL AS DOUBLE) AS level FROM c_object
UNION ALL SELECT object_id, '2024-01-05 00:00:00', NULL, 2.0 FROM c_object
"""),
)
def _(spark, folder):
    raw = json_docs.raw_tables_2(_event_elements(spark, folder))
    wide = json_docs.wide_tables(raw.object_attributes, ["object_id", "time"])
    return reduce(
        DataFrame.unionByName,
        [df.select("object_id", F.col("time").alias("at"), "first", "level") for df in wide.values()],
    )


@query(
    "json1_tables",
    on_clicks("""
SELECT 'event' AS "table", event_id AS id, type AS ref, CAST(NULL AS VARCHAR) AS qualifier FROM c_event
UNION ALL SELECT 'object', object_id, type, NULL FROM c_object
UNION ALL SELECT 'e2o', l.event_id, l.object_id, CASE WHEN e.type = 'error' THEN '__INVALID__' ELSE l.qualifier END
  FROM c_e2o l JOIN c_event e ON e.event_id = l.event_id
UNION ALL SELECT 'attr', CONCAT('e', event_id), CAST(ROUND(value * 100) AS BIGINT)::VARCHAR, event_type FROM events
"""),
)
def _(spark, folder):
    log = clicks(spark, folder)
    typed = F.to_json(F.struct(F.col("object_id").alias("ocel:oid"), F.col("qualifier").alias("ocel:qualifier")))
    links = log.e2o.groupBy("event_id").agg(
        F.collect_list(typed).alias("typed"), F.collect_list(F.to_json(F.array("object_id"))).alias("plain")
    )
    cents = table(spark, folder, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        F.round(F.col("value") * 100).cast("long").cast("string").alias("cents"),
    )
    ids = F.regexp_replace(F.concat_ws(",", "plain"), r"[\[\]]", "")
    text = F.concat(
        F.lit('{"ocel:activity":"'), "type", F.lit('","ocel:timestamp":"'), F.col("time").cast("string"), F.lit('",'),
        F.when(F.col("type") == "error", F.concat(F.lit('"ocel:omap":['), ids)).otherwise(
            F.concat(F.lit('"ocel:typedOmap":['), F.concat_ws(",", "typed"))
        ),
        F.lit('],"ocel:vmap":{"cents":'), "cents", F.lit("}}"),
    )
    events = log.event.join(links, "event_id").join(cents, "event_id").select(
        F.lit("event").alias("kind"), F.col("event_id").alias("id"), text.alias("raw")
    )
    objects = log.object.select(
        F.lit("object").alias("kind"), F.col("object_id").alias("id"),
        F.to_json(F.struct(F.col("type").alias("ocel:type"))).alias("raw"),
    )
    raw = json_docs.raw_tables_1(events.unionByName(objects))
    none = F.lit(None).cast("string").alias("qualifier")
    return (
        raw.event.select(F.lit("event").alias("table"), F.col("event_id").alias("id"), F.col("type").alias("ref"), none)
        .unionByName(raw.object.select(F.lit("object").alias("table"), F.col("object_id").alias("id"), F.col("type").alias("ref"), none))
        .unionByName(raw.e2o.select(F.lit("e2o").alias("table"), F.col("event_id").alias("id"), F.col("object_id").alias("ref"), "qualifier"))
        .unionByName(
            raw.event_attributes.where("name = 'cents' AND kind = 'BIGINT'").select(
                F.lit("attr").alias("table"), F.col("event_id").alias("id"), F.col("value").alias("ref"), F.col("type").alias("qualifier")
            )
        )
    )


@query(
    "json_declared_types",
    on_clicks("SELECT 'event' AS entity, type FROM c_event GROUP BY type UNION ALL SELECT 'object', type FROM c_object GROUP BY type"),
)
def _(spark, folder):
    elements = _event_elements(spark, folder)
    return reduce(
        DataFrame.unionByName,
        [
            json_docs.declared_types(elements, e).select(F.lit(e).alias("entity"), F.trim("type").alias("type"))
            for e in ("event", "object")
        ],
    )


@query(
    "token_normalize",
    """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '__INVALID__' ELSE CONCAT(c_mktsegment, '_', c_nationkey) END AS token
FROM customer
""",
)
def _(spark, folder):
    raw = F.when(F.col("c_acctbal") < 0, "  ").otherwise(
        F.concat(F.lit("\t "), "c_mktsegment", F.lit("|"), F.col("c_nationkey").cast("string"), F.lit(" "))
    )
    return table(spark, folder, "customer").select("c_custkey", normalize_token(raw).alias("token"))


@query(
    "time_to_unix_seconds",
    """
SELECT event_id, CASE WHEN value < 1 THEN -9223372036854775808 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS seconds FROM events
""",
)
def _(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", unix_seconds(F.when(F.col("value") >= 1, F.col("ts"))).alias("seconds")
    )


@query(
    "parse_time_uniform",
    """
SELECT event_id, date_trunc('second', ts) AS time FROM events
""",
)
def _(spark, folder):
    text = F.date_format("ts", "dd-MM-yyyy HH:mm:ss")
    return normalize.parse_time(table(spark, folder, "events").select("event_id", text.alias("time")))


@query(
    "parse_time_zoned",
    "SELECT event_id, ts AS time FROM events",
)
def _(spark, folder):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("value") > 50, "+05:30").otherwise("Z"))
    return normalize.parse_time(table(spark, folder, "events").select("event_id", text.alias("time")))


@query(
    "parse_time_mixed",
    """
SELECT event_id, CASE event_type
  WHEN 'view' THEN ts
  WHEN 'click' THEN date_trunc('second', ts)
  WHEN 'purchase' THEN date_trunc('second', ts)
  WHEN 'signup' THEN date_trunc('day', ts) END AS time
FROM events
""",
)
def _(spark, folder):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
        .when(kind == "click", F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
        .when(kind == "purchase", F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
        .when(kind == "signup", F.date_format("ts", "yyyy-MM-dd"))
        .otherwise("not a time")
    )
    return normalize.parse_time(table(spark, folder, "events").select("event_id", text.alias("time")))


@query(
    "infer_object_time",
    on_orders("""
, start AS (SELECT MIN(time) AS t FROM o_event WHERE time >= TIMESTAMP '1996-01-01'),
linked AS (
  SELECT l.object_id, MIN(e.time) AS t FROM o_e2o l JOIN o_event e ON e.event_id = l.event_id
  WHERE e.time >= TIMESTAMP '1996-01-01' GROUP BY 1),
attr AS (SELECT object_id, MIN(time) FILTER (WHERE time >= (SELECT t FROM start)) AS t, MIN(time) AS anytime FROM o_customer GROUP BY 1)
SELECT o.object_id, o.type,
  COALESCE(CASE WHEN o.type = 'supplier' THEN o.time END, LEAST(linked.t, attr.t), attr.anytime) AS time
FROM o_object o LEFT JOIN linked ON linked.object_id = o.object_id LEFT JOIN attr ON attr.object_id = o.object_id
"""),
)
def _(spark, folder):
    log = orders(spark, folder)
    late = log.event.where(F.col("time") >= F.lit(datetime(1996, 1, 1)).cast("timestamp_ntz"))
    bare = log.object.withColumn("time", F.when(F.col("type") == "supplier", F.col("time")))
    return normalize.infer_object_time(bare, late, log.e2o, [log["object_attr_customer"]])


@query(
    "fill_object_attributes",
    on_orders("""
, raw AS (
  SELECT c.object_id, CASE WHEN c.price < 250000 THEN c.time ELSE o.time END AS time,
    CASE WHEN c.priority <> '5-LOW' THEN c.priority END AS priority, CASE WHEN c.status = 'F' THEN c.price END AS price, c.price AS ord
  FROM o_customer c JOIN o_object o ON o.object_id = c.object_id)
SELECT object_id, time,
  last_value(priority IGNORE NULLS) OVER w AS priority, ROUND(last_value(price IGNORE NULLS) OVER w, 6) AS price, ROUND(ord, 6) AS ord
FROM raw WINDOW w AS (PARTITION BY object_id ORDER BY time, ord, priority ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""),
)
def _(spark, folder):
    log = orders(spark, folder)
    raw = log["object_attr_customer"].select(
        "object_id",
        F.when(F.col("price") < 250000, F.col("time")).alias("time"),
        F.when(F.col("priority") != "5-LOW", F.col("priority")).alias("priority"),
        F.when(F.col("status") == "F", F.col("price")).alias("price"),
        F.col("price").alias("ord"),
    )
    return normalize.fill_object_attributes(raw, log.object, ["ord", "priority"])


@query(
    "fill_part_attributes",
    on_orders("SELECT p.object_id, p.brand, p.size, o.time FROM o_part_raw p JOIN o_object o ON o.object_id = p.object_id"),
)
def _(spark, folder):
    raw = fixtures.orders_part_attributes_raw(spark, folder)
    return normalize.fill_object_attributes(raw, orders(spark, folder).object)


@query(
    "attach_link_times",
    on_orders("""
SELECT r.object_id_src, r.object_id_dst, r.qualifier, GREATEST(s.time, d.time) AS time
FROM o_o2o_raw r JOIN o_object s ON s.object_id = r.object_id_src JOIN o_object d ON d.object_id = r.object_id_dst
"""),
)
def _(spark, folder):
    return normalize.attach_link_time(fixtures.orders_o2o_raw(spark, folder), orders(spark, folder).object)


@query(
    "build_log",
    on_clicks("""
SELECT 'event' AS "table", event_id AS id, type AS ref, time FROM c_event
UNION ALL SELECT 'object', object_id, type, time FROM c_object
UNION ALL SELECT 'e2o', event_id, object_id, time FROM c_e2o
UNION ALL SELECT 'o2o', r.object_id_src, r.object_id_dst, GREATEST(s.time, d.time)
  FROM c_o2o r JOIN c_object s ON s.object_id = r.object_id_src JOIN c_object d ON d.object_id = r.object_id_dst
UNION ALL SELECT 'event_attr_purchase', event_id, CAST(value AS VARCHAR), time FROM c_purchase
"""),
)
def _(spark, folder):
    log = clicks(spark, folder)
    built = normalize.build_log(
        log.event.withColumn("time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        log.object.drop("time"),
        log.e2o.drop("time"),
        log["o2o"].drop("time"),
        {"purchase": log["event_attr_purchase"].drop("time")},
    )
    return _rows(built, "event", "object", "e2o", "o2o", "event_attr_purchase")


@query(
    "normalize_dtypes",
    """
SELECT o_orderkey AS object_id, o_custkey AS event_id, CAST(ROUND(o_totalprice) AS BIGINT) AS price, o_orderdate AS time,
  o_orderstatus AS type, o_totalprice > 250000 AS large, ROUND(o_totalprice, 2) AS amount, 'bigint' AS key_type, 'int' AS price_type
FROM orders
""",
)
def _(spark, folder):
    dirty = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("double").alias("object_id"),
        F.col("o_custkey").cast("string").alias("event_id"),
        F.round("o_totalprice").cast("long").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.col("o_orderstatus").cast("binary").alias("type"),
        (F.col("o_totalprice") > 250000).alias("large"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )
    clean = normalize.normalize_table(dirty, "time")
    kinds = dict(clean.dtypes)
    return clean.withColumns(
        {"price": F.col("price").cast("long"), "key_type": F.lit(kinds["object_id"]), "price_type": F.lit(kinds["price"])}
    )


@query(
    "drop_thin_tables",
    on_orders("""
SELECT 'event' AS "table", COUNT(*) AS "rows", 3 AS columns FROM o_event
UNION ALL SELECT 'object', COUNT(*), 3 FROM o_object
UNION ALL SELECT 'e2o', COUNT(*), 4 FROM o_e2o
UNION ALL SELECT 'object_attr_customer', COUNT(*), 5 FROM o_customer WHERE price < 250000
"""),
)
def _(spark, folder):
    log = orders(spark, folder)
    attrs = log["object_attr_customer"]
    messy = log.replace(
        object_attr_customer=attrs.withColumn("time", F.when(F.col("price") < 250000, F.col("time"))),
        object_attr_supplier=log.object.where("type = 'supplier'").select("object_id", "time"),
        event_attr_none=log.event.select("event_id"),
    )
    return profile.table_overview(normalize.drop_thin(messy))


@query(
    "drop_attribute_columns",
    on_orders("SELECT object_id, time, priority FROM o_customer"),
)
def _(spark, folder):
    return normalize.drop_attributes(orders(spark, folder), {"price", "status", "type"})["object_attr_customer"]


@query(
    "number_rows",
    on_orders("SELECT event_id, time, ROW_NUMBER() OVER (ORDER BY time, event_id) - 1 AS row_id FROM o_event"),
)
def _(spark, folder):
    return number_rows(orders(spark, folder).event.select("event_id", "time"), ["time", "event_id"])


@query(
    "reindex_ids",
    on_clicks("""
, ev AS (SELECT event_id, ROW_NUMBER() OVER (ORDER BY time, event_id) - 1 AS n FROM c_event),
ob AS (SELECT object_id, ROW_NUMBER() OVER (ORDER BY time, object_id) - 1 AS n FROM c_object)
SELECT ev.n AS event_id, ob.n AS object_id, l.qualifier, l.time
FROM c_e2o l JOIN ev ON ev.event_id = l.event_id JOIN ob ON ob.object_id = l.object_id
"""),
)
def _(spark, folder):
    return graph.reindex(clicks(spark, folder)).e2o


# -- validation ------------------------------------------------------------


def broken_clicks(spark: SparkSession, folder: str) -> ObjectLog:
    """The clicks log with null types, repeated events and missing items."""
    log = clicks(spark, folder)
    late = F.lit(datetime(2024, 1, 1, 12)).cast("timestamp_ntz")
    again = log.event.where("type = 'error'")
    event = log.event.withColumn("type", F.when(F.second("time") > 0, F.col("type"))).unionByName(again)
    return log.replace(event=event, object=log.object.where((F.col("type") == "user") | (F.col("time") < late)))


_BROKEN = """
, b_event AS (
  SELECT event_id, CASE WHEN EXTRACT(SECOND FROM time) > 0 THEN type END AS type, time FROM c_event
  UNION ALL SELECT event_id, type, time FROM c_event WHERE type = 'error'),
b_object AS (SELECT * FROM c_object WHERE type = 'user' OR time < TIMESTAMP '2024-01-01 12:00:00')
"""
_NULLS = """
SELECT 'event' AS "table", 'event_id' AS "column", COUNT(*) FILTER (WHERE event_id IS NULL) AS n_bad FROM b_event
UNION ALL SELECT 'event', 'type', COUNT(*) FILTER (WHERE type IS NULL) FROM b_event
UNION ALL SELECT 'object', 'object_id', COUNT(*) FILTER (WHERE object_id IS NULL) FROM b_object
UNION ALL SELECT 'object', 'type', COUNT(*) FILTER (WHERE type IS NULL) FROM b_object
UNION ALL SELECT 'e2o', 'event_id', COUNT(*) FILTER (WHERE event_id IS NULL) FROM c_e2o
UNION ALL SELECT 'e2o', 'object_id', COUNT(*) FILTER (WHERE object_id IS NULL) FROM c_e2o
UNION ALL SELECT 'e2o', 'qualifier', COUNT(*) FILTER (WHERE qualifier IS NULL) FROM c_e2o
UNION ALL SELECT 'o2o', 'object_id_src', COUNT(*) FILTER (WHERE object_id_src IS NULL) FROM c_o2o
UNION ALL SELECT 'o2o', 'object_id_dst', COUNT(*) FILTER (WHERE object_id_dst IS NULL) FROM c_o2o
"""


@query("validate_nulls", on_clicks(_BROKEN + _NULLS))
def _(spark, folder):
    return validate.null_counts(broken_clicks(spark, folder))


@query(
    "validate_unique",
    on_clicks(_BROKEN + "SELECT event_id, COUNT(*) AS n_rows FROM b_event GROUP BY event_id HAVING COUNT(*) > 1"),
)
def _(spark, folder):
    return validate.duplicate_keys(broken_clicks(spark, folder), "event")


@query(
    "validate_references",
    on_clicks(_BROKEN + "SELECT DISTINCT object_id AS id FROM c_e2o WHERE object_id NOT IN (SELECT object_id FROM b_object)"),
)
def _(spark, folder):
    return validate.dangling(broken_clicks(spark, folder), "e2o", "object_id", "object", "object_id")


@query(
    "validate_log",
    on_clicks(_BROKEN + f"""
SELECT 'non_null' AS rule, "table", "column", n_bad, '' AS sample FROM ({_NULLS})
UNION ALL SELECT 'unique', 'event', 'event_id', COUNT(*), COALESCE(string_agg(event_id, ',' ORDER BY event_id) FILTER (WHERE r <= 5), '')
  FROM (SELECT event_id, ROW_NUMBER() OVER (ORDER BY event_id) AS r FROM (SELECT event_id FROM b_event GROUP BY 1 HAVING COUNT(*) > 1))
UNION ALL SELECT 'unique', 'object', 'object_id', COUNT(*), '' FROM (SELECT object_id FROM b_object GROUP BY 1 HAVING COUNT(*) > 1)
UNION ALL SELECT 'reference', 'e2o', 'event_id', COUNT(*), '' FROM (SELECT event_id FROM c_e2o EXCEPT SELECT event_id FROM b_event)
UNION ALL SELECT 'reference', 'e2o', 'object_id', COUNT(*), COALESCE(string_agg(id, ',' ORDER BY id) FILTER (WHERE r <= 5), '')
  FROM (SELECT id, ROW_NUMBER() OVER (ORDER BY id) AS r FROM (SELECT object_id AS id FROM c_e2o EXCEPT SELECT object_id FROM b_object))
UNION ALL SELECT 'reference', 'o2o', 'object_id_src', COUNT(*), '' FROM (SELECT object_id_src FROM c_o2o EXCEPT SELECT object_id FROM b_object)
UNION ALL SELECT 'reference', 'o2o', 'object_id_dst', COUNT(*), COALESCE(string_agg(id, ',' ORDER BY id) FILTER (WHERE r <= 5), '')
  FROM (SELECT id, ROW_NUMBER() OVER (ORDER BY id) AS r FROM (SELECT object_id_dst AS id FROM c_o2o EXCEPT SELECT object_id FROM b_object))
"""),
)
def _(spark, folder):
    found = validate.validate(broken_clicks(spark, folder))
    return found.withColumn("sample", F.concat_ws(",", "sample"))


# -- vocabulary ------------------------------------------------------------


@query(
    "entity_counts",
    on_orders("SELECT (SELECT COUNT(DISTINCT event_id) FROM o_event) AS num_events, (SELECT COUNT(DISTINCT object_id) FROM o_object) AS num_objects"),
)
def _(spark, folder):
    log = orders(spark, folder)
    n = vocab.entity_count(log, "object").scalar()
    return vocab.entity_count(log, "event").select("num_events", n.alias("num_objects"))


@query(
    "types_all",
    on_orders("SELECT 'event' AS entity, type FROM o_event GROUP BY type UNION ALL SELECT 'object', type FROM o_object GROUP BY type"),
)
def _(spark, folder):
    log = orders(spark, folder)
    return reduce(
        DataFrame.unionByName, [vocab.types(log, e).withColumn("entity", F.lit(e)) for e in ("event", "object")]
    )


@query(
    "types_linked",
    on_orders("""
SELECT DISTINCT 'event' AS entity, type FROM o_link WHERE object_type IN ('customer', 'supplier')
UNION ALL SELECT DISTINCT 'object', object_type FROM o_link WHERE type = 'ship A'
"""),
)
def _(spark, folder):
    log = orders(spark, folder)
    events = vocab.types(log, "event", ["customer", "supplier"]).withColumn("entity", F.lit("event"))
    return events.unionByName(vocab.types(log, "object", "ship A").withColumn("entity", F.lit("object")))


@query(
    "max_lifetime",
    on_orders("""
SELECT ROUND(MAX(epoch(last) - epoch(seen)), 6) AS max_seconds
FROM (SELECT object_id, seen, MAX(time) AS last FROM o_link WHERE object_type = 'customer' GROUP BY ALL)
"""),
)
def _(spark, folder):
    return vocab.max_lifetime(orders(spark, folder), "customer")


@query(
    "max_interevent",
    on_clicks("""
SELECT ROUND(MAX(epoch_us(time) - epoch_us(prev)) / 1e6, 6) AS max_seconds
FROM (SELECT time, LAG(time) OVER (PARTITION BY object_id ORDER BY time, event_id) AS prev FROM c_link WHERE object_type = 'user')
"""),
)
def _(spark, folder):
    return vocab.max_interevent(clicks(spark, folder), "user")


@query(
    "describe_types",
    on_clicks("""
SELECT t.type, CASE WHEN t.type <> 'error' THEN CONCAT('A visitor event of kind ', t.type) END AS description
FROM (SELECT DISTINCT type FROM c_event) t
"""),
)
def _(spark, folder):
    log = clicks(spark, folder)
    texts = log.event.where("type <> 'error'").select("type").distinct().withColumn(
        "description", F.concat(F.lit("A visitor event of kind "), "type")
    )
    return vocab.describe_types(log, "event", texts)


@query(
    "column_roles",
    on_orders("""
SELECT 'event' AS "table", 'event_id' AS "column", 'numerical' AS role, COUNT(event_id) AS non_null FROM o_event
UNION ALL SELECT 'event', 'type', 'categorical', COUNT(type) FROM o_event
UNION ALL SELECT 'event', 'time', 'timestamp', COUNT(time) FROM o_event
UNION ALL SELECT 'object', 'object_id', 'numerical', COUNT(object_id) FROM o_object
UNION ALL SELECT 'object', 'type', 'categorical', COUNT(type) FROM o_object
UNION ALL SELECT 'object', 'time', 'timestamp', COUNT(time) FROM o_object
UNION ALL SELECT 'e2o', 'event_id', 'numerical', COUNT(event_id) FROM o_e2o
UNION ALL SELECT 'e2o', 'object_id', 'numerical', COUNT(object_id) FROM o_e2o
UNION ALL SELECT 'e2o', 'qualifier', 'categorical', COUNT(qualifier) FROM o_e2o
UNION ALL SELECT 'e2o', 'time', 'timestamp', COUNT(time) FROM o_e2o
UNION ALL SELECT 'object_attr_customer', 'object_id', 'text', COUNT(object_id) FROM o_customer
UNION ALL SELECT 'object_attr_customer', 'time', 'timestamp', COUNT(time) FROM o_customer
UNION ALL SELECT 'object_attr_customer', 'status', 'categorical', COUNT(status) FROM o_customer
UNION ALL SELECT 'object_attr_customer', 'priority', 'categorical', COUNT(priority) FROM o_customer
UNION ALL SELECT 'object_attr_customer', 'price', 'numerical', COUNT(price) FROM o_customer
UNION ALL SELECT 'object_attr_customer', 'note', 'text', 0
"""),
)
def _(spark, folder):
    log = orders(spark, folder)
    log = log.replace(
        object_attr_customer=log["object_attr_customer"].withColumn(
            "note", F.when(F.col("price") < 0, F.col("priority"))
        )
    )
    overrides = {**BASE_ROLES, "object_attr_*": {"note": "categorical", "status": "categorical"}}
    return vocab.column_roles(log, overrides)


# -- transforms ------------------------------------------------------------


@query(
    "from_event_time",
    on_clicks("""
, k AS (SELECT * FROM c_event WHERE time >= TIMESTAMP '2024-01-28 06:00:00'),
l AS (SELECT * FROM c_e2o WHERE event_id IN (SELECT event_id FROM k)),
o AS (SELECT * FROM c_object WHERE object_id IN (SELECT object_id FROM l))
SELECT 'event' AS "table", event_id AS id, type AS ref, time FROM k
UNION ALL SELECT 'object', object_id, type, time FROM o
UNION ALL SELECT 'e2o', event_id, object_id, time FROM l
UNION ALL SELECT 'o2o', object_id_src, object_id_dst, time FROM c_o2o
  WHERE object_id_src IN (SELECT object_id FROM o) AND object_id_dst IN (SELECT object_id FROM o)
UNION ALL SELECT 'event_attr_purchase', event_id, CAST(value AS VARCHAR), time FROM c_purchase WHERE event_id IN (SELECT event_id FROM k)
"""),
)
def _(spark, folder):
    log = transform.from_event_time(clicks(spark, folder), datetime(2024, 1, 28, 6))
    return _rows(log, "event", "object", "e2o", "o2o", "event_attr_purchase")


@query(
    "upto_event_time",
    on_orders("""
, k AS (SELECT * FROM o_event WHERE time <= TIMESTAMP '1995-03-01'),
l AS (SELECT * FROM o_e2o WHERE event_id IN (SELECT event_id FROM k))
SELECT 'event' AS "table", event_id AS id, type AS ref, time FROM k
UNION ALL SELECT 'object', object_id, type, time FROM o_object WHERE object_id IN (SELECT object_id FROM l)
UNION ALL SELECT 'e2o', event_id, object_id, time FROM l
UNION ALL SELECT 'object_attr_customer', object_id, status, time FROM o_customer WHERE object_id IN (SELECT object_id FROM l)
"""),
)
def _(spark, folder):
    log = transform.upto_event_time(orders(spark, folder), datetime(1995, 3, 1))
    attrs = log["object_attr_customer"].select("object_id", "status", "time")
    return _rows(log.replace(object_attr_customer=attrs), "event", "object", "e2o", "object_attr_customer")


def doubled_clicks(spark: SparkSession, folder: str) -> ObjectLog:
    """The clicks log with a second link, under another role, for purchases."""
    log = clicks(spark, folder)
    bought = log.event.where("type = 'purchase'").select("event_id")
    again = log.e2o.where("qualifier = 'actor'").join(bought, "event_id", "left_semi")
    return log.replace(e2o=log.e2o.unionByName(again.withColumn("qualifier", F.lit("buyer"))))


_DOUBLED = """
, d_e2o AS (
  SELECT * FROM c_e2o UNION ALL
  SELECT l.event_id, l.object_id, 'buyer', l.time FROM c_e2o l JOIN c_event e ON e.event_id = l.event_id
  WHERE e.type = 'purchase' AND l.qualifier = 'actor'),
d_link AS (
  SELECT l.object_id, l.event_id, e.type, e.time, o.type AS object_type
  FROM d_e2o l JOIN c_event e ON e.event_id = l.event_id JOIN c_object o ON o.object_id = l.object_id)
"""


@query(
    "flatten_to_type",
    on_clicks(_DOUBLED + """
, m AS (
  SELECT l.event_id AS old, l.object_id, CONCAT(l.event_id, '::', l.object_id, '::',
    ROW_NUMBER() OVER (PARTITION BY l.event_id, l.object_id ORDER BY l.qualifier)) AS event_id
  FROM d_e2o l JOIN c_object o ON o.object_id = l.object_id WHERE o.type = 'user')
SELECT 'event' AS "table", m.event_id AS id, e.type AS ref, e.time FROM c_event e JOIN m ON m.old = e.event_id
UNION ALL SELECT 'object', object_id, type, time FROM c_object WHERE type = 'user'
UNION ALL SELECT 'e2o', m.event_id, l.object_id, l.time FROM d_e2o l JOIN m ON m.old = l.event_id AND m.object_id = l.object_id
UNION ALL SELECT 'event_attr_purchase', m.event_id, CAST(p.value AS VARCHAR), p.time FROM c_purchase p JOIN m ON m.old = p.event_id
"""),
)
def _(spark, folder):
    flat = transform.flatten(doubled_clicks(spark, folder), "user")
    return _rows(flat, "event", "object", "e2o", "event_attr_purchase")


@query(
    "flatten_to_types",
    on_orders("""
, m AS (
  SELECT l.event_id AS old, l.object_id, l.time, CONCAT(l.event_id, '::', l.object_id, '::1') AS event_id
  FROM o_e2o l JOIN o_object o ON o.object_id = l.object_id WHERE o.type IN ('customer', 'part'))
SELECT 'event' AS "table", m.event_id AS id, e.type AS ref, e.time FROM o_event e JOIN m ON m.old = e.event_id
UNION ALL SELECT 'e2o', event_id, object_id, time FROM m
UNION ALL SELECT 'object_attr_customer', object_id, status, time FROM o_customer
"""),
)
def _(spark, folder):
    log = orders(spark, folder)
    attrs = log["object_attr_customer"].select("object_id", "status", "time")
    flat = transform.flatten(log.replace(object_attr_customer=attrs), ("customer", "part"))
    return _rows(flat, "event", "e2o", "object_attr_customer")


@query(
    "split_events",
    on_orders("""
, n AS (SELECT event_id, COUNT(*) AS k FROM o_e2o GROUP BY 1)
SELECT CASE WHEN n.k > 1 THEN CONCAT(e.event_id, ':', l.object_id) ELSE e.event_id END AS event_id, e.type, e.time
FROM o_event e LEFT JOIN o_e2o l ON l.event_id = e.event_id LEFT JOIN n ON n.event_id = e.event_id
"""),
)
def _(spark, folder):
    return transform.split_events(orders(spark, folder)).event


@query(
    "project_to_type",
    on_orders("""
SELECT 'event' AS "table", event_id AS id, type AS ref, time FROM o_event
  WHERE event_id IN (SELECT event_id FROM o_e2o WHERE starts_with(object_id, 'supp'))
UNION ALL SELECT 'object', object_id, type, time FROM o_object WHERE type = 'supplier'
UNION ALL SELECT 'e2o', event_id, object_id, time FROM o_e2o WHERE starts_with(object_id, 'supp')
"""),
)
def _(spark, folder):
    return _rows(transform.project(orders(spark, folder), "supplier"), "event", "object", "e2o")


@query(
    "event_objects",
    on_orders("""
SELECT event_id, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY object_id) - 1 AS position, object_id FROM o_e2o
"""),
)
def _(spark, folder):
    return transform.event_objects(orders(spark, folder))


@query(
    "nest_events",
    on_orders("""
SELECT e.event_id, e.type, e.time, COALESCE(string_agg(l.object_id, ',' ORDER BY l.object_id), '') AS objects
FROM o_event e LEFT JOIN o_e2o l ON l.event_id = e.event_id GROUP BY ALL
"""),
)
def _(spark, folder):
    nested = transform.nest(orders(spark, folder))
    return nested.withColumn("objects", F.concat_ws(",", "object_ids")).drop("object_ids")


def _customer_orders(spark: SparkSession, folder: str) -> ObjectLog:
    """The orders log with customers and orders only: a component for each customer."""
    log = orders(spark, folder)
    kinds = ["customer", "order"]
    return log.replace(
        object=log.object.where(F.col("type").isin(kinds)), e2o=log.e2o.where(F.col("qualifier").isin(kinds))
    )


_REACH = """
, hub AS (SELECT event_id, MIN(object_id) AS hub FROM {links} GROUP BY 1),
edge AS MATERIALIZED (
  SELECT l.object_id AS a, h.hub AS b FROM {links} l JOIN hub h ON h.event_id = l.event_id WHERE l.object_id <> h.hub
  UNION SELECT h.hub, l.object_id FROM {links} l JOIN hub h ON h.event_id = l.event_id WHERE l.object_id <> h.hub),
reach AS (
  WITH RECURSIVE walk(node, component) USING KEY (node) AS (
    SELECT DISTINCT a, a FROM edge
    UNION
    SELECT e.b, MIN(w.component) FROM walk w JOIN edge e ON e.a = w.node JOIN recurring.walk r ON r.node = e.b
    WHERE w.component < r.component GROUP BY e.b)
  SELECT node, component FROM walk),
member AS (
  SELECT o.object_id, o.type, COALESCE(r.component, o.object_id) AS component FROM {objects} o LEFT JOIN reach r ON r.node = o.object_id),
placed AS (
  SELECT e.event_id, e.time, COALESCE(m.component, CONCAT('event:', e.event_id)) AS component
  FROM o_event e LEFT JOIN hub h ON h.event_id = e.event_id LEFT JOIN member m ON m.object_id = h.hub)
"""
_WHOLE = _REACH.format(links="o_e2o", objects="o_object")
_CUSTOMERS = """
, s_e2o AS (SELECT * FROM o_e2o WHERE qualifier IN ('customer', 'order')),
s_object AS (SELECT * FROM o_object WHERE type IN ('customer', 'order'))
""" + _REACH.format(links="s_e2o", objects="s_object")


@query("connected_components", on_orders(_WHOLE + "SELECT object_id, component FROM member"))
def _(spark, folder):
    return components.object_components(orders(spark, folder))


@query("customer_components", on_orders(_CUSTOMERS + "SELECT object_id, component FROM member"))
def _(spark, folder):
    return components.object_components(_customer_orders(spark, folder))


@query("event_components", on_orders(_CUSTOMERS + "SELECT event_id, component FROM placed"))
def _(spark, folder):
    return components.event_components(_customer_orders(spark, folder))


_STATS = """
, stats AS (
  SELECT COALESCE(a.component, b.component) AS component, COALESCE(a.objects, 0) AS objects, COALESCE(b.events, 0) AS events,
    COALESCE(a.object_types, 0) AS object_types, b.first AS start, b.last AS "end",
    COALESCE(ROUND((epoch_us(b.last) - epoch_us(b.first)) / 3.6e9, 6), 0.0) AS span_hours,
    COALESCE(ROUND((epoch_us(b.last) - epoch_us(b.first)) / 3.6e9 / 24, 6), 0.0) AS span_days
  FROM (SELECT component, COUNT(*) AS objects, COUNT(DISTINCT type) AS object_types FROM member GROUP BY 1) a
  FULL JOIN (SELECT component, COUNT(*) AS events, MIN(time) AS first, MAX(time) AS last FROM placed GROUP BY 1) b
  ON a.component = b.component)
"""


@query("component_stats", on_orders(_CUSTOMERS + _STATS + "SELECT * FROM stats"))
def _(spark, folder):
    return components.component_stats(_customer_orders(spark, folder)).drop("object_type_mix")


@query(
    "component_type_mix",
    on_orders(_CUSTOMERS + "SELECT component, type, COUNT(*) AS n FROM member GROUP BY ALL"),
)
def _(spark, folder):
    stats = components.component_stats(_customer_orders(spark, folder))
    return stats.select("component", F.explode("object_type_mix").alias("type", "n"))


@query(
    "largest_component",
    on_orders(_WHOLE + _STATS + """
SELECT component, objects, events, objects / SUM(objects) OVER () AS object_share, events / SUM(events) OVER () AS event_share
FROM stats ORDER BY objects DESC, events DESC, component DESC LIMIT 1
"""),
)
def _(spark, folder):
    return components.largest_share(components.component_stats(orders(spark, folder)))


# -- recipes and schema checks ---------------------------------------------


@query(
    "recipe_log",
    on_clicks("""
, kept AS (SELECT * FROM c_event WHERE time >= TIMESTAMP '2024-01-05' AND time <= TIMESTAMP '2024-01-20'),
links AS (SELECT * FROM c_e2o WHERE event_id IN (SELECT event_id FROM kept))
SELECT 'event' AS "table", event_id AS id, type AS ref, time FROM kept
UNION ALL SELECT 'object', object_id, type, time FROM c_object WHERE object_id IN (SELECT object_id FROM links)
UNION ALL SELECT 'e2o', event_id, object_id, time FROM links
UNION ALL SELECT 'event_attr_purchase', event_id, 'event_id,time', time FROM c_purchase WHERE event_id IN (SELECT event_id FROM kept)
"""),
)
def _(spark, folder):
    """A recipe's cuts on a log: event times kept, attribute columns left out, types normalised."""
    recipe = Recipe(
        val=fixtures.CLICKS_VAL, test=fixtures.CLICKS_TEST, drop=frozenset({"value"}), since=datetime(2024, 1, 5), until=datetime(2024, 1, 20)
    )
    log = recipe.prepare(clicks(spark, folder))
    attrs = log["event_attr_purchase"]
    shown = attrs.select("event_id", F.lit(",".join(sorted(attrs.columns))).alias("columns"), "time")
    return _rows(log.replace(event_attr_purchase=shown), "event", "object", "e2o", "event_attr_purchase")


@query(
    "required_columns",
    on_clicks("""
SELECT unnest(['event', 'object', 'e2o', 'o2o']) AS "table", unnest(['lacks', 'lacks', 'lacks', 'lacks']) AS verdict,
  unnest([(SELECT COUNT(*) FROM c_event), (SELECT COUNT(*) FROM c_object), (SELECT COUNT(*) FROM c_e2o), (SELECT COUNT(*) FROM c_o2o)]) AS "rows"
"""),
)
def _(spark, folder):
    """Each core table without its last required column is refused, whatever its rows."""
    log, found = clicks(spark, folder), []
    validate.require_columns(log)
    for name, columns in validate.REQUIRED_COLUMNS.items():
        try:
            validate.require_columns(log.replace(**{name: log[name].drop(columns[-1])}))
            verdict = "passed"
        except validate.InvalidLog:
            verdict = "lacks"
        found.append(log[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), F.lit(verdict).alias("verdict"), "rows"))
    return reduce(DataFrame.unionByName, found)
