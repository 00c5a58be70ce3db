"""Two logs derived from the sample tables: dense clicks and day-grain orders."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid
from ..model import ObjectLog

DAY = timedelta(days=1)
CLICKS_VAL, CLICKS_TEST = datetime(2024, 1, 20), datetime(2024, 1, 25)
CLICKS_GRID = Grid.regular(datetime(2024, 1, 3), DAY, 27)
ORDERS_GRID = Grid.between(datetime(1996, 1, 1), datetime(2000, 12, 31), 30 * DAY)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _named(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def clicks(spark: SparkSession, folder: str) -> ObjectLog:
    """One event per click, linked to its user (actor) and item (target)."""
    raw = table(spark, folder, "events").select(
        _named("e", "event_id").alias("event_id"),
        _named("u", "user_id").alias("user"),
        F.concat(F.lit("i"), F.regexp_extract("props", "[0-9]+", 0)).alias("item"),
        F.col("event_type").alias("type"),
        F.col("ts").alias("time"),
        "value",
    )
    ends = F.array(
        F.struct(F.col("user").alias("object_id"), F.lit("actor").alias("qualifier"), F.lit("user").alias("type")),
        F.struct(F.col("item").alias("object_id"), F.lit("target").alias("qualifier"), F.lit("item").alias("type")),
    )
    return ObjectLog(
        {
            "event": raw.select("event_id", "type", "time"),
            "object": raw.select("time", F.inline(ends)).groupBy("object_id", "type").agg(F.min("time").alias("time")),
            "e2o": raw.select("event_id", "time", F.inline(ends)).select("event_id", "object_id", "qualifier", "time"),
            "o2o": raw.groupBy(F.col("user").alias("object_id_src"), F.col("item").alias("object_id_dst")).agg(
                F.lit("touched").alias("qualifier"), F.min("time").alias("time")
            ),
            "event_attr_purchase": raw.where("type = 'purchase'").select("event_id", "value", "time"),
        }
    )


def _ships(lines: DataFrame) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    day = F.date_format("l_shipdate", "yyyyMMdd")
    # No sign of the flag is in the id, but tables that need the id only read the same exchange as those with the flag.
    none = F.coalesce(F.substring("flag", 1, 0), F.lit(""))
    return lines.groupBy(*keys).agg(F.min("l_returnflag").alias("flag")).withColumn(
        "event_id",
        F.concat(F.lit("l"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day), none),
    )


def orders(spark: SparkSession, folder: str) -> ObjectLog:
    """Order and shipping events over customers, orders, parts and suppliers."""
    head = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem")
    ships = _ships(lines)
    order_id = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("event_id")
    placed = F.array(
        F.struct(_named("cust", "o_custkey").alias("object_id"), F.lit("customer").alias("qualifier")),
        F.struct(_named("ord", "o_orderkey").alias("object_id"), F.lit("order").alias("qualifier")),
    )
    shipped = F.array(
        F.struct(_named("ord", "l_orderkey").alias("object_id"), F.lit("order").alias("qualifier")),
        F.struct(_named("part", "l_partkey").alias("object_id"), F.lit("part").alias("qualifier")),
        F.struct(_named("supp", "l_suppkey").alias("object_id"), F.lit("supplier").alias("qualifier")),
    )

    def first(df: DataFrame, prefix: str, key: str, kind: str, time: str) -> DataFrame:
        seen = df.groupBy(key).agg(F.min(time).alias("time"))
        return seen.select(_named(prefix, key).alias("object_id"), F.lit(kind).alias("type"), "time")

    order_time = head.groupBy("o_orderkey").agg(F.min("o_orderdate").alias("placed")).join(
        lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped")),
        "o_orderkey",
        "left",
    )
    return ObjectLog(
        {
            "event": _union(
                head.select(order_id, F.concat(F.lit("order "), "o_orderstatus").alias("type"), F.col("o_orderdate").alias("time")),
                ships.select("event_id", F.concat(F.lit("ship "), "flag").alias("type"), F.col("l_shipdate").alias("time")),
            ),
            "object": _union(
                first(head, "cust", "o_custkey", "customer", "o_orderdate"),
                order_time.select(
                    _named("ord", "o_orderkey").alias("object_id"), F.lit("order").alias("type"), F.least("placed", "shipped").alias("time")
                ),
                first(lines, "part", "l_partkey", "part", "l_shipdate"),
                first(lines, "supp", "l_suppkey", "supplier", "l_shipdate"),
            ),
            "e2o": _union(
                head.select(order_id, F.inline(placed), F.col("o_orderdate").alias("time")),
                ships.select("event_id", F.inline(shipped), F.col("l_shipdate").alias("time")),
            ).select("event_id", "object_id", "qualifier", "time"),
            "object_attr_customer": head.select(
                _named("cust", "o_custkey").alias("object_id"),
                F.col("o_orderdate").alias("time"),
                F.col("o_orderstatus").alias("status"),
                F.col("o_orderpriority").alias("priority"),
                F.col("o_totalprice").alias("price"),
            ),
        }
    )


def orders_o2o_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Object links of the orders log without a time."""
    placed = table(spark, folder, "orders").select(
        _named("ord", "o_orderkey").alias("object_id_src"),
        _named("cust", "o_custkey").alias("object_id_dst"),
        F.lit("placed by").alias("qualifier"),
    )
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return placed.unionByName(
        lines.select(
            _named("ord", "l_orderkey").alias("object_id_src"),
            _named("part", "l_partkey").alias("object_id_dst"),
            F.lit("comprises").alias("qualifier"),
        )
    )


def orders_part_attributes_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Part attributes of the orders log without a time."""
    used = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, folder, "part").join(used, "p_partkey", "left_semi").select(
        _named("part", "p_partkey").alias("object_id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size")
    )
