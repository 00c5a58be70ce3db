"""A key with a third of all rows is split over tasks, and results stay whole."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from objectlog import Grid, ObjectLog
from objectlog.operators import components, graph, labels, profile, timing, transform

_TIGHT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.shuffle.partitions": "16",
}
ROWS = 150_000


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Stored log in which one object, and one event, hold a third of all links."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    code = F.xxhash64("id")
    events = spark.range(ROWS).select(
        F.format_string("e%07d", "id").alias("event_id"),
        F.when(code % 3 == 0, "a").when(code % 3 == 1, "b").otherwise("c").alias("type"),
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(code, F.lit(2592000))).cast("timestamp_ntz").alias("time"),
    )
    some = F.format_string("o%05d", F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(20000)))
    links = events.select("event_id", "time", F.when(F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0, "hot").otherwise(some).alias("object_id"))
    links.write.parquet(folder + "/e2o")
    events.write.parquet(folder + "/event")
    e2o = spark.read.parquet(folder + "/e2o")
    e2o.groupBy("object_id").agg(F.min("time").alias("time")).withColumn("type", F.lit("T")).write.parquet(folder + "/object")
    log = ObjectLog({n: spark.read.parquet(f"{folder}/{n}") for n in ("event", "object", "e2o")})
    before = {k: spark.conf.get(k, None) for k in _TIGHT}
    for key, value in _TIGHT.items():
        spark.conf.set(key, value)
    yield log
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    n = rows.collect()[0].n
    return n, rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "build",
    [
        lambda log: log.links_of("T").groupBy("object_id", "type").count(),
        profile.coverage_by_min_length,
        timing.recent_activity,
        timing.age_at_event,
    ],
    ids=["links_of", "coverage", "recent_activity", "age_at_event"],
)
def test_hot_rows_are_split(skewed, build):
    n, plan = final_plan(build(skewed))
    assert n > 0 and "skew=true" in plan


def test_labels_fold_before_they_meet_objects(skewed):
    grid = Grid.regular(datetime(2024, 1, 2), timedelta(days=1), 28)
    counts = labels.stage_event_count(skewed, "T", grid, timedelta(days=1), "a", "b")
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") < plan.index("Aggregate [object_id") < plan.index("Join Inner")
    hot = counts.where("object_id = 'hot'").agg(F.sum("target")).first()[0]
    assert hot > 0
    # Each event is in exactly one window of an even grid: add up by hand.
    own = skewed.links().where("object_id = 'hot'").orderBy("time", "event_id").collect()
    want = 0
    for slot in range(28):
        at = datetime(2024, 1, 2) + timedelta(days=slot)
        if [r.type for r in own if r.time <= at][-1] == "a":
            want += sum(r.type == "b" and at < r.time <= at + timedelta(days=1) for r in own)
    assert hot == want


@pytest.mark.parametrize("strategy", ["last", "uniform"])
def test_hub_costs_its_fan_out(skewed, spark, strategy):
    """Seeds ask a hub that holds a third of all edges; two edge types with fan-outs of their own, uneven seed times."""
    days = [5, 6, 9.25, 9.5, 20, 29]
    seeds = spark.createDataFrame(
        [(i, "object:hot", datetime(2024, 1, 1) + timedelta(days=d)) for i, d in enumerate(days)] + [(9, "object:none", datetime(2024, 1, 3))],
        "seed_id int, node string, seed_time timestamp_ntz",
    )
    edges = graph.typed_edges(skewed).where("edge LIKE '%via_e2o%' OR edge LIKE '%rev_f2p_object_id%'")
    limits = graph.fan_outs(skewed, 6, 1).withColumn("limit", F.when(F.col("edge").contains("rev"), 2).otherwise(F.col("limit")))
    found = graph.temporal_neighbours(seeds, edges, limits, 1, strategy=strategy, seed=3)
    rows = {(r.seed_id, r.edge, r.target) for r in found.collect()}
    own = edges.where("source = 'object:hot'").withColumn("h", F.md5(F.concat_ws("|", F.lit("3"), "source", "target"))).collect()
    kept = {r.edge: r.limit for r in limits.collect()}
    want = set()
    for s in seeds.where("node = 'object:hot'").collect():
        for edge in {r.edge for r in own}:
            past = [r for r in own if r.edge == edge and r.time <= s.seed_time]
            past.sort(key=(lambda r: (r.h, r.target)) if strategy == "uniform" else (lambda r: (r.time, r.target)), reverse=strategy == "last")
            want |= {(s.seed_id, edge, r.target) for r in past[: kept[edge]]}
    assert rows == want and len(want) > 30


def test_one_event_with_a_third_of_the_links(skewed, spark):
    crowd = spark.range(ROWS // 2).select(
        F.lit("e0000000").alias("event_id"), F.format_string("x%06d", "id").alias("object_id")
    )
    time = skewed.event.where("event_id = 'e0000000'").first().time
    log = skewed.replace(
        e2o=skewed.e2o.unionByName(crowd.withColumn("time", F.lit(time).cast("timestamp_ntz"))),
        object=skewed.object.unionByName(
            crowd.select("object_id", F.lit("T").alias("type"), F.lit(time).cast("timestamp_ntz").alias("time"))
        ),
    )
    members = components.object_components(log)
    parts = members.groupBy("component").count().collect()
    assert sum(r["count"] for r in parts) == log.object.count()
    assert max(r["count"] for r in parts) >= ROWS // 2
    places = transform.event_objects(log).where("event_id = 'e0000000'").select("position").collect()
    assert sorted(r.position for r in places) == list(range(ROWS // 2 + 1))
    assert transform.split_events(log).event.count() == ROWS + ROWS // 2
