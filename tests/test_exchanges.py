"""Links and events travel once where once is enough, and the rows stay the same."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from objectlog.operators import labels, profile, timing, transform
from objectlog.sources import fixtures

START = datetime(2024, 1, 1)


@pytest.fixture
def apart(spark):
    """No join is made by broadcast unless it is asked for."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def exchanges(df) -> int:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange hashpartitioning", final)) - final.count("ReusedExchange")


@pytest.fixture
def crowded(spark, make_log):
    """Events of 0 to 5 objects, a link twice, one without an event, one without an object, an event row twice, one without an id."""
    events = [(f"e{n}", "a", START + timedelta(hours=n), [f"x{n}{k}" for k in range(n)]) for n in range(6)]
    log = make_log({f"x{n}{k}": "T" for n in range(6) for k in range(n)}, events)
    odd = spark.createDataFrame([("e5", "x50", "q", START), (None, "x10", "q", START), ("e3", None, "q", START)], log.e2o.schema)
    more = spark.createDataFrame([("e4", "b", START), (None, "a", START)], log.event.schema)
    return log.replace(e2o=log.e2o.unionByName(odd), event=log.event.unionByName(more))


def by_hand(log):
    links = [(r.event_id, r.object_id) for r in log.e2o.collect() if r.event_id is not None]
    of = {}
    for e, o in links:
        of.setdefault(e, []).append(o)
    places = sorted((e, n, str(o)) for e, objs in of.items() for n, o in enumerate(sorted(objs, key=lambda o: (o is not None, o))))
    name = lambda e, o: e if len(of[e]) < 2 else ":".join(x for x in (e, o) if x is not None)
    split = [(name(r.event_id, o), r.type) for r in log.event.collect() for o in of.get(r.event_id, [])]
    split += [(r.event_id, r.type) for r in log.event.collect() if r.event_id not in of]
    return places, sorted(split, key=str), sorted(name(e, o) for e, o in links)


@pytest.mark.parametrize("heavy", [transform.HEAVY, 5, 2, 1])
def test_light_and_heavy_events_give_the_same_rows(crowded, monkeypatch, heavy):
    monkeypatch.setattr(transform, "HEAVY", heavy)
    places, split, links = by_hand(crowded)
    assert sorted((r.event_id, r.position, str(r.object_id)) for r in transform.event_objects(crowded).collect()) == places
    flat = transform.split_events(crowded)
    assert sorted(((r.event_id, r.type) for r in flat.event.collect()), key=str) == split
    assert sorted(r.event_id for r in flat.e2o.collect()) == links and flat.e2o.columns == crowded.e2o.columns


def test_links_meet_their_event_once(apart, crowded):
    assert exchanges(transform.split_events(crowded).event) == 2
    assert exchanges(transform.event_objects(crowded)) == 1


@pytest.mark.parametrize("heavy", [profile.HEAVY, 2, 1, 0])
def test_light_and_heavy_objects_give_the_same_rows(crowded, spark, monkeypatch, heavy):
    """At 0 all objects are heavy. One object has many links at one time, some twice; links without an object or event stay odd."""
    many = [(f"e{n % 5}", "x50", "q", START + timedelta(hours=n // 2)) for n in range(12)]
    odd = [(None, "alone", "q", START), (None, "alone", "q", START), ("e1", None, "q", START + timedelta(hours=3)), ("e1", "x50", "q", None)]
    log = crowded.replace(e2o=crowded.e2o.unionByName(spark.createDataFrame(many + odd, crowded.e2o.schema)))
    log = log.replace(event=crowded.event.dropDuplicates(["event_id"]))

    def rows(df):
        return sorted(map(str, df.collect()))

    def all_rows():
        return rows(profile.coverage_by_min_length(log)), rows(timing.recent_activity(log)), rows(timing.recent_k_activities(log, 3))

    monkeypatch.setattr(profile, "HEAVY", heavy)
    monkeypatch.setattr(timing, "HEAVY", heavy)
    found = all_rows()
    monkeypatch.setattr(profile, "HEAVY", 0)
    monkeypatch.setattr(timing, "HEAVY", 0)
    assert found == all_rows()
    links = [(r.event_id, r.object_id) for r in log.e2o.collect() if r.object_id]
    length = {o: len({e for e, p in links if p == o and e}) for _, o in links}
    top = {}
    for e, o in links:
        if length[o]:
            top[e] = max(top.get(e, 0), length[o])
    for r in profile.coverage_by_min_length(log).collect():
        k = r.min_object_trace_length
        assert r.event_count == sum(n >= k for n in top.values()) and r.object_count == sum(n >= k for n in length.values() if n)


def test_links_meet_their_object_once(apart, crowded):
    plan = profile.coverage_by_min_length(crowded)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    log = crowded.replace(e2o=crowded.e2o.where("object_id IS NOT NULL"))
    plan = timing._lagged_activity(log, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "_day" not in plan


def test_labels_of_unknown_entities_do_not_travel(apart, crowded):
    known = crowded.object.where("object_id like 'x5%'").select("object_id")
    rows = crowded.links().select("object_id", "event_id", "time")
    found = labels.drop_unknown(rows, known.unionByName(known))
    assert found.columns == rows.columns
    assert sorted(r.object_id for r in found.collect()) == ["x50", "x50", "x51", "x52", "x53", "x54"]
    plan = plan_of(found)
    # Below both exact joins: the sieve of the links, next to their table.
    assert re.search(r"BroadcastHashJoin .*LeftSemi", plan) and plan.index("SortMergeJoin [event_id") < plan.index("BroadcastHashJoin")
    assert plan.index("SortMergeJoin [event_id") < plan.index("LeftSemi")


def test_events_and_links_of_orders_share_an_exchange(apart, tmp_path):
    at = F.lit("2024-01-01").cast("timestamp")
    lines = apart.range(40).select(
        (F.col("id") % 7).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 5).alias("l_partkey"),
        F.lit(2).alias("l_suppkey"), at.alias("l_shipdate"), F.when(F.col("id") % 3 > 0, "A").alias("l_returnflag"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    heads = apart.range(7).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), at.alias("o_orderdate"),
                                  F.lit("1").alias("o_orderpriority"), F.lit(1.0).alias("o_totalprice"))
    heads.write.parquet(f"{tmp_path}/orders.parquet")
    log = fixtures.orders(apart, str(tmp_path))
    ids = {r.event_id for r in log.event.where("event_id like 'l%'").collect()}
    assert ids == {f"l{i % 7}_1_{i % 5}_2_20240101" for i in range(40)}
    assert {r.event_id for r in log.e2o.where("event_id like 'l%'").collect()} == ids
    both = log.e2o.select("event_id", "object_id").unionByName(log.event.select("event_id", F.col("type").alias("object_id")))
    assert exchanges(both) == 1
