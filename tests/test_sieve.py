"""Links of other objects stay where they are; results keep every row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from objectlog import Grid
from objectlog.functions.sieve import sieve
from objectlog.operators import labels, timing, transform
from objectlog.plans.recipes import Recipe

from .conftest import HOUR, START


@pytest.fixture
def shuffled(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in names}
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def small(make_log):
    return make_log({"a": "T", "b": "T", "c": "U"}, [("e1", "x", START, ["a", "c", "a"]), ("e2", "y", START + HOUR, ["b", "c"]), ("e3", "x", START + 2 * HOUR, ["c"])])


@pytest.mark.parametrize("kind", ["string", "long", "int", "double"])
def test_sieve_keeps_all_that_match(spark, kind):
    rows = spark.range(20_000).select(F.when(F.col("id") > 4, F.col("id") - 10_000).cast(kind).alias("k"), "id")
    ids = rows.where("id % 100 = 7").select("k").unionByName(rows.where("id % 100 = 7").select("k"))
    kept = sieve(rows, ids, "k")
    assert kept.columns == ["k", "id"]
    found = {r.id for r in kept.collect()}
    assert len(found) == kept.count() and found >= {i for i in range(20_000) if i % 100 == 7}
    assert len(found) < 400 or kind == "double"
    assert sieve(rows, ids.limit(0), "k").count() == (20_000 if kind == "double" else 0)
    assert sieve(rows, ids.select(F.col("k").cast("binary" if kind == "string" else "string")), "k").count() == 20_000


@pytest.mark.parametrize(
    "build",
    [
        lambda log, grid: labels.stage_attribute_class(log, "T", grid, "x", "object_attr_T", "v", ["p"]),
        lambda log, grid: labels.stage_next_event(log, "T", grid, HOUR, "x", ["y"]),
        lambda log, grid: labels.stage_related_count(log, "T", "U", grid, HOUR, "x", "y"),
        lambda log, grid: transform.project(log, "T").e2o,
        lambda log, grid: transform.flatten(log, "T").event,
    ],
    ids=["stage_attribute_class", "stage_next_event", "stage_related_count", "project_to_type", "flatten_to_types"],
)
def test_links_are_sieved_before_they_travel(make_log, build):
    log = small(make_log)
    attrs = log.object.select("object_id", "time", F.lit("p").alias("v"))
    plan = optimized(build(log.replace(object_attr_T=attrs), Grid.regular(START, HOUR, 3)))
    assert "_sieve_word" in plan
    # The sieve stands on the links themselves.
    assert max(len(x) - len(x.lstrip(" :+-")) for x in plan.splitlines() if "_sieve_word" in x) > 4


def test_recipe_cuts_both_ends_at_once(make_log, shuffled):
    log = small(make_log)
    at = dict(val=START, test=START, since=START + HOUR, until=START + HOUR)
    cut = Recipe(**at).prepare(log)
    two = transform.upto_event_time(transform.from_event_time(log, at["since"]), at["until"])
    for name in ("event", "object", "e2o"):
        assert sorted(map(str, cut[name].collect())) == sorted(map(str, two[name].collect()))
    assert sorted(r.object_id for r in cut.object.collect()) == ["b", "c"] and cut.e2o.count() == 2
    assert optimized(cut.e2o).count("LeftSemi") == 1


def test_cuts_drop_links_without_an_object(make_log):
    log = small(make_log)
    odd = log.replace(e2o=log.e2o.withColumn("object_id", F.when(F.col("object_id") != "c", F.col("object_id"))))
    kept = transform.from_event_time(odd, START)
    assert kept.e2o.count() == 3 and {r.object_id for r in kept.object.collect()} == {"a", "b"}


def test_flatten_numbers_copies_without_a_join_of_links(make_log, shuffled):
    flat = transform.flatten(small(make_log), "T")
    assert sorted(r.event_id for r in flat.e2o.collect()) == ["e1::a::1", "e1::a::1", "e1::a::2", "e1::a::2", "e2::b::1"]
    assert sorted(r.event_id for r in flat.event.collect()) == ["e1::a::1", "e1::a::2", "e2::b::1"]
    assert optimized(flat.e2o).count("Join Inner") == 2  # the sieve and the ids


def test_oldest_objects_of_repeated_events(make_log, shuffled):
    log = make_log({o: "T" for o in "abcd"}, [("e", "x", START + 9 * HOUR, list("dcba")), ("f", "y", START, ["a"])])
    seen = log.object.withColumn("time", F.lit(START).cast("timestamp_ntz") + F.expr("make_dt_interval(0, ascii(object_id) - 97)"))
    seen = seen.unionByName(seen.where("object_id = 'd'").withColumn("time", F.lit(None).cast("timestamp_ntz")))
    twice = log.event.unionByName(log.event.where("event_id = 'e'"))
    found = timing.oldest_objects(log.replace(object=seen, event=twice), k=3)
    got = sorted((r.event_type, r["rank"], r.n, r.delta_mean_hours) for r in found.collect())
    assert got == [("x", 1, 1, 9.0), ("x", 2, 1, 9.0), ("x", 3, 1, 8.0), ("y", 1, 1, 0.0)]
    # Events are joined to rows already ranked, and ranked again: two windows for each join.
    plan = optimized(found)
    assert plan.count("Join Inner, (event_id") > 0 and plan.count("Window [row_number") == 2 * plan.count("Join Inner, (event_id")
