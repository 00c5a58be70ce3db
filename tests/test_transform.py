"""Components and flattening on tiny logs: disjoint, complete, counts kept."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from objectlog.operators import components, transform, validate

from .conftest import HOUR, START


def simple(make_log, objects, events):
    kinds = {o: t for o, t in objects}
    return make_log(kinds, [(e, "act", START + HOUR * i, ids) for i, (e, ids) in enumerate(events)])


def groups(log):
    members: dict[str, set] = {}
    for row in components.object_components(log).collect():
        members.setdefault(row.component, set()).add(row.object_id)
    return members


def event_groups(log):
    return {r.event_id: r.component for r in components.event_components(log).collect()}


def test_single_component(make_log):
    log = simple(make_log, [("a", "T"), ("b", "T")], [("e1", ["a", "b"])])
    assert groups(log) == {"a": {"a", "b"}}
    assert event_groups(log) == {"e1": "a"}


def test_two_components(make_log):
    log = simple(make_log, [(o, "T") for o in "abcd"], [("e1", ["a", "b"]), ("e2", ["c", "d"])])
    assert sorted(map(sorted, groups(log).values())) == [["a", "b"], ["c", "d"]]


def test_transitive(make_log):
    log = simple(make_log, [(o, "T") for o in "abc"], [("e1", ["a", "b"]), ("e2", ["b", "c"])])
    assert groups(log) == {"a": {"a", "b", "c"}}


def test_isolated_object(make_log):
    log = simple(make_log, [("a", "T"), ("b", "T"), ("lonely", "T")], [("e1", ["a", "b"])])
    assert groups(log)["lonely"] == {"lonely"}
    assert "lonely" not in event_groups(log).values()


def test_event_without_objects(make_log):
    log = simple(make_log, [("a", "T")], [("e1", ["a"]), ("orphan", [])])
    assert len(set(event_groups(log).values()) | set(groups(log))) == 2
    assert event_groups(log)["orphan"] == "event:orphan"


def test_disjoint_and_complete(make_log):
    log = simple(
        make_log, [("x", "A"), ("y", "B"), ("p", "A"), ("q", "B"), ("z", "C")], [("e1", ["x", "y"]), ("e2", ["p", "q"])]
    )
    rows = components.object_components(log).collect()
    assert len(rows) == len({r.object_id for r in rows}) == 5
    assert {r.object_id for r in rows} == {"x", "y", "p", "q", "z"}
    assert len(event_groups(log)) == 2


def test_types_per_component(make_log):
    log = simple(make_log, [("a", "Alpha"), ("b", "Beta"), ("c", "Gamma")], [("e1", ["a", "b"])])
    mix = {r.component: r.object_type_mix for r in components.component_stats(log).collect()}
    assert mix == {"a": {"Alpha": 1, "Beta": 1}, "c": {"Gamma": 1}}


def test_long_chain_settles(make_log):
    names = [f"n{i:03d}" for i in range(60)]
    log = simple(make_log, [(n, "T") for n in names], [(f"e{i}", [names[i], names[i + 1]]) for i in range(59)])
    assert groups(log) == {"n000": set(names)}


def test_split_keeps_single_events(make_log):
    log = simple(make_log, [("a", "T"), ("b", "T")], [("e1", ["a"]), ("e2", ["b"])])
    assert {r.event_id for r in transform.split_events(log).event.collect()} == {"e1", "e2"}


def test_split_copies_and_ids(make_log):
    log = simple(make_log, [(o, "T") for o in "abc"], [("ev", ["a", "b", "c"])])
    flat = transform.split_events(log)
    assert {r.event_id for r in flat.event.collect()} == {"ev:a", "ev:b", "ev:c"}
    assert flat.e2o.groupBy("event_id").count().where("count > 1").count() == 0


def test_split_total_is_number_of_links(make_log):
    log = simple(make_log, [(o, "T") for o in "abc"], [("e1", ["a", "b"]), ("e2", ["c"])])
    assert transform.split_events(log).event.count() == 3


def test_split_keeps_type_and_time(make_log):
    log = make_log({"a": "T", "b": "T"}, [("e1", "my_act", START, ["a", "b"])])
    assert {(r.type, r.time) for r in transform.split_events(log).event.collect()} == {("my_act", START)}


def test_split_keeps_objects(make_log):
    log = simple(make_log, [("a", "T"), ("b", "T")], [("e1", ["a", "b"])])
    assert transform.split_events(log).object.exceptAll(log.object).count() == 0


def test_split_keeps_empty_event(make_log):
    log = simple(make_log, [("a", "T")], [("e_empty", []), ("e1", ["a"])])
    assert "e_empty" in {r.event_id for r in transform.split_events(log).event.collect()}


def test_split_in_time_order(make_log):
    log = make_log({"a": "T", "b": "T"}, [("late", "x", START + timedelta(days=1), ["a", "b"]), ("early", "x", START, ["a", "b"])])
    rows = transform.split_events(log).event.orderBy("time", "event_id").collect()
    assert [r.event_id for r in rows] == ["early:a", "early:b", "late:a", "late:b"]


def test_flatten_multiplies_duplicate_links(make_log):
    log = make_log({"a": "T", "b": "U"}, [("e", "x", START, ["a", "a", "b"])])
    flat = transform.flatten(log, "T")
    assert {r.event_id for r in flat.event.collect()} == {"e::a::1", "e::a::2"}
    assert flat.e2o.count() == 4
    with pytest.raises(ValueError):
        transform.flatten(log, "nothing")


def test_project_drops_unlinked(make_log):
    log = make_log({"a": "T", "b": "U"}, [("e1", "x", START, ["a", "b"]), ("e2", "y", START, ["b"])])
    kept = transform.project(log, "T")
    assert [r.event_id for r in kept.event.collect()] == ["e1"]
    assert [r.object_id for r in kept.e2o.collect()] == ["a"]


def test_nest_keeps_its_shape(make_log):
    names = [f"o{i:02d}" for i in range(50)]
    log = make_log({n: "T" for n in names}, [("big", "x", START, names[::-1]), ("none", "x", START, [])])
    assert {r.event_id: r.object_ids for r in transform.nest(log).collect()} == {"big": names, "none": []}
    assert {(r.event_id, r.position): r.object_id for r in transform.event_objects(log).collect()} == {
        ("big", i): n for i, n in enumerate(names)
    }


def test_validation_names_broken_rules(make_log, spark):
    log = make_log({"a": "T"}, [("e1", "x", START, ["a"]), ("e2", None, START, ["ghost"])])
    with pytest.raises(validate.InvalidLog, match="ghost"):
        validate.checked(log)
    log = log.replace(e2o=log.e2o.where("object_id = 'a'"), event=log.event.where("type IS NOT NULL"))
    assert validate.checked(log) is log
    with pytest.raises(validate.InvalidLog, match="lacks"):
        validate.validate(log.replace(event=log.event.drop("time")))
    twice = log.replace(event=log.event.unionByName(log.event))
    found = {(r.rule, r.table): r.n_bad for r in validate.validate(twice).where(F.col("n_bad") > 0).collect()}
    assert found == {("unique", "event"): 1}


def test_components_run_on_numbers(make_log, spark):
    """Events of one to six links, repeats and unknown ends among them; rounds only see long codes."""
    picks = [[(7 * e + k * k) % 90 for k in range(e % 6 + 1)] + ([(7 * e) % 90] if e % 4 == 0 else []) for e in range(60)]
    above = {o: o for o in range(90)}

    def top(o):
        while above[o] != o:
            o = above[o]
        return o

    for event in picks:
        for o in event[1:]:
            above[top(o)] = top(event[0])
    wanted: dict[int, set] = {}
    for o in range(90):
        wanted.setdefault(top(o), set()).add(f"o{o:02d}")
    log = simple(make_log, [(f"o{o:02d}", "T") for o in range(90)], [(f"e{e}", [f"o{o:02d}" for o in ids]) for e, ids in enumerate(picks)])
    log = log.replace(e2o=log.e2o.unionByName(log.e2o.limit(3).withColumn("event_id", F.lit(None).cast("string"))))
    assert groups(log) == {min(ids): ids for ids in wanted.values()}
    path = spark.range(500).select(F.xxhash64("id").alias("u"), F.xxhash64(F.col("id") + 1).alias("v"))
    found = components.contracted(path)
    assert found.select("code", "root").dtypes == [("code", "bigint"), ("root", "bigint")]
    assert found.agg(F.count_distinct("root"), F.count_distinct("code")).first()[:] == (1, 501)
    assert components.contracted(path.limit(0)).count() == 0
