"""Documents of both shapes to normalised logs, and logs on storage."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from objectlog.operators import graph, profile, validate, vocab
from objectlog.plans.recipes import RECIPES
from objectlog.sources import json_docs, normalize, store

DOC_2 = {
    "eventTypes": [{"name": "place", "attributes": []}, {"name": "never", "attributes": []}],
    "objectTypes": [{"name": "order", "attributes": []}],
    "events": [
        {
            "id": "e1",
            "type": " place | now ",
            "time": "2024-01-15T08:00:00Z",
            "relationships": [{"objectId": "o1", "qualifier": "main"}, {"objectId": "", "qualifier": "x"}, 5, {"objectId": "o2"}],
            "attributes": [{"name": "cost", "value": 1}, {"name": "cost", "value": 2.5}, {"name": "who", "value": "ann"}],
        },
        {
            "id": 2,
            "type": "",
            "time": "2024-01-16T08:00:00Z",
            "relationships": [{"objectId": "o1", "qualifier": " "}],
            "attributes": [],
        },
    ],
    "objects": [
        {
            "id": "o1",
            "type": "order",
            "relationships": [{"objectId": "o2", "qualifier": "of"}, {"objectId": "ghost", "qualifier": "of"}],
            "attributes": [
                {"name": "state", "value": "open", "time": "2024-01-15T09:00:00Z"},
                {"name": "state", "value": "shut", "time": "2024-01-17T09:00:00Z"},
                {"name": "size", "value": 3},
                {"name": "note", "value": None, "time": "2024-01-17T09:00:00Z"},
            ],
        },
        {"id": "o2", "type": "order.line", "attributes": [{"name": "n", "value": 7}]},
    ],
}
DOC_1 = {
    "ocel:global-log": {"ocel:version": "1.0"},
    "ocel:events": {
        "e1": {
            "ocel:activity": "create",
            "ocel:timestamp": "2020-07-09 08:20:01",
            "ocel:omap": ["i1"],
            "ocel:typedOmap": [{"ocel:oid": "i1", "ocel:qualifier": "item"}, {"ocel:qualifier": "nobody"}],
            "ocel:vmap": {"weight": 2, "fast": True},
        },
        "e2": {"ocel:activity": "ship", "ocel:timestamp": "2020-07-10 08:20:01", "ocel:omap": ["i1", "i2"], "ocel:vmap": {}},
    },
    "ocel:objects": {
        "i1": {"ocel:type": "item", "ocel:ovmap": {"price": 3.5}},
        "i2": {"ocel:type": "item", "ocel:ovmap": {"price": 4}},
    },
}


@pytest.fixture()
def folder(tmp_path):
    def write(name, *docs):
        path = tmp_path / name
        path.mkdir()
        for i, doc in enumerate(docs):
            (path / f"doc{i}.json").write_text(json.dumps(doc, indent=1))
        return str(path)

    return write


def test_versions(spark, folder):
    path = folder("mixed", DOC_2, DOC_1, {"events": []})
    found = {r.path.rsplit("/", 1)[-1]: r.version for r in json_docs.detect_versions(spark, path).collect()}
    assert found == {"doc0.json": "2.0", "doc1.json": "1.0", "doc2.json": None}
    with pytest.raises(ValueError):
        json_docs.read_log(spark, path)


def test_read_log_2(spark, folder):
    log = validate.checked(json_docs.read_log(spark, folder("two", DOC_2)))
    assert {tuple(r) for r in log.event.select("event_id", "type", "time").collect()} == {
        ("e1", "place _ now", datetime(2024, 1, 15, 8)),
        ("2", "__INVALID__", datetime(2024, 1, 16, 8)),
    }
    assert {tuple(r) for r in log.e2o.select("event_id", "object_id", "qualifier", "time").collect()} == {
        ("e1", "o1", "main", datetime(2024, 1, 15, 8)),
        ("e1", "o2", "__INVALID__", datetime(2024, 1, 15, 8)),
        ("2", "o1", "__INVALID__", datetime(2024, 1, 16, 8)),
    }
    assert [tuple(r) for r in log["o2o"].select("object_id_src", "object_id_dst", "qualifier").collect()] == [("o1", "o2", "of")]
    assert {tuple(r) for r in log.object.collect()} == {
        ("o1", "order", datetime(2024, 1, 15, 8)),
        ("o2", "order.line", datetime(2024, 1, 15, 8)),
    }
    attrs = log["event_attr_place _ now"].collect()
    assert [(r.event_id, r.cost, r.who) for r in attrs] == [("e1", 2.5, "ann")]
    orders = log["object_attr_order"].orderBy("time").collect()
    assert [(r.time, r.state, r.size) for r in orders] == [
        (datetime(2024, 1, 15, 8), None, 3.0),
        (datetime(2024, 1, 15, 9), "open", 3.0),
        (datetime(2024, 1, 17, 9), "shut", 3.0),
    ]
    assert log["object_attr_order_line"].first().n == 7
    assert dict(log["object_attr_order_line"].dtypes)["n"] == "int"


def test_many_documents_make_one_log(spark, folder):
    second = {
        "eventTypes": [],
        "objectTypes": [],
        "events": [{"id": "e9", "type": "place", "time": "2024-02-01T00:00:00Z", "relationships": [{"objectId": "o1", "qualifier": "main"}]}],
        "objects": [],
    }
    log = json_docs.read_log(spark, folder("many", DOC_2, second))
    assert log.event.count() == 3 and log.object.count() == 2
    elements = json_docs.read_elements(spark, folder("types", DOC_2))
    assert {r.type for r in json_docs.declared_types(elements, "event").collect()} == {"place", "never", " place | now ", ""}


def test_read_log_1(spark, folder):
    log = validate.checked(json_docs.read_log(spark, folder("one", DOC_1)))
    assert "o2o" not in log
    assert {tuple(r) for r in log.e2o.select("event_id", "object_id", "qualifier").collect()} == {
        ("e1", "i1", "item"),
        ("e2", "i1", "__INVALID__"),
        ("e2", "i2", "__INVALID__"),
    }
    row = log["event_attr_create"].first()
    assert (row.event_id, row.weight, row.fast) == ("e1", 2, True)
    assert {r.object_id: r.price for r in log["object_attr_item"].collect()} == {"i1": 3.5, "i2": 4.0}
    assert "event_attr_ship" not in log


def test_store_round_trip_and_recipe(spark, folder, tmp_path):
    log = json_docs.read_log(spark, folder("two", DOC_2))
    store.save(log, str(tmp_path / "stored"))
    back = store.load(spark, str(tmp_path / "stored"))
    assert set(back.tables) == set(log.tables)
    for name, df in log.tables.items():
        assert back[name].select(*df.columns).exceptAll(df).count() == 0 and back[name].count() == df.count()
        assert back[name].select(*df.columns).dtypes == df.dtypes
    assert store.load(spark, str(tmp_path / "stored"), since=datetime(2024, 1, 16).date()).event.count() == 1
    recipe = RECIPES["bpi2019"]
    assert recipe.prepare(log).event.count() == 0
    assert RECIPES["bpi2017"].all_roles()["event_attr_*"]["RequestedAmount"] == "numerical"


@pytest.mark.parametrize(
    "values, want",
    [
        (["2024-03-01T10:00:00.5Z", "2024-03-02T10:00:00.25+02:00"], [datetime(2024, 3, 1, 10, 0, 0, 500000), datetime(2024, 3, 2, 10, 0, 0, 250000)]),
        (["05-06-2024 10:00:00", "25-06-2024 10:00:00"], [datetime(2024, 6, 5, 10), datetime(2024, 6, 25, 10)]),
        (["05/06/2024 10:00:00", "25/06/2024 10:00:00"], [datetime(2024, 6, 5, 10), datetime(2024, 6, 25, 10)]),
        (["05/26/2024 10:00:00", None], [datetime(2024, 5, 26, 10), None]),
        (["2024-03-01", "2024/03/02 01:02:03"], [datetime(2024, 3, 1), datetime(2024, 3, 2, 1, 2, 3)]),
        (["05/06/2024 10:00:00", "2024-03-01"], [datetime(2024, 5, 6, 10), datetime(2024, 3, 1)]),
        (["2024-03-01", "soon"], [datetime(2024, 3, 1), None]),
        (["2024-13-01", "2024-02-30"], [None, None]),
    ],
)
def test_time_formats(spark, values, want):
    df = spark.createDataFrame(list(enumerate(values)), "i int, time string")
    assert [r.time for r in normalize.parse_time(df).orderBy("i").collect()] == want


def test_dtype_rules(spark):
    def table(sql):
        return normalize.normalize_table(spark.sql(sql), "time")

    kinds = dict(table("SELECT 3000000000L a, 5L b, 1S c, CAST(1 AS FLOAT) f, '7' event_id, 'x' object_id, 2.5BD d").dtypes)
    assert kinds == {"a": "bigint", "b": "int", "c": "int", "f": "float", "event_id": "bigint", "object_id": "string", "d": "double"}
    for bad in (
        "SELECT CAST(NULL AS INT) a",
        "SELECT CAST(NULL AS BOOLEAN) a",
        "SELECT array(1) a",
        "SELECT '1.5' event_id",
        "SELECT CAST(NULL AS BIGINT) object_id",
        "SELECT * FROM VALUES ('1'), (NULL) AS t(event_id)",
    ):
        with pytest.raises(ValueError):
            table(bad)
    assert normalize.table_names("event_attr_", ["a.b", "a_b", ""], ()) == {
        "a.b": "event_attr_a_b",
        "a_b": "event_attr_a_b_2",
        "": "event_attr_unknown",
    }


def test_build_log_refuses_broken_input(make_log, spark):
    log = make_log({"a": "T"}, [("e1", "x", datetime(2024, 1, 1), ["a"])])
    parts = (log.event, log.object.drop("time"), log.e2o.drop("time"))
    with pytest.raises(ValueError, match="must not have a time"):
        normalize.build_log(*parts, event_attr={"x": log.event})
    ghost = spark.createDataFrame([("e1", "a"), ("nope", "a")], "event_id string, object_id string")
    with pytest.raises(ValueError, match="nope"):
        normalize.build_log(log.event, log.object.drop("time"), ghost)
    with pytest.raises(ValueError, match="unique"):
        normalize.build_log(log.event.unionByName(log.event), *parts[1:])
    lonely = spark.createDataFrame([("b", "T")], "object_id string, type string")
    with pytest.raises(ValueError, match="no time"):
        normalize.build_log(log.event, parts[1].unionByName(lonely), log.e2o)


def test_schema_helpers(make_log):
    log = make_log({"a": "T"}, [("e1", "x", datetime(2024, 1, 1), ["a"]), ("e2", "x", datetime(2024, 1, 2), ["a"])])
    kinds, preview = profile.find_columns(log, ["TYPE"], preview_rows=1)["event"]
    assert kinds == [("type", "string")] and preview.count() == 1
    assert ("e2o", "qualifier", "string") in profile.column_types(log)
    assert vocab.duration(vocab.max_interevent(log, "T"), "gap").days == 1
    with pytest.raises(ValueError):
        vocab.duration(vocab.max_interevent(log, "none"), "gap")
    assert vocab.types(log, "event", []).count() == 0
    assert profile.attribute_completeness(log, "event") is None
    few = profile.weekly_stability(log.event, 6).first()
    assert (few.weeks_ge_min_events, few.corr_mean, few.active_cells) == (0, None, 0)
    with pytest.raises(ValueError):
        profile.weekly_stability(log.event, 5)


def test_graph_catalogue(make_log):
    log = make_log({"a": "T"}, [("e1", "x", datetime(2024, 1, 1), ["a"])])
    assert ("e2o", "f2p_event_id", "event") in graph.edge_catalogue(log)
    bare = graph.edge_catalogue(log.replace(e2o=log.e2o.drop("qualifier")))
    assert bare == [("object", "via_e2o", "event"), ("event", "via_e2o", "object")]
    limits = {(r["edge"], r["hop"]): r["limit"] for r in graph.fan_outs(log, 32, 3).collect()}
    assert [limits["object>via_e2o>event", hop] for hop in (1, 2, 3)] == [32, 20, 13]
    assert validate.require_columns(log) is None
    numbered = graph.reindex(log)
    assert numbered.e2o.select("event_id", "object_id").first() == (0, 0)
    assert numbered.event.where(F.col("event_id") == 0).count() == 1
