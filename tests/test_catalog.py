"""Every registered query against its check SQL, and the named jobs."""

from __future__ import annotations

import re
from datetime import timedelta
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from objectlog import Grid
from objectlog.plans.jobs import LABEL_JOBS, SAMPLE_JOBS, job
from objectlog.plans.recipes import RECIPES
from tools.check_queries import compare

from .conftest import START

FOLDER = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not FOLDER.exists(), reason="sample tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in sorted(FOLDER.glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(name, spark, duck):
    got = entry.queries()[name](spark, str(FOLDER)).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        verdict = compare(got, duck.sql(sql).df())
        assert verdict.startswith("ok"), verdict


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["object_id", "time", "target"]


def test_jobs_are_complete(make_log):
    assert len(LABEL_JOBS) == 21 and len({j.name for j in LABEL_JOBS}) == 21
    assert {j.log for j in LABEL_JOBS} == set(RECIPES)
    log = make_log({"a": "T"}, [("e1", "x", START, ["a"])])
    grid = Grid.regular(START, timedelta(hours=1), 3)
    for one in (*LABEL_JOBS, *SAMPLE_JOBS):
        tables = {}
        if one.table:
            key = "event" if one.table.startswith("event") else "object"
            tables[one.table] = log[key].withColumnRenamed("type", one.column)
        if one.kind == "attribute_value":
            tables[one.table] = log.event.selectExpr("event_id", f"1.5D AS `{one.column}`", "time")
        labels = one.build(log.replace(**tables), grid)
        assert labels.columns == [*one.keys, "time", "target"]
        assert labels.schema["target"].dataType.typeName() == ("double" if one.task_type == "regression" else "integer")
        assert set(one.meta.fks) == set(one.keys)
    assert job("order_payment_outcome_14d").classes == ("pay order", "payment reminder")


def test_no_query_cuts_its_input_short():
    for path in Path(__file__).resolve().parents[1].glob("objectlog/**/*.py"):
        text = path.read_text()
        assert not re.search(r"localCheckpoint|\.rdd\b|toPandas|crossJoin|pandas_udf|\budf\(", text), path
