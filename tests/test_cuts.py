"""Cuts of lineage, and documents written for the reading queries."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from objectlog.plans import log_queries
from objectlog.session import cut_lineage


def test_cut_is_a_table_with_the_same_rows_and_schema(spark):
    df = spark.createDataFrame(
        [(1, None, [1.5, None], "2024-01-01"), (2, "x", [], None)], "`a.b` int, `b c` string, d array<double>, t string"
    ).withColumns({"t": F.col("t").cast("timestamp_ntz"), "n": F.struct(F.lit("v").alias("v"))})
    got = cut_lineage(df)
    assert got.dtypes == df.dtypes and sorted(got.collect()) == sorted(df.collect())
    assert got.inputFiles() and all(f.endswith(".parquet") for f in got.inputFiles())
    assert cut_lineage(df.limit(0)).dtypes == df.dtypes and cut_lineage(df.limit(0)).count() == 0


def test_cut_of_what_parquet_cannot_hold(spark):
    df = spark.range(3).select("id", F.lit(None).alias("nothing"), F.col("id").alias("ID"))
    assert sorted(tuple(r) for r in cut_lineage(df).collect()) == [(i, None, i) for i in range(3)]


def test_documents_grow_in_number_with_their_lines(spark, monkeypatch):
    monkeypatch.setattr(log_queries, "_DOCUMENT", 100)
    lines = spark.range(1000).select(F.lit(1).alias("place"), F.concat(F.lit("line "), "id").alias("line"))
    path = log_queries._documents(spark, lines, {0: "first", 2: "last"})
    files = [f.read_text().splitlines() for f in Path(path.removeprefix("file:")).glob("document=*/*.txt")]
    assert len(files) == 10 and all(f[0] == "first" and f[-1] == "last" for f in files)
    assert sorted(x for f in files for x in f[1:-1]) == sorted(f"line {i}" for i in range(1000))
    few = log_queries._documents(spark, lines.limit(5), {0: "first", 2: "last"})
    assert len(list(Path(few.removeprefix("file:")).glob("document=*"))) == 3
