"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from objectlog.llm import decontam, html_text, line_dedup, mixing, quality, sharding, simhash, token_output, url_filter, warc
from objectlog.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "one very long text of many words " * 8_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0),
        (None, "no id here", "en", None, 10), (None, None, None, None, None), (4, LONG, "en", "s", len(LONG)),
        (5, " \n\t\n ", "en", "s", 5), (6, "ein Wört mit 字 \U0001f600", "de", "t", 20), (1, "same id, other text", "en", "t", 19),
    ]
    docs = prepare(spark).createDataFrame(rows, SCHEMA)
    clash = ("n_words", "kept", "size", "shard", "SLOT", "rate", "spans", "fingerprint", "_row", "_pile", "a.b", "score")
    return docs.select("*", *[F.lit("mine").alias(c) for c in clash])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def items(spark, rows=((1, "a b c"), (None, "no id here"), (3, None), (4, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark, rows=((1, 1, 0), (6, 0, 1), (4, None, 0), (None, 1, 1), (4, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_quality(odd, none):
    got = quality.judge(odd).collect()
    assert len(got) == 10 and got[0]["a.b"] == "mine"
    assert all(r["kept"] == (r["doc_id"] == 4 and not r["base_failed"]) for r in got)
    assert all(r["n_words"] == 0 and r["clean_text"] is None for r in got if r["text"] is None)
    assert quality.judge(none).count() == 0


def test_simhash(odd, none):
    got = {(r["doc_id"], r["_key"]): r for r in simhash.clusters(odd).collect()}
    zero = [r for r in got.values() if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {2, 3, None, 5} and {r["component_id"] for r in zero} == {2}
    assert simhash.clusters(odd).count() == 10 and simhash.clusters(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 2").count() == 1 and kept.where("doc_id = 1").count() == 2


def test_decontam(spark, odd, none):
    got = {(r["doc_id"], r["text"]): r for r in decontam.find(odd, items(spark)).collect()}
    assert got[1, "a b c d e"]["n_hit"] == 3 and got[1, "a b c d e"]["item_ids"] == ["1"]
    assert got[None, "no id here"]["item_ids"] == ["null"] and got[2, None]["clean_text"] is None
    assert len(decontam.find(odd, items(spark)).collect()) == 10
    assert decontam.find(none, items(spark)).count() == 0 and decontam.find(odd, items(spark, [])).agg(F.sum("n_hit")).first()[0] == 0


def test_mixing(spark, odd, none):
    shares = {"good": 1.0, "poor": 0.0, "toxic": 0.0}
    for told in (labels(spark), labels(spark, [])):
        got = mixing.mix(odd, told, shares=shares).collect()
        assert len(got) == 10 and all(abs(sum(r["posteriors"]) - 1) < 1e-9 and r["rate"] >= 0 for r in got)
    assert all(r["posteriors"] == [1.0, 0.0, 0.0] for r in got)
    assert mixing.mix(none, labels(spark), shares=shares).count() == 0


def test_lines(odd, none):
    got = line_dedup.judge(odd)
    assert {(r["doc_id"], r["kept"]) for r in got.collect()} == {(1, True), (None, True), (4, True), (6, True)}
    assert line_dedup.keep_lines(odd).count() == 10 and line_dedup.judge(none).count() == 0


def test_tokens(spark, odd, none, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    token_output.write_tokens(odd, f"{tmp_path}/odd", path)
    got = token_output.read_tokens(spark, f"{tmp_path}/odd").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 1, 2, 3, 4, 5, 6]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(10)]
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 5)} == {1}
    token_output.write_tokens(none, f"{tmp_path}/none", path)
    assert token_output.read_tokens(spark, f"{tmp_path}/none").count() == 0


def test_sharding(odd, none):
    got = sharding.external_shuffle(odd).collect()
    assert len(got) == 10 and {r["law"] for r in got} == {"key"} and got[0]["a.b"] == "mine"
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    assert {r["size"] for r in got if not r["text"]} == {1} and {r["text_crc32"] for r in got if not r["text"]} == {0}
    assert sharding.external_shuffle(none).count() == 0


PAGES = "page_id long, url string, html string, text string, host string"


def pages(spark, rows=None):
    big = "<article><p>" + "long words " * 20_000 + "</p></article>"
    rows = [
        (1, "http://a.com/x", big, "mine", "mine"), (1, "http://a.com/x", big, "mine", "mine"), (2, None, None, None, None),
        (3, "no scheme", "", None, None), (None, "http://B.net/es/\r\nX: y", big, None, None), (4, "", "<p>broken <b", None, None),
        (5, "http://a.com/x", "WARC/1.1\r\n\r\nWARC/1.0 <p>inside", None, None),
    ] if rows is None else rows
    return prepare(spark).createDataFrame(rows, PAGES)


def test_urls(spark):
    got = {r["page_id"]: r for r in url_filter.judge(pages(spark)).collect()}
    assert url_filter.judge(pages(spark)).count() == 7 and url_filter.judge(pages(spark, [])).count() == 0
    assert got[2]["host"] == "" and got[3]["path"] == "" and got[1]["rule"] == "com/" and got[None]["verdict"] == "block"
    assert got[None]["host"] == "b.net" and got[None]["rule"] == "net/es/"


def test_html(spark):
    got = {r["page_id"]: r for r in html_text.extract(pages(spark)).collect()}
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0 and len(got) == 6
    assert got[1]["text"] == " ".join(["long words"] * 20_000) and got[1]["host"] == "mine"
    assert html_text.extract(pages(spark, [])).count() == 0


def test_warc(spark, tmp_path):
    warc.write_archives(pages(spark), f"{tmp_path}/a")
    records = warc.read_archives(spark, f"{tmp_path}/a").cache()
    got = {r["response"]["payload"].decode(): r for r in warc.assemble(records).collect()}
    kinds = [r["type"] for r in warc.assemble(records).collect()]
    assert sorted(kinds) == ["response"] * 6 + ["revisit"]  # each row is a capture, the repeated one too
    assert "WARC/1.1\r\n\r\nWARC/1.0 <p>inside" in got and not records.where("truncated").count()
    assert all(r["request"] is not None and len(r["metadata"]) == 1 for r in got.values())
    big = "x" * 200
    same = [(1, "http://a.com/1", big, None, None), (1, "http://a.com/2", big, None, None), (None, "u", big, None, None), (None, "u", big, None, None)]
    more = [(None, "n", "y" * 150, None, None)] * 3 + [(7, "u", "small", None, None)] * 2
    warc.write_archives(pages(spark, same + more), f"{tmp_path}/c")
    read = warc.assemble(warc.read_archives(spark, f"{tmp_path}/c")).collect()
    assert sorted(r["type"] for r in read) == ["response"] * 7 + ["revisit"] * 2 and len({r["capture"] for r in read}) == 9
    held = {r["capture"]: r["response"]["payload_bytes"] for r in read}
    assert all(held[r["response"]["refers_to"]] == 200 for r in read if r["type"] == "revisit")
    warc.write_archives(pages(spark, []), f"{tmp_path}/b")
    assert warc.assemble(warc.read_archives(spark, f"{tmp_path}/b")).count() == 0


def test_pipeline_stages(spark, odd, tmp_path):
    folder = str(tmp_path)
    items(spark).write.parquet(f"{folder}/benchmark.parquet")
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, folder).columns == odd.columns
        stage(spark, odd, folder).collect()
