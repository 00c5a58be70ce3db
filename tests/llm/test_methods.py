"""The operators against brute force, exact round trips and held-out accuracy, on the small tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from objectlog.llm import decontam, html_text, line_dedup, mixing, quality, rans, sharding, simhash, token_output, url_filter, warc
from objectlog.llm.common import read

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, FOLDER, "documents")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_simhash_components(docs):
    got = {r["doc_id"]: r for r in simhash.clusters(docs).collect()}
    sets, prints = Sets(), {d: int(r["fingerprint"], 16) for d, r in got.items()}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                sets.link(a, b)
    assert {d: sets.find(d) for d in prints} == {d: r["component_id"] for d, r in got.items()}
    assert len({r["component_id"] for r in got.values()}) < len(got)


@pytest.mark.parametrize("segments", [2, 4])
def test_close_pairs_of_any_segments(spark, segments):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(8)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {(u, v) for u in signed for v in signed if u > v and ((u ^ v) & (1 << 64) - 1).bit_count() <= 4}
    got = simhash.close_pairs(spark.createDataFrame([(s,) for s in signed], "_fp long"), segments=segments).collect()
    assert {(r["u"], r["v"]) for r in got} == want


def test_fingerprint_by_hand():
    import xxhash

    text = "A b C d e f  G"
    words = ["a", "b", "c", "d", "e f", "g"]
    codes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(3)]
    bits = sum(1 << k for k in range(64) if sum(c >> k & 1 for c in codes) * 2 > 3)
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == bits


def test_decontam_windows_in_small_blocks(spark, docs):
    bench = read(spark, FOLDER, "benchmark")
    one = decontam.find(docs, bench).select("doc_id", "spans", "item_ids", "longest").orderBy("doc_id").collect()
    many = decontam.find(docs, bench, block_words=400).select("doc_id", "spans", "item_ids", "longest").orderBy("doc_id").collect()
    assert one == many and any(r["spans"] for r in one)
    items = [decontam.words_of(r["text"].encode()) for r in bench.collect()]
    keys = {tuple(w[i : i + 10]) for w in items for i in range(len(w) - 9)} | {tuple(w) for w in items if 0 < len(w) < 10}
    sizes = {len(k) for k in keys}
    for row in decontam.find(docs, bench).collect():
        words = decontam.words_of(row["text"].encode())
        hit = {i + j for n in sizes for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in keys for j in range(n)}
        assert row["n_hit"] == len(hit)
    clean = decontam.decontaminate(docs, bench)
    assert decontam.find(clean, bench).agg(F.sum("n_hit")).first()[0] == 0


def test_automaton_random():
    rng = random.Random(5)
    for _ in range(60):
        items = [(str(i), [b"%d" % rng.randint(0, 2) for _ in range(rng.randint(0, 9))]) for i in range(5)]
        words = [b"%d" % rng.randint(0, 3) for _ in range(40)]
        spans, names, _ = decontam.Automaton(items, 4).match(words)
        hit, found = set(), set()
        for name, w in items:
            size = min(4, len(w))
            for i in range(len(w) - size + 1):
                for j in range(len(words) - size + 1):
                    if size and words[j : j + size] == w[i : i + size]:
                        hit.update(range(j, j + size))
                        found.add(name)
        assert ({i for a, b in spans for i in range(a, b)}, names) == (hit, found)


def test_lines_by_brute_force(docs):
    lines = [r for r in line_dedup.lines_of(docs).collect()]
    grams = {r["norm"]: {r["norm"][i : i + 5] for i in range(max(1, len(r["norm"]) - 4))} for r in lines}
    sets = Sets()
    first = {}
    for r in sorted(lines, key=lambda r: (r["doc_id"], r["line_no"])):
        sets.link(first.setdefault(r["norm"], (r["doc_id"], r["line_no"])), (r["doc_id"], r["line_no"]))
    texts = sorted(grams, key=lambda t: len(grams[t]))
    links = []
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if len(grams[a]) < 0.8 * len(grams[b]):
                break
            both = len(grams[a] & grams[b])
            if both >= 0.8 * (len(grams[a]) + len(grams[b]) - both):
                links.append((a, b))
                sets.link(first[a], first[b])
    got = {(r["doc_id"], r["line_no"]): (r["keeper_doc"], r["keeper_line"]) for r in line_dedup.judge(docs).collect()}
    kept = sum(got[first[a]] == got[first[b]] for a, b in links)
    assert kept >= 0.95 * len(links)
    assert sum(got[k] == sets.find(k) for k in got) >= 0.99 * len(got)
    clean = line_dedup.keep_lines(docs).agg(F.sum(F.length("clean_text"))).first()[0]
    assert clean < docs.agg(F.sum(F.length("text"))).first()[0]


def test_large_family_of_lines(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(400):
        line = list(words)
        line[rng.randrange(60)] = f"other{i}"
        rows.append((i, " ".join(line)))
    got = line_dedup.judge(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").count()
    assert got == 1


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70_000, 65_536, 140_001])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 49_000).astype(np.uint16)
    table = rans.Table(*np.unique(ids, return_counts=True))
    block = rans.encode(ids, table)
    assert (rans.decode(block, table) == ids).all()
    for k in range(len(block["places"])):
        size = rans.LANES * rans.ROWS
        assert (rans.decode(block, table, k) == ids[k * size : (k + 1) * size]).all()
    if n:
        with pytest.raises(ValueError):
            rans.decode(block | {"crc": block["crc"] ^ 1}, table)


def test_tokens_as_the_library_has_them(spark, docs, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    more = spark.createDataFrame(
        [(10**6, "It's <|endoftext|> <|ENDOFTEXT|> don't!!  x y z \x01 a\x01b é İI Σς ,,. word,'s 12a3")],
        "doc_id long, text string",
    )
    both = docs.select("doc_id", "text").unionByName(more)
    token_output.write_tokens(both, f"{tmp_path}/t", path)
    got = token_output.read_tokens(spark, f"{tmp_path}/t").orderBy("doc_id").collect()
    tokenizer, start = Tokenizer.from_file(path), 0
    for row, doc in zip(got, both.orderBy("doc_id").collect(), strict=True):
        ids = np.array(tokenizer.encode(doc["text"], add_special_tokens=False).ids + [1], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_shards(docs):
    got = sharding.external_shuffle(docs, bucket_bytes=20_000).collect()
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r)
        assert r["text_crc32"] == zlib.crc32(r["text"].encode()) and r["size"] == len(r["text"].encode()) + 1
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by_shard.values())
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs.collect()} and len(got) == docs.count()
    wider = {r["doc_id"]: r["shard"] for r in sharding.external_shuffle(docs, shards=17).collect()}
    assert all(wider[r["doc_id"]] == r["grown_shard"] for r in got)
    rows = max(by_shard.values(), key=len)
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["slot"])] != sorted(r["doc_id"] for r in rows)


def test_url_models_by_hand(spark):
    pages = read(spark, FOLDER, "pages")
    rows = url_filter.judge(pages).select("url", "score", "rule", "verdict").collect()
    counts = [{"allow": {}, "block": {}} for _ in range(5)]
    form = lambda u: "\u0002" * 4 + u.translate({**{c: c + 32 for c in range(65, 91)}, **{c: 48 for c in range(49, 58)}}) + "\u0003"
    signs = set()
    for r in rows:
        t = form(r["url"])
        signs.update(t[4:])
        for i in range(4, len(t)):
            for k in range(5):
                if r["rule"]:
                    seen = counts[k][r["verdict"]].setdefault(t[i - k : i], {})
                    seen[t[i]] = seen.get(t[i], 0) + 1

    def p(kind, t, i):
        value = 1 / (len(signs) + 1)
        for k in range(5):
            seen = counts[k][kind].get(t[i - k : i])
            if seen:
                value = (max(seen.get(t[i], 0) - 0.75, 0) + 0.75 * len(seen) * value) / sum(seen.values())
        return value

    for r in rows[:60]:
        t = form(r["url"])
        want = np.mean([np.log(p("allow", t, i)) - np.log(p("block", t, i)) for i in range(4, len(t))])
        assert abs(want - r["score"]) < 1e-9
    known = [r for r in rows if r["rule"]]
    cut = min((r["score"] for r in rows if not r["rule"] and r["verdict"] == "allow"), default=0)
    assert np.mean([(r["score"] >= cut) == (r["verdict"] == "allow") for r in known]) > 0.9


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    even, odd = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").toPandas()
    mix = mixing.mix(docs, even, multiples={"good": 1.0, "poor": 1.0, "toxic": 0.0}).select("doc_id", "n_tokens", "posteriors", "rate", "copies")
    got = mix.toPandas().merge(odd, on="doc_id")
    said = np.stack(got["posteriors"])[:, 2] > 0.5
    assert np.mean(said == (got["toxic"] > 0)) > 0.96
    assert (got[got["toxic"] == 0]["copies"] >= 1).mean() > 0.97
    all_rows = mix.toPandas()
    p, n = np.stack(all_rows["posteriors"]), all_rows["n_tokens"].to_numpy()
    natural, now = n @ p, (n * all_rows["rate"]) @ p
    assert abs(now[:2] - natural[:2]).max() < 0.03 * natural.sum() and now[2] < 0.35 * natural[2]


def test_rates_are_the_least_squares_ones():
    rng = np.random.default_rng(0)
    p = rng.dirichlet((0.3, 0.3, 0.3), 300)
    n = rng.integers(1, 50, 300)
    natural = n @ p
    totals = natural.sum() * np.array([0.7, 0.3, 0.0])
    history, now = [], natural
    for _ in range(400):
        history.append(((now - totals) / natural).tolist())
        rate = mixing._rates(p, history)
        now = (n * rate) @ p
    slope = p @ ((now - totals) / natural) + mixing.RIDGE * (rate - 1)
    assert np.abs(slope[rate > 1e-6]).max() < 1e-3 and slope[rate == 0].min() > -1e-3


def test_html_of_pages_and_unseen_layouts(spark):
    import html as entities
    import re

    pages = read(spark, FOLDER, "pages")
    wrong = 0
    rows = html_text.extract(pages).collect()
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"</?b>", "", re.sub(r"<br>", " ", x)) for x in re.split(r"</?(?:p|h1|ul|li)>", article)]
        blocks = [" ".join(entities.unescape(x).split()) for x in parts]
        wrong += r["text"] != "\n\n".join(b for b in blocks if b)
    assert wrong <= 0.02 * len(rows)
    model, rng, same = html_text.fit(pages), random.Random(99), 0
    texts = [r["text"].split("\n\n") for r in rows if r["text"]]
    for _ in range(200):
        page = html_text.Page(html_text.layout(rng, rng.choice(texts)))
        want = [t for t, y in zip(page.text, html_text._layout_labels(page)) if t and y]
        same += html_text.decode(page, model.log_odds(html_text.features(page))) == want
    assert same >= 180


def test_warc_links_over_the_request(spark):
    columns = "record_id string, type string, concurrent_to string"
    rows = [("r", "response", "q"), ("q", "request", None), ("m", "metadata", "q"), ("n", "metadata", "r"), ("x", "metadata", "gone")]
    (got,) = warc.assemble(spark.createDataFrame(rows, columns)).collect()
    assert got["request"]["record_id"] == "q" and [m["record_id"] for m in got["metadata"]] == ["m", "n"]


def test_lines_count_distinct_documents_of_a_host(spark):
    """Plain counts: a line in over ten distinct texts of a host goes, with a block of ten such lines as with one."""
    own = lambda i: f"own words {i} of this text {i}\nand more {i}"
    block = [f"line {k} of the block" for k in range(10)]
    rows = [(i, "\n".join([*block, own(i), "seen by ten"] if i < 10 else [*block, own(i)]), "s") for i in range(30)]
    rows += [(100 + i, f"here eleven times\n{own(i)}", "s") for i in range(11)] + [(200 + i, f"one text again\n{own(7)}", "s") for i in range(40)]
    rows += [(300 + i, f"line 0 of the block\n{own(300 + i)}", "t") for i in range(10)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    left = {r["doc_id"]: (r["clean_text"] or "").split("\n") for r in got}
    assert all(not set(block) & set(left[i]) and own(i).split("\n")[0] in left[i] for i in range(30))
    assert all("seen by ten" in left[i] for i in range(10)) and not any("here eleven times" in left[100 + i] for i in range(11))
    assert all("one text again" in left[200 + i] for i in range(40)) and all("line 0 of the block" in left[300 + i] for i in range(10))


@pytest.mark.parametrize(("shared", "own"), [(2, 1), (5, 3), (10, 3), (10, 6), (10, 30)])
def test_blocks_of_many_lines_leave_the_corpus(spark, shared, own):
    rng = random.Random(shared * 100 + own)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(8))
    block = [line() for _ in range(shared)]
    long = lambda: " ".join(line() for _ in range(12))
    rows = []
    for i in range(300):
        mine = [line() if own > 10 else long() for _ in range(own)]
        rows.append((i, "\n".join(block + mine), "s"))
    original = [line() for _ in range(30)]
    for i in range(300, 360):  # near-copies: no line of theirs goes
        edited = list(original)
        edited[i % 30] = f"edited {i}"
        rows.append((i, "\n".join(edited), "s"))
    texts = {r["doc_id"]: r["text"].split("\n") for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(texts) == 360
    assert not any(set(block) & set(lines) for lines in texts.values())
    assert all(len(texts[i]) == 30 for i in range(300, 360))


def test_stage_of_near_duplicates_by_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for _ in range(120):
        base = [word() for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(base))
        for _ in range(2):
            edited = list(base)
            for _ in range(rng.randint(1, 6)):
                edited[rng.randrange(len(edited))] = word()
            texts.append(" ".join(edited))
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    sets, links = Sets(), 0
    for i, a in enumerate(grams):
        sets.find(i)
        for j in range(i + 1, i + 3 - i % 3):
            both = len(a & grams[j])
            if both >= 0.8 * (len(a) + len(grams[j]) - both):
                sets.link(i, j)
                links += 1
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, FOLDER).collect()}
    want = {i for i in range(len(texts)) if sets.find(i) == i}
    assert links > 100 and kept == want


def test_tokens_of_copies_meet_the_targets(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    got = mixing.mix(docs, labels, shares={"good": 0.85, "poor": 0.15, "toxic": 0.0}).toPandas()
    p, n = np.stack(got["posteriors"]), got["n_tokens"].to_numpy()
    made, asked = (n * got["copies"].to_numpy()) @ p, (n * got["rate"].to_numpy()) @ p
    assert abs(made - asked).max() < 0.015 * n.sum()
    assert abs(made - n.sum() * np.array([0.85, 0.15, 0.0])).max() < 0.03 * n.sum()
    assert (abs(got["copies"] - got["rate"]) < 1).all()
