"""The Merkle manifest against a plain recomputation, with several rounds of exchange."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from objectlog.llm import manifest
from objectlog.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hashed(parts):
    return sha256("".join(parts).encode()).hexdigest()


def told(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(nodes):
    """(subroot, for each node the runs it passes with its place in them)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            paths[k].append((nodes[i // 8 * 8 : i // 8 * 8 + 8], i % 8))
            at[k] = i // 8
        nodes = [hashed(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def fold(node, path):
    for run, at in path:
        node = hashed([*run[:at], node, *run[at + 1 :]])
    return node


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    lower = lambda t: t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    leaves = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = hashed([told((doc_id, source, lang, n_chars, text))])
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        moved = hashed([told((doc_id, source, lang, n_chars, lower(text)))]) if changed else leaf
        leaves.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, moved, doc_id))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: climb([x[2] for x in sorted(leaves[g])]) for g in langs}
    root, tops = climb([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        for (_, _, leaf, moved, doc_id), path in zip(sorted(leaves[g]), trees[g][1]):
            whole = path + top
            proof = hashed([h for run, at in whole for i, h in enumerate(run) if i != at])
            folded = fold(moved, whole)
            out.append((doc_id, leaf, trees[g][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def rows_of(n, langs):
    made = [(i * 3, f"Text {i} Wört", langs[i % len(langs)], "S", i) for i in range(n)]
    odd = [
        (None, None, None, None, None), (None, "x", "en", "s", 1), (7, "A", None, "s", 1), (7, "A", None, "s", 1), (7, "b", None, "s", 1),
        (8, "", "lone", None, 0), (9, "Very LONG " * 50_000, "en", "s", 1),
    ]
    return made + odd


@pytest.mark.parametrize("height, n, langs", [(1, 700, ["en", "de", "en", "en"]), (1, 90, [f"l{i}" for i in range(20)]), (4, 300, ["en", "zz"])])
def test_against_recomputation(spark, height, n, langs):
    rows = rows_of(n, langs)
    docs = prepare(spark).createDataFrame(rows, SCHEMA).repartition(5)
    docs = docs.select("*", *[F.lit("mine").alias(c) for c in ("g", "part", "root", "key", "group", "items", "a.b")])
    found = manifest.manifest(docs, manifest.lowered(), height=height, paths=True).collect()
    got = [(r["key"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in found]
    assert sorted(got, key=str) == brute(rows)
    assert all(manifest.folded(r["leaf"], [tuple(p) for p in r["path"]]) == r["root"] for r in found)


def test_one_row_and_none(spark):
    docs = prepare(spark).createDataFrame([(1, "a", "en", "s", 1)], SCHEMA)
    (one,) = manifest.manifest(docs).collect()
    assert one["leaf"] == one["subroot"] == one["root"] and one["verified"] and one["proof_sha256"] == hashed([])
    assert manifest.manifest(docs.limit(0)).collect() == []
