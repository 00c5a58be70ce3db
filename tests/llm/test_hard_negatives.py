"""Hard negatives against brute force; the Hilbert curve."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from objectlog.llm import hard_negatives
from objectlog.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    held = []
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        held.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    anchors = {}
    for vec_id, label, q in held:
        if vec_id % 100 == 0:
            anchors[vec_id] = min(anchors.get(vec_id, (label, q)), (label, q))

    def first(scored, k):
        best = {}
        for score, vec_id in sorted(scored, key=lambda x: (-x[0], x[1])):
            best.setdefault(vec_id, score)
        return list(best.items())[:k]

    out = []
    for anchor, (label, q) in anchors.items():
        scores = [(sum(x * y for x, y in zip(q, p)), i, lab == label) for i, lab, p in held]
        for positive, high in first([(s, i) for s, i, same in scores if same and i != anchor], 5):
            inside = [(s, i) for s, i, same in scores if not same and 80 * high <= 100 * s <= 100 * high]
            for rank, (negative, score) in enumerate(first(inside, 5), 1):
                out.append((anchor, positive, rank, negative, high, score))
    return sorted(out)


def clustered(n, rng, dims=8):
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, [m + rng.gauss(0, 0.2) for m in middles[i % 6]], i % 3) for i in range(n)]


@pytest.mark.parametrize("size, page", [(hard_negatives.BLOCK, hard_negatives.PAGE), (16, 8)])
def test_against_brute_force(spark, size, page):
    rng = random.Random(3)
    rows = clustered(1500, rng)
    rows += [(2000 + i, [1.0] * 8, 1) for i in range(300)]  # ties, one hot vector
    rows += [(400, rows[400][1], rows[400][2])] * 2 + [(2100, [1.0] * 8, 2)] * 40  # repeated rows
    docs = prepare(spark).createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, hard_negatives.mine(docs, size, page).collect())) == brute(rows)


def test_edges(spark):
    good = [(i, [0.1 * i, 0.5, -0.25], i % 2) for i in range(1, 30)] + [(0, [0.3, 0.5], 0), (100, [1e30, 1.0, 0.0], 1), (200, [], 0)]
    bad = [(None, [1.0, 1.0, 1.0], 0), (300, None, 1), (500, [1.0, None, 1.0], 1), (600, [float("nan")] * 3, 1), (700, [float("inf")] * 3, 0), (800, [1.0] * 3, None)]
    docs = prepare(spark).createDataFrame(good + bad, SCHEMA)
    docs = docs.select("*", *[F.lit("mine").alias(c) for c in ("block", "anchor", "score", "rank", "a.b", "q", "key")])
    got = hard_negatives.mine(docs).collect()
    assert {r["anchor_id"] for r in got} <= {0, 100, 200}
    tame = [r for r in good if r[0] != 100]
    assert sorted(map(tuple, hard_negatives.mine(docs.where("vec_id <> 100")).collect())) == brute(tame)
    assert hard_negatives.mine(docs.limit(0)).collect() == []


def test_the_curve_visits_every_cell_in_steps_of_one():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(list(np.ndindex(*[1 << bits] * dims)))
        order = np.argsort(hard_negatives.hilbert(cells, bits))
        assert sorted(hard_negatives.hilbert(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_rule_blocks_out(spark):
    """On vectors in clusters most blocks are never read."""
    rows = clustered(6000, random.Random(4))
    blocks, width = hard_negatives.candidate_blocks(hard_negatives.rows_of(prepare(spark).createDataFrame(rows, SCHEMA)), 64)
    held = blocks.collect()
    lo, hi = (np.array([np.frombuffer(b[c], np.int64) for b in held]) for c in ("lo", "hi"))
    assert (hi - lo).mean() < 0.5 * (hi.max(axis=0) - lo.min(axis=0)).mean()
    assert sum(len(np.frombuffer(b["ids"], np.int64)) for b in held) == 6000
