"""Hard negatives: exact scores against Hilbert-ordered blocks, of which zone maps choose those worth reading."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a block, anchors scored together, and zone maps looked at together.
BLOCK, CHUNK, PAGE = 512, 128, 512
#: The curve runs over the leading directions of about this many rows, drawn by a hash of their ids. It decides how well
#: rows that are alike lie together, not what is found.
FIT_ROWS = 4096
AXES, BITS = 10, 6
POSITIVES, NEGATIVES = 5, 5
LOW_PERCENT, HIGH_PERCENT = 80, 100
ANCHOR_EVERY, SHIFT_EVERY, CLASSES, SCALE = 100, 7, 10, 256
#: Components and scores beyond these stay at the limit; vectors of common size are far below.
_LARGEST, _END = 2**40, 2**55
_EXACT = 2**53

_ITEM = "struct<anchor:bigint, vector:binary, windows:array<struct<tag:int, low:bigint, high:bigint>>>"
_ITEM_ARROW = pa.struct(
    [
        ("anchor", pa.int64()),
        ("vector", pa.binary()),
        ("windows", pa.list_(pa.struct([("tag", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]))),
    ]
)


def rows_of(vectors: DataFrame) -> DataFrame:
    """vec_id, label, q of the rows that take part: an id, a label, and a vector of finite components only."""
    component = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    moved = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    return whole.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        moved.cast("long").alias("label"),
        F.transform(component, lambda x: F.floor(F.greatest(F.lit(-float(_LARGEST)), F.least(F.lit(float(_LARGEST)), x * SCALE)))).alias("q"),
    )


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of `cells` (whole numbers under 2 ** bits), bits * columns <= 63."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # turn each smaller cube as the larger one demands
        mask = bit - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & mask)
            x[0] ^= np.where(on, mask, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _curve(rows: DataFrame, count: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, offsets and scales that turn a vector into cells."""
    share = min(1.0, FIT_ROWS / max(1, count))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).limit(2 * FIT_ROWS).collect()
    sample = _padded([r["q"] for r in sorted(drawn)], width).astype(float) if drawn else np.zeros((1, width))
    middle = sample - sample.mean(axis=0)
    axes = np.linalg.eigh(middle.T @ middle)[1][:, ::-1][:, :AXES]
    along = sample @ axes
    low = along.min(axis=0)
    return axes, low, np.maximum(along.max(axis=0) - low, 1e-9)


def _padded(vectors: list, width: int) -> np.ndarray:
    found = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(found, vectors):
        row[: len(v)] = v
    return found


def _keys(axes: np.ndarray, low: np.ndarray, scale: np.ndarray, width: int) -> Callable[[pa.Array], pa.Array]:
    def run(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.int64())
        along = (_padded(vectors.to_pylist(), width) @ axes - low) / scale
        cells = np.clip(along * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return pa.array(hilbert(cells, BITS))

    return run


_BLOCK = pa.schema(
    [("block", pa.int64()), ("label", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())]
)
_BLOCK_SQL = "block bigint, label bigint, ids binary, vectors binary, lo binary, hi binary"


def _packed(width: int, size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Consecutive rows of one label as blocks: ids, vectors, and the least and greatest value of each dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            label = batch.column("label").to_numpy()
            ids = batch.column("vec_id").to_numpy()
            edges = np.flatnonzero(np.diff(label)) + 1
            for a, b in zip([0, *edges], [*edges, len(label)]):
                for at in range(a, b, size):
                    cut = slice(at, min(b, at + size))
                    q = _padded(batch.column("q")[cut.start : cut.stop].to_pylist(), width)
                    row = (number, int(label[at]), ids[cut].tobytes(), q.tobytes(), q.min(axis=0).tobytes(), q.max(axis=0).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)
                    number += 1

    return run


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers, exact; beyond _END it stays there."""
    most = (int(np.abs(a).max(initial=0)) + 1) * (int(np.abs(b).max(initial=0)) + 1) * max(1, a.shape[1])
    if most < _EXACT:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    exact = a.astype(object) @ b.astype(object)
    return np.clip(exact, -_END, _END).astype(np.int64)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> list[int]:
    """Positions of the first k rows of different ids: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score))
    found: list[int] = []
    for at in order:
        if not any(ids[at] == ids[f] for f in found):
            found.append(int(at))
            if len(found) == k:
                break
    return found


def _anchors(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The anchors of each block, with the score that their last positive reaches at least, as their own block shows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                ids, q = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["vectors"], np.int64).reshape(-1, width)
                out = []
                for at in np.flatnonzero(ids % ANCHOR_EVERY == 0):
                    other = np.flatnonzero(ids != ids[at])
                    score = _product(q[at : at + 1], q[other].T)[0]
                    best = _first(score, ids[other], POSITIVES)
                    floor = int(score[best[-1]]) if len(best) == POSITIVES else -_END
                    out.append({"anchor": int(ids[at]), "label": one["label"], "block": one["block"], "vector": q[at].tobytes(), "floor": floor})
                if out:
                    yield pa.RecordBatch.from_pylist(out, _ANCHOR)

    return run


_ANCHOR = pa.schema([("anchor", pa.int64()), ("label", pa.int64()), ("block", pa.int64()), ("vector", pa.binary()), ("floor", pa.int64())])
_ANCHOR_SQL = "anchor bigint, label bigint, block bigint, vector binary, floor bigint"


def _chunks(asked: DataFrame, size: int) -> DataFrame:
    """label, items: up to `size` questions of one label that lie together on the curve, in one row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.int64()), ("items", pa.list_(_ITEM_ARROW))])
        for batch in batches:
            label = batch.column("label").to_numpy()
            items = pa.StructArray.from_arrays(
                [batch.column(f.name).cast(f.type) for f in _ITEM_ARROW], fields=list(_ITEM_ARROW)
            )
            edges = np.flatnonzero(np.diff(label)) + 1
            for a, b in zip([0, *edges], [*edges, len(label)]):
                for at in range(a, b, size):
                    part = items[at : min(b, at + size)]
                    whole = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
                    yield pa.RecordBatch.from_arrays([pa.array([label[at]], pa.int64()), whole], schema=schema)

    ordered = asked.select("label", "block", "anchor", "vector", "windows").orderBy("label", "block", "anchor")
    return ordered.drop("block").mapInArrow(run, f"label bigint, items array<{_ITEM}>")


def _requests(width: int, same: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, items): the questions that interval arithmetic on the zone maps can't answer without the block.

    A score lies between the sums of the least and of the greatest product in each dimension.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("items", pa.list_(_ITEM_ARROW))])
        for batch in batches:
            for row in range(batch.num_rows):
                zones = batch.column("zones")[row].values
                lo, hi = (np.frombuffer(b"".join(zones.field(c).to_pylist()), np.int64).reshape(-1, width) for c in ("lo", "hi"))
                fits = (zones.field("label").to_numpy() == batch.column("label")[row].as_py()) == same
                items = batch.column("items")[row].values
                asked = items.to_pylist()
                a = np.frombuffer(b"".join(x["vector"] for x in asked), np.int64).reshape(-1, width)
                plus, minus = np.maximum(a, 0), np.minimum(a, 0)
                top = _product(plus, hi.T) + _product(minus, lo.T)
                bottom = _product(plus, lo.T) + _product(minus, hi.T)
                need = np.zeros(top.shape, bool)
                for at, x in enumerate(asked):
                    for w in x["windows"]:
                        need[at] |= (top[at] >= w["low"]) & (bottom[at] <= w["high"])
                need &= fits
                where = np.flatnonzero(need.any(axis=0))
                if len(where):
                    picks = [np.flatnonzero(need[:, z]) for z in where]
                    ends = np.concatenate([[0], np.cumsum([len(p) for p in picks])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), items.take(pa.array(np.concatenate(picks))))
                    yield pa.RecordBatch.from_arrays([zones.field("block").take(pa.array(where)), lists], schema=schema)

    return run


def _scores(width: int, k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(anchor, tag, id, score): the first k rows of the block in each window asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("tag", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
        for batch in batches:
            out = []
            for one in batch.to_pylist():
                ids, q = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["vectors"], np.int64).reshape(-1, width)
                a = np.frombuffer(b"".join(x["vector"] for x in one["items"]), np.int64).reshape(-1, width)
                for x, score in zip(one["items"], _product(a, q.T)):
                    for w in x["windows"]:
                        # Tag 0 asks for positives: rows other than the anchor.
                        held = np.flatnonzero((score >= w["low"]) & (score <= w["high"]) & ((w["tag"] > 0) | (ids != x["anchor"])))
                        for at in _first(score[held], ids[held], k):
                            out.append((x["anchor"], w["tag"], int(ids[held[at]]), int(score[held[at]])))
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _search(asked: DataFrame, pages: DataFrame, n_pages: int, blocks: DataFrame, width: int, same: bool, k: int) -> DataFrame:
    """anchor, tag, id, score, rank: the first k rows of each window, among rows of the same label or of all others."""
    chunks = _chunks(asked, CHUNK).withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))))
    requests = chunks.join(pages, "page").mapInArrow(_requests(width, same), f"block bigint, items array<{_ITEM}>")
    met = requests.join(blocks.select("block", "ids", "vectors"), "block")
    hits = met.mapInArrow(_scores(width, k), "anchor bigint, tag int, id bigint, score bigint")
    once = hits.groupBy("anchor", "tag", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("anchor", "tag").orderBy(F.desc("score"), "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def candidate_blocks(rows: DataFrame, size: int = BLOCK) -> tuple[DataFrame, int]:
    """The blocks, written as Parquet, one row each (block, label, ids, vectors, lo, hi), and the vectors' width."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("width")).first()
    width = max(1, facts["width"] or 0)
    key = F.arrow_udf(_keys(*_curve(rows, facts["n"], width), width), "bigint")
    ordered = rows.withColumn("key", key("q")).orderBy("label", "key", "vec_id").select("vec_id", "label", "q")
    return stored(ordered.mapInArrow(_packed(width, size), _BLOCK_SQL), "negative-blocks"), width


def mine(vectors: DataFrame, size: int = BLOCK, page: int = PAGE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without an id, a label or a vector, or with a component that is null or not finite, take no part. Labels move
    on by one (modulo CLASSES) where SHIFT_EVERY divides the id; components become floor(SCALE * x). Scores are whole
    inner products; higher ones come first, ties by smaller id. Shorter vectors count as padded with zeros;
    components beyond 2 ** 40 and scores beyond 2 ** 55 stay there. Anchors are rows whose id ANCHOR_EVERY divides; their positives the first
    POSITIVES other rows of their label. For each pair the first NEGATIVES rows of other labels whose score lies
    between LOW_PERCENT and HIGH_PERCENT % of the positive's are returned; pairs without any do not appear, so those of
    a negative positive score never do. Rows that repeat an id count once in a list, with the best score there; an
    anchor that repeats is one, that with the smallest label and then vector (by bytes). An empty table gives an empty
    one. Other columns are ignored.

    1. Rows are sorted by label and Hilbert key and cut into blocks. An equal key, however frequent, is cut by id.
    2. Every block with an anchor gives the anchor's first positives in it, and so a score that all others must reach.
    3. Anchors, in chunks, meet the zone maps, in pages; what the maps can't rule out becomes a request for a block,
       first for the positives, then for the windows that they open. A block reads its requests and answers with the
       first rows of each window; the answers fold by rank. The results are exact, whatever the maps rule out.
    """
    blocks, width = candidate_blocks(rows_of(vectors), size)
    n_pages = max(1, -(-blocks.count() // page))
    place = F.pmod(F.xxhash64("block"), F.lit(n_pages)).cast("int").alias("page")
    pages = stored(blocks.groupBy(place).agg(F.collect_list(F.struct("block", "label", "lo", "hi")).alias("zones")), "negative-zones")
    seeds = blocks.mapInArrow(_anchors(width), _ANCHOR_SQL).groupBy("anchor")
    anchors = stored(seeds.agg(F.min(F.struct("label", "vector", "block", "floor")).alias("x")).select("anchor", "x.*"), "negative-anchors")
    window = lambda tag, low, high: F.struct(
        tag.cast("int").alias("tag"), low.cast("long").alias("low"), high.cast("long").alias("high")
    )
    every = F.array(window(F.lit(0), F.col("floor"), F.lit(_END)))
    first = _search(anchors.withColumn("windows", every), pages, n_pages, blocks, width, True, POSITIVES)
    positives = stored(
        first.select("anchor", F.col("rank").alias("tag"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negative-positives"
    )
    least = F.expr(f"({LOW_PERCENT} * positive_score + {HIGH_PERCENT - 1}) div {HIGH_PERCENT}")
    opened = positives.where("positive_score >= 0").groupBy("anchor").agg(
        F.collect_list(window(F.col("tag"), least, F.col("positive_score"))).alias("windows")
    )
    found = _search(anchors.join(opened, "anchor"), pages, n_pages, blocks, width, False, NEGATIVES)
    return found.join(positives, ["anchor", "tag"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id,
       positive_score, score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 5
"""
