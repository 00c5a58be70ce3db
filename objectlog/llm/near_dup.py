"""Near-duplicate texts: MinHash bands propose, sequential Bayesian tests prune, full shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import fold
from ..operators.components import stars
from . import simhash
from .common import stored, utf8

#: Signature values compared at once; after each such batch the candidates that look hopeless go.
BATCH = 32
MINIMA = 128
#: Members of a bucket that are compared in one task; larger buckets are dealt out in pairs of blocks of half that weight.
GROUP = 2048
#: Buckets above this size are split first, by the rarest shingles of their texts.
SPLIT = 16384
#: A text counts as one member for each so many shingles.
SHINGLES_A_MEMBER = 2000
_AT_ONCE = 512
_PAIRS_AT_ONCE = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(11).integers(0, 2**63, (2, MINIMA, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = pa.struct([("n", pa.int32()), ("sig", pa.binary()), ("buckets", pa.list_(pa.int64()))])
_SKETCH_SQL = "struct<n:int, sig:binary, buckets:array<bigint>>"


@dataclass(frozen=True)
class Rule:
    """Texts link if 100 * intersection >= percent * union of their shingles of `width` words.

    A pair right at the limit misses all bands with a probability of (1 - (percent / 100) ** rows) ** bands: 8e-5 as
    set here. `missed` is the posterior probability of reaching the limit below which a candidate is pruned; with 0 none
    is, and full sets decide on all of them. `bits`: texts whose fingerprints (see `simhash`) differ in that many bits or
    fewer are candidates too; None asks for no fingerprint.
    """

    width: int = 3
    percent: int = 85
    bands: int = 20
    rows: int = 6
    missed: float = 0.001
    bits: int | None = None

    def floors(self) -> list[int]:
        """Fewest equal values among the first BATCH, 2 * BATCH, ... with which a candidate goes on.

        With a uniform prior the posterior probability of a similarity s or more, m of n values being equal, is that of
        at most m hits in n + 1 draws that hit with probability s.
        """
        s, found = self.percent / 100, []
        for n in range(BATCH, MINIMA + 1, BATCH):
            below = 0.0
            for m in range(n + 1):
                below += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
                if below >= self.missed:
                    break
            found.append(m)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles, A-Z lower-cased; fewer words than `width`: of all together."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    codes = np.array([digest(w) for w in words], np.uint64)
    width = min(width, len(codes))
    rolled = np.full(len(codes) - width + 1, width, np.uint64)
    for k in range(width):
        rolled = rolled * _ODD + codes[k : k + len(rolled)]
    return np.unique(_mixed(rolled))


def sketch(text: bytes, rule: Rule) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of distinct shingles, MINIMA minima (upper halves), and a hash for each band of them."""
    found = shingles(text, rule.width)
    least = np.full(MINIMA, ~np.uint64(0), np.uint64)
    for at in range(0, len(found), _AT_ONCE):
        part = (found[None, at : at + _AT_ONCE] ^ _RANDOM[0]) * _RANDOM[1]
        np.minimum(least, part.min(axis=1), out=least)
    least >>= np.uint64(32)
    rolled = np.arange(rule.bands, dtype=np.uint64)
    for value in least[: rule.bands * rule.rows].reshape(rule.bands, rule.rows).T:
        rolled = _mixed(rolled * _ODD + value)
    return len(found), least.astype("<u4"), rolled.view(np.int64)


def _sketches(rule: Rule) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        made = (sketch(t or b"", rule) for t in texts.to_pylist())
        return pa.array([{"n": n, "sig": s.tobytes(), "buckets": b.tolist()} for n, s, b in made], _SKETCH)

    return run


def _sets(width: int) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t or b"", width).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return run


def _matrix(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), "<u4").reshape(-1, MINIMA)


def survivors(floors: list[int], a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[i], b[j]) of signatures stay in play through all batches of values."""
    alive = np.arange(len(i))
    equal = np.zeros(len(i), np.int32)
    for k, floor in enumerate(floors):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal + (a[i[alive], cut] == b[j[alive], cut]).sum(axis=1, dtype=np.int32)
        on = equal >= floor
        alive, equal = alive[on], equal[on]
    return alive


def _promising(rule: Rule) -> Callable[[pa.Array, pa.Array], pa.Array]:
    floors = rule.floors()

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        both = np.arange(len(left))
        passed = np.zeros(len(left), bool)
        if len(left):
            passed[survivors(floors, _matrix(left), _matrix(right), both, both)] = True
        return pa.array(passed)

    return run


def text_key() -> Column:
    """What a text is told apart by. Null is like the empty text."""
    return F.unhex(F.md5(F.coalesce(utf8("text"), F.lit(b""))))


def _alike(n: str, m: str, rule: Rule) -> Column:
    """Sets of these sizes can reach the limit."""
    return 100 * F.least(n, m) >= rule.percent * F.greatest(n, m)


def _linked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (u, v) whose full sets reach the limit."""
    left, right = (sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}")) for x in ("u", "v"))
    both = F.size(F.array_intersect("su", "sv")).alias("both")
    sized = pairs.join(left, "u").join(right, "v").select("u", "v", (F.size("su") + F.size("sv")).alias("n"), both)
    return sized.where(100 * F.col("both") >= rule.percent * (F.col("n") - F.col("both"))).select("u", "v")


_MEMBER = pa.schema(
    [("bucket", pa.int64()), ("hub", pa.int64()), ("node", pa.int64()), ("component", pa.int64()), ("n", pa.int32()), ("sig", pa.binary())]
)
_MEMBER_SQL = "bucket bigint, hub bigint, node bigint, component bigint, n int, sig binary"
_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


class _Groups:
    """The members of a batch's groups (one row each) as columns, and their pairs that stay in play."""

    def __init__(self, batch: pa.RecordBatch, rule: Rule):
        lists = batch.column("members")
        self.flat, self.rule, self.floors = lists.flatten(), rule, rule.floors()
        sizes = np.diff(lists.offsets.to_numpy())
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
        self.hub = batch.column("hub").to_numpy(zero_copy_only=False)
        self.apart = (batch.column("lo").to_numpy() != batch.column("hi").to_numpy()) if len(sizes) else np.zeros(0, bool)
        self.node, self.component, self.n, self.block = (
            self.flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "n", "block")
        )
        self.sig = _matrix(self.flat.field("sig"))

    def pairs(self, g: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different components in group g, by parts: positions i < j."""
        a, b = self.starts[g], self.starts[g + 1]
        step = max(1, _PAIRS_AT_ONCE // (b - a))
        for at in range(a, b, step):
            rows, cols = np.arange(at, min(b, at + step))[:, None], np.arange(a, b)[None, :]
            meet = (rows < cols) & (self.component[rows] != self.component[cols])
            meet &= (self.node[rows] != self.hub[g]) & (self.node[cols] != self.hub[g])
            if self.apart[g]:
                meet &= self.block[rows] != self.block[cols]
            low, high = np.minimum(self.n[rows], self.n[cols]), np.maximum(self.n[rows], self.n[cols])
            i, j = np.nonzero(meet & (100 * low.astype(np.int64) >= self.rule.percent * high.astype(np.int64)))
            i, j = i + at, j + a
            alive = survivors(self.floors, self.sig, self.sig, i, j)
            yield i[alive], j[alive]


def _still_open(rule: Rule) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The members of each group that have a promising partner in another component."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = _Groups(batch, rule)
            seen, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g in range(len(groups.bucket)):
                met = np.unique(np.concatenate([np.concatenate(p) for p in groups.pairs(g)] or [np.zeros(0, np.int64)]))
                seen.append(met)
                of.append(np.full(len(met), g))
            at, group = np.concatenate(seen).astype(np.int64), np.concatenate(of).astype(np.int64)
            fields = [groups.flat.field(c).take(pa.array(at)) for c in ("node", "component", "n", "sig")]
            yield pa.RecordBatch.from_arrays([pa.array(groups.bucket[group]), pa.array(groups.hub[group]), *fields], schema=_MEMBER)

    return run


def _links_between(rule: Rule) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links that join components, checked on full sets; a pair that earlier links join already is not looked at."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = _Groups(batch, rule)
            sets = groups.flat.field("set")
            links: list[tuple[int, int]] = []
            for g in range(len(groups.bucket)):
                above: dict[int, int] = {}

                def top(c: int) -> int:
                    while c in above:
                        c = above[c]
                    return c

                for i, j in groups.pairs(g):
                    for x, y in zip(i.tolist(), j.tolist()):
                        p, q = top(int(groups.component[x])), top(int(groups.component[y]))
                        if p == q:
                            continue
                        one, two = sets[x].values.to_numpy(), sets[y].values.to_numpy()
                        both = len(np.intersect1d(one, two, assume_unique=True))
                        if 100 * both >= rule.percent * (len(one) + len(two) - both):
                            above[max(p, q)] = min(p, q)
                            u, v = int(groups.node[x]), int(groups.node[y])
                            links.append((max(u, v), min(u, v)))
            u, v = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_LINK)

    return run


def _by_prints(texts: DataFrame, bits: int) -> DataFrame:
    """node, n, bucket: a bucket for each fingerprint, with the texts that have it or a greater one within `bits` of it."""
    pairs = stored(simhash.close_pairs(texts.select(F.col("fp").alias("_fp")).distinct(), bits), "near-prints")
    near = texts.select("node", "n", F.col("fp").alias("u")).join(pairs, "u").select("node", "n", F.col("v").alias("fp"))
    bucket = F.xxhash64(F.lit("fingerprint"), "fp").alias("bucket")
    return texts.select("node", "n", "fp").unionByName(near).select("node", "n", bucket)


def _mixed_only(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    mixed = fold(members, "bucket", F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    return members.join(mixed.select("bucket"), "bucket", "left_semi")


def _fall_apart(members: DataFrame, sets: DataFrame, rule: Rule, limit: int) -> DataFrame:
    """Very large buckets under keys of their own texts' shingles; no pair that reaches the limit loses its last key.

    Such a pair shares at least percent / 100 of either set. So, in any common order of the shingles, it shares one of
    those that remain of either set when all but one of that many of its last shingles go. The order is from rare to
    common within the bucket, which keeps the new buckets small; whatever is still large is dealt out in pairs of blocks.
    """
    sizes = fold(members, "bucket", F.count(F.lit(1)).alias("size")).where(F.col("size") > limit).select("bucket")
    if sizes.isEmpty():
        return members
    sizes = stored(sizes, "near-large")
    small = members.join(sizes, "bucket", "left_anti").select(*members.columns)
    large = members.join(sizes, "bucket")
    held = large.select("bucket", "node").join(sets, "node").select("bucket", "node", F.explode("set").alias("shingle"))
    held = stored(held.withColumn("key", F.xxhash64("bucket", "shingle")), "near-shingles")
    # A key of one text leads to no pair; it only takes a place in the order, before all others.
    counts = fold(held, "key", F.count(F.lit(1)).alias("held")).where("held > 1")
    common = held.join(counts, "key").select("bucket", "node", F.struct("held", "key").alias("at"))
    ordered = common.groupBy("bucket", "node").agg(F.sort_array(F.collect_list("at")).alias("at"))
    rare = F.floor((100 - rule.percent) * F.col("n") / 100) + 1 - (F.col("n") - F.size("at"))
    keys = F.slice("at", F.lit(1), F.greatest(rare, F.lit(0)).cast("int"))
    dealt = ordered.join(large.select("bucket", "node", "n"), ["bucket", "node"]).select("bucket", "node", F.explode(keys).alias("at"))
    named = large.join(dealt, ["bucket", "node"]).withColumn("bucket", F.col("at.key")).select(*members.columns)
    return stored(_mixed_only(small.unionByName(named)), "near-split")


def _groups(members: DataFrame, group: int, *more: str) -> DataFrame:
    """bucket, hub, lo, hi, members: one row per bucket, or per pair of blocks of a bucket that is too heavy for one."""
    weight = F.lit(1) + (F.col("n") / SHINGLES_A_MEMBER).cast("bigint")
    heavy = fold(members.withColumn("w", weight), "bucket", F.sum("w").alias("weight"))
    blocks = F.when(F.col("weight") > group, F.ceil(F.col("weight") * 2 / group)).otherwise(1).cast("int")
    placed = members.join(heavy, "bucket").withColumn("blocks", blocks)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("*", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    rows = F.collect_list(F.struct("node", "component", "n", "sig", "block", *more)).alias("members")
    return dealt.groupBy("bucket", "hub", "lo", "hi").agg(rows)


def components(docs: DataFrame, rule: Rule = Rule(), group: int = GROUP, split: int = SPLIT) -> DataFrame:
    """key, least, n, component, least_of: the distinct texts of `docs` that have words (see `text_key`).

    least: the smallest doc_id of the text; component: a number shared by all texts that links reach; least_of: the
    smallest doc_id of its texts.

    1. Texts meet in buckets, one for each band of minima (and of near fingerprints, if `rule.bits` asks for them). Every
       text is a candidate with the hub of its bucket only, the text that shares most buckets with others: as many
       candidates as memberships, however large a bucket.
    2. Candidates lose out as soon as a batch of signature values makes it improbable that they reach the limit (none
       does if `rule.missed` is 0); the full shingle sets of the others are compared.
    3. A bucket whose texts then lie in one component has nothing left to find. In the others, members of different
       components are compared batch by batch inside a task, without a row for each pair; those with a promising
       partner are brought together once more with their full sets. Buckets that are too heavy are dealt out as pairs
       of blocks, very large ones are split before by rare shingles that alike texts must share.
    """
    key = text_key()
    made = F.arrow_udf(_sketches(rule), _SKETCH_SQL)
    more = {} if rule.bits is None else {"fp": F.arrow_udf(simhash.fingerprints, "bigint")(utf8("text"))}
    texts = (
        docs.select("doc_id", key.alias("key"), made(utf8("text")).alias("f"), *[c.alias(n) for n, c in more.items()])
        .groupBy("key")
        .agg(F.min("doc_id").alias("least"), F.first("f").alias("f"), *[F.first(n).alias(n) for n in more])
        .where("f.n > 0")
    )
    texts = stored(texts.select(F.monotonically_increasing_id().alias("node"), "key", "least", "f.*", *more), "near-texts")
    places = texts.select("node", "n", F.explode("buckets").alias("bucket"))
    if rule.bits is not None:
        places = places.unionByName(_by_prints(texts, rule.bits))
    # Folded before they travel, and under a struct, so that the joins have exchanges that Spark can split.
    full = fold(places, "bucket", F.count(F.lit(1)).alias("size")).where("size > 1")
    met = stored(places.join(full, "bucket"), "near-places")
    central = fold(met, "node", F.sum("size").alias("central"))
    hubs = fold(
        met.join(central, "node"), "bucket", F.max(F.struct("central", F.negative("node").alias("less"), "n")).alias("hub")
    ).select("bucket", F.negative("hub.less").alias("hub"), F.col("hub.n").alias("m"))
    members = stored(met.select("bucket", "node", "n").join(hubs, "bucket"), "near-members")

    wanted = texts.join(met.select("node").distinct(), "node", "left_semi").select("node", "key", F.xxhash64("least").alias("at"))
    source = docs.select(key.alias("key"), F.xxhash64("doc_id").alias("at"), utf8("text").alias("text"))
    found = source.join(wanted, ["key", "at"]).groupBy("key", "at", "node").agg(F.first("text").alias("text"))
    sets = stored(found.select("node", F.arrow_udf(_sets(rule.width), "array<bigint>")("text").alias("set")), "near-sets")

    first = members.where((F.col("node") != F.col("hub")) & _alike("n", "m", rule)).select(
        F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")
    )
    hopeful = first.distinct()
    if rule.missed > 0:
        left, right = (texts.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}")) for x in ("u", "v"))
        promising = F.arrow_udf(_promising(rule), "boolean")
        hopeful = hopeful.join(left, "u").join(right, "v").where(promising("su", "sv")).select("u", "v")
    links = stored(_linked(stored(hopeful, "near-hopeful"), sets, rule), "near-links")

    reached = stored(stars(links).select(F.col("object_id").alias("node"), "component"), "near-reached")
    placed = members.select("bucket", "hub", "node", "n").join(reached, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    open_ = stored(_mixed_only(placed).join(texts.select("node", "sig"), "node"), "near-open")
    rest = stored(_groups(_fall_apart(open_, sets, rule, split), group).mapInArrow(_still_open(rule), _MEMBER_SQL).distinct(), "near-rest")
    further = _groups(rest.join(sets, "node"), group, "set").mapInArrow(_links_between(rule), "u bigint, v bigint")
    ends = stars(links.unionByName(stored(further, "near-further"))).select(F.col("object_id").alias("node"), "component")
    whole = stored(
        texts.select("node", "key", "least", "n").join(ends, "node", "left").withColumn("component", F.coalesce("component", "node")),
        "near-whole",
    )
    return whole.join(fold(whole, "component", F.min("least").alias("least_of")), "component").drop("node")


def duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id among the texts that links reach (see `Rule` and `components`); kept: it is the
    row's own doc_id. Equal texts are linked. Null texts and texts without words have no shingle and are linked with
    nothing, not with each other either. A row without an id has the id of its component, null if none of it has one;
    it is kept only if its component has none. Repeated rows get equal rows. An empty table gives an empty one. Other
    columns are ignored.
    """
    ends = stored(components(docs, rule).select("key", "n", "least_of"), "near-ends")
    rows = docs.select("doc_id", text_key().alias("key")).join(ends, "key", "left")
    own = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least_of"))
    return rows.select(
        "doc_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        own.alias("component_id"),
        own.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY 1, 2, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
least AS (SELECT u, min(v) AS c FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN least ON least.u = doc_id
"""
