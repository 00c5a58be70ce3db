"""Merkle manifest of a dataset: every row's leaf, its group's subroot, the root, and a proof, by butterfly exchange."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, lower_ascii, stored

FANOUT = 8
#: A part holds FANOUT ** HEIGHT consecutive leaves of a group, aligned, in one row.
HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Parts of one group meet the group's place in the upper tree over so many copies of it.
_SALTS = 16


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value; as bytes."""
    text = value.cast("string")
    told = F.concat(F.octet_length(text).cast("string"), F.lit(":")).cast("binary")
    return F.coalesce(F.concat(told, text.cast("binary")), F.lit(b"-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def digest(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str], up: int | None) -> list[list[str]]:
    """The nodes, and what every FANOUT consecutive ones become, `up` times (None: until one remains)."""
    found = [nodes]
    while up if up is not None else len(found[-1]) > 1:
        last = found[-1]
        found.append([digest(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
        up = up if up is None else up - 1
    return found


def _tops(height: int) -> Callable[[pa.Array, pa.Array], pa.Array]:
    def run(leaves: pa.Array, parts: pa.Array) -> pa.Array:
        lone = [n == 1 for n in parts.to_pylist()]
        return pa.array([levels(x, None if one else height)[-1][0] for x, one in zip(leaves.to_pylist(), lone)], pa.string())

    return run


def _parts(nodes: DataFrame, order: Sequence[str], height: int) -> DataFrame:
    """g, part, parts, items, top: the nodes (columns g, leaf and others) of each group in `order`, cut into aligned parts.

    A range sort, then the position in the sorted partition, less where the group begins in it, plus the group's nodes
    in earlier partitions: one small row for each (partition, group) tells both.
    """
    others = [c for c in nodes.columns if c != "g"]
    placed = stored(nodes.orderBy("g", *order, "leaf").withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    placed = placed.withColumns({"_run": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    runs = placed.groupBy("_run", "g").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("_from"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        "_run", "g", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"), F.sum("n").over(whole).alias("size")
    )
    size = FANOUT**height
    cut = placed.join(offsets, ["_run", "g"]).withColumn("pos", F.col("_pos") + F.col("_shift"))
    cut = cut.select("g", "pos", *others, F.floor(F.col("pos") / size).alias("part"), F.ceil(F.col("size") / size).alias("parts"))
    items = F.array_sort(F.collect_list(F.struct("pos", *others))).alias("items")
    made = cut.groupBy("g", "part", "parts").agg(items)
    top = F.arrow_udf(_tops(height), "string")(F.col("items.leaf"), F.col("parts"))
    return stored(made.withColumn("top", top), "merkle-parts")


def _exchange(parts: DataFrame) -> DataFrame:
    """g, part, top, runs: the group's subroot, and for each level above the parts the run (all nodes) and the own place.

    Round r: FANOUT neighbouring subtrees of FANOUT ** r parts each form one. Every part knows the top of its subtree
    and sends it to the parts that hold the same place in the other subtrees; each then hashes the run of tops, so all
    of them have the new top and no pass leads down again. In the last subtree places may be empty: the parts there
    serve these in turn. A round moves FANOUT short rows for each part.
    """
    none = F.array().cast("array<struct<run:array<string>, at:int>>")
    state = stored(parts.select("g", "part", "parts", "top", none.alias("runs")), "merkle-round")
    most = state.agg(F.max("parts")).first()[0] or 0
    span = 1
    while span < most:
        tree, place = F.floor(F.col("part") / span), F.col("part") % span
        first = F.floor(tree / FANOUT) * FANOUT
        trees = F.ceil(F.col("parts") / span)
        held = F.col("parts") - tree * span
        sent = (
            state.where(trees > 1)
            .select("g", "parts", "top", tree.alias("tree"), first.alias("first"), trees.alias("trees"),
                    F.explode(F.sequence(place, F.lit(span - 1).cast("long"), F.least(held, F.lit(span)))).alias("place"))
            .select("g", "parts", "top", "tree", "place",
                    F.explode(F.sequence("first", F.least(F.col("first") + FANOUT, F.col("trees")) - 1)).alias("to"))
            .select("g", (F.col("to") * span + F.col("place")).alias("part"), "parts", "tree", "top")
            .where(F.col("part") < F.col("parts"))
        )
        got = sent.groupBy("g", "part").agg(F.array_sort(F.collect_list(F.struct("tree", "top"))).alias("run"))
        run = F.col("run.top")
        level = F.array(F.struct(run.alias("run"), (tree - first).cast("int").alias("at")))
        state = stored(
            state.join(got, ["g", "part"], "left").select(
                "g", "part", "parts",
                F.when(run.isNull(), F.col("top")).otherwise(F.sha2(F.array_join(run, ""), 256)).alias("top"),
                F.when(run.isNull(), F.col("runs")).otherwise(F.concat("runs", level)).alias("runs"),
            ),
            "merkle-round",
        )
        span *= FANOUT
    return state.select("g", "part", "top", "runs")


def _path(rows: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """(hashes before, hashes after) among the siblings of node `at`, level by level."""
    for nodes in rows[:-1]:
        low = at // FANOUT * FANOUT
        yield "".join(nodes[low:at]), "".join(nodes[at + 1 : low + FANOUT])
        at //= FANOUT


def folded(node: str, path: Iterable[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest((before, node, after))
    return node


_PROOF = pa.schema(
    [("at", pa.int64())]
    + [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    + [("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))]
)


def _proofs(height: int, paths: bool, key: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each item of each part: its proof, and the root folded from its changed leaf, else from its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in batch.schema.names}
                items = one["items"].values
                leaves, changed = items.field("leaf").to_pylist(), items.field("changed").to_pylist()
                upper = []
                for step in one["runs"].as_py() + one["above"].as_py():
                    run, at = step["run"], step["at"]
                    upper.append(("".join(run[:at]), "".join(run[at + 1 :])))
                rows = levels(leaves, None if one["parts"].as_py() == 1 else height)
                above, ends = "".join(a + b for a, b in upper), {}
                out = {c: [] for c in ("proof_sha256", "folded_root", "path")}
                for at, leaf in enumerate(leaves):
                    path = list(_path(rows, at))
                    out["proof_sha256"].append(digest([*(a + b for a, b in path), above]))
                    top = folded(changed[at] or leaf, path)
                    if top not in ends:
                        ends[top] = folded(top, upper)
                    out["folded_root"].append(ends[top])
                    out["path"].append([{"before": a, "after": b} for a, b in path + upper] if paths else None)
                n = len(leaves)
                columns = {
                    "key": items.field(key), "leaf": items.field("leaf"), "subroot": [one["top"].as_py()] * n,
                    "root": [one["root"].as_py()] * n, **out,
                }
                arrays = [columns["key"], *[pa.array(columns[f.name], f.type) for f in list(_PROOF)[1:]]]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", *_PROOF.names[1:]])

    return run


def manifest(
    docs: DataFrame,
    changed: Column | None = None,
    *,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    key: str = "doc_id",
    height: int = HEIGHT,
    paths: bool = False,
) -> DataFrame:
    """One row per row of `docs`: key, leaf, subroot, root, proof_sha256, folded_root, verified, path.

    leaf: SHA-256 (hex) of the `fields` as `field` writes them. In a group the leaves ascend by `key` (nulls first, then
    by leaf); every FANOUT consecutive nodes become the hash of their concatenated hex text, the last ones too, until one
    remains, the subroot. The subroots, ordered by `group` (null first, then by bytes), become the root alike. The proof
    is what stands beside a node, level by level up to the root; proof_sha256 is its hash, path (null unless `paths`)
    the text before and after the node at each level. `changed` is the leaf of a changed row, null where it is as it
    was: folded_root folds it, else the own leaf, with the proof; verified: that is the root.

    Repeated rows are leaves of their own. A row's key may be null or repeated. An empty table gives an empty one, no
    root. Long texts are hashed where they are read; only digests travel. Other columns are ignored.

    Leaves are sorted once, over all groups; a part of FANOUT ** height leaves is one row, whatever the group's size.
    """
    g = field(col(group)).cast("string")
    other = F.lit(None).cast("string") if changed is None else changed
    rows = docs.select(
        g.alias("g"), col(group).alias("group"), col(key).alias("key"), leaf([col(f) for f in fields]).alias("leaf"), other.alias("changed")
    )
    parts = _parts(rows, ["key"], height)
    lower = _exchange(parts)
    least = parts.where("part = 0").select("g", F.col("items")[0]["group"].alias("group"))
    subroots = lower.where("part = 0").select("g", "top").join(least, "g")
    upper = _parts(subroots.select(F.lit("").alias("g"), "group", F.col("g").alias("of"), F.col("top").alias("leaf")), ["group"], height)
    places = stored(
        upper.drop("top").join(_exchange(upper), ["g", "part"]).mapInArrow(_places(height), "g string, salt int, above array<struct<run:array<string>, at:int>>, root string"),
        "merkle-places",
    )
    known = lower.withColumn("salt", F.pmod("part", F.lit(_SALTS)).cast("int")).join(places, ["g", "salt"]).drop("salt")
    whole = parts.drop("top").join(known, ["g", "part"])
    kind = docs.select(col(key)).schema[0].dataType.simpleString()
    texts = ", ".join(f"{c} string" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))
    out = f"key {kind}, {texts}, path array<struct<before:string, after:string>>"
    found = whole.mapInArrow(_proofs(height, paths, "key"), out)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _places(height: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each group (item of the upper tree) the runs from its subroot up and the root, _SALTS times."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = pa.list_(pa.struct([("run", pa.list_(pa.string())), ("at", pa.int32())]))
        names = pa.schema([("g", pa.string()), ("salt", pa.int32()), ("above", steps), ("root", pa.string())])
        for batch in batches:
            for one in batch.to_pylist():
                rows = levels([x["leaf"] for x in one["items"]], None if one["parts"] == 1 else height)
                for at, item in enumerate(one["items"]):
                    own, place = [], at
                    for nodes in rows[:-1]:
                        low = place // FANOUT * FANOUT
                        own.append({"run": nodes[low : low + FANOUT], "at": place - low})
                        place //= FANOUT
                    told = {"g": item["of"], "above": own + one["runs"], "root": one["top"]}
                    yield pa.RecordBatch.from_pylist([{**told, "salt": s} for s in range(_SALTS)], names)

    return run


def lowered(text: str = "text", fields: Sequence[str] = FIELDS, key: str = "doc_id") -> Column:
    """The leaf of a row whose text has lost its upper case (A-Z), where 3 divides the crc32 of its decimal key."""
    values = [lower_ascii(col(f)) if f == text else col(f) for f in fields]
    return F.when(F.crc32(col(key).cast("string").cast("binary")) % 3 == 0, leaf(values))


def oracle(depth: int = 8) -> str:
    """DuckDB SQL for groups (and numbers of groups) of up to FANOUT ** depth."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf_of = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"
    crc = (
        "xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT), "
        "lambda c, b: list_reduce(range(8), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), "
        "4294967295), 4294967295)"
    )
    sql = [
        f"raw AS (SELECT doc_id, lang, {leaf_of('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf_of(low)} END AS changed FROM documents)",
        "d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM raw)",
        "a0 AS (SELECT lang, pos, leaf AS h FROM d)",
    ]

    def climb(name: str, keys: str) -> None:
        for k in range(depth):
            group = f"{keys}, " if keys else ""
            sql.append(
                f"{name}{k + 1} AS (SELECT {group}run AS pos, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h "
                f"FROM (SELECT *, CASE WHEN n > 1 THEN pos // 8 ELSE pos END AS run "
                f"FROM (SELECT *, count(*) OVER ({f'PARTITION BY {keys}' if keys else ''}) AS n FROM {name}{k})) GROUP BY {group}run, n)"
            )

    climb("a", "lang")
    sql.append(f"sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM a{depth})")
    sql.append("b0 AS (SELECT place AS pos, subroot AS h FROM sub)")
    climb("b", "")
    sql.append(f"start AS (SELECT d.*, subroot, place, (SELECT h FROM b{depth}) AS root FROM d JOIN sub ON d.lang IS NOT DISTINCT FROM sub.lang)")
    sql.append("s0 AS (SELECT *, '' AS proof, coalesce(changed, leaf) AS f, pos AS i, place AS j FROM start)")
    for step, (name, own, at) in enumerate([("a", "i", k) for k in range(depth)] + [("b", "j", k) for k in range(depth)]):
        same = "r.lang IS NOT DISTINCT FROM s.lang AND " if name == "a" else ""
        group = "lang, " if name == "a" else ""
        sql.append(
            f"r{step} AS (SELECT {group}run, n, list(h ORDER BY pos) AS hs FROM (SELECT *, pos // 8 AS run, "
            f"count(*) OVER ({'PARTITION BY lang' if group else ''}) AS n FROM {name}{at}) GROUP BY {group}run, n)"
        )
        left, right = f"array_to_string(hs[1:{own} % 8], '')", f"array_to_string(hs[{own} % 8 + 2:], '')"
        sql.append(
            f"s{step + 1} AS (SELECT s.* REPLACE (CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, "
            f"CASE WHEN n > 1 THEN sha256({left} || f || {right}) ELSE f END AS f, "
            f"CASE WHEN n > 1 THEN {own} // 8 ELSE {own} END AS {own}) FROM s{step} s JOIN r{step} r ON {same}r.run = s.{own} // 8)"
        )
    return (
        "WITH " + ",\n".join(sql) + "\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified "
        f"FROM s{2 * depth}"
    )
