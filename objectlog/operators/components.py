"""Connected components of objects that meet in events."""

from __future__ import annotations

import hashlib
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hours_between
from ..functions.ordered import fold
from ..model import ObjectLog
from ..session import cut_lineage, remove, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = fold(around, "u", F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return around.join(least, "u").where(F.col("v") > F.col("u")).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = fold(edges, "u", F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where(
        F.col("u") != F.col("v")
    ).distinct()


def _round(edges: DataFrame) -> tuple[DataFrame, dict, str]:
    """The edges as a table, with a fingerprint of the set that the write measures."""
    code = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return written(edges, "stars", n=F.count(F.lit(1)), code=code)


def stars(edges: DataFrame) -> DataFrame:
    """(u, v) pairs, u > v, to (node, smallest node of its component).

    Alternates the two star steps until the edge set stops changing, which it does,
    as every round with a change moves some node to a smaller one. Each round
    is one job that writes a table in the shared folder, so the plan stays short and
    a lost executor costs one round; the round before it is deleted.
    """
    edges, state, path = _round(edges)
    while True:
        last, before = path, state
        edges, state, path = _round(_small_star(_large_star(edges)))
        remove(edges.sparkSession, last)
        if state == before:
            return edges.select(F.col("u").alias("object_id"), F.col("v").alias("component"))


#: Rounds that share an order of codes: a star takes two rounds of one order, but would only halve in orders of their own.
_SAME_ORDER = 5


def _order(turn: int) -> int:
    """A number that turns the order of codes from time to time (order by exclusive or with it)."""
    return int.from_bytes(hashlib.md5(f"order {turn // _SAME_ORDER}".encode()).digest()[:8], signed=True)


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of random long codes, u <> v, to (code, root): one root for all codes of a component.

    Every round moves each code to the least one around it and the edges with their ends; loops and repeated edges go.
    Codes that are nowhere the least vanish, with hubs almost all, so the first rounds do most of the work. The order
    changes now and then, as no shape of graph is then bad for all rounds. The tables of moves are read back to front.
    """
    edges, state, path = written(edges.distinct(), "edges", n=F.count(F.lit(1)))
    spark, moves = edges.sparkSession, []
    while state["n"]:
        turn = F.lit(_order(len(moves)))
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = fold(ends.select("u", F.col("v").bitwiseXOR(turn).alias("w")), "u", F.min("w").alias("w"))
        to = F.least("w", F.col("u").bitwiseXOR(turn)).bitwiseXOR(turn)
        moves.append(cut_lineage(least.select(F.col("u").alias("code"), to.alias("root"))))
        one, two = (moves[-1].select(F.col("code").alias(x), F.col("root").alias(f"to_{x}")) for x in ("u", "v"))
        moved = edges.join(one, "u").join(two, "v").where("to_u <> to_v").select(
            F.greatest("to_u", "to_v").alias("u"), F.least("to_u", "to_v").alias("v")
        )
        last = path
        edges, state, path = written(moved.distinct(), "edges", n=F.count(F.lit(1)))
        remove(spark, last)
    if not moves:
        return edges.select(F.col("u").alias("code"), F.col("v").alias("root"))
    found = moves.pop()
    for move in reversed(moves):
        further = found.select(F.col("code").alias("root"), F.col("root").alias("end"))
        found = move.join(further, "root", "left").select("code", F.coalesce("end", "root").alias("root"))
    return found


def _coded(links: DataFrame) -> tuple[DataFrame, Column]:
    """object_id, code of all linked objects, and the code's formula: a hash in which no two of them agree."""
    for seed in count():
        code = F.xxhash64(F.lit(seed), "object_id")
        nodes = cut_lineage(links.select("object_id").distinct().withColumn("code", code))
        if nodes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return nodes, code


def _edges(ties: DataFrame) -> DataFrame:
    """(u, v): every code of an event with the event's least one.

    Of up to three codes the fold that finds the least also tells the others: the greatest, and what is left of the
    exclusive or of all. Only larger events are joined back to their links.
    """
    folded = fold(
        ties, "event_id", F.min("u").alias("v"), F.max("u").alias("high"), F.bit_xor("u").alias("all"), F.count("u").alias("n")
    )
    large = F.when(F.col("n") > 3, F.col("event_id")).alias("event_id")
    hubs, seen, _ = written(
        folded.where("v <> high").select(large, "v", "high", "all", "n"), "hubs", large=F.count_if(F.col("n") > 3)
    )
    other = F.col("all").bitwiseXOR(F.col("v")).bitwiseXOR(F.col("high"))
    small = hubs.where("n <= 3").select(F.explode(F.array("high", F.when(F.col("n") == 3, other))).alias("u"), "v")
    if seen["large"]:
        small = small.unionByName(ties.join(hubs.where("n > 3").select("event_id", "v"), "event_id").select("u", "v"))
    return small.where("u <> v")


def object_components(log: ObjectLog) -> DataFrame:
    """object_id, component: the smallest object id of the component.

    An event ties each of its objects to one of them: as many edges as links,
    never all pairs. Isolated objects are their own component. Edges and rounds run on
    numbers; ids come back at the end.
    """
    links = log.e2o.select("event_id", "object_id").where("event_id IS NOT NULL AND object_id IS NOT NULL")
    nodes, code = _coded(links)
    ends = contracted(_edges(links.select("event_id", code.alias("u"))))
    members = cut_lineage(nodes.join(ends, "code").select("object_id", "root"))
    found = members.join(fold(members, "root", F.min("object_id").alias("component")), "root")
    return log.object.select("object_id").distinct().join(found.select("object_id", "component"), "object_id", "left").select(
        "object_id", F.coalesce("component", "object_id").alias("component")
    )


def event_components(log: ObjectLog, objects: DataFrame | None = None) -> DataFrame:
    """event_id, component; an event without objects is a component of its own."""
    objects = object_components(log) if objects is None else objects
    hub = log.e2o.groupBy("event_id").agg(F.min("object_id").alias("object_id"))
    placed = log.event.select("event_id").join(hub, "event_id", "left").join(objects, "object_id", "left")
    return placed.select(
        "event_id",
        F.coalesce("component", F.concat(F.lit("event:"), F.col("event_id").cast("string"))).alias("component"),
    )


def component_stats(log: ObjectLog) -> DataFrame:
    """Size, type mix and time span of every component."""
    members = cut_lineage(object_components(log))
    by_type = members.join(log.object.select("object_id", "type"), "object_id").groupBy(
        "component", "type"
    ).agg(F.count(F.lit(1)).alias("n"))
    objects = by_type.groupBy("component").agg(
        F.sum("n").alias("objects"),
        F.count(F.lit(1)).alias("object_types"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("object_type_mix"),
    )
    events = event_components(log, members).join(log.event.select("event_id", "time"), "event_id").groupBy(
        "component"
    ).agg(
        F.count(F.lit(1)).alias("events"), F.min("time").alias("start"), F.max("time").alias("end")
    )
    both = objects.join(events, "component", "full_outer")
    span = F.coalesce(hours_between(F.col("end"), F.col("start")), F.lit(0.0))
    return both.select(
        "component",
        F.coalesce("objects", F.lit(0)).alias("objects"),
        F.coalesce("events", F.lit(0)).alias("events"),
        F.coalesce("object_types", F.lit(0)).alias("object_types"),
        "start",
        "end",
        span.alias("span_hours"),
        (span / 24).alias("span_days"),
        "object_type_mix",
    )


def largest_share(stats: DataFrame) -> DataFrame:
    """The biggest component's share of all objects and events."""
    total = stats.agg(
        F.sum("objects").alias("all_objects"),
        F.sum("events").alias("all_events"),
        F.max(F.struct("objects", "events", "component")).alias("top"),
    )
    return total.select(
        F.col("top.component").alias("component"),
        F.col("top.objects").alias("objects"),
        F.col("top.events").alias("events"),
        (F.col("top.objects") / F.col("all_objects")).alias("object_share"),
        (F.col("top.events") / F.col("all_events")).alias("event_share"),
    )
