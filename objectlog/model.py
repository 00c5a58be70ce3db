"""The log bundle: named DataFrames plus the keys that tie them together."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.sieve import sieve

EVENT, OBJECT, E2O, O2O = "event", "object", "e2o", "o2o"
EVENT_ATTR, OBJECT_ATTR = "event_attr_", "object_attr_"
KEY_COLUMNS = ("event_id", "object_id", "object_id_src", "object_id_dst")


@dataclass(frozen=True)
class TableMeta:
    pk: str | None = None
    fks: Mapping[str, str] = field(default_factory=dict)
    time_col: str | None = "time"


def default_meta(name: str) -> TableMeta:
    if name == EVENT:
        return TableMeta(pk="event_id")
    if name == OBJECT:
        return TableMeta(pk="object_id")
    if name == E2O:
        return TableMeta(fks={"event_id": EVENT, "object_id": OBJECT})
    if name == O2O:
        return TableMeta(fks={"object_id_src": OBJECT, "object_id_dst": OBJECT})
    if name.startswith(EVENT_ATTR):
        return TableMeta(fks={"event_id": EVENT})
    if name.startswith(OBJECT_ATTR):
        return TableMeta(fks={"object_id": OBJECT})
    return TableMeta(time_col=None)


def as_list(values: str | Iterable[str]) -> list[str]:
    return [values] if isinstance(values, str) else list(values)


class ObjectLog:
    """An immutable bundle of lazy tables.

    `event(event_id, type, time)`, `object(object_id, type, time)`,
    `e2o(event_id, object_id[, qualifier], time)`, optional
    `o2o(object_id_src, object_id_dst[, qualifier], time)`, and any number of
    `event_attr_<type>` / `object_attr_<type>` tables.
    """

    def __init__(self, tables: Mapping[str, DataFrame], meta: Mapping[str, TableMeta] | None = None):
        self.tables = {name: _zone_free(df) for name, df in tables.items()}
        self.meta = {name: (meta or {}).get(name) or default_meta(name) for name in self.tables}

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    @property
    def event(self) -> DataFrame:
        return self.tables[EVENT]

    @property
    def object(self) -> DataFrame:
        return self.tables[OBJECT]

    @property
    def e2o(self) -> DataFrame:
        return self.tables[E2O]

    def replace(self, **tables: DataFrame) -> "ObjectLog":
        return ObjectLog({**self.tables, **tables}, self.meta)

    def map_tables(self, fn) -> "ObjectLog":
        return ObjectLog({name: fn(name, df) for name, df in self.tables.items()}, self.meta)

    def attribute_tables(self, kind: str) -> dict[str, DataFrame]:
        prefix = {"event": EVENT_ATTR, "object": OBJECT_ATTR}[kind]
        return {name: df for name, df in self.tables.items() if name.startswith(prefix)}

    def links(self, event_types: str | Iterable[str] | None = None, members: DataFrame | None = None) -> DataFrame:
        """One row per link: object_id, event_id, type, time (of the event).

        Duplicate links stay duplicate. The filter on event types runs before the
        shuffle on `event_id`. Most links of objects other than `members`, if given,
        are left out there too; the caller still joins the members.
        """
        event = self.event.select("event_id", "type", "time")
        if event_types is not None:
            event = event.where(F.col("type").isin(as_list(event_types)))
        e2o = self.e2o.select("event_id", "object_id")
        if members is not None:
            e2o = sieve(e2o, members, "object_id")
        return e2o.join(event, "event_id")

    def objects_of(self, object_type: str | Iterable[str]) -> DataFrame:
        return self.object.where(F.col("type").isin(as_list(object_type)))

    def members(self, object_type: str) -> DataFrame:
        """object_id, first_seen of one type. Ids are unique in a valid log."""
        return self.objects_of(object_type).select("object_id", F.col("time").alias("first_seen"))

    def links_of(
        self, object_type: str, event_types: str | Iterable[str] | None = None
    ) -> DataFrame:
        """`links` of objects of one type, with the object's first-seen time.

        A log stored with its `typed_link` table answers this by reading one
        partition, without any join.
        """
        if "typed_link" in self.tables:
            wide = self.tables["typed_link"].where(F.col("object_type") == object_type)
            if event_types is not None:
                wide = wide.where(F.col("type").isin(as_list(event_types)))
            return wide.select("object_id", "event_id", "type", "time", "first_seen")
        members = self.members(object_type)
        return self.links(event_types, members).join(members, "object_id").select(
            "object_id", "event_id", "type", "time", "first_seen"
        )

    def links_and_members(self, object_type: str) -> tuple[DataFrame, DataFrame | None]:
        """Links, and the objects still to be joined to whatever is folded from them.

        Folding first means a hot object's links never travel to one task: they
        are combined where they are. None: the links are of that type already.
        """
        if "typed_link" in self.tables:
            return self.links_of(object_type), None
        members = self.members(object_type)
        return self.links(members=members), members

    def with_typed_links(self) -> "ObjectLog":
        objects = self.object.select(
            "object_id", F.col("type").alias("object_type"), F.col("time").alias("first_seen")
        )
        return self.replace(typed_link=self.links().join(objects, "object_id"))


def _zone_free(df: DataFrame) -> DataFrame:
    zoned = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    if not zoned:
        return df
    return df.select(
        *[F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if c in zoned else F.col(f"`{c}`") for c in df.columns]
    )


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
