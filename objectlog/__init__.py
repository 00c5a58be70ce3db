"""Object-centric event logs as Spark DataFrames: ingest, profile, label, score."""

from .grid import Grid
from .model import ObjectLog, TableMeta
from .session import configure

__all__ = ["Grid", "ObjectLog", "TableMeta", "configure"]
