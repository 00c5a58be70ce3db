"""A cheap look at the ids a join will keep, before its other side travels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 1 << 26
_WORD, _BITS = "_sieve_word", "_sieve_bits"


def sieve(rows: DataFrame, ids: DataFrame, key: str, *, sinks: bool = False) -> DataFrame:
    """`rows` without most of those whose `key` is not in `ids`; no row whose key is there is lost.

    A bitmap of BITS bits in words of 64, so the broadcast has at most a million rows whatever the data; with very many
    ids it merely lets more through. The exact join must follow, and be an inner one: Spark would move a semi join below
    the sieve. If it `sinks`, it is a semi join itself, and Spark takes it down to the table that has the key; the exact
    join may then be one too. Keys of two types, or of one whose equal values may differ in their bytes, are not sieved.
    """
    kind = rows.schema[key].dataType
    if kind != ids.schema[key].dataType or kind not in (T.StringType(), T.LongType(), T.IntegerType()):
        return rows
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(BITS))

    def bit(number: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(64)).cast("int"))

    words = ids.groupBy(F.shiftright(at, 6).alias(_WORD)).agg(F.bit_or(bit(at)).alias(_BITS))
    if sinks:
        held = F.col(_BITS).bitwiseAND(bit(at)) != 0
        return rows.join(F.broadcast(words), (F.shiftright(at, 6) == F.col(_WORD)) & held, "left_semi")
    marked = rows.join(F.broadcast(words), F.shiftright(at, 6) == F.col(_WORD))
    return marked.where(F.col(_BITS).bitwiseAND(bit(at)) != 0).select(*[F.col(f"`{c}`") for c in rows.columns])
