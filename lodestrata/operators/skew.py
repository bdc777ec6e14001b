"""Joins against a side of checked size, salted where that side is too large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import cut

#: Rows and bytes of a small side that may be broadcast; both are measured before each use.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Rows of one key, on either side of a join of many to many, that may meet in one task; more are split into blocks.
PART_ROWS = 4_000


def row_bytes(df: DataFrame):
    """Expression of about the bytes a row takes in memory."""
    size = F.lit(16 * (len(df.columns) + 1)).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(2 * F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return size


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is small enough to be broadcast, measured in one pass without moving a row."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str | list[str],
    *,
    how: str = "inner",
    max_broadcast_rows: int = BROADCAST_ROWS,
    salts: int = 16,
    salt_on: list[str] | None = None,
) -> DataFrame:
    """``left`` joined with ``right``, which has one row per ``key``.

    ``right`` is measured first (hand in a checkpointed or cheap frame).  Up to
    ``max_broadcast_rows`` and BROADCAST_BYTES it is broadcast and ``left`` is not shuffled.
    Beyond that both sides are shuffled on (key, salt): ``right`` is repeated
    ``salts`` times and the rows of a crowded key are spread over as many tasks.
    """
    if fits(right, max_broadcast_rows):
        return left.join(F.broadcast(right), key, how)
    keys = [key] if isinstance(key, str) else list(key)
    over = salt_on or [c for c in left.columns if c not in keys]
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in over]), F.lit(salts)))
    repeated = right.withColumn("__salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)])))
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")


def split_join(left: DataFrame, right: DataFrame, key: str, part_rows: int | None = None) -> DataFrame:
    """Inner join of many rows with many on ``key``, crowded keys in blocks of about ``part_rows`` times ``part_rows`` rows.

    Rows of a side are dealt to parts by their hash (so they should be
    distinct), and each pair of parts meets once.  Keys that are crowded on
    neither side are joined as they are.  Null keys match nothing.
    """
    part = part_rows or PART_ROWS
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / part)).cast("long")
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    n = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    crowded = cut(n.where((F.col("l") > part) | (F.col("r") > part)).select(key, parts("l").alias("__l"), parts("r").alias("__r")))

    def dealt(side: DataFrame, mine: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in side.columns]), F.coalesce(mine, F.lit(1)))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))
        return lookup_join(side, crowded, key, how="left").withColumn(f"{mine}part", own).withColumn(f"{other}part", every).drop("__l", "__r")

    return dealt(left, "__l", "__r").join(dealt(right, "__r", "__l"), [key, "__lpart", "__rpart"]).drop("__lpart", "__rpart")


def crowded_values(df: DataFrame, column: str, least_rows: int, most: int = 256) -> list:
    """Values of ``column`` with at least ``least_rows`` rows, found in one pass by a summary of bounded size (at most ``most`` of them)."""
    top = df.agg(F.expr(f"approx_top_k(`{column}`, {most}, {64 * most})").alias("top")).first()["top"]
    return [r["item"] for r in top or [] if r["count"] >= least_rows]
