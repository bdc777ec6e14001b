"""Reads of a change log: point and multi-get, contains, scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.kv import has_prefix
from lodestrata.operators.resolve import live_state
from lodestrata.operators.skew import lookup_join
from lodestrata.session import cut


def get(log: DataFrame, key: str | bytes, now: int, **kw) -> DataFrame:
    """The live entry of one key; no row if there is none. The key reaches the scan as a pushed filter."""
    return live_state(log.where(F.col("key") == F.lit(key)), now, **kw)


def multi_get(log: DataFrame, keys: DataFrame, now: int, **kw) -> DataFrame:
    """Each distinct key of ``keys`` with its live entry's columns and ``status`` 'found' or 'not_found'."""
    wanted = cut(keys.select("key").where("key is not null").distinct())  # measured, joined and joined again
    part = lookup_join(log, wanted, "key", salt_on=["seq"])
    found = live_state(part, now, **kw)
    return wanted.join(found, "key", "left").withColumn("status", F.when(F.col("seq").isNotNull(), "found").otherwise("not_found"))


def contains(log: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """(key, present) of each distinct key of ``keys``."""
    return multi_get(log, keys, now).select("key", (F.col("status") == "found").alias("present"))


def scan(
    log: DataFrame, now: int, *, prefix: str | bytes | None = None, start: str | bytes | None = None,
    end: str | bytes | None = None, ascending: bool = True, limit: int | None = None, ordered: bool = True,
) -> DataFrame:
    """Live entries with ``start`` <= key < ``end`` and ``prefix``, in key order.

    The key predicates are applied before newest-wins, so runs and row groups
    are pruned; ``limit`` is the feature of a top-k scan.
    """
    if prefix is not None:
        log = log.where(has_prefix(F.col("key"), prefix))
    if start is not None:
        log = log.where(F.col("key") >= F.lit(start))
    if end is not None:
        log = log.where(F.col("key") < F.lit(end))
    out = live_state(log, now)
    if ordered:
        out = out.orderBy(F.col("key") if ascending else F.col("key").desc())
    return out.limit(limit) if limit is not None else out


def delete_prefix(log: DataFrame, prefixes: Sequence[str | bytes]) -> DataFrame:
    """The log without keys of these prefixes."""
    for p in prefixes:
        log = log.where(~has_prefix(F.col("key"), p))
    return log
