"""Newest wins: the visible state of a change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.kv import is_live
from lodestrata.operators.ordered import group_ordinal


def resolve(log: DataFrame, key: str = "key", seq: str = "seq", as_of: int | None = None) -> DataFrame:
    """The newest version of each key, tombstones and expired entries included.

    Planned as a rank limit of one, which Spark also applies before the
    shuffle: a key written again and again leaves each map task once.  Filters
    on the key pass below it, all others stay above.  Null keys or seq are no
    entries; repeated deliveries of one version count once.
    """
    src = log.where(F.col(key).isNotNull() & F.col(seq).isNotNull())
    if as_of is not None:
        src = src.where(F.col(seq) <= as_of)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).desc()))
    return src.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def live_state(log: DataFrame, now: int, key: str = "key", seq: str = "seq", as_of: int | None = None) -> DataFrame:
    """Live entries only. A deleted or expired newest version hides older ones."""
    return resolve(log, key, seq, as_of).where(is_live(now))


def merge_runs(runs: Sequence[DataFrame], key: str = "key", seq: str = "seq") -> DataFrame:
    """Newest version of each key over several runs, whatever their order or overlap."""
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    return resolve(merged, key, seq)


def newest_places(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """(key, seq) of each key's newest version; combined before the shuffle."""
    return log.where(F.col(key).isNotNull() & F.col(seq).isNotNull()).groupBy(key).agg(F.max(seq).alias(seq))


def shadowed(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Versions that a newer one of their key hides.

    An anti join on (key, seq): the versions of a crowded key are spread over all tasks.
    """
    return log.join(newest_places(log, key, seq), [key, seq], "left_anti")


def with_newest(log: DataFrame, key: str = "key", seq: str = "seq", name: str = "is_newest") -> DataFrame:
    """The log with a mark on each key's newest version, spread like ``shadowed``."""
    mark = newest_places(log, key, seq).withColumn(name, F.lit(True))
    return log.join(mark, [key, seq], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def versions(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Every version with its ordinal within the key, newest first."""
    return group_ordinal(log, [key], [F.col(seq).desc()], "ordinal")
