"""Key/value separation: large values live in value files, runs keep pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.kv import is_inline, record_size
from lodestrata.model import InvalidRequestError


def tier(value_len: Column, threshold: int) -> Column:
    """'inline' or 'separated'."""
    return F.when(is_inline(value_len, threshold), "inline").otherwise("separated")


def with_pointers(records: DataFrame, fid: Column, order: str, key_len: Column, value_len: Column, expires_at: Column) -> DataFrame:
    """``records`` with fid, offset and len: the place of each in its value file.

    A file has a bounded number of records, so the running sum per file is a bounded group.
    """
    placed = records.withColumn("fid", fid.cast("long")).withColumn("len", record_size(key_len, value_len, expires_at).cast("long"))
    before = Window.partitionBy("fid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long"))


def dereference(index: DataFrame, values: DataFrame) -> DataFrame:
    """Rows of ``index`` with the value their pointer (fid, offset) names; inline rows keep theirs."""
    far = values.select("fid", "offset", F.col("value").alias("__far"))
    joined = index.join(far, ["fid", "offset"], "left")
    return joined.withColumn("value", F.coalesce("value", "__far")).drop("__far")


def discard_stats(records: DataFrame, dead: Column) -> DataFrame:
    """Per value file: bytes of dead records and of all."""
    return records.groupBy("fid").agg(
        F.sum(F.when(dead, F.col("len")).otherwise(0)).cast("long").alias("discard"), F.sum("len").cast("long").alias("total"),
    )


def gc_candidates(stats: DataFrame, ratio: float) -> DataFrame:
    """Files whose dead bytes reach ``ratio`` (in the open interval 0..1) of their size."""
    if not 0 < ratio < 1:
        raise InvalidRequestError("ratio must lie between 0 and 1")
    return stats.where(F.col("discard") >= F.lit(ratio) * F.col("total"))


def gc_rewrite(records: DataFrame, victims: DataFrame, dead: Column) -> DataFrame:
    """Live records of the victim files: what must be written again before they go."""
    return records.where(~dead).join(victims.select("fid"), "fid", "left_semi")
