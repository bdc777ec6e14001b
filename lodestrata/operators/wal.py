"""Write-ahead records with a checksum each, and what a replay of them accepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.kv import crc32c


def record_bytes(key: Column, seq: Column, is_delete: Column, value: Column, expires_at: Column) -> Column:
    """The bytes a record's checksum covers: lengths before key and value, so that no two records share them."""
    word = lambda x: F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))
    body = F.coalesce(value.cast("binary"), F.lit(b""))
    head = [word(F.octet_length(key.cast("binary"))), key.cast("binary"), word(seq), word(F.when(is_delete, 1).otherwise(0)), word(F.coalesce(expires_at, F.lit(0)))]
    return F.concat(*head, word(F.octet_length(body)), body)


def append(log: DataFrame, segment: Column) -> DataFrame:
    """``log`` with its segment and each record's CRC-32C, as it is written."""
    covered = record_bytes(F.col("key"), F.col("seq"), F.col("is_delete"), F.col("value"), F.col("expires_at"))
    return log.withColumn("segment", segment.cast("long")).withColumn("checksum", crc32c(covered))


def replay(written: DataFrame) -> DataFrame:
    """Records of each segment up to before the first whose bytes do not match its checksum.

    A segment has a bounded number of records, so it is a bounded group; the
    records behind a damaged one are lost even if they are whole, as their
    beginning cannot be told.
    """
    covered = record_bytes(F.col("key"), F.col("seq"), F.col("is_delete"), F.col("value"), F.col("expires_at"))
    checked = written.withColumn("__bad", F.when(~crc32c(covered).eqNullSafe(F.col("checksum")), F.col("seq")))
    first = F.min("__bad").over(Window.partitionBy("segment"))
    return checked.withColumn("__first", first).where("__first is null or seq < __first").drop("__bad", "__first", "checksum")
