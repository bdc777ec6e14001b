"""Queries of the general training-data problems (1, 3 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.consolidate import consolidate, run_metadata
from lodestrata.operators.dense import first_k
from lodestrata.operators.patches import live_tables
from lodestrata.session import cut
from lodestrata.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Tables live at the end of the manifest's changes, with their level."""
    return live_tables(table(spark, folder, "manifest_modify"))


def p1_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The same state in two steps: the earlier half of the versions makes a base, the later half is applied to it as patches."""
    changes = table(spark, folder, "manifest_modify")
    half = F.lit((changes.agg(F.max("version")).first()[0] or 0) // 2)
    base = cut(live_tables(changes.where(F.col("version") <= half)))
    return live_tables(changes.where(F.col("version") > half), base=base)


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    live = cut(p1_found(spark, folder).withColumnRenamed("id", "table_id"))
    return consolidate(table(spark, folder, "sst_record"), live)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every live record once, read back from the consolidated files."""
    return _merged(spark, folder).select("level", "table_id", "rec_no")


def p3_files(spark: SparkSession, folder: str) -> DataFrame:
    """The consolidated files of each level: how many, records, bytes and key range."""
    files = run_metadata(_merged(spark, folder)).groupBy("level").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"),
        F.hex(F.min("min_key")).alias("min_key"), F.hex(F.max("max_key")).alias("max_key"),
    )
    return files


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first three different followers of each user."""
    edges = table(spark, folder, "follower_edge")
    return first_k(edges, key="user_id", item="follower", seq="seq", k=3).select("user_id", "follower")


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows received for each user, from the same dense accumulators."""
    edges = table(spark, folder, "follower_edge")
    return first_k(edges, key="user_id", item="follower", seq="seq", k=1).select(
        "user_id", F.col("n_rows").cast("long").alias("n_rows")
    )


_LIVE = """
    select id, level from (
      select id, level, upper(trim(op)) in ('CREATE', '0') as made,
             row_number() over (partition by id order by version desc, ordinal desc) as rn
      from manifest_modify
      where id is not null and version is not null and ordinal is not null
        and upper(trim(op)) in ('CREATE', '0', 'DELETE', '1'))
    where rn = 1 and made"""

QUERIES = {"p1_found": p1_found, "p1_incremental": p1_incremental, "p3_found": p3_found, "p3_files": p3_files, "p6_found": p6_found, "p6_counts": p6_counts}

SQL = {
    "p1_found": _LIVE,
    "p1_incremental": _LIVE,
    "p3_found": f"""
        with live as ({_LIVE})
        select distinct l.level, r.table_id, r.rec_no
        from sst_record r join live l on l.id = r.table_id
        where r.rec_no is not null""",
    "p3_files": f"""
        with live as ({_LIVE}),
        once as (select l.level, r.table_id, r.rec_no, arg_min(r.key, r.file_name) as key,
                 29 + coalesce(octet_length(arg_min(r.key, r.file_name)), 0)
                    + coalesce(arg_min(coalesce(octet_length(r.value), 0), r.file_name), 0) as n_bytes
          from sst_record r join live l on l.id = r.table_id where r.rec_no is not null group by 1, 2, 3)
        select level, cast(ceil(sum(n_bytes) / 134217728.0) as bigint) as n_files, count(*) as n_records, cast(sum(n_bytes) as bigint) as n_bytes,
               hex(min(key)) as min_key, hex(max(key)) as max_key
        from once group by 1""",
    "p6_found": """
        with e as (
          select trim(user_id) as user_id, trim(follower) as follower, min(seq) as seq
          from follower_edge
          where trim(user_id) <> '' and trim(follower) <> '' and seq is not null
          group by 1, 2),
        r as (select *, row_number() over (partition by user_id order by seq, follower) as rn from e)
        select user_id, follower from r where rn <= 3""",
    "p6_counts": """
        select trim(user_id) as user_id, count(*) as n_rows
        from follower_edge
        where trim(user_id) <> '' and trim(follower) <> '' and seq is not null
        group by 1""",
}
