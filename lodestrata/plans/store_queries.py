"""Queries that run the stored table: ``events`` written as a change log in commits, then read, merged, cleaned and recovered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.model import LOG, NoRewriteError, Options
from lodestrata.plans.kv_queries import _LIVE, _LOG, _RES, NOW, log_of
from lodestrata.session import cut, scratch, write_bytes
from lodestrata.sources.store import KVTable

QUERIES: dict = {}
SQL: dict[str, str] = {}
OPTIONS = Options(value_threshold=24, value_file_bytes=1 << 18, memtable_size=1 << 22)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _change_log(spark: SparkSession, folder: str) -> DataFrame:
    log = log_of(spark, folder).withColumns({"key": F.col("key").cast("binary"), "value": F.col("value").cast("binary"), "meta": F.lit(0).cast("byte")})
    return log.select(*LOG.names)


def _stored(spark: SparkSession, folder: str, commits: int = 2, between=None) -> KVTable:
    """The log in a fresh table, in commits of equal spans of the sequence; ``between`` runs after the first."""
    log = _change_log(spark, folder)
    last = log.agg(F.max("seq")).first()[0] or 0
    t = KVTable(spark, scratch(spark, "table"), OPTIONS)
    for i in range(commits):
        t.write(log.where((F.col("seq") > last * i // commits if i else F.lit(True)) & (F.col("seq") <= last * (i + 1) // commits)))
        if between and not i:
            between(t)
    return t


def _text(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), "seq", F.col("value").cast("string").alias("value"))


@query(f"with {_LIVE} select key, seq, value from live")
def store_scan(spark, folder):
    """All live entries, large values fetched from their files."""
    return _text(_stored(spark, folder).scan(NOW))


@query(f"with {_LIVE} select key, seq, value from live where key >= 'user:00000020' and key < 'user:00000060'")
def store_scan_range(spark, folder):
    """A key range; runs outside it are not read."""
    return _text(_stored(spark, folder).scan(NOW, start=b"user:00000020", end=b"user:00000060"))


@query(f"""with {_RES}, p as (select i, 'user:' || lpad(cast(i * 10 as varchar), 8, '0') as key from range(40) t(i)),
    s as (select p.i, p.key, r.value, case when p.i < 10 then 'found' when p.i < 15 then 'deleted' when r.key is null then 'not_found'
      when r.is_delete then 'deleted' when r.expires_at <> 0 and r.expires_at <= {NOW} then 'expired' else 'found' end as status
      from p left join res r on r.key = p.key)
    select key, status, case when i < 10 then 'again' || i when status = 'found' then value end as value from s""")
def store_put_delete_get(spark, folder):
    """Ten keys are put anew and five deleted through the table's own calls, then forty are asked for."""
    t = _stored(spark, folder)
    name = lambda i: b"user:%08d" % (i * 10)
    t.batch([(name(i), b"again%d" % i, 0) for i in range(9)])
    t.put(name(9), b"again9")
    t.batch([], [name(i) for i in range(10, 15)])
    keys = spark.range(40).select(F.concat(F.lit("user:"), F.lpad((F.col("id") * 10).cast("string"), 8, "0")).cast("binary").alias("key"))
    return t.multi_get(keys, NOW).select(F.col("key").cast("string").alias("key"), "status", F.col("value").cast("string").alias("value"))


@query(f"with {_LIVE} select key, seq, value, true as single from live")
def store_compact(spark, folder):
    """After a full compaction each live entry is there once, and nothing else."""
    t = _stored(spark, folder, 3)
    t.compact(NOW, force=True)
    rows = cut(_text(t.scan(NOW)))
    return rows.withColumn("single", F.lit(t.log().count() == rows.count()))


@query(f"with {_LIVE} select key, seq, value from live")
def store_gc(spark, folder):
    """After a compaction the value files are mostly garbage: their live values move, and the files go."""
    t = _stored(spark, folder, 3)
    t.compact(NOW, force=True)
    try:
        t.gc(0.3, NOW)
    except NoRewriteError:
        pass  # all values are live
    t.clean(grace_seconds=0)
    return _text(t.scan(NOW))


@query(f"""with {_LOG}, m as (select max(seq) // 2 as half from log),
    r as (select *, row_number() over (partition by key order by seq desc) as rn from log, m where seq <= half)
    select key, seq, value from r where rn = 1 and not is_delete and (expires_at = 0 or expires_at > {NOW})""")
def store_asof(spark, folder):
    """A held snapshot after half of the log, read when all of it has been written and compacted."""
    held = []
    t = _stored(spark, folder, 2, lambda t: held.append(t.hold()))
    t.compact(NOW, force=True)
    return _text(t.scan(NOW, as_of_seq=held[0]))


@query(f"with {_LIVE} select key, seq, value from live")
def store_recover(spark, folder):
    """A crash leaves a damaged manifest file and a run that nobody committed; the table opens as if they were not there."""

    def crash(t: KVTable) -> None:
        write_bytes(spark, f"{t.path}/manifest/{t.manifest().version + 1:020d}.json", b'12\n[{"op": "delete", "na')
        _change_log(spark, folder).limit(1).write.parquet(f"{t.path}/runs/l0-lost")

    t = _stored(spark, folder, 2, crash)
    again = KVTable(spark, t.path, OPTIONS)
    again.clean(grace_seconds=0)
    return _text(again.scan(NOW))


@query(f"""with {_RES}, n as (select count(*) as n from log)
    select cast(n.n as bigint) as entries, count(*) filter (where not is_delete and (expires_at = 0 or expires_at > {NOW})) as live,
      count(*) filter (where is_delete) as deleted, count(*) filter (where not is_delete and expires_at <> 0 and expires_at <= {NOW}) as expired,
      cast(n.n - count(*) as bigint) as shadowed from res, n group by n.n""")
def store_stats(spark, folder):
    """Entries of all levels by what became of them."""
    names = ("entries", "live", "deleted", "expired", "shadowed")
    return _stored(spark, folder).stats(NOW).agg(*[F.sum(c).alias(c) for c in names])


@query(f"with {_LIVE} select key, seq, value from live where not starts_with(key, 'user:0000001')")
def store_drop_prefix(spark, folder):
    t = _stored(spark, folder)
    t.drop_prefixes([b"user:0000001"])
    return _text(t.scan(NOW))
