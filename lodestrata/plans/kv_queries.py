"""Queries of the engine's own operators, each with its SQL.

The change log of most of them maps ``events``: key 'user:<id>', seq the event
id, deletes the 'error' events, values the props, and an expiry for 'view'
events.  Every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import kv
from lodestrata.operators import graph, levels, ordered, patches, read, sketch, values, wal
from lodestrata.operators.resolve import live_state, merge_runs, resolve, shadowed, versions, with_newest
from lodestrata.session import cut, scratch
from lodestrata.sources.tables import table

NOW, TTL = 1_706_600_000, 3600
THRESHOLD = 1024
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def seconds(ts: str) -> F.Column:
    """Epoch seconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"unix_date(cast({ts} as date)) * 86400L + hour({ts}) * 3600 + minute({ts}) * 60 + second({ts})")


def log_of(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as a change log with text keys."""
    return table(spark, folder, "events").select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"), F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").alias("is_delete"), F.col("props").alias("value"),
        F.when(F.col("event_type") == "view", kv.with_ttl(seconds("ts"), TTL)).otherwise(F.lit(0)).cast("long").alias("expires_at"),
    )


_LOG = f"""log as (
  select 'user:' || lpad(cast(user_id as varchar), 8, '0') as key, event_id as seq, event_type = 'error' as is_delete, props as value,
         case when event_type = 'view' then cast(floor(epoch(ts)) as bigint) + {TTL} else 0 end as expires_at from events)"""
_RES = f"{_LOG}, res as (select key, seq, is_delete, value, expires_at from (select *, row_number() over (partition by key order by seq desc) as rn from log) where rn = 1)"
_LIVE = f"{_RES}, live as (select key, seq, value, expires_at from res where not is_delete and (expires_at = 0 or expires_at > {NOW}))"
_PROBES = [f"user:{i * 10:08d}" for i in range(20)]
_PROBE_SQL = "probes as (select 'user:' || lpad(cast(i * 10 as varchar), 8, '0') as key from range(20) t(i))"


def _live(spark, folder) -> DataFrame:
    return live_state(log_of(spark, folder), NOW).select("key", "seq", "value", "expires_at")


def _probes(spark) -> DataFrame:
    return spark.range(20).select(F.concat(F.lit("user:"), F.lpad((F.col("id") * 10).cast("string"), 8, "0")).alias("key"))


# point reads and state


@query(f"with {_LIVE} select * from live")
def kv_live_state(spark, folder):
    return _live(spark, folder)


@query(f"with {_LIVE} select * from live where key = (select min(key) from live)")
def kv_point_get(spark, folder):
    log = log_of(spark, folder)
    first = _live(spark, folder).agg(F.min("key")).first()[0]  # some key that is there
    return read.get(log, first or "", NOW).select("key", "seq", "value", "expires_at")


@query(f"with {_LIVE} select 'user:99999999' as key, case when exists (select 1 from live where key = 'user:99999999') then 'found' else 'not_found' end as status")
def kv_point_get_miss(spark, folder):
    keys = spark.createDataFrame([("user:99999999",)], "key string")
    return read.multi_get(log_of(spark, folder), keys, NOW).select("key", "status")


@query(f"with {_LIVE}, {_PROBE_SQL} select p.key, seq, value, case when seq is null then 'not_found' else 'found' end as status from probes p left join live l on l.key = p.key")
def kv_multi_get(spark, folder):
    return read.multi_get(log_of(spark, folder), _probes(spark), NOW).select("key", "seq", "value", "status")


@query(f"with {_LIVE}, {_PROBE_SQL} select p.key, l.key is not null as present from probes p left join live l on l.key = p.key")
def kv_contains(spark, folder):
    return read.contains(log_of(spark, folder), _probes(spark), NOW)


@query(f"with {_RES} select case when is_delete then 'deleted' when expires_at <> 0 and expires_at <= {NOW} then 'expired' else 'live' end as status, count(*) as n from res group by 1")
def kv_status_counts(spark, folder):
    return resolve(log_of(spark, folder)).groupBy(kv.status(NOW).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_RES} select key, seq from res where is_delete")
def kv_tombstones(spark, folder):
    return resolve(log_of(spark, folder)).where("is_delete").select("key", "seq")


@query(f"with {_LIVE} select key, seq from live where key in (select key from log where is_delete)")
def kv_delete_then_put(spark, folder):
    log = log_of(spark, folder)
    deleted = log.where("is_delete").select("key").distinct()
    return _live(spark, folder).join(deleted, "key", "left_semi").select("key", "seq")


@query(f"select * from (values ('never', true), ('now', false), ('next', true), ('past', false)) t(key, live)")
def kv_ttl_boundary(spark, folder):
    rows = [("never", 0), ("now", NOW), ("next", NOW + 1), ("past", NOW - 1)]
    log = spark.createDataFrame(rows, "key string, expires_at bigint").withColumn("is_delete", F.lit(False))
    return log.select("key", kv.is_live(NOW).alias("live"))


@query(f"""with {_LOG}, m as (select max(seq) // 2 as half from log),
    r as (select *, row_number() over (partition by key order by seq desc) as rn from log, m where seq <= half)
    select key, seq, value from r where rn = 1 and not is_delete and (expires_at = 0 or expires_at > {NOW})""")
def kv_as_of(spark, folder):
    log = log_of(spark, folder)
    at = log.agg(F.max("seq")).first()[0] or 0
    return live_state(log, NOW, as_of=at // 2).select("key", "seq", "value")


@query(f"with {_LOG} select key, seq, is_delete, row_number() over (partition by key order by seq desc) as ordinal from log")
def kv_version_history(spark, folder):
    return versions(log_of(spark, folder)).select("key", "seq", "is_delete", "ordinal")


@query(f"with {_LOG} select key, count(*) as versions, count(*) - 1 as overwrites from log group by 1")
def kv_version_counts(spark, folder):
    return log_of(spark, folder).groupBy("key").agg(F.count(F.lit(1)).alias("versions"), (F.count(F.lit(1)) - 1).alias("overwrites"))


@query("""with r as (select *, row_number() over (partition by key order by seq desc) as rn from entry_log where octet_length(key) > 0)
    select hex(key) as key, seq from r where rn = 1 and not coalesce(is_delete, false)
    and (coalesce(expires_at, 0) = 0 or expires_at > 1740000000)""")
def kv_entry_log_state(spark, folder):
    log = table(spark, folder, "entry_log").where("octet_length(key) > 0")
    return live_state(log, 1_740_000_000).select(F.hex("key").alias("key"), "seq")


# ordered scans


@query(f"with {_LIVE} select key, seq, row_number() over (order by key) as ordinal from live")
def kv_scan_full(spark, folder):
    return ordered.with_ordinal(_live(spark, folder).select("key", "seq"), ["key"])


@query(f"with {_LIVE}, t as (select key, seq from live order by key desc limit 25) select key, seq, row_number() over (order by key desc) as ordinal from t")
def kv_scan_desc_limit(spark, folder):
    top = read.scan(log_of(spark, folder), NOW, ascending=False, limit=25).select("key", "seq")
    return top.withColumn("ordinal", F.row_number().over(Window.orderBy(F.col("key").desc())).cast("long"))  # 25 rows


@query(f"with {_LIVE} select key, seq, value from live where starts_with(key, 'user:0000001')")
def kv_scan_prefix(spark, folder):
    return read.scan(log_of(spark, folder), NOW, prefix="user:0000001", ordered=False).select("key", "seq", "value")


@query(f"with {_LIVE} select key, seq, value from live where key >= 'user:00000020' and key < 'user:00000060'")
def kv_scan_range(spark, folder):
    return read.scan(log_of(spark, folder), NOW, start="user:00000020", end="user:00000060", ordered=False).select("key", "seq", "value")


@query("""with s as (select url, row_number() over (partition by url order by doc_id desc) as rn, doc_id from documents where url is not null)
    select url, doc_id from s where rn = 1 and starts_with(url, 'https://www.')""")
def kv_scan_prefix_url(spark, folder):
    log = table(spark, folder, "documents").select(F.col("url").alias("key"), F.col("doc_id").alias("seq"))
    log = log.where(kv.has_prefix(F.col("key"), "https://www."))
    return resolve(log).select(F.col("key").alias("url"), F.col("seq").alias("doc_id"))


def _seek_sql(found: str, how: str) -> str:
    return f"""with {_LIVE}, d as (select distinct 'user:' || lpad(cast(o_custkey as varchar), 8, '0') as probe from orders)
    select probe, {found}(l.key) as found from d left join live l on l.key {how} d.probe group by 1"""


def _seek(spark, folder, how):
    probes = table(spark, folder, "orders").select(F.concat(F.lit("user:"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("probe")).distinct()
    return ordered.seek(_live(spark, folder), probes, how)


@query(_seek_sql("min", ">="))
def kv_seek_ceiling(spark, folder):
    return _seek(spark, folder, "ceiling")


@query(_seek_sql("max", "<"))
def kv_seek_lower(spark, folder):
    return _seek(spark, folder, "lower")


@query(_seek_sql("min", ">"))
def kv_seek_higher(spark, folder):
    return _seek(spark, folder, "higher")


@query(_seek_sql("max", "<="))
def kv_seek_floor(spark, folder):
    return _seek(spark, folder, "floor")


@query(f'with {_LIVE} select key, lag(key) over (order by key) as previous, lead(key) over (order by key) as "next" from live')
def kv_neighbours(spark, folder):
    return ordered.neighbours(_live(spark, folder))


@query("""select l.event_id, l.user_id, r.event_id as click_id from events l
    asof left join (select user_id, event_id from events where event_type = 'click') r
    on l.user_id = r.user_id and l.event_id >= r.event_id where l.event_type = 'purchase'""")
def kv_asof_join(spark, folder):
    e = table(spark, folder, "events")
    left = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("at"), "event_id")
    right = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("click_id"))
    return ordered.asof(left, right, ["user_id"], "at", ["click_id"]).select("event_id", "user_id", "click_id")


@query(f"with {_RES} select key, seq, is_delete from res")
def kv_merge_runs(spark, folder):
    log = log_of(spark, folder)
    return merge_runs([log.where(F.pmod("seq", F.lit(4)) == i) for i in range(4)]).select("key", "seq", "is_delete")


@query(f"with {_LOG} select key, seq from log l where seq < (select max(seq) from log m where m.key = l.key)")
def kv_shadowed(spark, folder):
    return shadowed(log_of(spark, folder)).select("key", "seq")


# separated values


def _records(spark, folder) -> DataFrame:
    d = table(spark, folder, "documents").where("text is not null")
    return d.select(
        "doc_id", F.octet_length(F.col("doc_id").cast("string")).cast("long").alias("klen"), F.octet_length("text").cast("long").alias("vlen"), "text",
    )


_REC = """rec as (select doc_id, octet_length(encode(cast(doc_id as varchar))) as klen, octet_length(encode(text)) as vlen, text from documents where text is not null),
    sized as (select *, 1 + 1 + greatest(1, (length(bin(vlen)) + 6) // 7) + 1 + klen + vlen + 4 as len, doc_id // 100 as fid from rec),
    ptr as (select *, coalesce(sum(len) over (partition by fid order by doc_id rows between unbounded preceding and 1 preceding), 0) as off from sized)"""


def _pointers(spark, folder) -> DataFrame:
    return values.with_pointers(_records(spark, folder), F.floor(F.col("doc_id") / 100), "doc_id", F.col("klen"), F.col("vlen"), F.lit(0))


@query(f"with {_REC} select case when vlen < {THRESHOLD} then 'inline' else 'separated' end as tier, count(*) as n, cast(sum(vlen) as bigint) as bytes from rec group by 1")
def vs_split_tiers(spark, folder):
    return _records(spark, folder).groupBy(values.tier(F.col("vlen"), THRESHOLD).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum("vlen").alias("bytes"))


@query(f"with {_REC} select doc_id, fid, cast(off as bigint) as \"offset\", cast(len as bigint) as len from ptr")
def vs_pointers(spark, folder):
    return _pointers(spark, folder).select("doc_id", "fid", "offset", "len")


@query(f"with {_REC} select doc_id, vlen as value_len, md5(text) as digest from ptr")
def vs_deref(spark, folder):
    placed = _pointers(spark, folder)
    large = F.col("vlen") >= THRESHOLD
    index = placed.select("doc_id", "fid", "offset", F.when(~large, F.col("text")).alias("value"))
    files = placed.where(large).select("fid", "offset", F.col("text").alias("value"))
    return values.dereference(index, files).select("doc_id", F.octet_length("value").cast("long").alias("value_len"), F.md5("value").alias("digest"))


@query(f"with {_REC} select doc_id, cast(len as bigint) as record_len, cast(len - 1 as bigint) as wal_len from sized")
def vs_record_size(spark, folder):
    r = _records(spark, folder)
    return r.select(
        "doc_id", kv.record_size(F.col("klen"), F.col("vlen"), F.lit(0)).alias("record_len"), kv.wal_size(F.col("klen"), F.col("vlen"), F.lit(0)).alias("wal_len"),
    )


@query(f"with {_REC} select doc_id, cast(case when vlen < {THRESHOLD} then klen + vlen + 1 else klen + 13 end as bigint) as estimate from rec")
def vs_estimate_size(spark, folder):
    return _records(spark, folder).select("doc_id", kv.estimate_size(F.col("klen"), F.col("vlen"), THRESHOLD).cast("long").alias("estimate"))


def _gc_records(spark, folder) -> DataFrame:
    """Log records in value files of 1000 events each, with their state."""
    log = log_of(spark, folder).withColumn("fid", F.floor(F.col("seq") / 1000).cast("long"))
    log = log.withColumn("len", kv.record_size(F.octet_length("key"), F.octet_length("value"), F.col("expires_at")).cast("long"))
    return with_newest(log).withColumn("dead", ~F.col("is_newest") | ~kv.is_live(NOW))


_GC = f"""{_LOG}, g as (select *, seq // 1000 as fid,
    1 + 1 + 1 + case when expires_at = 0 then 1 else 5 end + octet_length(encode(key)) + octet_length(encode(value)) + 4 as len,
    seq < max(seq) over (partition by key) or is_delete or (expires_at <> 0 and expires_at <= {NOW}) as dead from log),
    s as (select fid, cast(sum(case when dead then len else 0 end) as bigint) as discard, cast(sum(len) as bigint) as total from g group by 1)"""


@query(f"with {_GC} select * from s")
def vs_discard_stats(spark, folder):
    return values.discard_stats(_gc_records(spark, folder), F.col("dead"))


@query(f"with {_GC} select * from s where discard >= 0.6 * total")
def vs_gc_candidates(spark, folder):
    return values.gc_candidates(values.discard_stats(_gc_records(spark, folder), F.col("dead")), 0.6)


@query(f"with {_GC} select key, seq, fid from g where not dead and fid in (select fid from s where discard >= 0.6 * total)")
def vs_gc_rewrite(spark, folder):
    records = cut(_gc_records(spark, folder))
    victims = values.gc_candidates(values.discard_stats(records, F.col("dead")), 0.6)
    return values.gc_rewrite(records, victims, F.col("dead")).select("key", "seq", "fid")


@query()
def vs_integrity(spark, folder):
    """CRC-32C of every text; SQL has no such function."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", kv.crc32c(F.col("text").cast("binary")).alias("checksum"))


@query("select doc_id, md5(text) as digest from documents where text is not null")
def vs_digest(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.md5("text").alias("digest"))


# runs and levels


def _runs(spark, folder) -> DataFrame:
    """Runs of 1000 log entries with their statistics."""
    return log_of(spark, folder).groupBy(F.floor(F.col("seq") / 1000).cast("long").alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("seq").alias("max_seq"),
    )


_RUNS = f"{_LOG}, runs as (select seq // 1000 as run, count(*) as n, min(key) as min_key, max(key) as max_key, max(seq) as max_seq from log group by 1)"


@query(f"with {_RUNS} select * from runs")
def lsm_run_stats(spark, folder):
    return _runs(spark, folder)


@query(f"with {_RUNS} select a.run as a, b.run as b from runs a join runs b on a.run < b.run and a.min_key <= b.max_key and b.min_key <= a.max_key")
def lsm_run_overlap(spark, folder):
    runs = cut(_runs(spark, folder)).select(F.col("run").alias("id"), F.col("min_key").alias("lo"), F.col("max_key").alias("hi"))
    return levels.overlapping_pairs(runs).select("a", "b")


@query(f"with {_RUNS} select run from runs where min_key <= 'user:00000001' and max_key >= 'user:00000001'")
def lsm_run_prune(spark, folder):
    return _runs(spark, folder).where((F.col("min_key") <= "user:00000001") & (F.col("max_key") >= "user:00000001")).select("run")


_MAN = """man as (select id, level from (select id, level, upper(trim(op)) in ('CREATE', '0') as made,
    row_number() over (partition by id order by version desc, ordinal desc) as rn from manifest_modify
    where upper(trim(op)) in ('CREATE', '0', 'DELETE', '1')) where rn = 1 and made),
    lv as (select l.level, coalesce(s.size, 0) as size, coalesce(s.tables, 0) as tables from range(7) l(level)
      left join (select m.level, cast(sum(f.size) as bigint) as size, count(*) as tables from man m
        join (select table_id, max(size_bytes) as size from sst_file group by 1) f on f.table_id = m.id group by 1) s on s.level = l.level)"""


def _levels(spark, folder) -> DataFrame:
    live = cut(patches.live_tables(table(spark, folder, "manifest_modify"))).withColumnRenamed("id", "table_id")
    files = table(spark, folder, "sst_file").groupBy("table_id").agg(F.max("size_bytes").alias("size"))
    found = live.join(files, "table_id").groupBy("level").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("tables"))
    return found


@query(f"""with {_MAN}, big as (select max(size) filter (where level = 6) as last, 10485760 as base from lv),
    t as (select lv.*, greatest(base, last // cast(pow(10, 6 - level) as bigint)) as target from lv, big)
    select level, size, tables, case when level = 0 then tables / 15.0::double else size / target::double end as score,
      case when level = 0 then 0 else target end as target from t""")
def lsm_level_scores(spark, folder):
    got = {r["level"]: r for r in _levels(spark, folder).collect()}  # one row per level
    sizes = [got[i]["size"] if i in got else 0 for i in range(7)]
    tables_ = [got[i]["tables"] if i in got else 0 for i in range(7)]
    t = levels.targets(sizes)
    rows = [(i, sizes[i], tables_[i], tables_[0] / 15 if i == 0 else sizes[i] / t.level_bytes[i], t.level_bytes[i]) for i in range(7)]
    return spark.createDataFrame(rows, "level int, size bigint, tables bigint, score double, target bigint").withColumn("level", F.col("level").cast("long"))


@query(f"""with {_RUNS}, o as (select max_key, row_number() over (order by min_key, run) as i, count(*) over () as n from runs),
    c as (select distinct max_key as boundary from o where i % greatest(3, cast(ceil(n / 5.0) as bigint)) = 0 and i < n)
    select boundary from c""")
def lsm_splits(spark, folder):
    runs = sorted((r["min_key"], r["run"], r["max_key"]) for r in _runs(spark, folder).collect())  # run metadata
    made = levels.splits([levels.Run(str(n), 1, lo.encode(), hi.encode(), 0) for lo, n, hi in runs])
    cuts = sorted({hi.decode() for _, hi in made if hi is not None})
    return spark.createDataFrame([(c,) for c in cuts], "boundary string")


@query(f"with {_RES} select key, seq, is_delete from res")
def lsm_compact(spark, folder):
    log = log_of(spark, folder)
    middle = F.lit(log.agg(F.max("seq")).first()[0] or 0) / 2
    upper, lower = log.where(F.col("seq") > middle), resolve(log.where(F.col("seq") <= middle))
    return merge_runs([upper, lower]).select("key", "seq", "is_delete")


@query(f"with {_LIVE} select key, seq from live")
def lsm_compact_drop(spark, folder):
    return resolve(log_of(spark, folder)).where(kv.is_live(NOW)).select("key", "seq")


@query(f"with {_MAN} select id, level from man")
def manifest_live(spark, folder):
    return patches.live_tables(table(spark, folder, "manifest_modify"))


@query(f"with {_MAN} select level, count(*) as tables from man group by 1")
def manifest_levels(spark, folder):
    return patches.live_tables(table(spark, folder, "manifest_modify")).groupBy("level").agg(F.count(F.lit(1)).alias("tables"))


@query(f"""with {_MAN} select distinct table_id, 'not live' as problem from sst_file where table_id is not null and table_id not in (select id from man)
    union all select id, 'no file' from man where id not in (select table_id from sst_file where table_id is not null)""")
def manifest_orphans(spark, folder):
    live = patches.live_tables(table(spark, folder, "manifest_modify")).select(F.col("id").alias("table_id"), F.lit(True).alias("live"))
    there = table(spark, folder, "sst_file").where("table_id is not null").select("table_id").distinct().withColumn("there", F.lit(True))
    both = live.join(there, "table_id", "full_outer").where("live is null or there is null")  # one shuffle for both anti joins
    return both.select("table_id", F.when(F.col("live").isNull(), "not live").otherwise("no file").alias("problem"))


@query("""with d as (select distinct version, ordinal, id, upper(trim(op)) in ('CREATE', '0') as made from manifest_modify
      where upper(trim(op)) in ('CREATE', '0', 'DELETE', '1')),
    c as (select count(*) filter (where made) as creations, count(*) filter (where not made) as deletions from d)
    select creations, deletions, deletions > 10000 and deletions > 10 * (creations - deletions) as due from c""")
def manifest_checkpoint_due(spark, folder):
    m = table(spark, folder, "manifest_modify")
    kind = patches.operation(F.col("op"), patches.MANIFEST_OPERATIONS)
    once = m.select("version", "ordinal", "id", kind.alias("kind")).where("kind is not null").distinct()
    c = once.agg(F.count_if(F.col("kind") == "insert").alias("creations"), F.count_if(F.col("kind") == "delete").alias("deletions"))
    due = (F.col("deletions") > 10_000) & (F.col("deletions") > 10 * (F.col("creations") - F.col("deletions")))
    return c.withColumn("due", due)


@query("""with r as (select event_id, event_id // 1000 as segment, event_id % 997 = 996 as bad from events),
    b as (select segment, min(event_id) filter (where bad) as first_bad from r group by 1)
    select r.segment, count(*) as valid from r join b on b.segment = r.segment where first_bad is null or event_id < first_bad group by 1""")
def wal_replay_valid(spark, folder):
    """Records are written with a checksum; of some the bytes are changed behind its back, and the replay must notice."""
    written = wal.append(log_of(spark, folder), F.floor(F.col("seq") / 1000))
    damaged = written.withColumn("value", F.when(F.col("seq") % 997 == 996, F.concat("value", F.lit("?"))).otherwise(F.col("value")))
    return wal.replay(damaged).groupBy("segment").agg(F.count(F.lit(1)).alias("valid"))


@query(f"""with {_LOG} select seq // 500 as batch, count(*) as n, cast(sum(octet_length(encode(key)) + octet_length(encode(value))) as bigint) as size,
    count(*) >= 500 or sum(octet_length(encode(key)) + octet_length(encode(value))) >= 1048576 as too_big from log group by 1""")
def batch_limits(spark, folder):
    g = log_of(spark, folder).groupBy(F.floor(F.col("seq") / 500).cast("long").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("key") + F.octet_length("value")).cast("long").alias("size"),
    )
    return g.withColumn("too_big", (F.col("n") >= 500) | (F.col("size") >= 1 << 20))


# sketches and caches


@query("""with v as (select * from (values (100, 0.01::double), (1000, 0.001::double), (5000, 0.05::double), (100000, 0.1::double)) t(n, fpp)),
    b as (select n, fpp, cast(ceil(-n * ln(fpp) / pow(ln(2), 2) / n) as integer) as bits from v)
    select n, fpp, bits, greatest(1, least(30, cast(floor(bits * 0.69::double) as integer))) as hashes from b""")
def bloom_sizing(spark, folder):
    rows = [(n, f, sketch.bloom_bits_per_key(n, f), sketch.bloom_hashes(sketch.bloom_bits_per_key(n, f))) for n, f in ((100, 0.01), (1000, 0.001), (5000, 0.05), (100_000, 0.1))]
    return spark.createDataFrame(rows, "n int, fpp double, bits int, hashes int")


@query("""select count(*) filter (where c_custkey % 2 = 0) as members, cast(0 as bigint) as missed, count(*) filter (where c_custkey % 2 = 1) as others,
    true as rate_as_designed from customer""")
def bloom_no_false_negative(spark, folder):
    """Half of the keys are members: none is missed, and of the others about one percent is taken for one."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"))
    got = sketch.bloom_probe(c.where("key % 2 = 0"), c, "key", 0.01)
    member = F.col("key") % 2 == 0
    n = got.agg(
        F.count_if(member).alias("members"), F.count_if(member & ~F.col("maybe")).alias("missed"), F.count_if(~member).alias("others"),
        F.count_if(~member & F.col("maybe")).alias("wrong"),
    )
    return n.select("members", "missed", "others", (F.col("wrong") <= 0.03 * F.col("others") + 3).alias("rate_as_designed"))


def _sketched(spark, folder, halvings: int) -> DataFrame:
    """Estimates of a count-min sketch against the counts: keys, their sum of counts, estimates that are too low, whether most are exact."""
    e, keys = table(spark, folder, "events"), ["user_id", "event_type"]
    width = 1 << max(4, (4 * e.select(*keys).distinct().count()).bit_length())
    sketched = sketch.count_min(e, keys, width)
    for _ in range(halvings):
        sketched = sketch.halved(sketched)
    both = sketch.estimates(sketched, e, keys, width).join(sketch.saturated_counts(e, keys, halvings).withColumnRenamed("estimate", "n"), keys)
    return both.agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("total"), F.count_if(F.col("estimate") < F.col("n")).alias("too_low"),
        (F.count_if(F.col("estimate") == F.col("n")) >= 0.95 * F.count(F.lit(1))).alias("mostly_exact"),
    )


def _sketched_sql(n: str) -> str:
    return f"""select count(*) as n_keys, cast(sum(n) as bigint) as total, cast(0 as bigint) as too_low, true as mostly_exact
    from (select {n} as n from events group by user_id, event_type)"""


@query(_sketched_sql("least(count(*), 15)"))
def cm_sketch_saturated(spark, folder):
    return _sketched(spark, folder, 0)


@query(_sketched_sql("least(count(*), 15) // 2"))
def cm_sketch_halved(spark, folder):
    return _sketched(spark, folder, 1)


def _trace(spark, folder, policy: str) -> DataFrame:
    """16 caches of 32 keys; a shard sees every access of its keys."""
    e = table(spark, folder, "events").withColumn("shard", F.pmod(F.xxhash64("user_id"), F.lit(16)))
    return sketch.cache_trace(e, "shard", "event_id", "user_id", policy, 32)


@query()
def lru_window_trace(spark, folder):
    return _trace(spark, folder, "lru")


@query()
def slru_trace(spark, folder):
    return _trace(spark, folder, "slru")


@query()
def tinylfu_trace(spark, folder):
    return _trace(spark, folder, "tinylfu")


@query("""select c_custkey as n, lpad(lower(hex(c_custkey)), 16, '0') as big_endian, c_custkey as back, lpad(cast(c_custkey as varchar), 5, '0') || '.sst' as file_name,
    c_custkey as file_id from customer""")
def codec_round_trip(spark, folder):
    """Big-endian bytes and file names of numbers, and back."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("n"))
    coded = kv.big_endian(F.col("n"), 8)
    name = kv.file_name(F.col("n"))
    return c.select("n", F.lower(F.hex(coded)).alias("big_endian"), kv.from_big_endian(coded).alias("back"), name.alias("file_name"), kv.file_id(name).alias("file_id"))


@query("""with k as (select distinct 'user:' || lpad(cast(user_id as varchar), 8, '0') as key from events), p as (select key, lag(key) over (order by key) as previous from k)
    select key, previous, cast((select max(i) from range(0, 14) t(i) where starts_with(key, substr(previous, 1, i))) as integer) as shared from p where previous is not null""")
def kv_common_prefix(spark, folder):
    """Bytes each key shares with the one before it, as a block writer leaves them out."""
    keys = log_of(spark, folder).select("key").distinct()
    near = ordered.neighbours(keys).where("previous is not null")
    return near.select("key", "previous", kv.common_prefix(F.col("key").cast("binary"), F.col("previous").cast("binary")).alias("shared"))


# documents and graph

_USER = "ID STRING, Name STRING, Follower ARRAY<STRING>, Following ARRAY<STRING>"


@query("select id, name, len(follower) as n_follower, len(following) as n_following from seed_user")
def json_users(spark, folder):
    u = table(spark, folder, "seed_user")
    body = F.to_json(F.struct(F.col("id").alias("ID"), F.col("name").alias("Name"), F.col("follower").alias("Follower"), F.col("following").alias("Following")))
    log = u.select(F.col("id").alias("key"), F.lit(1).cast("long").alias("seq"), F.lit(False).alias("is_delete"), body.alias("value"), F.lit(NOW + 1000).alias("expires_at"))
    d = live_state(log, NOW).select(F.from_json("value", _USER).alias("d"))
    return d.select(
        F.col("d.ID").alias("id"), F.col("d.Name").alias("name"),
        F.size("d.Follower").cast("long").alias("n_follower"), F.size("d.Following").cast("long").alias("n_following"),
    )


def _current(spark, folder) -> DataFrame:
    u = table(spark, folder, "user_doc").select(F.trim("id").alias("id"), "seq", "following").where("length(id) > 0")
    return resolve(u, "id", "seq")


_EDGES = """edges as (select distinct src, dst from (select trim(id) as src, trim(unnest(following)) as dst from
    (select *, row_number() over (partition by trim(id) order by seq desc) as rn from user_doc where trim(id) <> '' and seq is not null) where rn = 1)
    where dst <> '')"""
_SEED = "edges as (select distinct src, dst from (select trim(id) as src, trim(unnest(following)) as dst from seed_user) where src <> '' and dst <> '')"


def _edges(spark, folder) -> DataFrame:
    return graph.edges(_current(spark, folder), "id", following="following")


def _seed(spark, folder) -> DataFrame:
    return graph.edges(table(spark, folder, "seed_user"), "id", following="following")


@query(f"with {_EDGES} select src as id, count(*) as degree from edges group by 1")
def graph_out_degree(spark, folder):
    return graph.degrees(_edges(spark, folder), "src")


@query(f"with {_EDGES} select dst as id, count(*) as degree from edges group by 1")
def graph_in_degree(spark, folder):
    return graph.degrees(_edges(spark, folder), "dst")


@query(f"with {_EDGES} select x.src as a, x.dst as b from edges x join edges y on x.src = y.dst and x.dst = y.src where x.src < x.dst")
def graph_mutual(spark, folder):
    return graph.mutual(_edges(spark, folder))


@query(f"with {_SEED} select distinct x.src, y.dst from edges x join edges y on x.dst = y.src where x.src <> y.dst")
def graph_two_hop(spark, folder):
    return graph.two_hop(_seed(spark, folder))


@query(f"""with recursive {_SEED}, hop(id, depth) as (select '1' as id, 0 as depth union select e.dst, h.depth + 1 from hop h join edges e on e.src = h.id where h.depth < 3)
    select id, cast(min(depth) as integer) as depth from hop group by 1""")
def graph_khop(spark, folder):
    return graph.k_hop(_seed(spark, folder), ["1"], 3)


@query(f"with {_SEED} select x.src as a, y.src as b, count(*) as n from edges x join edges y on x.dst = y.dst and x.src < y.src group by 1, 2")
def graph_common_neighbours(spark, folder):
    return graph.common_neighbours(_seed(spark, folder))


@query(f"""with {_SEED}, u as (select distinct least(src, dst) as a, greatest(src, dst) as b from edges where src <> dst)
    select x.a, x.b, y.b as c from u x join u y on x.b = y.a join u z on z.a = x.a and z.b = y.b""")
def graph_triangles(spark, folder):
    return graph.triangles(_seed(spark, folder))


# the same over all current documents; of common neighbours, whose pairs grow as the degrees squared, a stated set of ids against all


@query("""select trim(id) as id, name, len(follower) as n_follower, len(following) as n_following from
    (select *, row_number() over (partition by trim(id) order by seq desc) as rn from user_doc where trim(id) <> '' and seq is not null) where rn = 1""")
def json_users_current(spark, folder):
    u = table(spark, folder, "user_doc").select(F.trim("id").alias("id"), "seq", "name", "follower", "following").where("length(id) > 0 and seq is not null")
    body = F.to_json(F.struct(F.col("id").alias("ID"), F.col("name").alias("Name"), F.col("follower").alias("Follower"), F.col("following").alias("Following")))
    log = u.select(F.col("id").alias("key"), "seq", F.lit(False).alias("is_delete"), body.alias("value"), F.lit(NOW + 1000).alias("expires_at"))
    d = live_state(log, NOW).select(F.from_json("value", _USER).alias("d"))
    return d.select(
        F.col("d.ID").alias("id"), F.col("d.Name").alias("name"),
        F.size("d.Follower").cast("long").alias("n_follower"), F.size("d.Following").cast("long").alias("n_following"),
    )


@query(f"with {_EDGES} select distinct x.src, y.dst from edges x join edges y on x.dst = y.src where x.src <> y.dst")
def graph_two_hop_current(spark, folder):
    return graph.two_hop(cut(_edges(spark, folder)))


@query(f"""with recursive {_EDGES}, hop(id, depth) as (select '10000010' as id, 0 as depth union select e.dst, h.depth + 1 from hop h join edges e on e.src = h.id where h.depth < 3)
    select id, cast(min(depth) as integer) as depth from hop group by 1""")
def graph_khop_current(spark, folder):
    return graph.k_hop(cut(_edges(spark, folder)), ["10000010"], 3)


@query(f"""with {_EDGES} select x.src as a, y.src as b, count(*) as n from edges x join edges y on x.dst = y.dst and x.src <> y.src
    where x.src between '10000010' and '10000019' group by 1, 2""")
def graph_common_neighbours_current(spark, folder):
    e = cut(_edges(spark, folder))
    return graph.common_neighbours(e, of=e.where("src between '10000010' and '10000019'").select(F.col("src").alias("id")).distinct())


@query(f"""with {_EDGES}, u as (select distinct least(src, dst) as a, greatest(src, dst) as b from edges where src <> dst)
    select x.a, x.b, y.b as c from u x join u y on x.b = y.a join u z on z.a = x.a and z.b = y.b""")
def graph_triangles_current(spark, folder):
    return graph.triangles(cut(_edges(spark, folder)))


@query(f"with {_EDGES} select 'e:' || src || ':' || dst as key, dst from edges where src = '10000010'")
def graph_prefix_adjacency(spark, folder):
    return graph.adjacency(graph.edge_log(_edges(spark, folder)), "10000010").select("key", "dst")


@query(f"with {_LIVE} select key, seq from live")
def stream_ingest_equiv(spark, folder):
    """A bounded stream into a Parquet log gives the state of the batch."""
    from lodestrata.streaming.ingest import append_stream

    path = scratch(spark, "stream")
    changes = log_of_stream(spark, folder)
    done = append_stream(changes, f"{path}/log", f"{path}/checkpoint")
    done.awaitTermination()
    return live_state(spark.read.parquet(f"{path}/log"), NOW).select("key", "seq")


def log_of_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``log_of`` over a file stream of ``events``."""
    schema = table(spark, folder, "events").schema
    # a pattern, so that one file serves as well as a directory of files
    events = spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")
    return events.select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"), F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").alias("is_delete"), F.col("props").alias("value"),
        F.when(F.col("event_type") == "view", kv.with_ttl(seconds("ts"), TTL)).otherwise(F.lit(0)).cast("long").alias("expires_at"),
    )
