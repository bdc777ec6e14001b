"""Key-value semantics against a dictionary, and every query against its SQL."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import kv
from lodestrata.operators import levels, ordered, read, sketch
from lodestrata.operators.resolve import live_state, merge_runs, resolve

LOG = "key string, seq bigint, is_delete boolean, value string, expires_at bigint"


def history(n=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.3 else f"k{rnd.randrange(40):03d}"
        rows.append((key, i, rnd.random() < 0.2, f"v{i}", rnd.choice([0, 0, 50, 100, 150])))
    return rows


def model(rows, now):
    newest = {}
    for r in sorted(rows, key=lambda r: r[1]):
        newest[r[0]] = r
    return {k: r[3] for k, r in newest.items() if not r[2] and (r[4] == 0 or r[4] > now)}


@pytest.mark.parametrize("now", [50, 100, 149])
def test_state_equals_dictionary(spark, now):
    rows = history()
    log = spark.createDataFrame(random.Random(2).sample(rows, len(rows)) + rows[:50], LOG)
    assert {r["key"]: r["value"] for r in live_state(log, now).collect()} == model(rows, now)
    half = {r["key"]: r["value"] for r in live_state(log, now, as_of=300).collect()}
    assert half == model([r for r in rows if r[1] <= 300], now)


def test_runs_in_any_split_and_compaction(spark):
    rows = history(seed=4)
    log = spark.createDataFrame(rows, LOG)
    want = model(rows, 100)
    parts = [log.where(F.pmod(F.hash("seq"), F.lit(3)) == i) for i in range(3)]
    merged = merge_runs([resolve(parts[2]), parts[0], parts[1]])
    assert {r["key"]: r["value"] for r in merged.where(kv.is_live(100)).collect()} == want


def test_reads(spark):
    rows = history(seed=5)
    log, want = spark.createDataFrame(rows, LOG), model(rows, 100)
    keys = spark.createDataFrame([("hot",), ("k001",), ("none",), (None,), ("k001",)], "key string")
    got = {r["key"]: (r["status"], r["value"]) for r in read.multi_get(log, keys, 100).collect()}
    assert got == {k: ("found", want[k]) if k in want else ("not_found", None) for k in ("hot", "k001", "none")}
    scan = [r["key"] for r in read.scan(log, 100, prefix="k0", start="k005", end="k030", ascending=False, limit=7).collect()]
    assert scan == sorted((k for k in want if k.startswith("k0") and "k005" <= k < "k030"), reverse=True)[:7]
    assert read.delete_prefix(log, ["k"]).select("key").distinct().collect()[0][0] == "hot"


def test_ordered(spark):
    rnd = random.Random(6)
    ks = sorted({rnd.randrange(1000) for _ in range(120)})
    keys = spark.createDataFrame([(k,) for k in ks], "key int").repartition(4)
    assert {(r["key"], r["ordinal"]) for r in ordered.with_ordinal(keys, ["key"]).collect()} == {(k, i + 1) for i, k in enumerate(ks)}
    probes = spark.createDataFrame([(p,) for p in [*range(0, 1000, 13), *ks[::9], None]], "probe int").repartition(3)
    tests = {
        "floor": lambda p: max((k for k in ks if k <= p), default=None), "lower": lambda p: max((k for k in ks if k < p), default=None),
        "ceiling": lambda p: min((k for k in ks if k >= p), default=None), "higher": lambda p: min((k for k in ks if k > p), default=None),
    }
    for how, want in tests.items():
        got = ordered.seek(keys.union(keys.limit(3)), probes, how).collect()
        assert len(got) == probes.count()
        assert all(r["found"] == (None if r["probe"] is None else want(r["probe"])) for r in got), how
    assert all(r["found"] is None for r in ordered.seek(keys.limit(0), probes, "floor").collect())
    near = {r["key"]: (r["previous"], r["next"]) for r in ordered.neighbours(keys).collect()}
    assert near == dict(zip(ks, zip([None, *ks[:-1]], [*ks[1:], None]), strict=True))


def test_group_ordinal(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["hot"] * 5 + ["a", "b", "z", None]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, s int").repartition(5)
    got = {(r["g"], r["s"]): r["n"] for r in ordered.group_ordinal(df, ["g"], [F.col("s").desc()], "n").collect()}
    place = {}
    for g in {g for g, _ in rows}:
        for i, s in enumerate(sorted((s for h, s in rows if h == g), reverse=True)):
            place[g, s] = i + 1
    assert got == place
    assert ordered.group_ordinal(df.limit(0), ["g"], [F.col("s").desc()]).count() == 0


def test_asof_with_a_hot_key(spark):
    rnd = random.Random(7)
    left = [(1 if rnd.random() < 0.5 else rnd.randrange(5), rnd.randrange(500), i) for i in range(400)]
    right = [(1 if rnd.random() < 0.5 else rnd.randrange(5), t, t * 10) for t in rnd.sample(range(500), 90)]
    got = ordered.asof(spark.createDataFrame(left, "g int, t int, n int"), spark.createDataFrame(right, "g int, t int, v int"), ["g"], "t", ["v"])
    want = {(g, t, n, max(((rt, v) for rg, rt, v in right if rg == g and rt <= t), default=(0, None))[1]) for g, t, n in left}
    assert {(r["g"], r["t"], r["n"], r["v"]) for r in got.collect()} == want


def test_column_functions(spark):
    row = spark.range(1).select(
        *[kv.uvarint_size(F.lit(x)).alias(f"u{i}") for i, x in enumerate((0, 127, 128, 16383, 16384, 1 << 62))],
        *[kv.next_power_of_two(F.lit(x)).alias(f"p{i}") for i, x in enumerate((1, 2, 3, 8, 9))],
        kv.crc32c(F.lit(b"123456789")).alias("crc"), kv.crc32c(F.lit(b"")).alias("crc0"), kv.crc32c(F.lit(None).cast("binary")).alias("none"),
        F.hex(kv.internal_key(F.lit(b"k"), F.lit(1).cast("long"))).alias("ik"),
        kv.parse_key(kv.internal_key(F.lit(b"key"), F.lit(5).cast("long"))).alias("pk"),
    ).first()
    assert [row[f"u{i}"] for i in range(6)] == [1, 1, 2, 2, 3, 9]
    assert [row[f"p{i}"] for i in range(5)] == [1, 2, 4, 8, 16]
    assert row["crc"] == 0xE3069283 and row["crc0"] == 0 and row["none"] is None
    assert row["ik"] == "6BFFFFFFFFFFFFFFFE" and bytes(row["pk"]) == b"key"
    assert kv.prefix_end(b"ab\xff") == b"ac" and kv.prefix_end(b"\xff\xff") is None


def test_key_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame(history(), LOG).write.parquet(path)
    plan = read.get(spark.read.parquet(path), "hot", 100)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,hot)" in plan
    plan = read.scan(spark.read.parquet(path), 100, prefix="k0")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,k0)" in plan and "LessThan(key,k1)" in plan
    pushed = [line for line in plan.split("PushedFilters")[1:] if "is_delete" in line.split("]")[0]]
    assert not pushed  # tombstones are dropped after newest-wins only


def test_seconds_do_not_depend_on_the_zone(spark):
    from lodestrata.plans.kv_queries import seconds

    df = spark.sql("select timestamp_ntz'2024-07-01 02:30:15.9' as ts union all select timestamp_ntz'1969-12-31 23:59:59'")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert sorted(r[0] for r in df.select(seconds("ts")).collect()) == [-1, 1719801015]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_scratch_is_cleaned(spark):
    from lodestrata.session import clean_scratch, scratch

    path = scratch(spark, "t")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert clean_scratch(spark) >= 1 and clean_scratch(spark) == 0


def test_lookup_join_beyond_the_bound(spark):
    from lodestrata.operators.skew import lookup_join

    left = spark.createDataFrame([(1, i) for i in range(50)] + [(k, 0) for k in range(9)], "k int, v int")
    right = spark.createDataFrame([(k, str(k)) for k in range(1, 7)], "k int, w string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        for bound in (0, 100):
            got = lookup_join(left, right, "k", how=how, max_broadcast_rows=bound, salts=3)
            assert sorted(map(tuple, got.collect()), key=str) == want


def test_level_planning():
    t = levels.targets([0, 0, 0, 0, 0, 0, 10 << 30])
    assert t.level_bytes[6] == 10 << 30 and t.level_bytes[5] == 1 << 30 and t.base >= 3
    assert levels.priorities([0] * 7, 3) == []
    todo = levels.priorities([0, 0, 0, 0, 0, 50 << 20, 20 << 20], 30)
    assert {p.level for p in todo} == {0, 5} and levels.l0_first(todo)[0].level == 0
    r = [levels.Run(str(i), 0, bytes([i]), bytes([i + 1]), 10, i) for i in range(4)] + [levels.Run("far", 0, b"x", b"z", 10, 9)]
    top, bottom = levels.pick_l0(r, [levels.Run("b", 1, b"\x04", b"\x09", 1), levels.Run("c", 1, b"y", b"z", 1)])
    assert [x.name for x in top] == ["0", "1", "2", "3"] and [x.name for x in bottom] == ["b"]
    assert levels.pick_level(r, [], busy=[(b"\x00", b"\x01")])[0][0].name == "2"
    assert levels.splits(r) == [(None, r[2].hi), (r[2].hi, None)] and levels.splits([]) == []
    assert levels.pick_l0_to_l0(r, 100, now=100.0) and not levels.pick_l0_to_l0(r, 100, now=5.0)
    assert levels.checkpoint_due(10_500, 10_001) and not levels.checkpoint_due(30_000, 10_001)


def test_sketches_and_caches():
    s = sketch.CountMin(8)
    for key in range(7):
        for n in (1, 2, 3):
            s.increment(key)
            assert s.estimate(key) == n
    for _ in range(40):
        s.increment(3)
    assert s.estimate(3) == 15
    s.reset()
    assert s.estimate(3) == 7
    s.clear()
    assert s.estimate(3) == 0
    lru = sketch.WindowLRU(3)
    assert [(lru.add(k) or (0,))[0] for k in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 2]
    seg = sketch.SegmentedLRU(2, 2)
    for k in (1, 2, 3, 4, 5):
        seg.add(k)
    assert list(seg.probation) == [2, 3, 4, 5] and seg.victim() == 2
    assert seg.get(2) and list(seg.protected) == [2]
    assert seg.get(3) and list(seg.protected) == [2, 3] and list(seg.probation) == [4, 5]
    assert seg.get(4) and list(seg.protected) == [3, 4] and list(seg.probation) == [5, 2] and not seg.get(99)


def test_queries_agree_with_sql(spark, sf):
    from compare import compare, connect

    from lodestrata.plans import core_problems, kv_queries, store_queries

    con = connect(sf)
    for q in (kv_queries, store_queries, core_problems):
        for name, f in q.QUERIES.items():
            if name in q.SQL:
                assert compare(spark, con, name, f, q.SQL[name], sf) == "", name
            else:
                assert f(spark, sf).count() > 0, name


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
