"""Sketches, caches, codecs, checksummed records, run overlaps and the session's folders."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import kv
from lodestrata.operators import levels, sketch, wal
from lodestrata.operators.skew import crowded_values, fits


def test_bloom(spark, monkeypatch):
    h = np.random.default_rng(1).integers(0, 1 << 64, 40_000, dtype=np.uint64)
    b = sketch.Bloom(20_000, sketch.bloom_bits_per_key(20_000, 0.01)).add(h[:20_000])
    assert b.may_contain(h[:20_000]).all() and b.may_contain(h[20_000:]).mean() < 0.02 and b.words.nbytes < 30_000
    monkeypatch.setattr(sketch, "BLOOM_PART", 300)  # several parts
    members = spark.range(0, 2000, 2).withColumnRenamed("id", "k").union(spark.sql("select cast(null as bigint)"))
    got = sketch.bloom_probe(members, spark.range(2000).withColumnRenamed("id", "k"), "k").collect()
    assert len(got) == 2000 and all(r["maybe"] for r in got if r["key"] % 2 == 0)
    assert sum(r["maybe"] for r in got if r["key"] % 2) < 60
    assert sketch.bloom_probe(members.limit(0), members, "k").where("maybe").count() == 0


def test_count_min(spark):
    rnd = random.Random(2)
    keys = [min(int(rnd.expovariate(0.05)), 99) for _ in range(3000)]
    df = spark.createDataFrame([(k, "x") for k in keys], "k int, s string").repartition(4)
    for halvings in (0, 1):
        made = sketch.count_min(df, ["k", "s"], 512)
        for _ in range(halvings):
            made = sketch.halved(made)
        got = {r["k"]: r["estimate"] for r in sketch.estimates(made, df, ["k", "s"], 512).collect()}
        want = {k: min(keys.count(k), 15) >> halvings for k in set(keys)}
        assert got.keys() == want.keys() and all(got[k] >= want[k] for k in want)
        assert sum(got[k] == want[k] for k in want) > 0.9 * len(want)
    crowded = sketch.count_min(df, ["k", "s"], 2).collect()
    assert len(crowded) <= 8 and all(r["n"] == 15 for r in crowded)


@pytest.mark.parametrize("capacity", [1, 4, 9])
def test_lru_hits_are_those_of_stack_distance(capacity):
    rnd = random.Random(capacity)
    trace = [int(rnd.random() ** 2 * 20) for _ in range(600)]
    hits = sketch._simulate(trace, sketch.WindowLRU(capacity))
    for i, key in enumerate(trace):
        before = [j for j in range(i) if trace[j] == key]
        assert hits[i] == (bool(before) and len(set(trace[before[-1] + 1:i])) < capacity)


def test_tiny_lfu_keeps_what_is_asked_often():
    rnd = random.Random(5)
    trace = [rnd.randrange(20) if rnd.random() < 0.5 else 1000 + i for i in range(6000)]  # a hot set within a scan
    rate = {p: sum(sketch._simulate(trace, make(40))) / len(trace) for p, make in sketch.POLICIES.items()}
    assert rate["tinylfu"] > 0.45 and rate["tinylfu"] > rate["lru"]
    cache = sketch.TinyLFU(10)
    sketch._simulate(trace, cache)
    assert len(cache.main) + len(cache.window.held) <= 10


def test_codecs(spark):
    numbers = [0, 1, 127, 128, 300, 2**31 - 1, 2**32 - 1, 2**40 + 5, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    got = df.select(
        "n", kv.from_big_endian(kv.big_endian(F.col("n"), 8)).alias("u64"), F.hex(kv.big_endian(F.col("n"), 4)).alias("u32"), kv.uvarint(F.col("n")).alias("v"),
        kv.from_uvarint(kv.uvarint(F.col("n"))).alias("back"), kv.uvarint_size(F.col("n")).alias("size"), kv.file_id(kv.file_name(F.col("n"))).alias("id"),
    ).collect()
    for r in got:
        assert r["n"] == r["u64"] == r["back"] == r["id"] and len(r["v"]) == r["size"] and int(r["u32"], 16) == r["n"] % 2**32
        rest, out = r["n"], bytearray()
        while rest >= 128:
            out.append(rest & 127 | 128)
            rest >>= 7
        assert bytes(r["v"]) == bytes([*out, rest])
    one = spark.range(1).select(
        kv.file_name(F.lit(7)).alias("name"), kv.file_id(F.lit("a/b/00012.vlog"), ".vlog").alias("id"), kv.file_id(F.lit("x.sst")).alias("none"),
        kv.from_uvarint(F.lit(b"\x80")).alias("short"), kv.from_uvarint(F.lit(b"")).alias("empty"),
        *[kv.common_prefix(F.lit(a), F.lit(b)).alias(f"c{i}") for i, (a, b) in enumerate([(b"abc", b"abd"), (b"ab", b"abc"), (b"", b"x"), (b"x", b"y"), (b"ab", b"ab")])],
    ).first()
    assert (one["name"], one["id"], one["none"], one["short"], one["empty"]) == ("00007.sst", 12, None, None, None)
    assert [one[f"c{i}"] for i in range(5)] == [2, 2, 0, 0, 2]


def test_random_entries(spark):
    a, b = (kv.random_entries(spark, 200, 20, seed=3).collect() for _ in range(2))
    assert a == b and len({bytes(r["key"]) for r in a}) == 200
    assert {len(r["value"]) for r in a} <= set(range(21)) and len({len(r["value"]) for r in a}) > 10


def test_replay_stops_at_the_first_damaged_record(spark):
    rows = [(f"k{i}", i, i % 5 == 0, None if i % 5 == 0 else f"v{i}", 0) for i in range(40)]
    log = spark.createDataFrame(rows, "key string, seq bigint, is_delete boolean, value string, expires_at bigint")
    written = wal.append(log, F.floor(F.col("seq") / 10))
    assert {r["seq"] for r in wal.replay(written).collect()} == set(range(40))
    damaged = written.withColumn("value", F.when(F.col("seq").isin(17, 19), "?").otherwise(F.col("value")))
    damaged = damaged.withColumn("checksum", F.when(F.col("seq") == 20, F.lit(None)).otherwise(F.col("checksum")))
    assert {r["seq"] for r in wal.replay(damaged).collect()} == {*range(17), *range(30, 40)}


@pytest.mark.parametrize("n", [0, 5, 900])
def test_overlapping_runs(spark, n):
    rnd = random.Random(n)
    runs = [(i, *sorted(rnd.sample(range(5000), 2))) if i % 7 else (i, 40, 40) for i in range(n)]
    runs = [(i, lo, min(hi, lo + 60)) for i, lo, hi in runs]
    df = spark.createDataFrame(runs, "id int, lo int, hi int").repartition(3)
    got = [tuple(r) for r in levels.overlapping_pairs(df).collect()]
    want = {(a[0], b[0]) for a in runs for b in runs if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2]}
    assert len(got) == len(set(got)) and set(got) == want


def test_sides_are_measured(spark):
    df = spark.range(1000).withColumn("s", F.repeat(F.lit("x"), 1000))
    assert fits(df, 1000) and not fits(df, 999) and not fits(df, 1000, 500_000)
    crowd = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    assert crowded_values(crowd, "v", 500) == [7] and crowded_values(crowd.limit(0), "v", 1) == []


def test_scratch_goes_with_its_scope(spark):
    import os

    from lodestrata.session import scratch, scratch_scope

    with scratch_scope(spark):
        path = scratch(spark, "x")
        spark.range(3).write.parquet(path)
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_entry_survives_a_missing_library(sf):
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p9_found' not in q"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
