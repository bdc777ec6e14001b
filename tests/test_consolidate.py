"""Run consolidation: nothing lost, nothing twice, sorted, sized."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestrata.operators import consolidate as C

SCHEMA = "file_name string, table_id bigint, rec_no int, key binary, value binary, expires_at bigint, meta tinyint, level string"


def data(spark):
    rows = []
    for t in range(1, 6):
        for n in range(40):
            key = b"hot" if t == 1 else bytes([n % 7, t])
            rows.append((f"{t}.sst", t, n, key, None if n % 5 == 0 else b"v" * (n % 30), 0, 0, "clash"))
    rows += [("1-copy.sst", 1, n, b"hot", b"v" * (n % 30) if n % 5 else None, 0, 0, "clash") for n in range(0, 40, 2)]  # part of a copy
    rows += rows[:9]  # read twice
    rows += [(None, 2, 100, None, b"x", 0, 0, ""), ("9.sst", 9, 1, b"k", b"x", 0, 0, ""), ("x", None, 1, b"k", b"", 0, 0, ""), ("x", 2, None, b"k", b"", 0, 0, "")]
    live = [(1, 0), (2, 1), (3, 1), (4, None), (77, 2)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(live, "table_id bigint, level int")


WANT = {(t, n) for t in (1, 2, 3, 4) for n in range(40)} | {(2, 100)}


def test_each_live_record_once(spark, monkeypatch):
    for limit, crowded, part in ((1000, 1 << 17, 4096), (0, 30, 7)):  # broadcast and salted join; copies removed before they meet, tables in parts
        monkeypatch.setattr(C, "CROWDED_ROWS", crowded)
        monkeypatch.setattr(C, "RUN_RECORDS", part)
        records, live = data(spark)
        got = C.consolidate(records.repartition(3), live, target_bytes=200, max_broadcast_rows=limit).collect()
        assert len(got) == len(WANT) and {(r["table_id"], r["rec_no"]) for r in got} == WANT
        assert {r["level"] for r in got if r["table_id"] == 4} == {None}
        kept = {(r["table_id"], r["rec_no"]): r["value"] for r in got}
        assert kept[1, 0] is None and bytes(kept[1, 2]) == b"vv"


def random_records(spark, n=6000, seed=2):
    """One key holds a third of all records; files hold parts of their table in any order, some twice."""
    rnd = random.Random(seed)
    rows = []
    for t in range(60):
        for i in range(n // 60):
            key = b"hot" if rnd.random() < 0.33 else bytes(rnd.randrange(256) for _ in range(4))
            row = (t, i, key, b"v" * rnd.randrange(60), 0, 0)
            rows += [(f"{t}-{f}.sst", *row) for f in range(2 if rnd.random() < 0.2 else 1)]
    rnd.shuffle(rows)
    live = [(t, t % 3) for t in range(60)]
    return spark.createDataFrame(rows, "file_name string, table_id bigint, rec_no int, key binary, value binary, expires_at bigint, meta tinyint"), spark.createDataFrame(live, "table_id bigint, level int")


def test_files_have_the_wanted_size_whatever_the_session(spark, tmp_path):
    records, live = random_records(spark)
    for parts in ("1", "7"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            files = C.run_metadata(C.consolidate(records, live, str(tmp_path / parts), 20_000)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        for level in range(3):
            mine = sorted((r for r in files if r["level"] == level), key=lambda r: r["file_no"])
            assert len(mine) >= 6 and all(18_000 <= r["n_bytes"] <= 22_000 for r in mine[:-1])
            assert all(bytes(a["max_key"]) <= bytes(b["min_key"]) for a, b in zip(mine, mine[1:]))
        # a file on disk each, in merged order
        written = sorted((tmp_path / parts).glob("*.parquet"))
        assert len([f for f in written if pq.read_metadata(f).num_rows]) == len(files)
        for f in written:
            t = pq.read_table(f, columns=["level", "file_no", "key", "table_id", "rec_no"]).to_pylist()
            assert len({r["file_no"] for r in t}) <= 1
            places = [(r["level"], r["key"], r["table_id"], r["rec_no"]) for r in t]
            assert places == sorted(places)
    assert sum(r["n_records"] for r in files) == 6000


def test_runs_are_sorted_and_whole(spark, tmp_path):
    records, live = random_records(spark, 600)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "13")  # runs that go on in the next batch
    try:
        runs = C.read_runs(C.live_rows(records, live), str(tmp_path / "runs")).collect()
    finally:
        spark.conf.set(name, old)
    assert sorted(r["table_id"] for r in runs) == list(range(60))
    for r in runs:
        places = [(bytes(k), n) for k, n in zip(r["key"], r["rec_no"])]
        assert places == sorted(places) and sorted(r["rec_no"]) == list(range(10))


def test_empty_tables(spark):
    records, live = data(spark)
    none = F.lit(False)
    assert C.consolidate(records.where(none), live).count() == 0
    assert C.consolidate(records, live.where(none)).count() == 0
