"""The stored table: visibility, commits, compaction, garbage collection, recovery."""

import random

import pytest

from lodestrata.model import (
    LOG, BatchTooBigError, BlockedWritesError, EmptyKeyError, InvalidRequestError, KeyNotFoundError, MissingTableError,
    NoRewriteError, Options, RejectedError,
)
from lodestrata.sources.store import KVTable


def contents(t, now, **kw):
    return {bytes(r["key"]): bytes(r["value"]) for r in t.scan(now, **kw).collect()}


def test_life_of_a_table(spark, tmp_path):
    t = KVTable(spark, str(tmp_path / "t"), Options(value_threshold=16))
    rnd = random.Random(1)
    want = {}
    for _ in range(3):
        puts = [(f"k{rnd.randrange(15):02d}".encode(), bytes([65 + rnd.randrange(9)]) * rnd.randrange(0, 40), rnd.choice([0, 0, 90])) for _ in range(12)]
        gone = [f"k{rnd.randrange(15):02d}".encode() for _ in range(2)]
        t.batch(puts, gone)
        for k, v, e in puts:
            want[k] = (v, e)
        for k in gone:
            want.pop(k, None)
    live = {k: v for k, (v, e) in want.items() if e == 0 or e > 90}
    assert contents(t, 90) == live
    assert contents(t, 90, prefix=b"k1") == {k: v for k, v in live.items() if k.startswith(b"k1")}
    assert contents(t, 90, start=b"k03", end=b"k07") == {k: v for k, v in live.items() if b"k03" <= k < b"k07"}
    again = KVTable(spark, str(tmp_path / "t"), Options(value_threshold=16))  # reopened
    assert contents(again, 90) == live
    before = {r["level"]: r for r in t.stats(90).collect()}
    assert before[0]["runs"] >= 3 and before[0]["live"] == len(live) and before[0]["entries"] == sum(before[0][c] for c in ("live", "deleted", "expired", "shadowed"))
    assert t.compact(90, force=True) and contents(t, 90) == live
    assert t.clean() == []  # all files are young
    assert sum(f.startswith("runs/") for f in t.clean(grace_seconds=0)) >= 3 and t.orphans() == ([], [])
    dropped = t.gc(0.01, 90)
    assert dropped and contents(t, 90) == live and t.verify().count() == 0
    t.checkpoint()
    after = t.stats(90).collect()
    assert contents(t, 90) == live and sum(r["live"] for r in after) == len(live) and not any(r["shadowed"] or r["deleted"] for r in after)
    some = next(iter(live))
    assert t.get(some, 90) == live[some]
    t.delete(some)
    with pytest.raises(KeyNotFoundError):
        t.get(some, 90)


def test_errors(spark, tmp_path):
    t = KVTable(spark, str(tmp_path / "t"), Options(max_batch_count=3))
    with pytest.raises(EmptyKeyError):
        t.put(b"", b"x")
    with pytest.raises(EmptyKeyError):
        t.write(spark.createDataFrame([(None, 1, False, b"x", 0, 0)], LOG))
    with pytest.raises(BatchTooBigError):
        t.batch([(b"a", b"", 0)] * 3)
    with pytest.raises(KeyNotFoundError):
        t.get(b"a", 0)
    with pytest.raises(InvalidRequestError):
        t.gc(1.0, 0)
    t.put(b"a", b"")
    assert t.get(b"a", 0) == b""  # an empty value is not a delete
    with pytest.raises(NoRewriteError):
        t.gc(0.5, 0)
    stale = t.manifest()
    t.put(b"b", b"1")
    with pytest.raises(RejectedError):
        t._commit(stale, [])
    with pytest.raises(InvalidRequestError):
        t.gc(0.5, 0, sample=0.0)
    t.close()
    with pytest.raises(BlockedWritesError):
        t.put(b"c", b"1")


def test_missing_run(spark, tmp_path):
    import shutil

    t = KVTable(spark, str(tmp_path / "t"))
    t.put(b"a", b"1")
    shutil.rmtree(tmp_path / "t" / "runs")
    with pytest.raises(MissingTableError):
        t.clean(grace_seconds=0)


def test_two_writers_number_their_entries_apart(spark, tmp_path):
    one, two = (KVTable(spark, str(tmp_path / "t")) for _ in range(2))
    published = one._publish
    once = []

    def late(version, body):
        if not once:  # the other writer comes between
            once.append(1)
            two.put(b"a", b"two")
        published(version, body)

    one._publish = late
    one.put(b"a", b"one")
    rows = sorted((r["seq"], bytes(r["value"])) for r in one.log().collect())
    assert rows == [(1, b"two"), (2, b"one")] and one.get(b"a", 0) == b"one"


def test_writers_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: KVTable(spark, str(tmp_path / "t")).put(b"k%d" % (i % 2), b"%d" % i), range(6)))
    rows = KVTable(spark, str(tmp_path / "t")).log().collect()
    assert sorted(r["seq"] for r in rows) == [1, 2, 3, 4, 5, 6]


def test_torn_manifest_and_unfinished_commit(spark, tmp_path):
    t = KVTable(spark, str(tmp_path / "t"))
    t.put(b"a", b"1")
    folder = tmp_path / "t" / "manifest"
    (folder / ".half").write_text("12")  # crashed before it had a name
    whole = (folder / f"{1:020d}.json").read_text()
    (folder / f"{2:020d}.json").write_text(whole[: len(whole) // 2])  # damaged
    again = KVTable(spark, str(tmp_path / "t"))
    assert again.get(b"a", 0) == b"1" and again.manifest().version == 2
    again.put(b"a", b"3")
    assert again.get(b"a", 0) == b"3" and again.manifest().next_seq == 3


def test_snapshots_survive_compaction(spark, tmp_path):
    t = KVTable(spark, str(tmp_path / "t"), Options(value_threshold=4))
    t.batch([(b"a", b"old value", 0), (b"b", b"b", 0)])
    held = t.hold()
    t.batch([(b"a", b"new value", 0)], [b"b"])
    t.compact(0, force=True)
    assert contents(t, 0) == {b"a": b"new value"} and contents(t, 0, as_of_seq=held) == {b"a": b"old value", b"b": b"b"}
    with pytest.raises(InvalidRequestError):
        t.scan(0, as_of_seq=1)
    with pytest.raises(NoRewriteError):  # the held snapshot needs the old value
        t.gc(0.5, 0)
    t.release(held)
    t.compact(0, force=True)
    assert t.log().count() == 1
    with pytest.raises(InvalidRequestError):
        t.scan(0, as_of_seq=held)


def test_gc_frees_space(spark, tmp_path):
    t = KVTable(spark, str(tmp_path / "t"), Options(value_threshold=64, value_file_bytes=20_000))
    rnd = random.Random(3)
    values = {b"k%03d" % i: rnd.randbytes(400) for i in range(100)}
    t.batch([(k, v, 0) for k, v in values.items()])
    assert len(t.manifest().files) >= 2
    t.batch([], [k for i, k in enumerate(values) if i % 10])
    assert t.gc(0.5, 0, sample=0.5)
    gone = t.clean(grace_seconds=0)
    assert any(f.startswith("values/") for f in gone) and not any((tmp_path / "t" / f).exists() for f in gone)
    held = sum(r["len"] for r in t._value_files(t.manifest().files).collect())
    assert held < 0.2 * 100 * 400 and contents(t, 0) == {k: v for i, (k, v) in enumerate(values.items()) if i % 10 == 0}
    assert t.get(b"k010", 0) == values[b"k010"]


def test_runs_are_rolled_at_their_size(spark, tmp_path):
    t = KVTable(spark, str(tmp_path / "t"), Options(memtable_size=2000, base_table_size=3000, base_level_size=10_000, l0_tables=2))
    rnd = random.Random(4)
    want = {}
    for _ in range(3):
        rows = [(b"key%05d" % rnd.randrange(400), rnd.randbytes(40), 0) for _ in range(150)]
        t.batch(rows)
        want.update({k: v for k, v, _ in rows})
    l0 = [r for r in t.manifest().runs.values() if r["level"] == 0]
    assert len(l0) > 9 and all(r["size"] < 4000 for r in l0)
    top, target = t.plan(0)
    assert top and target > 0
    everything = (b"", b"\xff")
    assert t.plan(10**10, [everything])[1] == 0  # the base is busy: small runs of level 0 among themselves
    assert t.compact(10**10, busy=[everything]) and contents(t, 0) == want
    for _ in range(9):
        if not t.compact(0):
            break
    assert contents(t, 0) == want and max(r["level"] for r in t.manifest().runs.values()) > 0


def test_drop_prefixes_and_checksums(spark, tmp_path):
    t = KVTable(spark, str(tmp_path / "t"), Options(value_threshold=64))
    t.batch([(b"a1", b"x" * 100, 0), (b"a2", b"y", 0), (b"b1", b"z", 0)])
    t.put(b"a3", b"w")
    assert t.drop_prefixes([b"a"]) and contents(t, 0) == {b"b1": b"z"} and not t.drop_prefixes([b"q"])
    name = next(iter(t.manifest().runs))
    other = spark.createDataFrame([(b"b1", 1, False, b"changed", 0, 0, None, None)], t.log().schema)
    other.coalesce(1).write.parquet(str(tmp_path / "o"))
    file = next((tmp_path / "o").glob("*.parquet"))
    (tmp_path / "t" / "runs" / name).write_bytes(file.read_bytes())
    (tmp_path / "t" / "runs" / name).with_name("." + name.split("/")[1] + ".crc").unlink()
    assert [r["what"] for r in t.verify().collect()] == ["run"]


def test_multi_get(spark, tmp_path):
    t = KVTable(spark, str(tmp_path / "t"), Options(value_threshold=4))
    t.batch([(b"a", b"long value", 0), (b"b", b"x", 5), (b"c", b"x", 0)], [b"c"])
    keys = spark.createDataFrame([(k,) for k in (b"a", b"b", b"c", b"d", b"a", None)], "key binary")
    got = {bytes(r["key"]): (r["status"], r["value"] and bytes(r["value"])) for r in t.multi_get(keys, 5).collect()}
    assert got == {b"a": ("found", b"long value"), b"b": ("expired", None), b"c": ("deleted", None), b"d": ("not_found", None)}


def test_a_replayed_batch_is_not_written_again(spark, tmp_path):
    t = KVTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(b"a", 1, False, b"x", 0, 0)], LOG)
    assert t.write(rows, batch=("s", 0)) and not t.write(rows, batch=("s", 0)) and t.write(rows, batch=("other", 0))
    assert t.log().count() == 2


def test_automatic_compaction_and_stream(spark, tmp_path):
    from lodestrata.streaming.ingest import ingest

    src = tmp_path / "in"
    for i in range(3):
        rows = [(f"k{j}".encode(), i * 10 + j, j == i, f"v{i}".encode(), 0, 0) for j in range(5)]
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(str(src / f"b{i}"))
    t = KVTable(spark, str(tmp_path / "t"), Options(l0_tables=1))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(src / "b[0-9]"))
    ingest(stream, t, str(tmp_path / "cp"), compact_every=2).awaitTermination()
    assert contents(t, 0) == {f"k{j}".encode(): b"v2" for j in range(5) if j != 2}
    assert any(r["level"] > 0 for r in t.manifest().runs.values())
