"""Far too many small files (sorted-run consolidation).

The live records of thousands of small files become few files per level, each
a sorted run of a key range:

1. ``read_runs``: the files of a table are read as one run: its records, one
   copy of each (identity: table and record number, so different records of
   equal content all stay), sorted by key.  A table of very many records gives
   a run per ``RUN_RECORDS`` record numbers.
2. ``plan_files``: bounds on (level, key, table, record number), sixteen to a
   file, are taken from a sample of the runs; the bytes between them are then
   counted exactly, and neighbours are joined until a file has ``target_bytes``.
   The record number ends the order, so a key that holds a third of all records
   is divided between files like any other.
3. ``merge_runs``: every run is cut at the files' bounds, a task gets the slices
   of one file and merges them k-way with a heap; nothing is sorted again.
4. ``consolidate``: a task writes its file; ``run_metadata`` reads key range, records and bytes of each back.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators.skew import BROADCAST_ROWS, crowded_values, lookup_join
from lodestrata.session import map_arrow, scratch

#: Bytes a record takes besides key and value: table, number, expiry, meta, lengths.
RECORD_OVERHEAD = 29
#: Record numbers of a table in one run; rows of a table from which its copies are removed before they meet.
RUN_RECORDS, CROWDED_ROWS = 4096, 1 << 17
#: Bounds to a file, and sampled records to a bound: 16 keys a file are what the driver holds, 320 what it sees.
PARTS, SAMPLES = 16, 20
PAYLOAD = ("key", "value", "expires_at", "meta")


def live_rows(records: DataFrame, live: DataFrame, payload: Sequence[str] = PAYLOAD, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of live tables as read, copies included, with the table's level (null: -1).

    ``live``: (table_id, level), one row per table; measured by ``lookup_join``.
    A record without table or number has no identity and is left out.
    """
    src = records.where("table_id is not null and rec_no is not null").select(
        "table_id", "rec_no", F.coalesce("file_name", F.lit("")).alias("file_name"), *[F.col(f"`{c}`") for c in payload],
    )
    levels = live.select("table_id", F.coalesce("level", F.lit(-1)).cast("int").alias("level"))
    return lookup_join(src, levels, "table_id", max_broadcast_rows=max_broadcast_rows, salt_on=["rec_no"])


def _place(level: int, key: bytes | None, table: int, rec: int) -> tuple:
    """What the merged order compares; a null key comes first."""
    return level, key is not None, key or b"", table, rec


def _assemble(payload: Sequence[str], schema: pa.Schema):
    """Runs from rows sorted by (table, part, record number, file): of each record its first row, by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table, part = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("table_id", "part"))
            first = np.flatnonzero((table != table[-1]) | (part != part[-1]))
            cut = int(first[-1]) + 1 if len(first) else 0  # the last run may go on in the next batch
            if cut or held and not _continues(held[-1], table[0], part[0]):
                yield from _runs([*held, batch.slice(0, cut)])
                held = []
            held.append(_once(batch.slice(cut)))
        if held:
            yield from _runs(held)

    def _continues(before: pa.RecordBatch, table, part) -> bool:
        last = before.slice(before.num_rows - 1)
        return last.column(last.schema.get_field_index("table_id"))[0].as_py() == table and last.column(last.schema.get_field_index("part"))[0].as_py() == part

    def _once(rows: pa.RecordBatch) -> pa.RecordBatch:
        """Without further copies of a record."""
        table, rec = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("table_id", "rec_no"))
        new = np.r_[True, (table[1:] != table[:-1]) | (rec[1:] != rec[:-1])]
        return rows if new.all() else rows.take(pa.array(np.flatnonzero(new)))

    def _runs(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _once(pa.Table.from_batches([p for p in parts if p.num_rows], parts[0].schema).combine_chunks().to_batches()[0])
        table, part, rec, level = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("table_id", "part", "rec_no", "level"))
        keys = rows.column(rows.schema.get_field_index("key")).to_pylist()
        starts = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (part[1:] != part[:-1])])
        ends = np.r_[starts[1:], len(table)]
        order = np.empty(len(table), np.int64)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            order[a:b] = sorted(range(a, b), key=lambda i: (keys[i] is not None, keys[i] or b"", rec[i]))
        rows = rows.take(pa.array(order))
        offsets = pa.array(np.r_[starts, len(table)].astype(np.int32))
        listed = [pa.ListArray.from_arrays(offsets, rows.column(rows.schema.get_field_index(c))) for c in ("rec_no", "n_bytes", *payload)]
        yield pa.RecordBatch.from_arrays([pa.array(level[starts].astype(np.int32)), pa.array(table[starts]), *listed], schema=schema)

    return run


def read_runs(rows: DataFrame, path: str, payload: Sequence[str] = PAYLOAD) -> DataFrame:
    """The runs of ``live_rows``, written to ``path``: level, table_id and lists rec_no, n_bytes and the payload, by key.

    Copies that differ resolve to the row in the file with the smallest name, then by content.
    """
    spark = rows.sparkSession
    size = F.lit(RECORD_OVERHEAD) + F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
    crowded = crowded_values(rows, "table_id", CROWDED_ROWS)
    if crowded:
        # a table with very many rows may be very many copies: they are removed while they are still spread
        many = F.col("table_id").isin(crowded)
        row = F.struct("file_name", *[F.col(f"`{c}`") for c in payload])
        once = rows.where(many).groupBy("table_id", "rec_no").agg(F.min(row).alias("row"), F.first("level").alias("level"))
        rows = rows.where(~many).unionByName(once.select("table_id", "rec_no", "row.*", "level"))
    rows = rows.withColumns({"n_bytes": size.cast("long"), "part": F.floor(F.col("rec_no") / F.lit(RUN_RECORDS)).cast("long"), "h": F.xxhash64(*[F.col(f"`{c}`") for c in payload])})
    by_run = rows.repartition("table_id", "part").sortWithinPartitions("table_id", "part", "rec_no", "file_name", "h").drop("h", "file_name")
    lists = [T.StructField(c, T.ArrayType(by_run.schema[c].dataType)) for c in ("rec_no", "n_bytes", *payload)]
    shape = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("table_id", T.LongType()), *lists])
    arrow = pa.schema([("level", pa.int32()), ("table_id", pa.int64()), *((f.name, pa.list_(_ARROW[f.dataType.elementType.simpleString()])) for f in lists)])
    out = by_run.withColumn("table_id", F.col("table_id").cast("long"))
    map_arrow(out, _assemble(tuple(payload), arrow), shape).write.parquet(path)
    return spark.read.parquet(path)


_ARROW = {
    "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(), "double": pa.float64(), "float": pa.float32(),
}


@dataclass(frozen=True)
class Plan:
    """Where files begin: file i holds what lies from bound i - 1 up to before bound i; and its level."""

    bounds: tuple[tuple, ...] = ()
    levels: tuple[int, ...] = ()


def _cuts(batch: pa.RecordBatch, bounds: Sequence[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """(row, file, from, to) of the slices of each run of the batch: bounds are looked up in the run, not records among the bounds."""
    levels, tables = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("level", "table_id"))
    recs, keys = (batch.column(batch.schema.get_field_index(c)) for c in ("rec_no", "key"))
    for row, (level, table) in enumerate(zip(levels, tables, strict=True)):
        key, rec = keys[row].as_py(), recs[row].as_py()
        n, at = len(rec), 0
        place = lambda i: _place(level, key[i], table, rec[i])  # noqa: E731, B023
        file = bisect_right(bounds, place(0))
        while at < n:
            end = bisect_left(range(n), bounds[file], at, key=place) if file < len(bounds) else n
            if end > at:
                yield row, file, at, end
            at, file = end, file + 1


def _weigh(bounds: Sequence[tuple]):
    """(part, n_bytes): bytes of each run between the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("n_bytes"))
            ends = sizes.offsets.to_numpy().astype(np.int64)
            total = np.r_[0, np.cumsum(sizes.flatten().to_numpy())]
            base = ends - ends[0]
            found = [(part, int(total[base[row] + b] - total[base[row] + a])) for row, part, a, b in _cuts(batch, bounds)]
            if found:
                part, size = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(size, pa.int64())], names=["part", "n_bytes"])

    return run


def plan_files(runs: DataFrame, target_bytes: int) -> Plan:
    """Bounds of files of ``target_bytes``; the last file of a level takes what is left."""
    sizes = {r["level"]: (r["n"], r["n_bytes"]) for r in runs.select("level", F.explode("n_bytes").alias("b")).groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("b").alias("n_bytes")).collect()}
    bounds: list[tuple] = []
    wanted = {level: -(-b * PARTS // target_bytes) for level, (_, b) in sizes.items()}
    large = {level: max(1, n // (wanted[level] * SAMPLES)) for level, (n, b) in sizes.items() if b > target_bytes}
    if large:
        every = F.element_at(F.create_map(*[F.lit(x) for kv in large.items() for x in kv]), F.col("level"))
        each = runs.where(F.col("level").isin(list(large))).select("level", "table_id", F.explode(F.arrays_zip("rec_no", "key")).alias("r"))
        each = each.where(F.pmod(F.xxhash64("table_id", "r.rec_no"), every) == 0)
        seen: dict[int, list[tuple]] = {}
        for r in each.select("level", "r.key", "table_id", "r.rec_no").collect():
            key = None if r["key"] is None else bytes(r["key"])
            seen.setdefault(r["level"], []).append(_place(r["level"], key, r["table_id"], r["rec_no"]))
        for level, places in seen.items():
            places.sort()
            step = max(1, len(places) // wanted[level])
            bounds += places[step::step]
    # a bound before each level but the first
    levels = sorted(sizes)
    bounds = sorted({*bounds, *(_place(level, None, -(1 << 63), -(1 << 31)) for level in levels[1:])})
    weights = np.zeros(len(bounds) + 1, np.int64)
    weighed = map_arrow(runs.select("level", "table_id", "rec_no", "n_bytes", "key"), _weigh(bounds), "part int, n_bytes bigint")
    for r in weighed.groupBy("part").agg(F.sum("n_bytes").alias("n_bytes")).collect():  # PARTS rows a file
        weights[r["part"]] = r["n_bytes"]
    kept, of, filled = [], [levels[0]] if levels else [], 0
    for i, bound in enumerate(bounds):
        filled += int(weights[i])
        new_level = bound[0] != of[-1]
        # closed where it is nearest to the target
        if new_level or filled + int(weights[i + 1]) // 2 >= target_bytes:
            kept.append(bound)
            of.append(bound[0])
            filled = 0
    return Plan(tuple(kept), tuple(of))


def _slice(plan: Plan):
    """The slices of each run with their file's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = list(_cuts(batch, plan.bounds))
            if not cuts:
                continue
            rows, files, a, b = (np.array(x) for x in zip(*cuts, strict=True))
            out = []
            for c in batch.columns:
                if not isinstance(c, pa.ListArray):
                    out.append(c.take(pa.array(rows)))
                    continue
                start = c.offsets.to_numpy().astype(np.int64)
                start = start - start[0]
                # slices of consecutive runs follow each other without gaps
                ends = np.r_[start[rows] + a, start[rows[-1]] + b[-1]].astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), c.flatten()))
            yield pa.RecordBatch.from_arrays([pa.array(files.astype(np.int32)), *out], names=["file_no", *batch.schema.names])

    return run


def _merge(payload: Sequence[str]):
    """k-way merge of the slices of a file: a heap holds the next record of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        slices = pa.Table.from_batches(got).combine_chunks()
        lists = {c: slices[c].chunk(0) for c in ("rec_no", "n_bytes", *payload)}
        ends = lists["rec_no"].offsets.to_numpy().astype(np.int64)
        flat = {c: v.flatten() for c, v in lists.items()}
        ends = ends - ends[0]
        level, table, file = (slices[c].to_numpy() for c in ("level", "table_id", "file_no"))

        def records(i: int) -> Iterator[tuple]:
            a, b = int(ends[i]), int(ends[i + 1])
            keys, recs, own = flat["key"].slice(a, b - a).to_pylist(), flat["rec_no"].slice(a, b - a).to_pylist(), int(table[i])
            for at, (key, rec) in enumerate(zip(keys, recs, strict=True), a):
                yield key is not None, key or b"", own, rec, at

        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        for number in np.unique(file).tolist():  # one, where a task has one file
            order = np.fromiter((r[4] for r in heapq.merge(*(records(i) for i in np.flatnonzero(file == number).tolist()))), np.int64)
            for a in range(0, len(order), 1 << 14):
                at = pa.array(order[a:a + (1 << 14)])
                who = owner[order[a:a + (1 << 14)]]
                columns = [pa.array(level[who]), pa.array(file[who]), pa.array(table[who]), *(flat[c].take(at) for c in ("rec_no", "n_bytes", *payload))]
                yield pa.RecordBatch.from_arrays(columns, names=["level", "file_no", "table_id", "rec_no", "n_bytes", *payload])

    return run


def merge_runs(runs: DataFrame, plan: Plan, payload: Sequence[str] = PAYLOAD) -> DataFrame:
    """The records of ``runs``, file by file in merged order: level, file_no, table_id, rec_no, n_bytes, payload; a partition is a file."""
    columns = ["level", "table_id", "rec_no", "n_bytes", *payload]
    schema = T.StructType([T.StructField("file_no", T.IntegerType()), *[runs.schema[c] for c in columns]])
    cut = map_arrow(runs.select(*columns), _slice(plan), schema).repartitionById(max(1, len(plan.levels)), F.col("file_no"))
    flat = [T.StructField(c, runs.schema[c].dataType.elementType) for c in ("rec_no", "n_bytes", *payload)]
    out = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("file_no", T.IntegerType()), T.StructField("table_id", T.LongType()), *flat])
    return map_arrow(cut, _merge(tuple(payload)), out)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of consolidated files; level null where it was unknown."""
    return spark.read.parquet(path).withColumn("level", F.when(F.col("level") >= 0, F.col("level")))


def run_metadata(files: DataFrame) -> DataFrame:
    """Per file: level, key range, records and bytes."""
    return files.groupBy("level", "file_no").agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("n_records"), F.sum("n_bytes").alias("n_bytes"),
    )


def consolidate(
    records: DataFrame, live: DataFrame, path: str | None = None, target_bytes: int = 128 << 20, payload: Sequence[str] = PAYLOAD,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Each live record once, k-way merged by key range into files of ``target_bytes`` below ``path``; returns what was written.

    ``payload`` must hold key and value.  Without ``path`` the files lie in the shared folder.

    Defined cases: empty tables give no rows; a live table without a file adds
    nothing; records of tables that are not live are dropped; a level that is
    null stays null; null and empty keys and values are kept; more columns in
    either table are ignored.
    """
    if target_bytes < 1:
        raise ValueError("target_bytes must be positive")
    spark = records.sparkSession
    folder = scratch(spark, "runs")
    runs = read_runs(live_rows(records, live, payload, max_broadcast_rows), f"{folder}/runs", payload)
    path = path or f"{folder}/files"
    merge_runs(runs, plan_files(runs, target_bytes), payload).write.parquet(path)
    return read_files(spark, path)
