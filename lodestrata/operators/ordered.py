"""Operators on the global key order, without ever sorting everything in one task.

Rows are range-partitioned and sorted once; each range is then walked in order
(``_walked``), and what a range must know of those before it (rows counted,
the last value) is one row per range, so it is gathered and handed back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import cut, map_arrow

_PID = "__pid"


def with_ordinal(df: DataFrame, by: Sequence[str], name: str = "ordinal", descending: bool = False) -> DataFrame:
    """``df`` with each row's place (from 1) in the order of ``by``."""
    order = [F.col(c).desc() if descending else F.col(c) for c in by]
    # the id holds the range's number above its 33 low bits and the place in the range in them
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn(_PID, F.shiftright("__at", 33).cast("int"))
    counts = sorted((r[0], r[1]) for r in ranged.groupBy(_PID).count().collect())  # a row per partition
    before, total = [], 0
    for pid, n in counts:
        before.append((pid, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, f"{_PID} int, __before bigint")
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1
    return ranged.join(F.broadcast(offsets), _PID).withColumn(name, place).drop(_PID, "__at", "__before")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows in order, with __g (group) and __value: range, place in it, place in the group here, last value of the group here, whether the group is the range's first."""
    pid = TaskContext.get().partitionId()
    n, group, placed, held, first = 0, None, 0, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(batch.schema.get_field_index("__g")).to_numpy(zero_copy_only=False)
        value = batch.column(batch.schema.get_field_index("__value"))
        if group is None or g[0] != group:
            placed, held = 0, None
        first = g[0] if first is None else first
        at = np.arange(len(g))
        new = np.r_[False, g[1:] != g[:-1]]
        start = np.maximum.accumulate(np.where(new, at, 0))
        place = at - start + np.where(start == 0, placed, 0) + 1
        some = np.maximum.accumulate(np.where(np.asarray(value.is_valid()), at, -1))
        known = some >= start
        index = np.where(known, some, len(g) if held is not None else -1)
        if held is not None:
            index = np.where(~known & (start > 0), -1, index)
        pool = value if held is None else pa.concat_arrays([value, held])
        last = pool.take(pa.array(np.maximum(index, 0), pa.int64(), mask=index < 0))
        opening = np.logical_and.accumulate(~new) & (g[0] == first) & (n == 0 or group == first)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(g), pid, np.int32)), pa.array(n + at), pa.array(place), last, pa.array(opening)],
            names=[*batch.schema.names, _PID, "__n", "__place", "__last", "__opens"],
        )
        n, group, placed, held = n + len(g), g[-1], int(place[-1]), last.slice(len(g) - 1)


def _walked(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column) -> tuple[DataFrame, list]:
    """(rows walked, per range: its first and last group, rows of the last one here, last value)."""
    src = df.withColumns({"__value": value, "__g": F.xxhash64(*group) if group else F.lit(0).cast("long")})
    by = [*[F.col(c) for c in group], *order]
    ranged = src.repartitionByRange(*by).sortWithinPartitions(*by)
    more = [(_PID, T.IntegerType()), ("__n", T.LongType()), ("__place", T.LongType()), ("__last", src.schema["__value"].dataType), ("__opens", T.BooleanType())]
    walked = cut(map_arrow(ranged, _walk, T.StructType([*ranged.schema.fields, *(T.StructField(n, t) for n, t in more)])).drop("__value"))
    ends = walked.groupBy(_PID).agg(
        F.min_by("__g", "__n").alias("first"), F.max_by(F.struct(F.col("__g").alias("g"), F.col("__place").alias("n"), F.col("__last").alias("v")), "__n").alias("end"),
    ).collect()  # a row per range
    return walked, sorted(ends, key=lambda r: r[_PID])


def group_ordinal(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """``df`` with each row's place (from 1) within its group; a group of any size is spread over ranges."""
    walked, ends = _walked(df, group, order, F.lit(None).cast("int"))
    carries, held, rows = [], None, 0
    for r in ends:
        before = rows if held == r["first"] else 0
        carries.append((r[_PID], before))
        held, rows = r["end"]["g"], r["end"]["n"] + (before if r["end"]["g"] == r["first"] else 0)
    carried = df.sparkSession.createDataFrame(carries, f"{_PID} int, __carry bigint")
    place = F.col("__place") + F.when(F.col("__opens"), F.col("__carry")).otherwise(0)
    return walked.join(F.broadcast(carried), _PID).select(*df.columns, place.alias(name))


def last_before(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` up to the row, within ``group``, by ``order``.

    A group of any size is spread over the ranges it covers.
    """
    walked, ends = _walked(df, group, order, value)
    carries, held, held_group = [], None, None
    for r in ends:
        carries.append((r[_PID], held if held_group == r["first"] else None))
        own = r["end"]["v"]
        if own is None and r["first"] == r["end"]["g"] and held_group == r["first"]:
            own = held
        held, held_group = own, r["end"]["g"]
    kind = T.StructType([T.StructField(_PID, T.IntegerType()), T.StructField("__carry", walked.schema["__last"].dataType)])
    carried = df.sparkSession.createDataFrame(carries, kind)
    out = F.coalesce("__last", F.when(F.col("__opens"), F.col("__carry")))
    return walked.join(F.broadcast(carried), _PID).select(*df.columns, out.alias(name))


#: How ``seek`` compares: (from above, equal keys count).
SEEKS = {"floor": (False, True), "lower": (False, False), "ceiling": (True, True), "higher": (True, False)}


def seek(keys: DataFrame, probes: DataFrame, how: str, key: str = "key", probe: str = "probe") -> DataFrame:
    """(probe, found): for each row of ``probes`` the nearest key, null if there is none.

    ``how``: 'floor' the greatest <=, 'lower' the greatest <, 'ceiling' the
    smallest >=, 'higher' the smallest >.  Null keys count as absent.
    """
    above, equal = SEEKS[how]
    k = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("at"), F.lit(0 if equal else 1).alias("kind"), F.lit(True).alias("is_key"))
    p = probes.select(F.col(probe).alias("at"), F.lit(1 if equal else 0).alias("kind"), F.lit(False).alias("is_key"))
    order = [F.col("at").desc() if above else F.col("at"), F.col("kind")]
    got = last_before(k.unionByName(p), [], order, F.when(F.col("is_key"), F.col("at")), "found")
    return got.where("not is_key").select(F.col("at").alias(probe), F.when(F.col("at").isNotNull(), F.col("found")).alias("found"))


def floor_keys(keys: DataFrame, probes: DataFrame, key: str = "key", probe: str = "probe") -> DataFrame:
    """(probe, found): the greatest key <= each probe, null if there is none."""
    return seek(keys, probes, "floor", key, probe)


def neighbours(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, previous, next): each distinct key with the one before it and the one behind it."""
    k = keys.select(F.col(key).alias("key")).where("key is not null").distinct()
    # in one walk: the one before; the one behind is the reverse of it
    before = seek(k, k, "lower", "key", "key").withColumnRenamed("found", "previous")
    behind = before.where("previous is not null").select(F.col("previous").alias("key"), F.col("key").alias("next"))
    return before.join(behind, "key", "left").select(F.col("key").alias(key), "previous", "next")


def asof(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, value: Sequence[str]) -> DataFrame:
    """``left`` with ``value`` columns of the last row of ``right`` of equal ``on`` and ``at`` <= its own.

    Rows of ``right`` at the same place count as before; no such row: nulls.
    """
    r = right.select(*on, at, F.lit(0).alias("__kind"), F.struct(*value).alias("__r"))
    cols = [c for c in left.columns if c not in (*on, at)]
    l_ = left.select(*on, at, F.lit(1).alias("__kind"), F.struct(*cols).alias("__l"))
    both = r.withColumn("__l", F.lit(None).cast(l_.schema["__l"].dataType)).unionByName(l_.withColumn("__r", F.lit(None).cast(r.schema["__r"].dataType)))
    got = last_before(both, list(on), [F.col(at), F.col("__kind")], F.col("__r"), "__got").where("__kind = 1")
    return got.select(*on, at, "__l.*", *[F.col(f"__got.`{c}`").alias(c) for c in value])
