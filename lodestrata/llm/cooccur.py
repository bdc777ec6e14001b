"""Items that appear together (basket collapsing).

Identical baskets (sorted sets) are collapsed into one with a weight, so a
basket that a third of all records share is enumerated once.  Items that can
be in no reported pair are left out before pairs are made, without losing one:

* n_ab is at most n_a, so an item in fewer than ``min_count`` baskets;
* the lift of a pair is at most n / max(n_a, n_b), so an item in more than
  n / min_lift baskets.

The items kept are numbered in their own order, and a pair is one 64-bit
number.  Pairs of the distinct baskets are made in numpy, all baskets of one
length at a time, and their weights are summed per task before the shuffle.
A long basket is cut into blocks of ``block`` items whose block pairs are
spread over the cluster, so no task enumerates a long basket alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.ordered import with_ordinal
from lodestrata.operators.skew import lookup_join
from lodestrata.session import cut, map_arrow, scratch

#: Kept items whose hashes are handed to every task (8 bytes each); more are joined.
CODED_ITEMS = 2_000_000
#: Pairs a task sums before it lets them go.
PAIRS = 1 << 21


def collapse(baskets: DataFrame, items: str) -> DataFrame:
    """(items, weight): each distinct non-empty basket once."""
    return baskets.where(F.size(items) > 0).groupBy(F.col(items).alias("items")).agg(F.count(F.lit(1)).alias("weight"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), ends - ends[0]


def _encode(hashes_bc, codes_bc):
    """(codes, weight) from (hashes, weight): the numbers of the kept items of each basket, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes = hashes_bc.value, codes_bc.value
        for batch in batches:
            values, ends = _lists(batch.column(0))
            at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
            kept = known[at] == values if len(known) else np.zeros(len(values), bool)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))[kept]
            code = codes[at[kept]]
            order = np.lexsort((code, owner))
            size = np.bincount(owner, minlength=batch.num_rows)
            rows = np.flatnonzero(size > 1)
            code = code[order][np.repeat(size > 1, size)]
            offsets = np.r_[0, np.cumsum(size[rows])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(code)), batch.column(1).take(pa.array(rows))], names=["codes", "weight"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) from (x, y, same, weight): pairs of x with y, of x with itself where ``same``, weights summed."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def total() -> tuple[np.ndarray, np.ndarray]:
        pair, weight = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.argsort(pair, kind="stable")
        pair, weight = pair[order], weight[order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, np.int64)
        return pair[first], np.add.reduceat(weight, first) if len(first) else weight

    for batch in batches:
        (x, x_ends), (y, y_ends) = _lists(batch.column(0)), _lists(batch.column(1))
        same, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        nx, ny = np.diff(x_ends), np.where(same, 0, np.diff(y_ends))
        shape = nx * (1 << 32) + ny
        for s in np.unique(shape).tolist():
            a, b = s >> 32, s & 0xFFFFFFFF
            at = np.flatnonzero(shape == s)
            i, j = np.triu_indices(a, 1) if not b else (g.ravel() for g in np.indices((a, b)))
            step = max(1, PAIRS // max(len(i), 1))
            for k in range(0, len(at), step):
                part = at[k:k + step]
                left = x[x_ends[part][:, None] + i]
                right = x[x_ends[part][:, None] + j] if not b else y[y_ends[part][:, None] + j]
                held.append(((left << 32 | right).ravel(), np.repeat(weight[part], len(i))))
                waiting += left.size
                if waiting >= PAIRS:
                    held = [total()]
                    waiting = len(held[0][0])
                    if waiting > PAIRS // 2:  # few repeats: let them go
                        yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], names=["pair", "n"])
                        held, waiting = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([*map(pa.array, total())], names=["pair", "n"])


def _blocks(coded: DataFrame, block: int) -> DataFrame:
    """(x, y, same, weight) whose pairs are those of every basket once."""
    short = coded.where(F.size("codes") <= block).select(F.col("codes").alias("x"), F.array().cast("array<bigint>").alias("y"), F.lit(True).alias("same"), "weight")
    long = coded.where(F.size("codes") > block)
    if long.isEmpty():
        return short
    piece = lambda i: F.slice("codes", F.col(i) * block + 1, F.lit(block))
    cutup = (
        long.select("*", F.ceil(F.size("codes") / F.lit(block)).cast("int").alias("nb"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bi"))
        .select("*", F.explode(F.sequence(F.col("bi"), F.col("nb") - 1)).alias("bj"))
        .select(piece("bi").alias("x"), piece("bj").alias("y"), (F.col("bi") == F.col("bj")).alias("same"), "weight")
    )
    return short.unionByName(cutup.repartition(F.xxhash64("x"), F.xxhash64("y")))


def _d(c: str) -> Column:
    return F.col(c).cast("decimal(12,0)")


def together(baskets: DataFrame, items: str, *, min_count: int, min_lift: str = "1", block: int = 256) -> DataFrame:
    """Pairs of items with their joint count and how much it exceeds chance.

    ``baskets``: one row per record, ``items`` a sorted array without repeats.
    Result: a, b (a < b), n_ab, n_a, n_b, n, lift = n_ab*n/(n_a*n_b) and
    conviction of a -> b, (1 - n_b/n) / (1 - n_ab/n_a), null where b is in each
    basket that holds a.  Pairs have n_ab >= min_count and lift >= min_lift,
    compared exactly (decimal arithmetic).

    Defined cases: null and empty baskets do not count, in n neither; a basket
    of one item counts in n and n_a; no baskets: no rows.
    """
    limit = Decimal(min_lift)
    spark = baskets.sparkSession
    path = scratch(spark, "baskets")
    collapse(baskets, items).withColumn("basket", F.monotonically_increasing_id()).write.parquet(f"{path}/collapsed")
    collapsed = spark.read.parquet(f"{path}/collapsed")
    n = collapsed.agg(F.sum("weight")).first()[0] or 0
    counts = collapsed.select("weight", F.explode("items").alias("item")).groupBy("item").agg(F.sum("weight").alias("n_item"))
    counts = counts.where((F.col("n_item") >= min_count) & (F.col("n_item").cast("decimal(12,0)") * F.lit(limit) <= F.lit(n)))
    kept = with_ordinal(counts, ["item"], "code").withColumn("h", F.xxhash64("item"))  # written by with_ordinal
    size, different = kept.agg(F.count(F.lit(1)), F.count_distinct("h")).first()
    if size <= CODED_ITEMS and size == different:
        rows = kept.select("h", "code").toPandas()  # at most 16 bytes for each of CODED_ITEMS
        order = np.argsort(rows["h"].to_numpy())
        known, codes = (spark.sparkContext.broadcast(rows[c].to_numpy()[order]) for c in ("h", "code"))
        hashed = collapsed.where(F.size("items") > 1).select(F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"), "weight")
        coded = map_arrow(hashed, _encode(known, codes), "codes array<bigint>, weight bigint")
    else:
        apart = collapsed.where(F.size("items") > 1).select("basket", "weight", F.explode("items").alias("item"))
        apart = lookup_join(apart, kept.select("item", "code"), "item", salt_on=["basket"])
        coded = apart.groupBy("basket").agg(F.array_sort(F.collect_list("code")).alias("codes"), F.first("weight").alias("weight")).where(F.size("codes") > 1)
        coded = cut(coded.select("codes", "weight"))
    pairs = map_arrow(_blocks(coded, block), _summed, "pair bigint, n bigint")
    pairs = pairs.groupBy("pair").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_count)
    out = pairs.select(F.shiftright("pair", 32).alias("ca"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("cb"), "n_ab")
    for x in ("a", "b"):
        out = lookup_join(out, kept.select(F.col("code").alias(f"c{x}"), F.col("item").alias(x), F.col("n_item").alias(f"n_{x}")), f"c{x}", salts=4)
    out = out.withColumn("n", F.lit(n).cast("long")).where(_d("n_ab") * _d("n") >= _d("n_a") * _d("n_b") * F.lit(limit))
    x = {c: F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n")}
    return out.select(
        "a", "b", "n_ab", "n_a", "n_b", "n",
        (x["n_ab"] * x["n"] / (x["n_a"] * x["n_b"])).alias("lift"),
        F.try_divide(1 - x["n_b"] / x["n"], 1 - x["n_ab"] / x["n_a"]).alias("conviction"),
    )
