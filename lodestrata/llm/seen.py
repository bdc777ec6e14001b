"""Has this key been seen before? (ribbon filters over sealed batches)

1. Rows become two 64-bit hashes of the key and their place; the keys
   themselves are left behind.
2. Crowded keys, those with more rows than a shard should take alone, are found
   with a bounded summary.  Of such a key's rows in one window of the order all
   but the first are repeats, and only the first goes on.  No other key is grouped.
3. Rows are spread over shards by hash, as many shards as the count of rows
   asks for, and read in order.  A shard keeps no keys: it asks the generations
   of sealed ribbon filters and the open batch, then adds the new keys
   (``Generations``).  A filter misses no key, so every row it denies is a
   first occurrence for certain.
4. Exact check of the positives: a key of which some row is positive and none
   was denied has no certain first occurrence, so its earliest positive was a
   wrong answer and is withdrawn.  Keys are compared by both hashes; two of
   10**10 keys agree in all 128 bits with a probability of about 1e-19.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.skew import lookup_join
from lodestrata.session import cut, map_arrow, scratch

#: Rows a shard takes; the filters of so many keys are some 3 MB.
SHARD_ROWS = 1 << 20
#: Rows of one key from which it counts as crowded; at most so many such keys are kept.
CROWDED_ROWS, CROWDED_KEYS = 1 << 16, 256
_LAST = (1 << 63) - 1


def _probe_shard(bits: int, seal: int, seal_most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Generations(bits=bits, seal=seal, seal_most=seal_most)
        before, how_before, shard = None, NEW, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, at = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "at"))
            audit = at == _LAST
            # rows of one key at one place get one answer
            same = np.r_[before == (h1[0], h2[0], at[0]), (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & (at[1:] == at[:-1])]
            head = np.flatnonzero(~same & ~audit)
            how = np.zeros(len(h1), np.int8)
            how[head] = known.add(h1[head].view(np.uint64), h2[head].view(np.uint64))
            if audit.any():
                known.seal()
                asked = np.flatnonzero(audit)
                how[asked] = known.probe(h1[asked].view(np.uint64), h2[asked].view(np.uint64))
            group = np.maximum.accumulate(np.where(same, -1, np.arange(len(h1))))
            how = np.where(group < 0, how_before, how[group])
            before, how_before = (h1[-1], h2[-1], at[-1]), how[-1]
            extra = (how.astype(np.int8), np.full(len(h1), shard, np.int32), np.full(len(h1), len(known.sealed), np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, extra)], names=[*batch.schema.names, "how", "shard", "filters"])

    from lodestrata.llm.ribbon import NEW, Generations

    return run


class _Asked:
    """Rows as the filters answered them, in the shared folder."""

    def __init__(self, rows: DataFrame, key: str, order: str, *, window: int = 1 << 13, audit_keys: int = 0, bits: int = 16, seal: int = 1 << 10,
                 seal_most: int = 1 << 20):
        spark = rows.sparkSession
        k = F.col("key")
        src = rows.select(F.col(f"`{key}`").cast("binary").alias("key"), F.col(f"`{order}`").cast("long").alias("at")).where("octet_length(key) > 0 and at is not null")
        hashed = src.select(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7919), k).alias("h2"), "at")
        # one pass; the summary of the most frequent hashes has a bounded size
        summary = F.expr(f"approx_top_k(h1, {CROWDED_KEYS}, {64 * CROWDED_KEYS})")
        n, top = hashed.agg(F.count(F.lit(1)), summary).first()
        shards = max(-(-n // SHARD_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // (SHARD_ROWS >> 5))), 1)
        least = max(CROWDED_ROWS, n // (4 * shards))
        crowded = [r["item"] for r in top or [] if r["count"] >= least]
        self.repeats = None
        asked = hashed
        if crowded:
            asked = hashed.where(~F.col("h1").isin(crowded))
            held = hashed.where(F.col("h1").isin(crowded)).groupBy("h1", "h2", F.floor(F.col("at") / F.lit(window)).alias("win"))
            held = held.agg(F.min("at").alias("first"), F.collect_list("at").alias("ats"))  # at most a window's rows
            same = lambda x: x == F.col("first")
            asked = asked.unionByName(held.select("h1", "h2", F.explode(F.filter("ats", same)).alias("at")))
            self.repeats = held.select(F.explode(F.filter("ats", lambda x: x > F.col("first"))).alias("at"))
        if audit_keys:
            # longer than any key of the data, hence certainly absent
            longest = src.agg(F.max(F.octet_length("key"))).first()[0] or 0
            absent = F.concat(F.lit(b"\xff" * (longest + 1)), F.col("id").cast("string").cast("binary"))
            asked = asked.unionByName(spark.range(audit_keys).select(F.xxhash64(absent).alias("h1"), F.xxhash64(F.lit(7919), absent).alias("h2"), F.lit(_LAST).alias("at")))
        sharded = asked.repartition(shards, "h1").sortWithinPartitions("at", "h1", "h2")
        path = scratch(spark, "seen")
        map_arrow(sharded, _probe_shard(bits, seal, seal_most), "h1 bigint, h2 bigint, at bigint, how tinyint, shard int, filters int").write.parquet(path)
        self.all = spark.read.parquet(path)
        self.answers = self.all.where(F.col("at") < _LAST) if audit_keys else self.all
        positive = self.answers.where("how > 0").groupBy("h1", "h2").agg(F.min("at").alias("at"))
        denied = self.answers.where("how = 0").select("h1", "h2")
        self.withdrawn = cut(positive.join(denied, ["h1", "h2"], "left_anti"))  # wrong answers: few, read more than once

    def cases(self) -> DataFrame:
        wrong = self.withdrawn.groupBy("at").agg(F.collect_list(F.struct("h1", "h2")).alias("wrong"))
        found = lookup_join(self.answers.where("how > 0"), wrong, "at", how="left", salts=1)
        return found.where(~F.coalesce(F.array_contains("wrong", F.struct("h1", "h2")), F.lit(False))).select("at", "how")


def seen_before(rows: DataFrame, *, key: str, order: str, **options) -> DataFrame:
    """The ``order`` values of the rows whose key, byte for byte, has a row placed earlier.

    ``window``: span of ``order`` in which rows of a crowded key are gathered;
    ``bits``: fingerprint bits; ``seal`` and ``seal_most``: keys of the first
    and of the largest sealed batch.

    Defined cases: null and empty keys and rows without a place are no cases;
    rows of one key at the same place do not precede each other; a repeated
    row is reported as often as it is there; a place must be below 2**63 - 1;
    an empty table gives no rows; further columns are ignored.
    """
    asked = _Asked(rows, key, order, **options)
    found = asked.cases().select(F.col("at").alias(order))
    return found if asked.repeats is None else found.unionByName(asked.repeats.select(F.col("at").alias(order)))


def error_rate(rows: DataFrame, *, key: str, order: str, audit_keys: int = 1 << 20, **options) -> DataFrame:
    """Rate of wrong answers, measured twice. One row; rates are null where nothing was asked.

    On the data: positives that the exact check withdrew, of all keys that were
    new.  By audit: keys certainly absent (longer than any key of the data),
    asked of the filters after the last batch is sealed.  ``n_filters`` sealed
    filters answered; of the ``n_positive`` answers ``n_by_filter`` are
    theirs, the others come from batches that were still open.
    """
    asked = _Asked(rows, key, order, audit_keys=audit_keys, **options)
    audit, positive = F.col("at") == _LAST, F.col("how") > 0
    shard = asked.all.groupBy("shard").agg(F.max("filters").alias("filters"))
    one = asked.all.agg(
        F.count_if(~audit).alias("n_asked"), F.count_if(~audit & positive).alias("n_positive"), F.count_if(~audit & (F.col("how") == 2)).alias("n_by_filter"),
        F.count_if(audit).alias("n_audit"), F.count_if(audit & positive).alias("n_audit_wrong"),
    )
    wrong = asked.withdrawn.agg(F.count(F.lit(1)).alias("n_wrong"))
    out = one.join(F.broadcast(wrong)).join(F.broadcast(shard.agg(F.coalesce(F.sum("filters"), F.lit(0)).alias("n_filters"))))  # one row each
    return out.select(
        "n_asked", "n_positive", "n_by_filter", "n_filters", "n_wrong", "n_audit", "n_audit_wrong",
        F.try_divide(F.col("n_wrong").cast("double"), F.col("n_asked") - F.col("n_positive") + F.col("n_wrong")).alias("wrong_rate"),
        F.try_divide(F.col("n_audit_wrong").cast("double"), F.col("n_audit")).alias("audit_rate"),
    )
