"""A few keys holding most records (dense accumulator arrays).

Every input split, of equal size whatever its keys, is reduced where it is
read: keys are dictionary-encoded, the codes index dense numpy arrays, and the
rows are scattered into them: ``bincount`` for counts, a rank-limited scatter
for "the first k different values by order".  What leaves a split is at most
``k`` entries per key, so a key holding a third of all rows costs a reducer no
more than k entries per split.  The array blocks are then summed by the same
code, one shuffle later, in key order, so that a task holds the accumulators of
one chunk of keys at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import map_arrow

#: Rows gathered before they are scattered; bounds a task's memory.
CHUNK_ROWS = 1 << 18
#: Rows between the passes; Spark's batches may differ in what they declare nullable.
ROWS = pa.schema([("key", pa.string()), ("item", pa.string()), ("seq", pa.int64()), ("n", pa.int64())])


def _reduce(table: pa.Table, k: int) -> pa.Table:
    """(key, item, seq, n) reduced to the first k different items of each key; n is summed."""
    if not table.num_rows:
        return table
    key = pc.dictionary_encode(table["key"]).combine_chunks()
    item = pc.dictionary_encode(table["item"]).combine_chunks()
    if isinstance(key, pa.ChunkedArray):
        key, item = key.chunk(0), item.chunk(0)
    kc = key.indices.to_numpy().astype(np.int64)
    n_keys, words = len(key.dictionary), item.dictionary
    ic = item.indices.to_numpy(zero_copy_only=False)
    ic = np.where(np.isnan(ic), len(words), ic).astype(np.int64) if ic.dtype.kind == "f" else ic.astype(np.int64)
    rank = np.empty(len(words) + 1, np.int64)  # order of items as bytes, for equal seq
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    rank[len(words)] = len(words)
    seq = table["seq"].combine_chunks().to_numpy(zero_copy_only=False)
    counts = np.bincount(kc, weights=table["n"].to_numpy(), minlength=n_keys).astype(np.int64)
    # dense blocks [n_keys, k], filled place by place: two scatter-minima find each key's smallest seq and, at that, its smallest item
    none = len(words) + 1
    seqs, items = np.zeros((n_keys, k), np.int64), np.full((n_keys, k), none, np.int64)
    left, order = np.arange(len(kc)), rank[ic]
    for place in range(k):
        low = np.full(n_keys, np.iinfo(np.int64).max)
        np.minimum.at(low, kc[left], seq[left])
        lowest = left[seq[left] == low[kc[left]]]
        best = np.full(n_keys, none, np.int64)
        np.minimum.at(best, kc[lowest], order[lowest])
        seqs[:, place], items[:, place] = low, best
        left = left[order[left] != best[kc[left]]]  # an item counts once
        if not len(left):
            break
    filled = np.flatnonzero(items.ravel() < none)
    n = np.zeros((n_keys, k), np.int64)
    n[:, 0] = counts
    word_of = np.empty(len(words) + 1, np.int64)
    word_of[rank] = np.arange(len(words) + 1)
    word = word_of[items.ravel()[filled]]
    out = pa.table({
        "key": key.dictionary.take(pa.array(filled // k)), "item": words.take(pa.array(word, mask=word == len(words))),
        "seq": pa.array(seqs.ravel()[filled]), "n": pa.array(n.ravel()[filled]),
    })
    return out.cast(ROWS)


def _table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches).cast(ROWS).combine_chunks()


def _merge_splits(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        kept: pa.Table | None = None
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                parts = [_table(held)] + ([kept] if kept is not None else [])
                kept = _reduce(pa.concat_tables(parts), k)
                held, rows = [], 0
                if kept.num_rows > CHUNK_ROWS // 2:  # many keys: partial blocks may leave at any time
                    yield from kept.to_batches()
                    kept = None
        parts = ([_table(held)] if held else []) + ([kept] if kept is not None else [])
        if parts:
            yield from _reduce(pa.concat_tables(parts), k).to_batches()

    return run


def _sum_blocks(k: int):
    """The same reduction over rows sorted by key: whole keys leave, the last key waits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_table([batch]))
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                table = _reduce(pa.concat_tables(held), k)
                last = table["key"][table.num_rows - 1]
                open_ = pc.equal(table["key"], last)
                yield from table.filter(pc.invert(open_)).to_batches()
                held = [table.filter(open_)]
                rows = held[0].num_rows
        if held:
            yield from _reduce(pa.concat_tables(held), k).to_batches()

    return run


def first_k(rows: DataFrame, *, key: str, item: str, seq: str, k: int) -> DataFrame:
    """Per key its first ``k`` different items by ``seq`` and its number of rows.

    Result: key, item, seq (the item's smallest), place (1..k), n_rows (of the
    key, repeated on each of its rows).

    Key and item count without spaces around them.  Defined cases: a null or
    blank key or item or a null seq: the row does not count; equal seq: items
    in byte order; repeated rows: one item, each row counted in ``n_rows``; a
    key with fewer than k items keeps them all; an empty table gives no rows.
    """
    if k < 1:
        raise ValueError("k must be positive")
    schema = "key string, item string, seq bigint, n bigint"
    src = rows.select(
        F.trim(F.col(f"`{key}`")).alias("key"), F.trim(F.col(f"`{item}`")).alias("item"),
        F.col(f"`{seq}`").cast("long").alias("seq"), F.lit(1).cast("long").alias("n"),
    ).where("length(key) > 0 and length(item) > 0 and seq is not null")
    blocks = map_arrow(src, _merge_splits(k), schema)
    by_key = blocks.repartition("key").sortWithinPartitions("key")
    summed = map_arrow(by_key, _place_rows(k), schema + ", place int, n_rows bigint")
    return summed.select(
        F.col("key").alias(key), F.col("item").alias(item), F.col("seq").alias(seq), "place", "n_rows",
    )


def _place_rows(k: int):
    sums = _sum_blocks(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sums(batches):
            if not batch.num_rows:
                continue
            # rows of a key are adjacent, its first carries the count
            n = batch.column(batch.schema.get_field_index("n")).to_numpy()
            heads = np.flatnonzero(n > 0)
            length = np.diff(np.r_[heads, len(n)])
            place = np.arange(len(n)) - np.repeat(heads, length) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place.astype(np.int32)), pa.array(np.repeat(n[heads], length))],
                names=[*batch.schema.names, "place", "n_rows"],
            )

    return run
