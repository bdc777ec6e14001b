"""All similar pairs between set-valued records (banded minwise signatures).

1. Equal sets are one class; only distinct sets are numbered, signed and compared.
2. Each set gets ``bands`` keys of ``rows`` minwise hashes.  At similarity s
   two sets share no key with probability (1 - s**rows)**bands; with 14 bands of
   2 that is 8e-5 at the threshold 0.7 and falls steeply above it.
3. Only (key, number) is shuffled.  Keys held by one set end there; the sets of
   any other key are candidates.
4. A key shared by more than ``crowded`` sets (they hold the same few popular
   ids) is split exactly: with popular ids last in a common order, two sets of
   similarity >= t share k of the first |A| - ceil(t|A|) + k ids.  So the sets of
   a crowded key meet again by (key, one such id), those of a part that is still
   crowded by (key, two such ids), and what then remains is dealt into blocks
   that meet pairwise.  No pair is lost or capped.  Keys that hold a large share
   of all sets are found by a summary of bounded size and split before they meet in one task.
5. Each set has a 128-bit map of its ids.  Bits of one map missing in the
   other are ids missing there, which bounds the similarity from above; the
   candidates left by that bound are verified on the sets themselves.
6. ``similar_classes`` gives the links between classes and the members of each;
   ``similar_pairs`` expands them, members of a large class dealt over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.skew import fits, lookup_join
from lodestrata.session import cut, map_arrow, scratch

#: Members of a class in one block of the expansion, and sets of a key in one block.
BLOCK = 1024
#: Ids put last in the prefix order; the most frequent ones, a bounded list.
POPULAR = 4096
#: Keys with so many sets are split before they meet; at most so many such keys are named.
HUGE_ROWS, HUGE_KEYS = 1 << 17, 1024
#: Sets whose maps (28 bytes each) are handed to every task, so that it drops pairs where they arise; beyond, the maps are joined.
MAPPED_SETS = 3_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _sign(bands: int, rows: int, threshold: float, popular: dict[int, int], seed: int = 7):
    rng = np.random.default_rng(seed)
    mult = rng.integers(1 << 40, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.array(sorted(popular), np.int64)
        hot_rank = np.array([popular[h] for h in hot.tolist()], np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            arrays = batch.column(batch.schema.get_field_index("hashes"))
            values = arrays.flatten().to_numpy(zero_copy_only=False)
            ends = arrays.offsets.to_numpy()
            ends = (ends - ends[0]).astype(np.int64)
            starts, sizes = ends[:-1], np.diff(ends)
            base = values.view(np.uint64)
            salt = batch.column(batch.schema.get_field_index("f")).to_numpy().astype(np.uint64)
            keys = np.empty((n, bands), np.uint64)
            with np.errstate(over="ignore"):
                for b in range(bands):
                    key = salt * np.uint64(1_000_003) + np.uint64(b)
                    for r in range(rows):
                        i = b * rows + r
                        low = np.minimum.reduceat(_mixed(base * mult[i] + add[i]), starts)
                        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + low)
                    keys[:, b] = key
            # prefix of two more than needed for one common id: unpopular ids first, in hash order; the most popular last
            if len(hot):
                at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
                rank = np.where(hot[at] == values, hot_rank[at], -1)
            else:
                rank = np.full(len(values), -1)
            owner = np.repeat(np.arange(n), sizes)
            order = np.lexsort((values, rank, owner))
            least = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
            prefix = np.minimum(sizes - least + 2, sizes)
            place = np.arange(len(values)) - np.repeat(starts, sizes)
            taken = order[place < np.repeat(prefix, sizes)]
            pre_ends = np.r_[0, np.cumsum(prefix)].astype(np.int32)
            bit = _mixed(base)
            one, high = np.uint64(1) << (bit & np.uint64(63)), (bit >> np.uint64(6) & np.uint64(1)).astype(bool)
            low_map, high_map = (np.bitwise_or.reduceat(np.where(m, one, np.uint64(0)), starts).view(np.int64) for m in (~high, high))
            keep = [i for i, c in enumerate(batch.schema.names) if c != "hashes"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in keep),
                    pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), pa.array(keys.view(np.int64).ravel())),
                    pa.ListArray.from_arrays(pre_ends, pa.array(values[taken])), pa.array((sizes - least + 1).astype(np.int32)),
                    pa.array(low_map), pa.array(high_map),
                ],
                names=[*(batch.schema.names[i] for i in keep), "keys", "prefix", "n_prefix", "m0", "m1"],
            )

    return run


def _split(depth: int):
    """(key, num) from (key, num, prefix, n_prefix): a key for each ``depth`` ids of the prefix.

    Similar sets share at least ceil(t|A|) ids.  Where that is one, two ids need
    not be shared; such sets are small, and meet each other once more by the old key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, num = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(2)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            n = batch.column(3).to_numpy(zero_copy_only=False)
            starts, small = ends[:-1], np.flatnonzero(n == np.diff(ends))
            if depth > 1 and len(small):
                yield pa.RecordBatch.from_arrays([pa.array((~key[small])), pa.array(num[small])], names=["key", "num"])
            n = np.minimum(n + depth - 1, np.diff(ends))
            for size in np.unique(n).tolist():
                at = np.flatnonzero(n == size)
                chosen = np.array(list(combinations(range(size), depth)), np.int64).reshape(-1, depth)
                if not len(chosen):
                    continue
                part = np.sort(values[starts[at][:, None, None] + chosen[None]], axis=2)
                out = np.repeat(key[at].view(np.uint64), len(chosen)).reshape(len(at), -1)
                with np.errstate(over="ignore"):
                    for d in range(depth):
                        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + part[:, :, d])
                yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64).ravel()), pa.array(np.repeat(num[at], len(chosen)))], names=["key", "num"])

    return run


@dataclass(frozen=True)
class _Maps:
    """Number, field, size and map of every set, by number."""

    num: np.ndarray
    f: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def near(self, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        """Whether sets (by their place here) may be similar: ids missing in the other, as the maps show, bound what they share."""
        missing = lambda x, y: sum(np.bitwise_count(m[x] & ~m[y]).astype(np.int32) for m in (self.low, self.high))
        most = np.minimum(self.n[i] - missing(i, j), self.n[j] - missing(j, i))
        return (self.f[i] == self.f[j]) & (most >= threshold * (self.n[i] + self.n[j] - most) - 1e-9)


def _meet(crowded: int, threshold: float, maps):
    """Rows sorted by key: the pairs of each key's sets as (a, b), those that ``maps`` rules out left away; of a crowded key its rows as (a, null, key)."""

    def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
        columns = [pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        over: list[int] = []  # the crowded key whose rows still come
        for batch in batches:
            key, num = (np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in zip((0, 1), held, strict=True))
            if len(key):
                # the last key may go on in the next batch
                end = int(np.searchsorted(key, key[-1]))
                before = over
                if key[-1] in over or len(key) - end > crowded:
                    over, end = [key[-1]], len(key)
                held = (key[end:], num[end:])
                yield from _pairs(key[:end], num[:end], before + over)
        yield from _pairs(*held, over)

    def _pairs(key: np.ndarray, num: np.ndarray, over: list[int]) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        many = (size > crowded) | np.isin(key[start], over)
        rows = np.flatnonzero(np.repeat(many, size))
        if len(rows):
            yield out(num[rows], None, key[rows])
        # the sets' places among the maps are looked up once, not for each pair
        place = np.searchsorted(maps.value.num, num) if maps is not None else None
        for s in np.unique(size[~many & (size > 1)]).tolist():
            at = start[~many & (size == s)]
            i, j = np.triu_indices(s, 1)
            step = max(1, (1 << 20) // len(i))
            for a in range(0, len(at), step):
                one, other = ((at[a:a + step, None] + k).ravel() for k in (i, j))
                if maps is not None:
                    near = maps.value.near(place[one], place[other], threshold)
                    one, other = one[near], other[near]
                x, y = np.minimum(num[one], num[other]), np.maximum(num[one], num[other])
                yield out(x[x < y], y[x < y], None)

    return run


def _signed(sets: DataFrame, path: str, bands: int, rows: int, threshold: float) -> DataFrame:
    """The sets with signature, prefix and map, written below ``path``."""
    h = sets.select(F.explode("items").alias("x")).select(F.xxhash64("x").alias("h"))
    top = h.agg(F.expr(f"approx_top_k(h, {POPULAR}, {16 * POPULAR})")).first()[0] or []  # most frequent first; the order decides nothing but speed
    popular = {r["item"]: i for i, r in enumerate(reversed(top))}
    hashed = sets.select("num", "f", F.size("items").alias("n"), F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"))
    schema = "num bigint, f int, n int, keys array<bigint>, prefix array<bigint>, n_prefix int, m0 bigint, m1 bigint"
    map_arrow(hashed, _sign(bands, rows, threshold, popular), schema).write.parquet(f"{path}/signed")
    return sets.sparkSession.read.parquet(f"{path}/signed")


def _candidates(signed: DataFrame, path: str, crowded: int, threshold: float, maps) -> DataFrame:
    """Pairs of numbers (a, b) that may be similar; a pair may come more than once."""
    spark = signed.sparkSession
    keyed = signed.select(F.explode("keys").alias("key"), "num")
    n, top = keyed.agg(F.count(F.lit(1)), F.expr(f"approx_top_k(key, {HUGE_KEYS}, {16 * HUGE_KEYS})")).first()
    huge = [r["item"] for r in top or [] if r["count"] >= max(HUGE_ROWS, crowded + 1)]
    prefix = signed.select(F.col("num"), "prefix", "n_prefix")
    found, names = None, []
    rows, waiting = keyed, None
    if huge:
        rows, waiting = keyed.where(~F.col("key").isin(huge)), keyed.where(F.col("key").isin(huge))
    for depth in (1, 2, 3):
        met = map_arrow(rows.select("key", "num").repartition("key").sortWithinPartitions("key"), _meet(crowded, threshold, maps), "a bigint, b bigint, key bigint")
        names.append(f"{path}/met{depth}")
        met.write.parquet(names[-1])
        met = spark.read.schema(met.schema).parquet(names[-1])
        found = spark.read.schema(met.schema).parquet(*names).where("b is not null").select("a", "b")
        again = met.where("b is null").select("key", F.col("a").alias("num"))
        if waiting is not None:
            again, waiting = again.unionByName(waiting), None
        if again.isEmpty():
            return found
        if depth == 3:
            break
        joined = again.join(prefix, "num").select("key", "num", "prefix", "n_prefix")
        rows = map_arrow(joined, _split(depth), "key bigint, num bigint")
    # what shares a key and two rare ids, and still is crowded: blocks that meet pairwise
    size = again.groupBy("key").count().select("key", F.ceil(F.col("count") / F.lit(BLOCK)).cast("int").alias("k"))
    dealt = lookup_join(again, size, "key", salt_on=["num"]).withColumn("block", F.pmod(F.xxhash64("num"), F.col("k")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    x = dealt.select("key", F.col("num").alias("a"), F.col("block").alias("x"), every.alias("y"))
    y = dealt.select("key", F.col("num").alias("b"), F.col("block").alias("y"), every.alias("x"))
    return found.unionByName(x.join(y, ["key", "x", "y"]).where("a < b").select("a", "b"))


def _classes(
    records: DataFrame, id: str, fields: tuple[str, ...], threshold: float, least: int, bands: int, rows: int, crowded: int,
) -> tuple[DataFrame, DataFrame]:
    """(members (num, f, id) of each class, links (a, b) between different classes); a class is named by the number of one of its rows."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = records.sparkSession
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"`{c}`").alias("items")) for i, c in enumerate(fields)])).alias("s")
    src = records.where(F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").alias("id"), one).select("id", "s.*")
    src = src.where(F.size("items") >= max(1, least)).withColumn("items", F.sort_array("items"))
    path = scratch(spark, "sets")
    # 128 bits name a set; rows are numbered as they are written
    named = src.withColumns({"num": F.monotonically_increasing_id(), "c1": F.xxhash64("items"), "c2": F.xxhash64(F.lit(7919), "items")})
    named.write.parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    narrow, cls = members.select("num", "f", "c1", "c2", "id"), ["f", "c1", "c2"]
    several = cut(narrow.groupBy(*cls).agg(F.min("num").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"))
    copies = cut(lookup_join(narrow, several, cls, salt_on=["num"]).select("num", "rep", "f", "id"))
    others = copies.where("num <> rep").select("num")
    signed = _signed(lookup_join(members, others, "num", how="left_anti", salts=1).select("num", "f", "items"), path, bands, rows, threshold)

    def missing(x: str, y: str) -> Column:
        """At least so many ids of x are not in y."""
        return sum(F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(f"{y}{i}"))) for i in (0, 1))

    maps = signed.select("num", "f", "n", "m0", "m1")
    handed = None
    if fits(maps, MAPPED_SETS, MAPPED_SETS * 96):
        table = maps.toPandas().sort_values("num")
        handed = spark.sparkContext.broadcast(_Maps(*(table[c].to_numpy() for c in ("num", "f", "n")), *(table[c].to_numpy().view(np.uint64) for c in ("m0", "m1"))))
    found = _candidates(signed, path, crowded, threshold, handed)
    for x, renamed in (("a", ("fa", "na", "a0", "a1")), ("b", ("fb", "nb", "b0", "b1"))):
        if handed is None:
            found = found.join(maps.toDF(x, *renamed), x)  # a set has at most crowded partners a key
    if handed is None:
        most = F.least(F.col("na") - missing("a", "b"), F.col("nb") - missing("b", "a"))
        near = most >= F.lit(threshold) * (F.col("na") + F.col("nb") - most) - F.lit(1e-9)
        found = found.where((F.col("fa") == F.col("fb")) & near)
    candidates = found.select("a", "b").distinct()
    items = members.select("num", "f", "items")
    pairs = candidates.join(items.toDF("a", "fa", "ia"), "a").join(items.toDF("b", "fb", "ib"), "b").where("fa = fb")
    common = F.size(F.array_intersect("ia", "ib"))
    links = pairs.where(common / (F.size("ia") + F.size("ib") - common) >= F.lit(threshold)).select("a", "b")
    held = lookup_join(narrow.select("num", "f", "id"), copies.select("num"), "num", how="left_anti", salts=1)
    held = held.unionByName(copies.select(F.col("rep").alias("num"), "f", "id").distinct())
    return held, cut(links)


def similar_classes(
    records: DataFrame, *, id: str, fields: tuple[str, ...], threshold: float, least: int = 1, bands: int = 14, rows: int = 2, crowded: int = 256,
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the classes of equal sets.

    ``members``: field, id, class, n_links (classes linked with the record's);
    a row per record and field.  ``links``: field, class_a, class_b of
    different classes of similarity >= threshold, each once.  However many
    records hold one set, it is one class, so nothing grows as their square.
    Defined cases as for ``similar_pairs``.
    """
    members, links = _classes(records, id, fields, threshold, least, bands, rows, crowded)
    name = F.element_at(F.array(*[F.lit(c) for c in fields]), F.col("f") + 1).alias("field")
    ends = links.select(F.explode(F.array("a", "b")).alias("num")).groupBy("num").agg(F.count(F.lit(1)).alias("n_links"))
    out = lookup_join(members, cut(ends), "num", how="left", salt_on=["id"])
    named = links.join(members.select(F.col("num").alias("a"), name).distinct(), "a")
    return out.select(name, "id", F.col("num").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")), named.select("field", F.col("a").alias("class_a"), F.col("b").alias("class_b"))


def similar_pairs(
    records: DataFrame, *, id: str, fields: tuple[str, ...], threshold: float, least: int = 1,
    bands: int = 14, rows: int = 2, crowded: int = 256,
) -> DataFrame:
    """Pairs of records whose sets in a field have intersection / union >= threshold.

    ``fields``: array columns holding sets (no repeats, no nulls); sets of fewer
    than ``least`` ids are left out.  Result: field, id_a, id_b with id_a < id_b,
    each pair once.  To join two tables, hand in their union with distinct ids.

    Defined cases: null and empty sets are similar to nothing; equal sets are
    similar; a null id is no record; repeated rows of an id count once; further
    columns are ignored; an empty table gives no rows.
    """
    members, links = _classes(records, id, fields, threshold, least, bands, rows, crowded)
    several = members.groupBy("num").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("num", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("k"))
    several = cut(several)
    # members of a class beyond BLOCK are dealt over blocks, and each pair of blocks meets once
    large = several.where("k > 1")
    dealt = lookup_join(members, large, "num", how="left", salt_on=["id"]).withColumn("k", F.coalesce("k", F.lit(1)))
    dealt = dealt.select("num", "f", "id", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("block"))
    both = links.unionByName(several.select(F.col("num").alias("a"), F.col("num").alias("b")))
    for x in ("a", "b"):
        both = lookup_join(both, large.toDF(x, f"k{x}"), x, how="left").withColumn(f"b{x}", F.explode(F.sequence(F.lit(0), F.coalesce(f"k{x}", F.lit(1)) - 1)))
    out = (
        both.join(dealt.select(F.col("num").alias("a"), "f", F.col("block").alias("ba"), F.col("id").alias("ida")), ["a", "ba"])
        .join(dealt.select(F.col("num").alias("b"), F.col("block").alias("bb"), F.col("id").alias("idb")), ["b", "bb"])
        .where((F.col("a") != F.col("b")) | (F.col("ida") < F.col("idb")))
    )
    name = F.element_at(F.array(*[F.lit(c) for c in fields]), F.col("f") + 1)
    return out.select(name.alias("field"), F.least("ida", "idb").alias("id_a"), F.greatest("ida", "idb").alias("id_b"))
