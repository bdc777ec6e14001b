"""Membership and frequency sketches and cache policies."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Hashable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import map_arrow, ship


def bloom_bits_per_key(n: int, fpp: float) -> int:
    """Bits a key needs for the false-positive rate."""
    return math.ceil(-n * math.log(fpp) / math.log(2) ** 2 / n)


def bloom_hashes(bits_per_key: int) -> int:
    """Best number of hash functions, 1 to 30."""
    return min(30, max(1, int(bits_per_key * 0.69)))


class Bloom:
    """A Bloom filter over 64-bit hashes, probed by double hashing; one bit a place."""

    def __init__(self, n_keys: int, bits_per_key: int):
        self.k = bloom_hashes(bits_per_key)
        self.n_bits = max(64, n_keys * max(bits_per_key, 0))
        self.words = np.zeros(-(-self.n_bits // 64), np.uint64)

    def _places(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = hashes.astype(np.uint64)
        step = (h >> np.uint64(33)) | np.uint64(1)
        with np.errstate(over="ignore"):
            for _ in range(self.k):
                at = h % np.uint64(self.n_bits)
                yield (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
                h = h + step

    def add(self, hashes: np.ndarray) -> Bloom:
        for word, bit in self._places(hashes):
            np.bitwise_or.at(self.words, word, bit)
        return self

    def may_contain(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for word, bit in self._places(hashes):
            found &= self.words[word] & bit != 0
        return found


#: Members of one part of a distributed Bloom filter (about 1.2 MB at one percent).
BLOOM_PART = 1 << 20


def _probe_parts(keys_in_part: int, bits: int):
    """Rows (part, probe, h, key) sorted by part, members before probes: a filter per part, and what it says of each probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known = None, None
        for batch in batches:
            parts, probe, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for p in np.unique(parts).tolist():
                if p != part:
                    part, known = p, Bloom(keys_in_part, bits)
                mine = parts == p
                known.add(h[mine & ~probe].view(np.uint64))
                asked = np.flatnonzero(mine & probe)
                if len(asked):
                    yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(asked)), pa.array(known.may_contain(h[asked].view(np.uint64)))], names=["key", "maybe"])

    return run


def bloom_probe(members: DataFrame, probes: DataFrame, key: str, fpp: float = 0.01) -> DataFrame:
    """(key, maybe) of each row of ``probes``: a distributed Bloom filter of ``members``.

    Both sides are split by key hash into parts of about BLOOM_PART members,
    each with its own filter; null keys are left out.
    """
    h = F.xxhash64(F.lit(7919), F.col(key))  # not the hash rows are shuffled by
    m = members.where(F.col(key).isNotNull()).select(h.alias("h"), F.col(key).alias("key")).distinct()
    n = max(1, m.count())
    parts = -(-n // BLOOM_PART)
    part = F.pmod("h", F.lit(parts)).cast("int").alias("part")
    p = probes.where(F.col(key).isNotNull()).select(h.alias("h"), F.col(key).alias("key"))
    both = m.select(part, F.lit(False).alias("probe"), "h", F.lit(None).cast(p.schema["key"].dataType).alias("key")).unionByName(p.select(part, F.lit(True).alias("probe"), "h", "key"))
    kind = probes.schema[key].dataType.simpleString()
    ranged = both.repartition("part").sortWithinPartitions("part", "probe")
    return map_arrow(ranged, _probe_parts(-(-n // parts), bloom_bits_per_key(n, fpp)), f"key {kind}, maybe boolean")


class CountMin:
    """Count-min sketch of four rows of four-bit counters, saturating at 15 (one machine; ``count_min`` is the distributed one)."""

    def __init__(self, counters: int, seed: int = 1):
        self.width = 1 << max(0, math.ceil(math.log2(max(1, counters))))
        self.rows = np.zeros((4, self.width), np.uint8)
        self.seeds = np.random.default_rng(seed).integers(0, 1 << 62, 4)

    def increment(self, hashed: int) -> None:
        at = (hashed ^ self.seeds) & (self.width - 1)
        lanes = np.arange(4)
        self.rows[lanes, at] = np.minimum(self.rows[lanes, at] + 1, 15)

    def estimate(self, hashed: int) -> int:
        return int(self.rows[np.arange(4), (hashed ^ self.seeds) & (self.width - 1)].min())

    def reset(self) -> None:
        """Halve all counters (aging)."""
        self.rows >>= 1

    def clear(self) -> None:
        self.rows[:] = 0


def _lanes(keys: list[str], width: int) -> Column:
    """The places of a key in the sketch: one in each of four rows."""
    return F.array(*[F.struct(F.lit(i).alias("lane"), F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(width)).alias("at")) for i in range(4)])


def count_min(df: DataFrame, keys: list[str], width: int, most: int = 15) -> DataFrame:
    """(lane, at, n): a count-min sketch of four rows of ``width`` saturating counters.

    Counters are summed per task before the shuffle and over all tasks after
    it, so the sketch of any number of rows has 4 x ``width`` entries at most.
    """
    return df.select(F.explode(_lanes(keys, width)).alias("p")).groupBy("p.lane", "p.at").agg(F.least(F.count(F.lit(1)), F.lit(most)).cast("long").alias("n"))


def halved(sketch: DataFrame) -> DataFrame:
    """The sketch with all counters halved (aging)."""
    return sketch.withColumn("n", F.shiftright("n", 1))


def estimates(sketch: DataFrame, df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, estimate) of each distinct key of ``df``: the least of its four counters, never less than its own count."""
    asked = df.select(*keys).distinct().select(*keys, F.explode(_lanes(keys, width)).alias("p")).select(*keys, "p.lane", "p.at")
    found = asked.join(sketch, ["lane", "at"], "left").groupBy(*keys)
    return found.agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def saturated_counts(df: DataFrame, keys: list[str], halvings: int = 0, most: int = 15) -> DataFrame:
    """Exact counterpart of the sketch: occurrences per key, saturating, halved ``halvings`` times."""
    n = F.least(F.count(F.lit(1)), F.lit(most)).cast("long")
    return df.groupBy(*keys).agg((F.shiftright(n, halvings) if halvings else n).alias("estimate"))


class WindowLRU:
    """Least-recently-used cache of fixed capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, OrderedDict()

    def add(self, key: Hashable, value=None):
        """Insert a key; returns the evicted (key, value) or None."""
        out = self.held.popitem(last=False) if key not in self.held and len(self.held) >= self.capacity else None
        self.held[key] = value
        self.held.move_to_end(key)
        return out

    def get(self, key: Hashable) -> bool:
        """Whether the key is held; it becomes the most recent."""
        if key in self.held:
            self.held.move_to_end(key)
            return True
        return False


class SegmentedLRU:
    """New keys enter a probation segment; a second use promotes them to a protected one."""

    def __init__(self, probation: int, protected: int):
        self.caps = (probation, protected)
        self.probation, self.protected = OrderedDict(), OrderedDict()

    def __len__(self) -> int:
        return len(self.probation) + len(self.protected)

    def victim(self):
        """The key the next insertion drops; None while there is room."""
        return next(iter(self.probation)) if len(self) >= sum(self.caps) and self.probation else None

    def add(self, key: Hashable, value=None):
        full = len(self.probation) >= self.caps[0] and len(self) >= sum(self.caps)
        out = self.probation.popitem(last=False) if full else None
        self.probation[key] = value
        return out

    def get(self, key: Hashable) -> bool:
        if key in self.protected:
            self.protected.move_to_end(key)
            return True
        if key not in self.probation:
            return False
        value = self.probation.pop(key)
        if len(self.protected) >= self.caps[1]:  # its oldest goes back on probation
            old, kept = self.protected.popitem(last=False)
            self.probation[old] = kept
        self.protected[key] = value
        return True


class TinyLFU:
    """A small window in front of a segmented cache; a count-min sketch decides who stays.

    What falls out of the window enters the main cache only if the sketch has
    seen it more often than the key it would replace.  After ``10 * capacity``
    accesses all counters are halved.
    """

    def __init__(self, capacity: int, window_share: float = 0.01):
        window = max(1, int(capacity * window_share))
        main = max(2, capacity - window)
        self.window, self.main = WindowLRU(window), SegmentedLRU(main - main * 4 // 5, main * 4 // 5)
        self.sketch, self.left, self.every = CountMin(capacity * 4), 10 * capacity, 10 * capacity

    @staticmethod
    def _hash(key: Hashable) -> int:
        return xxhash.xxh3_64_intdigest(repr(key)) >> 2

    def get(self, key: Hashable) -> bool:
        self.left -= 1
        if not self.left:
            self.sketch.reset()
            self.left = self.every
        self.sketch.increment(self._hash(key))
        return self.window.get(key) or self.main.get(key)

    def add(self, key: Hashable, value=None):
        """Insert a key; returns what left the cache."""
        out = self.window.add(key, value)
        if out is None:
            return None
        victim = self.main.victim()
        if victim is not None and self.sketch.estimate(self._hash(out[0])) <= self.sketch.estimate(self._hash(victim)):
            return out
        return self.main.add(*out)


POLICIES = {
    "lru": WindowLRU, "slru": lambda c: SegmentedLRU(c // 2, c - c // 2), "tinylfu": TinyLFU,
}


def _simulate(keys: Iterable, policy) -> list[bool]:
    hits = []
    for key in keys:
        hit = policy.get(key)
        if not hit:
            policy.add(key)
        hits.append(hit)
    return hits


def cache_trace(df: DataFrame, shard: str, order: str, key: str, policy: str, capacity: int) -> DataFrame:
    """(shard, accesses, hits) of a cache per ``shard`` that sees its accesses by ``order``.

    ``policy``: one of POLICIES.  A cache is a sequential machine, so a shard is
    one group: shards are what is parallel.  Shard by a hash of the key, so that
    a shard sees every access of its keys.
    """
    kind = df.schema[shard].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cache = POLICIES[policy](capacity)
        hits = _simulate(pdf.sort_values("o", kind="stable")["k"], cache)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "accesses": [len(hits)], "hits": [sum(hits)]})

    ship(df.sparkSession)
    src = df.select(F.col(shard).alias("shard"), F.col(order).alias("o"), F.col(key).alias("k"))
    return src.groupBy("shard").applyInPandas(run, f"shard {kind}, accesses bigint, hits bigint")
