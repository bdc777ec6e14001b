"""Levelled compaction: targets, priorities and picks, planned on the driver over run metadata."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.model import Options


@dataclass(frozen=True)
class Run:
    """Metadata of a sorted run."""

    name: str
    level: int
    lo: bytes
    hi: bytes
    size: int
    max_seq: int = 0
    created: float = 0.0


@dataclass(frozen=True)
class Targets:
    """Wanted bytes of each level and of its runs; the level that L0 compacts into."""

    base: int
    level_bytes: tuple[int, ...]
    run_bytes: tuple[int, ...]


def run_bytes(level: int, opt: Options = Options(), base: int = 1) -> int:
    """Wanted bytes of a run: L0 runs are memory tables; below the base level each level's runs are a multiple larger."""
    return opt.memtable_size if level == 0 else opt.base_table_size * opt.table_multiplier ** max(0, level - base)


def targets(sizes: Sequence[int], opt: Options = Options()) -> Targets:
    """Targets from the levels' sizes.

    A level may hold its share of the last one's bytes, a multiple less for each
    level in between, but not less than the base size.  L0 compacts into the
    deepest level that needs no more than the base size, or into the one below
    if that one is empty above a level with room.
    """
    last = len(sizes) - 1
    room = {i: max(opt.base_level_size, sizes[last] // opt.level_multiplier ** (last - i)) for i in range(1, last + 1)}
    base = max((i for i in room if room[i] == opt.base_level_size), default=0)
    runs = tuple(run_bytes(i, opt, base) for i in range(last + 1))
    if 0 < base < last and not sizes[base] and sizes[base + 1] < room[base + 1]:
        base += 1
    return Targets(base, (0, *room.values()), runs)


@dataclass(frozen=True)
class Priority:
    """How urgent the compaction of a level is."""

    level: int
    score: float
    adjusted: float


def priorities(sizes: Sequence[int], l0_runs: int, opt: Options = Options()) -> list[Priority]:
    """Levels worth compacting, most urgent first.

    A score is the size against the target (L0: runs against their limit).  A
    level that must move is less urgent the fuller the level it moves into is:
    its score counts relative to that level's, which counts as 0.01 at least.
    """
    t = targets(sizes, opt)
    score = {0: l0_runs / opt.l0_tables} | {i: sizes[i] / t.level_bytes[i] for i in range(1, len(sizes))}
    chain = [0, *range(max(t.base, 1), len(sizes))]  # each level moves into the one after it
    into = dict(zip(chain, chain[1:], strict=False))
    relative = {i: s / max(score[into[i]], 0.01) if s >= 1 and i in into else s for i, s in score.items()}
    full = [Priority(i, score[i], relative[i]) for i in range(len(sizes) - 1) if score[i] >= 1]
    return sorted(full, key=lambda p: -p.adjusted)


def l0_first(todo: Sequence[Priority]) -> list[Priority]:
    """The same with level 0, if it is there, in front."""
    return sorted(todo, key=lambda p: p.level != 0)


def overlapping(runs: Sequence[Run], lo: bytes, hi: bytes) -> list[Run]:
    """Runs whose closed key range meets [lo, hi]."""
    return [r for r in runs if r.lo <= hi and lo <= r.hi]


def overlapping_pairs(runs: DataFrame) -> DataFrame:
    """(a, b), a < b: ids of runs (id, lo, hi) whose closed key ranges meet.

    Two ranges meet exactly if one begins inside the other.  Keys are cut into
    bins of about equal numbers of beginnings; a run is in each bin it crosses,
    so a run meets those that begin in its bins only, and no two runs are compared twice.
    """
    # every run begins somewhere, so a share of the beginnings by their hash cuts them evenly; 512 bounds at most or so
    every = max(1, runs.count() // 256)
    cuts = sorted(r[0] for r in runs.where(F.pmod(F.xxhash64("lo"), F.lit(every)) == 0).select("lo").distinct().collect()) if every > 1 else []
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast(f"array<{runs.schema['lo'].dataType.simpleString()}>")
    bin_of = lambda c: F.size(F.filter(bounds, lambda x: x <= F.col(c)))
    x = runs.select(F.col("id").alias("x"), F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi"), F.explode(F.sequence(bin_of("lo"), bin_of("hi"))).alias("bin"))
    y = runs.select(F.col("id").alias("y"), F.col("lo").alias("y_lo"), bin_of("lo").alias("bin"))
    met = x.join(y, "bin").where((F.col("x") != F.col("y")) & (F.col("x_lo") <= F.col("y_lo")) & (F.col("y_lo") <= F.col("x_hi")))
    met = met.where((F.col("x_lo") < F.col("y_lo")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def pick_l0(l0: Sequence[Run], base: Sequence[Run], busy: Sequence[tuple[bytes, bytes]] = ()) -> tuple[list[Run], list[Run]]:
    """(top, bottom): the longest oldest-first chain of overlapping L0 runs, and the base runs it meets; none where another job is."""
    top: list[Run] = []
    for run in l0:
        if top and not overlapping([run], min(r.lo for r in top), max(r.hi for r in top)):
            break
        top.append(run)
    if not top:
        return [], []
    bottom = overlapping(base, min(r.lo for r in top), max(r.hi for r in top))
    lo, hi = min(r.lo for r in top + bottom), max(r.hi for r in top + bottom)
    return ([], []) if any(a <= hi and lo <= b for a, b in busy) else (top, bottom)


def pick_l0_to_l0(l0: Sequence[Run], run_bytes: int, now: float, min_age: float = 10.0, at_least: int = 4) -> list[Run]:
    """Small, settled L0 runs to merge among themselves; none if they are too few."""
    small = [r for r in l0 if r.size < 2 * run_bytes and now - r.created >= min_age]
    return small if len(small) >= at_least else []


def pick_level(this: Sequence[Run], below: Sequence[Run], busy: Sequence[tuple[bytes, bytes]] = ()) -> tuple[list[Run], list[Run]]:
    """(top, bottom): the run with the oldest data whose range no other job holds, and what it meets below."""
    for run in sorted(this, key=lambda r: r.max_seq):
        bottom = overlapping(below, run.lo, run.hi)
        lo = min([run.lo, *(r.lo for r in bottom)])
        hi = max([run.hi, *(r.hi for r in bottom)])
        if not any(a <= hi and lo <= b for a, b in busy):
            return [run], bottom
    return [], []


def splits(bottom: Sequence[Run]) -> list[tuple[bytes | None, bytes | None]]:
    """Key sub-ranges (from, to] of a compaction: every max(3, n/5) bottom runs one; both ends open."""
    step = max(3, math.ceil(len(bottom) / 5))
    cuts = [bottom[i].hi for i in range(step - 1, len(bottom) - 1, step)]
    return list(zip([None, *cuts], [*cuts, None], strict=True)) if bottom else []


def checkpoint_due(creations: int, deletions: int, opt: Options = Options()) -> bool:
    """A manifest log is rewritten when deletions are many and dominate what is live."""
    return deletions > opt.checkpoint_deletions and deletions > opt.checkpoint_ratio * (creations - deletions)
