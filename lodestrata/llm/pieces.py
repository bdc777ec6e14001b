"""Texts as codes of distinct pieces: costly text work is done once per distinct piece of a slice."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: The White_Space characters of Unicode (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters of text worked on at a time; a longer text is a slice of its own.
SLICE_CHARS = 1 << 20


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts, together SLICE_CHARS or one text."""
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_CHARS)))
        yield a, b
        a = b


def coded(pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(pieces of each text, code of each piece, distinct pieces)."""
    per_text = np.fromiter(map(len, pieces), np.int64, len(pieces))
    array = pa.array([p for ps in pieces for p in ps], pa.large_string()).dictionary_encode()
    return per_text, array.indices.to_numpy(), array.dictionary


def gather(starts: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Positions of the entries of each code's list, one list after the other."""
    counts = lengths[code]
    ends = np.cumsum(counts)
    if not len(ends):
        return np.empty(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts[code] - (ends - counts), counts)


def expanded(texts: list[str | None], pattern: re.Pattern, split: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As ``coded``, of the pieces that ``split`` makes of each match of ``pattern``.

    ``split`` runs once per distinct match, so it must not depend on what is around.
    """
    find = pattern.findall
    per_text, code, distinct = coded([find(t) if t else [] for t in texts])
    inner, inner_code, parts = coded([split(c) for c in distinct.to_pylist()])
    starts = np.cumsum(inner) - inner
    at = gather(starts, inner, code)
    ends = np.r_[0, np.cumsum(inner[code])]
    bounds = ends[np.r_[0, np.cumsum(per_text)]]
    return np.diff(bounds), inner_code[at], parts
