"""Minimal acyclic transducer: words to token ids through shared prefixes and suffixes.

States with equal futures are merged while the sorted words are added, so the
automaton is minimal.  An edge carries the number of words that sort before
those it leads to; the sum along a word's path is the word's ordinal, which
indexes its token ids.  All arrays lie in one file that executors memory-map.

Words are looked up many at a time: one numpy step per byte position moves the
states of all words still alive.
"""

from __future__ import annotations

import numpy as np


def build(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The automaton of ``words`` (any order, no repeats) with their ``ids``, as one buffer."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    edges: list[list[tuple[int, int]]] = []  # of finished states
    final: list[bool] = []
    path: list[tuple[list[tuple[int, int]], bool]] = [([], False)]  # open states of the last word

    def finish(node: tuple[list[tuple[int, int]], bool]) -> int:
        known = (node[1], tuple(node[0]))
        if known not in register:
            register[known] = len(edges)
            edges.append(node[0])
            final.append(node[1])
        return register[known]

    last = b""
    for word in (words[i] for i in order):
        same = 0
        most = min(len(last), len(word))
        while same < most and last[same] == word[same]:
            same += 1
        for at in range(len(last), same, -1):
            path[at - 1][0].append((last[at - 1], finish(path.pop())))
        for _ in range(same, len(word)):
            path.append(([], False))
        path[-1] = (path[-1][0], True)
        last = word
    for at in range(len(last), 0, -1):
        path[at - 1][0].append((last[at - 1], finish(path.pop())))
    root = finish(path.pop())

    below = np.zeros(len(edges), np.int64)  # words reachable; children are finished before parents
    key, to, out = [], [], []
    for s, es in enumerate(edges):
        n = int(final[s])
        for byte, t in es:
            key.append(s * 256 + byte)
            to.append(t)
            out.append(n)
            n += int(below[t])
        below[s] = n
    lengths = np.array([len(ids[i]) for i in order], np.int64)
    parts = [
        np.array(key, np.int64), np.array(to, np.int64), np.array(out, np.int64), np.array(final, np.int64),
        np.r_[0, np.cumsum(lengths)].astype(np.int64), np.array([x for i in order for x in ids[i]], np.int64),
    ]
    return np.r_[root, [len(p) for p in parts]].astype(np.int64).tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A built automaton, from a buffer or a memory-mapped file."""

    def __init__(self, source: bytes | str):
        raw = np.frombuffer(source, np.int64) if isinstance(source, bytes) else np.memmap(source, np.int64, "r")
        self.root, cuts = int(raw[0]), np.cumsum(raw[1:7])
        self.key, self.to, self.out, self.final, self.offsets, self.ids = np.split(raw[7:], cuts[:-1])

    def ordinals(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ordinal of each word data[offsets[i]:offsets[i+1]], -1 for words that aren't in the automaton."""
        n = len(offsets) - 1
        found = np.full(n, -1, np.int64)
        if not len(self.key):
            return found
        at, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        live = np.arange(n)
        state, total = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        while len(live):
            done = at[live] >= end[live]
            ended = live[done]
            ended = ended[self.final[state[ended]] != 0]
            found[ended] = total[ended]
            live = live[~done]
            wanted = state[live] * 256 + data[at[live]]
            edge = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = self.key[edge] == wanted
            live, edge = live[hit], edge[hit]
            state[live] = self.to[edge]
            total[live] += self.out[edge]
            at[live] += 1
        return found
