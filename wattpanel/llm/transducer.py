"""Minimal acyclic transducer from words to id sequences, in one file that readers memory-map.

Words come sorted, so a state can be closed as soon as a word leaves it: the longest common prefix of its outputs moves to
the arc above, and a state equal to a closed one is replaced by it.  Equal endings are therefore one chain of states.  The end of a
word is an arc of its own (symbol ``END``), so a state needs no further marks.

The file holds, after a header of five longs, arc keys (state * 257 + symbol, ascending), arc targets, place and length of
each arc's output, and the pool of outputs.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

END = 256
_SYMBOLS = 257
_HEADER = np.dtype("<i8")


def _common(outputs: list[tuple[int, ...]]) -> int:
    """Length of the longest common prefix."""
    low, high = min(outputs), max(outputs)
    n = 0
    for a, b in zip(low, high):
        if a != b:
            break
        n += 1
    return n


def build(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file's bytes for (word, ids) pairs in ascending order of distinct words."""
    states: dict[tuple, int] = {}
    path: list[list[list]] = [[]]  # open arcs [symbol, target, output] of the states along the last word
    previous, longest = b"", 0

    def close(down_to: int) -> None:
        while len(path) > down_to:
            arcs = path.pop()
            n = _common([a[2] for a in arcs])
            state = states.setdefault(tuple((s, t, o[n:]) for s, t, o in arcs), len(states))
            path[-1][-1][1:] = [state, arcs[0][2][:n]]

    for word, ids in entries:
        shared = 0
        while shared < min(len(previous), len(word)) and previous[shared] == word[shared]:
            shared += 1
        if previous and (word <= previous):
            raise ValueError("words must be distinct and ascending")
        close(shared + 1)
        for symbol in word[shared:]:
            path[-1].append([symbol, -1, ()])
            path.append([])
        path[-1].append([END, -1, tuple(ids)])
        previous, longest = word, max(longest, len(word))
    close(1)
    root = states.setdefault(tuple(map(tuple, path[0])), len(states))
    return _packed(states, root, longest)


def _packed(states: dict[tuple, int], root: int, longest: int) -> bytes:
    keys, targets, places, lengths, pool = [], [], [], [], []
    kept: dict[tuple[int, ...], int] = {}
    for arcs, state in states.items():  # in the order of their numbers
        for symbol, target, output in sorted(arcs):
            if output not in kept:
                kept[output] = len(pool)
                pool.extend(output)
            keys.append(state * _SYMBOLS + symbol)
            targets.append(target)
            places.append(kept[output])
            lengths.append(len(output))
    head = np.array([len(keys), len(pool), root, len(states), longest], dtype=_HEADER)
    body = [np.array(keys, dtype="<i8"), *[np.array(x, dtype="<i4") for x in (targets, places, lengths, pool)]]
    return b"".join(x.tobytes() for x in (head, *body))


class Transducer:
    """A built file, memory-mapped: processes of a machine share its pages."""

    def __init__(self, path: str):
        arcs, pool, self.root, self.states, self.longest = (int(x) for x in np.fromfile(path, dtype=_HEADER, count=5))
        at = 5 * _HEADER.itemsize

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.memmap(path, dtype=kind, mode="r", offset=at, shape=(n,)) if n else np.zeros(0, kind)
            at += n * np.dtype(kind).itemsize
            return found

        self.keys = column("<i8", arcs)
        self.targets, self.places, self.lengths = (column("<i4", arcs) for _ in range(3))
        self.pool = column("<i4", pool)

    def walk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of many words at once (bytes and offsets): which are known, how many ids each has (unknown: 0), and their ids in order."""
        n = len(offsets) - 1
        size = np.diff(offsets)
        known = np.zeros(n, dtype=bool)
        taken = np.full((n, self.longest + 1), -1, dtype=np.int32)
        alive = np.flatnonzero(size <= self.longest) if len(self.keys) else np.zeros(0, np.int64)
        state = np.full(len(alive), self.root, dtype=np.int64)
        for step in range(self.longest + 1):
            if not len(alive):
                break
            ends = size[alive] == step
            symbol = np.full(len(alive), END, dtype=np.int64)
            symbol[~ends] = data[offsets[alive[~ends]] + step]
            key = state * _SYMBOLS + symbol
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            taken[alive[there], step] = arc[there]
            known[alive[there & ends]] = True
            on = there & ~ends
            alive, state = alive[on], self.targets[arc[on]].astype(np.int64)
        arcs = taken[known]
        arcs = arcs[arcs >= 0]
        length = self.lengths[arcs].astype(np.int64)
        return known, self._per_word(taken, known), gather(self.pool, self.places[arcs].astype(np.int64), length)

    def _per_word(self, taken: np.ndarray, known: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(known), dtype=np.int64)
        if known.any():
            arcs = taken[known]
            counts[known] = np.where(arcs >= 0, self.lengths[np.maximum(arcs, 0)], 0).sum(axis=1)
        return counts


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``pool[start : start + length]`` of every pair, one after another."""
    before = np.cumsum(lengths) - lengths
    return pool[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]
