"""Recompression of word sequences: runs, then pairs, round after round.

In a round every run of one symbol gets a name, and then every pair of a left
symbol followed by a right one (sides by a bit of the symbol's hash, new in
every round). Names are hashes of what they stand for, so that equal
parts get equal names in every document without a table that all tasks share.

Whether a symbol is formed depends on little around it. Each symbol carries
that context as a range of words: wherever the words of the context occur
again, the same symbol stands at the same place within them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from quillon.llm.words import U, splitmix


class Symbols(NamedTuple):
    name: np.ndarray  # uint64
    start: np.ndarray  # first word of the symbol, and the word after its last
    end: np.ndarray
    left: np.ndarray  # context: first word, and the word after the last; outside the text if it depends on the text's end
    right: np.ndarray
    text: np.ndarray  # which text it is in


def symbols(words: np.ndarray, counts: np.ndarray) -> Symbols:
    """Level 0: the words themselves. counts: words of each text."""
    at = np.arange(len(words), dtype=np.int64)
    return Symbols(words, at, at + 1, at, at + 1, np.repeat(np.arange(len(counts), dtype=np.int64), counts))


def runs(s: Symbols) -> Symbols:
    """Each run of one symbol becomes one."""
    n = len(s.name)
    if not n:
        return s
    new = np.ones(n, dtype=bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.text[1:] != s.text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    length = last - first + 1
    name = s.name[first]
    name = np.where(length > 1, splitmix(name ^ splitmix(length.astype(np.uint64) << U(1))), name)
    text = s.text[first]
    # A run ends where another symbol begins: its context holds those beside it.
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    own_left = np.minimum.reduceat(s.left, first)
    own_right = np.maximum.reduceat(s.right, first)
    left = np.where((first > 0) & (s.text[before] == text), np.minimum(own_left, s.left[before]), s.start[first] - 1)
    right = np.where((last < n - 1) & (s.text[after] == text), np.maximum(own_right, s.right[after]), s.end[last] + 1)
    return Symbols(name, s.start[first], s.end[last], np.minimum(left, own_left), np.maximum(right, own_right), text)


def pairs(s: Symbols, level: int) -> Symbols:
    """Each left symbol followed by a right one becomes one symbol with it."""
    n = len(s.name)
    if n < 2:
        return s
    side = (splitmix(s.name + U(2 * level + 1)) & U(1)).astype(bool)  # True: right
    same = s.text[1:] == s.text[:-1]
    joined = np.zeros(n, dtype=bool)  # with the next
    joined[:-1] = same & ~side[:-1] & side[1:]
    taken = np.zeros(n, dtype=bool)
    taken[1:] = joined[:-1]
    # A single symbol depends on the one that it could have joined.
    left, right = s.left.copy(), s.right.copy()
    single = ~joined & ~taken
    lefts, rights = np.flatnonzero(single & ~side), np.flatnonzero(single & side)
    nxt, prv = np.minimum(lefts + 1, n - 1), np.maximum(rights - 1, 0)
    right[lefts] = np.where((lefts < n - 1) & (s.text[nxt] == s.text[lefts]), np.maximum(s.right[lefts], s.right[nxt]), s.end[lefts] + 1)
    left[rights] = np.where((rights > 0) & (s.text[prv] == s.text[rights]), np.minimum(s.left[rights], s.left[prv]), s.start[rights] - 1)
    # The neighbour's own context counts on both sides.
    left[lefts] = np.where((lefts < n - 1) & (s.text[nxt] == s.text[lefts]), np.minimum(left[lefts], s.left[nxt]), left[lefts])
    right[rights] = np.where((rights > 0) & (s.text[prv] == s.text[rights]), np.maximum(right[rights], s.right[prv]), right[rights])
    at = np.flatnonzero(joined)
    name = s.name.copy()
    name[at] = splitmix(splitmix(s.name[at] + U(4 * level + 2)) ^ s.name[at + 1])
    end = s.end.copy()
    end[at] = s.end[at + 1]
    left[at] = np.minimum(s.left[at], s.left[at + 1])
    right[at] = np.maximum(s.right[at], s.right[at + 1])
    keep = ~taken
    return Symbols(name[keep], s.start[keep], end[keep], left[keep], right[keep], s.text[keep])


def rounds(words: np.ndarray, counts: np.ndarray, n: int) -> Symbols:
    """The symbols after n rounds."""
    s = symbols(words, counts)
    for level in range(n):
        s = pairs(runs(s), level)
    return s


def open_windows(s: Symbols, repeated: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Of the windows at starts, those that hold no context of an unrepeated symbol.

    A window that occurs elsewhere brings each symbol whose context it holds
    with it; one such symbol that occurs once rules the window out.
    """
    once = np.flatnonzero(~repeated & (s.right - s.left <= width))
    total = int(max(s.end.max(initial=0), starts.max(initial=0) + 1)) + width + 2
    shut = np.zeros(total + 1, dtype=np.int32)  # windows from right - width to left hold the context
    low, high = np.maximum(s.right[once] - width, 0), s.left[once]
    ok = (high >= low) & (s.left[once] >= 0)
    np.add.at(shut, low[ok], 1)
    np.add.at(shut, high[ok] + 1, -1)
    return starts[np.cumsum(shut)[starts] == 0]
