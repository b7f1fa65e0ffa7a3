"""Suffix arrays of byte strings by induced sorting, with permuted common prefixes; all steps on whole numpy columns.

``suffix_array``: classify suffixes as larger (L) or smaller (S) than their right neighbour; name the leftmost-smaller
substrings in order; sort the string of their names recursively; then induce the L suffixes from left to right and the
S suffixes from right to left, bucket by bucket. A bucket is worked off in rounds (its members, those they bring into
the same bucket, and so on), so the number of numpy calls depends on the alphabet and not on the length.

The recursion names pairs of names: a name of m symbols and the one behind it make a name of 2m. It ends when all
names differ or cover ``depth`` bytes, because matches beyond that length need no order among themselves.
"""

from __future__ import annotations

import numpy as np

#: Ends every string and sorts before all bytes. UTF-8 never uses the bytes from 0xF8 on, so bytes move up by one.
END = 0
PAD = 255


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one to its right. The last one counts as smaller."""
    n = len(text)
    step = np.zeros(n, dtype=np.int8)
    np.sign(text[1:].astype(np.int16) - text[:-1], out=step[:-1], casting="unsafe")
    step[-1] = 1
    # Equal neighbours are of the kind of the next pair that differs.
    decided = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def leftmost_smaller(smaller: np.ndarray) -> np.ndarray:
    """Positions of S suffixes with an L suffix on their left."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def substring_names(text: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Order-preserving numbers of the substrings from each mark to the next, both ends included.

    Eight bytes make one sort column. A substring that ends is followed by the largest symbol: where a longer one goes
    on with the same bytes, its suffix is the smaller.
    """
    lengths = np.r_[marks[1:], len(text) - 1] + 1 - marks

    def column(some: np.ndarray, at: int) -> np.ndarray:
        key = np.zeros(len(some), dtype=np.uint64)
        for i in range(at, at + 8):
            symbol = np.where(i < lengths[some], text[np.minimum(marks[some] + i, len(text) - 1)], PAD)
            key = (key << np.uint64(8)) | symbol.astype(np.uint64)
        return key

    first = column(np.arange(len(marks)), 0)
    first[-1] = 0  # the end of the whole text comes before all else
    names = _ranks(first)
    for at in range(8, int(lengths.max()), 8):
        # Only names that stand for a substring that goes on need the next column.
        goes_on = np.zeros(int(names.max()) + 1, dtype=bool)
        goes_on[names[lengths > at]] = True
        some = np.flatnonzero(goes_on[names])
        rank = _ranks(column(some, at))
        names = names * (len(marks) + 1)
        names[some] += rank
        names = _ranks(names)
    return names


def _ranks(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def sort_names(names: np.ndarray, marks: np.ndarray, depth: int, ends: np.ndarray) -> np.ndarray:
    """The marks in the order of their suffixes, to ``depth`` bytes or the end of their string (``ends``).

    A name is the place of its group in the order. Each round looks at the groups that still have several members, adds
    the name as far behind as the group's names reach, and so names twice as much.
    """
    count = len(names)
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    new = np.r_[True, sorted_names[1:] != sorted_names[:-1]]
    place = np.empty(count + 1, dtype=np.int64)
    place[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    place[count] = -1
    at = np.r_[marks, np.iinfo(np.int64).max // 2]
    alone = new & np.r_[new[1:], True]
    slots, reach = np.flatnonzero(~alone), 1
    while len(slots):
        held = order[slots]
        behind = np.minimum(held + reach, count)
        open_ = (at[behind] - marks[held] < depth) & (at[behind] < ends[held])
        # A group has one reading, so it is open or closed as a whole unless its members end; those need no order.
        slots, held, behind = slots[open_], held[open_], behind[open_]
        if not len(slots):
            break
        key = place[held] * (count + 1) + place[behind] + 1
        sort = np.argsort(key)
        held, key = held[sort], key[sort]
        new = np.r_[True, key[1:] != key[:-1]]
        first = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        order[slots] = held
        place[held] = first
        slots = slots[~(new & np.r_[new[1:], True])]
        reach *= 2
    return marks[order]


class _Buckets:
    """Chunks of positions per first symbol, in the order they were put."""

    def __init__(self) -> None:
        self.chunks: list[list[np.ndarray]] = [[] for _ in range(256)]

    def put(self, positions: np.ndarray, symbols: np.ndarray) -> None:
        if len(positions) == 0:
            return
        order = np.argsort(symbols, kind="stable")
        ordered = symbols[order]
        cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(ordered)]
        positions = positions[order]
        for a, b in zip(bounds[:-1], bounds[1:]):
            self.chunks[ordered[a]].append(positions[a:b])

    def take(self, symbol: int) -> np.ndarray:
        chunks = self.chunks[symbol]
        self.chunks[symbol] = []
        return np.concatenate(chunks) if chunks else np.empty(0, dtype=np.int64)


def induce(text: np.ndarray, smaller: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The suffix array from the sorted leftmost-smaller suffixes."""
    larger_of: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * 256
    seeds, larger = _Buckets(), _Buckets()
    seeds.put(marks, text[marks])
    # The suffix that is the end symbol alone has no right neighbour; it is a seed like the marks and precedes them.
    for symbol in range(256):
        rounds = []
        current = larger.take(symbol)
        while len(current):
            rounds.append(current)
            left = current[current > 0] - 1
            left = left[~smaller[left]]
            kind = text[left]
            inside = kind == symbol
            larger.put(left[~inside], kind[~inside])
            current = left[inside]
        larger_of[symbol] = np.concatenate(rounds) if rounds else current
        seed = seeds.take(symbol)
        if len(seed):
            left = seed[seed > 0] - 1
            left = left[~smaller[left]]
            larger.put(left, text[left])
    out = []
    below = _Buckets()
    for symbol in range(255, -1, -1):
        rounds = []
        current = below.take(symbol)
        if symbol == END:
            break
        while len(current):
            rounds.append(current)
            left = current[current > 0] - 1
            left = left[smaller[left]]
            kind = text[left]
            inside = kind == symbol
            below.put(left[~inside], kind[~inside])
            current = left[inside]
        out += rounds
        tail = larger_of[symbol][::-1]
        if len(tail):
            left = tail[tail > 0] - 1
            left = left[smaller[left]]
            below.put(left, text[left])
            out.append(tail)
    return np.concatenate(out)[::-1] if out else np.empty(0, dtype=np.int64)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes that do not begin with END, ordered by their first ``depth`` bytes.

    ``text``: bytes moved up by one, strings closed by END; the last symbol is END.
    """
    smaller = classify(text)
    marks = leftmost_smaller(smaller)
    if len(marks):
        names = substring_names(text, marks)
        closing = np.flatnonzero(text == END)
        marks = sort_names(names, marks, depth, closing[np.searchsorted(closing, marks)])
    return induce(text, smaller, marks)


def packed(text: np.ndarray) -> np.ndarray:
    """Eight bytes from every position on, as one number."""
    out = np.zeros(len(text) + 8, dtype=np.uint64)
    out[: len(text)] = text
    for shift in (1, 2, 4):
        out[:-shift] |= out[shift:] << np.uint64(8 * shift)
    return out


def common_at_least(words: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at left and right, in whole eights up to ``most``."""
    length = np.zeros(len(left), dtype=np.int64)
    alive = np.arange(len(left))
    for at in range(0, most, 8):
        a, b = left[alive] + at, right[alive] + at
        fits = (a < n) & (b < n)
        fits[fits] = words[a[fits]] == words[b[fits]]
        alive = alive[fits]
        if not len(alive):
            break
        length[alive] = at + 8
    return length


def shares(words: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of ``length`` bytes at left and right are equal; both lie inside the text."""
    ok = np.arange(len(left))
    steps = [*range(0, length - 7, 8)]
    if length % 8 and length > 8:
        steps.append(length - 8)
    for at in steps:
        ok = ok[words[left[ok] + at] == words[right[ok] + at]]
        if not len(ok):
            break
    out = np.zeros(len(left), dtype=bool)
    out[ok] = True
    return out


def repeated_starts(text: np.ndarray, room: np.ndarray, length: int, stride: int = 48) -> np.ndarray:
    """Positions whose ``length`` bytes start at another position too. ``room``: bytes to the end of the string.

    Neighbours in the suffix array are compared in text order. The common prefix with the suffix before shrinks by one
    at most from a position to the next (the permuted common prefixes), so a long one found every ``stride`` positions
    settles those behind it; only the rest are compared one by one.
    """
    order = suffix_array(text, length)
    order = order[room[order] >= length]
    repeated = np.zeros(len(text), dtype=bool)
    if len(order) < 2:
        return repeated
    before = np.full(len(text), -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    words = packed(text)
    at = np.flatnonzero(before >= 0)
    sample = at[at % stride == 0]
    common = np.zeros(len(text), dtype=np.int64)
    reach = common_at_least(words, sample, before[sample], len(text), length + stride + 7)
    common[sample] = np.minimum(np.minimum(reach, room[sample]), room[before[sample]])
    base = at - at % stride
    sure = (common[base] - (at - base)) >= length
    rest = at[~sure]
    rest = rest[shares(words, rest, before[rest], length)]
    repeated[at[sure]] = repeated[rest] = repeated[before[rest]] = True
    # The first of a class in the array has no equal neighbour before it, but the settled one behind it.
    behind = at[sure]
    behind = behind[~repeated[before[behind]]]
    behind = behind[shares(words, behind, before[behind], length)]
    repeated[before[behind]] = True
    return repeated
