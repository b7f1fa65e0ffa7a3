"""Periodic runs of words by maximal pairs: the bottom-up tree of common-prefix intervals, no extension of matches.

A run with period q from word s on, L words long, is a string of L - q words that occurs at s and at s + q and cannot be
longer on either side: a maximal pair whose distance is at most its length. So runs are read off the pairs.

1. Words get exact numbers per block of documents. Only documents in which ``least / 2`` words in a row occur twice can
   hold such a pair; the suffixes of the others are not sorted. The order is built by doubling names.
2. Common prefixes of neighbours in the order come from the names, longest first.
3. The intervals of common prefixes are closed bottom-up. Each holds its places in order, cut into stretches of one
   left-word class. When two of them meet at an interval of h words, each place of the smaller one meets those of the
   larger one within h words whose class differs; stretches of its own class are hopped over. A pair that is reported is
   maximal on the right because it meets there, and on the left because the classes differ.
4. Pairs of one stretch at several multiples of a period have one start and one length; the smallest distance stays.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.common import Rolling, byte_blocks, mix, short_batches, text_column, word_spans
from tiltmeter.llm.passages import merged_spans

LEAST_WORDS = 12


def word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, different ones for different words."""
    size = end - start
    bounds = np.r_[0, np.cumsum(size)].astype(np.int64)
    at = np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[at]))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def rows_with_repeats(words: np.ndarray, row: np.ndarray, width: int, rolling: Rolling) -> np.ndarray:
    """Marks the words of rows in which some ``width`` words occur twice; by fingerprints, so it may mark others too."""
    if len(words) < width:
        return np.zeros(len(words), dtype=bool)
    prints = rolling.every(rolling.prefix(mix(words.astype(np.uint64))), width)
    prints = mix(prints ^ mix(row[: len(prints)].astype(np.uint64)))[row[: len(prints)] == row[width - 1 :]]
    of_row = row[: len(words) - width + 1][row[: len(words) - width + 1] == row[width - 1 :]]
    order = np.argsort(prints)
    again = of_row[order[1:][prints[order][1:] == prints[order][:-1]]]
    some = np.zeros(int(row[-1]) + 1, dtype=bool)
    some[again] = True
    return some[row]


def suffix_order(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their suffixes, row by row; words that each has in common with the one before it).

    A name is the place of its group in the order. Each round looks at the groups that still have several members and
    names twice as many words; a suffix that ends comes before those that go on.
    """
    count = len(words)
    key = row * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    head = np.r_[True, key[order][1:] != key[order][:-1]]
    names = np.empty(count, dtype=np.int64)
    names[order] = np.maximum.accumulate(np.where(head, np.arange(count), 0))
    levels = [names.astype(np.int32)]
    open_ = order[np.repeat(_several(head), np.diff(np.r_[np.flatnonzero(head), count]))]
    reach = 1
    while len(open_):
        behind = np.minimum(open_ + reach, count - 1)
        goes_on = (open_ + reach < count) & (row[behind] == row[open_])
        name, then = names[open_], np.where(goes_on, names[behind] + 1, 0)
        sort = np.lexsort((then, name))
        open_, name, then = open_[sort], name[sort], then[sort]
        group = np.r_[True, name[1:] != name[:-1]]
        part = group | np.r_[True, then[1:] != then[:-1]]
        at = np.arange(len(open_))
        names[open_] = name + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(names.astype(np.int32))
        open_ = open_[np.repeat(_several(part), np.diff(np.r_[np.flatnonzero(part), len(part)]))]
        reach *= 2
    order = np.argsort(names)
    common = np.zeros(count, dtype=np.int64)
    pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    one, two, both = order[pair - 1], order[pair], np.zeros(len(pair), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = one + both, two + both
        same = np.flatnonzero((a < count) & (b < count))
        same = same[levels[k][a[same]] == levels[k][b[same]]]
        both[same] += 1 << k
    common[pair] = both
    return order, common


def _several(head: np.ndarray) -> np.ndarray:
    """By group, whether it has several members."""
    return np.diff(np.r_[np.flatnonzero(head), len(head)]) > 1


class Places:
    """Places in order, and those of them that start a stretch of one left-word class."""

    def __init__(self, place: int) -> None:
        self.all, self.heads = [place], [place]

    def differing(self, place: int, reach: int, left: dict) -> Iterator[int]:
        """The places at most ``reach`` away whose left word is another one than that of ``place``."""
        own = left[place]
        at, end = bisect_left(self.all, place - reach), bisect_right(self.all, place + reach)
        while at < end:
            other = self.all[at]
            if left[other] != own:
                yield other
                at += 1
                continue
            head = bisect_right(self.heads, other)
            if head == len(self.heads):
                return
            at = bisect_left(self.all, self.heads[head])

    def take(self, other: Places, left: dict) -> None:
        """The places of ``other``, no larger than this one, join."""
        if 8 * len(other.all) > len(self.all):
            self.all = sorted(self.all + other.all)
            self.heads = [p for b, p in zip([None, *self.all], self.all) if b is None or left[b] != left[p]]
            return
        for place in other.all:
            at = bisect_left(self.all, place)
            before = self.all[at - 1] if at else None
            behind = self.all[at] if at < len(self.all) else None
            if behind is not None:
                was = before is None or left[before] != left[behind]
                now = left[place] != left[behind]
                if was and not now:
                    self.heads.pop(bisect_left(self.heads, behind))
                elif now and not was:
                    insort(self.heads, behind)
            if before is None or left[before] != left[place]:
                insort(self.heads, place)
            self.all.insert(at, place)


def close_pairs(places: list[int], common: list[int], left: dict, least: int) -> Iterator[tuple[int, int, int]]:
    """(first place, distance, common words) of the maximal pairs no further apart than they are long.

    ``places`` in the order of their suffixes, ``common[k]`` the words that place k shares with the one before it.
    """
    open_: list[tuple[int, Places]] = []

    def meet(one: Places, two: Places, h: int) -> Iterator[tuple[int, int, int]]:
        large, small = (one, two) if len(one.all) >= len(two.all) else (two, one)
        for place in small.all:
            for other in large.differing(place, h, left):
                distance = abs(place - other)
                if distance + h >= least:
                    yield min(place, other), distance, h
        large.take(small, left)
        return large

    current = Places(places[0])
    for k in range(1, len(places) + 1):
        h = common[k] if k < len(places) else 0
        while open_ and open_[-1][0] > h:
            deep, held = open_.pop()
            current = yield from meet(held, current, deep)
        if k == len(places):
            return
        if open_ and open_[-1][0] == h:
            open_[-1] = (h, (yield from meet(open_[-1][1], current, h)))
        else:
            open_.append((h, current))
        current = Places(places[k])


def runs_of_block(words: np.ndarray, row: np.ndarray, least: int, rolling: Rolling) -> dict[int, list[tuple[int, int, int]]]:
    """row -> (start in the block, length, smallest period) of all its runs, by start and period."""
    width = (least + 1) // 2
    kept = np.flatnonzero(rows_with_repeats(words, row, width, rolling))
    if not len(kept):
        return {}
    words, row = words[kept], row[kept]
    order, common = suffix_order(words, row)
    # Top intervals of at least ``width`` common words, each with the place before its first common prefix.
    deep = common >= width
    inside = deep | np.r_[deep[1:], False]
    at = np.flatnonzero(inside)
    if not len(at):
        return {}
    head = np.flatnonzero(~deep[at])
    bounds = np.r_[head, len(at)]
    # An interval whose places are all further apart than any two of them have in common holds no run.
    group = np.repeat(np.arange(len(head)), np.diff(bounds))
    places = order[at]
    by_place = np.lexsort((places, group))
    gaps = np.diff(places[by_place], prepend=0)
    gaps[head] = len(words)
    near = np.minimum.reduceat(gaps, head) <= np.maximum.reduceat(np.where(deep[at], common[at], 0), head)
    found: dict[int, dict[tuple[int, int], int]] = {}
    for g in np.flatnonzero(near):
        here = places[bounds[g] : bounds[g + 1]]
        before = np.maximum(here - 1, 0)
        inner = (here > 0) & (row[before] == row[here])
        left = dict(zip(here.tolist(), np.where(inner, words[before], -1).tolist()))
        of = found.setdefault(int(row[here[0]]), {})
        for start, distance, h in close_pairs(here.tolist(), common[at[bounds[g] : bounds[g + 1]]].tolist(), left, least):
            key = (int(kept[start]), distance + h)
            of[key] = min(distance, of.get(key, distance))
    return {r: sorted(((s, n, q) for (s, n), q in of.items()), key=lambda x: (x[0], x[2])) for r, of in found.items() if of}


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``runs`` (start, length, period in words), ``n_dropped``, ``text``.

    A run is a stretch of at least ``least`` words and at least two periods, that no neighbouring word extends with its
    smallest period. Runs come by start, then period. ``text`` holds the words that lie behind the first period of no
    run, joined by one space. NULL and blank texts have no words, no runs and an empty text. Words are bytes between
    ASCII white space, unchanged. Every row stands for itself, whatever its id; other columns are not read. No rows in,
    no rows out.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(41)
        for batch in batches:
            n_words, runs, dropped, texts = [], [], [], []
            for _, _, data, bounds in byte_blocks(batch.column(1)):
                start, end, row = word_spans(data, bounds)
                size = np.bincount(row, minlength=len(bounds) - 1)
                first = np.r_[0, np.cumsum(size)].tolist()
                found = runs_of_block(word_numbers(data, start, end), row, least, rolling) if len(row) >= least else {}
                raw, bounds = data.tobytes(), bounds.tolist()
                for r in range(len(size)):
                    words = raw[bounds[r] : bounds[r + 1]].split()
                    own = [(s - first[r], n, q) for s, n, q in found.get(r, ())]
                    n_words.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    kept, at = [], 0
                    for a, b in merged_spans([(s + q, s + n) for s, n, q in own]):
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    dropped.append(len(words) - len(kept))
                    texts.append(b" ".join(kept))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(runs, run_type), pa.array(dropped, pa.int64())]
            columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "n_dropped", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, n_dropped long, text string"
    return rows.mapInArrow(find, schema)
