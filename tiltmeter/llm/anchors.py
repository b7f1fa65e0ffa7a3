"""Winnowed anchors: every window of a text picks the smallest fingerprint of its grams, equal windows pick alike.

The windows of a document that pick the same gram follow one another. They form a slice: ``n`` windows from a word or
byte on. Two equal windows lie in slices with the same anchor, so windows need only be compared inside anchors, and
equal slices only once. A window is never cut and lies in exactly one slice. Equal slices of one document (a period
repeated thousands of times makes thousands) are one row with all their ``starts``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.common import Rolling, as_long, byte_blocks, short_batches, sliding_argmin, text_column, word_hashes, word_spans, written

WORD_SEED, GRAM_SEED, SLICE_SEED = 11, 12, 13
SLICES = "doc_id {id}, text_key long, anchor long, slice long, starts array<int>, n int"


class Symbols:
    """The symbols of a block of rows, their bounds by row, and the prefix sums that fingerprint any run of them."""

    def __init__(self, unit: str) -> None:
        self.unit = unit
        self.words, self.grams, self.slices = Rolling(WORD_SEED), Rolling(GRAM_SEED), Rolling(SLICE_SEED)

    def of(self, data: np.ndarray, bounds: np.ndarray):
        if self.unit == "byte":
            return bounds, self.grams.table[data], self.slices.table[data], None
        spans = word_spans(data, bounds)
        values = word_hashes(data, spans, self.words)
        return np.searchsorted(spans[2], np.arange(len(bounds))), values, values, spans


def slices_of_block(symbols: Symbols, data, bounds, window: int, gram: int):
    """(row, start, n, anchor, slice fingerprint) of all slices of a block."""
    rows, gram_symbols, slice_symbols, _ = symbols.of(data, bounds)
    n = len(gram_symbols)
    if n < window:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty, empty
    grams = symbols.grams.every(symbols.grams.prefix(gram_symbols), gram)
    bits = np.uint64(max(20, int(n).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    keys = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
    picked = mask - (sliding_argmin(keys, window - gram + 1) & mask)
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[: len(picked)]
    fits = np.arange(len(picked)) + window <= rows[row_of + 1]
    at = np.flatnonzero(fits)
    if not len(at):
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty, empty
    picked, row_of = picked[at].astype(np.int64), row_of[at]
    new = np.flatnonzero(np.r_[True, (picked[1:] != picked[:-1]) | (row_of[1:] != row_of[:-1])])
    start, n_windows = at[new], np.diff(np.r_[new, len(at)])
    prints = symbols.slices.runs(symbols.slices.prefix(slice_symbols), start, start + n_windows - 1 + window)
    return row_of[new], start - rows[row_of[new]], n_windows, as_long(grams[picked[new]]), as_long(prints)


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, text: rows that repeat an id stay apart by their text."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def slice_table(rows: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """All slices of the rows of ``keyed_text``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(unit)
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for first, _, data, bounds in byte_blocks(batch.column(2)):
                row, start, n, anchor, prints = slices_of_block(symbols, data, bounds, window, gram)
                if len(row):
                    order = np.lexsort((start, prints, anchor, row))
                    row, start, n, anchor, prints = (x[order] for x in (row, start, n, anchor, prints))
                    new = np.r_[True, (prints[1:] != prints[:-1]) | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]
                    head = np.flatnonzero(new)
                    starts = pa.ListArray.from_arrays(pa.array(np.r_[head, len(row)].astype(np.int32)), pa.array(start.astype(np.int32)))
                    take = pa.array(row[head] + first)
                    columns = [ids.take(take), keys.take(take), pa.array(anchor[head]), pa.array(prints[head])]
                    columns += [starts, pa.array(n[head].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "anchor", "slice", "starts", "n"])

    return rows.mapInArrow(cut, SLICES.format(id=rows.schema["doc_id"].dataType.simpleString()))


def text_of_slices(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text_key, text, cuts: the rows that hold wanted slices, with those of each row in one list.

    ``wanted`` has doc_id, text_key and a struct ``cut``. A row's list is at most as long as its text.
    """
    lists = wanted.groupBy("doc_id", "text_key").agg(F.collect_list("cut").alias("cuts"))
    return join_on_row(rows, lists)


def join_on_row(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the id (NULL meets NULL) and the key of the text."""
    other = other.withColumnRenamed("doc_id", "__id").withColumnRenamed("text_key", "__key")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    return rows.join(other, same, how).drop("__id", "__key")


def shared_slices(slices: DataFrame) -> DataFrame:
    """Distinct slices of the anchors that occur more than once, kept in the shared folder.

    anchor, slice, n, members (slices equal to it), low (the member with the smallest id), slices (distinct ones of
    the anchor). Equal slices are added up before they move, so copies and common passages cost one row per task.
    """
    low = F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "text_key", F.col("starts")[0].alias("start"))
    distinct = slices.groupBy("anchor", "slice").agg(F.max("n").alias("n"), F.sum(F.size("starts")).alias("members"), F.min(low).alias("low"))
    anchors = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("slices"), F.sum("members").alias("all"))
    # Written, so that the join finds two shuffled sides and an anchor of very many slices can be split.
    anchors = written(anchors.where(F.col("all") > 1).drop("all"))
    return written(distinct.join(anchors, "anchor"))


def in_runs(batches: Iterator[pa.RecordBatch], key: str, weigh: Callable[[pa.Table], np.ndarray], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by a BIGINT key, each of about ``most`` by weight or of one group."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        held.append(batch)
        weight += int(weigh(pa.Table.from_batches([batch])).sum())
        if weight < most:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key).to_numpy()
        last = int(np.searchsorted(keys == keys[-1], True)) if len(keys) else 0
        yield from _cut(whole.slice(0, last), key, weigh, most)
        held = whole.slice(last).to_batches()
        weight = sum(int(weigh(pa.Table.from_batches([b])).sum()) for b in held)
    if held:
        yield from _cut(pa.Table.from_batches(held), key, weigh, most)


def _cut(whole: pa.Table, key: str, weigh, most: int) -> Iterator[pa.Table]:
    if not whole.num_rows:
        return
    keys = whole.column(key).to_numpy()
    firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    totals = np.cumsum(weigh(whole))[np.r_[firsts[1:] - 1, len(keys) - 1]]
    a, done = 0, 0
    while a < len(keys):
        group = int(np.searchsorted(totals, done + most, side="left"))
        b = int(firsts[group + 1]) if group + 1 < len(firsts) else len(keys)
        yield whole.slice(a, b - a).combine_chunks()
        a, done = b, int(totals[min(group, len(totals) - 1)])
