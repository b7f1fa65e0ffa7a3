"""Suffix-array deduplication: bytes inside a string of 400 bytes that starts anywhere else are removed.

1. Windows of 400 bytes pick anchors (grams of 100 bytes); slices of windows with one anchor meet in one shard. Equal
   strings of 400 bytes pick alike, so no match is lost between shards. Equal slices collapse to one with its count.
2. The distinct slices of each anchor that occurs more than once are joined to the text of one holder and put one after
   the other. A shard sorts the suffixes of a run of whole anchors by induced sorting and finds the strings that occur
   twice from permuted common prefixes.
3. Positions go back to all documents that hold the slice; spans that overlap or touch merge.

An anchor with too many distinct slices for one shard is taken apart: its windows are counted by two fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.anchors import GRAM_SEED, SLICE_SEED, in_runs, join_on_row, keyed_text, shared_slices, slice_table, text_of_slices
from tiltmeter.llm.common import Rolling, as_long, byte_blocks, written
from tiltmeter.llm.passages import merged_spans
from tiltmeter.llm.suffixes import END, repeated_starts

WINDOW_BYTES = 400
GRAM_BYTES = 100
#: Bytes sorted at once; an anchor is never split.
SHARD_BYTES = 3 << 20
#: Distinct slices of an anchor that a shard takes (a slice has fewer bytes than two windows).
ANCHOR_SLICES = 8192


def slice_bytes(held: DataFrame, window: int) -> DataFrame:
    """anchor, slice, members, piece: the bytes of each wanted slice, cut from the text of its holder."""
    schema = "anchor long, slice long, members long, piece binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, cuts in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
                raw = raw.as_py()
                for c in cuts:
                    out.append((c["anchor"], c["slice"], c["members"], raw[c["start"] : c["start"] + c["n"] - 1 + window]))
                if len(out) >= 4096:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["anchor", "slice", "members", "piece"])

    return held.select("text", "cuts").mapInArrow(cut, schema)


def shard_repeats(pieces: DataFrame, window: int) -> DataFrame:
    """anchor, slice, runs (at, n): windows of a slice that occur elsewhere in the shard."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = lambda t: np.diff(_bounds(t)) if t.num_rows else np.zeros(0, np.int64)
        for run in in_runs(batches, "anchor", weigh, SHARD_BYTES):
            _, _, data, bounds = next(byte_blocks(run.column("piece"), 1 << 62))
            sizes = np.diff(bounds)
            starts = bounds[:-1] + np.arange(len(sizes))
            text = np.full(len(data) + len(sizes), END, dtype=np.uint8)
            place = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
            text[place] = data + 1
            row = np.repeat(np.arange(len(sizes)), sizes + 1)
            room = starts[row] + sizes[row] - np.arange(len(text))
            hit = np.flatnonzero(repeated_starts(text, room, window))
            if not len(hit):
                continue
            head = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (row[hit][1:] != row[hit][:-1])])
            n, at, of = np.diff(np.r_[head, len(hit)]), hit[head] - starts[row[hit[head]]], row[hit[head]]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            values = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["at", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(of)].astype(np.int32)), values)
            rows = pa.array(of[first])
            yield pa.RecordBatch.from_arrays([run.column("anchor").combine_chunks().take(rows), run.column("slice").combine_chunks().take(rows), lists], names=["anchor", "slice", "runs"])

    dealt = pieces.select("anchor", "slice", "piece").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(sort, "anchor long, slice long, runs array<struct<at: int, n: int>>")


def _bounds(t: pa.Table) -> np.ndarray:
    sizes = pc.binary_length(t.column("piece")).to_numpy()
    return np.r_[0, np.cumsum(sizes)]


def counted_repeats(pieces: DataFrame, window: int) -> DataFrame:
    """The same for anchors too large for a shard: windows are counted by anchor and two fingerprints."""
    schema = "anchor long, slice long, members long, at int, p1 long, p2 long"

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(GRAM_SEED), Rolling(SLICE_SEED)
        for batch in batches:
            for first, end, data, bounds in byte_blocks(batch.column(3)):
                prints = [r.every(r.prefix(r.table[data]), window) for r in (one, two)]
                row = np.repeat(np.arange(end - first), np.diff(bounds) - window + 1)
                at = np.arange(len(row)) - np.repeat(np.cumsum(np.diff(bounds) - window + 1) - (np.diff(bounds) - window + 1), np.diff(bounds) - window + 1)
                spot = bounds[row] + at
                take = pa.array(row + first)
                columns = [batch.column(i).take(take) for i in range(3)]
                columns += [pa.array(at.astype(np.int32)), pa.array(as_long(prints[0][spot])), pa.array(as_long(prints[1][spot]))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "slice", "members", "at", "p1", "p2"])

    rows = pieces.select("anchor", "slice", "members", "piece").mapInArrow(explode, schema)
    often = rows.groupBy("anchor", "p1", "p2").agg(F.sum("members").alias("times")).where("times > 1").drop("times")
    hits = rows.join(often, ["anchor", "p1", "p2"])
    run = F.struct(F.col("at"), F.lit(1).alias("n"))
    return hits.groupBy("anchor", "slice").agg(F.collect_list(run).alias("runs"))


def repeated_windows(docs: DataFrame, window: int = WINDOW_BYTES, gram: int = GRAM_BYTES, id_col: str = "doc_id", text_col: str = "text", anchor_slices: int = ANCHOR_SLICES) -> DataFrame:
    """doc_id, text_key, runs (first window, windows): the windows of each document that also start elsewhere."""
    rows = keyed_text(docs, id_col, text_col)
    slices = written(slice_table(rows, "byte", window, gram))
    shared = shared_slices(slices)
    cut = F.struct(F.col("low.start").alias("start"), "n", "anchor", "slice", "members", (F.col("slices") > anchor_slices).alias("hot"))
    wanted = shared.select(F.col("low.doc_id").alias("doc_id"), F.col("low.text_key").alias("text_key"), cut.alias("cut"))
    found = shard_repeats(slice_bytes(text_of_slices(rows, wanted.where("not cut.hot")), window), window)
    hot = wanted.where("cut.hot")
    if not hot.isEmpty():
        found = found.unionByName(counted_repeats(slice_bytes(text_of_slices(rows, hot), window), window))
    found = found.groupBy("anchor", "slice").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    known = shared.select("anchor", "slice", "members").join(found, ["anchor", "slice"], "left")
    known = written(known.where((F.col("members") > 1) | F.col("runs").isNotNull()))
    whole = F.transform("starts", lambda s: F.struct(s.alias("at"), F.col("n").alias("n")))
    some = F.flatten(F.transform("starts", lambda s: F.transform("runs", lambda r: F.struct((s + r["at"]).alias("at"), r["n"].alias("n")))))
    hits = slices.join(known, ["anchor", "slice"])
    hits = hits.select("doc_id", "text_key", F.when(F.col("members") > 1, whole).otherwise(some).alias("hit"))
    return hits.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("hit")).alias("runs"))


def remove_substrings(docs: DataFrame, window: int = WINDOW_BYTES, gram: int = GRAM_BYTES, id_col: str = "doc_id", text_col: str = "text", anchor_slices: int = ANCHOR_SLICES) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (start, length in bytes), ``kept``.

    A byte goes if it lies in a string of ``window`` bytes that starts at any other place of any row, the same one
    included; all rows are judged as they came in. ``spans`` are the maximal removed runs and ``kept`` the bytes that
    stay (which may end inside a character). NULL text is empty. Rows with equal id and text are repeats of each other
    like any two rows. Texts shorter than the window lose nothing. Other columns are not read. No rows in, none out.
    """
    rows = keyed_text(docs, id_col, text_col)
    runs = repeated_windows(docs, window, gram, id_col, text_col, anchor_slices)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start: long, length: long>>, kept binary"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, spans, texts = [], [], [], []
            for raw, hits in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                merged = merged_spans([(h["at"], h["at"] + h["n"] - 1 + window) for h in hits or ()])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                texts.append(b"".join(kept))
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(texts[-1]))
                spans.append([{"start": a, "length": b - a} for a, b in merged])
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span_type), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return join_on_row(rows, runs, "left").select("doc_id", "text", "runs").mapInArrow(cut, schema)
