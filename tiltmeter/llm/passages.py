"""Substring deduplication by seeds: documents meet on winnowed anchors, matches are extended to whole windows.

1. Seed. Every window of 50 words picks one of its 12-word grams; the windows that pick the same gram form a slice.
   Slices of all documents are joined on their anchor. Equal slices collapse to one with its smallest document.
2. Extend. Where an anchor has several slices, each is extended from the anchor both ways, by every number of words to
   the left for which the whole reaches the window length. Extensions of one anchor are compared by their fingerprints,
   never pair by pair, so an anchor shared by many documents costs no more than its rows.
3. Keep. Windows that also start in a smaller document are repeats; those that touch merge to maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.anchors import Symbols, in_runs, join_on_row, keyed_text, shared_slices, slice_table, text_of_slices
from tiltmeter.llm.common import byte_blocks, written

WINDOW_WORDS = 50
GRAM_WORDS = 12
#: Stands for a NULL id, which comes after all others.
LAST = (1 << 63) - 1
#: Slices of one anchor compared in one place; the extensions of larger ones are dealt out by their fingerprints.
ANCHOR_SLICES = 4096
#: Slices whose extensions are sorted at once.
SORTED_SLICES = 1 << 14


def extensions(held: DataFrame, window: int) -> DataFrame:
    """anchor, part, slice, ord, windows, prints: the windows of each slice, the larger anchors dealt out by print."""
    schema = "anchor long, part long, slice long, ord long, windows binary, prints binary"

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols("word")
        for batch in batches:
            cuts = batch.column(1)
            for first, end, data, bounds in byte_blocks(batch.column(0)):
                rows, _, values, _ = symbols.of(data, bounds)
                every = symbols.slices.every(symbols.slices.prefix(values), window) if len(values) >= window else None
                out = []
                for i, row in enumerate(cuts.slice(first, end - first).to_pylist()):
                    for cut in row:
                        at = rows[i] + cut["start"]
                        prints = every[at : at + cut["n"]]
                        part = prints % np.uint64(cut["parts"])
                        for p in np.unique(part) if cut["parts"] > 1 else (0,):
                            mine = np.flatnonzero(part == p) if cut["parts"] > 1 else np.arange(cut["n"])
                            out.append((cut["anchor"], int(p), cut["slice"], cut["ord"], mine.astype(np.int32).tobytes(), prints[mine].tobytes()))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                    columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "part", "slice", "ord", "windows", "prints"])

    return held.select("text", "cuts").mapInArrow(extend, schema)


def repeated_extensions(extended: DataFrame) -> DataFrame:
    """anchor, slice, windows: the windows of a slice that also occur in a slice of the anchor with a smaller ``ord``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in in_runs(batches, "dealt", lambda t: np.ones(t.num_rows, np.int64), SORTED_SLICES):
            windows = [np.frombuffer(b, dtype=np.int32) for b in run.column("windows").to_pylist()]
            row = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
            prints = np.frombuffer(b"".join(run.column("prints").to_pylist()), dtype=np.uint64)
            anchor, order = run.column("anchor").to_numpy()[row], run.column("ord").to_numpy()[row]
            sort = np.lexsort((order, prints, anchor))
            new = np.r_[True, (prints[sort][1:] != prints[sort][:-1]) | (anchor[sort][1:] != anchor[sort][:-1])]
            lowest = order[sort][np.flatnonzero(new)][np.cumsum(new) - 1]
            again = np.zeros(len(sort), dtype=bool)
            again[sort] = order[sort] > lowest
            window = np.concatenate(windows) if windows else np.empty(0, np.int32)
            hit = np.flatnonzero(again)
            if len(hit):
                at = np.flatnonzero(np.r_[True, row[hit][1:] != row[hit][:-1]])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(hit)].astype(np.int32)), pa.array(window[hit]))
                rows = pa.array(row[hit][at])
                yield pa.RecordBatch.from_arrays(
                    [run.column("anchor").combine_chunks().take(rows), run.column("slice").combine_chunks().take(rows), lists],
                    names=["anchor", "slice", "windows"],
                )

    # Parts of a large anchor are runs of their own, also where several of them come to one task.
    dealt = extended.withColumn("dealt", F.xxhash64("anchor", "part")).repartition("anchor", "part").sortWithinPartitions("dealt")
    return dealt.mapInArrow(compare, "anchor long, slice long, windows array<int>")


def repeated_windows(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, id_col: str = "doc_id", text_col: str = "text", anchor_slices: int = ANCHOR_SLICES) -> DataFrame:
    """doc_id, text_key, runs: per document the runs (first window, windows) that also start in a smaller document."""
    rows = keyed_text(docs, id_col, text_col)
    slices = written(slice_table(rows, "word", window, gram))
    shared = shared_slices(slices)
    # Anchors with one slice need no extension: that slice is the whole match.
    wanted = shared.where("slices > 1").select(
        F.col("low.doc_id").alias("doc_id"),
        F.col("low.text_key").alias("text_key"),
        F.struct(
            F.col("low.start").alias("start"),
            "n",
            "anchor",
            "slice",
            F.coalesce(F.col("low.doc_id").cast("long"), F.lit(LAST)).alias("ord"),
            F.ceil(F.col("slices") / anchor_slices).alias("parts"),
        ).alias("cut"),
    )
    again = repeated_extensions(extensions(text_of_slices(rows, wanted), window))
    again = again.groupBy("anchor", "slice").agg(F.flatten(F.collect_list("windows")).alias("windows"))
    known = shared.select("anchor", "slice", "members", F.col("low.doc_id").alias("low_id")).join(again, ["anchor", "slice"], "left")
    known = written(known.where((F.col("members") > 1) | F.col("windows").isNotNull()))
    later = (F.col("doc_id") > F.col("low_id")) | (F.col("doc_id").isNull() & F.col("low_id").isNotNull())
    whole = F.transform("starts", lambda s: F.struct(s.alias("at"), F.col("n").alias("n")))
    single = F.flatten(F.transform("starts", lambda s: F.transform("windows", lambda w: F.struct((s + w).alias("at"), F.lit(1).alias("n")))))
    hits = slices.join(known, ["anchor", "slice"]).select("doc_id", "text_key", F.when(later, whole).otherwise(single).alias("hit"))
    hits = hits.where(F.col("hit").isNotNull())
    return hits.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("hit")).alias("runs"))


def remove_passages(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, id_col: str = "doc_id", text_col: str = "text", anchor_slices: int = ANCHOR_SLICES) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_removed``, ``spans`` (start, length in words), ``text``.

    ``text`` holds the words that stay, joined by one space; ``spans`` are the maximal repeats that were taken out.
    NULL and blank texts have no words and an empty text. A text of fewer words than a window loses nothing. NULL ids
    come after all others. Rows that repeat an id are not repeats of each other. Words are bytes between ASCII white
    space, unchanged. Other columns are not read. No rows in, no rows out.
    """
    rows = keyed_text(docs, id_col, text_col)
    runs = repeated_windows(docs, window, gram, id_col, text_col, anchor_slices)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start: long, length: long>>, text string"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, spans, texts = [], [], [], []
            for raw, hits in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                words = raw.split()
                merged = merged_spans([(h["at"], h["at"] + h["n"] - 1 + window) for h in hits or ()])
                kept, at = [], 0
                for a, b in merged:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                spans.append([{"start": a, "length": b - a} for a, b in merged])
                texts.append(b" ".join(kept))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span_type)]
            columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "spans", "text"])

    return join_on_row(rows, runs, "left").select("doc_id", "text", "runs").mapInArrow(cut, schema)


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ordered spans, those that overlap or touch merged."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
