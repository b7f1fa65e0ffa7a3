"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The items are dealt into shards of a bounded number of words; a shard travels to the tasks, which build its automaton
and stream the documents through it. The state after a word stands for the longest string that ends there and occurs
in an item; the windows that end there hang on the states up its links. Only stretches of words whose neighbours are
also neighbours in an item are walked, which leaves nothing out: outside them no string of two words matches.

Usual test sets are one shard. Each further one is a further pass over the documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.automaton import Matcher
from tiltmeter.llm.common import Rolling, byte_blocks, lowered, short_batches, text_column, word_hashes, word_spans, written
from tiltmeter.llm.passages import merged_spans

WINDOW_WORDS = 10
#: Words of the items whose automaton a task holds.
SHARD_WORDS = 1 << 17
#: Longer items are cut into pieces that overlap by a window less a word.
PIECE_WORDS = 4096
#: Words of a normalised text; what is left of ASCII stands between them.
ITEM_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_BETWEEN[0x41:0x5B] = False  # lower case by then
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Bits:
    """A set of fingerprints that may have false members and misses none."""

    def __init__(self, prints: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(16, (64 * len(prints)).bit_length()))
        self.at = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.at[prints >> self.shift] = True

    def has(self, prints: np.ndarray) -> np.ndarray:
        return self.at[prints >> self.shift]


class Scanner:
    """Finds the windows of some items, given as words joined by a space, in blocks of documents."""

    def __init__(self, items: list[bytes], window: int) -> None:
        self.rolling, self.pairs = Rolling(51), Rolling(52)
        numbers: dict[bytes, int] = {}
        strings = [[numbers.setdefault(w, len(numbers)) for w in item.split()] for item in items]
        self.numbers, self.matcher = numbers, Matcher(strings, window)
        self.shortest = min((min(window, len(s)) for s in strings if len(s) > 1), default=0)
        joined, alone = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for _, _, data, bounds in byte_blocks(pa.array(items, pa.binary())):
            (_, _, row), words = self._words(data, bounds)
            if len(words) > 1:
                joined.append(self._pairs(words)[row[1:] == row[:-1]])
            alone.append(words[np.bincount(row, minlength=len(bounds) - 1)[row] == 1])
        self.joined, self.alone = Bits(np.concatenate(joined)), Bits(np.concatenate(alone))

    def _words(self, data, bounds):
        spans = word_spans(data, bounds, _BETWEEN)
        return spans, word_hashes(data, spans, self.rolling, lower=True)

    def _pairs(self, words: np.ndarray) -> np.ndarray:
        return self.pairs.every(self.pairs.prefix(words), 2)

    def hits(self, data: np.ndarray, bounds: np.ndarray):
        """Word spans, and row -> [(first word in the block, behind the last, items)] of the windows in it."""
        spans, words = self._words(data, bounds)
        start, end, row = spans
        found: dict[int, list[tuple[int, int, list[int]]]] = {}
        if not len(words):
            return spans, found
        marked = self.alone.has(words)
        if len(words) > 1 and self.shortest:
            linked = self.joined.has(self._pairs(words)) & (row[1:] == row[:-1])
            edge = np.flatnonzero(np.diff(np.r_[False, linked, False]))
            first, last = edge[::2], edge[1::2]
            long = last - first + 1 >= self.shortest
            step = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(step, first[long], 1)
            np.add.at(step, last[long] + 1, -1)
            marked |= np.cumsum(step)[:-1] > 0
        at = np.flatnonzero(marked)
        if not len(at):
            return spans, found
        head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])])
        low = lowered(data).tobytes()
        for a, b in zip(at[head].tolist(), (at[np.r_[head[1:] - 1, len(at) - 1]] + 1).tolist()):
            known = [self.numbers.get(low[s:e], -1) for s, e in zip(start[a:b].tolist(), end[a:b].tolist())]
            for behind, length, items in self.matcher.matches(known):
                found.setdefault(int(row[a]), []).append((a + behind - length, a + behind, items))
        return spans, found


def item_pieces(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """item, words, bucket: normalised items in pieces of bounded length, each once."""
    text = F.translate(text_column(items, text_col), UPPER, LOWER)
    words = items.select(F.col(id_col).alias("item"), F.regexp_extract_all(text, F.lit(ITEM_PATTERN), F.lit(0)).alias("words")).distinct()
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)), F.lit(PIECE_WORDS)))
    pieces = words.where(F.size("words") > 0).select("item", "words", first.alias("first"))
    return pieces.select("item", F.slice("words", F.col("first"), F.lit(PIECE_WORDS + window - 1)).alias("words"), F.xxhash64("item", "words", "first").alias("key"))


def shards(items: DataFrame, window: int, id_col: str, text_col: str, shard_words: int) -> Iterator[tuple[list, list[bytes]]]:
    """(item ids, their words joined by a space) by shards of at most about ``shard_words`` words."""
    pieces = written(item_pieces(items, window, id_col, text_col))
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    buckets = max(1, -(-16 * total // shard_words))
    bucket = F.pmod("key", F.lit(buckets))
    sizes = pieces.groupBy(bucket.alias("b")).agg(F.sum(F.size("words")).alias("n")).orderBy("b").collect()
    runs, held = [], 0
    for b, n in sizes:
        if not runs or held + n > shard_words:
            runs.append([b, b])
            held = 0
        runs[-1][1], held = b, held + n
    for low, high in runs or [[0, 0]]:
        part = pieces.where(bucket.between(low, high)).select("item", F.array_join("words", " ").alias("text")).toArrow()
        yield part.column("item").to_pylist(), [t.encode() for t in part.column("text").to_pylist()]


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW_WORDS,
    most_covered: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit``, ``items``, ``spans`` (start, length in words),
    ``dropped``, ``text``.

    Texts are compared in lower case (A to Z), as words of letters, digits and anything beyond ASCII. ``window``
    consecutive words of an item, or all of a shorter one, are a window; a word of a document inside any occurrence of
    a window is hit. ``items`` are the ids of the items with such windows, each once and in order. ``spans`` are the
    maximal stretches of hit words and ``text`` the text without them, from the first character of the first word to
    the last of the last one; nothing else changes. ``dropped`` tells that more than ``most_covered`` of the words are
    hit, so that the document should go as a whole.

    NULL and wordless texts are not hit, and a NULL text stays NULL. Items without a word have no window. Items with a
    NULL id are found but not listed. Equal items are listed by each of their ids. Every row of the documents stands for
    itself; other columns are not read. No documents, no rows; no items, no hits.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    item_type = items.schema[item_col].dataType.simpleString()
    share = docs.sparkSession.sparkContext.broadcast
    held = None
    for shard in shards(items, window, item_col, item_text, shard_words):
        if held is not None:
            rows = written(scanned(rows, held, window, item_type))
        held = share(shard)
    return cut(rows, held, window, item_type, most_covered)


def found_in(batches: Iterator[pa.RecordBatch], held: Broadcast, window: int):
    """(batch, words by row, bytes and word bounds by hit row, spans and items by hit row), with those of earlier passes."""
    ids, texts = held.value
    scanner = Scanner(texts, window)
    for batch in batches:
        n_words, places, spans, items = [], {}, {}, {}
        for first, end, data, bounds in byte_blocks(batch.column(1)):
            (start, stop, row), hits = scanner.hits(data, bounds)
            n_words += np.bincount(row, minlength=end - first).tolist()
            head = np.searchsorted(row, np.arange(end - first + 1))
            for r, found in hits.items():
                spans[first + r] = merged_spans([(a - int(head[r]), b - int(head[r])) for a, b, _ in found])
                items[first + r] = {ids[i] for _, _, own in found for i in own}
            if batch.num_columns > 2:
                hits = range(end - first)
            for r in hits:
                mine = slice(int(head[r]), int(head[r + 1]))
                places[first + r] = (start[mine] - bounds[r], stop[mine] - bounds[r])
        if batch.num_columns > 2:
            for r, (old_spans, old_items) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if old_spans:
                    spans[r] = merged_spans([(s["start"], s["start"] + s["length"]) for s in old_spans] + spans.get(r, []))
                    items[r] = items.get(r, set()) | set(old_items)
        yield batch, n_words, places, spans, items


def _lists(count: int, spans: dict, items: dict, item_type: pa.DataType) -> list[pa.Array]:
    known = lambda r: sorted(i for i in items.get(r, ()) if i is not None)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    listed = [[{"start": a, "length": b - a} for a, b in spans.get(r, ())] for r in range(count)]
    return [pa.array(listed, span_type), pa.array([known(r) for r in range(count)], pa.list_(item_type))]


SPANS = "array<struct<start: long, length: long>>"


def scanned(rows: DataFrame, held: Broadcast, window: int, item_type: str) -> DataFrame:
    """doc_id, text, spans, items with what the items of one shard add."""
    empty = rows.sparkSession.createDataFrame([], f"i {item_type}").toArrow().schema.field("i").type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, spans, items in found_in(batches, held, window):
            columns = [batch.column(0), batch.column(1), *_lists(batch.num_rows, spans, items, empty)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "spans", "items"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, text string, spans {SPANS}, items array<{item_type}>")


def cut(rows: DataFrame, held: Broadcast, window: int, item_type: str, most_covered: float) -> DataFrame:
    """The last pass: the spans of all shards are taken out of the texts."""
    empty = rows.sparkSession.createDataFrame([], f"i {item_type}").toArrow().schema.field("i").type

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n_words, places, spans, items in found_in(batches, held, window):
            texts, n_hit = batch.column(1), [0] * batch.num_rows
            if spans:
                raws = texts.cast(pa.binary()).to_pylist()
                for r, own in spans.items():
                    (start, stop), raw, at, kept = places[r], raws[r], 0, []
                    for a, b in own:
                        kept.append(raw[at : int(start[a])])
                        at = int(stop[b - 1])
                        n_hit[r] += b - a
                    raws[r] = b"".join([*kept, raw[at:]])
                texts = pa.array(raws, pa.binary()).cast(pa.string())
            dropped = [h > most_covered * n for h, n in zip(n_hit, n_words)]
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())]
            listed = _lists(batch.num_rows, spans, items, empty)
            columns += [listed[1], listed[0], pa.array(dropped, pa.bool_()), texts]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "items", "spans", "dropped", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, items array<{item_type}>, spans {SPANS}, dropped boolean, text string"
    return rows.mapInArrow(finish, schema)
