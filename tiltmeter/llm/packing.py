"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenised, closed by an end id and cut where they are longer than a sequence. Pieces shorter than a
sequence are dealt to blocks of bounded size. Several islands evolve packings of one block from their own seeds. A
child takes one parent, receives whole well-filled bins of the other, loses every bin that would hold a piece twice,
and best-fits the displaced pieces, largest first. After each epoch the elites of all islands of a block migrate to
each of them. Bins of all blocks that stay poorly filled are dissolved and packed once more in blocks of their own.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.common import byte_blocks, short_batches, text_column, written

CAPACITY = 4096
END_ID = 1
#: Pieces of a block, about; islands of a block; epochs between migrations; children of an epoch; packings kept.
BLOCK_PIECES = 1024
ISLANDS = 2
EPOCHS = 2
CHILDREN = 24
POPULATION = 5
#: Bins filled less than this are dissolved after the first round.
WELL_FILLED = 0.98
#: Words of a generation whose ids a worker remembers.
REMEMBERED = 300_000
STOPS = b",."
#: What tokens at the end of a word end with, and words that are coded in one call.
WORD_END = "</w>"
CODED_WORDS = 512


# ---------------------------------------------------------------- tokens


class WordIds:
    """Ids of texts from the ids of their words; words between ASCII white space never share a token.

    The tokenizer lower-cases, so words are looked up in lower case, and letters never share a token with punctuation,
    so a word with a comma or full stop behind it has the ids of both. Only what is left is new to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def learn(self, words: set[bytes]) -> None:
        """Make all words known. Words not met for a while are forgotten: only two generations are remembered."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older, ends, plain = self.known, self.older, {}, {}
        # No set operations with the tables: those would walk through the whole of them.
        for word in words:
            if word in known:
                continue
            ids = older.get(word)
            if ids is not None:
                known[word] = ids
            elif word[-1] in STOPS and word[-2:-1].isalnum():
                ends[word] = stem = word[:-1]
                if stem not in known:
                    plain[stem] = None
            else:
                plain[word] = None
        for stop in (b",", b"."):
            if stop not in known:
                plain[stop] = None
        letters = [w for w in plain if w.decode().isalpha()]
        others = [w for w in plain if not w.decode().isalpha()]
        for some in (letters[at : at + CODED_WORDS] for at in range(0, len(letters), CODED_WORDS)):
            if not self._code_letters(some):
                self._code(some)
        for some in (others[at : at + CODED_WORDS] for at in range(0, len(others), CODED_WORDS)):
            self._code(some)
        known.update((word, known[stem] + known[word[-1:]]) for word, stem in ends.items())

    def _code_letters(self, words: list[bytes]) -> bool:
        """Learn words of letters only: each ends with its only id that stands for the end of a word."""
        text = b" ".join(words).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * (np.flatnonzero(self.closing[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return False
        raw = ids.tobytes()
        self.known.update((w, raw[a:b]) for w, a, b in zip(words, [0, *ends[:-1]], ends))
        return True

    def _code(self, words: list[bytes]) -> None:
        """Learn any words, told apart by where their tokens start."""
        some = [w.decode() for w in words]
        coded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
        raw = np.array(coded.ids, dtype="<u4").tobytes()
        starts = np.array([start for start, _ in coded.offsets], dtype=np.int64)
        begins = np.cumsum([0, *(len(w) + 1 for w in some)])
        cuts = (4 * np.searchsorted(starts, begins)).tolist()
        self.known.update((w, raw[a:b]) for w, a, b in zip(words, cuts[:-1], cuts[1:]))

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers, without the end."""
        # Special tokens are told by their case, so texts that may hold one keep theirs.
        words = [(text if b"<|" in text else text.lower()).split() for text in texts]
        met = set().union(*words) if words else set()
        if len(self.known) > REMEMBERED or not met <= self.known.keys():
            self.learn(met)
        for some in words:
            yield b"".join(map(self.known.__getitem__, some))


def word_ids(path: str) -> WordIds:
    """One table of words per Python worker, which serves all its tasks.

    Functions travel with the plan, so globals of this module last for one task only; a module of the worker lasts.
    """
    worker = sys.modules.setdefault("tiltmeter_worker", ModuleType("tiltmeter_worker"))
    tables = worker.__dict__.setdefault("word_ids", {})
    if path not in tables:
        tables[path] = WordIds(path)
    return tables[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids] of all documents."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        closing = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for first, _, data, bounds in byte_blocks(batch.column(1)):
                raw = data.tobytes()
                out = []
                for i, ids in enumerate(words.of([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])])):
                    ids += closing
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        row = (first + i, p, at // 4, len(part) // 4, zlib.crc32(part))
                        out.append(row + (np.frombuffer(part, "<i4"),) if with_ids else row)
                columns = list(zip(*out))
                arrays = [batch.column(0).take(pa.array(columns[0])), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:5]]]
                arrays += [pa.array(columns[5], pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return rows.mapInArrow(cut, schema)


# ---------------------------------------------------------------- packings of one block


def best_fit(sizes: np.ndarray, bins: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """Put the loose pieces, largest first, each into the fullest bin that takes it. ``bins``: -1 for loose pieces."""
    bins = bins.copy()
    held = bins >= 0
    fill = np.bincount(bins[held], sizes[held].astype(np.float64)).astype(np.int64) if held.any() else np.empty(0, np.int64)
    room = sorted((int(capacity - f), b) for b, f in enumerate(fill) if 0 < f < capacity)
    fresh = len(fill)
    for i in loose[np.argsort(-sizes[loose], kind="stable")].tolist():
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b, fresh = capacity, fresh, fresh + 1
        bins[i] = b
        if left > size:
            insort(room, (left - size, b))
    return np.unique(bins, return_inverse=True)[1]


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones: the (negated) mean square of how full they are."""
    fill = np.bincount(bins, sizes) / capacity
    return len(fill), -float((fill**2).mean())


def crossed(sizes, one: np.ndarray, other: np.ndarray, capacity: int, draw: np.random.Generator) -> np.ndarray:
    """``one`` with whole well-filled bins of ``other``: bins that share a piece go, what they held is best-fitted."""
    fill = np.bincount(other, sizes)
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = well[draw.random(len(well)) < 0.5]
    injected = np.isin(other, chosen)
    broken = np.zeros(one.max() + 1, dtype=bool)
    broken[one[injected]] = True
    bins = np.where(broken[one], -1, one)
    bins[injected] = one.max() + 1 + other[injected]
    loose = np.flatnonzero(bins < 0)
    bins[bins >= 0] = np.unique(bins[bins >= 0], return_inverse=True)[1]
    return best_fit(sizes, bins, loose, capacity)


def shaken(sizes, bins: np.ndarray, capacity: int, draw: np.random.Generator) -> np.ndarray:
    """The emptiest bins and a few others dissolved and their pieces best-fitted again."""
    fill = np.bincount(bins, sizes)
    gone = np.zeros(len(fill), dtype=bool)
    gone[np.argsort(fill)[: max(2, len(fill) // 50)]] = True
    gone |= draw.random(len(fill)) < 0.05
    out = np.where(gone[bins], -1, bins)
    loose = np.flatnonzero(out < 0)
    out[out >= 0] = np.unique(out[out >= 0], return_inverse=True)[1]
    return best_fit(sizes, out, loose, capacity)


def evolve(sizes: np.ndarray, migrants: list[np.ndarray], capacity: int, seed: int, children: int = CHILDREN) -> np.ndarray:
    """The best packing that an island finds in one epoch. It stops early where no packing can have fewer bins."""
    draw = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    everything = np.arange(len(sizes))
    start = best_fit(sizes, np.full(len(sizes), -1, dtype=np.int64), everything, capacity)
    packings = [start, *migrants]
    while len(packings) < POPULATION:
        packings.append(shaken(sizes, packings[len(packings) % (1 + len(migrants))], capacity, draw))
    scored = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(packings)), key=lambda x: x[:2])
    for k in range(children):
        if scored[0][0][0] <= least:
            break
        a, b = draw.choice(len(scored), size=2, replace=False)
        child = crossed(sizes, scored[min(a, b)][2], scored[max(a, b)][2], capacity, draw)
        if draw.random() < 0.5:
            child = shaken(sizes, child, capacity, draw)
        worst = scored[-1]
        score = fitness(sizes, child, capacity)
        if score < worst[0]:
            scored[-1] = (score, len(packings) + k, child)
            scored.sort(key=lambda x: x[:2])
    return scored[0][2]


# ---------------------------------------------------------------- blocks and islands


def packed_blocks(pieces: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """item, block, bin, offset, fill (of its bin) for the pieces (item, length); a block is one bounded row."""
    n_blocks = max(1, -(-pieces.count() // BLOCK_PIECES))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)))
    blocks = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "item")), asc=False).alias("pieces"))
    world = blocks.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    world = world.withColumn("migrants", F.array().cast("array<binary>"))
    found = None
    for epoch in range(epochs):
        found = written(_epoch(world, capacity, epoch))
        if epoch < epochs - 1:
            elites = found.groupBy("block").agg(F.collect_list("bins").alias("migrants"))
            world = world.drop("migrants").join(elites, "block")
    best = found.groupBy("block").agg(F.min(F.struct("n_bins", "score", "island", "bins")).alias("best"))
    return _laid_out(blocks.join(best.select("block", "best.bins"), "block"))


def _epoch(world: DataFrame, capacity: int, epoch: int) -> DataFrame:
    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, island, pieces, migrants in zip(*[c.to_pylist() for c in batch.columns]):
                sizes = np.array([p["length"] for p in pieces], dtype=np.int64)
                elites = [np.frombuffer(m, dtype=np.int32).astype(np.int64) for m in migrants]
                seed = (block * 1009 + island) * 31 + epoch
                bins = evolve(sizes, elites, capacity, seed)
                n_bins, score = fitness(sizes, bins, capacity)
                out.append((block, island, n_bins, score, bins.astype(np.int32).tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["block", "island", "n_bins", "score", "bins"])

    dealt = world.select("block", "island", "pieces", "migrants").repartition("block", "island")
    return dealt.mapInArrow(live, "block long, island int, n_bins long, score double, bins binary")


def _laid_out(blocks: DataFrame) -> DataFrame:
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pieces, raw in zip(*[c.to_pylist() for c in batch.columns]):
                bins = np.frombuffer(raw, dtype=np.int32)
                sizes = np.array([p["length"] for p in pieces], dtype=np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                new = np.r_[True, bins[order][1:] != bins[order][:-1]]
                start = (ends - sizes[order])[np.flatnonzero(new)][np.cumsum(new) - 1]
                fill = np.bincount(bins, sizes).astype(np.int64)[bins[order]]
                items = np.array([p["item"] for p in pieces], dtype=np.int64)[order]
                columns = [pa.array(items), pa.array(np.full(len(items), block)), pa.array(bins[order]), pa.array(ends - sizes[order] - start), pa.array(fill)]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "block", "bin", "offset", "fill"])

    return blocks.select("block", "pieces", "bins").mapInArrow(lay, "item long, block long, bin int, offset long, fill long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", islands: int = ISLANDS, epochs: int = EPOCHS, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``[, ``ids``].

    Every row of the input is packed: NULL and blank texts are the end id alone, rows that repeat an id are packed each
    for itself, NULL ids stay NULL. Only documents longer than ``capacity`` are cut, into pieces of that length and a
    rest. ``with_ids`` adds the token ids. Other columns are not read. No rows in, no rows out.
    """
    pieces = token_pieces(docs, tokenizer, capacity, id_col, text_col, with_ids)
    pieces = written(pieces.withColumn("item", F.monotonically_increasing_id()))
    short = pieces.where(F.col("length") < capacity).select("item", "length")
    first = written(packed_blocks(short, capacity, islands, epochs))
    poor = F.col("fill") < WELL_FILLED * capacity
    again = packed_blocks(first.where(poor).join(short, "item").select("item", "length"), capacity, islands, epochs)
    numbered = lambda df, r: df.select("item", ((F.col("block") * 2 + r) * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset")
    placed = numbered(first.where(~poor), 0).unionByName(numbered(again, 1))
    alone = pieces.where(F.col("length") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(placed.unionByName(alone), "item").drop("item")
