"""Phrase collocation mining by Toivonen's method: a sample proposes, one pass over everything decides.

1. Sample. Documents chosen by a hash are mined level by level for phrases that reach a lowered bound. They are kept as
   a filter of a few bits a phrase, whose size is bounded whatever the corpus.
2. Full pass. A phrase is counted if both its parts (without the last, without the first word) are in the filter: these
   are the sampled phrases and their negative border. Every word is counted. Whatever else the filter lets through is
   counted exactly too, so a full filter costs rows and never a result.
3. Failures. A frequent phrase of the border that is not in the filter may have longer ones that were not counted. A
   further pass counts all phrases that were not, and whose parts are frequent or not counted yet either. It closes
   the set: by induction over the length, both parts of a frequent phrase are counted by then.
4. Scores. The frequent phrases get back their words in one more pass; cuts, containment and ranks are joins.

Phrases travel as a fingerprint of 96 bits (of the words and the language) with a count, added up before every shuffle,
and with the bucket of a document that holds them: only documents of that bucket spell the phrase out in the last pass.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.llm.common import Rolling, as_long, byte_blocks, lowered, mix, short_batches, text_column, word_spans, written

LEAST_COUNT = 30
LONGEST = 4
REPORTED = 2000
#: One document in so many proposes phrases.
SAMPLE_ONE_IN = 4
#: Bits of the filter per phrase, and at most. A fuller filter lets more phrases be counted and loses none.
FILTER_BITS = 16
MOST_FILTER_BITS = 1 << 28
#: Phrase occurrences that a task adds up at once.
HELD_ROWS = 1 << 19
#: Parts in which each language is ranked before the best of them are ranked together.
RANKED_PARTS = 64
UNKNOWN_LANG = "und"

_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?") + list(range(0x0A, 0x0E))] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[[0x20, 0x09]] = True
COUNTS = "h1 long, h2 int, bucket int, n long"
#: Documents fall into so many buckets by their text.
BUCKETS = 1 << 16


class Coder:
    """Fingerprints of all phrases of a block of texts."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.bytes = Rolling(31), Rolling(32)
        self.words = Rolling(33), Rolling(34)

    def of(self, data: np.ndarray, bounds: np.ndarray, langs: np.ndarray):
        """Word spans, and per length (h1, h2, whether the phrase lies in one piece)."""
        start, end, row = spans = word_spans(data, bounds, _BETWEEN)
        piece = np.cumsum(_BREAK[data])[start] + row if len(start) else row
        keys = []
        for at_bytes, at_words in zip(self.bytes, self.words):
            words = at_bytes.runs(at_bytes.prefix(at_bytes.lower_table[data]), start, end)
            sums = at_words.prefix(words)
            keys.append([mix(at_words.every(sums, k) + langs[row[: len(row) - k + 1]]) if len(row) >= k else np.empty(0, np.uint64) for k in range(1, self.longest + 1)])
        fits = [piece[: max(0, len(piece) - k + 1)] == piece[k - 1 :] for k in range(1, self.longest + 1)]
        return spans, list(zip(keys[0], keys[1], fits))


def probes(size: int) -> tuple[int, ...]:
    """Where the places of a fingerprint in a filter of 2**size bits start, counted from its lowest bit."""
    return 0, 13, 26, 64 - size


class Filter:
    """A set of fingerprints with false members: four bits each."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.size = int(len(bits) * 8).bit_length() - 1

    def has(self, h1: np.ndarray, where: np.ndarray) -> np.ndarray:
        some, mask = np.flatnonzero(where), np.uint64((1 << self.size) - 1)
        for shift in probes(self.size):
            at = (h1[some] >> np.uint64(shift)) & mask
            some = some[((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1) > 0]
        out = np.zeros(len(h1), dtype=bool)
        out[some] = True
        return out


def in_bucket(h1: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The fingerprint of a phrase and a bucket: the number of the bucket four times over it."""
    return h1 ^ (bucket.astype(np.uint64) * np.uint64(0x0001000100010001))


def lang_hash(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((UNKNOWN_LANG if lang is None else lang).encode(), digest_size=8).digest(), "little")


def blocks(batches: Iterator[pa.RecordBatch], coder: Coder):
    """(langs and buckets by row, word spans, data, phrases by length) for blocks of the rows (text, lang, bucket)."""
    for batch in batches:
        langs, buckets = batch.column(1).to_pylist(), batch.column(2).to_numpy()
        hashes = {lang: lang_hash(lang) for lang in set(langs)}
        of_row = np.array([hashes[lang] for lang in langs], dtype=np.uint64)
        for first, end, data, bounds in byte_blocks(batch.column(0)):
            spans, grams = coder.of(data, bounds, of_row[first:end])
            yield (langs[first:end], buckets[first:end]), spans, data, grams


def chosen(grams, held: Filter, known: Filter | None = None) -> Iterator[np.ndarray]:
    """Per length the phrases to count: those with both parts in ``held``.

    With ``known``, the phrases that are frequent for sure: those not counted before whose parts are known or new.
    """
    inside = ahead = None
    for k, (h1, _, fits) in enumerate(grams):
        first = fits & inside[:-1] & inside[1:] if k else np.ones(len(h1), dtype=bool)
        new = fits & ahead[:-1] & ahead[1:] & ~first if k and known else np.zeros(len(h1), dtype=bool)
        yield new if known else first
        inside = held.has(h1, first)
        ahead = new | known.has(h1, fits & ~new) if known else None


def counts(rows: DataFrame, longest: int, pick: Callable, least: int) -> DataFrame:
    """h1, h2, bucket, n of the picked phrases that occur at least ``least`` times; in the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, total = Coder(longest), [], 0
        for (_, buckets), (_, _, row), _, grams in blocks(batches, coder):
            for (h1, h2, _), mask in zip(grams, pick(grams)):
                at = np.flatnonzero(mask)
                if len(at):
                    held.append((h1[at], as_long(h2[at]).astype(np.int32), buckets[row[at]]))
                    total += len(at)
            if total >= HELD_ROWS:
                yield _added_up(held)
                held, total = [], 0
        if held:
            yield _added_up(held)

    found = rows.mapInArrow(count, COUNTS).groupBy("h1", "h2").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n"))
    return written(found.where(F.col("n") >= least))


def _added_up(held) -> pa.RecordBatch:
    h1, h2, bucket = (np.concatenate([part[i] for part in held]) for i in range(3))
    order = np.argsort(h1)
    h1, h2, bucket = h1[order], h2[order], bucket[order]
    head = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    n, low = np.diff(np.r_[head, len(h1)]), np.minimum.reduceat(bucket, head)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (as_long(h1[head]), h2[head], low, n)], names=["h1", "h2", "bucket", "n"])


def filter_bits(phrases: DataFrame, by_bucket: bool = False) -> np.ndarray:
    """The filter of a table of phrases, or of phrases in their buckets; put together in Spark, by words of 64 bits."""
    wanted = FILTER_BITS * max(1 << 10, phrases.count())
    size = min(MOST_FILTER_BITS, 1 << (wanted - 1).bit_length()).bit_length() - 1
    key = F.col("h1")
    for shift in (0, 16, 32, 48) if by_bucket else ():
        key = key.bitwiseXOR(F.shiftleft(F.col("bucket").cast("long"), shift))
    places = F.array(*[F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << size) - 1)) for shift in probes(size)])
    at = phrases.select(F.explode(places).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
    found = words.toArrow()
    bits = np.zeros(1 << (size - 6), dtype=np.int64)
    bits[found.column("slot").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint8)


def lowered_bound(least: int, one_in: int) -> int:
    """Nineteen in twenty phrases that just reach ``least`` reach this in the sample, if they fall into it at random."""
    expected = least / one_in
    return max(2, math.floor(expected - 1.64 * math.sqrt(expected)))


def frequent_phrases(rows: DataFrame, least: int, longest: int, one_in: int) -> tuple[DataFrame, Broadcast]:
    """h1, h2, n of every phrase of at most ``longest`` words that occurs at least ``least`` times in its language; and the
    bits of their filter."""
    share = rows.sparkSession.sparkContext.broadcast
    sample = rows.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(one_in)) == 0)
    bound, proposed, held = lowered_bound(least, one_in), None, None
    for level in range(longest):

        def one_level(grams, level=level, held=held):
            if not level:
                return [np.ones(len(grams[0][0]), dtype=bool)]
            masks = list(chosen(grams[: level + 1], Filter(held.value)))
            return [np.zeros(len(m), dtype=bool) for m in masks[:-1]] + masks[-1:]

        found = counts(sample, longest, one_level, bound)
        proposed = found if proposed is None else proposed.unionByName(found)
        held = share(filter_bits(proposed))
    frequent = counts(rows, longest, lambda grams: chosen(grams, Filter(held.value)), least)
    known = share(filter_bits(frequent))
    if not border_failures(frequent, held).isEmpty():
        more = counts(rows, longest, lambda grams: chosen(grams, Filter(held.value), Filter(known.value)), least)
        frequent = frequent.unionByName(more)
        known = share(filter_bits(frequent))
    return frequent, known


def border_failures(frequent: DataFrame, held: Broadcast) -> DataFrame:
    """Phrases that are frequent in the corpus but were not proposed by the sample."""

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proposed = Filter(held.value)
        for batch in batches:
            h1 = batch.column(0).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(~proposed.has(h1, np.ones(len(h1), dtype=bool))))

    return frequent.mapInArrow(missed, COUNTS)


def phrase_texts(rows: DataFrame, longest: int, frequent: DataFrame, known: Broadcast) -> DataFrame:
    """h1, h2, lang, phrase of the frequent phrases (and some others), and lang and n, its words, once per block."""
    spelt = rows.sparkSession.sparkContext.broadcast(filter_bits(frequent, by_bucket=True))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, frequent, here = Coder(longest), Filter(known.value), Filter(spelt.value)
        for (langs, buckets), (start, end, row), data, grams in blocks(batches, coder):
            raw, out = lowered(data).tobytes(), []
            words = dict.fromkeys(langs, 0)
            for lang, n in zip(langs, np.bincount(row, minlength=len(langs)).tolist()):
                words[lang] += n
            for k, (h1, h2, fits) in enumerate(grams):
                fits = frequent.has(h1, fits)
                at = np.flatnonzero(here.has(in_bucket(h1, buckets[row[: len(h1)]]), fits))
                at = at[np.unique(h1[at], return_index=True)[1]]
                pieces = [b" ".join(raw[a:b].split()) for a, b in zip(start[at].tolist(), end[at + k].tolist())]
                out.append((as_long(h1[at]), as_long(h2[at]).astype(np.int32), [langs[r] for r in row[at].tolist()], pieces))
            h1, h2 = (np.concatenate([*[o[i] for o in out], np.zeros(len(words), kind)]) for i, kind in ((0, np.int64), (1, np.int32)))
            names, pieces = ([x for o in out for x in o[i]] for i in (2, 3))
            columns = [pa.array(h1), pa.array(h2), pa.array([*names, *words], pa.string())]
            columns.append(pa.array([*pieces, *[None] * len(words)], pa.binary()).cast(pa.string()))
            columns.append(pa.array([*[None] * len(pieces), *words.values()], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "lang", "phrase", "n"])

    return written(rows.mapInArrow(texts, "h1 long, h2 int, lang string, phrase string, n long"))


def mine_phrases(
    docs: DataFrame,
    least: int = LEAST_COUNT,
    longest: int = LONGEST,
    reported: int = REPORTED,
    one_in: int = SAMPLE_ONE_IN,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: per language the phrases whose words belong together most.

    Texts in lower case (A to Z) are cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs.
    ``a`` counts all occurrences of the phrase inside pieces, ``l`` and ``r`` those of the two parts at its weakest cut,
    ``n`` the words of the language. The score is 2,000,000 a / (l + r), rounded down, of the lowest-scoring cut (the
    first of equal ones). A phrase inside a longer frequent one with at least 80 % of its occurrences is left out. The
    ``reported`` best of each language follow score, count and bytes.

    NULL and empty texts have no words, a NULL language is ``und``. Repeated rows count as often as they stand there.
    Ids and other columns are not read. A language without a frequent phrase has no row. No rows in, no rows out.
    """
    short_batches(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG))
    rows = docs.select(text_column(docs, text_col).alias("text"), lang.alias("lang"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("text"), F.lit(BUCKETS)).cast("int"))
    frequent, known = frequent_phrases(rows, least, longest, one_in)
    texts = phrase_texts(rows, longest, frequent, known)
    words = texts.where("phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    named = texts.where("phrase is not null").select("h1", "h2", "lang", "phrase").distinct()
    named = named.join(frequent.select("h1", "h2", F.col("n").alias("a")), ["h1", "h2"]).select("lang", "phrase", "a", F.split("phrase", " ").alias("words"))
    return best_phrases(written(named), words, reported)


def part(first: int | Column, count: Column) -> Column:
    return F.array_join(F.slice("words", first, count), " ")


def best_phrases(named: DataFrame, words: DataFrame, reported: int) -> DataFrame:
    """The ranked phrases, from all frequent ones (lang, phrase, a, words) and the number of words by language."""
    phrases = named.where(F.size("words") > 1)
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(1, F.col("cut")).alias("first"), part(F.col("cut") + 1, F.size("words") - F.col("cut")).alias("rest"))
    count = named.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__part"), F.col("a").alias("__a"))
    for side, out in (("first", "l"), ("rest", "r")):
        same = (F.col("lang") == F.col("__lang")) & (F.col(side) == F.col("__part"))
        cuts = cuts.join(count, same).withColumn(out, F.col("__a")).drop("__lang", "__part", "__a", side)
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    weakest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("weakest")
    scored = cuts.groupBy("lang", "phrase", "a").agg(weakest)
    # Every stretch of at least two words of a longer phrase, with the count of the most frequent one around it.
    spots = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda s: part(s, k))))
    around = phrases.where(F.size("words") > 2).select("lang", F.col("a").alias("longer"), F.explode(spots).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left")
    inside = F.expr("100 * cast(longer as decimal(20, 0)) >= 80 * cast(a as decimal(20, 0))")
    kept = kept.where(~F.coalesce(inside, F.lit(False))).select("lang", "phrase", "a", "weakest.l", "weakest.r", "weakest.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= reported)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= reported)
    return kept.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
