"""Calibration and evaluation samples out of a text corpus.

Texts are cut at white space into token arrays. Sample counts and lengths are parameters and small; the
corpus is not, so it is only counted, numbered and filtered, and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.functions.hashing import portable_hash
from tiltmeter.operators.ordered import attach, id_bucket, number_within, running_total
from tiltmeter.session import settle

WINDOW_BLOCK = 4096


def tokens_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+", -1), "")


def placed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, length and offset of every non-empty text in the joined corpus.

    The texts are read once for this; the counts are kept, and only they are shuffled.
    """
    # A filter on the count would be pushed below and split every text twice; any visible character will do.
    words = docs.where(F.regexp_like(text, F.lit(r"\S")))
    lengths = words.select(F.col(key).alias("doc_id"), F.size(tokens_of(F.col(text))).cast("bigint").alias("length"))
    kept = settle(lengths)
    return running_total(kept, [], [F.col("doc_id")], F.col("length"), id_bucket(kept, "doc_id"), "offset")


def _overlap(wanted: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs of a window [start, stop) and a document that overlap, found by an equi-join on blocks of the corpus."""

    def blocks(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / WINDOW_BLOCK), F.floor(last / WINDOW_BLOCK)))

    w = wanted.withColumn("_block", blocks(F.col("start"), F.col("stop") - 1))
    d = placed.withColumn("_block", blocks(F.col("offset"), F.col("offset") + F.col("length") - 1))
    hits = d.join(w, "_block").where(
        (F.col("offset") < F.col("stop")) & (F.col("offset") + F.col("length") > F.col("start"))
    )
    # A pair that shares several blocks is kept at the first of them.
    first = F.floor(F.greatest("start", "offset") / WINDOW_BLOCK)
    return hits.where(F.col("_block") == first).drop("_block")


#: Pairs of a sample and a document that are sent to every task; more of them are joined like any table.
FEW_HITS = 1 << 18


def _small(rows: DataFrame, most: int) -> DataFrame:
    """Rows known to be at most ``most`` go to the texts where that is little, so that no text is moved."""
    return F.broadcast(rows) if most <= FEW_HITS else rows


def _gather(hits: DataFrame, docs: DataFrame, key: str, text: str, out: str, most: int) -> DataFrame:
    """Cut each window's part out of its documents and put the parts together; a result has window length.

    ``most``: how many hits there can be. A window overlaps at most as many texts as it has tokens.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    begin = F.greatest(F.col("start") - F.col("offset"), F.lit(0))
    count = F.least(F.col("stop") - F.col("offset"), F.col("length")) - begin
    parts = source.join(_small(hits, most), "doc_id").select(
        out, "offset", F.slice(tokens_of(F.col("_text")), (begin + 1).cast("int"), count.cast("int")).alias("part")
    )
    joined = parts.groupBy(out).agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("_p"))
    return joined.select(out, F.flatten("_p.part").alias("tokens"))


def random_windows(
    docs: DataFrame, n_samples: int, seq_len: int, seed: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``n_samples`` windows of ``seq_len`` tokens at hashed places of the whole joined corpus: sample, tokens."""
    placed = placed_documents(docs, key, text)
    total = placed.agg(F.sum("length").alias("_total"))
    wanted = (
        total.where(F.col("_total") > seq_len)
        .select("_total", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("sample"))
        .withColumn("start", F.pmod(portable_hash(seed, F.col("sample")), F.col("_total") - seq_len))
        .select("sample", "start", (F.col("start") + seq_len).alias("stop"))
    )
    return _gather(_overlap(wanted, placed), docs, key, text, "sample", n_samples * seq_len)


def sampled_texts_windows(
    docs: DataFrame, n_texts: int, n_samples: int, seq_len: int, seed: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Windows from a sample of ``n_texts`` texts, drawn by hash out of all of them."""
    return random_windows(shuffled_first(docs, n_texts, seed, key), n_samples, seq_len, seed, key, text)


def document_windows(
    docs: DataFrame, n_samples: int, seq_len: int, seed: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per sample a random text of at least ``seq_len`` tokens and a random window in it.

    The long texts are numbered, the draws are numbers, and the two meet in an equi-join.
    """
    lengths = docs.select(F.col(key).alias("doc_id"), F.size(tokens_of(F.col(text))).alias("length"))
    long = settle(lengths).where(F.col("length") >= seq_len)
    numbered = number_within(long, [], [F.col("doc_id")], id_bucket(long, "doc_id"), "number")
    draws = (
        numbered.agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 0)
        .select("_n", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("sample"))
        .select("sample", F.pmod(portable_hash(seed, F.col("sample"), "doc"), F.col("_n")).alias("number"))
    )
    chosen = numbered.join(draws, "number").withColumn(
        "start",
        F.pmod(portable_hash(seed, F.col("sample"), "at"), F.greatest(F.col("length") - seq_len, F.lit(1)).cast("bigint")),
    )
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    return source.join(_small(chosen.select("sample", "doc_id", "start"), n_samples), "doc_id").select(
        "sample",
        "doc_id",
        F.slice(tokens_of(F.col("_text")), (F.col("start") + 1).cast("int"), F.lit(seq_len)).alias("tokens"),
    )


def shuffled_first(rows: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """The first n rows of a repeatable shuffle: a top-n per task, then one of n rows per task."""
    ordered = rows.withColumn("_h", portable_hash(seed, F.col(key)))
    return ordered.orderBy("_h", key).limit(n)


def tokenised_first(docs: DataFrame, n: int, seed: int, key: str, text: str) -> DataFrame:
    """The first n texts of the shuffle, cut into tokens once they are chosen."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    return shuffled_first(rows, n, seed).select("_h", "doc_id", tokens_of(F.col("_text")).alias("tokens"))


def short_text_blocks(docs: DataFrame, n_samples: int, seq_len: int, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shuffle, leave out empty texts and those longer than ``seq_len``, join the first n, cut into full blocks.

    At most n_samples · seq_len tokens are joined.
    """
    rows = docs.where(F.size(tokens_of(F.col(text))).between(1, seq_len))
    chosen = tokenised_first(rows, n_samples, seed, key, text)
    joined = chosen.agg(F.array_sort(F.collect_list(F.struct("_h", "doc_id", "tokens"))).alias("_p")).select(
        F.flatten("_p.tokens").alias("_all")
    )
    blocks = F.floor(F.size("_all") / F.lit(seq_len)).cast("int")
    return joined.where(blocks > 0).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), blocks - 1),
                lambda b: F.struct(b.alias("block"), F.slice("_all", b * seq_len + 1, F.lit(seq_len)).alias("tokens")),
            )
        ).alias("_b")
    ).select("_b.block", "_b.tokens")


def truncated_texts(
    docs: DataFrame, n_samples: int, seq_len: int, seed: int, full_only: bool, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Shuffle, cut texts to ``seq_len`` tokens, take the first n; ``full_only`` leaves shorter ones out."""
    rows = docs.where(F.size(tokens_of(F.col(text))) >= seq_len) if full_only else docs
    chosen = tokenised_first(rows, n_samples, seed, key, text)
    return chosen.select("doc_id", F.slice("tokens", 1, seq_len).alias("tokens"))


def chat_texts(
    turns: DataFrame, n_samples: int, seq_len: int, seed: int, conv: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """The first n conversations of a shuffle in chat markup, cut to ``seq_len`` tokens.

    Only turns that start before the cut are put together, so a conversation of any length adds at most
    ``seq_len`` tokens and the turn the cut falls into.
    """
    chosen = shuffled_first(turns.select(conv).distinct(), n_samples, seed, conv).select(conv)
    marked = turns.join(chosen, conv, "left_semi").withColumn(
        "_tokens",
        tokens_of(F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit(" <|im_end|>\n"))),
    )
    lengths = marked.select(conv, turn, F.size("_tokens").cast("bigint").alias("_n"))
    placed = running_total(lengths, [conv], [F.col(turn)], F.col("_n"), id_bucket(lengths, turn), "_start")
    kept = placed.where(F.col("_start") < seq_len).select(conv, turn, "_start")
    parts = marked.join(kept, [conv, turn]).select(
        conv, turn, F.slice("_tokens", F.lit(1), (F.lit(seq_len) - F.col("_start")).cast("int")).alias("_part")
    )
    joined = parts.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "_part"))).alias("_p"))
    return joined.select(conv, F.flatten("_p._part").alias("tokens"))


def corpus_blocks(docs: DataFrame, seq_len: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole joined corpus in consecutive full blocks of ``seq_len`` tokens: block, tokens.

    A text is cut where blocks meet, and the pieces of a block come together by its number.
    """
    placed = placed_documents(docs, key, text)
    total = placed.agg(F.sum("length").alias("_total"))
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")).join(placed, "doc_id")

    def cut_up(doc: Column) -> Column:
        first = F.floor(doc["offset"] / seq_len)
        last = F.floor((doc["offset"] + doc["length"] - 1) / seq_len)

        def piece(b: Column) -> Column:
            begin = F.greatest(b * seq_len - doc["offset"], F.lit(0))
            end = (b + 1) * seq_len - doc["offset"]
            part = F.slice(doc["tokens"], (begin + 1).cast("int"), (end - begin).cast("int"))
            return F.struct(b.alias("block"), doc["offset"].alias("offset"), part.alias("part"))

        return F.transform(F.sequence(first, last), piece)

    # The text is split once per row, and only its pieces are exploded.
    doc = F.struct(tokens_of(F.col("_text")).alias("tokens"), "offset", "length")
    cut = source.select(F.inline(F.get(F.transform(F.array(doc), cut_up), F.lit(0))))
    whole = attach(cut, total).where((F.col("block") + 1) * seq_len <= F.col("_total"))
    joined = whole.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("_p"))
    return joined.select("block", F.flatten("_p.part").alias("tokens"))


def batches(samples: DataFrame, size: int, index: str) -> DataFrame:
    """Batch number in the order of a unique index: all in one for −1, else ``size`` to a batch."""
    if size == -1:
        return samples.withColumn("batch", F.lit(0).cast("bigint"))
    numbered = number_within(samples, [], [F.col(index)], id_bucket(samples, index), "_number")
    return numbered.withColumn("batch", F.floor(F.col("_number") / size).cast("bigint")).drop("_number")


def strided(rows: DataFrame, rank: int, world: int, index: str) -> DataFrame:
    """Every ``world``-th row from ``rank`` on; a filter on the stored index."""
    return rows.where(F.col(index) % world == rank)
