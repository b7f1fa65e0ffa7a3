"""Line deduplication by a log-template tree: lines that recur as one template across documents are dropped.

The tree has a fixed depth: the number of tokens, then the leading tokens, each with variable fields (tokens that hold
a digit) replaced by a wild card. A leaf holds several templates: the tokens that enough lines share at a position are
constant, the rest is wild, and lines that agree at most positions belong together. Every line is a template by its
whole masked text too. Everything is DataFrame expressions; every count is added up before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.common import SPACE_PATTERN, WORD_PATTERN, text_column, written

LEADING = 3
#: Share of positions that must be constant in a template.
SIMILARITY = 0.7
#: A template recurs if it stands in so many documents.
LEAST_DOCS = 10
#: A whole masked line recurs if it stands in so many documents of more than one text.
WHOLE_DOCS = 2
WILD = "<*>"
#: From the first byte of a token, without going back.
FIELD_PATTERN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def masked_lines(rows: DataFrame, leading: int = LEADING) -> DataFrame:
    """``line`` becomes ``masked``: its tokens joined by one space, those with a digit as a wild card.

    A row of numbers stays as it is: a line without a constant token, or with a single one behind wild leading tokens.
    Each step is a column of its own, so that no pattern runs twice, and most lines are left as they are by the first.
    """
    line, tidy, wild = F.col("line"), F.col("tidy"), F.col("wild")
    spaced = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    rows = rows.withColumn("untidy", spaced | line.rlike(r"[0-9\x09\x0B-\x0D]"))
    rows = rows.withColumn("tidy", F.when(F.col("untidy"), F.trim(F.regexp_replace(line, SPACE_PATTERN + "+", " "))).otherwise(line)).drop("line")
    rows = rows.withColumn("wild", F.when(F.col("untidy"), F.regexp_replace(tidy, FIELD_PATTERN, WILD)))
    record = (_constants(F.substring_index(wild, " ", leading)) > 0) | (_constants(wild) > 1)
    masked = F.when(F.col("untidy"), F.when(record, wild).otherwise(tidy)).otherwise(tidy)
    return rows.withColumn("masked", masked).drop("untidy", "tidy", "wild")


def _constants(masked: Column) -> Column:
    return _tokens(masked) - (F.length(masked) - F.length(F.replace(masked, F.lit(WILD), F.lit("")))) / len(WILD)


def _tokens(masked: Column) -> Column:
    spaces = F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit("")))
    return F.when(masked == "", 0).otherwise(spaces + 1)


def line_table(docs: DataFrame, leading: int, id_col: str, text_col: str) -> DataFrame:
    """A row per line that is not blank: doc_id, text_key, pos, tokens, masked, leaf, k1, k2. Kept in the shared folder,
    since every step below reads it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # Blank lines go first: a condition on what is made of a line would have it made twice.
    rows = masked_lines(rows.where(F.col("line").rlike(WORD_PATTERN[:-1])), leading).withColumn("tokens", _tokens(F.col("masked")))
    table = rows.select(
        "doc_id",
        "text_key",
        "pos",
        "tokens",
        "masked",
        F.xxhash64("tokens", F.substring_index("masked", " ", leading)).alias("leaf"),
        F.xxhash64("masked").alias("k1"),
        F.xxhash64(F.lit("line"), "masked").alias("k2"),
    )
    return written(table)


def shared_patterns(lines: DataFrame, leading: int, least_docs: int, similarity: float) -> DataFrame:
    """(text, patterns): the patterns that each differing line of a leaf, named by its ``k1``, may be an instance of.

    A token is frequent to the degree that it doubles ``least_docs``, counted in lines of its leaf and position. The
    pattern of a degree keeps the tokens of at least that degree and is wild elsewhere, so a leaf holds any number of
    templates, and a field whose values are frequent themselves is wild from a higher degree on. The patterns of a line
    are nested, and no more than the binary digits of the number of lines. The leading tokens are equal in a leaf, so a
    pattern needs a further word.
    """
    texts = lines.where(F.col("tokens") > leading).groupBy("leaf", "tokens", "k1", "masked").agg(F.count(F.lit(1)).alias("n"))
    mixed = lines.where(F.col("tokens") > leading).groupBy("leaf").agg((F.min("k1") < F.max("k1")).alias("differ"), F.count(F.lit(1)).alias("n"))
    mixed = written(mixed.where(F.col("differ") & (F.col("n") >= least_docs)).select("leaf"))
    spots = texts.join(mixed, "leaf").select("leaf", "tokens", "k1", "n", F.posexplode(F.split("masked", " ")).alias("spot", "token"))
    spots = written(spots)
    often = spots.groupBy("leaf", "spot", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs)
    often = written(often.select("leaf", "spot", "token", F.floor(F.log2(F.col("n") / least_docs)).alias("degree")))
    degrees = spots.drop("n").join(often, ["leaf", "spot", "token"]).groupBy("leaf", "tokens", "k1", "degree").agg(
        F.count(F.lit(1)).alias("same"),
        F.count_if((F.col("spot") >= leading) & (F.col("token") != WILD)).alias("further"),
        F.bit_xor(F.xxhash64("spot", "token")).alias("p1"),
        F.bit_xor(F.xxhash64("token", F.lit("pattern"), "spot")).alias("p2"),
    )
    found = degrees.groupBy("leaf", "tokens", "k1").agg(F.collect_list(F.struct("degree", "same", "further", "p1", "p2")).alias("degrees"))
    patterns = F.transform("degrees", lambda least: _pattern(F.filter("degrees", lambda d: d["degree"] >= least["degree"])))
    found = found.select(F.col("k1").alias("text"), "leaf", "tokens", F.explode(patterns).alias("pattern"))
    found = found.where((F.col("pattern.further") > 0) & (F.col("pattern.same") >= similarity * F.col("tokens")) & (F.col("pattern.same") < F.col("tokens")))
    keyed = F.struct(F.xxhash64("leaf", "pattern.p1").alias("k1"), F.xxhash64(F.lit("leaf"), "leaf", "pattern.p2").alias("k2"))
    return found.groupBy("text").agg(F.collect_list(keyed).alias("patterns"))


def _pattern(degrees: Column) -> Column:
    """The tokens of several degrees together."""
    none = F.struct(*[F.lit(0).cast("long").alias(name) for name in ("same", "further", "p1", "p2")])
    return F.aggregate(
        degrees,
        none,
        lambda all_, d: F.struct(
            (all_["same"] + d["same"]).alias("same"),
            (all_["further"] + d["further"]).alias("further"),
            all_["p1"].bitwiseXOR(d["p1"]).alias("p1"),
            all_["p2"].bitwiseXOR(d["p2"]).alias("p2"),
        ),
    )


def recurring_lines(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    leading: int = LEADING,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, text_key, positions): the lines to drop of every document that has any; see ``drop_recurring_lines``."""
    lines = line_table(docs, leading, id_col, text_col)
    # Written, as are the recurring templates below, so that the joins find two shuffled sides and a line that very many
    # documents hold can be split.
    patterns = written(shared_patterns(lines, leading, least_docs, similarity))
    texts = lines.select("doc_id", "text_key", "pos", "k1", "k2", F.lit(True).alias("whole"))
    wild = texts.join(patterns, texts["k1"] == patterns["text"]).select("doc_id", "text_key", "pos", F.explode("patterns").alias("p"))
    # A line counts for its own text and for each of its patterns. These are nested, so the first document of the widest
    # one is the first of every narrower one that it holds, and keeps its lines.
    keys = written(texts.unionByName(wild.select("doc_id", "text_key", "pos", "p.k1", "p.k2", F.lit(False).alias("whole"))))
    # Once a document first, so that no buffer is wider than a number and a repeated id has one text.
    named = F.when(F.col("doc_id").isNotNull(), F.col("text_key"))
    held = keys.groupBy("k1", "k2", "whole", "doc_id").agg(F.min(named).alias("low"), F.max(named).alias("high"))
    often = held.groupBy("k1", "k2", "whole").agg(
        F.count("doc_id").alias("docs"),
        F.min("doc_id").alias("first_doc"),
        F.min_by("low", "doc_id").alias("first_text"),
        (F.min("low") < F.max("high")).alias("texts"),
    )
    common = F.col("docs") >= least_docs
    often = often.where(common | (F.col("whole") & (F.col("docs") >= WHOLE_DOCS) & F.col("texts")))
    often = written(often.select("k1", "k2", common.alias("common"), "first_doc", "first_text"))
    # Copies of the first document are for the operators that compare documents, unless the line is in very many.
    dropped = keys.join(often, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    dropped = dropped.where(F.col("common") | (F.col("text_key") != F.col("first_text")))
    return dropped.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("positions"))


def drop_recurring_lines(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    leading: int = LEADING,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The input rows with recurring lines taken out of the text, and ``n_lines``, ``n_removed`` (long) added.

    A template that stands in at least ``least_docs`` documents is dropped from all of them but the one with the
    smallest id, so nothing vanishes from the corpus. A line whose whole masked text stands in fewer, but at least
    ``WHOLE_DOCS`` of more than one text, is dropped from all but that one and its copies. Blank lines always stay.
    NULL text stays NULL with 0 lines. A row without an id counts as no document, but loses its recurring lines. Rows
    that repeat an id count as one document. Columns of the input named like an added one are replaced; all others
    stay as they are. No rows in, no rows out.
    """
    gone = recurring_lines(docs, least_docs, leading, similarity, id_col, text_col)
    docs = docs.drop("n_lines", "n_removed")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(text_column(docs, text_col)).alias("row_key"))
    same = F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("text_key"))
    rows = rows.join(gone, same, "left")
    text, positions = F.col("row")[text_col], F.col("positions")
    parts = F.split(text, "\n")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(positions, i)), "\n")
    changed = F.when(positions.isNull(), text).otherwise(kept)
    return rows.select(
        *[(changed if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(positions.isNull(), 0).otherwise(F.size(positions)).cast("long").alias("n_removed"),
    )
