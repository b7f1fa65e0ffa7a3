"""Answer letters: which are valid, which options a prompt offers, which letter a text gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiltmeter.functions.text import core_question, strip

# Letters assumed when a prompt shows no readable option list (fixed values).
FALLBACK_LETTERS = ("A", "B", "C", "D")


def is_valid(answer: Column) -> Column:
    """One ASCII capital, possibly with a final line feed; never NULL itself.

    Accepts what ``^[A-Z]$`` accepts in Python. Written as comparisons, as it runs on every answer.
    """
    alone = (F.length(answer) == 1) | ((F.length(answer) == 2) & F.endswith(answer, F.lit("\n")))
    return F.coalesce(F.substring(answer, 1, 1).between("A", "Z") & alone, F.lit(False))


def is_valid_any_script(answer: Column) -> Column:
    """One capital letter of any script."""
    return F.coalesce(F.regexp_like(answer, F.lit(r"\A\p{Lu}\z")), F.lit(False))


def is_correct(answer: Column, correct: Column) -> Column:
    return F.coalesce(answer == correct, F.lit(False))


def follows_opinion(answer: Column, suggested: Column) -> Column:
    return F.coalesce(answer == suggested, F.lit(False))


def tidy_letter(letter: Column) -> Column:
    """Strip and capitalise; NULL unless exactly one capital letter is left."""
    tidy = F.upper(strip(letter))
    return F.when(F.regexp_like(tidy, F.lit(r"\A\p{Lu}\z")), tidy)


def option_letters(full_question: Column) -> Column:
    """Letters of the contiguous option lines ``A. …``, ``B. …``; A to D if fewer than two are found."""
    core = core_question(full_question)
    lines = F.filter(
        F.transform(F.split(core, "\n", -1), lambda line: F.regexp_extract(line, r"(?U)\A\s*([A-Z])\.\s+", 1)),
        lambda letter: letter != "",
    )
    count = F.aggregate(
        lines,
        F.lit(0),
        lambda n, letter: n + F.when(F.ascii(letter) - 65 == n, 1).otherwise(0),
    )
    alphabet = F.array(*[F.lit(chr(65 + i)) for i in range(26)])
    fallback = F.array(*[F.lit(c) for c in FALLBACK_LETTERS])
    return F.when(count >= 2, F.slice(alphabet, F.lit(1), count)).otherwise(fallback)


def option_positions(full_question: Column) -> Column:
    """Character offset of each option label in the prompt; empty if no option list was found."""
    lines = F.split(core_question(full_question), "\n", -1)
    start = F.struct(
        F.lit(0).alias("offset"),
        F.lit(0).alias("count"),
        F.array().cast("array<int>").alias("found"),
    )

    def step(state: Column, line: Column) -> Column:
        lead = F.regexp_extract(line, r"(?U)\A(\s*)[A-Z]\.\s+", 1)
        letter = F.regexp_extract(line, r"(?U)\A\s*([A-Z])\.\s+", 1)
        hit = (letter != "") & (F.ascii(letter) - 65 == state["count"])
        return F.struct(
            (state["offset"] + F.length(line) + 1).alias("offset"),
            (state["count"] + F.when(hit, 1).otherwise(0)).alias("count"),
            F.when(hit, F.concat(state["found"], F.array(state["offset"] + F.length(lead))))
            .otherwise(state["found"])
            .alias("found"),
        )

    return F.aggregate(
        lines,
        start,
        step,
        lambda s: F.when(s["count"] >= 2, s["found"]).otherwise(F.array().cast("array<int>")),
    )


def extract_letter(raw: Column, allowed: Column) -> Column:
    """The letter in the first ``{X}`` if allowed, else the first allowed letter that stands alone, else ''."""
    text = strip(raw)
    braced = F.regexp_extract(text, r"\{([A-Z])\}", 1)
    alone = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z])([A-Z])(?![A-Za-z])"), 1)
    first_alone = F.get(F.filter(alone, lambda c: F.array_contains(allowed, c)), F.lit(0))
    return (
        F.when(text.isNull(), F.lit(""))
        .when((braced != "") & F.array_contains(allowed, braced), braced)
        .otherwise(F.coalesce(first_alone, F.lit("")))
    )


def letter_of_token(token: Column, allowed: Column) -> Column:
    """Letter from the most likely next token: its first character if that is an allowed capital."""
    first = F.substring(strip(token), 1, 1)
    return F.when(
        F.regexp_like(first, F.lit(r"\A\p{Lu}\z")) & F.array_contains(allowed, first), first
    ).otherwise(F.lit(""))


def index_of_four(answer: Column) -> Column:
    """``A``..``D`` or ``0``..``3`` -> 0..3, else NULL."""
    tidy = F.upper(strip(answer.cast("string")))
    position = F.instr(F.lit("A0B1C2D3"), tidy)
    return F.when((F.length(tidy) == 1) & (position > 0), F.floor((position - 1) / 2).cast("int"))


def index_of_key(answer_key: Column, n_choices: Column) -> Column:
    """One letter -> its 0-based index if it is below ``n_choices``, else NULL."""
    tidy = F.upper(strip(answer_key))
    index = F.ascii(tidy) - 65
    return F.when((F.length(tidy) == 1) & index.between(0, n_choices - 1), index)
