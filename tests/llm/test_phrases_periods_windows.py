"""Phrases, periodic runs and windows of test items against plain versions, on odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from brute import best_phrases, item_windows, word_runs

from tiltmeter.llm import decontaminate, periods, phrases
from tiltmeter.llm.automaton import Matcher, build

ODD = [None, "", " \t\n ", ".,;:!?", "single", "   x", "É é É é É é É é É é É é", "word " * 40]


def phrase_rows():
    draw = random.Random(3)
    words = ["the", "of", "Ärger", "naïve", "x y", "red", "fox", "日本", "low", "tide"]
    said = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n"]) for _ in range(draw.randint(0, 60)))
    rows = [(said(), draw.choice(["en", "de", None, "und"])) for _ in range(120)]
    return rows + [(t, "en") for t in ODD] + [(rows[0][0], "de")] * 9


@pytest.mark.parametrize("one_in", [1, 4, 10**6])
def test_phrases(make_docs, one_in):
    """Also where the sample proposes everything or next to nothing and all has to come from the border and beyond."""
    rows = phrase_rows()
    docs = make_docs([(i, text, None, lang) for i, (text, lang) in enumerate(rows)], extra="h1")
    got = phrases.mine_phrases(docs, least=6, reported=40, one_in=one_in).collect()
    want = best_phrases(rows, 6, 4, 40)
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.lang for r in got} == {"en", "de", "und"}


def test_phrases_with_a_full_filter(make_docs, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_FILTER_BITS", 1 << 7)
    rows = phrase_rows()
    docs = make_docs([(i, text, None, lang) for i, (text, lang) in enumerate(rows)])
    assert sorted(map(tuple, phrases.mine_phrases(docs, least=6).collect())) == sorted(best_phrases(rows, 6, 4, 2000))


def test_border_failures_are_found(spark, make_docs):
    docs = make_docs([(1, "a b c. " * 50)]).selectExpr("text", "'en' as lang", "7 as bucket")
    none = spark.sparkContext.broadcast(np.zeros(1 << 11, np.uint8))
    frequent = phrases.counts(docs, 4, lambda grams: phrases.chosen(grams, phrases.Filter(none.value)), 30)
    assert sorted(r.n for r in frequent.collect()) == [50, 50, 50]
    assert phrases.border_failures(frequent, none).count() == 3
    known = spark.sparkContext.broadcast(phrases.filter_bits(frequent))
    assert phrases.border_failures(frequent, known).count() == 0
    more = phrases.counts(docs, 4, lambda grams: phrases.chosen(grams, phrases.Filter(none.value), phrases.Filter(known.value)), 30)
    assert sorted(r.n for r in more.collect()) == [50, 50, 50]


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 9_007_199_254_740_993, 9_007_199_254_740_997, 9_007_199_254_741_111
    named = spark.createDataFrame([("en", "p q", a, ["p", "q"]), ("en", "p", l, ["p"]), ("en", "q", r, ["q"])], "lang string, phrase string, a long, words array<string>")
    totals = spark.createDataFrame([("en", 4 * l)], "lang string, n long")
    (row,) = phrases.best_phrases(named, totals, 10).collect()
    assert (row.l, row.r, row.score) == (l, r, 2_000_000 * a // (l + r))


def test_no_phrases(make_docs):
    assert phrases.mine_phrases(make_docs([])).count() == 0
    assert phrases.mine_phrases(make_docs([(1, None), (2, "")])).count() == 0


def periodic_rows():
    draw = random.Random(4)
    rows = [(100 + i, t) for i, t in enumerate(ODD)]
    for i in range(300):
        words = ["a", "b", "C", "é"][: draw.randint(1, 4)]
        rows.append((i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 70)))))
    for i in range(60):
        block = [f"w{draw.randint(0, 40)}" for _ in range(draw.randint(1, 30))]
        text = [f"v{draw.randint(0, 9)}" for _ in range(draw.randint(0, 20))] + block * draw.randint(1, 7) + block[: draw.randint(0, len(block))]
        rows.append((1000 + i, "\n".join(text + [f"v{draw.randint(0, 9)}" for _ in range(draw.randint(0, 20))])))
    return [*rows, (2000, " ".join(f"u{i % 700}" for i in range(5000))), (5, "z z z z z z z z z z z z z"), (None, "z " * 30)]


@pytest.mark.parametrize("least", [12, 5, 4])
def test_runs(make_docs, least):
    rows = periodic_rows()
    got = periods.periodic_runs(make_docs(rows, extra="runs"), least=least).collect()
    want = []
    for i, text in rows:
        words = (text or "").encode().split()
        runs = word_runs(words, least)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((str(i), len(words), runs, len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.n_dropped, r.text) for r in got) == sorted(want)


def test_long_rows_of_one_word_and_of_many_left_words(make_docs):
    """Work must not grow with the square of a group: all suffixes are alike, or a string follows many different words."""
    once = " ".join(f"x{i} p q r s t u v" for i in range(4000))
    got = {r.doc_id: r for r in periods.periodic_runs(make_docs([(1, "same " * 60000), (2, once), (3, "a b " * 20000)])).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 60000, 1)] and got[1].text == "same"
    assert got[2].runs == [] and got[2].n_dropped == 0
    assert [tuple(x) for x in got[3].runs] == [(0, 40000, 2)] and got[3].text == "a b"


def test_no_runs(make_docs):
    assert periods.periodic_runs(make_docs([])).count() == 0


def test_automaton_knows_every_factor_and_no_more():
    draw = random.Random(6)
    for _ in range(200):
        strings = [[draw.randint(0, 2) for _ in range(draw.randint(0, 12))] for _ in range(draw.randint(1, 4))]
        goes, link, longest = build(strings)
        factors = {tuple(s[a:b]) for s in strings for a in range(len(s) + 1) for b in range(a, len(s) + 1)}
        ways, found = [((), 0)], set()
        while ways:
            word, state = ways.pop()
            found.add(word)
            ways += [((*word, w), to) for w, to in goes[state].items()]
        assert found == factors
        assert sum(longest[s] - longest[link[s]] for s in range(1, len(goes))) == len(factors) - 1


def test_matcher_on_streams():
    draw = random.Random(7)
    for _ in range(100):
        strings = [[draw.randint(0, 2) for _ in range(draw.randint(0, 9))] for _ in range(draw.randint(1, 5))]
        stream = [draw.randint(-1, 2) for _ in range(60)]
        want = set()
        for item, s in enumerate(strings):
            m = min(4, len(s))
            windows = {tuple(s[a : a + m]) for a in range(len(s) - m + 1)} if m else set()
            want |= {(e, m, item) for e in range(m, 61) if tuple(stream[e - m : e]) in windows}
        got = [(e, m, i) for e, m, items in Matcher(strings, 4).matches(stream) for i in items]
        assert sorted(got) == sorted(want)


def contaminated_rows():
    draw = random.Random(8)
    words = [draw.choice("abcdefghij") + draw.choice(["é", "x", "1", "日"]) for _ in range(40)]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(i, say(draw.randint(11, 60))) for i in range(12)]
    items += [(20, "Only"), (21, "two words"), (22, None), (23, ""), (24, "..."), (25, items[0][1]), (25, items[0][1]), (None, say(14)), (26, say(400))]
    docs = [(100 + i, t) for i, t in enumerate(ODD)]
    for i in range(80):
        text = say(draw.randint(0, 40))
        for _ in range(draw.randint(0, 3)):
            line = draw.choice(items)[1] or ""
            line = " ".join(line.split(" ")[draw.randint(0, 5) :][: draw.randint(1, 30)])
            text += draw.choice([" ", "\n", "--", "; "]) + draw.choice([line, line.upper().replace("É", "é"), line.replace(" ", ",\n")]) + " " + say(draw.randint(0, 20))
        docs.append((i, text))
    return [*docs, (3, "ONLY, only!"), (None, "Two... WORDS only"), (7, say(20000) + " " + items[3][1])], items


@pytest.mark.parametrize(("shard_words", "piece"), [(1 << 17, 4096), (60, 25)])
def test_windows_of_items(spark, make_docs, monkeypatch, shard_words, piece):
    """In one shard and in many, with items cut into pieces."""
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
    docs, items = contaminated_rows()
    table = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string").repartition(3)
    got = decontaminate.decontaminate(make_docs(docs, extra="items"), table, shard_words=shard_words).collect()
    assert len(got) == len(docs)
    want = []
    for i, text in docs:
        words, hit, names = item_windows(text, items, 10)
        want.append((str(i), len(words), len(hit), sorted(names), sorted(hit), 2 * len(hit) > len(words)))
    shown = [(str(r.doc_id), r.n_words, r.n_hit, r["items"], [k for s in r.spans for k in range(s.start, s.start + s.length)], r.dropped) for r in got]
    assert sorted(shown) == sorted(want)
    texts = {(r.doc_id, r.n_words): r.text for r in got}
    for i, text in docs:
        words, hit, _ = item_windows(text, items, 10)
        left, _, _ = item_windows(texts[i, len(words)], [], 10)
        assert left == [w for k, w in enumerate(words) if k not in hit]
        assert hit or texts[i, len(words)] == text


def test_items_by_name_and_no_items(spark, make_docs):
    docs = make_docs([(1, "a b c"), (2, None)])
    named = spark.createDataFrame([("q-10", "B C"), ("q-9", "c")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, named).collect()}
    assert (got[1]["items"], got[1].n_hit, got[1].text) == (["q-10", "q-9"], 2, "a ") and got[2].text is None
    none = decontaminate.decontaminate(docs, named.where("false")).collect()
    assert [r.n_hit for r in none] == [0, 0]
    assert decontaminate.decontaminate(make_docs([]), named).count() == 0
