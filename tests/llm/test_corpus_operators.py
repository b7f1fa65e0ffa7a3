"""Each corpus operator against a plain version, on rows with NULLs, empty and long texts, ties and repeats."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import exact_groups, linked_vectors, near_groups, source_targets, without_passages, without_substrings, without_templates

from tiltmeter.llm import byte_gru, chosen_path, exact, mixing, packing, passages, quantised, substrings, templates
from tiltmeter.llm.common import components

random.seed(5)
VOCABULARY = ["Ålesund", "red", "fox", "the", "of", "Stone", "naïve", "x1", "42", "run", "日本", "sea", "low", "tide", "zu"]


def plain(n: int) -> str:
    return " ".join(random.choice(VOCABULARY[:8]) + random.choice("abcdefgh") * random.randint(1, 9) for _ in range(n))


def prose(n: int) -> str:
    return " ".join(random.choice(VOCABULARY) + str(random.randint(0, 99)) for _ in range(n))


PASSAGE = prose(70)
LONG = prose(6000)
TEXTS = [
    (1, prose(120)),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "one two"),
    (6, "ONE two"),
    (7, prose(20) + " " + PASSAGE + " " + prose(30)),
    (8, PASSAGE),
    (9, prose(5) + "\n" + PASSAGE + "\t" + prose(5)),
    (10, LONG),
    (11, LONG + " tail"),
    (12, "a b " * 300),
    (13, "a b " * 200),
    (14, "aaaa" * 300),
    (15, PASSAGE),
    (16, PASSAGE.replace(" ", "\n")),
    (17, PASSAGE + " and a few more words"),
]
EMPTY_SAFE = {
    "exact": lambda d: exact.exact_copies(d),
    "mix": lambda d: mixing.copies_per_document(d),
    "mixed": lambda d: mixing.mixed_documents(d),
    "lines": lambda d: templates.drop_recurring_lines(d),
    "passages": lambda d: passages.remove_passages(d),
    "substrings": lambda d: substrings.remove_substrings(d),
    "near": lambda d: chosen_path.near_duplicates(d),
    "languages": lambda d: byte_gru.predict(d, *byte_gru.learn(d)),
}


@pytest.mark.parametrize("name", EMPTY_SAFE)
def test_empty_tables(make_docs, name):
    assert EMPTY_SAFE[name](make_docs([])).count() == 0


@pytest.mark.parametrize("name", EMPTY_SAFE)
@pytest.mark.parametrize("extra", ["text_key", "piece", "n_removed", "__id"])
def test_clashing_columns(make_docs, name, extra):
    docs = make_docs([(1, "an odd line of five words"), (2, None)], extra)
    assert EMPTY_SAFE[name](docs).count() >= (0 if name == "mixed" else 2)


def test_components_by_brute_force(spark):
    links = [(random.randint(0, 80), random.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 160)]
    links += [(5, 5), (None, 3)]
    from brute import groups

    real = [(a, b) for a, b in links if a is not None and a != b]
    want = groups({x for link in real for x in link}, real)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want


def test_exact_copies(make_docs):
    rows = [*TEXTS, (18, "one  two"), (18, "one  two"), (None, "one two"), (None, "only here"), (19, "ONE\ntwo")]
    got = exact.exact_copies(make_docs(rows), block_bits=3).collect()
    assert sorted(map(repr, [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got])) == sorted(map(repr, exact_groups(rows)))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_counting_quotient_filter_merges_losslessly():
    draw = np.random.default_rng(3)
    values = draw.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    stream = draw.choice(values, 3000)
    whole = exact.CountingQuotientFilter.of(stream)
    merged = None
    for part in np.array_split(stream, 7):
        one = exact.CountingQuotientFilter.from_bytes(exact.CountingQuotientFilter.of(part).to_bytes())
        merged = one if merged is None else merged.merge(one)
    counted = Counter(stream.tolist())
    for f in (whole, merged):
        assert dict(zip(f.fingerprints().tolist(), f.counts.tolist())) == counted
    parts = list(merged.blocks(5))
    assert sorted(x for _, p in parts for x in p.fingerprints().tolist()) == sorted(counted)


def test_source_mix(make_docs):
    rows = [(i, prose(i % 7), f"s{i % 4}") for i in range(200)] + [(None, "a b", None), (777, None, "s1"), (500, "w", "tiny")]
    docs = make_docs(rows)
    got = mixing.copies_per_document(docs).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = source_targets(dict(sizes))
    source_of = {(i, len((t or "").split())): s for i, t, s in rows}
    taken = defaultdict(int)
    for r in got:
        source = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert r.taken == r.copies * r.size and r.copies <= 3
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(7, 0.1 * want[s]) for s in want)
    again = mixing.copies_per_document(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert mixed == +copies


@pytest.mark.parametrize("limit", [1, 4096])
def test_passages(make_docs, limit):
    got = passages.remove_passages(make_docs(TEXTS), anchor_slices=limit).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == without_passages(TEXTS, 50)
    assert all(sum(s.length for s in r.spans) == r.n_removed for r in got)


def test_passages_of_repeated_and_missing_ids(make_docs):
    got = passages.remove_passages(make_docs([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("1", 0), ("None", 70)]


@pytest.mark.parametrize("limit", [0, 8192])
def test_substrings(make_docs, limit):
    rows = [*TEXTS, (8, PASSAGE), (None, LONG[:2000])]
    got = substrings.remove_substrings(make_docs(rows), anchor_slices=limit).collect()
    want = without_substrings([t for _, t in rows], 400)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want))


def test_near_duplicates(make_docs):
    base = prose(200).split()
    rows = list(TEXTS)
    for k in range(40):
        edited = list(base)
        for _ in range(k % 4):
            edited[random.randrange(200)] = "changed"
        rows.append((100 + k, " ".join(edited)))
    docs = make_docs(rows)
    for percent in (80, 85):
        want = near_groups(rows, percent)
        for sizes in ({}, {"small_node": 2, "levels": 2}):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosen_path.near_duplicates(docs, percent, **sizes).collect()}
            assert got == want


def test_near_duplicates_of_repeated_and_missing_ids(make_docs):
    one, two = prose(50), prose(50)
    rows = [(1, one), (5, one), (5, two), (6, two), (None, one), (None, None)]
    got = chosen_path.near_duplicates(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted(
        [("1", "1", True), ("5", "1", False), ("5", "1", False), ("6", "1", False), ("None", "None", True), ("None", "None", True)]
    )


def test_linked_vectors(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + draw.normal(size=16) * 0.08).tolist()) for i in range(300)]
    rows += [(400 + i, centres[0].tolist()) for i in range(30)] + [(500, (centres[0] * 7).tolist())]
    rows += [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None] + [1.0] * 15), (604, [float("inf")] + [1.0] * 15), (605, [])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, point string").repartition(5)
    want = linked_vectors(rows, 0.95)
    for tile in (1024, 8):
        got = {r.vec_id: (r.n_links, r.component_id) for r in quantised.linked_vectors(frame, tile_rows=tile).collect()}
        found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
        assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.9 * there
        assert got.keys() == want.keys()
    assert quantised.linked_vectors(frame.where("vec_id >= 600")).where("n_links = 0 and kept").count() == 6
    assert quantised.linked_vectors(frame.where("false")).count() == 0


def test_vectors_recall_on_the_table(spark, sf_dir):
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    near = [(1000 + i, [x + 0.01 * ((k * 7 + i) % 5 - 2) for k, x in enumerate(v)]) for i, v in rows[:150]]
    frame = spark.createDataFrame(rows + near, "vec_id long, embedding array<double>")
    want = linked_vectors(rows + near, 0.95)
    got = {r.vec_id: r.n_links for r in quantised.linked_vectors(frame).collect()}
    assert sum(got.values()) >= 0.9 * sum(w[0] for w in want.values()) > 0


def test_template_lines(make_docs):
    shared = "All rights reserved by the owner"
    rows = [(i, f"{plain(12)}\n{shared}\npage {i} of {i + 3} printed\n{plain(9)}") for i in range(1, 9)]
    rows += [(20, shared), (21, None), (22, ""), (23, f"{plain(8)}\nof the"), (None, f"{shared}\nkept without id as it is"), (4, shared)]
    kept = templates.drop_recurring_lines(make_docs(rows), least_docs=5).collect()
    by_id = defaultdict(list)
    for r in kept:
        by_id[r.doc_id].append(r)
    assert len(kept) == len(rows)
    assert by_id[1][0].n_removed == 0 and by_id[1][0].text == rows[0][1]
    for i in (2, 3, 5, 8):
        lines = rows[i - 1][1].split("\n")
        assert by_id[i][0].text == f"{lines[0]}\n{lines[3]}" and (by_id[i][0].n_lines, by_id[i][0].n_removed) == (4, 2)
    assert by_id[20][0].text == "" and by_id[21][0].text is None and by_id[22][0].text == "" and by_id[23][0].n_removed == 0
    assert by_id[None][0].text == "kept without id as it is"
    assert sorted(r.n_removed for r in by_id[4]) == [1, 2]


@pytest.mark.parametrize("least", [3, 6])
def test_template_lines_by_brute_force(make_docs, least):
    draw = random.Random(9)
    words = ["the", "staff", "report", "filed", "on", "Ärger", "7", "host3", "by", "x"]
    said = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", "\r"]) for _ in range(draw.randint(1, 6)))
    fixed = ["the report of {} was filed by {} on {}", "read more", "{} {} {}", "page {} of {} printed", "  ", "the staff <*> {} and so on we go"]
    filled = lambda: draw.choice(fixed).format(*[draw.choice(words[1:]) + str(draw.choice(["", "", 4])) for _ in range(3)])
    rows = [(i, "\n".join(draw.choice([said, filled])() for _ in range(draw.randint(0, 7)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, rows[0][1]), (103, rows[1][1]), (104, "the report " * 4000 + "\n" + rows[2][1])]
    want = without_templates(rows, least)
    kept = {r.doc_id: r for r in templates.drop_recurring_lines(make_docs(rows, extra="masked"), least_docs=least).collect()}
    for (i, text), gone in zip(rows, want):
        lines = text.split("\n") if text is not None else []
        assert (kept[i].n_lines, kept[i].n_removed) == (len(lines), len(gone))
        assert kept[i].text == (None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))


def test_template_leaf_generalises(make_docs):
    names = ["amber", "beryl", "coral", "dusk", "ember", "flint"]
    rows = [(i, f"the quiet report from {name} station was filed late\n{plain(30)}") for i, name in enumerate(names)]
    kept = {r.doc_id: r.n_removed for r in templates.drop_recurring_lines(make_docs(rows), least_docs=6).collect()}
    assert kept == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}


def test_rows_of_numbers_are_no_template(make_docs):
    rows = [(i, f"{i} {i + 1} {i * 7} total") for i in range(20)]
    assert templates.drop_recurring_lines(make_docs(rows), least_docs=5).where("n_removed > 0").count() == 0


def removed(frame, **options):
    return {r.doc_id: r.n_removed for r in templates.drop_recurring_lines(frame, **options).collect()}


def test_template_leaf_holds_several_templates(make_docs):
    names = ["amber", "beryl", "coral", "dusk", "ember", "flint"]
    rows = [(i, f"Reviewed by the staff {name}") for i, name in enumerate(names)]
    rows += [(10 + i, f"Reviewed by the board {name}x") for i, name in enumerate(names)]
    rows += [(20, "Reviewed by the whole team")]
    assert removed(make_docs(rows), least_docs=6) == {i: int(i not in (0, 10, 20)) for i, _ in rows}


def test_template_fields_of_frequent_values(make_docs):
    values = ["amber", "beryl", "coral", "dusk", "ember", "flint"]
    rows = [(6 * i + k, f"Posted in the main forum by user {a} on {b}") for i, a in enumerate(values) for k, b in enumerate(values)]
    assert removed(make_docs(rows), least_docs=6) == {i: int(i > 0) for i, _ in rows}


def test_leading_tokens_alone_are_no_template(make_docs):
    verbs = ["go", "eat", "sleep", "read", "swim", "sing"]
    rows = [(i, f"I want to {verb}") for i, verb in enumerate(verbs)]
    rows += [(10 + i, f"You may then 7 {verb}") for i, verb in enumerate(verbs)]
    assert set(removed(make_docs(rows), least_docs=6).values()) == {0}


def test_records_of_many_fields_are_templates(make_docs):
    rows = [(i, f"2024-01-{10 + i} 12:30:{10 + i} host{i} {70 + i} login failed\nViews: {i} {i + 45} 2020-01-{10 + i}") for i in range(6)]
    rows += [(10 + i, f"{i} {i + 1} {i * 7} {i * 9}") for i in range(6)]
    assert removed(make_docs(rows), least_docs=6) == {i: 2 * (0 < i < 6) for i, _ in rows}


def test_short_and_long_and_rare_lines_recur(make_docs):
    words = " ".join(f"{a}{b}" for a in "abcdef" for b in "ghijk")
    names = ["amber", "beryl", "coral", "dusk", "ember", "flint"]
    rows = [(i, f"Read more\nAgain\n\n\nLicence {words} held by {name} alone\n{plain(9)}") for i, name in enumerate(names)]
    rows += [(10, f"shared by two\n{plain(9)}"), (11, f"{plain(9)}\nshared by two"), (12, f"{plain(9)}\nby one only")]
    assert removed(make_docs(rows), least_docs=6) == {i: 3 if 0 < i < 6 else int(i == 11) for i, _ in rows}


def test_few_copies_of_a_document_stay(make_docs):
    text = f"{plain(9)}\n{plain(8)}"
    rows = [(1, text), (2, text), (3, text.split("\n")[0]), (None, text)]
    assert removed(make_docs(rows)) == {1: 0, 2: 0, 3: 1, None: 0}


def test_gradients_by_differences():
    net = byte_gru.Network.fresh(3)
    draw = np.random.default_rng(0)
    segments, labels = draw.integers(97, 105, (6, 9)).astype(np.uint8), draw.integers(0, 3, 6)
    _, slopes = byte_gru.gradients(net, segments, labels)
    for part, slope in zip(net.parts(), slopes):
        for _ in range(6):
            spot = tuple(draw.integers(0, n) for n in part.shape)
            if part is net.table:
                spot = (spot[0], int(segments[0, 3]), spot[2])
            old = part[spot]
            ends = []
            for step in (5e-3, -5e-3):
                part[spot] = old + step
                ends.append(byte_gru.gradients(net, segments, labels)[0])
            part[spot] = old
            assert (ends[0] - ends[1]) / 1e-2 == pytest.approx(slope[spot], abs=3e-4)


def test_fast_pass_equals_the_plain_one():
    net, draw = byte_gru.Network.fresh(4), np.random.default_rng(1)
    segments, length = draw.integers(1, 255, (9, byte_gru.SEGMENT)).astype(np.uint8), draw.integers(1, byte_gru.SEGMENT, 9)
    plain = byte_gru.probabilities(net, byte_gru.run(net, segments))
    want = np.stack([plain[: length[i], i].sum(axis=0) for i in range(9)])
    assert np.allclose(byte_gru.segment_chances(net, segments, length), want, atol=1e-4)


def test_languages_of_odd_texts(make_docs):
    rows = [(i, ("the cat sat on that mat " if i % 2 else "der hund und die katze ") * 5, "s", "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "123 ... 456"), (103, "the " * 30000), (None, "und der hund " * 9)]
    docs = make_docs(rows)
    langs, network = byte_gru.learn(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in byte_gru.predict(docs, langs, network).collect()}
    assert langs == ["de", "en"] and len(got) == len(rows)
    assert all(got[i] == ("und", 0.0) for i in (100, 101, 102))
    assert got[103][0] == "en" and got[None][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(60))


def test_packing(make_docs):
    from tokenizers import Tokenizer

    from tiltmeter.llm.queries import tokenizer_path

    rows = [*TEXTS, (None, "no id"), (5, "one two")] + [(1000 + i, prose(random.randint(1, 60))) for i in range(150)]
    path, capacity = tokenizer_path(), 256
    got = packing.pack(make_docs(rows), path, capacity, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    want = Counter((str(i), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    by_row, bins = defaultdict(dict), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and (r.length == capacity or r.length < capacity)
        bins[r.sequence_id].append((r.offset, r.length))
        by_row[str(r.doc_id), r.start, r.piece].setdefault(tuple(r.ids), 0)
        by_row[str(r.doc_id), r.start, r.piece][tuple(r.ids)] += 1
    whole = Counter((d, ids) for (d, start, p), some in by_row.items() if p == 0 for ids, n in some.items() for _ in range(n) if len(ids) < capacity)
    assert whole == Counter({k: n for k, n in want.items() if len(k[1]) < capacity})
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(bins) <= 1.03 * sum(r.length for r in got) / capacity
    assert packing.pack(make_docs([]), path).count() == 0


def test_children_are_whole_packings():
    draw = np.random.default_rng(4)
    sizes = draw.integers(1, 100, 200)
    everything = np.arange(200)
    one = packing.best_fit(sizes, np.full(200, -1), draw.permutation(everything), 100)
    other = packing.shaken(sizes, one, 100, draw)
    for _ in range(20):
        child = packing.crossed(sizes, one, other, 100, draw)
        assert (np.bincount(child, sizes) <= 100).all() and (np.bincount(child) > 0).all()
        one, other = other, child


def test_planted_passages_by_their_bytes(make_docs):
    """What a window of 400 bytes means for passages counted in words: short ones stay, long ones go from both holders."""
    draw = random.Random(12)
    word = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for words, size in ((51, 5), (62, 5), (62, 7), (100, 5)):
        passage = " ".join(word(size) for _ in range(words))
        rows = [(i, f"{word(9)} {' '.join(word(6) for _ in range(40))}\n{passage}\n{' '.join(word(6) for _ in range(40))}") for i in (1, 2)]
        got = substrings.remove_substrings(make_docs(rows)).collect()
        # The line ends around the passage are shared too.
        whole = len(passage) + 2
        assert [r.n_removed for r in got] == [whole if whole >= 400 else 0] * 2
