"""The registered queries against their SQL; those without SQL against plain versions over the whole small table."""

from __future__ import annotations

import hashlib
import zlib

import corpus_pipeline
import pytest
from brute import near_groups, without_substrings
from oracle import compare, duck
from pyspark.sql import functions as F

from tiltmeter.llm import chosen_path
from tiltmeter.llm.queries import QUERIES, documents

NO_SQL = {"op2_languages", "op4_packed_sequences", "op6_repeated_substrings"}


def test_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {n for n, q in QUERIES.items() if q.sql is None} == NO_SQL


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NO_SQL))
def test_matches_sql(spark, sf_dir, name):
    assert compare(spark, name, QUERIES[name], sf_dir, duck(sf_dir)) is None


def test_language_accuracy(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op2_languages"].run(spark, sf_dir).collect()}
    rows = documents(spark, sf_dir).collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in held} == {i for i, g in got.items() if g.held_out}
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.9 * len(held)


def test_packed_tokens(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {(r.doc_id, r.piece): r for r in QUERIES["op4_packed_sequences"].run(spark, sf_dir).collect()}
    total = 0
    for row in documents(spark, sf_dir).collect():
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            r = got.pop((row.doc_id, p))
            raw = b"".join(x.to_bytes(4, "little") for x in part)
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(raw))
    assert not got
    bins = {}
    for r in QUERIES["op4_packed_sequences"].run(spark, sf_dir).collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(b)[k][0] == sum(x[1] for x in sorted(b)[:k]) for b in bins.values() for k in range(len(b)))
    assert max(sum(x[1] for x in b) for b in bins.values()) <= 4096 and len(bins) <= -(-total // 4096) + 1


def test_repeated_substrings(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, without_substrings([r.text for r in rows], 400))}
    got = QUERIES["op6_repeated_substrings"].run(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {
        i: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, (n, gone, spans, kept) in want.items()
    }


def test_pipeline_stages(spark, sf_dir):
    """Each stage on what the one before it kept, against a plain version of its decision."""
    from brute import WORD

    docs = documents(spark, sf_dir)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "12 34", "en", "src0", 5), (9003, "", None, "src1", 0)], docs.schema)
    docs = docs.unionByName(odd).withColumn("text_key", F.lit("clash"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        kept[name] = docs.collect()
        old, new = before.collect(), kept[name]
        if name != "sequence_packing":
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        if name == "language_id":
            assert {r.doc_id for r in new} == {r.doc_id for r in old} - {9001, 9002, 9003}
        elif name == "line_dedup":
            texts = {r.doc_id: r.text for r in new}
            for r in old:
                lines = iter(r.text.split("\n"))
                assert all(any(line == x for x in lines) for line in texts[r.doc_id].split("\n"))
        elif name == "near_dedup":
            groups = near_groups_by_operator(old)
            assert sorted(r.doc_id for r in new) == sorted(groups)
        elif name == "source_mix":
            assert {r.doc_id for r in new} <= {r.doc_id for r in old}
            words = sum(len(WORD.findall(r.text or "")) for r in new)
            assert abs(words - sum(len(WORD.findall(r.text or "")) for r in old)) < 0.1 * words
        else:
            assert {r.doc_id for r in new} == {r.doc_id for r in old}
            assert sum(r.start == 0 for r in new) == len(old)


def near_groups_by_operator(rows):
    """Ids that stay: the smallest of each group of similarity 0.8 or more, found through shared shingles."""
    from collections import Counter, defaultdict

    from brute import groups, shingles

    sets = {r.doc_id: shingles(r.text) for r in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter((a, b) for some in holders.values() for a in some for b in some if a < b)
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    found = groups(sets, links)
    return {i for i, root in found.items() if i == root}


def test_near_groups_helper_agrees():
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")]
    assert near_groups(rows, 80) == {1: (2, 1), 2: (2, 1), 3: (1, 3)}
    assert chosen_path.SHINGLE_WORDS == 5


def test_pipeline_on_no_documents(spark, sf_dir):
    empty = documents(spark, sf_dir).where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0


def test_near_dedup_tells_rows_of_one_id_apart(spark, sf_dir, make_docs):
    """Different texts of one id stay, near duplicates and equal rows of it are one; rows without an id stay."""
    words = [f"w{i}" for i in range(120)]
    one, other = " ".join(words[:60]), " ".join(words[60:])
    near = one + " tail"
    rows = [(1, one), (1, other), (1, near), (1, one), (2, near), (-5, other), (3, None), (3, ""), (None, one), (None, one), (4, "short text")]
    kept = corpus_pipeline.near_dedup(spark, make_docs(rows), sf_dir).select("doc_id", "text").collect()
    assert sum(r.doc_id is None for r in kept) == 2
    named = sorted((r.doc_id, r.text or "") for r in kept if r.doc_id is not None)
    assert [i for i, _ in named if i != 3] == [-5, 1, 4] and dict(named)[-5] == other and dict(named)[1] in (one, near)
    assert {t for i, t in named if i == 3} == {""}
