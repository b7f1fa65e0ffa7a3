"""The registered queries of the corpus operators, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.llm import byte_gru, chosen_path, decontaminate, exact, mixing, packing, passages, periods, phrases, quantised, substrings, templates, warc
from tiltmeter.llm.common import WORD_PATTERN
from tiltmeter.plans.registry import Query

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = Query(fn, sql)
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    "op1_near_vectors",
    """
    WITH RECURSIVE known AS (
        SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM known a JOIN known b ON a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.v, b.v) >= 0.95::DOUBLE
    ), reach AS (
        SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    ), least AS (
        SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
    ), counts AS (
        SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
    )
    SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
    FROM embeddings e JOIN least l USING (vec_id) LEFT JOIN counts c USING (vec_id)
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


@query("op2_languages")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    langs, network = byte_gru.learn(docs)
    judged = byte_gru.predict(docs.select("doc_id", "text"), langs, network)
    return judged.select("doc_id", byte_gru.in_fold().alias("held_out"), "lang_pred", "score")


@query(
    "op3_source_mix",
    rf"""
    WITH rows AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
    ), sizes AS (
        SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
    ), weighed AS (
        SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM sizes
    ), levels AS (
        SELECT *, cap / weight AS full_at,
            (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
        FROM weighed
        WINDOW w AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), targets AS (
        SELECT *, CASE WHEN level > full_at THEN cap::DOUBLE
            ELSE weight * (SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, level LIMIT 1) END AS target FROM levels
    ), rates AS (
        SELECT *, least(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END, 3.0::DOUBLE) AS rate FROM targets
    ), parts AS (
        SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part FROM rates
    ), draws AS (
        SELECT DISTINCT doc_id, seed, ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), (seed // 4)::VARCHAR)), (8 * (seed % 4) + 1)::INT, 8))::BIGINT AS draw
        FROM rows, range({mixing.SEEDS}) AS seeds(seed)
    ), tried AS (
        SELECT r.source, d.seed, abs(sum(CASE WHEN d.draw < p.part * 4294967296.0::DOUBLE THEN r.size ELSE 0 END)::DOUBLE - any_value(p.part * p.source_size)) AS gap
        FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source JOIN draws d ON r.doc_id IS NOT DISTINCT FROM d.doc_id
        GROUP BY r.source, d.seed
    ), best AS (
        SELECT source, min({{'gap': gap, 'seed': seed}}).seed AS seed FROM tried GROUP BY source
    )
    SELECT r.doc_id, r.size, p.source_size, p.target,
        (p.whole + (d.draw < p.part * 4294967296.0::DOUBLE)::BIGINT)::BIGINT AS copies,
        ((p.whole + (d.draw < p.part * 4294967296.0::DOUBLE)::BIGINT) * r.size)::BIGINT AS taken
    FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source JOIN best b ON r.source IS NOT DISTINCT FROM b.source
    JOIN draws d ON r.doc_id IS NOT DISTINCT FROM d.doc_id AND d.seed = b.seed
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies_per_document(documents(spark, sf_dir))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_packed_sequences")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


@query(
    "op5_repeated_passages",
    rf"""
    WITH rows AS (
        SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
    ), windows AS (
        SELECT doc_id, head, md5(array_to_string(words[head:head + {passages.WINDOW_WORDS - 1}], ' ')) AS print
        FROM (SELECT *, unnest(range(1, len(words) - {passages.WINDOW_WORDS - 2})) AS head FROM rows)
    ), firsts AS (
        SELECT print, min(doc_id) AS first_doc FROM windows GROUP BY print
    ), gone AS (
        SELECT doc_id, list(DISTINCT spot) AS spots
        FROM (SELECT w.doc_id, unnest(range(w.head, w.head + {passages.WINDOW_WORDS})) AS spot FROM windows w JOIN firsts f USING (print) WHERE f.first_doc < w.doc_id)
        GROUP BY doc_id
    ), kept AS (
        SELECT r.doc_id, len(r.words) AS n_words, coalesce(len(g.spots), 0) AS n_removed,
            [r.words[i] FOR i IN range(1, len(r.words) + 1) IF NOT list_contains(coalesce(g.spots, []), i)] AS words
        FROM rows r LEFT JOIN gone g ON r.doc_id = g.doc_id
    )
    SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(words, ' '), '')) AS kept_sha256 FROM kept
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.remove_passages(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_repeated_substrings")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_substrings(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op7_archived_pages",
    """
    WITH rows AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    keyed AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM rows),
    firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM keyed WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT k.page_id, k.payload_bytes, k.payload_digest,
        CASE WHEN f.first_id IS NULL OR f.first_id IS NOT DISTINCT FROM k.page_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN f.first_id IS NULL OR f.first_id IS NOT DISTINCT FROM k.page_id THEN NULL ELSE f.first_id END AS refers_to
    FROM keyed k LEFT JOIN firsts f ON k.payload_digest = f.payload_digest
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    archives = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = warc.read_archives(archives, folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


LINES_SQL = rf"""
    rows AS (
        SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
    ), cut AS (
        SELECT doc_id, md5(text) AS text_key, pos, lines[pos] AS line,
            array_to_string(regexp_extract_all(lines[pos], '[^\x20\x09-\x0D]+'), ' ') AS tidy FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS pos FROM rows)
    ), fields AS (
        SELECT *, regexp_replace(tidy, '[^\x20]*[0-9][^\x20]*', '{templates.WILD}', 'g') AS wild FROM cut WHERE tidy <> ''
    ), counted AS (
        SELECT *, array_to_string(string_split(wild, ' ')[1:{templates.LEADING}], ' ') AS head FROM fields
    ), masked AS (
        SELECT doc_id, text_key, pos, string_split(line, ' ') AS parts, line, len(string_split(line, ' ')) || chr(10) || array_to_string(string_split(line, ' ')[1:{templates.LEADING}], ' ') AS leaf
        FROM (
            SELECT doc_id, text_key, pos, CASE WHEN len(string_split(head, ' ')) > (length(head) - length(replace(head, '{templates.WILD}', ''))) // {len(templates.WILD)}
                OR len(string_split(wild, ' ')) > 1 + (length(wild) - length(replace(wild, '{templates.WILD}', ''))) // {len(templates.WILD)} THEN wild ELSE tidy END AS line FROM counted
        )
    ), texts AS (
        SELECT leaf, line, parts, count(*) AS n FROM masked WHERE len(parts) > {templates.LEADING} GROUP BY ALL
    ), mixed AS (
        SELECT leaf FROM texts GROUP BY leaf HAVING count(*) > 1 AND sum(n) >= {templates.LEAST_DOCS}
    ), spots AS (
        SELECT leaf, line, n, len(parts) AS tokens, unnest(range(1, len(parts) + 1)) AS spot, unnest(parts) AS token FROM texts SEMI JOIN mixed USING (leaf)
    ), frequent AS (
        SELECT leaf, spot, token, floor(ln(sum(n) / {templates.LEAST_DOCS}.0::DOUBLE) / ln(2.0::DOUBLE)) AS degree FROM spots GROUP BY ALL HAVING sum(n) >= {templates.LEAST_DOCS}
    ), held AS (
        SELECT leaf, line, tokens, spot, token, degree FROM spots JOIN frequent USING (leaf, spot, token)
    ), patterns AS (
        SELECT l.leaf, l.line, string_agg(h.spot || ' ' || h.token, chr(10) ORDER BY h.spot) AS pattern
        FROM (SELECT DISTINCT leaf, line, degree FROM held) l JOIN held h ON l.leaf = h.leaf AND l.line = h.line AND h.degree >= l.degree
        GROUP BY l.leaf, l.line, l.degree, h.tokens
        HAVING count(*) FILTER (h.spot > {templates.LEADING} AND h.token <> '{templates.WILD}') > 0 AND count(*) >= {templates.SIMILARITY}::DOUBLE * h.tokens AND count(*) < h.tokens
    ), keyed AS (
        SELECT doc_id, text_key, pos, true AS whole, line AS template FROM masked
        UNION ALL SELECT m.doc_id, m.text_key, m.pos, false, p.leaf || chr(10) || p.pattern FROM masked m JOIN patterns p ON m.leaf = p.leaf AND m.line = p.line
    ), often AS (
        SELECT whole, template, count(DISTINCT doc_id) >= {templates.LEAST_DOCS} AS common, min(doc_id) AS first_doc, arg_min(text_key, doc_id) AS first_text FROM keyed GROUP BY ALL
        HAVING count(DISTINCT doc_id) >= {templates.LEAST_DOCS} OR (whole AND count(DISTINCT doc_id) >= {templates.WHOLE_DOCS} AND min(text_key) < max(text_key))
    ), gone AS (
        SELECT k.doc_id, k.text_key, list(DISTINCT k.pos) AS positions FROM keyed k JOIN often o ON k.template = o.template AND k.whole = o.whole
        WHERE k.doc_id IS DISTINCT FROM o.first_doc AND (o.common OR k.text_key <> o.first_text) GROUP BY ALL
    )"""


@query(
    "op8_template_lines",
    f"""
    WITH {LINES_SQL}
    SELECT r.doc_id, coalesce(len(r.lines), 0)::BIGINT AS n_lines, coalesce(len(g.positions), 0)::BIGINT AS n_removed,
        sha256(coalesce(CASE WHEN g.positions IS NULL THEN r.text ELSE
            array_to_string([r.lines[i] FOR i IN range(1, len(r.lines) + 1) IF NOT list_contains(g.positions, i)], chr(10)) END, '')) AS kept_sha256
    FROM rows r LEFT JOIN gone g ON r.doc_id IS NOT DISTINCT FROM g.doc_id AND md5(r.text) = g.text_key
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = templates.drop_recurring_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(
    "op9_exact_copies",
    r"""
    WITH rows AS (
        SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
        doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256
    FROM rows WINDOW w AS (PARTITION BY bare ORDER BY points DESC, doc_id NULLS LAST)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_copies(documents(spark, sf_dir))


def components_sql(percent: int) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    near_words AS (
        SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents
    ), near_sets AS (
        SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
            ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles FROM near_words
    ), near_tokens AS (
        SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM near_sets
    ), near_links AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM near_tokens a JOIN near_tokens b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
    ), reach AS (
        SELECT doc_id AS a, doc_id AS b FROM near_sets UNION SELECT r.a, l.b FROM reach r JOIN near_links l ON r.b = l.a
    ), near_groups AS (
        SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
    )"""


@query(
    "op10_near_duplicates",
    f"""
    WITH RECURSIVE {components_sql(85)}
    SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, g.component_id, s.doc_id = g.component_id AS kept
    FROM near_sets s JOIN near_groups g ON s.doc_id = g.doc_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(documents(spark, sf_dir), percent=85)


def phrases_sql(text: str = "documents") -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    pieces AS (
        SELECT coalesce(lang, '{phrases.UNKNOWN_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM {text}
    ), worded AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
    ), totals AS (
        SELECT lang, sum(len(words))::BIGINT AS n FROM worded GROUP BY lang
    ), spelled AS (
        SELECT lang, k, words[s:s + k - 1] AS words FROM (
            SELECT *, unnest(range(1, len(words) - k + 2)) AS s FROM (SELECT lang, words, unnest(range(1, {phrases.LONGEST + 1})) AS k FROM worded)
        )
    ), counted AS (
        SELECT lang, k, array_to_string(words, ' ') AS phrase, any_value(words) AS words, count(*)::BIGINT AS a FROM spelled GROUP BY ALL
    ), frequent AS (
        SELECT * FROM counted WHERE a >= {phrases.LEAST_COUNT} AND k > 1
    ), cuts AS (
        SELECT *, array_to_string(words[1:cut], ' ') AS one, array_to_string(words[cut + 1:], ' ') AS two FROM (SELECT *, unnest(range(1, k)) AS cut FROM frequent)
    ), scored AS (
        SELECT c.lang, c.phrase, c.words, c.a, c.cut, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
        FROM cuts c JOIN counted x ON c.lang = x.lang AND c.one = x.phrase JOIN counted y ON c.lang = y.lang AND c.two = y.phrase
    ), weakest AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
    ), around AS (
        SELECT lang, array_to_string(words[s:s + m - 1], ' ') AS phrase, max(a) AS longer FROM (
            SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM frequent)
        ) GROUP BY ALL
    ), kept AS (
        SELECT w.* FROM weakest w LEFT JOIN around o ON w.lang = o.lang AND w.phrase = o.phrase
        WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * w.a
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
    )"""


@query(
    "op11_phrases",
    f"""
    WITH {phrases_sql()}
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {phrases.REPORTED}
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(documents(spark, sf_dir))


CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT)"""


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: one document in ten by the checksum of its id goes on with its own words again from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def again(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(words, lambda _, i: F.element_at(words, (place(i) + 1).cast("int"))), " ")

    words = F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))
    planted = F.transform(F.array(words), again)[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(WORD_PATTERN), planted).otherwise(F.col("text")).alias("text"))


@query(
    "op12_periodic_runs",
    rf"""
    WITH given AS (
        SELECT doc_id, {CRC_SQL} AS h, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
    ), placed AS (
        SELECT *, h // 10 AS g, len(words) AS n FROM given
    ), steps AS (
        SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM placed
    ), rows AS (
        SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [words[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1)::INT] FOR i IN range(0, n)] ELSE words END AS words FROM steps
    ), spots AS (
        SELECT doc_id, i, words[i + 1] AS word FROM (SELECT doc_id, words, unnest(range(0, n)) AS i FROM rows)
    ), pairs AS (
        SELECT x.doc_id, x.i, y.i - x.i AS q FROM spots x JOIN spots y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i
    ), stretches AS (
        SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (
            SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs
        ) GROUP BY doc_id, q, island HAVING count(*) >= q AND count(*) + q >= {periods.LEAST_WORDS}
    ), runs AS (
        SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL
    ), listed AS (
        SELECT doc_id, count(*) AS n_runs, min({{'l': -length, 's': start, 'p': period}}) AS best,
            string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
        FROM runs GROUP BY doc_id
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
    ), kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM spots ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
    )
    SELECT r.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, l.best.s::BIGINT AS start, (-l.best.l)::BIGINT AS length, l.best.p::BIGINT AS period,
        (1000 * -l.best.l // l.best.p)::BIGINT AS exponent_milli, sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.words, '')) AS collapsed_sha256
    FROM rows r LEFT JOIN listed l ON r.doc_id = l.doc_id LEFT JOIN kept k ON r.doc_id = k.doc_id
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(with_periods(documents(spark, sf_dir)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "text")
    return found.select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("-1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


@query(
    "op13_decontaminated",
    rf"""
    WITH items AS (
        SELECT item_id, regexp_extract_all(translate(text, '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '{decontaminate.ITEM_PATTERN}') AS words FROM benchmark
    ), windows AS (
        SELECT DISTINCT item_id, m, array_to_string(words[s:s + m - 1], ' ') AS line FROM (
            SELECT *, unnest(range(1, len(words) - m + 2)) AS s FROM (SELECT *, least(len(words), {decontaminate.WINDOW_WORDS}) AS m FROM items WHERE len(words) > 0)
        )
    ), rows AS (
        SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '{decontaminate.ITEM_PATTERN}'), []) AS words FROM documents
    ), places AS (
        SELECT doc_id, m, s, array_to_string(words[s:s + m - 1], ' ') AS line FROM (
            SELECT *, unnest(range(1, len(words) - m + 2)) AS s FROM rows, (SELECT DISTINCT m FROM windows)
        )
    ), found AS (
        SELECT p.doc_id, p.m, p.s, w.item_id FROM places p JOIN windows w ON p.m = w.m AND p.line = w.line
    ), hit AS (
        SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS i FROM found) GROUP BY doc_id
    ), named AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
    )
    SELECT r.doc_id, len(r.words)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(n.items, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
    FROM rows r LEFT JOIN hit h ON r.doc_id = h.doc_id LEFT JOIN named n ON r.doc_id = n.doc_id
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
