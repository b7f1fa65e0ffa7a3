"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its 5-word shingles; equal sets are one class from the start. A class has 64 minwise tokens. In a
tree, a node selects two of the 64 positions by its path and passes every class on to the child named by the class's
token there. Two classes share a child with a probability of at least their similarity; several trees with other
selections bring the recall to its target. Nodes that are small enough are compared exhaustively.

Two passes keep the work on links that matter for the components:

1. Every small node proposes a maximum spanning forest of its likely pairs, every large one a star around its smallest
   class. The proposals are confirmed on full sets and give a first labelling.
2. Nodes that still hold several labels are compared exhaustively, on full sets and at once: the sizes of all
   intersections are one product of incidence matrices. They return links between labels, a forest of them. Large
   nodes branch on until they are small; what is large at the last level is compared in blocks, the classes outside its
   most frequent label against all.

So a group of near copies costs a star and not all its pairs, no pair leaves a node unconfirmed in the second pass, and
none between two labels is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.anchors import in_runs, keyed_text
from tiltmeter.llm.common import Rolling, as_long, byte_blocks, components, mix, word_hashes, word_spans, written

SHINGLE_WORDS = 5
POSITIONS = 64
#: Independent trees, positions selected in a node, levels of branching.
TREES = 4
BRANCHES = 2
LEVELS = 3
#: Classes of a node that is compared exhaustively in one place.
SMALL_NODE = 256
#: Rows of a block of a large node at the last level.
BLOCK_ROWS = 512
PART_ROWS = 2048
#: Shingles in the columns of an incidence matrix, and bytes of texts compared at once.
WORD_COLUMNS = 4096
SET_BYTES = 8 << 20
#: Estimates this far below the threshold are still confirmed: four standard deviations of 64 tokens.
SLACK = 0.2

WORD_SEED, SHINGLE_SEED = 21, 22
_MULTIPLIERS = np.random.default_rng(23).integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Sorted distinct shingle fingerprints of each row of a column of texts."""

    def __init__(self, width: int) -> None:
        self.width, self.words, self.shingles = width, Rolling(WORD_SEED), Rolling(SHINGLE_SEED)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        for first, end, data, bounds in byte_blocks(column):
            spans = word_spans(data, bounds)
            prefix = self.shingles.prefix(word_hashes(data, spans, self.words, lower=True))
            rows = np.searchsorted(spans[2], np.arange(end - first + 1))
            every = self.shingles.every(prefix, self.width) if len(prefix) > self.width else np.empty(0, np.uint64)
            for a, b in zip(rows[:-1], rows[1:]):
                if b - a >= self.width:
                    found = np.sort(every[a : b - self.width + 1])
                    yield found[np.r_[True, found[1:] != found[:-1]]]
                elif b > a:
                    yield self.shingles.runs(prefix, np.array([a]), np.array([b]))
                else:
                    yield np.empty(0, np.uint64)


def minwise(shingles: np.ndarray) -> np.ndarray:
    tokens = np.full(POSITIONS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(shingles), 2048):
        hashed = (shingles[None, at : at + 2048] * _MULTIPLIERS[:, None]) >> np.uint64(32)
        tokens = np.minimum(tokens, hashed.min(axis=1).astype(np.uint32))
    return tokens


def set_table(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n (size of the set), s1, s2 (its fingerprint), tokens (its minwise tokens)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            n, s1, s2, tokens = [], [], [], []
            with np.errstate(over="ignore"):
                for found in shingler.sets(batch.column(2)):
                    n.append(len(found))
                    s1.append(mix(found).sum(dtype=np.uint64))
                    s2.append(mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    tokens.append(minwise(found).tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(as_long(np.array(s1, np.uint64)))]
            columns += [pa.array(as_long(np.array(s2, np.uint64))), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n", "s1", "s2", "tokens"])

    return rows.mapInArrow(build, f"doc_id {kind}, text_key long, n long, s1 long, s2 long, tokens binary")


def children(nodes: DataFrame) -> DataFrame:
    """path, doc_id, text_key of the children of rows (path, doc_id, text_key, tokens)."""
    kind = nodes.schema["doc_id"].dataType.simpleString()

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            tokens = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, POSITIONS)
            first = mix(path) % np.uint64(POSITIONS)
            gap = mix(path ^ np.uint64(0x5BD1E995)) % np.uint64(POSITIONS - 1) + np.uint64(1)
            for b in range(BRANCHES):
                spot = (first + np.uint64(b) * gap) % np.uint64(POSITIONS)
                token = tokens[np.arange(len(path)), spot.astype(np.int64)].astype(np.uint64)
                child = mix(mix(path + spot + np.uint64(1)) ^ token)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(child)), batch.column(1), batch.column(2)], names=["path", "doc_id", "text_key"])

    return nodes.select("path", "doc_id", "text_key", "tokens").mapInArrow(branch, f"path long, doc_id {kind}, text_key long")


def _tokens_of(run: pa.Table | pa.RecordBatch, name: str = "tokens") -> np.ndarray:
    return np.frombuffer(b"".join(run.column(name).to_pylist()), np.uint32).reshape(-1, POSITIONS)


def _likely(tokens_a, tokens_b, n_a, n_b, percent: int) -> np.ndarray:
    """Estimated similarity of every a with every b; -1 where it cannot reach the threshold."""
    estimate = np.empty((len(tokens_a), len(tokens_b)), dtype=np.float32)
    for i in range(len(tokens_a)):
        estimate[i] = (tokens_b == tokens_a[i]).mean(axis=1)
    low, high = np.minimum(n_a[:, None], n_b[None, :]), np.maximum(n_a[:, None], n_b[None, :])
    estimate[(100 * low < percent * high) | (estimate < percent / 100 - SLACK)] = -1
    return estimate


def spanning_forest(estimate: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a maximum spanning forest of a symmetric matrix; negative entries are no links."""
    n = len(estimate)
    best, link = np.full(n, -1.0), np.zeros(n, dtype=np.int64)
    outside, pairs, at = np.ones(n, dtype=bool), [], 0
    for _ in range(n):
        outside[at] = False
        better = outside & (estimate[at] > best)
        best[better], link[better] = estimate[at][better], at
        if not outside.any():
            break
        at = int(np.argmax(np.where(outside, best, -2.0)))
        if best[at] >= 0:
            pairs.append((int(link[at]), at))
    return pairs


EDGE = ["a_id", "a_key", "b_id", "b_key"]


def _edge_schema(kind: str) -> str:
    return f"a_id {kind}, a_key long, b_id {kind}, b_key long"


def small_node_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Spanning forests of the likely pairs of each node in (path, doc_id, text_key, n, tokens)."""
    kind = members.schema["doc_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in in_runs(batches, "path", lambda t: np.ones(t.num_rows, np.int64), 1 << 13):
            path, n = run.column("path").to_numpy(), run.column("n").to_numpy()
            tokens = _tokens_of(run)
            firsts = np.r_[np.flatnonzero(np.r_[True, path[1:] != path[:-1]]), len(path)]
            left, right = [], []
            for a, b in zip(firsts[:-1], firsts[1:]):
                if b - a < 2:
                    continue
                estimate = _likely(tokens[a:b], tokens[a:b], n[a:b], n[a:b], percent)
                for i, j in spanning_forest(estimate):
                    left.append(a + i)
                    right.append(a + j)
            if left:
                yield _pairs(run, np.array(left), np.array(right))

    dealt = members.select("path", "doc_id", "text_key", "n", "tokens").repartition("path").sortWithinPartitions("path")
    return dealt.mapInArrow(compare, _edge_schema(kind))


def _pairs(run: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    ids, keys = run.column("doc_id").combine_chunks(), run.column("text_key").combine_chunks()
    a, b = pa.array(left), pa.array(right)
    return pa.RecordBatch.from_arrays([ids.take(a), keys.take(a), ids.take(b), keys.take(b)], names=EDGE)


def star_pairs(members: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of the members of large nodes with the leader of each."""
    kind = members.schema["doc_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            same = (_tokens_of(batch) == _tokens_of(batch, "l_tokens")).mean(axis=1)
            n, m = batch.column("n").to_numpy(), batch.column("l_n").to_numpy()
            ok = (same >= percent / 100 - SLACK) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            take = pa.array(np.flatnonzero(ok))
            columns = [batch.column(c).take(take) for c in ("doc_id", "text_key", "l_id", "l_key")]
            yield pa.RecordBatch.from_arrays(columns, names=EDGE)

    both = members.join(leaders, "path").where(F.col("text_key") != F.col("l_key"))
    return both.select("doc_id", "text_key", "n", "tokens", "l_id", "l_key", "l_n", "l_tokens").mapInArrow(compare, _edge_schema(kind))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of incidence matrices."""
    count = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    words = np.intersect1d(sides[0][0], sides[1][0])
    spots = []
    for values, row in sides:
        spot = np.minimum(np.searchsorted(words, values), max(0, len(words) - 1))
        known = words[spot] == values if len(words) else np.zeros(len(values), bool)
        order = np.argsort(spot[known], kind="stable")
        spots.append((spot[known][order], row[known][order]))
    for at in range(0, len(words), WORD_COLUMNS):
        blocks = []
        for (spot, row), sets in zip(spots, (left, right)):
            a, b = np.searchsorted(spot, [at, at + WORD_COLUMNS])
            block = np.zeros((len(sets), min(WORD_COLUMNS, len(words) - at)), dtype=np.float32)
            block[row[a:b], spot[a:b] - at] = 1
            blocks.append(block)
        count += blocks[0] @ blocks[1].T
    return count.astype(np.int64)


def label_links(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Positions of confirmed links between different labels, left to right, that tie the labels to a forest."""
    sizes = np.array([len(x) for x in sets])
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for at in range(0, len(right), PART_ROWS):
        some = right[at : at + PART_ROWS]
        both = shared_counts([sets[i] for i in left], [sets[j] for j in some])
        apart = label[left][:, None] != label[some][None, :]
        i, j = np.nonzero(apart & (100 * both >= percent * (sizes[left][:, None] + sizes[some][None, :] - both)))
        pairs = np.stack([label[left[i]], label[some[j]]], axis=1)
        for k in np.unique(np.sort(pairs, axis=1), axis=0, return_index=True)[1] if len(i) else ():
            found.setdefault(tuple(sorted(pairs[k].tolist())), (int(left[i[k]]), int(some[j[k]])))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for (a, b), link in found.items():
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append(link)
    return out


def node_links(members: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: confirmed links between the labels of each group in (group, side, doc_id, label, text).

    Side 2 is compared with itself; otherwise side 0 with side 1. Texts travel rather than sets, as they compress.
    """
    kind = members.schema["doc_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        sizes = lambda t: 1 + pc.binary_length(t.column("text")).to_numpy().astype(np.int64)
        for run in in_runs(batches, "group", sizes, SET_BYTES):
            group, side = run.column("group").to_numpy(), run.column("side").to_numpy()
            label = run.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            sets = list(shingler.sets(run.column("text")))
            left, right = [], []
            firsts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
            for a, b in zip(firsts[:-1], firsts[1:]):
                one, other = a + np.flatnonzero(side[a:b] != 1), a + np.flatnonzero(side[a:b] != 0)
                if len(one) and len(other):
                    for i, j in label_links(sets, label, one, other, percent):
                        left.append(i)
                        right.append(j)
            if left:
                ids = run.column("doc_id").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(left)), ids.take(pa.array(right))], names=["a", "b"])

    dealt = members.select("group", "side", "doc_id", "label", "text").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(compare, f"a {kind}, b {kind}")


def blocks_of_large(members: DataFrame) -> DataFrame:
    """Large nodes as groups of bounded size: rows outside the most frequent label, in blocks, with parts of all rows.

    ``members``: path, doc_id, text_key, label, size, lead (the most frequent label), minor (rows outside it).
    """
    n_blocks = F.ceil(F.col("minor") / BLOCK_ROWS).cast("int")
    n_parts = F.ceil(F.col("size") / PART_ROWS).cast("int")
    minor = members.where(F.col("label") != F.col("lead")).withColumn("block", F.pmod(F.xxhash64("text_key"), n_blocks).cast("int"))
    left = minor.withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1))).withColumn("side", F.lit(0))
    right = members.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key"), n_parts).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1))).withColumn("side", F.lit(1))
    both = left.unionByName(right).withColumn("group", F.xxhash64("path", "block", "part"))
    return both.select("group", "side", "doc_id", "text_key", "label")


def confirmed(edges: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b (ids), both ways confirmed on the full sets: 100 * intersection >= percent * union."""
    kind = edges.schema["a_id"].dataType.simpleString()
    swap = F.struct("a_id", "a_key") > F.struct("b_id", "b_key")
    ends = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in zip(EDGE, EDGE[2:] + EDGE[:2])]
    edges = edges.select(*ends).distinct()
    for end in ("a", "b"):
        side = texts.select(F.col("doc_id").alias(f"{end}_id"), F.col("text_key").alias(f"{end}_key"), F.col("text").alias(f"{end}_text"))
        edges = edges.join(side, [f"{end}_id", f"{end}_key"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            ok = []
            for a, b in zip(shingler.sets(batch.column(2)), shingler.sets(batch.column(3))):
                both = np.sort(np.concatenate([a, b]))
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(both) - shared))
            take = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], names=["a", "b"])

    return written(edges.select("a_id", "b_id", "a_text", "b_text").mapInArrow(check, f"a {kind}, b {kind}"))


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    width: int = SHINGLE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    trees: int = TREES,
    levels: int = LEVELS,
    small_node: int = SMALL_NODE,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Texts link if the Jaccard similarity of their shingle sets is at least ``percent`` hundredths; A-Z are lower-cased.
    A text of fewer words than ``width`` is one shingle. NULL texts and texts without words have an empty set and link
    with nothing. ``component_id`` is the smallest id that links reach; ``kept`` is true where it is the row's own.
    Rows with equal sets always link. Rows that repeat an id are one node, with the links of all of them. A row without
    an id links with nothing and is kept, with a NULL component. Other columns are not read. No rows in, no rows out.
    """
    rows = keyed_text(docs, id_col, text_col)
    sets = written(set_table(rows, width))
    low = F.min(F.struct("doc_id", "text_key")).alias("low")
    real = sets.where("n > 0 and doc_id is not null")
    classes = real.groupBy("s1", "s2", "n").agg(low, F.first("tokens").alias("tokens"))
    classes = written(classes.select("s1", "s2", "n", "low.doc_id", "low.text_key", "tokens"))
    tokens = classes.select("doc_id", "text_key", "n", "tokens")

    roots = tokens.withColumn("path", F.explode(F.array(*[F.lit(r + 1).cast("long") for r in range(trees)])))
    nodes = children(roots.select("path", "doc_id", "text_key", "tokens"))
    sizes = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc_id", "text_key")).alias("lead"))
    # Written, so that the join finds two shuffled sides and a node of very many classes can be split.
    nodes = nodes.join(written(sizes.where("size > 1")), "path").join(tokens, ["doc_id", "text_key"])
    nodes = written(nodes)

    large = nodes.where(F.col("size") > small_node)
    leaders = large.where((F.col("lead.doc_id") == F.col("doc_id")) & (F.col("lead.text_key") == F.col("text_key")))
    leaders = leaders.select("path", F.col("doc_id").alias("l_id"), F.col("text_key").alias("l_key"), F.col("n").alias("l_n"), F.col("tokens").alias("l_tokens"))
    first = small_node_pairs(nodes.where(F.col("size") <= small_node), percent)
    first = first.unionByName(star_pairs(large, leaders, percent))
    met = nodes.select("doc_id", "text_key").distinct()
    texts = written(rows.join(met, ["doc_id", "text_key"]))
    proved = confirmed(first, texts, width, percent)

    labels = components(proved)
    more = written(_between_labels(nodes, labels, texts, width, percent, levels, small_node))
    reps = classes.select("s1", "s2", "n", F.col("doc_id").alias("node"))
    # Rows that repeat an id with other texts tie their classes together.
    again = real.groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "n")).alias("x"), F.max(F.struct("s1", "s2", "n")).alias("y"))
    again = real.join(again.where("x <> y").select("doc_id"), "doc_id").join(reps, ["s1", "s2", "n"])
    ties = again.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    final = components(proved.unionByName(more).unionByName(ties))

    node = reps.join(final, "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("least"))
    linked = sets.select("doc_id", "n", "s1", "s2").join(node, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("least"), F.col("doc_id")))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _between_labels(nodes: DataFrame, labels: DataFrame, texts: DataFrame, width: int, percent: int, levels: int, small_node: int) -> DataFrame:
    """a, b: confirmed links between different labels, from all nodes that hold several."""
    labels = labels.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "label")
    known = nodes.select("path", "doc_id", "text_key", "tokens").join(labels, "doc_id", "left")
    known = known.withColumn("label", F.coalesce("label", "doc_id"))
    groups = None
    for level in range(1, levels + 1):
        mixed = known.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
        known = written(known.join(written(mixed.where("low <> high").drop("low", "high")), "path"))
        small = known.where(F.col("size") <= small_node)
        small = small.select(F.col("path").alias("group"), F.lit(2).alias("side"), "doc_id", "text_key", "label")
        groups = small if groups is None else groups.unionByName(small)
        large = known.where(F.col("size") > small_node)
        if large.isEmpty():
            break
        if level < levels:
            grown = children(large.select("path", "doc_id", "text_key", "tokens"))
            carried = large.select("doc_id", "text_key", "tokens", "label").dropDuplicates(["doc_id", "text_key"])
            known = grown.join(carried, ["doc_id", "text_key"])
        else:
            counts = large.groupBy("path", "label").agg(F.count(F.lit(1)).alias("of"))
            lead = counts.groupBy("path").agg(F.max(F.struct("of", "label")).alias("most"), F.sum("of").alias("size"))
            lead = lead.select("path", F.col("most.label").alias("lead"), (F.col("size") - F.col("most.of")).alias("minor"))
            groups = groups.unionByName(blocks_of_large(large.join(lead, "path")))
    return node_links(groups.join(texts, ["doc_id", "text_key"]), width, percent)
