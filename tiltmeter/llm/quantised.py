"""Near-duplicate vectors by product quantisation: coarse lists, residual codes, table distances, exact rerank.

Vectors are brought to length one, where a cosine of c is a distance of sqrt(2 - 2c). Coarse centres and the codebooks of
the residuals are trained on a bounded sample; every vector is indexed. Each vector enters the lists of its nearest
centres (the probes), so two vectors meet if their probes have a list in common, whoever asks. Inside a list one side is
a query with a table of distances to all codewords and the other a code; since the distance of a vector to its code is
kept, the table distance gives a lower bound, and no linked pair is dropped by it. Survivors are compared by cosine in
double precision. A pair is counted in the first list that both have probed.

Equal vectors are one point with a number. Large lists are cut into tiles, and pairs of tiles are the unit of work; a
tile pair returns a count per point and a spanning forest, so a group of near copies never appears as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.anchors import in_runs
from tiltmeter.llm.common import components, written

#: Vectors of the training sample, by hash order.
SAMPLE = 16384
#: Members of a list on average, and the most lists there are.
LIST_MEMBERS = 64
MOST_LISTS = 2048
PROBES = 6
SUBSPACES = 8
CODEWORDS = 64
TILE_ROWS = 1024
ROUNDS = 8


@dataclass(frozen=True)
class Index:
    """Coarse centres and, per subspace, the codewords of the residuals."""

    centres: np.ndarray
    codewords: np.ndarray

    def probes(self, points: np.ndarray, n: int) -> np.ndarray:
        """The nearest centres of each point, nearest first."""
        n = min(n, len(self.centres))
        out = np.empty((len(points), n), dtype=np.int32)
        half = (self.centres**2).sum(axis=1) / 2
        for at in range(0, len(points), 4096):
            score = points[at : at + 4096] @ self.centres.T - half
            some = np.argpartition(-score, n - 1, axis=1)[:, :n]
            order = np.argsort(-np.take_along_axis(score, some, axis=1), axis=1, kind="stable")
            out[at : at + 4096] = np.take_along_axis(some, order, axis=1)
        return out

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far each residual lies from what its code stands for."""
        parts = residuals.reshape(len(residuals), SUBSPACES, -1)
        codes = np.empty((len(residuals), SUBSPACES), dtype=np.uint8)
        error = np.zeros(len(residuals))
        for s in range(SUBSPACES):
            words = self.codewords[s]
            distance = (parts[:, s] ** 2).sum(axis=1)[:, None] - 2 * parts[:, s] @ words.T + (words**2).sum(axis=1)
            codes[:, s] = distance.argmin(axis=1)
            error += ((parts[:, s] - words[codes[:, s]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def tables(self, residuals: np.ndarray) -> np.ndarray:
        """Squared distances of each query's parts to all codewords."""
        parts = residuals.reshape(len(residuals), SUBSPACES, 1, -1)
        return ((parts - self.codewords[None]) ** 2).sum(axis=3)


def k_means(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = points[draw.choice(len(points), size=min(k, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(p @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1) for p in np.array_split(points, max(1, len(points) // 4096))])
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def train(sample: np.ndarray, n_points: int) -> Index:
    lists = int(np.clip(n_points // LIST_MEMBERS, 1, min(MOST_LISTS, max(1, len(sample) // 4))))
    centres = k_means(sample, lists, 1)
    index = Index(centres, np.zeros((SUBSPACES, 1, sample.shape[1] // SUBSPACES)))
    residuals = (sample - centres[index.probes(sample, 1)[:, 0]]).reshape(len(sample), SUBSPACES, -1)
    words = [k_means(residuals[:, s], CODEWORDS, 2 + s) for s in range(SUBSPACES)]
    return Index(centres, np.stack(words))


def unit_points(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, point (doubles of length one, NULL where a vector cannot link)."""
    raw = F.col(vector_col).cast("array<double>")
    finite = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    largest = F.array_max(F.transform(raw, F.abs))
    shrunk = F.transform("raw", lambda x: x / F.col("largest"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), raw.alias("raw"), F.when(finite, largest).alias("largest"))
    rows = rows.withColumn("shrunk", F.when(F.col("largest") > 0, shrunk))
    norm = F.sqrt(F.aggregate("shrunk", F.lit(0.0), lambda t, x: t + x * x))
    return rows.select("vec_id", F.transform("shrunk", lambda x: x / norm).alias("point"))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def inverted_lists(points: DataFrame, index: Index, probes: int) -> DataFrame:
    """list, point_id, probes, code, error, point: an entry for each list that a point probes."""
    schema = "list int, point_id long, n long, probes array<int>, code binary, error double, point array<double>"

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column(2))
            probed = index.probes(matrix, probes)
            row = np.repeat(np.arange(len(matrix)), probed.shape[1])
            lists = probed.ravel()
            codes, error = index.encode(matrix[row] - index.centres[lists])
            take = pa.array(row)
            probe_lists = pa.ListArray.from_arrays(np.arange(0, probed.size + 1, probed.shape[1], dtype=np.int32), probed.ravel())
            columns = [pa.array(lists), batch.column(0).take(take), batch.column(1).take(take), probe_lists.take(take)]
            columns += [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), batch.column(2).take(take)]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "point_id", "n", "probes", "code", "error", "point"])

    return points.select("point_id", "n", "point").mapInArrow(enter, schema)


def tile_links(entries: DataFrame, index: Index, cosine: float) -> DataFrame:
    """point_id, links (other vectors linked, counted here) and near (a point it is tied to in this tile pair)."""
    radius = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in in_runs(batches, "group", lambda t: np.ones(t.num_rows, np.int64), 1):
            ids, number = run.column("point_id").to_numpy(), run.column("n").to_numpy()
            side, this = run.column("side").to_numpy(), int(run.column("list")[0].as_py())
            points, probed, error = _matrix(run.column("point")), _matrix(run.column("probes")), run.column("error").to_numpy()
            codes = np.frombuffer(b"".join(run.column("code").to_pylist()), np.uint8).reshape(-1, SUBSPACES)
            left = np.flatnonzero(side != 1)
            right = np.flatnonzero(side != 0)
            links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
            tables = None
            for at in range(0, len(left), 256):
                some = left[at : at + 256]
                tables = index.tables(points[some] - index.centres[this])
                estimate = np.zeros((len(some), len(right)))
                for s in range(SUBSPACES):
                    estimate += tables[:, s][:, codes[right, s]]
                near = np.sqrt(np.maximum(estimate, 0)) - error[right][None, :] <= radius
                i, j = np.nonzero(near)
                i, j = some[i], right[j]
                keep = ids[i] != ids[j] if side[0] == 2 and side[-1] == 2 else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                ok = np.einsum("ij,ij->i", points[i], points[j]) >= cosine
                i, j = i[ok], j[ok]
                first = _first_common(probed[i], probed[j]) == this
                i, j = i[first], j[first]
                np.add.at(links, i, number[j])
                if not (side[0] == 2 and side[-1] == 2):
                    np.add.at(links, j, number[i])
                root = _tie(root, i, j)
            hit = np.flatnonzero(links > 0)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[root[hit]])], names=["point_id", "links", "near"])

    dealt = entries.repartition("group").sortWithinPartitions("group", "side")
    return dealt.mapInArrow(link, "point_id long, links long, near long")


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest list in both rows of probes."""
    shared = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return np.where(shared, a, np.iinfo(np.int32).max).min(axis=1)


def _tie(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of a forest after the links i-j: the smallest position reachable."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above
    return root


def linked_vectors(vectors: DataFrame, cosine: float = 0.95, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding", tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Two vectors link if their cosine in double precision is at least ``cosine``. Vectors that are NULL, empty or zero,
    or hold NULL or non-finite components, link with nothing. All others must have one length, a multiple of the
    number of subspaces. ``n_links`` counts rows with another id or other vector; rows that repeat an id and vector
    are one. A row without an id links with nothing and is kept, with a NULL component. Other columns are not read.
    No rows in, no rows out.
    """
    rows = written(unit_points(vectors, id_col, vector_col))
    real = rows.where("point is not null and size(point) > 0 and vec_id is not null").dropDuplicates(["vec_id", "point"])
    points = written(real.groupBy("point").agg(F.min("vec_id").alias("point_id"), F.count(F.lit(1)).alias("n")))
    total = points.count()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    chosen = points.orderBy(F.xxhash64("point")).limit(SAMPLE).select("point").toArrow()
    index = train(_matrix(chosen.column("point")), total)

    entries = written(inverted_lists(points, index, probes))
    sizes = entries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles"))
    tiled = entries.join(sizes, "list").withColumn("tile", F.pmod(F.xxhash64("point_id"), F.col("tiles")).cast("int"))
    # A tile meets itself (side 2), and every other tile once: as the left one if it has the smaller number.
    others = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    side = F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1)
    paired = others.withColumn("side", side).withColumn("group", F.xxhash64("list", low, high))
    found = written(tile_links(paired.select("group", "side", "list", "point_id", "n", "probes", "code", "error", "point"), index, cosine))

    counts = found.groupBy("point_id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("point_id").alias("a"), F.col("near").alias("b")))
    known = points.join(counts, "point_id", "left").join(groups.withColumnRenamed("node", "point_id"), "point_id", "left")
    known = known.select(F.col("point").alias("__point"), "point_id", "n", "links", "component")
    out = rows.join(known, F.col("point") == F.col("__point"), "left")
    linked = F.col("vec_id").isNotNull() & F.col("point_id").isNotNull()
    component = F.when(linked, F.coalesce("component", "point_id")).otherwise(F.col("vec_id"))
    n_links = F.when(linked, F.col("n") - 1 + F.coalesce("links", F.lit(0))).otherwise(0)
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
