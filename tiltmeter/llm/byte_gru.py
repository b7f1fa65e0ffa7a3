"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

The network reads segments of a text byte by byte, left to right and right to left, and gives every position a
distribution over the languages; a document's distribution is the mean over all its positions. Training minimises the
cross entropy of every position by backpropagation through time. It sees a bounded sample of labelled documents; the
prediction sees every byte of every text and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.common import byte_blocks, mix, short_batches, text_column

SEGMENT = 64
HIDDEN = 12
#: Labelled documents per language to learn from, and segments of each.
SAMPLE_DOCS = 600
SAMPLE_SEGMENTS = 6
EPOCHS = 8
BATCH = 256
RATE = 0.02
UNDETERMINED = "und"
#: Segments run through the network at once.
WIDE = 1024


@dataclass
class Network:
    """Per direction: gate inputs of each byte (256 x 3h) and the recurrent weights (h x 3h); the output layer (2h x c)."""

    table: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.recur, self.out, self.bias]

    @classmethod
    def fresh(cls, n_labels: int, seed: int = 1) -> Network:
        draw = np.random.default_rng(seed)
        normal = lambda *shape: draw.normal(0, 0.3, shape).astype(np.float32)
        return cls(normal(2, 256, 3 * HIDDEN), normal(2, HIDDEN, 3 * HIDDEN), normal(2 * HIDDEN, n_labels), np.zeros(n_labels, np.float32))


def gates(x: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Update and reset gate and the candidate state, from the byte's inputs and the carried state's."""
    h = HIDDEN
    both = np.tanh((x[:, : 2 * h] + carried[:, : 2 * h]) * np.float32(0.5))
    both *= np.float32(0.5)
    both += np.float32(0.5)
    update, reset = both[:, :h], both[:, h:]
    return update, reset, np.tanh(x[:, 2 * h :] + reset * carried[:, 2 * h :])


def run(network: Network, segments: np.ndarray, keep: bool = False):
    """States of both directions at every position, (t, n, 2h). Padding must be at the end and zero."""
    n, steps = segments.shape
    states = np.empty((steps, n, 2 * HIDDEN), dtype=np.float32)
    trace = []
    for side in (0, 1):
        order = range(steps) if side == 0 else range(steps - 1, -1, -1)
        state = np.zeros((n, HIDDEN), dtype=np.float32)
        part = states[:, :, side * HIDDEN : (side + 1) * HIDDEN]
        for t in order:
            carried = state @ network.recur[side]
            update, reset, candidate = gates(network.table[side][segments[:, t]], carried)
            after = candidate + update * (state - candidate)
            if keep:
                trace.append((side, t, state, carried, update, reset, candidate))
            part[t] = state = after
    return (states, trace) if keep else states


def probabilities(network: Network, states: np.ndarray) -> np.ndarray:
    score = states @ network.out + network.bias
    score -= score.max(axis=-1, keepdims=True)
    np.exp(score, out=score)
    score /= score.sum(axis=-1, keepdims=True)
    return score


def gradients(network: Network, segments: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions, and its gradients back through time."""
    n, steps = segments.shape
    h = HIDDEN
    states, trace = run(network, segments, keep=True)
    chance = probabilities(network, states)
    loss = float(-np.log(chance[:, np.arange(n), labels] + 1e-9).mean())
    chance[:, np.arange(n), labels] -= 1
    chance /= n * steps
    flat = states.reshape(-1, 2 * h)
    out, bias = flat.T @ chance.reshape(-1, chance.shape[2]), chance.sum(axis=(0, 1))
    back = chance @ network.out.T
    table, recur = np.zeros_like(network.table), np.zeros_like(network.recur)
    flow = {0: np.zeros((n, h), np.float32), 1: np.zeros((n, h), np.float32)}
    for side, t, state, carried, update, reset, candidate in reversed(trace):
        d_after = flow[side] + back[t, :, side * h : (side + 1) * h]
        d_candidate = d_after * (1 - update) * (1 - candidate**2)
        d_update = d_after * (state - candidate) * update * (1 - update)
        d_reset = d_candidate * carried[:, 2 * h :] * reset * (1 - reset)
        d_input = np.concatenate([d_update, d_reset, d_candidate], axis=1)
        d_carried = np.concatenate([d_update, d_reset, d_candidate * reset], axis=1)
        np.add.at(table[side], segments[:, t], d_input)
        recur[side] += state.T @ d_carried
        flow[side] = d_after * update + d_carried @ network.recur[side].T
    return loss, [table, recur, out.astype(np.float32), bias.astype(np.float32)]


def train(segments: np.ndarray, labels: np.ndarray, n_labels: int, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam over shuffled batches with a rate that falls to nothing; the same sample gives the same network."""
    network, draw = Network.fresh(n_labels), np.random.default_rng(seed)
    first, second = ([np.zeros_like(p) for p in network.parts()] for _ in range(2))
    step, last = 0, max(1, epochs * -(-len(segments) // BATCH))
    for _ in range(epochs):
        for some in np.array_split(draw.permutation(len(segments)), max(1, -(-len(segments) // BATCH))):
            _, slopes = gradients(network, segments[some], labels[some])
            step += 1
            for part, slope, m, v in zip(network.parts(), slopes, first, second):
                m += 0.1 * (slope - m)
                v += 0.01 * (slope**2 - v)
                rate = RATE * (1 - (step - 1) / last)
                part -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def cut_segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segments, length, row) of all rows of a block; the last segment of a row is padded with zeros."""
    sizes = np.diff(bounds)
    per_row = -(-sizes // SEGMENT)
    row = np.repeat(np.arange(len(sizes)), per_row)
    within = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = bounds[row] + within * SEGMENT
    length = np.minimum(SEGMENT, bounds[row + 1] - start)
    padded = np.r_[data, np.zeros(SEGMENT, np.uint8)]
    segments = padded[start[:, None] + np.arange(SEGMENT)]
    segments[np.arange(SEGMENT)[None, :] >= length[:, None]] = 0
    return segments, length, row


def in_fold(id_col: str = "doc_id"):
    """True for the documents held out: the crc32 of the id as text is a multiple of five. A NULL id is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_segments(docs: DataFrame, docs_per_label: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, segments and labels, from about ``docs_per_label`` documents of each language.

    Only what training needs reaches the driver: a row per language, and a few segments per sampled document.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), text_column(docs, text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return [], np.empty((0, SEGMENT), np.uint8), np.empty(0, np.int64)
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, F.lit(docs_per_label / n)).otherwise(chance)
    draw = F.pmod(F.xxhash64("text", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < chance).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, bounds in byte_blocks(batch.column(1)):
                segments, length, row = cut_segments(data, bounds)
                sizes = np.bincount(row, minlength=len(bounds) - 1)
                within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                # Evenly spread over the text, full segments before the last short one.
                every = np.maximum(1, sizes[row] // SAMPLE_SEGMENTS)
                take = np.flatnonzero((within % every == 0) & (within // every < SAMPLE_SEGMENTS))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[take] + first)), pa.array([s.tobytes() for s in segments[take]], pa.binary())], names=["lang", "segment"])

    rows = sample.mapInArrow(cut, "lang string, segment binary").toArrow()
    langs = sorted(counts)
    segments = np.frombuffer(b"".join(rows.column("segment").to_pylist()), np.uint8).reshape(-1, SEGMENT)
    labels = np.array([langs.index(x) for x in rows.column("lang").to_pylist()], dtype=np.int64)
    order = np.lexsort((mix(segments.copy().view(np.uint64)[:, 0]), labels))
    return langs, segments[order], labels[order]


def learn(docs: DataFrame, docs_per_label: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], Network | None]:
    """The languages and a network, from the documents that are not held out."""
    langs, segments, labels = labelled_segments(docs.where(~in_fold(id_col)), docs_per_label, id_col, text_col, lang_col)
    return langs, train(segments, labels, len(langs)) if len(segments) else None


def predict(docs: DataFrame, langs: list[str], network: Network | None, text_col: str = "text") -> DataFrame:
    """The input rows with ``lang_pred`` and ``score`` (0 to 1), the mean probability of that language over all bytes.

    A text that is NULL or has no letter is ``und`` with score 0, and so is every text if there was nothing to learn
    from. Ties go to the language that sorts first. Input columns of these names are replaced. No rows in, no rows out.
    """
    docs = docs.drop("lang_pred", "score")
    short_batches(docs.sparkSession)
    if network is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})

    @F.pandas_udf("struct<label: int, score: double>")
    def judge(texts):
        import pandas as pd

        chances = pooled(network, pa.array(texts, pa.string()))
        label = chances.argmax(axis=1)
        return pd.DataFrame({"label": label.astype(np.int32), "score": chances[np.arange(len(label)), label]})

    names = F.array(*[F.lit(x) for x in langs])
    text = F.col("row")[text_col]
    known = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    judged = docs.select(F.struct(*docs.columns).alias("row"), judge(text_column(docs, text_col)).alias("judged"))
    return judged.select(
        *[F.col("row")[c].alias(c) for c in docs.columns],
        F.when(known, F.element_at(names, F.col("judged.label") + 1)).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(known, F.least(F.col("judged.score"), F.lit(1.0))).otherwise(0.0).alias("score"),
    )


def segment_chances(network: Network, segments: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums over the positions of each segment of their language probabilities, (n, c).

    The same network as ``run`` with one row per unit, so that every gate is a contiguous block worked on in place.
    """
    n, steps = segments.shape
    h = HIDDEN
    halved = np.where(np.arange(3 * h) < 2 * h, 0.5, 1.0).astype(np.float32)[:, None]
    spots = np.ascontiguousarray(segments.T).astype(np.intp)
    score = np.empty((steps, len(network.bias), n), dtype=np.float32)
    inputs, carried = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
    gate, candidate = carried[: 2 * h], carried[2 * h :]
    for side in (0, 1):
        table = np.ascontiguousarray(network.table[side].T * halved)
        recur = np.ascontiguousarray(network.recur[side].T * halved)
        out = np.ascontiguousarray(network.out[side * h : (side + 1) * h].T)
        state = np.zeros((h, n), dtype=np.float32)
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            np.take(table, spots[t], axis=1, out=inputs, mode="clip")
            np.dot(recur, state, out=carried)
            gate += inputs[: 2 * h]
            np.tanh(gate, out=gate)
            gate *= np.float32(0.5)
            gate += np.float32(0.5)
            candidate *= gate[h:]
            candidate += inputs[2 * h :]
            np.tanh(candidate, out=candidate)
            state -= candidate
            state *= gate[:h]
            state += candidate
            if side == 0:
                np.dot(out, state, out=score[t])
            else:
                score[t] += out @ state
    score += network.bias[None, :, None]
    score -= score.max(axis=1, keepdims=True)
    np.exp(score, out=score)
    score /= score.sum(axis=1, keepdims=True)
    inside = (np.arange(steps)[:, None] < length[None, :]).astype(np.float32)
    return np.einsum("tcn,tn->nc", score, inside)


def pooled(network: Network, texts: pa.Array) -> np.ndarray:
    """Mean over all positions of the language probabilities of each text; zeros for an empty one."""
    total = np.zeros((len(texts), len(network.bias)))
    for first, end, data, bounds in byte_blocks(texts):
        segments, length, row = cut_segments(data, bounds)
        for at in range(0, len(segments), WIDE):
            some = slice(at, at + WIDE)
            sums = segment_chances(network, segments[some], length[some])
            for c in range(total.shape[1]):
                total[first:end, c] += np.bincount(row[some], sums[:, c], minlength=end - first)
        total[first:end] /= np.maximum(np.diff(bounds), 1)[:, None]
    return total
