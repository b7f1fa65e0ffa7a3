"""Exact deduplication: counting quotient filters find repeated fingerprints, their rows are compared byte by byte.

A row's normalised text is its text without ASCII white space. Each partition counts the 64-bit fingerprints of its
rows in a counting quotient filter, cut into blocks by the top bits of the quotient. Blocks of all partitions are
merged by their sorted remainders, which loses nothing: the merged filter is the one that a single pass would have
built. Only rows whose fingerprint was counted more than once go on to the comparison of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.common import SPACE_PATTERN, text_column, written

QUOTIENT_BITS = 40
BLOCK_BITS = 12


class CountingQuotientFilter:
    """Fingerprints of 64 bits as quotient runs of sorted remainders with counts.

    ``occupied`` are the quotients in use, ``run_ends`` where each one's run of remainders ends. Within a run the
    remainders ascend, so two filters merge by one ordered pass over both.
    """

    def __init__(self, occupied, run_ends, remainders, counts) -> None:
        self.occupied, self.run_ends, self.remainders, self.counts = occupied, run_ends, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, bits: int = QUOTIENT_BITS):
        order = np.argsort(fingerprints, kind="stable")
        ordered = fingerprints[order].astype(np.uint64)
        weight = np.ones(len(ordered), dtype=np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
        weight = np.add.reduceat(weight, first) if len(first) else weight
        ordered = ordered[first]
        quotients = ordered >> np.uint64(64 - bits)
        remainders = (ordered & np.uint64((1 << (64 - bits)) - 1)).astype(np.uint32 if bits >= 32 else np.uint64)
        ends = np.flatnonzero(np.r_[quotients[1:] != quotients[:-1], True][: len(quotients)]) + 1
        return cls(quotients[ends - 1] if len(ends) else quotients, ends.astype(np.int64), remainders, weight)

    def fingerprints(self, bits: int = QUOTIENT_BITS) -> np.ndarray:
        lengths = np.diff(self.run_ends, prepend=0)
        return (np.repeat(self.occupied, lengths) << np.uint64(64 - bits)) | self.remainders.astype(np.uint64)

    def merge(self, other: CountingQuotientFilter, bits: int = QUOTIENT_BITS) -> CountingQuotientFilter:
        fingerprints = np.concatenate([self.fingerprints(bits), other.fingerprints(bits)])
        return type(self).of(fingerprints, np.concatenate([self.counts, other.counts]), bits)

    def blocks(self, block_bits: int, bits: int = QUOTIENT_BITS) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """Parts by the top bits of the quotient; a run never straddles two."""
        if not len(self.occupied):
            return
        block = (self.occupied >> np.uint64(bits - block_bits)).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            low = int(self.run_ends[a - 1]) if a else 0
            high = int(self.run_ends[b - 1])
            part = type(self)(self.occupied[a:b], self.run_ends[a:b] - low, self.remainders[low:high], self.counts[low:high])
            yield int(block[a]), part

    def to_bytes(self) -> bytes:
        head = np.array([len(self.occupied), len(self.remainders), self.remainders.itemsize], dtype=np.int64)
        parts = (head, self.occupied, self.run_ends.astype(np.int64), self.counts.astype(np.int64), self.remainders)
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        runs, n, item = (int(x) for x in np.frombuffer(raw, dtype=np.int64, count=3))
        at = 24
        occupied = np.frombuffer(raw, dtype=np.uint64, count=runs, offset=at)
        ends = np.frombuffer(raw, dtype=np.int64, count=runs, offset=at + 8 * runs)
        counts = np.frombuffer(raw, dtype=np.int64, count=n, offset=at + 16 * runs)
        kind = np.uint32 if item == 4 else np.uint64
        return cls(occupied, ends, np.frombuffer(raw, dtype=kind, count=n, offset=at + 16 * runs + 8 * n), counts)


def partition_filters(rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(block, filter) of every partition of a table with a BIGINT column ``fingerprint``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = None
        for batch in batches:
            part = CountingQuotientFilter.of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            built = part if built is None else built.merge(part)
        if built is not None:
            blocks = list(built.blocks(block_bits))
            for at in range(0, len(blocks), 1024):
                some = blocks[at : at + 1024]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in some], pa.int32()), pa.array([f.to_bytes() for _, f in some], pa.binary())],
                    names=["block", "filter"],
                )

    return rows.select("fingerprint").mapInArrow(build, "block int, filter binary")


def repeated_fingerprints(rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Fingerprints that the merged filter counts more than once, with their counts.

    A group is one block of all partitions: as many entries as distinct fingerprints in the block and partition, so
    copies of one text add nothing. More bits make smaller blocks.
    """

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [CountingQuotientFilter.from_bytes(raw) for raw in frame["filter"]]
        while len(parts) > 1:
            pairs = [parts[i].merge(parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[len(parts) - len(parts) % 2 :]
        often = parts[0].counts > 1
        return pd.DataFrame({"fingerprint": parts[0].fingerprints()[often].view(np.int64), "n": parts[0].counts[often]})

    return partition_filters(rows, block_bits).groupBy("block").applyInPandas(merged, "fingerprint long, n long")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal normalised texts the row with the most code points in its text stays, then the smallest id. NULL text is
    the empty text, equal to any text of white space only. A NULL id sorts last among rows of equal length and keeps
    nothing unless its whole group has none. Rows that repeat an id share its result, and all rows with the id that
    stays are ``kept``. No rows in, no rows out. Other columns of the input are not read.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))
    rows = plain.select(
        "doc_id",
        F.char_length("text").cast("long").alias("points"),
        F.regexp_replace("text", SPACE_PATTERN + "+", "").alias("bare"),
    )
    often = repeated_fingerprints(rows.select(F.xxhash64("bare").alias("fingerprint")), block_bits)
    often = written(often.select("fingerprint"))

    # Whole texts are the grouping key, so texts are compared by their bytes. Equal ones arrive in one task by their
    # fingerprint and leave it as one partial row.
    routed = rows.withColumn("fingerprint", F.xxhash64("bare")).join(often, "fingerprint")
    order = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("id"))
    groups = routed.groupBy("bare").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.where("group_size > 1").select(
        F.sha2("bare", 256).alias("text_sha256"), F.col("best.id").alias("keep_id"), "group_size"
    )
    keyed = rows.select("doc_id", F.sha2("bare", 256).alias("text_sha256"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return keyed.join(groups, "text_sha256", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
