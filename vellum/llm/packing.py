"""Best-fit packing of documents into sequences, by exact complements.

Method: only the number of pieces of each length matters for a plan, so the
corpus is reduced to a histogram of at most ``size`` lengths. From the longest
length down, the gap that a piece leaves is looked up among the lengths, the
sums of two and the sums of three lengths that are still available, and each
combination that fills it exactly is taken as often as its counts allow. What
is left is packed best fit, longest first: each gap takes the longest piece
that it can hold, and so on until none fits. A plan is a list of patterns with
multiplicities, at most a few for each length, however many pieces there are.

Pieces then find their sequence by their rank within their length. Ranks are
counted within buckets of a length, into which pieces are dealt in turn, and
shifted by the counts of the buckets before, so that a very common length, or
doc_id, is spread over many tasks.

Cases: a null text is empty and gives one piece, the end token; repeated rows
are packed one by one; a null doc_id is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .tokens import default_path, encoder

SIZE = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, size: int, end: bytes, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, dealt = encoder(path), TaskContext.get().partitionId()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                out: list[list] = [[], [], [], [], []]
                texts = [None] * len(part) if pa.types.is_null(part["text"].type) else part["text"].to_pylist()
                for doc_id, text in zip(part["doc_id"].to_pylist(), texts, strict=True):
                    ids = own.ids(text or "") + end
                    total = len(ids) // 4
                    at, k = 0, 0
                    while at < total:
                        n = (total % size or size) if k == 0 else size
                        for x, v in zip(out, (doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])), strict=True):
                            x.append(v)
                        at, k = at + n, k + 1
                bucket = (np.arange(len(out[0])) + dealt) % buckets
                dealt += len(bucket)
                columns = [pa.array(x, pa.int32() if k == 1 else pa.int64()) for k, x in enumerate(out)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bucket, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "bucket"])

    return rows


class _Available:
    """Counts of lengths, with bit sets of those above 0 for looking up sums."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size = size
        self.counts = [0] * (size + 1)
        self.bits = self.mirror = 0  # bit k, and bit size - k, for an available length k
        for k, n in counts.items():
            self.change(k, n)

    def change(self, length: int, by: int) -> None:
        before, after = self.counts[length], self.counts[length] + by
        self.counts[length] = after
        if (before > 0) != (after > 0):
            self.bits ^= 1 << length
            self.mirror ^= 1 << (self.size - length)

    def longest(self, most: int) -> int:
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else 0

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """The most unequal two lengths of this sum: first at most ``most``, both available."""
        if total < 2:
            return None
        # bit k: k available and total - k available
        shift = self.size - total
        both = self.bits & (self.mirror >> shift if shift >= 0 else self.mirror << -shift) & ((1 << (min(most, total - 1) + 1)) - 1)
        while both:
            k = both.bit_length() - 1
            if k != total - k or self.counts[k] > 1:
                return k, total - k
            both ^= 1 << k
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum up to the gap."""
        if self.bits >> gap & 1:
            return (gap,)
        if found := self.pair(gap, gap - 1):
            return found
        first = self.longest(gap - 2)
        while first > 0 and 3 * first >= gap:
            self.change(first, -1)
            found = self.pair(gap - first, first)
            self.change(first, 1)
            if found:
                return (first, *found)
            first = self.longest(first - 1)
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each at most size in sum, with how often to use them; all pieces are used up."""
    left = _Available(counts, size)
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        need = {k: pattern.count(k) for k in pattern}
        times = min(left.counts[k] // n for k, n in need.items())
        for k, n in need.items():
            left.change(k, -n * times)
        out.append((pattern, times))

    length = left.longest(size)
    while length > 0:
        while left.counts[length]:
            if length == size:
                take((length,))
                continue
            left.change(length, -1)
            found = left.fill(size - length)
            left.change(length, 1)
            if not found:
                break
            take((length, *found))
        length = left.longest(length - 1)
    while (length := left.longest(size)) > 0:
        pattern, gap = [], size
        while gap and length > 0:
            pattern.append(length)
            left.change(length, -1)
            gap -= length
            length = left.longest(gap)
        for k in pattern:
            left.change(k, 1)
        take(tuple(pattern))
    return out


def _intervals(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, by rank: first rank, first sequence, offset."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        at = 0
        for k in pattern:
            rows.setdefault(k, []).append((used.get(k, 0), sequence, at))
            used[k] = used.get(k, 0) + times
            at += k
        sequence += times
    return {k: np.array(x, np.int64) for k, x in rows.items()}


def _placed(intervals):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch["length"]), np.asarray(batch["rank"])
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for k in np.unique(length).tolist():
                pick = np.flatnonzero(length == k)
                table = intervals.value[k]
                row = table[np.searchsorted(table[:, 0], rank[pick], side="right") - 1]
                sequence[pick], offset[pick] = row[:, 1] + rank[pick] - row[:, 0], row[:, 2]
            batch = batch.drop_columns(["rank"])
            yield batch.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return rows


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """docs (doc_id, text) to doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    buckets = max(16, shared.parts_for(docs))
    pieces = docs.select("doc_id", "text").mapInArrow(_cut(path or default_path(), size, end_id.to_bytes(4, "little"), buckets), _PIECES + ", bucket long")
    pieces = shared.written(pieces, "pieces")
    counted = pieces.groupBy("bucket", "length").count()
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most size rows
    intervals = spark.sparkContext.broadcast(_intervals(plan(counts, size)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("bucket", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("row", F.row_number().over(within)).join(offsets, ["bucket", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("row") - 1).alias("rank"))
    return ranked.mapInArrow(_placed(intervals), _PIECES + ", sequence_id long, offset long")
