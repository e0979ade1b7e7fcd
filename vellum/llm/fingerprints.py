"""Document fingerprints: one-permutation MinHash, densified, packed to low bits.

Method: the five-word shingles of a text are hashed once; the top bits name
one of 256 bins and each bin keeps its smallest hash. An empty bin takes the
value of a bin drawn for (bin, try), trying again until a full one is drawn,
the same draws for every text (optimal densification), so two texts fill a bin
alike whenever they agree where it is drawn from. The low 8 bits of each bin
are stored in hex. Equal bins by chance are 1 in 256, which the likeness is
corrected for: (m - c) / (1 - c), at least 0.

Cases: a null text is empty; a text of fewer than five words is one shingle;
one without words has the fingerprint "", which is like another "" (1.0) and
unlike all else (0.0). Equal texts have equal fingerprints. Rows with equal
doc_ids stand in the order of a hash of their texts; rows with a null doc_id
come first.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import hashed, mix, rolling, rolling_raw, small_batches, utf8

BINS, BITS, WIDTH = 256, 8, 5
_BIN_BITS = BINS.bit_length() - 1
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - _BIN_BITS)
TRIES = 64


def _draws() -> np.ndarray:
    """For each try and bin, the bin to take a value from."""
    bins, tries = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(1, TRIES + 1, dtype=np.uint64))
    return (mix(mix(bins + np.uint64(0x9E3779B97F4A7C15)) + tries * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - _BIN_BITS)).astype(np.int64)


_DRAWS = _draws()


def signature(hashes: np.ndarray) -> np.ndarray | None:
    """Densified bins of the shingle hashes, cut to their low bits."""
    if not len(hashes):
        return None
    h = np.sort(hashes)
    at = np.searchsorted(h, _EDGES)
    full = np.diff(np.append(at, len(h))) > 0
    low = np.zeros(BINS, np.uint64)
    low[full] = h[at[full]]
    if not full.all():
        value = low.copy()
        empty = np.flatnonzero(~full)
        for draw in _DRAWS:
            hit = full[draw[empty]]
            value[empty[hit]] = low[draw[empty[hit]]]
            empty = empty[~hit]
            if not len(empty):
                break
        else:  # after so many tries, the next full bin
            filled = np.flatnonzero(full)
            value[empty] = low[filled[np.searchsorted(filled, empty) % len(filled)]]
        low = value
    return (low & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 1 / (1 << BITS)
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def signatures(texts: list[bytes]) -> list[np.ndarray | None]:
    h, starts = hashed(texts)
    runs = rolling(h, WIDTH)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(signature(runs[a : b - WIDTH + 1]))
        else:
            out.append(signature(mix(rolling_raw(h[a:b], b - a) + np.uint64(b - a))) if b > a else None)
    return out


def packed(x: np.ndarray | None) -> str:
    return "" if x is None else x.tobytes().hex()


_LEAST = -(1 << 63)


class Cuts:
    """Keys (known, doc_id, hash) at which parts begin, in order; doc_id and known are 0 for a null."""

    def __init__(self, keys: list[tuple[int, int, int]]):
        self.nulls = np.array([h for known, _, h in keys if not known], np.int64)
        self.ids, self.hashes = (np.array([k[i] for k in keys if k[0]], np.int64) for i in (1, 2))
        self.parts = len(keys) + 1

    def part_of(self, null: np.ndarray, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        part = np.searchsorted(self.ids, x) + len(self.nulls)
        part[null] = np.searchsorted(self.nulls, h[null], side="right")
        for cut in np.intersect1d(x[~null], self.ids):
            rows = np.flatnonzero(~null & (x == cut))
            begin, end = np.searchsorted(self.ids, cut), np.searchsorted(self.ids, cut, side="right")
            part[rows] += np.searchsorted(self.hashes[begin:end], h[rows], side="right")
        return part

    def set_firsts(self, firsts: dict[int, tuple[int, int, int]]) -> None:
        """Takes the least key of each part that has rows."""
        self.first = np.full((self.parts, 3), -1, np.int64)
        for k, key in firsts.items():
            self.first[k] = key
        full = sorted(firsts)
        self.before = np.zeros(self.parts, np.int64)
        self.before[full] = [*full[-1:], *full[:-1]]

    def is_first(self, part: np.ndarray, null: np.ndarray, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        known, first, least = self.first[part].T
        return (known == ~null) & (first == x) & (least == h)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = batch["doc_id"]
    return ~np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)), np.asarray(batch["h"])


def _parts(cuts: Cuts):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array(cuts.part_of(*_keys(batch)).astype(np.int32)))

    return rows


def _cuts(docs: DataFrame, parts: int) -> Cuts:
    """Quantiles of doc_ids; among rows of a null or very common doc_id, even steps of their texts' hashes."""
    steps = [k / parts for k in range(1, parts)] or [0.5]
    found = docs.select(F.percentile_approx("doc_id", steps, 100 * parts).alias("x"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    times = Counter(found.x or []) if parts > 1 else Counter()
    even = lambda m: [_LEAST + k * (1 << 64) // m for k in range(1, m)]
    keys = [(1, i, h) for i, m in times.items() for h in (_LEAST, *even(m))]
    keys += [(0, 0, h) for h in even(max(1, parts * found.nulls // max(found.n, 1)))]
    cuts = Cuts(sorted(keys))
    key = F.struct(F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    firsts = docs.mapInArrow(_parts(cuts), "doc_id long, h long, part int").groupBy("part").agg(F.min(key).alias("x"))
    cuts.set_firsts({r.part: tuple(r.x) for r in firsts.collect()})  # one row a part
    return cuts


def _placing(cuts: Cuts):
    """Gives each row its part; the first row of a part also goes, as an extra, behind the part before it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _keys(batch)
            part = cuts.part_of(*key)
            yield _with(batch, part, False)
            first = cuts.is_first(part, *key)
            if first.any():
                yield _with(batch.filter(pa.array(first)), cuts.before[part[first]], True)

    return rows


def _with(batch: pa.RecordBatch, part: np.ndarray, extra: bool) -> pa.RecordBatch:
    columns = [pa.array(part.astype(np.int32)), pa.array(np.full(len(part), extra)), batch["doc_id"], batch["h"], batch["text"].cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["part", "extra", "doc_id", "h", "text"])


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, place and text; the last of a part is the first of the next and only read."""
    names = [x.strip().split()[0] for x in _OUT.split(",")]
    held: tuple | None = None
    for batch in batches:
        for piece in small_batches(batch, "text"):
            texts = utf8(piece["text"])
            rows = list(zip(piece["part"].to_pylist(), piece["doc_id"].to_pylist(), piece["extra"].to_pylist(), texts, signatures(texts), strict=True))
            if held:
                rows.insert(0, held)
            done, edited = [], []
            for (part, doc_id, extra, data, own), (p, _, _, after, sig) in zip(rows, rows[1:], strict=False):
                if part != p or extra:
                    continue
                text, following = data.decode(), after.decode()
                half = len(text) // 2
                done.append((doc_id, len(text), own, sig))
                edited.append((text[: len(text) - half] + following[:half]).encode())
            held = rows[-1]
            out: list[list] = [[] for _ in names]
            for (doc_id, n, own, sig), data, changed in zip(done, edited, signatures(edited), strict=True):
                for x, v in zip(out, (doc_id, n, hashlib.sha256(data).hexdigest(), packed(own), packed(changed), likeness(own, changed), likeness(own, sig)), strict=True):
                    x.append(v)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of edited texts, with the likeness of each text to its edit and to the next text.

    The order of rows is cut at quantiles into parts; each part also gets the
    first row of the next one (that of the last part is the first of all), so
    that a text and the next meet in one sorted part and texts move once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    cuts = _cuts(docs.select("doc_id", "h"), shared.parts_for(docs))
    rows = shared.dealt(docs.mapInArrow(_placing(cuts), "part int, extra boolean, doc_id long, h long, text string"), cuts.parts)
    rows = rows.sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), "h", "text")
    return rows.select("part", "extra", "doc_id", "text").mapInArrow(_rows, _OUT)
