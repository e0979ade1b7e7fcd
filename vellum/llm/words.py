"""Words and their hashes, a batch of texts at a time, in numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return; A-Z count as a-z. Texts are handled as UTF-8 bytes.
A word's hash is a polynomial in a fixed odd number over 64-bit values of its
bytes, modulo 2^64, then mixed: differences of one running sum over all bytes
give all words at once. Words of more than LONG bytes, for which such a
polynomial has collisions by construction, are hashed one by one by XXH3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_33 = np.uint64(33)
SEGMENT = 1 << 19
LONG = 64


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; a null is an empty text."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _33)
    x *= _MIX1
    x ^= x >> _33
    x *= _MIX2
    x ^= x >> _33
    return x


_BASE = 0xD6E8FEB86659FD93
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]


class _Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))


def _segment(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in bytes, and their hashes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD.take(data)
    change = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = change[::2], change[1::2]
    _Powers.reach(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES.take(data) * _Powers.up[: len(data)], out=sums[1:])
    out = mix((sums.take(last) - sums.take(first)) * _Powers.down.take(first) + (last - first).astype(np.uint64) * _ODD)
    for k in np.flatnonzero(last - first > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[first[k] : last[k]].tobytes().lower())
    return first, out


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after another, and where each text starts (one entry more than texts)."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    bounds = np.append(0, np.cumsum(np.array([len(x) for x in texts], np.int64) + 1))
    firsts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and _IN_WORD[data[end]]:  # a word is never cut
            step = np.flatnonzero(~_IN_WORD.take(data[end : end + SEGMENT]))
            end = end + int(step[0]) if len(step) else min(end + SEGMENT, len(data))
        first, h = _segment(data[at:end])
        firsts.append(first + at)
        hashes.append(h)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(firsts), bounds)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words: one entry for each place where a run may begin."""
    return mix(rolling_raw(h, width))


def rolling_raw(h: np.ndarray, width: int) -> np.ndarray:
    if len(h) < width:
        return np.zeros(0, np.uint64)
    if width > 8:  # twice as long by doubling
        half, rest = width // 2, width % 2
        a = rolling_raw(h, half)
        step = np.uint64(pow(int(_ODD), half, 1 << 64))
        out = a[: len(a) - half] * step + a[half:]
        return out[: len(h) - width + 1] * _ODD + h[width - 1 :] if rest else out
    out = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        out *= _ODD
        out += h[i : len(h) - width + 1 + i]
    return out


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a shorter text is one shingle, an empty one has none."""
    h, starts = hashed(texts)
    runs = rolling(h, width)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield mix(rolling_raw(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def small_batches(batch: pa.RecordBatch, text: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about limit bytes of text each, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    if pa.types.is_null(column.type):
        yield batch
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0))
    total, first = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(first, i - first)
            total, first = 0, i
        total += n
    if first < len(sizes):
        yield batch.slice(first)


def squeezed(columns: list[np.ndarray]) -> bytes:
    """Arrays of one length, a plane for each byte of their values, compressed."""
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def opened(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of squeezed(), given their types."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    count, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(data[at : at + size * count].reshape(size, count).T).view(k).reshape(-1))
        at += size * count
    return out
