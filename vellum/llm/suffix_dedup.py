"""Repeated passages by a sparse suffix array.

Method: of each 25 words in a row one word is retained, that at which the
smallest hash of eight words in them begins (leftmost in a tie): about one word
in 9. Every window of 50 words so has a suffix that begins 0 to 17 words behind
its own begin, at the same place in every copy of the window. Suffixes are
sorted by their first 33 words, the core that all their windows share, and by
the words that follow; those of equal cores are also sorted by the words before
them, read backwards. Neighbours are compared in both orders: the words that
they share to the right and to the left tell how far a match extends. A window
that begins k words before its suffix is found again in the suffixes that agree
with it on 17 - k words behind the core and on k words before it, which stand
together in the two orders. So no repeated window is missed, and none is
compared with all others. Of equal windows the first by (doc_id, place) is the
source, the others are copies; touching windows merge into spans, so that a
match reaches as far as it holds.

Suffixes travel as packed arrays, one blob for each part of the suffix order
and batch: a 64-bit hash of the core, and 32-bit ones of the words around it
that its windows reach. A suffix that very many documents share would fill one
part: buckets of suffixes that a fixed-size count of all suffixes shows to be
more than HOT_LOAD over twice the mean go another way, as rows of window hashes
that are summed before the shuffle.

Cases: null and blank texts, and texts under 50 words, have no spans; rows that
share a doc_id are one document: equal windows at one place in them are one
occurrence, and without_copies leaves documents whose rows have differing texts
as they are; a null doc_id is ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import hashed, opened, rolling, small_batches, squeezed, utf8

WINDOW, SELECT, RUN = 50, 25, 8
REACH = SELECT - RUN
CORE = WINDOW - REACH
HOT_BITS, HOT_ROW = 18, 4096
HOT_LOAD = 2_000_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPANS = "doc_id long, start_word long, n_words long, is_source boolean, source_doc_id long, source_start long"
_HOT = "doc_id long, place long, h long"
_SUFFIX = ("u8", "i8", "u4", "u1", "u1")  # core, doc_id, place, words before it in its first window, windows


class Suffixes:
    """The retained suffixes of some texts."""

    def __init__(self, texts: list[bytes], doc_ids: np.ndarray):
        self.h, starts = hashed(texts)
        runs, cores = rolling(self.h, RUN), rolling(self.h, CORE)
        low = (runs >> np.uint64(32) << np.uint64(32)) | np.arange(len(runs), dtype=np.uint64)
        step, width = 1, REACH + 1  # the smallest of width runs, by doubling
        while step * 2 <= width:
            low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
            step *= 2
        if rest := width - step:
            low = np.minimum(low[:-rest], low[rest:]) if len(low) > rest else low[:0]
        counts = np.maximum(np.diff(starts) - WINDOW + 1, 0)
        first = np.repeat(starts[:-1] - (np.cumsum(counts) - counts), counts)
        at = np.arange(len(first)) + first  # where each window of one text begins
        of = np.repeat(np.arange(len(counts)), counts)
        place = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1])
        heads = np.flatnonzero(fresh)
        self.windows = np.diff(np.append(heads, len(at)))
        self.at, self.start = place[heads], at[heads]
        self.core, self.doc = cores[self.at], doc_ids[of[heads]]
        self.place = self.at - starts[:-1][of[heads]]
        self.before = self.at - self.start

    def bucket(self) -> np.ndarray:
        return (self.core >> np.uint64(64 - HOT_BITS)).astype(np.int64)

    def around(self, pick: np.ndarray) -> np.ndarray:
        """The words that the windows of some suffixes reach, before their cores and then behind them."""
        words = (self.h >> np.uint64(32)).astype(np.uint32)
        behind = REACH - (self.before - self.windows + 1)
        return np.concatenate([words[_ranges(self.start[pick], self.before[pick])], words[_ranges(self.at[pick] + CORE, behind[pick])]])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
    for batch in batches:
        for piece in small_batches(batch, "text"):
            ids = piece["doc_id"].cast(pa.int64())
            piece = piece.filter(ids.is_valid())
            if piece.num_rows:
                yield Suffixes(utf8(piece["text"]), np.asarray(piece["doc_id"].cast(pa.int64())))


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << HOT_BITS, np.uint32)
    for x in _each(batches):
        total += np.bincount(x.bucket(), minlength=len(total)).astype(np.uint32)
    yield shared.as_rows(total, HOT_ROW)


def _hot_buckets(docs: DataFrame, load: int) -> np.ndarray:
    total = shared.total_of(docs.mapInArrow(_loads, shared.ARRAY), 1 << HOT_BITS, HOT_ROW, "u4", "i8")
    return total > load + 2 * total.mean() if load else total > 0


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _packed(hot, parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _each(batches):
            part = ((x.core >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
            part[hot.value[x.bucket()]] = parts
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            keys = [k for k in range(parts) if cuts[k] < cuts[k + 1]]
            picks = [order[cuts[k] : cuts[k + 1]] for k in keys]
            columns = [x.core, x.doc, x.place.astype(np.uint32), x.before.astype(np.uint8), x.windows.astype(np.uint8)]
            blobs = [squeezed([c[pick] for c in columns]) for pick in picks]
            if keys:
                yield pa.RecordBatch.from_pydict({"part": pa.array(keys, pa.int32()), "suffixes": pa.array(blobs, pa.binary()), "words": pa.array([x.around(pick).tobytes() for pick in picks], pa.binary())})

    return rows


def _hot_rows(hot):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _each(batches):
            pick = np.flatnonzero(hot.value[x.bucket()])
            if len(pick):
                windows, n = rolling(x.h, WINDOW), x.windows[pick]
                first = (x.place - x.before)[pick]
                yield pa.RecordBatch.from_pydict({"doc_id": np.repeat(x.doc[pick], n), "place": _ranges(first, n), "h": windows[_ranges(x.start[pick], n)].view(np.int64)})

    return rows


def _shared_words(order: np.ndarray, core: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each of sorted suffixes, how many words in a row it shares with the one before; -1 where cores differ."""
    differ = words[order][1:] != words[order][:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
    return np.append(-1, np.where(core[order][1:] == core[order][:-1], n, -1))


def _matches(blobs: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """Sorts suffixes, compares neighbours, and yields runs of windows that occur again."""
    columns, lefts, rights = [], [], []
    for packed, words in blobs:
        columns.append(opened(packed, _SUFFIX))
        before, n = (x.astype(np.int64) for x in columns[-1][3:])
        behind = REACH - (before - n + 1)
        around = np.frombuffer(words, np.uint32)
        split = int(before.sum())
        lefts.append((around[:split], before))
        rights.append((around[split:], behind))
    core, doc, place, before, n = (np.concatenate(x) for x in zip(*columns, strict=True))
    order = np.argsort(core, kind="stable")
    same = core[order][1:] == core[order][:-1]
    again = np.zeros(len(core), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    pick = np.flatnonzero(again)
    if not len(pick):
        return
    core, doc, place, before, n = (x[pick].astype(t) for x, t in zip((core, doc, place, before, n), (np.uint64, np.int64, np.int64, np.int64, np.int64), strict=True))

    def table(sides: list[tuple[np.ndarray, np.ndarray]], backwards: bool) -> np.ndarray:
        """A row of REACH words for each picked suffix, nearest first; 0 beyond what its windows reach."""
        words, counts = (np.concatenate(x) for x in zip(*sides, strict=True))
        begins, counts = (np.cumsum(counts) - counts)[pick], counts[pick]
        out = np.zeros((len(pick), REACH), np.uint32)
        inner = _ranges(np.zeros(len(pick), np.int64), counts)
        source = np.repeat(begins + counts - 1, counts) - inner if backwards else np.repeat(begins, counts) + inner
        out[np.repeat(np.arange(len(pick)), counts), inner] = words[source]
        return out

    classes = []  # for each direction: the order, and what neighbours in it share
    for words in (table(rights, False), table(lefts, True)):
        order = np.lexsort((*words.T[::-1], core))
        classes.append((order, _shared_words(order, core, words)))

    def alike(direction: int, words: int) -> np.ndarray:
        """Equal numbers for suffixes that agree on the core and so many words beyond it in one direction."""
        order, common = classes[direction]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(common < words)
        return out

    found = []
    for k in range(REACH + 1):
        has = np.flatnonzero((before >= k) & (before - n < k))
        code = alike(0, REACH - k)[has] * (len(core) + 1) + alike(1, k)[has]
        found.append(_found(code, doc[has], place[has] - k))
    yield from _runs(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _found(code: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of a code that others have too: document, place, and those of the first."""
    order = np.lexsort((place, doc, code))
    code, doc, place = code[order], doc[order], place[order]
    once = np.ones(len(code), bool)
    once[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
    code, doc, place = code[once], doc[once], place[once]
    fresh = np.ones(len(code), bool)
    fresh[1:] = code[1:] != code[:-1]
    starts = np.flatnonzero(fresh)
    size = np.diff(np.append(starts, len(code)))
    pick = np.flatnonzero(np.repeat(size > 1, size))
    source = np.repeat(starts, size)[pick]
    return doc[pick], place[pick], doc[source], place[source]


def _runs(doc: np.ndarray, place: np.ndarray, source: np.ndarray, source_place: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(doc):
        return
    order = np.lexsort((source_place, source, place, doc))
    doc, place, source, source_place = doc[order], place[order], source[order], source_place[order]
    first = (doc == source) & (place == source_place)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1]) | (source_place[1:] != source_place[:-1] + 1) | (first[1:] != first[:-1])
    heads = np.flatnonzero(fresh)
    n = np.diff(np.append(heads, len(doc)))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[heads], place[heads], n + WINDOW - 1, first[heads], source[heads], source_place[heads])], ["doc_id", "start_word", "n_words", "is_source", "source_doc_id", "source_start"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins touching runs; rows come sorted by doc_id, is_source and start_word."""
    names = ["doc_id", "start_word", "n_words", "is_source", "source_doc_id", "source_start"]
    now, out = None, []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in names), strict=True):
            if now and row[0] == now[0] and row[3] == now[3] and row[1] <= now[1] + now[2]:
                now[2] = max(now[2], row[1] + row[2] - now[1])
            else:
                if now:
                    out.append(now)
                now = list(row)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)
            out = []
    if now:
        out.append(now)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)


def repeated_spans(docs: DataFrame, hot_load: int = HOT_LOAD) -> DataFrame:
    """Spans of words that repeat: doc_id, start_word, n_words, is_source, source_doc_id, source_start.

    Copies carry the place of the source of their first window; a span with
    is_source holds first occurrences. Places count words from 0.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    parts = shared.parts_for(docs)
    buckets = _hot_buckets(docs, hot_load)
    hot = spark.sparkContext.broadcast(buckets)
    blobs = shared.dealt(docs.mapInArrow(_packed(hot, parts), "part int, suffixes binary, words binary"), parts)
    runs = blobs.mapInArrow(shared.by_part(lambda part, rows: _matches(rows), ("suffixes", "words")), SPANS)
    if buckets.any():
        rows = shared.written(docs.mapInArrow(_hot_rows(hot), _HOT), "hot-windows")
        places = F.min(F.struct("doc_id", "place"))
        again = rows.groupBy("h").agg(places.alias("x"), F.max(F.struct("doc_id", "place")).alias("y")).where("x <> y")
        found = rows.join(again.select("h", F.col("x.doc_id").alias("source_doc_id"), F.col("x.place").alias("source_start")), "h")
        is_source = F.expr("doc_id = source_doc_id AND place = source_start")
        found = found.select("doc_id", F.col("place").alias("start_word"), F.lit(WINDOW).cast("long").alias("n_words"), is_source.alias("is_source"), "source_doc_id", "source_start")
        runs = runs.union(found)
    runs = runs.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "is_source", "start_word", "source_doc_id", "source_start")
    return runs.mapInArrow(_merge, SPANS)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of spans (start, count); white space around them stays."""
    data = text.encode()
    words = [m.span() for m in WORD.finditer(data)]
    out, at = [], 0
    for start, count in sorted(spans):
        if start >= len(words):
            break
        first, last = words[start][0], words[min(start + count, len(words)) - 1][1]
        if last > at:
            out.append(data[at : max(first, at)])
            at = last
    out.append(data[at:])
    return b"".join(out).decode()


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column holds the spans of each row's text."""
    for batch in batches:
        k = batch.schema.get_field_index("text")
        last = batch.num_columns - 1
        texts = [cut(t, [(s["start_word"], s["n_words"]) for s in spans]) if spans and t else t for t, spans in zip(batch[k].to_pylist(), batch[last].to_pylist(), strict=True)]
        batch = batch.set_column(k, "text", pa.array(texts, batch.schema.field(k).type))
        yield batch.select(range(last))


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with the copies of repeated spans cut from their texts (and n_chars set anew, where there is one)."""
    own, spans = (f"_{k}_{uuid.uuid4().hex}" for k in ("id", "spans"))  # names that docs does not have
    found = repeated_spans(docs, **options).where("NOT is_source").groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("start_word", "n_words")).alias(spans))
    texts = F.xxhash64("text")
    unclear = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(own)).agg(F.min(texts).alias("x"), F.max(texts).alias("y")).where("x <> y").select(own)
    # tables whose size Spark knows: where they are small, texts need not be shuffled for them
    found, unclear = shared.written(found, "copies"), shared.written(unclear, "unclear")
    found = found.join(unclear, own, "left_anti")
    out = docs.join(found, docs["doc_id"] == found[own], "left").select(*docs.columns, spans).mapInArrow(_cut_rows, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
