"""Language-model scores by a hashed maximum-entropy model.

Method: P(word | history) = P(class | history) P(group | class, history)
P(word | group, history). The first two are softmaxes whose logits are sums of
weight rows for hashed features of the history (the word before, and the word
before that as a skip feature) on top of the corpus frequencies. The commonest
words are groups of their own, in classes of like frequency; all others share
hashed groups, in which words go by their counts.

Distributed training: the training texts are dealt into ROUNDS by their hash. In
each round all tasks take the gradient of the log likelihood of the round's
texts at the same weights; the sums over all tasks, whatever their order and
number, move the weights once, by a step that is scaled by how often each
feature was seen so far.

On top, both words together are a feature: each history has a weight for every word seen after it: a
table that grows with the corpus and is split by history. Its objective is the
log likelihood less D for each unit of weight, weights at least 0. As these
features exclude each other, the gradient is zero where a word's probability is
(n(h, w) - D) / n(h), or its weight is 0 and the model above, scaled to the rest,
already gives it more; that point is solved for. Rare words (not among the HEAD
commonest) have such weights by hashed bucket. Texts are scored in sparse numpy
batches: the normaliser of a history is a sum over the words seen after it.

Sizes: counts of words are summed by word hash in parts of the hash space. The
HEAD commonest words and sums by bucket go to every task, as do the softmaxes'
weights: all of fixed size, as is all that reaches the driver. Occurrences of
rarer words are sent to the part of their hash, which counts them. All tokens
are sent, as packed arrays, to the part of their history, which fits its weights
and returns a sum for each text. Parts grow in number with the input. Histories
in buckets that a fixed-size count shows to be very common go another way, as
rows that are summed before the shuffle.

Cases: a null text is empty, a text of one end token; rows with a null doc_id
are in training (their remainder is null) and get scores; repeated rows count
as often as they come; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import hashed, mix, opened, small_batches, squeezed, utf8

FOLDS, HELD_OUT = 10, 0
CLASSES, SLOTS, OWN = 32, 32, 24
CLASS_ROWS, SLOT_ROWS = 1 << 12, 1 << 14
HEAD, BUCKETS = 1 << 18, 1 << 14
ROUNDS, RATE, CAUTION, MOST_STEP = 4, 0.6, 4.0, 2.0
BATCH, CHUNK = 1 << 14, 400_000
ADD, D = 0.1, 0.75
HOT_BITS, HOT_TOKENS = 16, 4_000_000
END, START = np.uint64(0x452821E638D01377), np.uint32(0xFFFFFFFF)
_GROUPS = CLASSES * SLOTS
_RARE_BIT = np.uint32(1 << 31)
_BATCH_BYTES = 8 << 20
_TASK_BYTES = 32 << 20
_LOG10 = np.log(10.0)


def in_training(doc_ids: list[int | None]) -> np.ndarray:
    return np.array([d is None or zlib.crc32(str(d).encode()) % FOLDS != HELD_OUT for d in doc_ids], bool)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end token, and where each text starts."""
    h, starts = hashed(texts)
    n = np.diff(starts)
    out = np.full(len(h) + len(texts), END)
    keep = np.ones(len(out), bool)
    ends = starts[1:] + np.arange(len(texts))
    keep[ends] = False
    out[keep] = h
    return out, np.append(0, np.cumsum(n + 1))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for piece in small_batches(batch, "text", _BATCH_BYTES):
            ids = piece["doc_id"].to_pylist()
            yield (ids, in_training(ids), *tokens_of(utf8(piece["text"])))


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _split(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that has entries, with their places."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return ((k, order[cuts[k] : cuts[k + 1]]) for k in range(parts) if cuts[k] < cuts[k + 1])


def bucket_of(short: np.ndarray) -> np.ndarray:
    """The bucket of a word that is not common, by 31 bits of its hash."""
    return (short & np.uint32(BUCKETS - 1)).astype(np.int64)


def group_of(bucket: np.ndarray) -> np.ndarray:
    """The group that the words of a bucket share with others."""
    return bucket % CLASSES * SLOTS + OWN + bucket // CLASSES % (SLOTS - OWN)


# -- counts -------------------------------------------------------------------


def _count_rows(parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, train, h, starts in _texts(batches):
            h, n = np.unique(h[np.repeat(train, np.diff(starts))], return_counts=True)
            each = list(_split(_part_of(h, parts), parts))
            if each:
                blobs = [squeezed([h[pick], n[pick].astype(np.uint32)]) for _, pick in each]
                yield pa.RecordBatch.from_pydict({"part": pa.array([k for k, _ in each], pa.int32()), "words": pa.array(blobs, pa.binary())})

    return rows


def _grade(n: np.ndarray) -> np.ndarray:
    """Counts on a scale of 16 steps for each doubling."""
    return np.minimum((np.log2(np.maximum(n, 1)) * 16).astype(np.int64), 1023)


_ROW = 4096
_STATS = 2 * BUCKETS + 2 * _ROW  # tokens and words by bucket, words by grade, tokens and words
_COUNTED = "words binary, counts binary, stats binary"


def _count_part(part: int, blobs: list[tuple[bytes]]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a part with their counts, and sums over them."""
    each = [opened(x, ("u8", "u4")) for (x,) in blobs]
    h, back = np.unique(np.concatenate([x[0] for x in each]), return_inverse=True)
    n = np.bincount(back, np.concatenate([x[1] for x in each]), len(h)).astype(np.int64)
    bucket = bucket_of((h >> np.uint64(33)).astype(np.uint32))
    by_bucket = [np.bincount(bucket, n, BUCKETS), np.bincount(bucket, minlength=BUCKETS)]
    stats = np.zeros(_STATS, np.int64)
    stats[: -2 * _ROW] = np.concatenate(by_bucket)
    stats[-2 * _ROW : 1024 - 2 * _ROW] = np.bincount(_grade(n), minlength=1024)
    stats[-2:] = n.sum(), len(h)
    yield pa.RecordBatch.from_pydict({"words": [h.tobytes()], "counts": [n.tobytes()], "stats": [stats.tobytes()]})


def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for stats in batch["stats"].to_pylist():
            yield shared.as_rows(np.frombuffer(stats, np.int64), _ROW)


def _common(grade: int):
    """Words of at least some grade."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in zip(batch["words"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                h, n = np.frombuffer(h, np.uint64), np.frombuffer(n, np.int64)
                pick = _grade(n) >= grade
                if pick.any():
                    yield pa.RecordBatch.from_pydict({"words": [h[pick].tobytes()], "counts": [n[pick].tobytes()]})

    return rows


class Counts:
    """What every task knows of the training corpus; of fixed size."""

    def __init__(self, stats: np.ndarray, words: np.ndarray, counts: np.ndarray):
        self.n, self.v = int(stats[-2]), int(stats[-1])
        rank = np.lexsort((words, -counts))
        self.by_rank, self.count_of = words[rank], counts[rank]
        order = np.argsort(self.by_rank)
        self.words, self.ranks = self.by_rank[order], order.astype(np.uint32)
        head = len(rank)
        own = np.arange(min(head, CLASSES * OWN))
        # the group of each common word: its own for the commonest
        self.group = group_of(bucket_of((self.by_rank >> np.uint64(33)).astype(np.uint32)))
        home = bucket_of((self.by_rank >> np.uint64(33)).astype(np.uint32))
        self.group[own] = own // OWN * SLOTS + own % OWN  # classes of like frequency
        rest = stats[: 2 * BUCKETS].reshape(2, BUCKETS).astype(np.int64)  # tokens and words of rare words by bucket
        np.subtract.at(rest[0], home, self.count_of)
        np.subtract.at(rest[1], home, 1)
        bucket_mass = rest[0] + ADD * (rest[1] + 1)
        mass = np.concatenate([self.count_of + ADD, bucket_mass])
        groups = np.concatenate([self.group, group_of(np.arange(BUCKETS))])
        total = np.bincount(groups, mass, _GROUPS)
        used = np.bincount(groups, minlength=_GROUPS) > 0
        smooth = np.where(used, np.bincount(groups, np.concatenate([self.count_of, rest[0]]), _GROUPS) + 0.5, 1e-12).reshape(CLASSES, SLOTS)
        self.class_bias = np.log(smooth.sum(1) / smooth.sum()).astype(np.float32)
        self.slot_bias = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)
        # log10 P(outcome | group) of each common word, then of each bucket; log10 of what a bucket's counts are divided by
        self.inside = np.log10(mass) - np.log10(np.maximum(total[groups], ADD))
        self.inside[own] = 0.0
        self.outcome_group = groups
        self.bucket_mass = np.log10(bucket_mass)

        self._table = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}  # each process makes its own

    def known(self, short: np.ndarray) -> np.ndarray:
        """Counts of tokens among the commonest words; 0 for others."""
        return np.where(short < _RARE_BIT, self.count_of[np.minimum(short, max(len(self.count_of) - 1, 0))] if len(self.count_of) else 0, 0)

    def short(self, h: np.ndarray) -> np.ndarray:
        """Words in 32 bits: the rank of one of the commonest, 31 bits of the hash of another."""
        out = (h >> np.uint64(33)).astype(np.uint32) | _RARE_BIT
        if not len(self.words):
            return out
        if self._table is None:  # a place for each word by some bits; of words that share one, only one is in it
            self._table = np.full(1 << 21, -1, np.int32)
            self._table[_table_place(self.words)] = np.arange(len(self.words))
        at = self._table[_table_place(h)]
        hit = self.words[at] == h
        out[hit] = self.ranks[at[hit]]
        left = np.flatnonzero((at >= 0) & ~hit)
        at = np.minimum(np.searchsorted(self.words, h[left]), len(self.words) - 1)
        hit = self.words[at] == h[left]
        out[left[hit]] = self.ranks[at[hit]]
        return out

    def outcome(self, short: np.ndarray) -> np.ndarray:
        """Outcomes: the rank of a common word, or behind all ranks the bucket of another."""
        return np.where(short < _RARE_BIT, short.astype(np.int64), len(self.by_rank) + bucket_of(short))


def _table_place(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(24)) & np.uint64((1 << 21) - 1)).astype(np.int64)


def counted(docs: DataFrame, head: int = HEAD) -> Counts:
    """Counts of all training texts; at most head words reach the driver."""
    parts = shared.parts_for(docs)
    blobs = shared.dealt(docs.mapInArrow(_count_rows(parts), "part int, words binary"), parts)
    own = shared.Tables(docs.sparkSession)
    words = own.written(blobs.mapInArrow(shared.by_part(_count_part, ("words",)), _COUNTED), "words")
    stats = shared.total_of(words.mapInArrow(_stats_rows, shared.ARRAY), _STATS, _ROW, "i8", "i8")
    upto = np.cumsum(stats[-2 * _ROW : 1024 - 2 * _ROW][::-1])[::-1]
    grade = int(np.searchsorted(-upto, -head))  # the least one that at most head words reach
    rows = words.select("words", "counts").mapInArrow(_common(grade), "words binary, counts binary").collect()
    join = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[c], kind) for r in rows)])
    out = Counts(stats, join("words", np.uint64), join("counts", np.int64))
    own.drop(words)
    return out


# -- the softmaxes ------------------------------------------------------------


def before(short: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, and the one before that."""
    first = np.concatenate([[START], short[:-1]]).astype(np.uint32) if len(short) else short
    first[starts[:-1]] = START
    second = np.concatenate([[START], first[:-1]]).astype(np.uint32) if len(short) else short
    second[starts[:-1]] = START
    return first, second


def history(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of the two words before."""
    return mix(_pair(first, second))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.uint64) << np.uint64(32) | second


def _load_bucket(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - HOT_BITS)).astype(np.int64)


def features(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashed features of histories: one row for each feature."""
    a, b = first.astype(np.uint64), second.astype(np.uint64)
    rows = np.stack([mix(a + np.uint64(1)), mix(b + np.uint64(1 << 40))])
    return (rows >> np.uint64(65 - CLASS_ROWS.bit_length())).astype(np.uint16)


def slot_rows(found: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rows of the slot weights for features seen with a class."""
    kind = np.arange(1, 1 + len(found), dtype=np.uint64)[:, None]
    x = mix(found.astype(np.uint64) << np.uint64(16) | kind << np.uint64(8) | classes.astype(np.uint64))
    return (x >> np.uint64(65 - SLOT_ROWS.bit_length())).astype(np.uint16)


_ONES = np.ones(SLOTS, np.float32)
_TOP = np.float32(60.0)  # logits are cut there, so that exp stays finite
_WEIGHTS = CLASS_ROWS * CLASSES + SLOT_ROWS * SLOTS
_SEEN = _WEIGHTS + CLASS_ROWS + SLOT_ROWS
_SIZE = _SEEN + (1 << HOT_BITS)  # gradient, how often each row was seen, tokens by bucket of their history


class Model:
    """Weights of both softmaxes."""

    def __init__(self, counts: Counts):
        self.counts = counts
        self.a, self.b = np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((SLOT_ROWS, SLOTS), np.float32)
        self._seen = np.zeros(CLASS_ROWS + SLOT_ROWS)
        self.loads = np.zeros(1 << HOT_BITS)

    def _exp(self, rows: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        z = weights.take(rows[0], axis=0)
        for r in rows[1:]:
            z += weights.take(r, axis=0)
        z += bias
        np.minimum(z, _TOP, out=z)
        return np.exp(z, out=z)

    def _both(self, found: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For classes, then slots: feature rows, probabilities, the outcome's place."""
        c = group // SLOTS
        inner = slot_rows(found, c)
        for rows, weights, bias, y in ((found, self.a, self.counts.class_bias, c), (inner, self.b, self.counts.slot_bias.take(c, axis=0), group % SLOTS)):
            p = self._exp(rows, weights, bias)
            p /= (p @ _ONES)[:, None]
            yield rows, p, y

    def log10(self, found: np.ndarray, group: np.ndarray) -> np.ndarray:
        """log10 P(group | history) of each token."""
        out = np.zeros(len(group))
        for at in range(0, len(group), BATCH):
            for _, p, y in self._both(found[:, at : at + BATCH], group[at : at + BATCH]):
                out[at : at + BATCH] += np.log(p[np.arange(len(y)), y].astype(float))
        return out / _LOG10

    def gradient(self, found: np.ndarray, group: np.ndarray, total: np.ndarray) -> None:
        """Adds the gradient of some tokens' log likelihood, and how often each row was seen, to total."""
        parts = np.split(total, [CLASS_ROWS * CLASSES, _WEIGHTS, _WEIGHTS + CLASS_ROWS, _SEEN])
        for at in range(0, len(group), BATCH):
            levels = self._both(found[:, at : at + BATCH], group[at : at + BATCH])
            for (rows, p, y), sums, seen in zip(levels, parts[:2], parts[2:4], strict=True):
                np.negative(p, out=p)
                p[np.arange(len(y)), y] += 1
                sums = sums.reshape(len(seen), -1)
                for r in rows:
                    order = np.argsort(r, kind="stable")
                    heads = np.flatnonzero(np.append(True, r[order][1:] != r[order][:-1]))
                    sums[r[order[heads]]] += np.add.reduceat(p[order], heads, axis=0)
                    seen += np.bincount(r, minlength=len(seen))

    def step(self, total: np.ndarray) -> None:
        """One step up the gradient: less the more often a row was seen, and the likelier an outcome is anyway."""
        self._seen += total[_WEIGHTS:_SEEN]
        self.loads += total[_SEEN:]
        class_share, slot_share = np.exp(self.counts.class_bias.astype(float)), np.exp(self.counts.slot_bias.astype(float)).mean(axis=0)
        for weights, sums, seen, share in ((self.a, total[: CLASS_ROWS * CLASSES], self._seen[:CLASS_ROWS], class_share), (self.b, total[CLASS_ROWS * CLASSES : _WEIGHTS], self._seen[CLASS_ROWS:], slot_share)):
            move = RATE * sums.reshape(weights.shape) / (seen[:, None] * share + CAUTION)
            weights += np.clip(move, -MOST_STEP, MOST_STEP).astype(np.float32)


def _gradient_rows(model):
    """One task's gradient over its texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        total = np.zeros(_SIZE)
        for _, train, h, starts in _texts(batches):
            pick = np.repeat(train, np.diff(starts))
            short = own.counts.short(h)
            first, second = before(short, starts)
            group = own.counts.outcome_group[own.counts.outcome(short[pick])]
            own.gradient(features(first[pick], second[pick]), group, total)
            total[_SEEN:] += np.bincount(_load_bucket(history(first, second)), minlength=1 << HOT_BITS)
        yield shared.as_rows(total.astype(np.float32), _ROW)

    return rows


def train(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> Model:
    """Counts and softmax weights from all training texts, each of which is in one round."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    model = Model(counted(docs, head))
    # tasks that read so much, of which a round's share is theirs, since each sends a gradient of fixed size
    tasks = max(2, -(-shared.source_bytes(docs) // _TASK_BYTES))
    for k in range(rounds if model.counts.n else 0):
        mine = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k).coalesce(tasks)
        sent = spark.sparkContext.broadcast(model)
        model.step(shared.total_of(mine.mapInArrow(_gradient_rows(sent), shared.ARRAY), _SIZE, _ROW, "f4", "f8"))
        sent.unpersist()
    return model


# -- scores -------------------------------------------------------------------

_FLOW = "part int, batch long, kind int, data binary"


def _flow(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["part", "batch", "kind", "data"])


# a batch's texts, its rare tokens, requests of counts of words and of histories, and the replies
_TEXTS, _RARE, _ASK_WORDS, _ASK_HISTORIES, _WORDS, _SUMS = range(6)
_KINDS = {
    _TEXTS: ("i8", "u1", "u1", "i8", "i8", "f8"),  # doc_id, null, held out, tokens, known, sum of log10 of common words' counts
    _RARE: ("u4", "u4"),  # text, place in _WORDS
    _ASK_WORDS: ("u8", "u1"),  # word, in training
    _ASK_HISTORIES: ("u4", "u4", "u4", "u1", "u4"),  # word before, the one before that, outcome, in training, text
    _WORDS: ("u4",),  # count
    _SUMS: ("u4", "f4"),  # steps between texts, sum of scores
}


def _score_rows(model, hot, parts: int):
    """For each batch what is known here, and its tokens by part of the word (rare ones) and of the history (all)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = model.value.counts
        batch = TaskContext.get().partitionId() << 24
        for ids, train, h, starts in _texts(batches):
            short = counts.short(h)
            n = counts.known(short)
            rare = short >= _RARE_BIT
            text = np.repeat(np.arange(len(ids), dtype=np.uint32), np.diff(starts))
            sums = np.bincount(text, np.where(rare, 0.0, np.log10(n + ADD)), len(ids))
            known = np.bincount(text[~rare], minlength=len(ids))
            null = np.array([x is None for x in ids])
            doc_ids = np.array([x or 0 for x in ids], np.int64)
            sign = train[text].astype(np.uint8)
            out = [(batch % parts, batch, _TEXTS, squeezed([doc_ids, null.astype(np.uint8), (~train).astype(np.uint8), np.diff(starts), known, sums]))]
            found = np.flatnonzero(rare)
            place = np.zeros(len(found), np.uint32)
            asked = 0
            for k, pick in _split(_part_of(h[found], parts), parts):
                place[pick] = np.arange(asked, asked + len(pick))
                asked += len(pick)
                out.append((k, batch, _ASK_WORDS, squeezed([h[found[pick]], sign[found[pick]]])))
            if len(found):
                out.append((batch % parts, batch, _RARE, squeezed([text[found], place])))
            first, second = before(short, starts)
            outcome = counts.outcome(short).astype(np.uint32)
            key = history(first, second)
            part = _part_of(key, parts)
            part[hot.value[_load_bucket(key)]] = parts
            # in the order of histories, so that their columns pack well
            order = np.argsort(_pair(first, second))
            columns = [x[order] for x in (first, second, outcome, sign, text)]
            out += [(k, batch, _ASK_HISTORIES, squeezed([x[pick] for x in columns])) for k, pick in _split(part[order], parts)]
            yield _flow(out)
            batch += 1

    return rows


def after_histories(model: Model, first: np.ndarray, second: np.ndarray, outcome: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 P(outcome | history) for distinct pairs, sorted by history, with their counts in training."""
    counts = model.counts
    fresh = np.ones(len(first), bool)
    fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    of = np.cumsum(fresh) - 1
    prior = model.log10(features(first, second), counts.outcome_group[outcome]) + counts.inside[outcome]
    q = 10.0**prior
    total = np.bincount(of, n)[of]
    target = np.where(n > 0, (n - D) / np.maximum(total, 1), 0.0)
    active = n > 0
    scale = np.ones(len(q))
    while True:  # weights of 0 leave the active set one after another
        rest, left = 1 - np.bincount(of, target * active), 1 - np.bincount(of, q * active)
        scale = (np.maximum(rest, 1e-12) / np.maximum(left, 1e-12))[of]
        drop = active & (target <= q * scale)
        if not drop.any():
            break
        active &= ~drop
    return np.log10(np.where(active, target, q * scale))


def _token_logs(model: Model, first: np.ndarray, second: np.ndarray, outcome: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of a token's probability; for a rare word, of its bucket's over what the bucket's counts are divided by."""
    rare = outcome - len(model.counts.by_rank)
    divided = np.where(rare >= 0, model.counts.bucket_mass[np.maximum(rare, 0)], 0.0)
    return after_histories(model, first, second, outcome, n) - divided


def _part_replies(model):
    """Counts a part's rare words, fits its histories' weights, and replies to each batch."""

    def words(blobs: list[tuple[int, bytes]]) -> Iterator[tuple]:
        each = [opened(x, _KINDS[_ASK_WORDS]) for _, x in blobs]
        _, back = np.unique(np.concatenate([x[0] for x in each]), return_inverse=True)
        n = np.bincount(back, np.concatenate([x[1] for x in each]))[back].astype(np.uint32)
        at = 0
        for (batch, _), (h, _) in zip(blobs, each, strict=True):
            yield batch, _WORDS, squeezed([n[at : at + len(h)]])
            at += len(h)

    def after(blobs: list[tuple[int, bytes]]) -> Iterator[tuple]:
        each = [opened(x, _KINDS[_ASK_HISTORIES]) for _, x in blobs]
        first, second, outcome, train = (np.concatenate([x[i] for x in each]) for i in range(4))
        order = np.argsort(_pair(first, second))
        begins = np.flatnonzero(np.append(True, (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])))
        # some histories at a time
        cuts = np.unique(np.append(begins[np.searchsorted(begins, np.arange(0, begins[-1] + 1, CHUNK))], len(order)))
        logs = np.empty(len(order))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            pick = order[a:b]
            key = _pair(first[pick], second[pick])
            rank = np.cumsum(np.append(False, key[1:] != key[:-1])) << 20 | outcome[pick]
            inner = np.argsort(rank, kind="stable")
            pick, rank = pick[inner], rank[inner]
            fresh = np.append(True, rank[1:] != rank[:-1])
            of, one = np.cumsum(fresh) - 1, pick[fresh]
            logs[pick] = _token_logs(model.value, first[one], second[one], outcome[one].astype(np.int64), np.bincount(of, train[pick]))[of]
        at = 0
        for (batch, _), x in zip(blobs, each, strict=True):
            which, place = np.unique(x[4], return_inverse=True)
            yield batch, _SUMS, squeezed([np.diff(which, prepend=np.uint32(0)), np.bincount(place, logs[at : at + len(place)]).astype(np.float32)])
            at += len(place)

    def process(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for kind, reply in ((_ASK_WORDS, words), (_ASK_HISTORIES, after)):
            blobs = [(batch, data) for batch, k, data in rows if k == kind]
            if blobs:
                yield _flow([(part, *x) for x in reply(blobs)])
        rest = [(part, *x) for x in rows if x[1] not in (_ASK_WORDS, _ASK_HISTORIES)]
        if rest:
            yield _flow(rest)

    return shared.by_part(process, ("batch", "kind", "data"))


def _combined(n: int, v: int):
    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("kind", "part", "data")), strict=True), key=lambda r: r[:2])
        of = lambda kind: [opened(x, _KINDS[kind]) for k, _, x in rows if k == kind]
        joined = lambda kind, i, t: np.concatenate([np.zeros(0, np.dtype(t)), *(x[i] for x in of(kind))])
        doc_id, null, held_out, tokens, known, sums = of(_TEXTS)[0]
        size = len(doc_id)
        text, place = (joined(_RARE, i, "u4") for i in range(2))
        c = joined(_WORDS, 0, "u4")[place]
        logs = np.bincount(text, np.log10(c + ADD), size)
        known = known + np.bincount(text[c > 0], minlength=size)
        base = sums + logs - tokens * np.log10(n + ADD * (v + 1))
        score = logs.astype(float)  # of rare words, whose buckets' sums hold the rest
        for steps, x in of(_SUMS):
            score[np.cumsum(steps)] += x
        return pa.table({"doc_id": pa.array(doc_id, mask=null.astype(bool)), "held_out": held_out.astype(bool), "n_tokens": tokens, "n_known": known, "train_tokens": np.full(size, n), "base_score": base, "score": score})

    return combine


_HOT = "first long, second long, outcome long, batch long, text long, n long, k long"


def _hot_rows(model, hot):
    """Tokens after very common histories, counted by batch and text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = model.value.counts
        batch = TaskContext.get().partitionId() << 24
        for ids, train, h, starts in _texts(batches):
            short = counts.short(h)
            first, second = before(short, starts)
            pick = np.flatnonzero(hot.value[_load_bucket(history(first, second))])
            if len(pick):
                text = np.repeat(np.arange(len(ids)), np.diff(starts))[pick]
                columns = [first[pick].astype(np.int64), second[pick].astype(np.int64), counts.outcome(short[pick]), text]
                order = np.lexsort(columns[::-1])
                columns = [x[order] for x in columns]
                heads = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in columns], axis=0)))
                k = np.diff(np.append(heads, len(order)))
                first, second, outcome, text = (x[heads] for x in columns)
                yield pa.RecordBatch.from_pydict({"first": first, "second": second, "outcome": outcome, "batch": np.full(len(k), batch), "text": text, "n": k * train[text], "k": k})
            batch += 1

    return rows


def _fitted(model):
    def fit(table: pa.Table) -> pa.Table:
        first, second, outcome, n = (np.asarray(table[c].combine_chunks()) for c in ("first", "second", "outcome", "n"))
        logs = _token_logs(model.value, first.astype(np.uint32), second.astype(np.uint32), outcome, n)
        return pa.table({"first": first, "second": second, "outcome": outcome, "log": logs})

    return fit


def _as_flow(table: pa.Table) -> pa.Table:
    text, s = (np.asarray(table[c].combine_chunks()) for c in ("text", "s"))
    order = np.argsort(text)
    data = squeezed([np.diff(text[order], prepend=0).astype(np.uint32), s[order].astype(np.float32)])
    return pa.Table.from_batches([_flow([(0, table["batch"][0].as_py(), _SUMS, data)])])


def _hot_flow(docs: DataFrame, model, hot) -> DataFrame:
    """Sums of scores after very common histories, by way of rows."""
    history_, pair = ["first", "second"], ["first", "second", "outcome"]
    rows = shared.written(docs.mapInArrow(_hot_rows(model, hot), _HOT), "hot-tokens")
    pairs = rows.groupBy(*pair).agg(F.sum("n").alias("n"))
    logs = shared.written(pairs.groupBy(*history_).applyInArrow(_fitted(model), "first long, second long, outcome long, log double"), "hot-logs")
    sums = rows.join(logs, pair).groupBy("batch", "text").agg(F.sum(F.col("k") * F.col("log")).alias("s"))
    return sums.groupBy("batch").applyInArrow(_as_flow, _FLOW)


def scored(docs: DataFrame, model: Model | None = None, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """docs (doc_id, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = shared.parts_for(docs)
    model = model or train(docs)
    common = model.loads > hot_tokens + 2 * model.loads.mean() if hot_tokens else model.loads > 0
    sent, hot = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(common)
    flow = shared.dealt(docs.mapInArrow(_score_rows(sent, hot, parts), _FLOW), parts).mapInArrow(_part_replies(sent), _FLOW)
    if common.any():
        flow = flow.union(_hot_flow(docs, sent, hot))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return flow.groupBy("batch").applyInArrow(_combined(model.counts.n, model.counts.v), out)
