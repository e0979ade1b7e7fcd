"""BPE encoding by a segment tree over pair ranks, and decoding.

Method: the leaves of a word's tree are its adjacent symbol pairs, each with
(rank, place), or infinity where no merge exists; each node holds the minimum
below it, so the root is the leftmost pair of the lowest rank. A merge changes
three leaves (the merged pair, the pair to its left, and the one that its right
symbol began), each a walk of logarithmic length, until the root is infinite.
Words of up to 256 symbols are merged many at a time, one numpy row for each
word of a size class; longer words by the same tree in plain lists. Distinct
pieces of a batch are encoded once and kept up to a bound.

The text is prepared as the vocabulary file says: NFC, white space to one
space, lower case; letters, single digits, other runs and English contractions
apart; bytes as printable characters; the last symbol of a word marked. Special
tokens are cut out of the raw text first. Code points that the tokenizers
library normalises or classes otherwise than Python (they come from two versions
of Unicode) are found by asking it for all of them once a process; texts and
pieces that hold one are normalised and split by the library. Merging is always
done here.

Cases: a null text is empty and has no ids (n_tokens 0, digests of the empty
string); repeated rows are returned as often as they come; a null doc_id is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .words import small_batches

CACHED_PIECES = 450_000
ROW_LIMIT = 256
ALIKE = 0x250  # Latin letters, which all versions of Unicode in use take alike
_NONE = np.uint64((1 << 64) - 1)
_PLACE = np.uint64(16)
SPACES = regex.compile(r"[^\S ]\s*| \s+")  # all runs but a single space


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 upwards."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [], 256
    for b in range(256):
        if b in kept:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def prepared(text: str) -> str:
    text = SPACES.sub(" ", unicodedata.normalize("NFC", text))
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class Vocabulary:
    """A vocabulary file with word ends, its merges as arrays, and a bounded store of encoded pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        self.end = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in content["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(x for x in content["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"])
        letters = byte_letters()
        self.first = np.array([ids[x] for x in letters], np.int64)
        self.last = np.array([ids[x + self.end] for x in letters], np.int64)
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.uint64)
        self._merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self._rank_of = {int(k): r for r, k in enumerate(keys.tolist())}
        self._ids: dict[str, str] = {}
        self._decoded: dict[str, str] = {}
        library = Tokenizer.from_file(path)
        self._normalised, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self._table: np.ndarray | None = None
        self._strange: set[str] = set()  # pieces of texts with such code points

    def _unlike(self):
        """For each code point whether the library takes it otherwise than the functions here."""
        stable = ((0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x20000, 0x2A6D6), (0x33000, 0xDFFFF))  # ideographs, Hangul, nothing
        points = (c for c in range(0x80, 0xF0000) if not any(a <= c <= b for a, b in stable))
        every = [c for c in map(chr, points) if unicodedata.category(c) not in ("Cs", "Co")]
        both = lambda x: zip(*(f("1".join(x)).split("1") for f in (self._normalised, prepared)), strict=True)
        theirs, own = zip(*both(every), strict=True)
        odd = {c for c, a, b in zip(every, theirs, own, strict=True) if a != b}
        marks = [c for c in every if unicodedata.category(c)[0] == "M" or unicodedata.category(c) == "Cn" and c < "\U00020000"]
        for around in ("{}\u0301", "{}\u0323", "\u0301{}", "\u0323{}"):  # order among marks above and below
            odd.update(c for c, (a, b) in zip(marks, both([around.format(c) for c in marks]), strict=True) if a != b)
        plain = [(c, x) for c, x in zip(every, theirs, strict=True) if x and not any(y.isspace() for y in x)]
        words = [f"b{x}!" for _, x in plain]
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])
        whole = " ".join(words)
        starts = [np.array([m.start() for m in self._words.finditer(whole)]), np.array([a for _, (a, _) in self._split(whole)])]
        for k in np.searchsorted(begins, np.setxor1d(*starts), side="right") - 1:
            odd.add(plain[k][0])
            odd.update(plain[k][1])
        table = np.zeros(0x110000, bool)
        table[list(map(ord, odd))] = True
        return table

    def is_odd(self, text: str) -> bool:
        """Whether the library takes some code point otherwise; it is asked when the first text goes beyond ALIKE."""
        if text.isascii():
            return False
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if points.max() < ALIKE:
            return False
        if self._table is None:
            self._table = self._unlike()
        return bool(self._table[points].any())

    def plain_pieces(self, text: str) -> list[str]:
        """What stands between spaces in a text without special tokens."""
        if self.is_odd(text):
            pieces = list(filter(None, self._normalised(text).split(" ")))
            self._strange.update(pieces)
            return pieces
        return list(filter(None, prepared(text).split(" ")))

    def words(self, piece: str) -> list[str]:
        """The words of what stands between two spaces."""
        if piece in self._strange:
            return [piece[a:b] for _, (a, b) in self._split(piece)]
        return self._words.findall(piece)

    # -- merging ---------------------------------------------------------

    def _leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at] << _PLACE | place.astype(np.uint64), _NONE)

    def _merge_rows(self, words: list[bytes], leaves: int) -> list[list[int]]:
        """Words of 2 to leaves + 1 bytes, one row each."""
        rows = len(words)
        size = np.array([len(w) for w in words])
        width = leaves + 1
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(rows, width)
        symbol = self.first[data]
        every = np.arange(rows)
        symbol[every, size - 1] = self.last[data[every, size - 1]]
        after = np.tile(np.arange(1, width + 1), (rows, 1))
        before = np.tile(np.arange(-1, width - 1), (rows, 1))
        tree = np.full((rows, 2 * leaves), _NONE)
        r, c = np.nonzero(np.arange(leaves) < (size - 1)[:, None])
        tree[r, leaves + c] = self._leaves(symbol[r, c], symbol[r, c + 1], c)
        level = leaves
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        flat, span = tree.reshape(-1), 2 * leaves

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray | np.uint64) -> None:
            base = row * span
            node = leaf + leaves
            flat[base + node] = value
            while leaves > 1 and node[0] > 1:
                node = node >> 1
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])

        live = np.flatnonzero(tree[:, 1 if leaves > 1 else leaves] != _NONE)
        while len(live):
            root = tree[live, 1 if leaves > 1 else leaves]
            at = (root & np.uint64(0xFFFF)).astype(np.int64)
            gone = after[live, at]
            following = after[live, gone]
            symbol[live, at] = made = self._merged[(root >> _PLACE).astype(np.int64)]
            symbol[live, gone] = -1
            after[live, at] = following
            more = following < size[live]
            before[live[more], following[more]] = at[more]
            value = np.full(len(live), _NONE)
            value[more] = self._leaves(made[more], symbol[live[more], following[more]], at[more])
            ends = gone < leaves
            if ends.any():
                put(live[ends], gone[ends], _NONE)
            put(live, at, value)
            left = before[live, at]
            has = left >= 0
            if has.any():
                put(live[has], left[has], self._leaves(symbol[live[has], left[has]], made[has], left[has]))
            live = live[tree[live, 1 if leaves > 1 else leaves] != _NONE]
        out = []
        for row, n in zip(symbol.tolist(), size.tolist(), strict=True):
            out.append([x for x in row[:n] if x >= 0])
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        symbol = [int(self.first[b]) for b in word]
        n = len(symbol)
        symbol[-1] = int(self.last[word[-1]])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        leaves = 1 << (n - 1).bit_length()
        none = (1 << 62, 0)
        tree = [none] * (2 * leaves)

        def leaf(i: int, j: int) -> tuple[int, int]:
            rank = self._rank_of.get(symbol[i] << 32 | symbol[j]) if j < n else None
            return none if rank is None else (rank, i)

        def put(i: int, value: tuple[int, int]) -> None:
            node = i + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        for i in range(n - 1):
            tree[leaves + i] = leaf(i, i + 1)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != none:
            rank, at = tree[1]
            gone = after[at]
            symbol[at], symbol[gone] = int(self._merged[rank]), -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, leaf(at, after[at]))
            if before[at] >= 0:
                put(before[at], leaf(before[at], at))
        return [x for x in symbol if x >= 0]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words, given as bytes."""
        out: list[list[int]] = [[]] * len(words)
        classes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) == 1:
                out[k] = [int(self.last[w[0]])]
            elif len(w) > ROW_LIMIT:
                out[k] = self._merge_long(w)
            elif w:
                classes.setdefault(1 << (len(w) - 2).bit_length() if len(w) > 2 else 1, []).append(k)
        for leaves, members in classes.items():
            step = max(1, (1 << 19) // leaves)
            for first in range(0, len(members), step):
                part = members[first : first + step]
                for k, ids in zip(part, self._merge_rows([words[k] for k in part], leaves), strict=True):
                    out[k] = ids
        return out

    # -- texts -----------------------------------------------------------

    def _pieces(self, text: str) -> list[str]:
        """What stands between spaces, and special tokens as themselves behind a line feed."""
        if self._cut is None or not any(x in text for x in self.special):
            return self.plain_pieces(text)
        out: list[str] = []
        for k, part in enumerate(self._cut.split(text)):
            out.extend(["\n" + part] if k % 2 else self.plain_pieces(part))
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes the pieces that are not yet held."""
        new = {p for p in pieces if p not in self._ids}
        if len(self._ids) + len(new) > CACHED_PIECES:
            self._ids.clear()
            self._decoded.clear()
            new = set(pieces)
        parts = {p: self.words(p) for p in new if p[0] != "\n"}
        words = list({w for x in parts.values() for w in x})
        ids = dict(zip(words, self.merge([w.encode() for w in words]), strict=True))
        for p in new:
            found = [self.special[p[1:]]] if p[0] == "\n" else [i for w in parts[p] for i in ids[w]]
            self._ids[p] = " ".join(map(str, found))
            self._decoded[p] = self.decode(found)
        self._strange.clear()  # those that are held keep their ids

    def encode(self, text: str) -> list[int]:
        pieces = self._pieces(text)
        self.learn(set(pieces))
        return [int(i) for p in pieces for i in self._ids[p].split(" ") if i]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, as the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        pieces = [self._pieces(t) for t in texts]
        self.learn(set().union(*pieces))
        for each in pieces:
            ids = " ".join(map(self._ids.__getitem__, each))
            decoded = " ".join(map(self._decoded.__getitem__, each))
            yield ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _digest_rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            for piece in small_batches(batch, "text", 4 << 20):
                texts = [x or "" for x in piece["text"].to_pylist()]
                n, ids, decoded = zip(*own.digests(texts), strict=True) if texts else ((), (), ())
                yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows


def encoded_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select("doc_id", "text").mapInArrow(_digest_rows(path or default_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode_rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            for piece in small_batches(batch, "text", 4 << 20):
                ids = [own.encode(x or "") for x in piece["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return rows


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) to doc_id, ids, decoded."""
    return docs.select("doc_id", "text").mapInArrow(_encode_rows(path or default_path()), "doc_id long, ids array<int>, decoded string")
