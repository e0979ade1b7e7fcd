"""Token ids of whole texts under a public vocabulary file of the tokenizers library."""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as the vocabulary file's own library gives them, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        self._own = Tokenizer.from_file(path)
        self._own.no_truncation()
        self._own.no_padding()
        self._special = [x["content"] for x in content["added_tokens"]]
        self._fast = self._merges(content)

    @staticmethod
    def _merges(content: dict):
        """The same vocabulary for the faster library, where it is byte-level and plain; else None."""
        import tiktoken

        model, before = content["model"], content["pre_tokenizer"] or {}
        plain = content["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex")
        if not plain or model["type"] != "BPE" or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            return None
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {x["content"] for x in content["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self._fast is None or any(x in text for x in self._special):
            ids = self._own.encode(text, add_special_tokens=False).ids
        else:
            ids = self._fast.encode_ordinary(text)
        return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
