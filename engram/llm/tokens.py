"""Token ids of whole texts through caches of pre-tokens, equal to those of the tokenizer library itself.

A byte-level BPE tokenizer cuts a text with a pattern before it merges bytes, and no match of that pattern crosses a
single space or line feed between two other characters. Texts are cut there, each piece is encoded once per worker and
then looked up. The text of an added special token is cut out first and counts as its one id, as in the library.
"""

from __future__ import annotations

import array
import json
import os
import re
import string
import sys
from collections.abc import Callable

import numpy as np

from engram.llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A single space between two characters that are not white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than space and line feed.
_ODD = re.compile(r"[^\S \n]")
_ODD_ASCII = tuple("\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
#: How the keys of a text's and of a line's first word begin.
_FIRST = (" ", "\n")
_MARKS = frozenset(string.punctuation)
#: Characters of the longest piece that stays in a cache.
LONG = 256
_DOUBLE = ("  ", "\n\n", " \n", "\n ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_of(key: str) -> str:
    """The text that a cache key stands for: ' x' is x itself, '\\nx' is itself, any other x follows a space."""
    if key[:1] == " ":
        return key[1:]
    return key if key[:1] == "\n" else " " + key


def keys_of(text: str) -> list[str]:
    if any(x in text for x in _DOUBLE) or (any(x in text for x in _ODD_ASCII) if text.isascii() else _ODD.search(text)):
        keys = _CUT.split(text)
        keys[0] = " " + keys[0]
        return keys
    keys = []
    mark = " "
    for line in text.split("\n"):
        words = line.split(" ")
        words[0] = mark + words[0]
        keys += words
        mark = "\n"
    return keys


def _check(path: str) -> None:
    """Cutting texts at single blanks holds for byte-level BPE with its own pattern and no normalizer only."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    before = made.get("pre_tokenizer") or {}
    able = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not able or made.get("normalizer") or made.get("model", {}).get("type") != "BPE":
        raise ValueError(f"{path} is no byte-level BPE tokenizer of the kind that can be cached by words")


class PieceCache(dict):
    """key -> value of its piece's packed ids (`packed` or `number`); the key of an added special token is its id.

    Misses are encoded in batches. When it holds `most` pieces it starts again from `seed`; pieces of more than LONG
    characters stay for one call only, so its size in bytes is bounded too.
    """

    def __init__(self, path: str, value: Callable[[bytes], object], most: int = 1_500_000, seed: dict | None = None):
        from tokenizers import Tokenizer

        _check(path)
        super().__init__(seed or {})
        self.long: list[str] = []
        self.tokenizer, self.value, self.most, self.seed = Tokenizer.from_file(path), value, most, seed or {}
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.marks: dict[str, object] = {}
        longest = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(longest)})") if longest else None

    def _keys(self, text: str | None) -> list:
        if not text:
            return []
        if not any(s in text for s in self.special):
            return keys_of(text)
        keys = []
        for part in self.split.split(text):
            if part in self.special:
                keys.append(self.special[part])
            elif part:
                keys += keys_of(part)
        return keys

    def prepare(self, texts: list[str | None]) -> list[list]:
        """The keys of each text; all of them are in the cache until the next call."""
        with common.no_cycles():
            return self._prepare(texts)

    def _prepare(self, texts: list[str | None]) -> list[list]:
        out = [self._keys(x) for x in texts]
        for k in self.long:
            self.pop(k, None)
        self.long = []
        if len(self) > self.most:
            self.clear()
            self.update(self.seed)
        new = set().union(*out).difference(self)
        if not new:
            return out
        # Marks after a letter up to the end of a piece are one match of the pattern: head and marks are encoded apart.
        apart, single, joined, heads = [], [], [], set()
        for k in new:
            if isinstance(k, int):
                self[k] = self.value(pack_ids([k]))
                continue
            if len(k) > LONG:
                self.long.append(k)
            if k[-1:] in _MARKS:
                head = k.rstrip(string.punctuation)
                if head[-1:].isalpha():
                    apart.append((k, head, k[len(head) :]))
                    if head not in self and head not in new:
                        heads.add(head)
                    continue
            w = k[1:] if k[:1] in _FIRST else k
            (joined if w.isalpha() or w.split() == [w] else single).append(k)
        for k in heads:
            if len(k) > LONG:
                self.long.append(k)
            w = k[1:] if k[:1] in _FIRST else k
            (joined if w.isalpha() or w.split() == [w] else single).append(k)
        self.update(zip(single, map(self.value, self._encode([piece_of(k) for k in single])), strict=True))
        self._encode_joined(joined)
        if fresh := list({m for _, _, m in apart} - self.marks.keys()):
            if len(self.marks) > self.most:
                self.marks.clear()
                fresh = list({m for _, _, m in apart})
            self.marks.update(zip(fresh, map(self.value, self._encode(fresh)), strict=True))
        self.update((k, self[head] + self.marks[m]) for k, head, m in apart)
        return out

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [pack_ids(x.ids) for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode_joined(self, keys: list[str], width: int = 64) -> None:
        """Encodes words in lines, one word a line: a line feed between them is always one id."""
        if not keys:
            return
        feed = self._encode(["\n"])[0]
        line, value = self.value(feed), self.value
        parts = [keys[i : i + width] for i in range(0, len(keys), width)]
        lines = ["\n".join([k[1:] if k[:1] in _FIRST else " " + k for k in part]) for part in parts]
        packed = feed.join(self._encode(lines)) + feed
        ends = np.flatnonzero(np.frombuffer(packed, dtype="<u4") == int.from_bytes(feed, "little")) * 4
        begins = np.concatenate(([0], ends[:-1] + 4))
        for k, a, b in zip(keys, begins.tolist(), ends.tolist(), strict=True):
            got = value(packed[a:b])
            self[k] = line + got if k[0] == "\n" else got


_SHARED: dict[tuple[str, str], PieceCache] = {}


def worker_cache(path: str, value: Callable[[bytes], object], most: int, seed: dict | None = None) -> PieceCache:
    """This worker's cache for a tokenizer and a value; later tasks of the worker find it filled."""
    name = (path, value.__name__)
    if name not in _SHARED:
        _SHARED[name] = PieceCache(path, value, most, seed)
    cache = _SHARED[name]
    cache.most, cache.seed = most, seed or {}
    return cache


def packed(ids: bytes) -> bytes:
    """The value of a cache that holds ids."""
    return ids


def number(ids: bytes) -> int:
    """The value of a cache that holds numbers of ids."""
    return len(ids) // 4


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    packed = array.array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()
