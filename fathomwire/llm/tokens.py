"""Token ids of whole texts by the tokenizers library, with a cache of words.

A BPE tokenizer whose pre-tokenizer never joins text across a space gives a text's ids as the
concatenation of its words' ids.  Random words are many, so a second cache holds the ids of the
pre-tokenizer's pieces.  ``many`` takes a run of texts, parts closing signs from
words, and looks up each of its different words once.  Tokenizers of another form go through ``encode_batch_fast`` whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_LIMIT = 300_000
PIECE_LIMIT = 400_000
LONG_WORD = 64
LONG_RUN = 8 << 20


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable letter: itself where it has one, else the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {b: chr(b if b in own else next(spare)) for b in range(256)}


class Recent(dict):
    """A cache of two generations: when one is full it becomes the older, and what is used again moves on."""

    def __init__(self, make, limit: int, longest: int = 1 << 30):
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()

    def forget(self) -> None:
        self.older = {}
        self.clear()


class TextEncoder:
    """``ids(text)``: the ids as little-endian unsigned 32-bit integers in a bytes object."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self._spaces_divide(spec)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.marked = all(x.startswith("<") for x in self.added)
        self.words = Recent(self._word, WORD_LIMIT, LONG_WORD)
        self.parts = Recent(self._part, WORD_LIMIT, LONG_WORD)
        self.pieces = Recent(self._piece, PIECE_LIMIT)
        self.letters = _byte_letters()
        # one run of Latin letters and one of signs: the pre-tokenizer parts them just there
        self.plain = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*)([!-&(-/:;=>?@\[-`{-~]*)").fullmatch

    @staticmethod
    def _spaces_divide(spec: dict) -> bool:
        """Whether spaces are dropped, so that words can be encoded one by one."""
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in pre] == ["Split", "ByteLevel"]
            and pre[0]["behavior"] == "Removed"
            and pre[0]["invert"] is True
            and pre[1]["add_prefix_space"] is False
            and spec.get("post_processor") is None
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
        )

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return array("I", [x.id for x in self.tokenizer.model.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        if len(word) <= LONG_WORD:
            if m := self.plain(word):
                letters, signs = m.groups()
                ids = b""
                if letters:
                    letters = letters.lower()
                    if not letters.isascii():
                        letters = "".join(map(self.letters.__getitem__, letters.encode()))
                    ids = self.pieces[letters]
                return ids + self.pieces[signs] if signs else ids
            if not any(x in word for x in self.added):
                t = self.tokenizer
                return b"".join(self.pieces[p] for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(word)))
        return self._whole(word)

    def _part(self, word: str) -> bytes:
        """As ``_word``, for words that ``many`` has parted: one of small letters is one piece, and stands in one cache only."""
        return self._piece(word) if self.marked and word.islower() and word.isascii() and word.isalpha() and len(word) <= LONG_WORD else self._word(word)

    def forget(self) -> None:
        """Empty the caches, which hold up to some hundred MB."""
        for cache in (self.words, self.parts, self.pieces):
            cache.forget()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._whole(text)
        self.words.turn()
        self.pieces.turn()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))

    def many(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of each text in them) for UTF-8 bytes and offsets from 0; each different word is looked up once."""
        if not self.by_word or len(data) > LONG_RUN:
            each = [self.ids(data[i:j].tobytes().decode()) for i, j in zip(off, off[1:], strict=False)]
            return np.frombuffer(b"".join(each), "<u4"), np.cumsum([0, *(len(x) // 4 for x in each)])
        self.parts.turn()
        self.pieces.turn()
        if self.marked and not (data == ord("<")).any():
            data, off = parted(data, off)
        texts = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(data))
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        each = list(map(self.parts.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        length = np.fromiter(map(len, each), np.int64, len(each)) // 4
        n = length[which := words.indices.to_numpy()]
        end = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        at = np.repeat((np.cumsum(length) - length)[which] - end[:-1], n) + np.arange(end[-1])
        return np.frombuffer(b"".join(each), "<u4")[at], end[split.offsets.to_numpy()]


_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'<"]] = True


def parted(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with a space before the signs that end a word behind an ASCII letter, and with small ASCII letters: the same ids from fewer words.

    A letter before other than ASCII stays: only there the normalizer may join it with what follows, and not every small letter joins as its capital does.
    """
    letter, sign = _LETTER[data], _SIGN[data]
    small = letter.copy()
    small[:-1] &= data[1:] < 0x80
    at = np.flatnonzero(letter[:-1] & sign[1:]) + 1
    rest = np.flatnonzero(~sign)
    ends = np.append((data[rest] == 0x20) | (data[rest] == 0x0A), True)
    at = at[ends[np.searchsorted(rest, at)]]
    return np.insert(np.where(small, data | 0x20, data), at, 0x20), off + np.searchsorted(at, off)


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder a Python worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
