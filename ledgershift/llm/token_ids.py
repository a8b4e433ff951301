"""Token ids of whole texts by a public tokenizer file, with a cache of words.

A tokenizer that drops white space and splits by letters, digits and the rest gives a text the ids of its words one
after the other. So a worker keeps the ids of words and encodes only those that it does not hold, and a text is a join
of byte strings. Capitals are folded first where that changes no id, a word and the punctuation behind it are kept
apart, and when the cache is full its older half goes: common words stay. Any other tokenizer file encodes whole texts.
"""

from __future__ import annotations

import json
import re
from array import array
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .kernels import text_buffer

#: Words that a worker keeps, with their ids: some 160 bytes each.
CACHED = 900_000

# The normaliser and splitter of the word tokenizer for which the ids of words may be joined.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The same split for visible characters below U+0250, which NFC leaves alone.
_SIMPLE = re.compile("[!-~\xa1-įı-ɏ]+")
_NUMBERS = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W{_NUMBERS}_]+|[{_NUMBERS}]|(?:[^\w\s]|_)+")


def _byte_characters() -> dict[int, str]:
    """Byte -> the visible character that byte-level vocabularies write for it: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = "".join(c for _, c in sorted(_byte_characters().items()))

#: Punctuation that is one part of its own behind an ASCII letter or digit; not that of special tokens.
_TAIL = b".,;:!?)*#&%$\"'"


def _folded(text: bytes) -> bytes:
    """text with ASCII letters in lower case, unless it may hold a special token or a mark (U+0300 to U+036F) that NFC joins to one case only."""
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


class _Words(dict):
    """Word -> ids; a word that is not there is encoded when it is asked for.

    At half of the encoder's bound the words become the older ones, in place of those before; one that is asked for again comes back.
    """

    def __init__(self, encoder: TextIds):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def known(self, word: bytes) -> bytes | None:
        return self.get(word) or self.older.get(word)

    def __missing__(self, word: bytes) -> bytes:
        if 2 * len(self) >= self.encoder.most:
            self.older = {}  # before the copy, so that no three halves are held
            self.older = self.copy()
            self.clear()
            self.encoder.parts.clear()
        out = self.older.get(word)
        if out is None:
            stem = word.rstrip(_TAIL)
            if len(stem) < len(word) and stem[-1:].isalnum():
                tail, out = self[word[len(stem) :]], self.known(stem)
                if out is None:  # the stem is kept alone: the whole word may not come again
                    return self[stem] + tail
                out += tail
            else:
                out = self.encoder._word(word.decode())
        self[word] = out
        return out


class TextIds:
    """ids(text bytes) -> little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, most: int = CACHED):
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normalizer = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.by_word = normalizer == _NORMALIZER and split == _SPLIT
        self.model, self.words, self.parts = self.tokenizer.model, _Words(self), {}

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _tokens(self, part: str) -> bytes:
        as_bytes = part if part.isascii() else charmap_decode(part.encode(), "strict", _BYTES)[0]
        return array("I", [t.id for t in self.model.tokenize(as_bytes)]).tobytes()

    def _part(self, part: str) -> bytes:
        known = self.parts.get(part)
        if known is None:
            known = self.parts[part] = self.words.known(part.encode()) or self._tokens(part)  # a lower-case word by itself
        return known

    def _word(self, word: str) -> bytes:
        if not _SIMPLE.fullmatch(word) or "<|" in word:
            return self._encoded(word)
        word = word.lower()
        if word.isalpha():
            return self._tokens(word)
        return b"".join(map(self._part, _PARTS.findall(word)))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [self._encoded(x.decode()) for x in texts]
        get = self.words.__getitem__
        return [b"".join(map(get, _folded(x).split())) for x in texts]


@lru_cache(2)
def text_ids(path: str, most: int) -> TextIds:
    """One encoder a worker process and file."""
    return TextIds(path, most)


def encode_column(column: pa.Array, path: str, end_id: int, most: int = CACHED) -> list[np.ndarray]:
    """uint32 ids of each text (null: empty), with end_id after the last; texts are taken some at a time. most: words that a worker keeps."""
    data, offsets = text_buffer(column)
    encoder, tail, out = text_ids(path, most), np.array([end_id], "<u4").tobytes(), []
    for k in range(0, len(column), 256):
        some = [data[a:b].tobytes() for a, b in zip(offsets[k : k + 256].tolist(), offsets[k + 1 : k + 257].tolist(), strict=False)]
        out += [np.frombuffer(x + tail, "<u4") for x in encoder.ids(some)]
    return out
