"""Token ids of whole texts as bytes (little-endian unsigned 32-bit), a word at a time.

The vocabulary drops white space, so the ids of a text are those of its words in turn. A worker keeps the ids of words
it has met (a bounded table), because the tokenizer itself is some ten times slower than a look-up.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from tokenizers import Tokenizer

#: Words a worker remembers; the table is emptied when full.
REMEMBERED = 600_000
LONGEST_REMEMBERED = 64


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """Lower-case word to the bytes of its ids."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encodes with one vocabulary file of this library's BPE with word ends (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path) as f:
            self.json = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        split = self.json["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        self.special = [t["content"] for t in self.json["added_tokens"]]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.words = _Words(self._word)
        self.get = self.words.__getitem__

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(word)
        parts = self.pieces.findall(word)
        if len(parts) == 1:
            return self._piece(parts[0]) if parts[0].isprintable() else self._whole(word)
        return b"".join(map(self.get, parts))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a UTF-8 text; the plain path is for code points below U+0240, others go to the tokenizer itself."""
        if not text:
            return b""
        plain = text.isascii() or int(np.frombuffer(text, np.uint8).max()) < 0xC9
        odd = not plain or any(c in text for c in (b"\x1c", b"\x1d", b"\x1e", b"\x1f")) or any(s.encode() in text for s in self.special)
        if odd or b"\x7f" in text or b"\x00" in text:
            return self._whole(text.decode("utf-8", "replace"))
        return b"".join(map(self.get, text.decode().lower().split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
