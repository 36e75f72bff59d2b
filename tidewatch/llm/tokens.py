"""Byte-level BPE ids of whole texts with the ``tokenizers`` library, cached by piece.

Most time of the library goes into normalising and splitting. Both tokenizers used here split at white space in a way
that never depends on more than one blank, so a text is cut at single blanks, equal pieces are encoded once, and only
their byte-pair merges go to the library's model. Anything unusual (other scripts, runs of blanks, special tokens) is
given to the library whole, so ids always equal ``Tokenizer.encode(text, add_special_tokens=False).ids``.
"""

from __future__ import annotations

import json
import os
import struct
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Cached pieces; the cache starts anew beyond that. About 200 MB of a worker at most.
CACHED = 700_000
#: Longer pieces are not kept.
LONGEST = 48


class _Whole(Exception):
    """The text cannot be cut at its blanks."""


class _Cache(dict):
    """Results of ``make`` by piece; very long pieces are not kept."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        made = self.make(piece)
        if len(piece) <= LONGEST:
            self[piece] = made
        return made


class PieceEncoder:
    """Ids of a text as little-endian unsigned integers of ``self.width`` bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._plain = regex.compile("[\\x20-\\x7e\\t\\n\\r\\xa1-\\u012f\\u0131-\\u024f]*").fullmatch
        kinds = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"] or {"type": ""}])]
        lowered = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds == ["ByteLevel"] and spec["normalizer"] is None and not spec["pre_tokenizer"]["add_prefix_space"]:
            # The pattern that the library's byte-level splitter documents.
            self.blank, self.lower = " ", False
            self._pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        elif kinds == ["Split", "ByteLevel"] and lowered == ["NFC", "Replace", "Lowercase"]:
            self.blank, self.lower = "", True
            self._pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        else:
            self.blank, self.lower = None, False
        self._any_special = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)").search
        # Marks that the splitter parts from the letters before them, as one piece.
        self._marks = {c for c in ",.;:!?" if self.blank is not None and self._pieces(f"{self.blank}ab{c}") == [f"{self.blank}ab", c]}
        # Printable bytes stand for themselves, the others for the characters from 256 on, in order.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        self._byte = {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}
        self._units, self._cores = _Cache(self._missing), _Cache(self._core)
        self._tokenize, self._kind, self._shown = self.model.tokenize, "H" if self.width == 2 else "I", (self.blank or "").translate(self._byte)

    def library(self, text: str) -> bytes:
        """Ids straight from the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if self.blank is None:
            return self.library(text)
        if len(self._units) > CACHED:
            self._units.clear()
        parts = text.split(" ")
        try:
            if self.blank:
                first = parts[0]
                parts[0] = "a"
                found = list(map(self._units.__getitem__, parts))
                found[0] = self._unit(first, "")
            else:
                found = map(self._units.__getitem__, parts)
            return b"".join(found)
        except _Whole:
            return self.library(text)

    def _missing(self, part: str) -> bytes:
        if part.isascii():
            # The usual cases, a word and a word with a mark, in one place: most new parts are such words.
            mark = part[-1:] if part[-1:] in self._marks else ""
            word = part[:-1] if mark else part
            if word.isalpha():
                piece = self.blank + (word.lower() if self.lower else word)
                made = self._cores.get(piece)
                if made is None:
                    made = array(self._kind, [t.id for t in self._tokenize(self._shown + piece[len(self.blank):])]).tobytes()
                    if len(piece) <= LONGEST:
                        if len(self._cores) > CACHED:
                            self._cores.clear()
                        self._cores[piece] = made
                return made + self._cores[mark] if mark else made
        if self.blank and (not part or part[0].isspace()):
            raise _Whole
        return self._unit(part, self.blank)

    def _unit(self, part: str, blank: str) -> bytes:
        if part.isascii() and part.isalpha():  # the usual case
            return self._cores[blank + (part.lower() if self.lower else part)]
        if not self._plain(part) or self._any_special(part):
            return self.library(blank + part)
        if self.lower:
            part = part.lower()
        return b"".join(map(self._cores.__getitem__, self._pieces(blank + part)))

    def _core(self, piece: str) -> bytes:
        plain = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self._byte)
        ids = [t.id for t in self.model.tokenize(plain)]
        if len(self._cores) > CACHED:
            self._cores.clear()
        return self._pack(len(ids), ids)

    def _pack(self, size: int, ids: list[int]) -> bytes:
        return struct.pack(f"<{size}{'H' if self.width == 2 else 'I'}", *ids)

    def array(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype=self.dtype)

    def token_bytes(self) -> np.ndarray:
        """Number of text bytes behind each id; the bytes of a byte-level token are its characters."""
        sizes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=np.int32)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            sizes[number] = len(token.encode()) if token in self.special else len(token)
        return sizes


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file."""
    return PieceEncoder(path)


def crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
