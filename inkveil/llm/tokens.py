"""Exact token ids of whole texts with a given tokenizer file, by way of a cache of chunks.

A chunk is a run that the tokenizer's own splitting never joins with its neighbours,
so the ids of a text are the ids of its chunks in order. The same words come again and
again; each worker encodes a chunk once and looks it up afterwards. The cache is
bounded; beyond the bound new chunks are encoded each time.
"""

from __future__ import annotations

import os
import re
import struct
import zlib


#: White space of the tokenizers' patterns (Unicode White_Space), a fixed value.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Within a run without white space: the run whole where it has an apostrophe (contractions);
#: else Latin letters, and ASCII signs and digits, each up to a place where the tokenizer
#: splits too; else the rest of the run. Possessive, so that no letter run is cut short.
_SOLID = f"[^{_WS}']*+'[^{_WS}]*+|{{s}}[{_LATIN}]++(?=[\\x00-\\x7f]|\\Z)|{{s}}[!-&(-@\\[-`{{{{-~]++(?=[{_LATIN}{_WS}]|\\Z)|{{s}}[^{_WS}]++"
_CHUNKS = {
    "leading": re.compile(f" ?{_SOLID.format(s=' ?')}|[{_WS}]+(?![^{_WS}])|[{_WS}]+"),  # a word takes one space before it
    "dropped": re.compile(_SOLID.format(s="")),  # white space is dropped
}
_loaded: dict[tuple[str, str], Encoder] = {}


_LETTERS = re.compile(f" ?[{_LATIN}]+").fullmatch


def _byte_alphabet() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next one from 256 up."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder(dict):
    """Ids of chunks, as bytes; a missing one is encoded, and kept while there is room."""

    def __init__(self, path: str, spaces: str, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.split, self.most = _CHUNKS[spaces].findall, most
        self.merge, self.alphabet, self.lower = self.tokenizer.model.tokenize, _byte_alphabet(), spaces == "dropped"
        self.space = self.alphabet[32]

    def __missing__(self, chunk: str) -> bytes:
        if _LETTERS(chunk) and "\u0130" not in chunk:  # one piece for the merges: no need to split or normalize it
            piece = chunk.lower() if self.lower else chunk
            if not piece.isascii():
                piece = piece.encode().decode("latin-1").translate(self.alphabet)
            elif piece[0] == " ":  # of ASCII letters and spaces the space alone has another letter
                piece = self.space + piece[1:]
            ids = [t.id for t in self.merge(piece)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.most:
            self[chunk] = out
        return out

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [b"".join(map(self.__getitem__, self.split(t))) for t in batch]


def encoder(path: str, spaces: str) -> Encoder:
    """The worker's own encoder for this file."""
    if (path, spaces) not in _loaded:
        _loaded[path, spaces] = Encoder(path, spaces)
    return _loaded[path, spaces]


def encode_rows(texts: list[str], path: str, spaces: str, end: int):
    """Ids with the end id for each text."""
    enc, tail = encoder(path, spaces), struct.pack("<I", end)
    for text in texts:
        yield enc.encode([text])[0] + tail


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
