"""Tokenizing by chunks of text whose tokens do not depend on their neighbours, with per-worker caches.

A tokenizer that pre-splits text gives the same tokens for a chunk wherever it stands, if
no pre-token can cross the chunk's borders. Natural text repeats its chunks, so the
library encodes each one once for each worker and later hits are dictionary look-ups.
Texts with characters for which the borders would need more care go to the library whole.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from groundwork.llm.common import CACHE_ENTRIES

_open: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, loaded once for each worker."""
    if path not in _open:
        _open[path] = Tokenizer.from_file(path)
    return _open[path]


#: Chunks of these characters alone, without an apostrophe, split in the same way under every
#: version of Unicode: into runs of letters, digits, and runs of the rest.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-įı-ɏ]+")
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Digits one by one (word_bpe) or in runs (byte_bpe).
ONE_DIGIT, DIGITS = (re.compile(rf"[{LETTERS}]+|[0-9]{run}|[^{LETTERS}0-9]+") for run in ("", "+"))


class ByteMap(dict):
    """For str.translate: a character's code to the library's stand-in characters for its UTF-8 bytes."""

    def __missing__(self, code: int) -> str:
        self[code] = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0]
        return self[code]


BYTES = ByteMap()


class PackedId(dict):
    """An id to its little-endian bytes; one entry for each id of the vocabulary at most."""

    def __init__(self, kind: str) -> None:
        self.width = np.dtype(kind).itemsize

    def __missing__(self, number: int) -> bytes:
        self[number] = packed = number.to_bytes(self.width, "little")
        return packed


class PieceIds(dict):
    """Pre-token of a plain chunk -> its packed ids: the library's model alone, without its normalizer and splitter.

    There are far fewer pre-tokens than chunks, so this is the table that is kept large.
    """

    def __init__(self, model, kind: str = "<u4") -> None:
        self.model, self.kind = model, kind
        self.packed = PackedId(kind)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= 3 * CACHE_ENTRIES:
            self.clear()
        # ASCII letters and digits stand for themselves; a space before them does not.
        found = self.model.tokenize(piece if piece.isascii() and piece.isalnum() else piece.translate(BYTES))
        self[piece] = ids = self.packed[found[0].id] if len(found) == 1 else b"".join([self.packed[t.id] for t in found])
        return ids


class ChunkIds(dict):
    """White-space-free chunk of UTF-8 bytes -> its token ids as packed little-endian integers.

    For tokenizers that drop white space and split at it (word_bpe): the ids of a text are
    those of its chunks in turn. Only ASCII white space ends a chunk; any other is left to
    the library inside the chunk.
    """

    def __init__(self, path: str, kind: str = "<u4") -> None:
        self.tokenizer, self.kind = tokenizer(path), kind
        self.pieces = PieceIds(self.tokenizer.model, kind)

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if chunk.isalpha():  # ASCII letters alone: one pre-token
            packed = self.pieces[chunk.lower().decode()]
        elif PLAIN.fullmatch(text := chunk.decode()) and "<|" not in text:
            packed = b"".join(map(self.pieces.__getitem__, ONE_DIGIT.findall(text.lower())))
        else:
            packed = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if len(chunk) <= 64:
            self[chunk] = packed
        return packed

    def encode(self, text: bytes | None) -> bytes:
        """The packed ids of a whole text; none for a null text."""
        return b"".join(map(self.__getitem__, text.split())) if text else b""


_ids: dict[tuple[str, str], ChunkIds] = {}


def chunk_ids(path: str, kind: str = "<u4") -> ChunkIds:
    if (path, kind) not in _ids:
        _ids[path, kind] = ChunkIds(path, kind)
    return _ids[path, kind]


#: Characters that are white space for one library and not for another, or controls.
ODD = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\xa0 ᠎ -‏ -  -⁯　﻿]")
#: White space beside white space or at an end: there a run is shared out between pre-tokens.
RUN = re.compile(r"[ \t\n][ \t\n]|^[ \t\n]|[ \t\n]$|\t")
BORDER = re.compile(r"(?<=[^ \t\n]) (?=[^ \t\n])")


class ChunkLengths(dict):
    """Chunk -> number of tokens of `prefix` + chunk, for byte-level BPE where a space joins the word after it.

    Tier one is the table of frequent chunks given at the start, tier two what this worker
    has encoded itself; tier two is emptied when full.
    """

    def __init__(self, path: str, prefix: str, frequent: dict[str, int]) -> None:
        super().__init__(frequent)
        self.tokenizer, self.prefix, self.frequent = tokenizer(path), prefix, frequent
        self.pieces = PieceIds(self.tokenizer.model)

    def __missing__(self, chunk: str) -> int:
        if len(self) >= CACHE_ENTRIES + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            head, *rest = DIGITS.findall(chunk)
            n = (len(self.pieces[self.prefix + head]) + sum(len(self.pieces[piece]) for piece in rest)) // 4
        else:
            n = len(self.tokenizer.encode(self.prefix + chunk, add_special_tokens=False).ids)
        if len(chunk) <= 64:
            self[chunk] = n
        return n


class TokenCounter:
    """Counts a text's tokens of a byte-level BPE tokenizer through two tables of chunks."""

    def __init__(self, path: str, first: dict[str, int], spaced: dict[str, int]) -> None:
        self.tokenizer = tokenizer(path)
        self.first, self.spaced = ChunkLengths(path, "", first), ChunkLengths(path, " ", spaced)
        self.newline = self.first["\n"]

    def clear(self) -> None:
        """Leave tier one alone in both tables."""
        for table in (self.first, self.spaced):
            table.clear()
            table.update(table.frequent)
            table.pieces.clear()

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str | None) -> int:
        """Tokens of a whole text, as the library gives them."""
        if not text:
            return 0
        if ODD.search(text):
            return self.whole(text)
        first, spaced = self.first.__getitem__, self.spaced.__getitem__
        if not RUN.search(text):
            # A line break between two words is a pre-token of its own.
            n = -self.newline
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                n += self.newline + first(head) + sum(map(spaced, rest))
            return n
        head, *rest = BORDER.split(text)
        return first(head) + sum(map(spaced, rest))
