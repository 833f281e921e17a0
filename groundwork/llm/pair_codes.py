"""Two tokenizers over the same bytes: groups of tokens that end together, and the pairs that overlap.

Between two neighbouring ends of either side's tokens lies one stretch of bytes, inside one token
of each: so the stretches are the links, each once. All of it is worked out for many chunks of
text at once in numpy; what a chunk gives is kept, since natural text repeats its chunks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Collection, Iterator
from itertools import chain

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from groundwork.llm.chunk_cache import BORDER, ODD, RUN

#: Bytes, roughly, that each of the two generations of kept chunks may hold, and the longest chunk that is kept.
GENERATION, LONGEST = 32 << 20, 64
#: Characters after which a long text is cut at the next border between chunks.
PIECE = 1 << 20
#: Borders where single spaces and line breaks stand between other characters alone.
LINE_BORDER = re.compile(r"(?=[ \n])")
#: A chunk whose tokens do not spell it counts so many tokens that no sum of others brings it above zero.
NEVER = -(1 << 62)
#: Above all numbers of tokens of a text.
MANY = 1 << 31


def byte_characters() -> dict[str, int]:
    """Stand-in character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """A: a byte-level BPE file of the tokenizers library, given " " + text. B: a sentencepiece file, given text."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        stand, self.a_size, self.b_size = byte_characters(), self.a.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes = [b""] * self.a_size
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        for piece, k in self.a.get_vocab().items():
            self.a_bytes[k] = piece.encode() if piece in special else bytes(stand[c] for c in piece)
        pieces = [self.b.id_to_piece(k) for k in range(self.b_size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        numbers = [str(k) for k in range(max(self.a_size, self.b_size))]
        self.written = [f"{x}{end}" for size, ends in ((self.a_size, ",|"), (self.b_size, ",;")) for end in ends for x in numbers[:size]]
        # Chunks may be taken alone only if no piece of B can cross their borders.
        self.cut = not any(re.search(r"[^▁]▁|\n", p) for p in pieces) and not self.b.encode("", out_type=int) and self.b.encode("\n") == [self.b.piece_to_id("▁"), self.b.piece_to_id("<0x0A>")]
        self.young: dict[str, tuple[bytes, str, int]] = {}
        self.old: dict[str, tuple[bytes, str, int]] = {}
        self.held = 0

    def clear(self) -> None:
        self.young, self.old, self.held = {}, {}, 0

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The chunks of " " + text in order, a list for each piece of a long text."""
        if not self.cut or ODD.search(text):
            yield [f" {text}"]
        elif len(text) <= PIECE:
            yield [f" {x}" for x in BORDER.split(text)] if RUN.search(text) else LINE_BORDER.split(f" {text}")[1:]
        else:
            start = 0
            while start < len(text):
                border = BORDER.search(text, start + PIECE)
                stop = border.start() if border else len(text)
                yield [f" {x}" for x in BORDER.split(text[start:stop])]
                start = stop + 1

    def learn(self, chunks: set[str]) -> None:
        """Make sure that `young` has all of these chunks."""
        wanted = chunks - self.young.keys()
        known = {c: self.old[c] for c in wanted & self.old.keys()}
        self._keep(known.keys(), known.values())
        fresh = list(wanted - known.keys())
        for k in range(0, len(fresh), 20_000):
            part = fresh[k : k + 20_000]
            self._keep(part, self.encode(part))

    def _keep(self, chunks: Collection[str], found: Collection[tuple[bytes, str, int]]) -> None:
        self.young.update(zip(chunks, found, strict=True))
        self.held += sum(map(len, chunks)) + sum([len(f[0]) + len(f[1]) for f in found]) + 256 * len(chunks)

    def turn(self) -> None:
        """To be called between batches: a full young generation becomes the old one; long chunks are not kept."""
        for chunk in [c for c in self.young if len(c) > LONGEST] if self.held > GENERATION // 4 else ():
            del self.young[chunk]
        if self.held > GENERATION:
            self.young, self.old, self.held = {}, self.young, 0

    def encode(self, chunks: list[str]) -> list[tuple[bytes, str, int]]:
        """For each chunk (which starts with a space or line break): packed codes a * b_size + b of its links in order,
        its groups in writing with a ; after each, and its numbers of A and B tokens as one (A * MANY + B)."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        b = [ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, b, strict=True)]  # B adds a space of its own
        found = self._align(chunks, a, b)
        if found is None:  # some chunk is not spelt by its tokens
            found = [(one := self._align([c], [x], [y])) and one[0] or (b"", "", NEVER) for c, x, y in zip(chunks, a, b, strict=True)]
        return found

    def _align(self, chunks: list[str], a: list[list[int]], b: list[list[int]]) -> list[tuple[bytes, str, int]] | None:
        """None if the tokens of A or B do not spell all chunks."""
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        text = "".join(chunks).encode()
        stops = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in chunks])
        a_ends, b_ends = np.cumsum(self.a_lengths[a_ids]), np.cumsum(self.b_lengths[b_ids])
        if not a_ids.size or not b_ids.size or b"".join(map(self.a_bytes.__getitem__, a_ids.tolist())) != text or b"".join(map(self.b_bytes.__getitem__, b_ids.tolist())) != text:
            return None
        if not n_a.all() or not n_b.all() or (a_ends[np.cumsum(n_a) - 1] != stops).any() or (b_ends[np.cumsum(n_b) - 1] != stops).any():
            return None
        ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        again = ends[1:] == ends[:-1]
        both, ends = ends[1:][again], ends[np.append(~again, True)]
        codes = (a_ids[np.searchsorted(a_ends, ends)] * self.b_size + b_ids[np.searchsorted(b_ends, ends)]).astype(np.uint32).tobytes()
        links = (4 * np.searchsorted(ends, stops, "right")).tolist()
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        a_last, b_last = both[a_group] == a_ends, both[b_group] == b_ends
        at = np.concatenate([a_ids + self.a_size * a_last, 2 * self.a_size + b_ids + self.b_size * b_last])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        written = list(map(self.written.__getitem__, at[order].tolist()))
        places, numbers = np.cumsum(n_a + n_b).tolist(), (n_a * MANY + n_b).tolist()
        found, low, start = [], 0, 0
        for high, stop, n in zip(links, places, numbers, strict=True):
            found.append((codes[low:high], "".join(written[start:stop]), n))
            low, start = high, stop
        return found

    def documents(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, int, int, int, bytes]]:
        """For each text the codes of its links, its numbers of A and B tokens and of groups, and the groups' digest.

        All zero, and no digest, for a null or empty text and for one that the tokens of A or B do not spell.
        """
        pieces = [list(self.chunks(t)) if t else [] for t in texts]
        wanted: set[str] = set()
        wanted.update(*(chunks for one in pieces for chunks in one))
        self.learn(wanted)
        get = self.young.__getitem__
        for one in pieces:
            codes, n, groups, digest, before = [], 0, 0, hashlib.sha256(), ""
            for chunks in one:
                found = list(map(get, chunks))
                n += sum([f[2] for f in found])
                codes.append(b"".join([f[0] for f in found]))
                written = "".join([f[1] for f in found])
                groups += written.count(";")
                digest.update(f"{before}{written[:-1]}".encode())
                before = ";"
            if n > 0:
                yield np.frombuffer(b"".join(codes), np.uint32), *divmod(n, MANY), groups, digest.digest()
            else:
                yield np.zeros(0, np.uint32), 0, 0, 0, b""
        self.turn()
