"""Encoding of whole texts with a tokenizers file, each distinct piece of text once per worker.

A text is cut before every single space that stands between two other characters. There no token of either
supported file can cross: a pre-token may only begin with that space, or the space is dropped, and nothing
before the cut changes what follows it. So the ids of a text are those of its pieces, in order. Texts where
white space meets white space at a cut are encoded whole by the library.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of distinct pieces and their ids that a worker holds while a task runs, and between tasks. What was met
#: first stays, as that is what is common; the rest is encoded anew when it is met again.
HELD_BYTES = 64 << 20
IDLE_BYTES = 16 << 20
#: Bytes that a piece takes besides its characters: the string's head, its place in the table, its number, its ids.
PIECE_BYTES = 190

#: What the word file's splitter keeps, as its JSON states it (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces of these characters are normalised alike by Python and by the library: no marks to compose, plain lower case.
PLAIN = r"[\x00-\u024F]*"
#: Stands for the end of a word where merges are looked up; pieces that hold it are left to the library.
WORD_END = "\x01"


@lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def encoder(path: str) -> "PieceEncoder":
    return PieceEncoder(path)


def releasing(path: str, run):
    """run (batches to batches), whose worker lets go of most of its pieces when a task ends: workers outlive their stage."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            encoder(path).release()

    return task


def bytes_as_characters() -> dict[int, str]:
    """The printable character that byte-level files write for each byte: itself where printable, else the next free one from U+0100."""
    printable = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(free)) for b in range(256)}


class PieceEncoder:
    """encode(texts): one array of ids for each text, equal to the library's with add_special_tokens=False."""

    def __init__(self, path: str):
        import json

        self.tokenizer = library(path)
        with open(path) as f:
            kind = json.load(f)
        # white space is dropped by a Split that keeps only its matches; else a space belongs to the word after it
        self.keeps_space = (kind.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.fast = self._merges(kind)
        self._reset()

    def _merges(self, kind: dict):
        """A function from pieces to all their ids and each one's number of ids, by the file's own merges in tiktoken's faster loop.

        It takes the pieces joined by the single spaces at which they were cut, so their ids are those of one text.
        """
        import regex
        import tiktoken

        model, special = kind["model"], [t["content"] for t in kind.get("added_tokens", [])]
        byte_of = {c: b for b, c in bytes_as_characters().items()}
        suffix = model.get("end_of_word_suffix") or ""
        ranks = {}
        for token, i in model["vocab"].items():
            if token in special:
                continue
            ended = bool(suffix) and token.endswith(suffix) and token != suffix
            ranks[bytes(byte_of[c] for c in (token[: -len(suffix)] if ended else token)) + (WORD_END.encode() if ended else b"")] = i
        self.plain = regex.compile(PLAIN).fullmatch
        if suffix:
            split, space = regex.compile(WORDS + "| ").findall, ranks[b" " + WORD_END.encode()]
            encode = tiktoken.Encoding("words", pat_str=f"[^{WORD_END}]+{WORD_END}", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

            def fast(pieces: list[str]):
                ids = np.asarray(encode(WORD_END.join(split(" ".join(pieces).lower() + " ")) + WORD_END), np.uint32)
                between = np.flatnonzero(ids == space)  # no word holds a space
                return np.delete(ids, between), np.diff(between, prepend=-1) - 1

        else:
            import public_tokenizers

            encode = tiktoken.Encoding("text", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
            widths = np.zeros(max(ranks.values()) + 1, np.int64)
            widths[list(ranks.values())] = list(map(len, ranks))

            def fast(pieces: list[str]):
                ids = np.asarray(encode("".join(pieces)), np.uint32)
                stops = np.cumsum([len(p.encode()) for p in pieces])
                return ids, np.diff(np.searchsorted(np.cumsum(widths[ids]), stops) + 1, prepend=0)

        return fast

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.leads: dict[str, int] = {}
        self.size = 0
        self.odd = np.zeros(1 << 12, bool)
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)
        self.arena = np.zeros(1 << 16, np.uint32)
        self.used = self.held = 0

    def release(self, most: int = IDLE_BYTES) -> None:
        """Cuts the table back to its first pieces, of about `most` bytes; to be called when a task ends."""
        if self.held <= most:
            return
        sizes = np.full(self.size, PIECE_BYTES)
        for table in (self.index, self.leads):
            sizes[np.fromiter(table.values(), np.int64, len(table))] += np.fromiter(map(len, table), np.int64, len(table))
        sums = np.cumsum(sizes)
        stays = int(np.searchsorted(sums, most))
        self.index, self.leads = ({w: n for w, n in table.items() if n < stays} for table in (self.index, self.leads))
        self.size, self.held = stays, int(sums[stays - 1]) if stays else 0
        self.used = int((self.starts[:stays] + self.lengths[:stays]).max(initial=0))
        self.arena = np.concatenate([self.arena[: self.used], np.zeros(max(1 << 16, self.used), np.uint32)])
        self.starts, self.lengths, self.odd = (np.concatenate([x[:stays], np.zeros(max(1 << 12, stays), x.dtype)]) for x in (self.starts, self.lengths, self.odd))

    def _is_fast(self, piece: str) -> bool:
        return (piece.isascii() or self.plain(piece) is not None) and "<|" not in piece and WORD_END not in piece

    def _add(self, pieces: list[str], odd: list[bool]) -> np.ndarray:
        """Encodes new pieces; their numbers."""
        lengths = np.zeros(len(pieces), np.int64)
        fast = np.fromiter(map(self._is_fast, pieces), bool, len(pieces))
        if self.keeps_space:  # joined, only a space between two other characters keeps to its own piece
            fast &= ~np.asarray(odd, bool)
            fast &= np.fromiter((p[:1] == " " for p in pieces), bool, len(pieces))
        quick, slow = np.flatnonzero(fast), np.flatnonzero(~fast)
        ids, counts = self.fast([pieces[i] for i in quick]) if len(quick) else (np.zeros(0, np.uint32), 0)
        lengths[quick] = counts
        coded = [e.ids for e in self.tokenizer.encode_batch([pieces[i] for i in slow], add_special_tokens=False)]
        lengths[slow] = list(map(len, coded))
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(coded), np.uint32)])
        order = np.concatenate([quick, slow])
        starts = np.empty(len(pieces), np.int64)
        starts[order] = self.used + np.cumsum(lengths[order]) - lengths[order]
        numbers = np.arange(self.size, self.size + len(pieces))
        self.size += len(pieces)
        while self.used + len(ids) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros(len(self.arena), np.uint32)])
        while self.size > len(self.starts):
            self.starts, self.lengths, self.odd = (np.resize(x, 2 * len(x)) for x in (self.starts, self.lengths, self.odd))
        self.arena[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.held += PIECE_BYTES * len(pieces) + sum(map(len, pieces))
        self.starts[numbers], self.lengths[numbers], self.odd[numbers] = starts, lengths, odd
        return numbers

    def _rows(self, index: dict[str, int], words: list[str], lead: bool) -> np.ndarray:
        """Where each word stands in the table; those not met before are encoded now."""
        found = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(found < 0)
        if len(at):
            new = [words[i] for i in at]
            if lead:
                new = list(dict.fromkeys(new))
            # with its space before it, a piece is odd if it has no other character, or white space at either end
            odd = [bool(w) and w[-1].isspace() for w in new] if lead else [not w or w.strip() != w for w in new]
            numbers = self._add([" " + w for w in new] if self.keeps_space and not lead else new, odd)
            index.update(zip(new, numbers.tolist()))
            found[at] = [index[words[i]] for i in at] if lead else numbers
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        n = len(texts)
        if not n:
            return []
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = parts.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        strange = np.zeros(n, bool)
        if self.held > HELD_BYTES:
            self.release()
        at = self._rows(self.index, words, False)[codes]
        if self.keeps_space:
            firsts = offsets[:-1]
            at[firsts] = self._rows(self.leads, [words[c] for c in codes[firsts]], True)
            strange = np.logical_or.reduceat(self.odd[at], firsts)
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        source = np.repeat(self.starts[at] - (ends - lengths), lengths)
        source += np.arange(total)
        flat = self.arena[source]
        bounds = np.concatenate([[0], ends[offsets[1:] - 1]])
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i in np.flatnonzero(strange):
            out[i] = np.asarray(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return out
