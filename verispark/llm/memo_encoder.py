"""Encoding by the tokenizers library with a memory of the pieces seen.

Both supported kinds of files split a text into pieces before they merge, and the merges of a piece depend on the piece
alone.  So each distinct piece goes through the library's model once and later ones are looked up. Texts for which the split
here could differ from the library's (characters whose class or case mapping differs between the two) go through the
library whole, and so do texts that hold an added token of the file where ``added`` asks for those.

The memory outlives a task: ``shared`` gives the tasks of a Python worker the same encoder, so frequent pieces are learned once a worker.  It
is filled up to ``most`` pieces; later pieces are remembered for one batch, so memory is bounded whatever the input.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from array import array

import numpy as np
import regex

from verispark.llm.workers import give_back

#: The split of byte-level files and of word files, as the files and the library state them (fixed values).
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Characters for which the library takes the whole text: separators that only Python calls blank, letters with special lower case,
#: and anything outside the planes and blocks of well-settled scripts.
BYTE_LEVEL_ODD = regex.compile(r"[\x1c-\x1f]|[^\x00-ɏͰ-ϿЀ-ӿ -⁯₠-₿぀-ヿ一-龥가-힣]")
WORD_ODD = regex.compile(r"[\x1c-\x1fİΣ]|[^\x00-ɏͰ-ϿЀ-ӿ -⁯₠-₿぀-ヿ一-龥]")

#: Texts without any of these are Latin-1 without apostrophes; they are split by the classes of their bytes, which gives the same pieces.
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x26\x28-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]")
END, LETTER, DIGIT, MARK, BLANK = range(5)
#: Slots of the table of short pieces, as a power of two.
SLOT_BITS = 19


def _classes() -> np.ndarray:
    out = np.full(256, MARK, np.uint8)
    for b in range(256):
        c = chr(b)
        out[b] = END if b == 0 else BLANK if c in "\t\n\r " else DIGIT if c in "0123456789" else LETTER if c.isalpha() else MARK
    return out


CLASS = _classes()
#: What remains of a word of eight bytes if so many belong to the piece.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


#: Pieces that are remembered for good, some 60 MB.
MOST = 250_000


def _byte_table() -> list[str]:
    """The printable stand-in for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Pieces(dict):
    """Piece to number; a new piece is learned when it is first asked for."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, piece: str) -> int:
        self[piece] = n = self.learn(piece)
        return n


class MemoEncoder:
    """encode(texts) gives all ids in one array and the number of ids of each text.

    added: added tokens such as <|endoftext|> get their own ids, as in a plain call of the library; otherwise they are read as text.
    most: pieces that are remembered for good."""

    def __init__(self, path: str, most: int = MOST, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()] if added else []
        self.words = self.tok.normalizer is not None
        self.split = regex.compile(WORD_SPLIT if self.words else BYTE_LEVEL_SPLIT).findall
        self.odd = WORD_ODD if self.words else BYTE_LEVEL_ODD
        self.tokenize = self.tok.model.tokenize
        self.shown = {b: c for b, c in enumerate(_byte_table())}
        self.most = most
        self.index = _Pieces(self._learn)
        self.keys, self.held = np.zeros((2, 1 << SLOT_BITS), np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self.placed = np.zeros(most, bool)
        self.flat, self.start, self.size = array("i"), array("q"), array("i")
        self.passing: list[str] = []  # pieces of this batch, once the memory is full
        self.whole: list[list[int]] = []  # ids of this batch's texts that went through the library whole

    def _learn(self, piece: str) -> int:
        bare = piece[1:] if piece[0] == " " else piece
        if bare.isascii() and bare.isalnum():
            plain = bare if bare is piece else "\u0120" + bare
        else:
            plain = piece.encode().decode("latin-1").translate(self.shown)
        if len(self.index) >= self.most:
            self.passing.append(piece)
        ids = [t.id for t in self.tokenize(plain)]
        self.start.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        return len(self.start) - 1

    def _forget(self) -> None:
        self.whole.clear()
        for piece in self.passing:
            del self.index[piece]
        if self.passing:
            self.passing.clear()
            end = self.start[self.most]
            del self.flat[end:], self.start[self.most :], self.size[self.most :]

    def _entire(self, text: str) -> np.ndarray:
        self.whole.append(self.tok.encode(text, add_special_tokens=False).ids)
        return np.array([-len(self.whole)])

    def _starts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin of each piece of the bytes x, and its class; every zero byte is a piece of its own."""
        c = CLASS[x]
        new = np.ones(len(x), bool)
        new[1:] = c[1:] != c[:-1]
        if self.words:  # digits stand alone
            new |= c == DIGIT
        else:  # a space before other than blanks belongs to what follows; so the last of several blanks is parted from the others
            blank = c == BLANK
            before = np.zeros(len(x), bool)
            before[:-1] = blank[:-1] & (c[1:] != BLANK) & (c[1:] != END)
            new |= before
            new[1:] &= ~(before[:-1] & (x[:-1] == 32))
        new |= c == END
        at = np.flatnonzero(new)
        return at, c[at]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the pieces of each text.  Pieces of up to 16 bytes are looked up in a table of two words a key, all at once."""
        raw = "\0".join([*texts, ""]).encode("latin-1")
        buffer = raw + bytes(16)
        at, kind = self._starts(np.frombuffer(raw, np.uint8))
        n = np.diff(at, append=len(raw))
        if self.words:
            real = kind != BLANK
            at, kind, n = at[real], kind[real], n[real]
        ends = kind == END
        pieces = np.cumsum(~ends)[ends]
        at, n = at[~ends], n[~ends]
        words = np.ndarray(len(buffer) - 7, "<u8", buffer, 0, (1,))
        low, high = words[at] & LOW[np.minimum(n, 8)], words[np.minimum(at + 8, len(words) - 1)] & LOW[np.clip(n - 8, 0, 8)]
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        one = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        two = ((mixed >> np.uint64(20)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        short = n <= 16
        numbers = np.full(len(at), -1, np.int64)
        for slot in (one, two):
            left = np.flatnonzero((numbers < 0) & short)
            own = slot[left]
            hit = (self.keys[0][own] == low[left]) & (self.keys[1][own] == high[left])
            numbers[left[hit]] = self.held[own[hit]]
        new = np.flatnonzero(numbers < 0)
        if len(new):
            text, starts = raw.decode("latin-1"), at[new]
            got = [text[a:z] for a, z in zip(starts.tolist(), (starts + n[new]).tolist(), strict=True)]
            numbers[new] = np.fromiter(map(self.index.__getitem__, got), np.int64, len(got))
            k, first = np.unique(numbers[new], return_index=True)
            i = new[first]
            i = i[short[i] & (k < self.most)]
            i = i[~self.placed[numbers[i]]]
            for slot in (one, two):
                own = slot[i]
                free = self.keys[0][own] == 0
                own, j = own[free], i[free]
                self.keys[0][own], self.keys[1][own], self.held[own] = low[j], high[j], numbers[j]
                won = self.held[own] == numbers[j]
                self.placed[numbers[j[won]]] = True
                i = np.setdiff1d(i, j[won], assume_unique=True)
        return np.split(numbers, pieces[:-1])

    def _numbers(self, text: str) -> np.ndarray:
        if self.words and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.odd.search(text):
            return self._entire(text)
        pieces = self.split(text.lower() if self.words else text)
        return np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))

    def _all_numbers(self, texts: list[str]) -> list[np.ndarray]:
        out, plain = [None] * len(texts), []
        for i, text in enumerate(texts):
            if any(x in text for x in self.added):
                out[i] = self._entire(text)
            elif NOT_PLAIN.search(text):
                out[i] = self._numbers(text)
            else:
                plain.append(i)
        if plain:
            for i, a in zip(plain, self._plain([texts[i].lower() if self.words else texts[i] for i in plain]), strict=True):
                out[i] = a
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self._forget()
        at, counts = self._all_numbers(texts), np.zeros(len(texts), np.int64)
        if not texts or not len(self.start) and not self.whole:
            return np.zeros(0, np.int32), counts
        flat, start, size = (np.frombuffer(x, t) if len(x) else np.zeros(0, t) for x, t in ((self.flat, np.int32), (self.start, np.int64), (self.size, np.int32)))
        where = np.concatenate(at)
        if self.whole:  # their ids follow those of the pieces
            more = np.array([len(x) for x in self.whole], np.int32)
            where[where < 0] = len(start) - 1 - where[where < 0]
            start, size = np.r_[start, len(flat) + np.cumsum(more) - more], np.r_[size, more]
            flat = np.concatenate([flat, *(np.array(x, np.int32) for x in self.whole)])
        n = size[where].astype(np.int64)
        ends = np.cumsum(n)
        upto = np.cumsum([len(a) for a in at], dtype=np.int64)
        total = np.r_[0, ends][upto]
        counts[:] = np.diff(np.r_[0, total])
        ids = flat[np.repeat(start[where] - ends + n, n) + np.arange(int(total[-1]))] if total[-1] else np.zeros(0, np.int32)
        del flat, start, size  # the arrays can grow only while nothing looks at them
        return ids, counts


_SHARED: dict[tuple[str, bool], MemoEncoder] = {}


def shared(path: str, added: bool = False) -> MemoEncoder:
    """The encoder of this process for a file; Spark reuses its Python workers, so later tasks find what earlier ones learned."""
    if (path, added) not in _SHARED:
        release()  # one at a time
        _SHARED[path, added] = MemoEncoder(path, added=added)
    return _SHARED[path, added]


def release() -> None:
    """Lets go of the encoder that earlier tasks left in this process and gives its memory back, so that the next operator has room."""
    if not _SHARED:
        return
    _SHARED.clear()
    gc.collect()  # an encoder and its pieces refer to each other
    give_back()
