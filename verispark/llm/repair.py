"""Re-Pair grammar compression of id sequences, and the shard file format.

The compressor repeats until no pair occurs ``LEAST`` times: count adjacent pairs, give the frequent ones a nonterminal each, replace.  A round
replaces all frequent pairs at once; where two overlap the more frequent wins.  After the first round only pairs that could be frequent before or
hold a new nonterminal are counted again: any other pair has lost places at most.  Pairs never cross the end of a document, so every
document is its own run of symbols and can be decoded alone.

A shard in bytes, little-endian: magic, then six uint64 (documents, ids, symbols, rules, first nonterminal, bits of a symbol), then the arrays:
both symbols of each rule, expansion length of each rule (uint32), ids before each document (uint64, one more than documents), symbols
before each document (the same), symbols.  Symbols are the low 16 bits of all of them, then each higher bit of all of them, packed.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"VRPAIR02"
LEAST = 12
SLOT_BITS = 18


def _frequent(seq: np.ndarray, at: np.ndarray, least: int, salt: int):
    """Of the pairs that begin at the places ``at``: the frequent ones, most frequent first; the places whose pair may be frequent, now or
    in a later round, ascending; and the rank of the pair at each of those, or the number of frequent pairs if it has none.

    Pairs are counted in hashed slots.  A slot's count bounds each of its pairs', so places in slots below ``least`` are done.  Of the pairs that
    share a slot one is counted in a round, and another salt separates them in the next; if none is frequent, all that are left are counted."""
    slot = seq[at] * np.uint32(0x9E3779B1 + 2 * salt) + seq[at + 1] * np.uint32(0xC2B2AE35 + 4 * salt)
    slot = ((slot ^ (slot >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - SLOT_BITS)).astype(np.int32)
    hot = (np.bincount(slot, minlength=1 << SLOT_BITS) >= least)[slot]
    at, own = at[hot], slot[hot]
    codes = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
    held = np.zeros(1 << SLOT_BITS, np.uint64)
    held[own] = codes
    same = held[own] == codes
    counts = np.bincount(own[same], minlength=1 << SLOT_BITS)
    if counts.max(initial=0) < least:
        held, own, counts = np.unique(codes, return_inverse=True, return_counts=True)
        same = np.ones(len(at), bool)
    order = np.flatnonzero(counts >= least)
    order = order[np.lexsort((held[order], -counts[order]))]
    place = np.full(len(counts), len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    rank = np.where(same, place[own], np.int32(len(order)))
    stay = ~same | (rank < len(order))
    return held[order], at[stay], rank[stay]


def compress(ids: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST):
    """ids with the (exclusive) end of each document; first: the first nonterminal.  Returns symbols, their ends, rules."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    top, salt = first, 0
    at = np.flatnonzero(~last[:-1])
    while len(at):
        pairs, at, rank = _frequent(seq, at, least, salt)
        if not len(pairs):
            break
        salt, none = salt + 1, len(pairs)
        full = np.full(len(seq) + 1, none, np.int32)
        full[at] = rank
        before, after = np.where(at > 0, full[at - 1], none), full[at + 1]
        begins = rank != before  # places of one rank on end are a run of one symbol: every second is taken
        nth = np.arange(len(at))
        nth -= np.maximum.accumulate(np.where(begins, nth, 0))
        take = at[(rank < none) & (nth % 2 == 0) & (~begins | (rank < before)) & (rank <= after)]
        seq[take] = top + full[take]
        last[take] = last[take + 1]
        open_ = np.zeros(len(seq), bool)
        open_[at] = True
        open_[take] = True
        open_[np.maximum(take - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[take + 1] = False
        seq, last, open_ = seq[keep], last[keep], open_[keep]
        at = np.flatnonzero(open_[:-1] & ~last[:-1])
        rules.append(np.stack([(pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)], 1))
        top += none
    own_ends = np.flatnonzero(last) + 1
    out = np.zeros(len(ends), np.int64)
    full_docs = np.diff(np.r_[0, ends]) > 0
    out[full_docs] = own_ends
    return seq, np.maximum.accumulate(out) if len(out) else out, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansions(rules: np.ndarray, first: int) -> np.ndarray:
    """Number of ids each rule stands for; a rule refers to earlier ones only."""
    out = np.ones(len(rules), np.uint64)
    done = 0
    while done < len(rules):
        ready = (rules[done:] < first + done).all(axis=1)
        upto = len(rules) if ready.all() else done + int(np.argmin(ready))
        size = lambda s: np.where(s < first, np.uint64(1), out[np.minimum(np.maximum(s.astype(np.int64) - first, 0), len(out) - 1)])  # noqa: E731, B023
        out[done:upto] = size(rules[done:upto, 0]) + size(rules[done:upto, 1])
        done = upto
    return out


def _symbols_bytes(symbols: np.ndarray, bits: int) -> bytes:
    high = [np.packbits((symbols >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(16, bits)]
    return b"".join([symbols.astype("<u2").tobytes(), *high])


def _read_symbols(data: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    out = np.frombuffer(data, "<u2", n, at).astype(np.uint32)
    at += 2 * n
    for k in range(16, bits):
        out |= np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(np.uint32) << np.uint32(k)
        at += -(-n // 8)
    return out, at


def pack_shard(ids: np.ndarray, ends: np.ndarray, first: int, **how) -> bytes:
    """ends: exclusive end of each document in ids, of which there are less than 2 ** 32."""
    ends = np.asarray(ends, np.int64)
    seq, seq_ends, rules = compress(ids, ends, first, **how)
    bits = max(16, int(first + len(rules) - 1).bit_length())
    head = np.array([len(ends), len(ids), len(seq), len(rules), first, bits], "<u8")
    return b"".join([MAGIC, head.tobytes(), _symbols_bytes(rules.reshape(-1), bits), expansions(rules, first).astype("<u4").tobytes(), np.r_[0, ends].astype("<u8").tobytes(), np.r_[0, seq_ends].astype("<u8").tobytes(), _symbols_bytes(seq, bits)])


class Shard:
    """Random access to a packed shard."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        self.docs, self.n_ids, n_seq, n_rules, self.first, bits = (int(x) for x in np.frombuffer(data, "<u8", 6, 8))
        pairs, at = _read_symbols(data, 56, 2 * n_rules, bits)
        self.rules = pairs.reshape(-1, 2)
        self.sizes = np.frombuffer(data, "<u4", n_rules, at).astype(np.int64)
        at += 4 * n_rules
        self.id_at = np.frombuffer(data, "<u8", self.docs + 1, at).astype(np.int64)
        at += 8 * (self.docs + 1)
        self.seq_at = np.frombuffer(data, "<u8", self.docs + 1, at).astype(np.int64)
        at += 8 * (self.docs + 1)
        self.seq, _ = _read_symbols(data, at, n_seq, bits)
        self._flat: np.ndarray | None = None

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The expansions of all symbols on end, where each begins, and its length; a rule refers to earlier ones only."""
        if self._flat is None:
            self._length = np.r_[np.ones(self.first, np.int64), self.sizes]
            self._start = np.cumsum(self._length) - self._length
            self._flat = np.empty(self.first + int(self.sizes.sum()), np.uint32)
            self._flat[: self.first] = np.arange(self.first, dtype=np.uint32)
            done = 0
            while done < len(self.rules):
                ready = (self.rules[done:] < self.first + done).all(axis=1)
                upto = len(self.rules) if ready.all() else done + int(np.argmin(ready))
                at = int(self._start[self.first + done]) if done < len(self.rules) else 0
                new = self._gathered(self.rules[done:upto].reshape(-1))
                self._flat[at : at + len(new)] = new
                done = upto
        return self._flat, self._start, self._length

    def _gathered(self, symbols: np.ndarray) -> np.ndarray:
        n = self._length[symbols]
        ends = np.cumsum(n)
        return self._flat[np.repeat(self._start[symbols] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        self._table()
        return self._gathered(symbols)

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """ids start to stop of document i; only the symbols that cover them are expanded."""
        seq = self.seq[self.seq_at[i] : self.seq_at[i + 1]].astype(np.int64)
        stop = int(self.id_at[i + 1] - self.id_at[i]) if stop is None else stop
        size = np.ones(len(seq), np.int64)
        nt = seq >= self.first
        size[nt] = self.sizes[seq[nt] - self.first]
        ends = np.cumsum(size)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skip = start - int(ends[a] - size[a]) if a < len(seq) else 0
        return self._expand(seq[a:b])[skip : skip + max(0, stop - start)]

    def all_ids(self) -> np.ndarray:
        return self._expand(self.seq)
