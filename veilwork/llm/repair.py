"""Re-Pair grammar compression of token ids, one grammar per block, with random-access decoding.

Each round counts the pairs of adjacent symbols in a block, gives frequent ones a new symbol (a
nonterminal) each and replaces their occurrences from left to right without overlap. Rounds repeat until
no pair pays: a rule costs three symbols (its pair and its length), so a pair that can be replaced fewer
than `least` = 4 times saves nothing. Pairs never cross the end of a document, so each document is a run
of symbols. A block stores its rules, each nonterminal's expansion length, the symbols, and for each
document its id, token count and symbol count; prefix sums over expansion lengths find any token
without decoding what stands before it.

Many pairs are replaced in a round (instead of one), those that are at least a tenth as frequent as the
50th, so that a round is a few vector operations. Only open places are looked at again: a pair that was counted
fewer than `least` times cannot become more frequent, so after a round those next to a new symbol are open, and
those of frequent pairs that were not replaced. Many open places are counted in hashed slots, where of two pairs
in one slot one stays open for the next round; few are counted by sorting.

Block layout, little-endian: magic `GRB2`; six uint32 (documents, first nonterminal, rules, symbols, bits a
symbol, bytes a length: 2 or 4); uint64 tokens; int64 doc ids; uint8 null flags of doc ids; uint32 tokens and
uint32 symbols of each document; rules as symbol pairs; expansion lengths; symbols. Symbols are written as
their low 16 bits, then a bit plane for each bit above.

Defined cases: an empty block has no rules and no symbols; documents without ids have no symbols; doc ids
may be null or repeat.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from .textkernel import gather

MAGIC = b"GRB2"
HEAD = struct.Struct("<4s6IQ")
SLOTS = 1 << 18
_SPREAD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Open places that are counted by sorting, at most.
FEW = 1 << 16


def _counted(keys: np.ndarray, turn: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, their counts, the number of the pair at each place, -1 if it was not counted)."""
    if exact:
        names, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return names, counts, number
    number = (keys * np.uint64(_SPREAD[turn % 4]) >> np.uint64(46)).astype(np.int32)
    names = np.zeros(SLOTS, np.uint64)
    names[number] = keys
    number[names[number] != keys] = -1
    return names, np.bincount(number[number >= 0], minlength=SLOTS), number


def compress(ids: np.ndarray, ends: np.ndarray, first: int, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules as symbol pairs, symbols, symbol count of each document) of ids whose documents end at `ends`.

    first: the first nonterminal, above every id.
    """
    x = ids.astype(np.uint32)  # a copy
    last = np.zeros(len(x), bool)
    last[ends[ends > 0] - 1] = True
    open_ = ~last  # places whose pair with the next symbol may be frequent
    rules, turn, exact, every = np.zeros((0, 2), np.uint32), 0, False, False
    while len(at := np.flatnonzero(open_)):
        exact = exact or len(at) <= FEW
        names, counts, number = _counted((x[at].astype(np.uint64) << np.uint64(32)) | x[at + 1], turn, exact)
        turn += 1
        often = np.partition(counts, -50)[-50] // 10 if len(counts) > 50 and not every else 0
        good = np.flatnonzero(counts >= max(least, often))
        rule_of = np.full(len(names) + 1, -1, np.int32)  # the last entry is for places that were not counted
        rule_of[good] = np.arange(len(good))
        rule = rule_of[number]
        chosen = rule >= 0
        place, rule = at[chosen], rule[chosen]
        fresh = np.ones(len(place), bool)
        fresh[1:] = place[1:] != place[:-1] + 1
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
        odd = (np.arange(len(place)) - run) & 1
        place, rule = place[odd == 0], rule[odd == 0]
        pays = np.bincount(rule, minlength=len(good)) >= least
        if not pays.any():
            if every:
                break
            exact = every = True  # once more: all pairs, counted exactly
            continue
        place, rule = place[pays[rule]], rule[pays[rule]]
        open_[at] = np.append(counts >= least, True)[number]
        x[place] = (first + len(rules) + (np.cumsum(pays) - 1)[rule]).astype(np.uint32)
        last[place] = last[place + 1]
        open_[np.maximum(place - 1, 0)] = open_[place] = True
        keep = np.ones(len(x), bool)
        keep[place + 1] = False
        x, last, open_ = x[keep], last[keep], open_[keep]
        open_ &= ~last
        pairs, exact, every = names[good[pays]], False, False
        rules = np.concatenate([rules, np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)])
    stops = np.flatnonzero(last) + 1
    sizes = np.zeros(len(ends), np.int64)
    sizes[np.diff(ends, prepend=0) > 0] = np.diff(stops, prepend=0)
    return rules, x, sizes


def _rounds(rules: np.ndarray, first: int) -> Iterator[tuple[int, int]]:
    """Stretches of rules that use only symbols from before the stretch."""
    begin = 0
    while begin < len(rules):
        end = begin + int(np.argmax(np.append((rules[begin:] >= first + begin).any(axis=1), True)))
        yield begin, end
        begin = end


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Expansion length of each nonterminal; a rule uses only earlier ones."""
    out = np.ones(len(rules), np.int64)
    for begin, end in _rounds(rules, first):
        part = rules[begin:end].astype(np.int64)
        below = np.where(part < first, 1, out[np.maximum(part - first, 0)])
        out[begin:end] = below.sum(axis=1)
    return out


def _put(symbols: np.ndarray, bits: int) -> bytes:
    planes = (np.packbits(symbols >> np.uint32(k) & np.uint32(1)).tobytes() for k in range(16, bits))
    return b"".join([(symbols & np.uint32(0xFFFF)).astype("<u2").tobytes(), *planes])


def pack(doc_ids: list, counts: np.ndarray, ids: np.ndarray, first: int) -> bytes:
    """A block of the documents' ids; counts: ids of each document; doc ids may be null."""
    rules, symbols, sizes = compress(ids, np.cumsum(counts), first)
    bits, long = max(16, int(first + len(rules)).bit_length()), lengths(rules, first)
    width = 4 if len(long) and long.max() >= 1 << 16 else 2
    head = HEAD.pack(MAGIC, len(doc_ids), first, len(rules), len(symbols), bits, width, len(ids))
    return b"".join([
        head,
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        counts.astype("<u4").tobytes(),
        sizes.astype("<u4").tobytes(),
        _put(rules.ravel(), bits),
        long.astype(f"<u{width}").tobytes(),
        _put(symbols, bits),
    ])


class Block:
    """A packed block, opened for decoding."""

    def __init__(self, raw: bytes) -> None:
        magic, docs, self.first, rules, symbols, bits, width, self.n_tokens = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = HEAD.size

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype, n, at)
            at += out.nbytes
            return out

        def take_symbols(n: int) -> np.ndarray:
            out = take("<u2", n).astype(np.int64)
            for k in range(16, bits):
                out |= np.unpackbits(take("u1", (n + 7) // 8), count=n).astype(np.int64) << k
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        self.counts, self.sizes = take("<u4", docs).astype(np.int64), take("<u4", docs).astype(np.int64)
        self.rules, self.lengths = take_symbols(2 * rules).reshape(-1, 2), take(f"<u{width}", rules).astype(np.int64)
        self.symbols = take_symbols(symbols)
        self._flat: np.ndarray | None = None
        self._begin = np.cumsum(self.lengths) - self.lengths

    def _expansions(self) -> np.ndarray:
        """The expansions of all nonterminals, one after another."""
        if self._flat is None:
            self._flat = np.zeros(int(self.lengths.sum()), np.uint32)
            for begin, end in _rounds(self.rules, self.first):
                found = self._spelled(self.rules[begin:end].ravel(), self._flat)
                self._flat[self._begin[begin] : self._begin[begin] + len(found)] = found
        return self._flat

    def _spelled(self, symbols: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """The ids of the symbols; flat holds the expansions of the nonterminals among them."""
        deep, n = symbols >= self.first, self._lengths_of(symbols)
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int64)
        out[at[~deep]] = symbols[~deep]
        spread = n[deep]
        into = np.repeat(at[deep] - (np.cumsum(spread) - spread), spread) + np.arange(int(spread.sum()))
        out[into] = gather(flat, self._begin[symbols[deep] - self.first], spread)
        return out

    def _lengths_of(self, symbols: np.ndarray) -> np.ndarray:
        deep = symbols >= self.first
        out = np.ones(len(symbols), np.int64)
        out[deep] = self.lengths[symbols[deep] - self.first]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self._spelled(symbols, self._expansions())

    def all(self) -> np.ndarray:
        return self.expand(self.symbols)

    def document(self, index: int) -> np.ndarray:
        """The ids of the block's index-th document, decoding nothing else."""
        begin = int(self.sizes[:index].sum())
        return self.expand(self.symbols[begin : begin + int(self.sizes[index])])

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """Ids begin..end of the block, decoding only the symbols that hold them."""
        begin, end = max(0, begin), min(end, self.n_tokens)
        if begin >= end:
            return np.zeros(0, np.int64)
        total = np.cumsum(self._lengths_of(self.symbols))
        a, b = int(np.searchsorted(total, begin, "right")), int(np.searchsorted(total, end, "left"))
        before = int(total[a - 1]) if a else 0
        return self.expand(self.symbols[a : b + 1])[begin - before : end - before]
