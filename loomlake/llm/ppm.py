"""The numpy side of language-model scoring by partial matching: grams of bytes, and their code lengths.

A gram is one long: a symbol in the lowest byte, and above it the DEPTH bytes before it, the nearest one
highest. Sorted grams are a trie, in which a context of n bytes is a range of longs with equal high bytes.
Bytes that UTF-8 never has stand for the beginning (BEGIN) and the end (END) of a text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Bytes of context; a gram has to stay below 2**63.
DEPTH = 5
BEGIN, END = 0xFE, 0xFF
#: Symbols that can follow a context: all bytes but BEGIN.
SYMBOLS = 255
#: Positions that are packed at once, and the size (as a power of two) of the table in which they meet.
PIECE, SLOTS = 1 << 20, 21
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: bytes) -> bytes:
    """A text as it is scored: A-Z in lower case, words joined by one space."""
    return b" ".join(text.lower().split())


def packed(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The grams of every byte of plain texts and of their ends, some at a time: grams, which texts they are of, and where each of these begins."""
    group: list[bytes] = []
    who: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = np.frombuffer(b"".join(group), np.uint8)
        use = np.arange(len(s)) >= DEPTH
        ends = np.cumsum([len(g) for g in group])
        begins = np.append(0, ends[:-1])
        for k in range(DEPTH):
            use[begins + k] = False  # what stands before a piece is context only
        keys = pack(s)[use[DEPTH:]]
        return keys, np.array(who), begins - DEPTH * np.arange(len(group))

    for i, text in enumerate(texts):
        whole = b"%b%b%b" % (bytes([BEGIN]) * DEPTH, text, bytes([END]))
        for at in range(DEPTH, len(whole), PIECE):
            group.append(whole[at - DEPTH : at + PIECE])
            who.append(i)
            size += len(group[-1])
            if size >= PIECE:
                yield flush()
                group, who, size = [], [], 0
    if group:
        yield flush()


class Tally:
    """Counts grams; most are met in a table of slots, the rest is sorted now and then."""

    def __init__(self) -> None:
        self.keys = np.zeros(1 << SLOTS, np.uint64)
        self.used = np.zeros(1 << SLOTS, bool)
        self.n = np.zeros(1 << SLOTS, np.int64)
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, weight: int) -> None:
        at = slots(keys)
        new = ~self.used[at]
        self.keys[at[new]] = keys[new]
        self.used[at[new]] = True
        met = self.keys[at] == keys
        if weight:
            self.n += np.bincount(at[met], minlength=1 << SLOTS) * weight
        left = keys[~met]
        self.rest.append((left, np.full(len(left), weight, np.int64)))
        self.size += len(left)
        if self.size > 8 * PIECE:
            self.rest = [self._rest()]
            self.size = 0

    def _rest(self) -> tuple[np.ndarray, np.ndarray]:
        return counted(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in self.rest)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in self.rest)]))

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams and their counts."""
        keys, n = self._rest()
        return np.append(self.keys[self.used], keys), np.append(self.n[self.used], n)


class Lookup:
    """Values of grams that are all known."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        self.at = np.zeros(1 << int(64 - self.shift), np.int32)
        self.at[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.intp)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.at[self._slot(keys)]
        wrong = np.flatnonzero(self.keys[at] != keys)
        at[wrong] = np.searchsorted(self.keys, keys[wrong])
        return self.values[at]


def pack(s: np.ndarray) -> np.ndarray:
    """The gram of each symbol of s but the first DEPTH ones."""
    wide = s.astype(np.uint64)
    n = len(s) - DEPTH
    out = wide[DEPTH:].copy()  # DEPTH + 1 bytes at most, so below 2**63
    for j in range(1, DEPTH + 1):
        out |= wide[DEPTH - j : DEPTH - j + n] << np.uint64(8 * (DEPTH - j + 1))
    return out


def slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * _MIX) >> np.uint64(64 - SLOTS)).astype(np.intp)


def counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their n."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.intp)
    return k[starts], np.add.reduceat(n[order], starts) if len(k) else n


def prefix(keys: np.ndarray, order: int) -> np.ndarray:
    """The context of `order` bytes of each gram, as a number."""
    return keys >> np.uint64(8 * (DEPTH + 1 - order)) if order else np.zeros(len(keys), np.uint64)


def nodes(keys: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (context of `order` bytes, symbol) pairs of grams as sorted longs, and their counts."""
    return counted((prefix(keys, order) << np.uint64(8)) | (keys & np.uint64(0xFF)), n)


def _sums(owner: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(owner, weights=x, minlength=size)


def code_lengths(keys: np.ndarray, n: np.ndarray, given: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """log10 of each gram's probability; keys: distinct grams in order; n: their counts in training.

    Symbols are coded in the longest context in which training has them. A context that has not got the
    symbol costs an escape: its share of distinct symbols, q / (t + q), where the symbols of longer
    contexts are excluded from q and t. As what a context was followed by also follows its shorter
    contexts, the symbols to exclude are those of the next longer context. What no context has is one of
    the symbols that are left, all alike.

    given: for each order, the whole (pair, count) table of contexts of which keys are only a part.
    """
    m = len(keys)
    logp, open_ = np.zeros(m), np.ones(m, bool)
    below = None  # of the next longer contexts: (their pairs with a count, the distinct contexts, each row's context)
    for order in range(DEPTH, -1, -1):
        pairs, counts = nodes(keys, n, order)
        if given and order in given and len(given[order][0]):
            own, more = given[order]
            partial = np.isin(pairs >> np.uint64(8), own >> np.uint64(8))
            counts = np.where(partial, 0, counts)
            pairs, counts = counted(np.append(pairs, own), np.append(counts, more))
        contexts, owner = np.unique(pairs >> np.uint64(8), return_inverse=True)
        seen = counts > 0
        total = _sums(owner, counts, len(contexts))
        kinds = _sums(owner, seen, len(contexts))
        mine = np.searchsorted(contexts, prefix(keys, order))
        t, q = total[mine], kinds[mine]
        if below is not None:
            longer, longer_contexts, longer_mine = below
            who = np.searchsorted(longer_contexts, longer >> np.uint64(8))
            shorter = (longer_contexts >> np.uint64(8))[who]  # the farthest byte goes
            at = np.searchsorted(pairs, (shorter << np.uint64(8)) | (longer & np.uint64(0xFF)))
            excluded = _sums(who, counts[at], len(longer_contexts))
            gone = _sums(who, np.ones(len(who)), len(longer_contexts))
            t, q = t - excluded[longer_mine], q - gone[longer_mine]
        c = counts[np.searchsorted(pairs, (prefix(keys, order) << np.uint64(8)) | (keys & np.uint64(0xFF)))]
        found = open_ & (c > 0)
        logp[found] += np.log10(c[found] / (t + q)[found])
        open_ &= ~found
        escape = open_ & (q > 0)
        logp[escape] += np.log10((q / np.maximum(t + q, 1))[escape])
        below = (pairs[seen], contexts, mine)
    if open_.any():
        logp[open_] -= math.log10(max(1, SYMBOLS - int(kinds.sum())))
    return logp
