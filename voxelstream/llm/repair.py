"""Re-Pair grammar compression of a stream of token ids, and its random-access reader.

In each round the most frequent pairs of neighbouring symbols get a nonterminal each and are replaced where they
do not overlap; rounds go on until no pair is frequent. A pair is frequent if it occurs LEAST times, from where its
rule takes less room than it saves. A shard keeps the rules, how many ids each expands to, the rest of the stream,
and the expanded place of every BLOCK-th symbol, so that a run of ids is decoded without the ids before it.

Layout of a shard, little-endian: the magic bytes, seven uint64 (base, documents, ids, rules, symbols, marks,
bytes a symbol), then int64 doc ids, uint8 null flags of those, uint64 ids of each document, uint32 left and
right symbols and uint64 lengths of the rules, uint64 marks, and the symbols: their low 16 bits, then, where a
symbol has three bytes, their high 8 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .tokenizing import gathered

MAGIC = b"VXRP0002"
PAIRS = 8192  # rules of a round, at most
LEAST = 6  # times a pair must occur to get a rule
BLOCK = 512  # symbols between marks
TABLE_BITS = 18  # binary digits of the slots of hashed pairs


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - TABLE_BITS)


def _frequent(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of candidates, their slots, their pairs, the most frequent pairs in order of their numbers).

    Counts of slots are never below those of their pairs, so they rule most places out before pairs are sorted.
    """
    slots = _slots(symbols[:-1], symbols[1:])
    counts = np.bincount(slots, minlength=1 << TABLE_BITS)
    often = counts[counts >= LEAST]
    least = np.partition(often, -PAIRS)[-PAIRS] if len(often) > PAIRS else LEAST
    places = np.flatnonzero((counts >= least)[slots])
    keys = symbols[places].astype(np.uint64) << np.uint64(32) | symbols[places + 1]
    pairs, n = np.unique(keys, return_counts=True)
    pairs, n = pairs[n >= LEAST], n[n >= LEAST]
    if len(pairs) > PAIRS:
        pairs = np.sort(pairs[np.lexsort((pairs, -n))[:PAIRS]])
    return places, slots[places], keys, pairs


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules as rows of left and right, ids that each rule expands to); rule k is the symbol base + k."""
    symbols, rules, n_rules = ids.astype(np.uint32), [], 0
    while len(symbols) > 1:
        places, slots, keys, chosen = _frequent(symbols)
        if not len(chosen):
            break
        # Of pairs that share a slot of the table one is left to the next round.
        table = np.full(1 << TABLE_BITS, -1, np.int32)
        left, right = (chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32)
        table[_slots(left, right)] = np.arange(len(chosen))
        at = table[slots]
        real = (at >= 0) & (chosen[at] == keys)
        places, at = places[real], at[real]
        # Of overlapping places, every second one of a run is replaced.
        starts = np.concatenate([[True], np.diff(places) > 1])
        run = np.maximum.accumulate(np.where(starts, places, 0))
        second = (places - run) % 2 == 1
        places, at = places[~second], at[~second]
        # A pair that lost all its places to its neighbours gets no rule.
        used = np.bincount(at, minlength=len(chosen)) > 0
        symbols[places] = base + n_rules + (np.cumsum(used) - 1)[at]
        kept = np.ones(len(symbols), bool)
        kept[places + 1] = False
        symbols = symbols[kept]
        rules.append(np.stack([left[used], right[used]], axis=1).astype(np.int64))
        n_rules += len(rules[-1])
    grammar = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    lengths, done = np.zeros(len(grammar), np.int64), 0
    for part in rules:  # a rule only uses symbols of earlier rounds
        sizes = np.where(part < base, 1, lengths[np.maximum(part - base, 0)]).sum(axis=1)
        lengths[done : done + len(part)] = sizes
        done += len(part)
    return symbols.astype(np.int64), grammar, lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of a run of symbols."""
    symbols = symbols.astype(np.int64)
    while len(symbols) and (rule := symbols >= base).any():
        out = np.repeat(symbols, np.where(rule, 2, 1))
        at = np.flatnonzero(rule) + np.arange(int(rule.sum()))  # where the left symbol of each rule goes
        out[at], out[at + 1] = rules[symbols[rule] - base].T
        symbols = out
    return symbols


def pack(doc_ids: list[int | None], document_ids: list[np.ndarray], base: int) -> bytes:
    """The bytes of a shard of whole documents, in the given order."""
    ids = np.concatenate(document_ids) if document_ids else np.zeros(0, np.int64)
    symbols, rules, lengths = compress(ids, base)
    size = 2 if base + len(rules) <= 2**16 else 3
    if base + len(rules) > 2**24:
        raise ValueError("a shard has too many symbols")
    sizes = np.where(symbols < base, 1, lengths[np.maximum(symbols - base, 0)] if len(lengths) else 1)
    marks = (np.cumsum(sizes) - sizes)[::BLOCK]
    header = np.array([base, len(doc_ids), len(ids), len(rules), len(symbols), len(marks), size], "<u8")
    parts = [
        header, np.array([0 if d is None else d for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"),
        np.array([len(x) for x in document_ids], "<u8"), rules[:, 0].astype("<u4"), rules[:, 1].astype("<u4"), lengths.astype("<u8"), marks.astype("<u8"),
        (symbols & 0xFFFF).astype("<u2"), *([(symbols >> 16).astype("u1")] if size == 3 else []),
    ]
    return MAGIC + b"".join(p.tobytes() for p in parts)


@dataclass
class Shard:
    base: int
    doc_ids: list[int | None]
    sizes: np.ndarray  # ids of each document
    rules: np.ndarray
    lengths: np.ndarray
    marks: np.ndarray
    symbols: np.ndarray

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        at = len(MAGIC)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        base, docs, _, rules, symbols, marks, size = map(int, take("<u8", 7))
        ids, nulls, sizes = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
        left, right, lengths, marks_at = take("<u4", rules), take("<u4", rules), take("<u8", rules), take("<u8", marks)
        stream = take("<u2", symbols).astype(np.int32)
        if size == 3:
            stream |= take("u1", symbols).astype(np.int32) << 16
        return cls(base, [None if n else int(d) for d, n in zip(ids, nulls, strict=True)], sizes, np.stack([left, right], axis=1).astype(np.int64), lengths.astype(np.int64), marks_at.astype(np.int64), stream)

    def read(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the expanded place ``start``; only the blocks that hold them are expanded."""
        if n <= 0:
            return np.zeros(0, np.int64)
        first = int(np.searchsorted(self.marks, start, "right")) - 1
        last = int(np.searchsorted(self.marks, start + n, "left"))
        ids = expand(self.symbols[first * BLOCK : last * BLOCK], self.rules, self.base)
        skip = start - int(self.marks[first])
        return ids[skip : skip + n]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.sizes[:k].sum()), int(self.sizes[k]))

    def all_ids(self) -> np.ndarray:
        """All ids: every rule is expanded once, and the symbols gather what they stand for."""
        used, place = np.unique(self.symbols, return_inverse=True)
        sizes = np.where(used < self.base, 1, self.lengths[np.maximum(used - self.base, 0)] if len(self.lengths) else 1)
        return gathered(expand(used, self.rules, self.base), sizes, place)
