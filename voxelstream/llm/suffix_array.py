"""Suffix arrays by induced sorting, and permuted longest common prefixes, on whole numpy arrays.

Positions are typed by whether their suffix is smaller (S) or larger (L) than the next. The leftmost S positions
(LMS) are sorted by induction, their substrings named, and the string of names is sorted recursively; the array
then follows by inducing L suffixes from the left and S suffixes from the right, bucket by bucket. Each bucket is
taken in whole blocks instead of one suffix at a time. Where the names outnumber BUCKETS, blocks would be too small
to pay, and the string of names is sorted by doubling ranks instead.
"""

from __future__ import annotations

import numpy as np

DIRECT = 512  # strings up to this length are sorted directly
BUCKETS = 4096  # most names that the string of names is sorted with by induction


def _scatter(array: np.ndarray, found: np.ndarray, symbols: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Put ``found`` into the buckets of ``symbols`` in order, moving the bucket edges by ``step`` a place."""
    if len(found) == 1:
        c = symbols[0]
        if step < 0:
            edge[c] -= 1
            array[edge[c]] = found[0]
        else:
            array[edge[c]] = found[0]
            edge[c] += 1
        return
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    firsts = np.flatnonzero(np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]]))
    counts = np.diff(np.append(firsts, len(order)))
    rank = np.arange(len(order)) - np.repeat(firsts, counts)
    if step < 0:
        array[edge[sorted_symbols] - 1 - rank] = found[order]
        edge[sorted_symbols[firsts]] -= counts
    else:
        array[edge[sorted_symbols] + rank] = found[order]
        edge[sorted_symbols[firsts]] += counts


def _induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All suffixes from the order of ``seeds`` (LMS positions)."""
    n, ends = len(text), np.cumsum(counts)
    starts = ends - counts
    array = np.full(n, -1, np.int32)
    tails = ends.copy()
    _scatter(array, seeds[::-1], text[seeds[::-1]], tails, -1)
    heads, present = starts.copy(), np.flatnonzero(counts)

    def before(block: np.ndarray, want_s: bool) -> np.ndarray:
        p = block[block > 0] - 1
        return p[is_s[p] == want_s]

    for c in present:
        at = starts[c]
        while at < heads[c]:
            block, at = array[at : heads[c]], heads[c]
            p = before(block, False)
            if len(p):
                _scatter(array, p, text[p], heads, 1)
        if tails[c] < ends[c]:
            p = before(array[tails[c] : ends[c]], False)
            if len(p):
                _scatter(array, p, text[p], heads, 1)
    tails = ends.copy()
    for c in present[::-1]:
        at = ends[c]
        while at > tails[c]:
            block, at = array[tails[c] : at][::-1], tails[c]
            p = before(block, True)
            if len(p):
                _scatter(array, p, text[p], tails, -1)
        if heads[c] > starts[c]:
            p = before(array[starts[c] : heads[c]][::-1], True)
            if len(p):
                _scatter(array, p, text[p], tails, -1)
    return array


def _named(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings, in text order, given their sorted ``order``; and how many there are."""
    length = np.zeros(len(text), np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = order[:-1], order[1:]
    differs = length[a] != length[b]
    active, k = np.flatnonzero(~differs), 0
    while len(active):
        active = active[k < length[a[active]]]
        unequal = text[a[active] + k] != text[b[active] + k]
        differs[active[unequal]] = True
        active, k = active[~unequal], k + 1
    name = np.zeros(len(text), np.int64)
    name[order] = np.concatenate([[0], np.cumsum(differs)])
    return name[lms], int(differs.sum()) + 1


def _by_names(names: np.ndarray, n_names: int) -> np.ndarray:
    """Order of the suffixes of a string of names (the last name is the least and occurs once)."""
    if n_names == len(names):
        return np.argsort(names)
    return suffix_array(names, n_names) if n_names <= BUCKETS else _direct(names)


def _direct(text: np.ndarray) -> np.ndarray:
    """Suffixes by doubling ranks."""
    rank, n, k = text.astype(np.int64), len(text), 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: max(n - k, 0)] += rank[k:] + 1
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array of ``text`` (numbers below ``alphabet``), whose last symbol is the least and occurs once."""
    n = len(text)
    if n <= DIRECT:
        return _direct(text)
    text = text.astype(np.int32)
    step = np.sign(text[1:] - text[:-1])
    # The type of a position is that of the next change; the last position is S.
    change = np.where(step != 0, np.arange(n - 1), n - 1)
    change = np.minimum.accumulate(change[::-1])[::-1]
    is_s = np.append(np.append(step, 1)[change] > 0, True)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    counts = np.bincount(text, minlength=alphabet)
    first = _induce(text, is_s, lms, counts)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    names, n_names = _named(text, lms, first[is_lms[first]])
    return _induce(text, is_s, lms[_by_names(names, n_names)], counts)


def permuted_lcp(text: np.ndarray, array: np.ndarray, stop: int) -> np.ndarray:
    """For each position, the common prefix of its suffix and the one before it in ``array``.

    A prefix ends before a symbol of at most ``stop``. Where both suffixes are preceded by the same symbol, the
    value is one less than the one before (reducible); only the others are compared.
    """
    n = len(text)
    previous = np.empty(n, np.int64)
    previous[array[1:]] = array[:-1]
    previous[array[0]] = -1
    at = np.arange(n)
    reducible = (previous > 0) & (at > 0)
    reducible[1:] &= (text[:-1] == text[np.maximum(previous[1:] - 1, 0)]) & (text[:-1] > stop)
    plcp = np.zeros(n, np.int64)
    active, k = np.flatnonzero(~reducible & (previous >= 0)), 0
    while len(active):
        a, b = active + k, previous[active] + k
        inside = (a < n) & (b < n)
        active, a, b = active[inside], a[inside], b[inside]
        same = (text[a] == text[b]) & (text[a] > stop)
        active = active[same]
        k += 1
        plcp[active] = k
    base = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.where(reducible, plcp[base] - (at - base), plcp)


def repeated_windows(segments: list[bytes], owner: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``size`` bytes that also occur earlier, as (segment, offset) in that order.

    ``owner`` and ``place`` tell where a segment begins; the window of least (owner, place) is the first.
    """
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    joined = np.frombuffer(b"\x00".join(segments) + b"\x00\x00", np.uint8).astype(np.int32) + 2
    ends = np.cumsum(lengths + 1) - 1
    joined[ends] = 1  # between segments
    joined[-1] = 0
    array = suffix_array(joined, 258)
    lcp = permuted_lcp(joined, array, 1)[array]
    segment = np.repeat(np.arange(len(segments)), lengths + 1)
    segment = np.append(segment, len(segments) - 1)
    offset = np.arange(len(joined)) - np.append(0, ends[:-1] + 1)[segment]
    valid = offset <= lengths[segment] - size
    valid[-1] = False
    # Runs of suffixes that share their first ``size`` bytes.
    run = np.cumsum(~((lcp >= size) & valid[array]))
    members = np.flatnonzero(valid[array])
    positions, run = array[members], run[members]
    keep = np.bincount(run)[run] > 1
    positions, run = positions[keep], run[keep]
    if not len(positions):
        return positions, positions
    order = np.lexsort((place[segment[positions]] + offset[positions], owner[segment[positions]], run))
    positions, run = positions[order], run[order]
    later = np.concatenate([[False], run[1:] == run[:-1]])
    # The same place can be met in two segments; it is not earlier than itself.
    own, at = owner[segment[positions]], place[segment[positions]] + offset[positions]
    starts = np.flatnonzero(~later)
    first = np.repeat(starts, np.diff(np.append(starts, len(run))))
    later = (own != own[first]) | (at != at[first])
    found = np.sort(positions[later])
    return segment[found], offset[found]
