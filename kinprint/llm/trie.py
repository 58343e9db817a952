"""Self-join of bit strings by Hamming distance: a binary trie is walked against itself.

A node of the trie is a range of the sorted array, so the trie needs no pointers. The walk
holds pairs of nodes that lie at one depth, with the bits in which their prefixes differ;
children of a pair are paired again and a pair goes as soon as it has more differing bits
than the budget allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Node pairs that are walked at once; more wait their turn, so memory is bounded.
FRONTIER = 1 << 16
#: A node pair with at most this many leaf pairs is compared leaf by leaf.
LEAVES = 128
#: Leaf pairs that are compared at once.
BATCH = 1 << 17


def _split(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """In each sorted range whose higher bits agree, where the rows with ``bit`` set begin."""
    a, b = lo.copy(), hi.copy()
    while (open_ := a < b).any():
        mid = (a + b) >> 1
        one = (words[np.minimum(mid, len(words) - 1)] & bit) != 0
        b = np.where(open_ & one, mid, b)
        a = np.where(open_ & ~one, mid + 1, a)
    return a


def self_join(
    words: np.ndarray, bits: int, budget: int, skip: int = 0, begins: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of index pairs (i < j) of ``words`` that differ in ``budget`` bits at most.

    ``bits``: the width in use, counted from the lowest. ``skip``: pairs must agree in that
    many leading bits. ``begins``: where tries begin, if ``words`` holds several one after
    another; they are walked together, each against itself. In a trie words are distinct and sorted.
    """
    n = len(words)
    if n < 2:
        return
    lo = np.array([0]) if begins is None else np.asarray(begins)
    lo, hi = lo.astype(np.int64), np.r_[lo[1:], n].astype(np.int64)
    more = hi - lo > 1
    lo, hi = lo[more], hi[more]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            for part in (slice(half, None), slice(None, half)):
                stack.append((depth, alo[part], ahi[part], blo[part], bhi[part], err[part]))
            continue
        small = (ahi - alo) * (bhi - blo) <= LEAVES
        if depth >= bits:
            small[:] = True
        if small.any():
            yield from _leaves(words, alo[small], ahi[small], blo[small], bhi[small], budget, bits, skip)
            big = ~small
            alo, ahi, blo, bhi, err = alo[big], ahi[big], blo[big], bhi[big], err[big]
        if not len(alo):
            continue
        bit = np.uint64(1 << (bits - 1 - depth))
        am, bm = _split(words, alo, ahi, bit), _split(words, blo, bhi, bit)
        same = (alo == blo) & (ahi == bhi)
        cost = err + 1
        halves = [
            (alo, am, blo, bm, err, np.ones(len(alo), bool)),
            (am, ahi, bm, bhi, err, np.ones(len(alo), bool)),
        ]
        if depth >= skip:
            halves.append((alo, am, bm, bhi, cost, cost <= budget))
            halves.append((am, ahi, blo, bm, cost, (cost <= budget) & ~same))
        parts = []
        for a0, a1, b0, b1, e, ok in halves:
            ok = ok & (a1 > a0) & (b1 > b0)
            ok &= ~((a0 == b0) & (a1 - a0 == 1) & (b1 - b0 == 1))
            parts.append((a0[ok], a1[ok], b0[ok], b1[ok], e[ok]))
        following = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(following[0]):
            stack.append((depth + 1, *following))


def _leaves(words, alo, ahi, blo, bhi, budget, bits, skip):
    na, nb = ahi - alo, bhi - blo
    total = na * nb
    ends = np.cumsum(total)
    start = 0
    while start < len(total):
        # As many node pairs as fit a batch, and one at least.
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + BATCH, "right")))
        t = total[start:stop]
        k = np.repeat(np.arange(start, stop), t)
        off = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
        i, j = alo[k] + off // nb[k], blo[k] + off % nb[k]
        x = words[i] ^ words[j]
        ok = (np.bitwise_count(x) <= budget) & (i != j)
        if skip:
            ok &= (x >> np.uint64(bits - skip)) == 0
        i, j = i[ok], j[ok]
        # A node paired with itself gives a pair twice.
        once = (i < j) | (alo[k[ok]] != blo[k[ok]])
        i, j = i[once], j[once]
        if len(i):
            yield np.minimum(i, j), np.maximum(i, j)
        start = stop


def rotate(words: np.ndarray, by: int, bits: int) -> np.ndarray:
    """``words`` with their ``bits`` bits turned left by ``by``."""
    if by % bits == 0:
        return words
    mask = np.uint64((1 << bits) - 1) if bits < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    return ((words << np.uint64(by)) | (words >> np.uint64(bits - by))) & mask


def cuts(bits: int, budget: int) -> list[tuple[int, int]]:
    """budget + 1 blocks (start, width) that cover the bits.

    Two strings with ``budget`` differing bits agree in one block at least, so a walk that
    starts at each block in turn, with that block equal, finds every pair.
    """
    edges = [round(k * bits / (budget + 1)) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
