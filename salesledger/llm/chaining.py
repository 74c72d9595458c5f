"""Collinear chains of word matches between two texts, and their alignment."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

GAP_COST = 0.25
"""Cost of each word that a chain steps over, in either text."""

Segment = tuple[int, int, int]
"""First matched word in the one text, in the other, and length."""


class Fenwick:
    """Best value among the ranks up to one, with the item that has it."""

    def __init__(self, n: int) -> None:
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, rank: int, value: float, item: int) -> None:
        while rank < len(self.best):
            if value > self.best[rank][0]:
                self.best[rank] = (value, item)
            rank += rank & -rank

    def up_to(self, rank: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while rank:
            if self.best[rank][0] > found[0]:
                found = self.best[rank]
            rank -= rank & -rank
        return found


def segments(p: np.ndarray, q: np.ndarray, k: int, reach: int) -> list[Segment]:
    """Matches of k words at p and q, joined along a diagonal where the next begins within ``reach`` words."""
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    cut = np.flatnonzero((np.diff(p - q) != 0) | (np.diff(p) > reach)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(p)]]) - 1
    found = np.stack([p[first], q[first], p[last] - p[first] + k], axis=1)
    return sorted(map(tuple, found.tolist()))


def chains(found: list[Segment]) -> list[list[Segment]]:
    """Segments parted into chains that ascend in both texts, each the best of what the better ones left.

    The best chain that ends in a segment takes, among the earlier ones, the largest score less the words stepped over.
    As that cost is linear in the positions, it is one prefix maximum over the second text's positions, in a Fenwick tree;
    segments enter the tree as the sweep over the first text passes the start of their last matched word.
    """
    ranks = sorted({q + n for _, q, n in found})
    tree = Fenwick(len(ranks))
    score: list[float] = []
    back: list[int] = []
    ends = sorted(range(len(found)), key=lambda i: found[i][0] + found[i][2])
    entered = 0
    for i, (p, q, n) in enumerate(found):
        while found[ends[entered]][0] + found[ends[entered]][2] <= p:
            j = ends[entered]
            end_p, end_q = found[j][0] + found[j][2], found[j][1] + found[j][2]
            tree.put(bisect_right(ranks, end_q), score[j] + GAP_COST * (end_p + end_q), j)
            entered += 1
        value, j = tree.up_to(bisect_right(ranks, q))
        gain = value - GAP_COST * (p + q)
        score.append(n + max(gain, 0.0))
        back.append(j if gain > 0 else -1)
    taken = [False] * len(found)
    out = []
    for i in sorted(range(len(found)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not taken[i]:
            taken[i] = True
            chain.append(found[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def trimmed(found: list[Segment]) -> list[Segment]:
    """Segments of one pair with overlaps along the sweep cut off the later one, so that they can follow each other."""
    out: list[Segment] = []
    for p, q, n in found:
        if out:
            last_p, last_q, last_n = out[-1]
            over = max(last_p + last_n - p, last_q + last_n - q)
            near = abs((p - q) - (last_p - last_q)) <= 8
            if 0 < over < n and near and p > last_p and q > last_q:
                p, q, n = p + over, q + over, n - over
        out.append((p, q, n))
    return sorted(out)


def aligned(d: np.ndarray, a: np.ndarray, k: int, most_gap: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, end, other start, other end, matched words) of ``d`` that align with ``a``.

    Dense matches of k words are chained, each segment grows by equal words, short gaps count their longest
    common subsequence. A passage ends where more than ``most_gap`` words in a row stay unmatched.
    """
    from salesledger.llm.hashing import windows

    left, right = windows(d, k), windows(a, k)
    if not len(left) or not len(right):
        return []
    # A match is anchored where it is unique in the other text; repeats are reached by growing.
    values, at, counts = np.unique(right, return_index=True, return_counts=True)
    slot = np.minimum(np.searchsorted(values, left), len(values) - 1)
    hit = (values[slot] == left) & (counts[slot] == 1)
    p = np.flatnonzero(hit)
    if not len(p):
        p = np.flatnonzero(values[slot] == left)
    if not len(p):
        return []
    passages = []
    for chain in chains(trimmed(segments(p, at[slot[p]], k, 1))):
        grown = _grown(d, a, chain)
        run = [*grown[0][:2], grown[0][2], grown[0][0] + grown[0][2], grown[0][1] + grown[0][2]]
        for p0, q0, n in grown[1:]:
            gap_d, gap_a = d[run[3] : p0], a[run[4] : q0]
            if max(len(gap_d), len(gap_a)) > most_gap:
                passages.append(run)
                run = [p0, q0, n, p0 + n, q0 + n]
            else:
                run[2:] = [run[2] + n + _common(gap_d, gap_a), p0 + n, q0 + n]
        passages.append(run)
    return [
        (start, end, other, other_end, matched)
        for start, other, matched, end, other_end in passages
        if matched >= identity * max(end - start, other_end - other)
    ]


def _grown(d: np.ndarray, a: np.ndarray, chain: list[Segment]) -> list[Segment]:
    """Segments of a chain, each extended over equal words as far as its neighbours allow."""
    out: list[Segment] = []
    for i, (p, q, n) in enumerate(chain):
        low_p, low_q = (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) if out else (0, 0)
        high_p, high_q = chain[i + 1][:2] if i + 1 < len(chain) else (len(d), len(a))
        back = min(p - low_p, q - low_q)
        if back > 0:
            differ = np.flatnonzero(d[p - back : p][::-1] != a[q - back : q][::-1])
            back = int(differ[0]) if len(differ) else back
            p, q, n = p - back, q - back, n + back
        ahead = min(high_p - p - n, high_q - q - n)
        if ahead > 0:
            differ = np.flatnonzero(d[p + n : p + n + ahead] != a[q + n : q + n + ahead])
            n += int(differ[0]) if len(differ) else ahead
        out.append((p, q, n))
    return out


def _common(d: np.ndarray, a: np.ndarray) -> int:
    """Length of the longest common subsequence of two short runs of words."""
    if not len(d) or not len(a):
        return 0
    row = [0] * (len(a) + 1)
    other = a.tolist()
    for word in d.tolist():
        diagonal = 0
        for j, x in enumerate(other, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == word else max(row[j], row[j - 1])
    return row[-1]
