"""Passages that documents share, through compact windows of min-hashes.

A document is its sequence of shingles. The Cartesian tree of its hashes gives windows (l, c, r): every
subsequence within l..r that holds c has its least hash at c. Passages that are similar enough have a
run of shingles in common (of four, at a similarity of 0.8), and so the centre c of a window that long:
the centres of all such windows are kept, and those that no other document has tell where no similar
passage can be. What is left is looked at with all its shingles in the same way, and stretches alike in
all that others share are one class. Classes meet in the rarest shingles of their stretches, which similar
ones cannot all have for themselves, and are verified, pair by pair, in blocks.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .components import connected_components

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


#: Documents that pairs are of, up to which their ids are sent to all tasks: 8 bytes each.
BROADCAST_IDS = 4_000_000
#: A number for each byte, and those of white space.
_BYTES = np.random.Generator(np.random.PCG64(51)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


class Powers:
    """Powers of a multiplier modulo 2^64, as many as were asked for."""

    def __init__(self) -> None:
        self.known = np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            self.known = np.concatenate((self.known, self.known * self.known[-1] * _MULTIPLIER))
        return self.known


def shingle_hashes(text: bytes | None, width: int, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each window of width words (A-Z in lower case, split at ASCII white space).

    A word's hash is the polynomial of its bytes' numbers in the multiplier; all words are worked out together.
    """
    raw = np.frombuffer((text or b"").lower(), np.uint8)
    inside = np.concatenate(([False], ~_WHITE[raw], [False]))
    ends = np.flatnonzero(inside[1:] != inside[:-1])
    size = ends[1::2] - ends[::2]
    n = len(size) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    last = np.cumsum(size)
    first = last - size
    place = np.arange(last[-1]) - np.repeat(first, size)
    code = np.add.reduceat(_BYTES[raw[inside[1:-1]]] * powers(int(size.max()))[place], first)
    code = _mixed(code, 7)
    out = code[:n].copy()
    for k in range(1, width):
        out *= _MULTIPLIER
        out += code[k : n + k]
    return _mixed(out, 0)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of x: a bijection of 64 bits."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def least_of_spans(x: np.ndarray, *spans: int) -> list[np.ndarray]:
    """For each span (ascending) the least of so many neighbours in the last dimension of x, from each place on."""
    found, run, span = [], x, 1
    for wanted in spans:
        while span < wanted:
            step = min(span, wanted - span)
            run = np.minimum(run[..., : run.shape[-1] - step], run[..., step:])
            span += step
        found.append(run)
    return found


def compact_windows(values: np.ndarray, least: int, reach: int = 1) -> list[np.ndarray]:
    """(k, c, l, r, before, after) of the nodes of each row's Cartesian tree whose span l..r has at least `least` places; leftmost of equal values first.

    values has a row for each hash function k. A node's parents span more than it does, so those with long
    spans are the least values of windows of `least` places, and the nearest smaller values of one are others
    of them: a stack over these few is enough. before and after: the upper half of the least value of the
    `reach` places before, and after, c; as large as can be where there are none.
    """
    rows, n = values.shape
    parts: list[tuple] = []
    if n >= least:
        low = np.uint64((1 << max(1, int(n).bit_length())) - 1)
        ranked = np.full((rows, n + 2 * reach), ~np.uint64(0))
        ranked[:, reach : n + reach] = (values & ~low) | np.arange(n, dtype=np.uint64)
        near, run = least_of_spans(ranked, reach, least)
        run = run[:, reach : n + reach - least + 1]
        for k in range(rows):
            own = run[k][np.append(True, run[k, 1:] != run[k, :-1])]  # places only move on
            at = (own & low).astype(np.int64)
            order, places = own.tolist(), at.tolist()
            left, right, open_ = [0] * len(order), [n - 1] * len(order), []
            for i, v in enumerate(order):
                while open_ and order[open_[-1]] > v:
                    right[open_.pop()] = places[i] - 1
                if open_:
                    left[i] = places[open_[-1]] + 1
                open_.append(i)
            parts.append((np.full(len(at), k), at, np.array(left, np.int64), np.array(right, np.int64), near[k, at] >> np.uint64(32), near[k, at + reach + 1] >> np.uint64(32)))
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2


def centres(values: np.ndarray, span: int) -> np.ndarray:
    """Places that have the least value of some `span` neighbours: those of compact_windows, with all of equal values."""
    if len(values) < span:
        return np.empty(0, np.int64)
    run = ~least_of_spans(values, span)[0]
    run = ~least_of_spans(np.pad(run, span - 1, constant_values=~np.zeros(1, run.dtype)[0]), span)[0]  # of the windows that hold a place the largest least
    return np.flatnonzero(run == values)


def covered(bad: np.ndarray, least: int, share: float) -> list[tuple[int, int]]:
    """The union of all stretches of at least `least` places of which at most `share` are bad, as ascending [i, j)."""
    n = len(bad)
    if n < least:
        return []
    total = np.concatenate(([0.0], np.cumsum(share - bad)))
    low = np.minimum.accumulate(total[: n - least + 1])
    ends = least + np.flatnonzero(total[least:] >= low - 1e-9)
    first = np.searchsorted(-low, -total[ends] - 1e-9)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, ends, -1)
    inside = np.concatenate(([False], np.cumsum(step[:-1]) > 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


def leading(order: np.ndarray, least: int, share: float) -> np.ndarray:
    """Whether each place is among the first in order, the share of them and one more, of some stretch of `least` places or more; zeros come first and are not asked for.

    Two sets of which each has at most that share for itself have the first of what is common among these.
    Order is taken in steps of a quarter of a level, so a few more places may be told.
    """
    out = np.zeros(len(order), bool)
    once = np.ones(len(order), bool)
    by = np.argsort(order, kind="stable")
    once[by[1:][(order[by][1:] == order[by][:-1]) & (order[by][1:] > 0)]] = False
    step = order >> np.uint64(30)
    for one in _distinct(step[order > 0]):
        region = covered(((step < one) & once).astype(float), least, share)
        if not region:
            break
        for i, j in region:
            out[i:j] |= (step[i:j] == one) & (order[i:j] > 0)
    return out


def common_run(least: int, similarity: float) -> int:
    """So many neighbours at least are common in a row to two similar stretches of `least` places or more."""
    runs = []
    for n in range(least, 4 * least + 1):
        common = int(np.ceil(similarity * n - 1e-9))
        runs.append(-(-common // (n - common + 1)))
    return max(1, min(runs))


def dense_runs(member: np.ndarray, least: int, share: float) -> list[tuple[int, int]]:
    """Stretches [i, j) of at least `least` places that begin and end with members and have at least the share of members; the longest is cut out first."""
    total = np.concatenate(([0.0], np.cumsum(np.where(member, 1 - share, -share))))
    found, todo = [], [(0, len(member))]
    while todo:
        i, j = todo.pop()
        if j - i < least:
            continue
        starts = i + np.flatnonzero(member[i:j])
        if len(starts) < share * least - 1e-9:
            continue
        # For each member as the end: the first start from which the sum up to it is not negative.
        low = np.minimum.accumulate(total[starts])
        first = starts[np.searchsorted(-low, -total[starts + 1] - 1e-9)]
        best = int(np.argmax(starts - first))
        start, end = int(first[best]), int(starts[best]) + 1
        if end - start >= least:
            found.append((start, end))
            todo += [(i, start), (end, j)]
    return sorted(found)


def _stretches(member: np.ndarray, least: int, similarity: float, matches: Callable[[int, int], list]) -> list:
    """What matches(i, j) finds for stretches with many members, joined; a stretch with matches is not looked at again.

    Of two similar sets of one size 2 s / (1 + s) are common; a larger set may have as few as s. Where such
    a stretch has no match, denser ones are tried, in the end those that are members throughout.
    """
    found, tried, open_ = [], set(), [(0, len(member))] if member.sum() >= similarity * least - 1e-9 else []
    for share in (2 * similarity / (1 + similarity), similarity, 0.96, 1 - 1e-9):
        rest = []
        for start, stop in open_:
            at = start
            for i, j in dense_runs(member[start:stop], least, share):
                i, j = start + i, start + j
                got = [] if (i, j) in tried else matches(i, j)
                tried.add((i, j))
                if got:
                    found += got
                    rest.append((at, i))
                    at = j
            rest.append((at, stop))
        open_ = [(i, j) for i, j in rest if j - i >= least]
    return sorted(found)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])]


def _within(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each of x is in ordered, which is ascending and not empty."""
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def shared_passages(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """(i, j, k, m): stretches a[i:j] and b[k:m], at least `least` long, whose sets of shingles are similar; zeros are like nothing.

    Dense stretches are tried first. In what lies between those that are similar all are: see best_box.
    """
    if min(len(a), len(b)) < least:
        return []
    known = np.sort(b)
    member = _within(a, known) & (a != 0)
    if np.count_nonzero(member) < similarity * least - 1e-9:
        return []
    zero_b = b == 0
    # All that is common is one passage, most of the time.
    common = _distinct(a[member])
    there = _within(b, common)
    i, k = int(member.argmax()), int(there.argmax())
    j, m = len(a) - int(member[::-1].argmax()), len(b) - int(there[::-1].argmax())
    # Shingles that stand twice count twice here, once below.
    if min(j - i, m - k) >= least and len(common) >= similarity * (j - i + m - k - len(common)):
        return [(i, j, k, m)]
    if not covered(~member, least, 1 - similarity) or not covered(~there, least, 1 - similarity):
        return []

    def similar(i: int, j: int) -> list[tuple[int, int, int, int]]:
        x, more = _distinct(a[i:j]), int((a[i:j] == 0).sum())
        x = x[x != 0]

        def same(k: int, m: int) -> list[tuple[int, int, int, int]]:
            y = _distinct(b[k:m])
            y = y[y != 0]
            both = int(_within(x, y).sum()) if len(y) else 0
            return [(i, j, k, m)] if both >= similarity * (len(x) + more + len(y) + int(zero_b[k:m].sum()) - both) - 1e-9 else []

        return _stretches(_within(b, x) & ~zero_b, least, similarity, same) if len(x) else []

    found = _stretches(member, least, similarity, similar)
    at, todo = 0, []
    for i, j, *_ in found:
        todo.append((at, i))
        at = max(at, j)
    todo.append((at, len(a)))
    while todo:
        i, j = todo.pop()
        if np.count_nonzero(member[i:j]) >= similarity * least - 1e-9:
            for p, q, k, m in best_box(a[i:j], b, member[i:j], least, similarity):
                found.append((i + p, i + q, k, m))
                todo += [(i, i + p), (i + q, j)]
    return sorted(found)


def best_box(a: np.ndarray, b: np.ndarray, member: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """The most similar stretches of a and b, if similar enough, of all there are.

    Two sets are similar by s if (1 + s) times what is common is not below s times the sum of their sizes. Where a
    shingle stands once in a stretch that is a sum over its places: for every stretch of a the best of b is the
    stretch of the largest sum. Ends that are not common only make up the length that is asked for. A stretch of
    more than two times least / (2 s - 1) places whose common shingles stand in one order can be halved, and a half is
    as similar: longer ones are not tried.
    """
    longest = 2 * int(np.ceil(least / (2 * similarity - 1))) if similarity > 0.5 else len(a)
    found: list[tuple[int, int, int, int]] = []
    for lo, hi in covered(~member, least, 1 - similarity):
        x = a[lo:hi]
        order = np.argsort(x, kind="stable")
        at = order[np.minimum(np.searchsorted(x[order], b), len(x) - 1)]
        at = np.where((x[at] == b) & (b != 0), at, -1)
        for k, m in covered(at < 0, least, 1 - similarity):
            best, where = -1e-9, None
            total = np.concatenate(([0.0], np.cumsum((at[k:m] >= 0) * (1 + similarity) - similarity)))
            count = np.append(0, np.cumsum(_within(x, np.sort(b[k:m])) & (x != 0)))
            most = float(np.max(total[least:] - np.minimum.accumulate(total[: m - k - least + 1])))  # as if all of a were there
            for size in range(least, min(hi - lo, longest, int(most / similarity + 1e-6)) + 1):
                # Ends of a stretch longer than asked for are common.
                starts = np.flatnonzero(count[size:] - count[:-size] >= similarity * size - 1e-9)
                if size > least:
                    starts = starts[member[lo + starts] & member[lo + starts + size - 1]]
                for part in np.array_split(starts, 1 + len(starts) * (m - k) // 2_000_000):
                    if not len(part):
                        continue
                    here = at[None, k:m]
                    gain = ((here >= part[:, None]) & (here < part[:, None] + size)) * (1 + similarity) - similarity
                    total = np.concatenate((np.zeros((len(part), 1)), np.cumsum(gain, axis=1)), axis=1)
                    low = np.minimum.accumulate(total[:, : m - k - least + 1], axis=1)
                    value = total[:, least:] - low - similarity * size
                    top = int(np.argmax(value))
                    if value.flat[top] > best:
                        r, e = divmod(top, value.shape[1])
                        best, where = float(value.flat[top]), (lo + int(part[r]), lo + int(part[r]) + size, k + int(np.argmin(total[r, : e + 1])), k + e + least)
            if where:
                i, j, k, m = where
                both = len(np.intersect1d(x[i - lo : j - lo][x[i - lo : j - lo] != 0], b[k:m]))
                sizes = [len(_distinct(z[z != 0])) + int((z == 0).sum()) for z in (a[i:j], b[k:m])]
                if both >= similarity * (sum(sizes) - both) - 1e-9:  # shingles that stand twice count once
                    found.append(where)
    return found


def ordered_passages(at: np.ndarray, bt: np.ndarray, n: int, least: int, similarity: float, m: int) -> list[tuple[int, int, int, int]]:
    """shared_passages of n and m places without repeats whose common ones are at[t] and bt[t], both ascending: all there are, longest first.

    A pair of stretches holds the common places from one t to another, so its similarity is a sum over t. Only where
    fewer than `least` are common can a stretch be shorter than asked for; places beside it make up for that.
    """
    need = int(np.ceil(2 * similarity * least / (1 + similarity) - 1e-9))
    if len(at) < need:
        return []
    i, j, k, w = int(at[0]), int(at[-1]) + 1, int(bt[0]), int(bt[-1]) + 1
    if min(j - i, w - k) >= least and (1 + similarity) * len(at) >= similarity * (j - i + w - k) - 1e-9:
        return [(i, j, k, w)]
    found = []
    gain = (1 + similarity) * np.arange(len(at)) - similarity * (at + bt)
    todo = [(0, len(at), 0, n)]
    while todo:
        lo, hi, left, right = todo.pop()
        if hi - lo < need or right - left < least:
            continue
        p, q, g = at[lo:hi], bt[lo:hi], gain[lo:hi]
        end = g + (1 - similarity + 1e-9)
        i, j = 0, hi - lo - 1
        if end[j] < g[0] or p[j] - p[0] + 1 < least or q[j] - q[0] + 1 < least:
            first = np.searchsorted(-np.minimum.accumulate(g), -end)
            size = p - p[first] + 1
            size[(size < least) | (q - q[first] + 1 < least)] = 0
            j = int(size.argmax())
            i = int(first[j])
            if not size[j]:
                both = p + q
                if (both[need - 1 :] - both[: len(both) - need + 1]).min() + 2 > (1 + similarity) * (least - 1) / similarity + 1e-9:
                    continue
                for c in range(min(least - 1, hi - lo), need - 1, -1):
                    x, y = p[c - 1 :] - p[: len(p) - c + 1] + 1, q[c - 1 :] - q[: len(q) - c + 1] + 1
                    good = np.flatnonzero((1 + similarity) * c >= similarity * (np.maximum(x, least) + np.maximum(y, least)) - 1e-9)
                    if len(good):
                        i, j = int(good[0]), int(good[0]) + c - 1
                        break
                else:
                    continue
        a, b, c, d = int(p[i]), int(p[j]) + 1, int(q[i]), int(q[j]) + 1
        b = min(right, max(b, a + least))
        a = max(left, min(a, b - least))
        d = min(m, max(d, c + least))
        c = max(0, min(c, d - least))
        found.append((a, b, c, d))
        todo += [(lo, lo + int(np.searchsorted(p, a)), left, a), (lo + int(np.searchsorted(p, b)), hi, b, right)]
    return found


def _alike(a: np.ndarray, b: np.ndarray, least: int, ours: np.ndarray, theirs: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Stretches of at least `least` places that hold the same set of shingles; ours and theirs tell which places of a and b are common."""

    def long(good: np.ndarray) -> list[tuple[int, int]]:
        edge = np.concatenate(([-1], np.flatnonzero(~good), [len(good)]))
        at = np.flatnonzero(edge[1:] - edge[:-1] > least)
        return list(zip((edge[at] + 1).tolist(), edge[at + 1].tolist(), strict=True))

    found, todo = [], []
    if one := long(ours):
        todo = [(*x, *y) for y in long(theirs) for x in one]
    sets: dict[tuple, set] = {}
    while todo:
        i, j, k, m = todo.pop()
        for t, z, lo, hi in ((0, a, i, j), (1, b, k, m)):
            if (t, lo, hi) not in sets:
                sets[t, lo, hi] = set(_distinct(z[lo:hi]).tolist())
        x, y = sets[0, i, j], sets[1, k, m]
        if x == y:
            found.append((i, j, k, m))
        elif both := x & y:
            known = np.array(sorted(both), a.dtype)
            todo += [(i + s, i + e, k + t, k + f) for s, e in long(_within(a[i:j], known)) for t, f in long(_within(b[k:m], known))]
    return found


def _spans_of_runs(x: np.ndarray, both: np.ndarray, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places i and j, number of shingles, which of both) of the stretches that begin and end with a run of one shingle and of which enough is common."""
    cuts = np.append(0, np.flatnonzero((x[1:] != x[:-1]) | (x[1:] == 0)) + 1)
    ends = np.append(cuts[1:], len(x))
    value = x[cuts].astype(np.int64)
    value[value == 0] = -1 - np.flatnonzero(value == 0)
    known, which = np.unique(value, return_inverse=True)
    has = np.zeros((len(cuts), len(cuts), len(known)), bool)  # the shingles of the runs from one on, up to another
    for k in range(len(cuts)):
        has[: k + 1, k:, which[k]] = True
    size = has.sum(axis=2)
    has = has[:, :, np.isin(known, both)]
    # Ends that are not common only make up the length that is asked for.
    common = np.isin(value, both)
    good = (ends[None, :] - cuts[:, None] >= least) & (has.sum(axis=2) >= similarity * size - 1e-9)
    good &= (common[:, None] | (ends[None, :] - ends[:, None] < least)) & (common[None, :] | (cuts[None, :] - cuts[:, None] < least))
    i, j = np.nonzero(np.triu(good))
    return np.stack((cuts[i], ends[j]), axis=1), size[i, j], has[i, j]


def run_passages(a: np.ndarray, b: np.ndarray, both: np.ndarray, least: int, similarity: float, most: int = 64) -> list[tuple[int, int, int, int]] | None:
    """shared_passages where shingles are repeated in a row: all there are, longest first; none if there are more than `most` runs.

    A run that a stretch holds some of can be taken whole, which changes neither set.
    """
    if max(np.count_nonzero((x[1:] != x[:-1]) | (x[1:] == 0)) for x in (a, b)) >= most:
        return None
    (one, n, x), (two, m, y) = (_spans_of_runs(z, both, least, similarity) for z in (a, b))
    found = []
    if len(one) and len(two):
        best = np.zeros(len(one), np.int64)
        partner = np.zeros(len(one), np.int64)
        y = y.astype(np.float32).T
        for part in np.array_split(np.arange(len(one)), 1 + len(one) * len(two) // 1_000_000):
            alike = (x[part].astype(np.float32) @ y) * (1 + similarity) >= similarity * (n[part][:, None] + m[None, :]) - 1e-4
            total = np.where(alike, (two[:, 1] - two[:, 0])[None, :], 0)
            partner[part] = total.argmax(axis=1)
            best[part] = total.max(axis=1)
        length = np.where(best > 0, one[:, 1] - one[:, 0], 0)
        while length.any():
            k = int(length.argmax())
            i, j = one[k].tolist()
            found.append((i, j, *two[partner[k]].tolist()))
            length[(one[:, 0] < j) & (one[:, 1] > i)] = 0
    return found


def fewest_others(x: np.ndarray, both: np.ndarray, least: int) -> int:
    """So many different shingles besides both at least are in any `least` places of x; each zero is one."""
    t = np.flatnonzero(~_within(x, both) | (x == 0))
    order = np.argsort(x[t], kind="stable")
    before = np.full(len(t), -1)
    same = (x[t][order][1:] == x[t][order][:-1]) & (x[t][order][1:] != 0)
    before[order[1:][same]] = t[order[:-1][same]]
    step = np.zeros(len(x) + 1, np.int64)  # a shingle is new to the places from i on up to its next if it was not there since i
    last = len(x) - least
    first = np.maximum(before + 1, t - least + 1).clip(0)
    good = first <= np.minimum(t, last)
    np.add.at(step, first[good], 1)
    np.add.at(step, np.minimum(t, last)[good] + 1, -1)
    return int(np.cumsum(step)[: last + 1].min())


def repeated_stretches(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """shared_passages of stretches that repeat some shingles: as they are, then by their runs; place by place only where neither tells."""
    x, y = _distinct(a), _distinct(b)
    both = x[_within(x, y) & (x != 0)]
    if not len(both):
        return []
    if len(both) < similarity / (1 - similarity) - 1e-9:
        return _alike(a, b, least, _within(a, both), _within(b, both))  # one shingle more would be too many
    n, m = (len(z) + max(0, np.count_nonzero(w == 0) - 1) for z, w in ((x, a), (y, b)))
    if len(both) >= similarity * (n + m - len(both)) - 1e-9:
        ends = [(int(w[0]), int(w[-1]) + 1) for w in (np.flatnonzero(_within(z, both)) for z in (a, b))]
        return [(*ends[0], *ends[1])] if min(j - i for i, j in ends) >= least else [(0, len(a), 0, len(b))]
    if fewest_others(a, both, least) + fewest_others(b, both, least) > len(both) * (1 - similarity) / similarity + 1e-9:
        return []
    found = run_passages(a, b, both, least, similarity)
    return shared_passages(a, b, least, similarity) if found is None else found


class Block:
    """Sequences of shingles that are compared with each other."""

    def __init__(self, seqs: list[np.ndarray], least: int, similarity: float) -> None:
        self.seqs, self.least, self.similarity = seqs, least, similarity
        size = np.array([len(x) for x in seqs])
        self.start = np.append(0, np.cumsum(size))
        flat = np.concatenate(seqs).astype(np.uint64)
        flat = np.sort(flat << np.uint64(32) | np.arange(len(flat), dtype=np.uint64))
        order = (flat & np.uint64(0xFFFFFFFF)).astype(np.int64)
        flat >>= np.uint64(32)
        new = np.append(True, flat[1:] != flat[:-1])
        known = np.cumsum(new) - 1
        self.ids = np.empty(len(flat), np.int64)
        self.ids[order] = known
        # What each sequence holds, once: which, where first and how often.
        whose = np.repeat(np.arange(len(seqs)), size)[order]
        cuts = np.flatnonzero(new | np.append(True, whose[1:] != whose[:-1]))
        times = np.diff(np.append(cuts, len(flat)))
        several = (times > 1) & (flat[cuts] > 0)
        self.again = np.empty(len(flat), bool)
        self.again[order] = np.repeat(several, times)
        here = flat[cuts] > 0
        cuts, times = cuts[here], times[here]
        by = np.argsort(whose[cuts].astype(np.uint16 if len(seqs) < 1 << 16 else np.int64), kind="stable")
        cuts = cuts[by]
        whose = whose[cuts]
        self.which, self.first, self.times = known[cuts].astype(np.int32), (order[cuts] - self.start[whose]).astype(np.int32), times[by].astype(np.int32)
        self.bound = np.searchsorted(whose, np.arange(len(seqs) + 1))
        self.repeats = np.add.reduceat(self.again, self.start[:-1]) > 0
        width = int(known[-1]) + 1
        self.at, self.mark = np.full(width, -1, np.int32), np.zeros(width, bool)
        self.runs: dict[int, dict[int, list]] = {}

    def same_run(self, k: int) -> dict[int, list]:
        """The stretches of one and the same shingle, by its number."""
        if k not in self.runs:
            x = self.ids[self.start[k] : self.start[k + 1]]
            cuts = np.append(0, np.flatnonzero(x[1:] != x[:-1]) + 1)
            ends = np.append(cuts[1:], len(x))
            out = defaultdict(list)
            for i, j in zip(cuts[ends - cuts >= self.least].tolist(), ends[ends - cuts >= self.least].tolist(), strict=True):
                out[int(x[i])].append((i, j))
            self.runs[k] = out
        return self.runs[k]

    def links(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, list]]:
        """(a, b, shared_passages of a and b) for the pairs that have any; a ascends."""
        enough = self.similarity * self.least - 1e-9
        width = len(self.at)
        places = np.append(0, np.cumsum(self.bound[b + 1] - self.bound[b]))
        row = np.cumsum(np.diff(a, prepend=a[:1]) != 0)
        start, now = 0, -1
        while start < len(a):
            # So many pairs at a time that the arrays stay small.
            stop = min(int(np.searchsorted(places, places[start] + 2_000_000, "right")) - 1, int(np.searchsorted(row, row[start] + 4_000_000 // width, "right")))
            stop = max(stop, start + 1)
            x, y, r = a[start:stop], b[start:stop], row[start:stop] - row[start]
            whole = x[np.flatnonzero(np.diff(r, prepend=-1))]
            weight = np.zeros(len(whole) * width, np.int32)
            for k, one in enumerate(whole.tolist()):
                mine = slice(self.bound[one], self.bound[one + 1])
                weight[self.which[mine] + k * width] = self.times[mine]
            size = self.bound[y + 1] - self.bound[y]
            ends = np.cumsum(size)
            cuts = ends - size
            where = np.arange(ends[-1]) + np.repeat(self.bound[y] - cuts, size)
            there = self.which[where]
            w = weight[there + np.repeat(r * width, size)]
            hit = w > 0
            ours = np.add.reduceat(w, cuts)
            good = np.flatnonzero(ours >= enough)
            if len(good):
                theirs = np.add.reduceat(hit * self.times[where], cuts)
                good = good[theirs[good] >= enough]
                common, total = np.add.reduceat(hit, cuts, dtype=np.int64), np.add.reduceat(hit * there, cuts, dtype=np.int64)
            for k, m, n, u, v, z in zip(*(q[good].tolist() for q in (x, y, common, ours, theirs, total)), strict=True) if len(good) else ():
                if n == 1:
                    got = [(*p, *q) for p in self.same_run(k).get(z, ()) for q in self.same_run(m).get(z, ())]
                else:
                    if k != now:
                        if now >= 0:
                            self.at[self.which[self.bound[now] : self.bound[now + 1]]] = -1
                        mine, now = slice(self.bound[k], self.bound[k + 1]), k
                        self.at[self.which[mine]] = self.first[mine]
                    got = self.passages(k, m, n, n == u and n == v)
                if got:
                    yield k, m, got
            start = stop

    def passages(self, a: int, b: int, common: int, once: bool) -> list:
        least, similarity, seqs = self.least, self.similarity, self.seqs
        at = self.at[self.ids[self.start[b] : self.start[b + 1]]]
        if once and not self.repeats[a] and not self.repeats[b]:
            q = np.flatnonzero(at >= 0)
            p = at[q]
            if (p[1:] > p[:-1]).all():
                return ordered_passages(p, q, len(seqs[a]), least, similarity, len(seqs[b]))
        theirs = self.which[self.bound[b] : self.bound[b + 1]]
        self.mark[theirs] = True
        ours = self.mark[self.ids[self.start[a] : self.start[a + 1]]]
        self.mark[theirs] = False
        if common < similarity / (1 - similarity) - 1e-9:
            return _alike(seqs[a], seqs[b], least, ours, at >= 0)
        one = covered(~ours, least, 1 - similarity)
        two = covered(at < 0, least, 1 - similarity) if one else []
        found = []
        for i, j in one:
            alone = not self.again[self.start[a] + i : self.start[a] + j].any()
            for k, m in two:
                if alone and not self.again[self.start[b] + k : self.start[b] + m].any():
                    q = np.flatnonzero((at[k:m] >= i) & (at[k:m] < j))
                    p = at[k:m][q] - i
                    if (p[1:] > p[:-1]).all():
                        found += [(i + x, i + y, k + z, k + w) for x, y, z, w in ordered_passages(p, q, j - i, least, similarity, m - k)]
                        continue
                got = repeated_stretches(seqs[a][i:j], seqs[b][k:m], least, similarity)
                found += [(i + x, i + y, k + z, k + w) for x, y, z, w in got]
        return found


def _packed(*columns: tuple[np.ndarray, int]) -> bytes:
    """So many lower bytes of each column of whole numbers, byte by byte, which compresses well."""
    return b"".join(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes() for x, n in columns)


def _unpacked(data: bytes, *sizes: int) -> list[np.ndarray]:
    raw = np.frombuffer(data, np.uint8).reshape(sum(sizes), -1)
    out, at = [], 0
    for n in sizes:
        x = np.zeros((raw.shape[1], 8), np.uint8)
        x[:, :n] = raw[at : at + n].T
        out.append(x.view("<u8").ravel())
        at += n
    return out


_DEALT = "place long, batch long, data binary"


def _rows(rows: list[tuple], names: tuple[str, ...] = ("place", "batch", "data")) -> pa.RecordBatch:
    kinds = {"data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(x, pa.int64())) for k, x in enumerate(names)], list(names))


def _shared(sequences: DataFrame, read: Callable, run: int, finish: Callable, schema: str, size: int) -> DataFrame:
    """The rows finish(doc, tag, length, steps or hashes, hit) of sequences of hashes; hit: 0 where no other has one, else the logarithm of how often it stands.

    read(batch) yields (doc, tag, hashes). Their centres (all places if run is 1) are dealt by key, which
    tells those that stand in one sequence only, and the answers go back to where the sequences are noted.
    """
    parts = min(max(16, size >> 22), 1 << 16)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            batch = uuid.uuid4().int >> 65
            keys = np.concatenate([x[3] for x in open_])
            n = np.array([len(x[3]) for x in open_])
            place = np.concatenate([np.arange(k, dtype=np.uint32) for k in n])
            owner = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            to = ((keys >> np.uint64(48)) % np.uint64(parts)).astype(np.uint16)  # the other 48 bits travel
            order = np.argsort(to, kind="stable")
            keys, owner, place, to = keys[order], owner[order], place[order], to[order]
            cuts = np.append(0, np.flatnonzero(np.diff(to)) + 1)
            out = [(int(to[i]), batch, _packed((keys[i:j], 6), (np.diff(owner[i:j], prepend=np.uint32(0)), 3), (place[i:j], 4))) for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)], strict=True)]
            head = np.array([[x[0], x[1], len(x[2]), len(x[3])] for x in open_], np.int64)
            body = [x[2].astype(np.uint32).tobytes() if run == 1 else x[4].tobytes() for x in open_]
            yield _rows([(-1, batch, len(n).to_bytes(8, "little") + head.tobytes() + b"".join(body))])
            for k in range(0, len(out), 64):
                yield _rows(out[k : k + 64])

        open_, many = [], 0
        for b in batches:
            for doc, tag, h in read(b):
                at = np.arange(len(h)) if run == 1 else centres(h, run)
                key = h[at]
                # Steps to the next centre; the upper bit marks what stands more than once here, which may be alone and still no loss.
                steps = np.diff(at, prepend=0).astype(np.uint8)
                order = np.argsort(key)
                twice = key[order][1:] == key[order][:-1]
                if twice.any():
                    steps[order[1:][twice]] |= 128
                    steps[order[:-1][twice]] |= 128
                open_.append((doc, tag, h, key, steps))
                many += len(key)
                if many > 400_000:
                    yield from flush()
                    open_, many = [], 0
        if open_:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, owners, places = {}, [], [], []
        for b in batches:
            for place, batch, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                k, o, p = _unpacked(data.as_py(), 6, 3, 4)
                k |= np.uint64(place << 48)
                owners.append(np.cumsum(o, dtype=np.uint64) | np.uint64(ids.setdefault(batch, len(ids)) << 32))
                keys.append(k)
                places.append(p.astype(np.uint32))
        if not ids:
            return
        back = list(ids)
        key, owner, place = np.concatenate(keys), np.concatenate(owners), np.concatenate(places)
        del keys, owners, places
        order = np.argsort(key)
        key, owner, place = key[order], owner[order], place[order]
        cuts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        several = np.minimum.reduceat(owner, cuts) != np.maximum.reduceat(owner, cuts)
        size = np.diff(np.append(cuts, len(key)))
        kept = np.repeat(several, size)
        level = np.repeat(np.log2(size).astype(np.uint8), size)[kept]
        owner, place = owner[kept], place[kept]
        order = np.argsort(owner, kind="stable")
        owner, place, level = owner[order], place[order], level[order]
        home = owner >> np.uint64(32)
        cuts = np.append(0, np.flatnonzero(home[1:] != home[:-1]) + 1) if len(home) else np.empty(0, np.int64)
        out = [(0, back[int(home[i])], _packed((owner[i:j] & np.uint64(0xFFFFFF), 3), (place[i:j], 4), (level[i:j], 1))) for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(home)], strict=False)]
        for k in range(0, len(out), 64):
            yield _rows(out[k : k + 64])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, found = {}, defaultdict(list)
        for b in batches:
            for place, batch, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if place < 0:
                    heads[batch] = data.as_py()
                else:
                    found[batch].append(data.as_py())
        for batch, answers in found.items():
            raw = heads.pop(batch)
            m = int.from_bytes(raw[:8], "little")
            head = np.frombuffer(raw, np.int64, 4 * m, 8).reshape(m, 4)
            body = np.frombuffer(raw, np.uint32 if run == 1 else np.uint8, -1, 8 + 32 * m)
            off = np.append(0, np.cumsum(head[:, 3]))
            hit = np.zeros(off[-1], np.uint8)
            for x in answers:
                o, p, level = _unpacked(x, 3, 4, 1)
                hit[off[o.astype(np.int64)] + p.astype(np.int64)] = level
            rows = []
            for doc, tag, n, i, j in zip(*head[:, :3].T.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                if hit[i:j].any():
                    rows += finish(doc, tag, n, body[i:j], hit[i:j])
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), target)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), target)

    names = [x.split()[0] for x in schema.split(", ")]
    target = pa.schema([(x.split()[0], {"long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in schema.split(", ")])
    dealt = stored(sequences.mapInArrow(deal, _DEALT))
    met = dealt.where("place >= 0").repartition(parts, "place").mapInArrow(meet, _DEALT)
    out = stored(met.union(dealt.where("place < 0")).repartition(parts, "batch").mapInArrow(answer, schema), release=True)
    discard(dealt)
    return out


def _pieces(docs: DataFrame, least: int, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(doc, lo, seq, level, c): stretches of documents from shingle lo on that may be similar to those of others, c the same for equal ones.

    seq: 32 bits of each shingle's hash, 0 where no other stretch has it; level: the logarithm of how often it stands.
    """
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text")).withColumn("tag", F.xxhash64("text"))
    share, run = 1 - similarity, common_run(least, similarity)

    def whole(b: pa.RecordBatch) -> Iterator[tuple]:
        for doc, text, tag in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            h = shingle_hashes(text.as_py(), width, powers)
            if len(h) >= least:
                yield doc, tag, h

    def dense(doc: int, tag: int, n: int, steps: np.ndarray, hit: np.ndarray) -> list[tuple]:
        bad = np.zeros(n)
        bad[np.cumsum(steps & 127)[(hit == 0) & (steps < 128)]] = 1
        return [(doc, tag, i, j) for i, j in covered(bad, least, share)]

    powers = Powers()
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spans = _shared(given, whole, run, dense, "doc long, tag long, lo long, hi long", size)
    involved = stored(spans.select("doc").distinct())
    if involved.count() <= BROADCAST_IDS:  # else the texts are dealt to meet them
        involved = F.broadcast(involved)
    spans = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    cut = given.join(involved, "doc", "left_semi").join(spans, ["doc", "tag"])

    def stretches(b: pa.RecordBatch) -> Iterator[tuple]:
        for doc, text, all_ in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            h = shingle_hashes(text.as_py(), width, powers)
            for x in all_:
                yield doc, x["lo"], h[x["lo"] : x["hi"]]

    def masked(doc: int, lo: int, n: int, seq: np.ndarray, hit: np.ndarray) -> list[tuple]:
        low = seq.copy()
        low[low == 0] = 1
        order = np.argsort(seq, kind="stable")
        once = np.ones(n, bool)
        twice = seq[order][1:] == seq[order][:-1]
        once[order[1:][twice]] = once[order[:-1][twice]] = False
        low[(hit == 0) & once] = 0
        return [(doc, lo + i, low[i:j].tobytes(), hit[i:j].tobytes()) for i, j in covered((low == 0).astype(float), least, share)]

    out = _shared(cut.select("doc", "text", "spans"), stretches, 1, masked, "doc long, lo long, seq binary, level binary", size)
    return stored(out.withColumn("c", F.xxhash64("seq")).dropDuplicates(["doc", "lo", "c"]))


#: Classes of one block at most, on average; blocks meet each other.
BLOCK = 256
_CLASS = "c long, n long, low struct<doc:long,lo:long>, high struct<doc:long,lo:long>, multi array<long>"


def _met(pieces: DataFrame, least: int, share: float) -> DataFrame:
    """(ba, bb, pairs, classes): blocks of classes, pairs (a, b) of these that may be similar, and what there is to know of them.

    Classes meet in shingles that lead some stretch of theirs, rare ones first. Four of the most frequent of
    these sign a class: a pair is told at the least one that signs both; only where there is none at every
    shingle they meet in.
    """
    several = pieces.groupBy("doc").agg(F.count("*").alias("m")).where("m > 1")
    place = F.struct("doc", "lo")
    classes = stored(pieces.join(several, "doc", "left").groupBy("c").agg(
        F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high"), F.collect_list(F.when(F.col("m").isNotNull(), F.col("doc"))).alias("multi"), F.first("seq").alias("seq"), F.first("level").alias("level")
    ))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, keys, least4 = [], [], []
            for one, x, level in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                order = np.frombuffer(x.as_py(), np.uint32).astype(np.uint64)
                order[order > 0] |= np.frombuffer(level.as_py(), np.uint8).astype(np.uint64)[order > 0] << np.uint64(32)
                key = order[leading(order, least, share)]
                if len(key):
                    key = _distinct(key).astype(np.int64)
                    c.append(one)
                    keys.append(key.tolist())
                    sign = key[key >> 32 == key[-1] >> 32]
                    least4.append([int(sign[min(k, len(sign) - 1)]) for k in range(4)])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(least4, pa.list_(pa.int64()))], ["c", "keys", "sig"])

    signs = stored(classes.select("c", "seq", "level").mapInArrow(signed, "c long, keys array<long>, sig array<long>"))
    homes = signs.groupBy(F.col("sig")[0].alias("home")).agg(F.ceil(F.count("*") / BLOCK).alias("split"))
    blocks = signs.withColumn("home", F.col("sig")[0]).join(homes, "home").withColumn("block", F.xxhash64("home", F.pmod("c", "split"))).select("c", "keys", "sig", "block")
    blocks = stored(blocks)
    keyed = blocks.select(F.explode("keys").alias("key"), "c", "block", *[F.col("sig")[k].alias(f"s{k}") for k in range(4)])
    parts = max(16, (blocks.agg(F.sum(F.size("keys"))).first()[0] or 0) >> 17)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(7)]) for b in batches]
        if not cols:
            return
        cols = np.concatenate(cols, axis=1)
        cols = cols[:, np.lexsort(cols[[1, 2, 0]])]
        cuts = np.append(0, np.flatnonzero(np.diff(cols[0])) + 1)
        ends = np.append(cuts[1:], cols.shape[1])
        none = np.iinfo(np.int64).max

        def flush(told: list) -> Iterator[pa.RecordBatch]:
            all_ = np.concatenate(told, axis=1)
            all_ = all_[:, np.lexsort(all_[[1, 0]])]
            for k in range(0, all_.shape[1], 500_000):
                part = all_[:, k : k + 500_000]
                at = np.flatnonzero(np.append(True, (part[:2, 1:] != part[:2, :-1]).any(axis=0))).tolist()
                yield _rows([(int(part[0, i]), int(part[1, i]), np.ascontiguousarray(part[2:, i:j].T).tobytes()) for i, j in zip(at, [*at[1:], part.shape[1]], strict=True)], ("ba", "bb", "data"))

        told, many = [], 0
        for size in range(2, 9):  # the many small ones together
            first = cuts[ends - cuts == size]
            for j in range(1, size):
                for i in range(j) if len(first) else ():
                    x, y = cols[:, first + i], cols[:, first + j]
                    least4 = np.full(len(first), none)
                    for k in range(3, 7):
                        for m in range(3, 7):
                            np.minimum(least4, x[k], out=least4, where=x[k] == y[m])
                    here = (least4 == none) | (least4 == x[0])
                    told.append(np.stack((x[2, here], y[2, here], x[1, here], y[1, here])))
        for start, end in zip(cuts[ends - cuts > 8].tolist(), ends[ends - cuts > 8].tolist(), strict=True):
            key = cols[0, start]
            for i in range(start, end, 1000):
                for k in range(i, end, 1000):
                    x, y = cols[1:, i : min(i + 1000, end)], cols[1:, k : min(k + 1000, end)]
                    least4 = np.full((x.shape[1], y.shape[1]), none)
                    for p in range(2, 6):
                        for q in range(2, 6):
                            np.minimum(least4, x[p][:, None], out=least4, where=x[p][:, None] == y[q])
                    here = (least4 == none) | (least4 == key)
                    u, v = np.nonzero(np.triu(here, 1) if i == k else here)
                    told.append(np.stack((x[1, u], y[1, v], x[0, u], y[0, v])))
                    many += len(u)
                    if many > 500_000:
                        yield from flush(told)
                        told, many = [], 0
        if told:
            yield from flush(told)

    def selves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([(k, k, np.array([x, x], np.int64).tobytes()) for x, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], ("ba", "bb", "data"))

    told = "ba long, bb long, data binary"
    alike = blocks.join(classes.where("low.doc <> high.doc").select("c"), "c", "left_semi").select("c", "block")
    pairs = stored(keyed.repartition(parts, "key").mapInArrow(paired, told).union(alike.mapInArrow(selves, told)).groupBy("ba", "bb").agg(F.collect_list("data").alias("pairs")), release=True)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ids = np.unique(np.frombuffer(b"".join(data), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), x)), pa.array(np.full(len(ids), y)), pa.array(ids)], ["ba", "bb", "c"])

    known = pairs.mapInArrow(needed, "ba long, bb long, c long").join(classes, "c").groupBy("ba", "bb").agg(F.collect_list(F.struct("c", "n", "low", "high", "multi", "seq")).alias("classes"))
    return pairs.join(known, ["ba", "bb"])


def _verified(batches: Iterator[pa.RecordBatch], least: int, similarity: float) -> Iterator[tuple]:
    """For each block its classes and an iterator of (a, b, similar stretches) of its pairs; a pair of stretches of one document is none."""
    for batch in batches:
        classes, cuts = batch.column("classes").values, batch.column("classes").offsets.to_numpy()
        ids, many, seqs, multi = (classes.field(x) for x in ("c", "n", "seq", "multi"))
        ids, many = ids.to_numpy(), many.to_numpy()
        (low, lo), (high, hi) = ([classes.field(e).field(x).to_numpy() for x in ("doc", "lo")] for e in ("low", "high"))
        for n in range(batch.num_rows):
            at = np.arange(cuts[n], cuts[n + 1])
            at = at[np.lexsort((ids[at], lo[at], low[at]))]
            order = ids[at]
            known = [
                {"c": c, "n": k, "low": {"doc": d, "lo": i}, "high": {"doc": e, "lo": j}, "multi": multi[x].as_py(), "seq": np.frombuffer(seqs[x].as_buffer(), np.uint32)}
                for x, c, k, d, i, e, j in zip(at.tolist(), *(z[at].tolist() for z in (ids, many, low, lo, high, hi)), strict=True)
            ]
            by = np.argsort(order)
            pairs = by[np.searchsorted(order[by], np.frombuffer(b"".join(batch.column("pairs")[n].as_py()), np.int64))].reshape(-1, 2)
            pairs = np.unique(pairs.min(axis=1) * len(known) + pairs.max(axis=1))
            block = Block([x["seq"] for x in known], least, similarity)

            def links(known: list = known, pairs: np.ndarray = pairs, block: Block = block) -> Iterator[tuple]:
                low, high = (np.array([x[e]["doc"] for x in known], np.int64) for e in ("low", "high"))
                a, b = pairs // len(known), pairs % len(known)
                kept = np.minimum(low[a], low[b]) != np.maximum(high[a], high[b])
                a, b = a[kept], b[kept]
                for i, k, got in block.links(a, b):
                    yield known[i], known[k], got

            yield {x["c"]: x for x in known}, links()


def repeated_passages(docs: DataFrame, least_words: int = 51, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, a_start, a_end, b, b_start, b_end): pairs of passages of two documents, in words from 0, ends exclusive.

    Passages have at least least_words words; their sets of width-word shingles have a Jaccard similarity
    of at least `similarity`. Stretches of documents that are alike in all that they share with others are
    a class, whose smallest id stands for it: each of the others is paired with it, and two classes by
    theirs. All pairs of classes are there. Ids are longs; rows of one id are texts of one document, equal
    ones count once and each of the others is compared; rows with a null id are left out. Null, empty and
    short texts have no passages.
    """
    least = least_words - width + 1
    pieces = _pieces(docs, least, width, similarity, id_col, text_col)
    names = ["c", "a", "a_start", "a_end", "b", "b_start", "b_end"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, links in _verified(batches, least, similarity):
            out = []
            for a, b, got in links:
                if a["c"] == b["c"]:
                    x, y, c = {"doc": 0, "lo": 0}, a["low"], a["c"]
                else:
                    x, y = next((x, y) for x, y in ((a["low"], b["low"]), (a["low"], b["high"]), (a["high"], b["low"])) if x["doc"] != y["doc"])
                    c = None
                out += [(c, x["doc"], x["lo"] + i, x["lo"] + j + width - 1, y["doc"], y["lo"] + k, y["lo"] + m + width - 1) for i, j, k, m in got]
            yield _rows(out, tuple(names))

    found = stored(_met(pieces, least, 1 - similarity).mapInArrow(rows, ", ".join(f"{x} long" for x in names)), release=True)
    copies = found.where("c IS NOT NULL").join(pieces.select("c", "doc", "lo"), "c").where("doc <> b")
    copies = copies.select(F.col("doc").alias("a"), (F.col("lo") + F.col("a_start")).alias("a_start"), (F.col("lo") + F.col("a_end")).alias("a_end"), "b", "b_start", "b_end")
    return found.where("c IS NULL").select(*names[1:]).union(copies).distinct()


def _merged(spans: str) -> Column:
    """Ascending structs (s, e) of which those that overlap or touch have become one."""
    kind = "struct<s:int,e:int>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))
    closed = lambda acc: F.when(acc["s"] >= 0, F.array_append(acc["done"], F.struct(acc["s"].alias("s"), acc["e"].alias("e")))).otherwise(acc["done"])
    step = lambda acc, x: F.when(x["s"] <= acc["e"], F.struct(acc["done"].alias("done"), acc["s"].alias("s"), F.greatest(acc["e"], x["e"]).alias("e"))).otherwise(
        F.struct(closed(acc).alias("done"), x["s"].alias("s"), x["e"].alias("e"))
    )
    return F.aggregate(F.array_sort(spans), start, step, closed)


def passage_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 51, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, class_id, n_links, n_passages, spans): a row for each document that shares a passage with another.

    class_id: the smallest id reachable by shared passages; n_links: pairs of passages, one in the document
    and one in any other, copies counted each; spans: its passages as start:end in words, ends exclusive,
    overlapping ones merged, ascending and comma-joined; n_passages: how many. See repeated_passages for
    options and edge cases; documents that share nothing have no row, nor has an empty table.
    """
    least = least_words - width + 1
    pieces = _pieces(docs, least, width, similarity, id_col, text_col)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: class x has similar stretches from s to e, n in all of its rows; 1: documents x and y are linked; 2: document x has n pairs with itself."""
        for known, links in _verified(batches, least, similarity):
            spans, total, own, edges, root = defaultdict(set), Counter(), Counter(), set(), {c: c for c in known}

            def top(c: int, root: dict = root) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            multi = {c: Counter(x["multi"]) for c, x in known.items() if x["multi"]}
            for a, b, got in links:
                for i, j, k, m in got:
                    spans[a["c"]].add((i, j + width - 1))
                    spans[b["c"]].add((k, m + width - 1))
                total[a["c"]] += len(got) * (b["n"] - (a is b))
                if a is not b:
                    total[b["c"]] += len(got) * a["n"]
                if a["c"] in multi and b["c"] in multi:
                    p, q = multi[a["c"]], multi[b["c"]]
                    for doc in p.keys() & q.keys():
                        own[doc] += len(got) * (p[doc] * (p[doc] - 1) if a is b else 2 * p[doc] * q[doc])
                if (x := top(a["c"])) != (y := top(b["c"])):
                    root[x] = y
                    edges.add((a["low"]["doc"], b["low"]["doc"]))
            rows = [(1, x, y, 0, 0, 0) for x, y in edges] + [(2, x, 0, 0, 0, n) for x, n in own.items() if n]
            for c, all_ in spans.items():
                merged: list[list[int]] = []
                for s, e in sorted(all_):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                rows += [(0, c, 0, s, e, 0 if k else total[c]) for k, (s, e) in enumerate(merged)]
            yield _rows(rows, ("kind", "x", "y", "s", "e", "n"))

    found = stored(_met(pieces, least, 1 - similarity).mapInArrow(sums, "kind long, x long, y long, s long, e long, n long"), release=True)
    place = F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))
    linked = found.where("kind = 0").groupBy("x", "s", "e").agg(F.sum("n").alias("n")).groupBy(F.col("x").alias("c")).agg(F.sum("n").alias("n"), F.collect_set(place).alias("all"))
    linked = linked.select("c", "n", _merged("all").alias("all"))
    lows = pieces.groupBy("c").agg(F.min("doc").alias("low"))
    members = stored(pieces.select("doc", "lo", "c").join(linked, "c").join(lows, "c"))
    groups = connected_components(found.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")).union(members.select("doc", "low")))
    moved = F.transform("all", lambda x: F.struct((x["s"] + F.col("lo")).cast("int").alias("s"), (x["e"] + F.col("lo")).cast("int").alias("e")))
    per = members.groupBy("doc").agg(F.sum("n").alias("n"), F.flatten(F.collect_list(moved)).alias("all"))
    own = found.where("kind = 2").groupBy(F.col("x").alias("doc")).agg(F.sum("n").alias("own"))
    per = per.join(own, "doc", "left").withColumn("n_links", F.col("n") - F.coalesce("own", F.lit(0))).where("n_links > 0").withColumn("merged", _merged("all"))
    return per.join(groups, F.col("doc") == F.col("node")).select(
        F.col("doc").alias(id_col), F.col("component").alias("class_id"), "n_links", F.size("merged").cast("long").alias("n_passages"),
        F.array_join(F.transform("merged", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("spans"),
    )
