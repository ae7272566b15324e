"""SimHash near-duplicates: fingerprints, and a binary-trie self-join of them.

Fingerprints are made in Arrow batches. Distinct ones, in ascending order, are the leaves of a binary
trie; the trie is cut into blocks of neighbouring leaves, and pairs of blocks whose common prefixes
differ in no more bits than allowed go to tasks. A task walks node pairs of its two blocks together,
adds up differing bits, drops a pair once the budget is exceeded, and returns only a spanning forest
of the links it finds. Components of all forests are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

#: Leaves of a block, and blocks at most: beyond MAX_BLOCKS * BLOCK leaves, blocks grow instead.
BLOCK, MAX_BLOCKS = 16_384, 4_096
#: Leaves of a block of a lane: every block goes to all blocks near it, so that fewer and larger ones move less.
LANE_BLOCK = 1 << 19
#: Node pairs that a task holds in one step of its walk.
FRONTIER = 1 << 16
_SIGN = np.uint64(1 << 63)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the text's shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
        h = xxhash.xxh64_intdigest
        hashes = [h(line[i:j], seed) for i, j in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = np.array(hashes[k : k + 65_536], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a long."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"", width, seed) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return given.mapInArrow(run, "id long, fp long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; parents point to smaller numbers."""
    while i.size:
        i, j = _roots(parent, i), _roots(parent, j)
        apart = i != j
        i, j = i[apart], j[apart]
        hi, lo = np.maximum(i, j), np.minimum(i, j)
        np.minimum.at(parent, hi, lo)


def _near_pairs(fps: np.ndarray, split: int | None, budget: int, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of ascending distinct fps within budget bits, some at a time.

    split None: all pairs; else pairs of a leaf before split with one from there on. Each step takes the
    deepest node pairs first, so few are held; a pair of single leaves is settled at once. With group, a
    number for each leaf, only pairs of leaves of different groups: node pairs within one are not walked.
    """
    n = len(fps)
    if group is not None and n:
        ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n)
        until = ends[np.searchsorted(ends, np.arange(n), side="right")]  # where the run of leaves of one group ends
    if n < 2 or (split is not None and not 0 < split < n):
        return
    first = (0, n, 0, n) if split is None else (0, split, split, n)
    stack = [(63, np.array([[*first, 0]], np.int64))]
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack.append((bit, pairs[FRONTIER:]))
            pairs = pairs[:FRONTIER]
        single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        if single.any():
            i, j = pairs[single, 0], pairs[single, 2]
            near = (i != j) & (_bits(fps[i] ^ fps[j]) <= budget)
            yield i[near], j[near]
            pairs = pairs[~single]
        if not len(pairs) or bit < 0:
            continue
        lo_a, hi_a, lo_b, hi_b, spent = pairs.T
        mid_a, mid_b = _middle(fps, lo_a, hi_a, bit), _middle(fps, lo_b, hi_b, bit)
        own = (lo_a == lo_b) & (hi_a == hi_b)
        kids = []
        for low_a, high_a, low_b, high_b, cost, ok in (
            (lo_a, mid_a, lo_b, mid_b, 0, None),
            (mid_a, hi_a, mid_b, hi_b, 0, None),
            (lo_a, mid_a, mid_b, hi_b, 1, None),
            (mid_a, hi_a, lo_b, mid_b, 1, ~own),
        ):
            good = (low_a < high_a) & (low_b < high_b) & (spent + cost <= budget)
            good &= ~((low_a == low_b) & (high_a - low_a == 1) & (high_b - low_b == 1))
            if ok is not None:
                good &= ok
            if group is not None:
                at, to = np.minimum(low_a, n - 1), np.minimum(low_b, n - 1)
                good &= ~((group[at] == group[to]) & (until[at] >= high_a) & (until[to] >= high_b))
            if good.any():
                kids.append(np.stack((low_a[good], high_a[good], low_b[good], high_b[good], spent[good] + cost), axis=1))
        if kids:
            stack.append((bit - 1, np.concatenate(kids)))


def trie_links(fps: np.ndarray, split: int | None, budget: int) -> np.ndarray:
    """Each leaf's root in a forest that joins the pairs of _near_pairs."""
    parent = np.arange(len(fps))
    for i, j in _near_pairs(fps, split, budget):
        _unite(parent, i, j)
    return _roots(parent, np.arange(len(fps)))


def trie_partners(fps: np.ndarray, split: int | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf that has any, a closest leaf of _near_pairs; of equals one that a hash picks."""
    none = np.uint64(~np.uint64(0))
    best = np.full(len(fps), none)
    for i, j in _near_pairs(fps, split, budget):
        gap = _bits(fps[i] ^ fps[j]).astype(np.uint64) << np.uint64(57)
        pick = ((fps[i] ^ fps[j]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(47)) << np.uint64(40)
        np.minimum.at(best, i, gap | pick | j.astype(np.uint64))
        np.minimum.at(best, j, gap | pick | i.astype(np.uint64))
    own = np.flatnonzero(best != none)
    return own, (best[own] & np.uint64((1 << 40) - 1)).astype(np.int64)


def trie_apart(fps: np.ndarray, group: np.ndarray, split: np.uint64 | None, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of places of ascending fps, which may repeat, within budget bits and of different groups, some at a time.

    split None: all pairs; else pairs of an fp below split with one from there on.
    """
    leaf, start = np.unique(fps, return_index=True)
    end = np.append(start[1:], len(fps))
    low, high = (f.reduceat(group, start) if len(fps) else group for f in (np.minimum, np.maximum))
    # A leaf of several groups is one of its own: a number that no other leaf has.
    label = np.where(low == high, np.unique(group, return_inverse=True)[1][start] if len(fps) else group, -1 - np.arange(len(leaf)))

    def spread(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the leaves i, each with all places of its leaf j, about FRONTIER pairs at a time."""
        many = (end[i] - start[i]) * (end[j] - start[j])
        for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(many) // FRONTIER)) + 1):
            k = np.repeat(part, many[part])
            nth = np.arange(len(k)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
            size = end[j[k]] - start[j[k]]
            x, y = start[i[k]] + nth // size, start[j[k]] + nth % size
            apart = group[x] != group[y]
            yield x[apart], y[apart]

    if split is None:
        own = np.flatnonzero(low != high)
        for x, y in spread(own, own):
            yield x[x < y], y[x < y]
    for i, j in _near_pairs(leaf, None if split is None else int(np.searchsorted(leaf, split)), budget, label):
        yield from spread(i, j)


def _middle(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where in each range of leaves, alike above bit, the first with that bit set is."""
    base = (fps[lo] >> np.uint64(bit) | np.uint64(1)) << np.uint64(bit)
    return np.clip(np.searchsorted(fps, base), lo, hi)


def _near_blocks(bounds: np.ndarray, budget: int) -> list[np.ndarray]:
    """For each block, the blocks from it on whose leaves' common prefix can be within budget."""
    lo, hi = np.concatenate(([np.uint64(0)], bounds)), np.concatenate((bounds - np.uint64(1), [~np.uint64(0)]))
    gap = lo ^ hi
    for s in (1, 2, 4, 8, 16, 32):
        gap |= gap >> np.uint64(s)  # ones from the first differing bit down
    return [i + np.flatnonzero(_bits((lo[i] ^ lo[i:]) & ~(gap[i] | gap[i:])) <= budget) for i in range(len(lo))]


def _block_pairs(near: list[np.ndarray]) -> list[np.ndarray]:
    """For each block the numbers i * MAX_BLOCKS + j of the pairs i <= j of near blocks that it is in."""
    first = np.repeat(np.arange(len(near)), [len(x) for x in near])
    second = np.concatenate(near)
    pair = first * MAX_BLOCKS + second
    apart = first != second
    block, pair = np.concatenate((first, second[apart])), np.concatenate((pair, pair[apart]))
    order = np.argsort(block, kind="stable")
    return np.split(pair[order], np.searchsorted(block[order], np.arange(1, len(near))))


def fingerprint_links(nodes: DataFrame, budget: int = 2, block: int = BLOCK, partners: bool = False, *, apart: bool = False) -> DataFrame:
    """(lane, a, b): links between reps of fingerprints of one lane within budget bits.

    nodes: (lane, fp, rep), fp distinct in a lane. The links are enough to join what is near; with partners
    they are pairs near themselves, a closest one for each fingerprint and pair of blocks. With apart, nodes
    has a column group too, fp may repeat, and the links are all pairs of different groups, equal fp
    included. Block bounds are quantiles, at most MAX_BLOCKS numbers for each lane on the driver.
    """
    sizes = nodes.groupBy("lane").agg(F.count("*").alias("n")).agg(F.max("n")).first()
    n = sizes[0] or 0
    blocks = max(1, min(MAX_BLOCKS, -(-n // block)))
    unsigned = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # a long that sorts as fp without sign
    cuts: dict[int, list[int]] = {r[0]: [] for r in nodes.select("lane").distinct().collect()}
    if blocks > 1:
        shares = [i / blocks for i in range(1, blocks)]
        cuts = {r[0]: sorted(set(r[1])) for r in nodes.groupBy("lane").agg(F.percentile_approx(unsigned, shares, 20 * blocks)).collect()}
    bounds = {lane: np.array(c, np.int64).view(np.uint64) ^ _SIGN for lane, c in cuts.items()}
    # For each block the pairs that it is in, worked out once.
    pairs_of = {lane: _block_pairs(_near_blocks(b, budget)) for lane, b in bounds.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lanes, fps, reps, groups = (b.column(c).to_numpy() for c in ("lane", "fp", "rep", "group"))
            for lane in np.unique(lanes):
                on = lanes == lane
                fp, rep, group = fps[on].view(np.uint64), reps[on], groups[on]
                at = np.searchsorted(bounds[lane], fp, side="right")
                for k in np.unique(at):
                    own = at == k
                    data = (fp[own].tobytes(), rep[own].tobytes(), group[own].tobytes() if apart else b"")
                    keys = pairs_of[lane][k] + int(lane) * MAX_BLOCKS**2
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array([x] * len(keys), pa.binary()) for x in data]], ["pair", "fps", "reps", "groups"])

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.frombuffer(b"".join(pdf["fps"]), np.uint64)
        rep = np.frombuffer(b"".join(pdf["reps"]), np.int64)
        lane, i, j = int(key[0]) // MAX_BLOCKS**2, int(key[0]) // MAX_BLOCKS % MAX_BLOCKS, int(key[0]) % MAX_BLOCKS
        order = np.argsort(fp, kind="stable")
        fp, rep = fp[order], rep[order]
        if apart:
            group = np.frombuffer(b"".join(pdf["groups"]), np.int64)[order]
            found = list(trie_apart(fp, group, None if i == j else bounds[lane][j - 1], budget)) or [(order[:0], order[:0])]
            own, other = (np.concatenate(x) for x in zip(*found, strict=True))
            return pd.DataFrame({"lane": lane, "a": rep[own], "b": rep[other]})
        split = None if i == j else int(np.searchsorted(fp, bounds[lane][j - 1]))
        if partners:
            own, other = trie_partners(fp, split, budget)
        else:
            root = trie_links(fp, split, budget)
            own = np.flatnonzero(root != np.arange(len(fp)))
            other = root[own]
        return pd.DataFrame({"lane": lane, "a": rep[own], "b": rep[other]})

    dealt = nodes.select("lane", "fp", "rep", F.col("group") if apart else F.lit(0).cast("long").alias("group")).mapInArrow(deal, "pair long, fps binary, reps binary, groups binary")
    return dealt.groupBy("pair").applyInPandas(walk, "lane int, a long, b long")


def simhash_groups(
    docs: DataFrame, budget: int = 2, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, fingerprint, component_id), a row for each row of docs.

    Words are runs of other bytes than ASCII white space, A-Z in lower case; shingles of width words,
    repeats included (fewer words: the whole sequence; none or a null text: fingerprint zero).
    Fingerprints link at budget or fewer differing bits; component_id is the smallest id reachable by
    links, the document's own included. Ids are longs; rows of one id count as separate documents; a
    row with a null id gets its group's smallest other id, or null if there is none. Other columns are
    not looked at. An empty table gives an empty one.
    """
    made = stored(with_fingerprints(docs, id_col, text_col, width, seed))
    nodes = stored(made.where(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("rep")))
    links = fingerprint_links(nodes.select(F.lit(0).alias("lane"), "fp", F.col("fp").alias("rep")), budget)
    groups = connected_components(links)
    named = nodes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("group"), "rep")
    least = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    ids = named.select("fp", "group").join(least, "group").select("fp", "component_id")
    out = made.join(ids, "fp", "left")
    return out.select(F.col("id").alias(id_col), hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def lanes_of(text: bytes, lanes: int, width: int, seed: int = 42) -> np.ndarray:
    """`lanes` independent 32-bit fingerprints of the distinct shingles, each in the upper half of a 64-bit number."""
    words = text.lower().split()
    parts = {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} or {b" ".join(words)}
    base = np.array([xxhash.xxh64_intdigest(p, seed) for p in parts], np.uint64)
    out = np.empty(lanes, np.uint64)
    for k in range(0, lanes, 2):
        x = base + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total = np.zeros(64, np.int64)
        for s in range(0, len(x), 65_536):
            total += np.unpackbits(x[s : s + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(2 * total > len(x), bitorder="little").view(np.uint64)[0]
        out[k] = (bits >> np.uint64(32)) << np.uint64(32)
        if k + 1 < lanes:
            out[k + 1] = bits << np.uint64(32)
    return out


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """32-bit hashes of the distinct shingles, ascending."""
    words = text.lower().split()
    parts = {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} or {b" ".join(words)}
    return np.unique(np.array([xxhash.xxh32_intdigest(p) for p in parts], np.uint32))


def near_duplicate_groups(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, lanes: int = 16, budget: int = 2, lane_width: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, component_id), a row for each row of docs: groups of documents whose sets of shingles are similar.

    Texts with the same words are one node. Nodes meet if one of `lanes` independent 32-bit fingerprints
    (of distinct lane_width-word shingles) differs in at most budget bits: first in each lane a node with one of its
    equals and a closest other, then all pairs that these have not joined yet. Pairs link if the Jaccard
    similarity of their width-word shingle sets is at least `similarity`; component_id is the smallest id
    reachable. Equal word sequences always meet; of pairs at a similarity of 0.8 some 98 % do, of closer
    ones nearly all. Null ids keep to themselves (component_id null) unless their words equal another's; a
    null text is an empty one, and texts without words are one group. Other columns are not looked at.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [xxhash.xxh3_128_intdigest(b" ".join(x.as_py().lower().split())) for x in b.column(1)]
            made = [lanes_of(x.as_py(), lanes, lane_width).view(np.int64).tolist() for x in b.column(1)]
            high = np.array([w >> 64 for w in words], np.uint64).view(np.int64)
            low = np.array([w & (1 << 64) - 1 for w in words], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(high), pa.array(low), pa.array(made, pa.list_(pa.int64()))], ["id", "wh", "wl", "fps"])

    made = stored(given.mapInArrow(run, "id long, wh long, wl long, fps array<long>"))
    nodes = stored(made.where(F.col("id").isNotNull()).groupBy("wh", "wl").agg(F.min("id").alias("rep"), F.min("fps").alias("fps")), release=True)
    each = nodes.select("rep", F.posexplode("fps").alias("lane", "fp"))
    # One of those with equal lanes stands for them, another in each lane.
    first = stored(each.groupBy("lane", "fp").agg(F.min(F.struct(F.xxhash64("lane", "rep").alias("h"), "rep"))["rep"].alias("first"), F.count("*").alias("n")), release=True)
    equal = each.join(stored(first.where("n > 1").drop("n")), ["lane", "fp"]).where(F.col("rep") != F.col("first")).select(F.col("rep").alias("a"), F.col("first").alias("b"))
    close = stored(fingerprint_links(first.select("lane", "fp", F.col("first").alias("rep")), budget, LANE_BLOCK, partners=True), release=True)
    ordered = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = equal.union(close.select("a", "b")).where("a <> b").select(*ordered).distinct()
    # All lanes together tell how similar two documents can be; what is far off is not compared in full.
    wide = nodes.select(F.col("rep").alias("a"), F.col("fps").alias("fa"))
    gap = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x.as_py(), width).tobytes() for x in b.column(1)], pa.binary())], ["id", "sh"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                common = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(common >= similarity * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def similar(pairs: DataFrame) -> DataFrame:
        likely = stored(pairs.join(wide, "a").join(wide.select(F.col("a").alias("b"), F.col("fa").alias("fb")), "b").where(gap <= int(32 * lanes * 0.22)).select("a", "b"))
        wanted = stored(likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct())
        # A node's text is that of its smallest id; of rows that share an id any may stand for it.
        held = stored(given.join(wanted, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(sets, "id long, sh binary"))
        both = likely.join(held.select(F.col("id").alias("a"), F.col("sh").alias("sa")), "a").join(held.select(F.col("id").alias("b"), F.col("sh").alias("sb")), "b")
        return stored(both.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long"), release=True)

    links = similar(pairs)
    groups = connected_components(links)
    # Only lane values that are near others, or that three nodes or more have, can have pairs that were not tried.
    more = stored(close.select("lane", F.explode(F.array("a", "b")).alias("first")).union(first.where("n > 2").select("lane", "first")).distinct())
    values = stored(first.join(more, ["lane", "first"], "left_semi").select("lane", "fp"))
    again = each.join(values, ["lane", "fp"], "left_semi").join(groups, F.col("rep") == F.col("node"), "left")
    again = stored(again.select("lane", "fp", "rep", F.coalesce("component", "rep").alias("group")))
    rest = fingerprint_links(again, budget, LANE_BLOCK, apart=True).select(*ordered).distinct()
    groups = connected_components(links.union(similar(rest)))
    named = nodes.join(groups, F.col("rep") == F.col("node"), "left").select("wh", "wl", F.coalesce("component", "rep").alias("component_id"))
    return made.join(named, ["wh", "wl"], "left").select(F.col("id").alias(id_col), "component_id")
