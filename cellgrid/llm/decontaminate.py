"""Benchmark passages in documents, re-parameterised ones included.

Texts become templates: numbers, units and (in a second reading) names are typed placeholders. Windows
of a template are hashed and joined with the windows of the benchmark's items; a document that holds
enough of an item's windows is aligned with it, and the values in its slots must follow from the
item's by one consistent substitution.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Units, as they stand after a number.
UNITS = frozenset(
    "% $ € £ ¥ ° mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs "
    "pound pounds oz ounce ounces t ton tons tonne tonnes ml l liter liters litre litres gallon gallons s sec second seconds min "
    "minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw kwh j kj cal kcal v a k °c °f "
    "mph kmh kph usd eur gbp dollar dollars cent cents euro euros percent degree degrees".split()
)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[%$€£¥°]")
#: Codes of placeholders; any other code is a literal word's hash.
NUM, UNIT, NAME = 1, 2, 3
_CAPITAL = 1 << 63
_MULTIPLIER, _FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Benchmark windows up to which their index is sent to all tasks; beyond, windows are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000


class Codes(dict):
    """A token's code in the plain reading (numbers are placeholders), worked out once for each token; the top bit marks capitals."""

    limit = 1 << 20

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token[0].isdigit() or low in NUMBER_WORDS:
            code = NUM
        else:
            code = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) | 4
        if len(self) >= self.limit:
            self.clear()
        if code > NAME:
            code = code | _CAPITAL if token[0].isupper() else code & ~_CAPITAL
        self[token] = code
        return code


class Reading(NamedTuple):
    tokens: list[str]
    plain: np.ndarray
    named: np.ndarray


def read(text: str | None, codes: Codes) -> Reading:
    tokens = TOKEN.findall(text or "")
    coded = np.array([codes[t] for t in tokens], np.uint64)
    for i in np.flatnonzero(coded[:-1] == NUM).tolist():
        if tokens[i + 1].lower() in UNITS:
            coded[i + 1] = UNIT
    capital = coded >= np.uint64(_CAPITAL)
    return Reading(tokens, coded & np.uint64(_CAPITAL - 1), np.where(capital, np.uint64(NAME), coded))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of width codes; of all of them where there are fewer; none of nothing."""
    n = len(codes)
    if not n:
        return np.empty(0, np.uint64)
    width = min(width, n)
    out = codes[: n - width + 1].copy()
    for k in range(1, width):
        out *= _MULTIPLIER
        out += codes[k : n - width + 1 + k]
    out ^= out >> np.uint64(31)
    out *= _FINISH
    return out


def readings(r: Reading, width: int) -> list[np.ndarray]:
    """Window hashes of the plain and of the named reading; of the latter only where two words in five are literal."""
    plain = window_hashes(r.plain, width)
    named = window_hashes(r.named, width) + np.uint64(1)
    if len(named):
        w = min(width, len(r.named))
        held = np.convolve((r.named > NAME).astype(np.int64), np.ones(w, np.int64), "valid")
        named = np.where(held * 5 >= 2 * w, named, np.uint64(0))
    return [plain, named]


class Item(NamedTuple):
    item_id: int
    reading: Reading
    windows: list[np.ndarray]


class Matcher:
    """Finds items in a document."""

    def __init__(self, items: list[tuple[int, str]], width: int, least: float, consistent: float) -> None:
        self.width, self.least, self.consistent, self.codes = width, least, consistent, Codes()
        self.items = [Item(i, r := read(t, self.codes), readings(r, width)) for i, t in items]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, item in enumerate(self.items):
            for way, hashes in enumerate(item.windows):
                for h in np.unique(hashes[hashes != 0]).tolist():
                    self.postings[h].append((k, way))
        #: Items shorter than a window stand in longer documents as they are: their tokens by number of tokens.
        self.short: dict[int, dict[tuple[str, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, item in enumerate(self.items):
            if 0 < len(item.reading.tokens) < width:
                self.short[len(item.reading.tokens)][tuple(t.lower() for t in item.reading.tokens)].append(k)
        self.all = np.array(sorted(self.postings), np.uint64)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.all >> np.uint64(46)] = True

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of hashes that some item has."""
        if not len(self.all):
            return np.empty(0, np.int64)
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(46)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.all, hashes[at]), len(self.all) - 1)
        return at[self.all[place] == hashes[at]]

    def find(self, text: str | None) -> list[tuple[int, float, float]]:
        """(item_id, share of the item's windows found, consistency of its slots), by item."""
        doc = read(text, self.codes)
        # Windows with few literal words need no sorting out here, as no item's index has them.
        ways = [window_hashes(doc.plain, self.width), window_hashes(doc.named, self.width) + np.uint64(1)]
        hits: Counter[tuple[int, int]] = Counter()
        for hashes in ways:
            at = self.known(hashes)
            if len(at):
                for h in set(hashes[at].tolist()):
                    hits.update(self.postings[h])
        best: dict[int, tuple[float, float]] = {}
        for (k, way), n in hits.items():
            own = self.items[k].windows[way]
            own = own[own != 0]
            share = n / len(np.unique(own))
            if share >= self.least and (way == 0 or len(own) * 2 >= len(self.items[k].windows[0])):
                first, each = self._places(ways[way], self.items[k], way)
                found = [(share, self._slots(doc, first, self.items[k], way))]
                if found[0][1] < 1:
                    found += [(part, self._slots(doc, at, self.items[k], way)) for part, at in self._occurrences(each, self.items[k], way)]
                for one in found:
                    if one[1] >= self.consistent:
                        best[k] = max(best.get(k, (0.0, 0.0)), one)
        low = [t.lower() for t in doc.tokens] if self.short else []
        for n, held in self.short.items():
            for at in range(len(low) - n + 1 if len(low) > n else 0):
                for k in held.get(tuple(low[at : at + n]), ()):
                    best[k] = (1.0, 1.0)
        return [(self.items[k].item_id, *best[k]) for k in sorted(best)]

    def _places(self, hashes: np.ndarray, item: Item, way: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(place in the document, place in the item) of windows in both: with the window's first place in the item, and with each."""
        where: dict[int, list[int]] = defaultdict(list)
        for i, h in enumerate(item.windows[way].tolist()):
            where[h].append(i)
        first, each = [], []
        for at in self.known(hashes).tolist():
            starts = where.get(int(hashes[at]))
            if starts:
                first.append((at, starts[0]))
                each += [(at, start) for start in starts]
        return first, each

    def _occurrences(self, each: list[tuple[int, int]], item: Item, way: int) -> Iterator[tuple[float, list[tuple[int, int]]]]:
        """(share, places) of each stretch of the document that holds the share least of the item's windows by itself.

        A stretch has one place for each place of the item: of those whose distance is the stretch's, give or
        take as much as may be missing or put in, the nearest.
        """
        windows = item.windows[way].tolist()
        many = len(set(windows) - {0})
        slack = max(self.width, len(windows) // 5)
        each = sorted(each, key=lambda p: p[0] - p[1])
        off = np.array([at - start for at, start in each], np.int64)
        for d in np.unique(off).tolist():
            lo, hi = np.searchsorted(off, [d - slack, d + slack + 1]).tolist()
            near: dict[int, int] = {}
            for at, start in each[lo:hi] if hi - lo >= self.least * many else ():
                if start not in near or abs(at - start - d) < abs(near[start] - start - d):
                    near[start] = at
            share = len({windows[start] for start in near}) / many
            if share >= self.least:
                yield share, [(at, start) for start, at in near.items()]

    def _slots(self, doc: Reading, places: list[tuple[int, int]], item: Item, way: int) -> float:
        """The share of slots whose value follows from the item's by the commonest substitution; 1 without slots."""
        codes = item.reading.plain if way == 0 else item.reading.named
        width = min(self.width, len(codes))
        pairs: dict[tuple[int, str], Counter[str]] = defaultdict(Counter)
        seen = set()
        for at, start in places:
            for j in range(width):
                code = int(codes[start + j])
                if code <= NAME and at + j < len(doc.tokens) and (start + j, at + j) not in seen:
                    seen.add((start + j, at + j))
                    pairs[code, item.reading.tokens[start + j].lower()][doc.tokens[at + j].lower()] += 1
        total = sum(sum(c.values()) for c in pairs.values())
        return sum(c.most_common(1)[0][1] for c in pairs.values()) / total if total else 1.0


SCHEMA = "item_id long, share double, consistency double"


def find_benchmark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 5,
    least: float = 0.8,
    consistent: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """(id_col, item_id, share, consistency): a row for each document and item that it holds.

    A window is width tokens (numbers, runs of letters, unit signs; case does not count). An item is held
    if at least the share least of its distinct windows is in the document, in the plain reading or in
    the one with names replaced, and at least the share consistent of its slots take values by one
    substitution, in the whole document or in one stretch that holds that share of windows by itself. Items
    and documents with fewer tokens than a window are one window; in a longer document such an item is held
    where its tokens stand as they are, in upper or lower case. Texts without tokens, and null ones, match
    nothing. Ids may be null or repeat: a row stands for each row of docs. Items
    with a null id or equal texts count as items of their own. Other columns are not looked at; where
    either table is empty so is the result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text"))
    size = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    fields = pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("consistency", pa.float64())])
    # A token has a character at least, and two readings make a window each: a bound without reading the items.
    if size <= broadcast_windows:
        held = [(r.item_id, r.item_text) for r in items.collect()]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held, width, least, consistent)
            for b in batches:
                found = [(i, hit) for i, x in enumerate(b.column(1)) for hit in matcher.find(x.as_py())]
                rows = pa.array([i for i, _ in found], pa.int64())
                cols = [pa.array([h[k] for _, h in found], fields[k].type) for k in range(3)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), *cols], ["id", "item_id", "share", "consistency"])

        return given.mapInArrow(scan, f"id {id_type}, {SCHEMA}").withColumnRenamed("id", id_col)

    def windows(batches: Iterator[pa.RecordBatch], item: bool, short: bool = True) -> Iterator[pa.RecordBatch]:
        """A row for each distinct window: (key, way, hash, how many the reading has). Way 2 is for items shorter than a window, as they are, if there are such."""
        codes = Codes()
        for b in batches:
            for key, x in zip(b.column(0), b.column(1), strict=True):
                reading = read(x.as_py(), codes)
                low = [t.lower().encode("utf-8", "surrogatepass") for t in reading.tokens]
                sizes = range(len(low), len(low) + (0 < len(low) < width)) if item else range(1, min(width, len(low)) if short else 1)
                plain = np.array([xxhash.xxh64_intdigest(b" ".join(low[i : i + n])) for n in sizes for i in range(len(low) - n + 1)], np.uint64)
                for way, h in enumerate([*readings(reading, width), plain]):
                    own = np.unique(h[h != 0]).view(np.int64)
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * n, pa.int64()), pa.array(np.full(n, way, np.int32)), pa.array(own), pa.array(np.full(n, n, np.int64))], ["key", "way", "h", "n"])

    schema = "key long, way int, h long, n long"
    keyed_docs = stored(given.withColumn("key", F.monotonically_increasing_id()))
    keyed_items = stored(items.withColumn("key", F.monotonically_increasing_id()))
    item_windows = stored(keyed_items.select("key", "item_text").mapInArrow(lambda b: windows(b, True), schema).select(F.col("key").alias("item_key"), "way", "h", "n"))
    short = bool(item_windows.where("way = 2").head(1))
    doc_windows = keyed_docs.select("key", "text").mapInArrow(lambda b: windows(b, False, short), schema).select("key", "way", "h")
    shared = (
        doc_windows.join(item_windows, ["way", "h"]).groupBy("key", "item_key", "way", "n").agg(F.count("*").alias("hits"))
        .where(F.col("hits") >= least * F.col("n")).select("key", "item_key").distinct()
    )
    pairs = shared.join(keyed_docs, "key").join(keyed_items.withColumnRenamed("key", "item_key"), "item_key").select("id", "text", "item_id", "item_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, (text, item, item_text) in enumerate(zip(b.column(1), b.column(2), b.column(3), strict=True)):
                for hit in Matcher([(item.as_py(), item_text.as_py())], width, least, consistent).find(text.as_py()):
                    rows.append(i)
                    out.append(hit)
            cols = [pa.array([h[k] for h in out], fields[k].type) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *cols], ["id", "item_id", "share", "consistency"])

    return pairs.mapInArrow(verify, f"id {id_type}, {SCHEMA}").withColumnRenamed("id", id_col)
