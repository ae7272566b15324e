"""Secrets in texts: fixed patterns, and strings that a primed compressor finds nothing like.

A candidate is a long mixed string close to a sensitive word. What it adds to the compressed size of
the text around it, with a compressor primed by a dictionary of identifiers, is its novelty: names
made of known parts cost few bytes, random strings nearly as many as they have.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's patterns, in its order, with the least length of the whole match, or of group 2.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
BASE_KINDS = KINDS[:3]

#: Strings worth measuring, and the words that make their surroundings sensitive.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: Characters that are measured at a time: the cost of a longer string is the sum of its blocks'.
MEASURE = 512
SENSITIVE = re.compile(r"key|secret|token|passw|pwd|auth|bearer|credential|private|signature|session|cookie|connection", re.I | re.A)
MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])")
#: Identifiers and words that code has around secrets.
IDENTIFIERS = (
    "access account action address admin algorithm alias allow api app application args array async attribute auth authorization "
    "backend base64 bearer binary body bool branch buffer bucket build bytes cache callback certificate channel charset class client "
    "cluster code column command commit config connection const container content context cookie count create credential current "
    "data database date debug default define delete description device dict directory document domain download element email enable "
    "encoding endpoint environment error event example exception expires export false field file filter float format frame function "
    "gateway generate get global group handler hash header host http https identifier image import index info init input instance "
    "integer interface internal item json key label length level library license limit link list local location log login manager "
    "max message metadata method min mode model module name namespace network node null number object offset operation option order "
    "output package page parameter parent password path pattern payload permission platform plugin policy port prefix private process "
    "profile project property protocol provider proxy public query queue random range record reference region register release remote "
    "request resource response result return role root route schema scope script secret section security select self server service "
    "session set setting signature size source stage start state static status storage stream string struct style subject table tag "
    "target task template test text thread timeout timestamp title token trace transaction true type update upload url user username "
    "utf-8 uuid value variable version view void volume webhook width window worker write xml yaml zone "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ https://www. .example.com/ .org .net"
).encode()


class Novelty:
    """Bytes that a string adds to the compressed size of what is around it."""

    def __init__(self, around: int = 192) -> None:
        self.around = around
        prime = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=9, dict_data=prime, write_checksum=False, write_content_size=False, write_dict_id=False)

    def __call__(self, text: str, start: int, end: int) -> int:
        left = text[max(0, start - self.around) : start]
        right = text[end : end + self.around]
        size = lambda *parts: len(self.packer.compress("".join(parts).encode("utf-8", "surrogatepass")))
        return size(left, right, text[start:end]) - size(left, right)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, ascending; leftmost and non-overlapping for each kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty, near: int, least_ratio: float) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, bytes) of strings outside the taken spans that hardly compress in sensitive surroundings."""
    found = []
    # Taken spans as ascending stretches that do not overlap, to be searched instead of looked through.
    starts: list[int] = []
    stops: list[int] = []
    for s, _, e in taken:
        if stops and s < stops[-1]:
            stops[-1] = max(stops[-1], e)
        else:
            starts.append(s)
            stops.append(e)

    def touched(i: int, j: int) -> bool:
        at = bisect_right(stops, i)
        return at < len(starts) and starts[at] < j

    for m in CANDIDATE.finditer(text):
        ends = [*range(m.start(), m.end(), MEASURE), m.end()]
        costs: dict[int, int] = {}
        k = 0
        while k < len(ends) - 1:
            i, best = ends[k], None
            if ends[k + 1] - i >= 16 and MIXED.match(text[i : ends[k + 1]]) and SENSITIVE.search(text, max(0, i - near), i):
                cost = 0
                for b in range(k, len(ends) - 1):
                    if touched(ends[b], ends[b + 1]):
                        break
                    if b not in costs:
                        costs[b] = novelty(text, ends[b], ends[b + 1])
                    cost += costs[b]
                    if cost >= least_ratio * (ends[b + 1] - i):
                        best = (b + 1, cost)
            if best:
                found.append((i, 3, ends[best[0]], best[1]))
            k = best[0] if best else k + 1
    return found


def find_secrets(
    docs: DataFrame, near: int = 48, least_ratio: float = 0.75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, spans), a row for each row of docs.

    spans: array of (kind, start, end, value, novelty) by start, then kind as in KINDS; code points, end
    exclusive. assign, access and hex are the fixed patterns and have no novelty. novel: strings of 16
    characters or more with letters and digits, at most near characters after a sensitive word, not touching
    a fixed pattern's span, that add at least least_ratio bytes a character to the compressed text around
    them; longer ones are measured by blocks of MEASURE characters and reach as far as all of them together
    do so. A null or empty text has no spans. Ids may be null or repeat and are passed on; other columns
    are not looked at. An empty table gives an empty one.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("novelty", pa.int64())])
    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in batches:
            out = []
            for x in b.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                both = [(*s, None) for s in base] + novel_spans(text, base, novelty, near, least_ratio)
                both.sort(key=lambda s: s[:3])
                out.append([{"kind": KINDS[k], "start": i, "end": j, "value": text[i:j], "novelty": c} for i, k, j, c in both])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(span))], ["id", "spans"])

    made = given.mapInArrow(run, f"id {id_type}, spans array<struct<kind:string,start:long,end:long,value:string,novelty:long>>")
    return made.select(F.col("id").alias(id_col), "spans")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
