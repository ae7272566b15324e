"""Licence notices, found through a positional index of rare licence words.

The document frequency of every word of the templates is counted over the whole corpus, and each place
of a word in a template is a posting. Of a document's licence words the rarest are looked up; the
difference of positions says where a template would start, with some slack for words put in or left out.
Where enough rare words agree the template is aligned with the document, and its key phrases must stand
there. The phrases to report exactly are templates as well, with themselves as key phrase.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening words of common licences, with the phrases that must be among them.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "without restriction"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["free software foundation"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["free and unencumbered software"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("boost", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software", ["boost software license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
]

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z to a-z, and every byte that no word has to a space. Bytes from 0x80 on belong to code points from there on.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    exact: bool


def _templates() -> list[Template]:
    exact = [Template(label, tuple(words(p)), (tuple(words(p)),), True) for p, label in PHRASES.items()]
    return exact + [Template(label, tuple(words(t)), tuple(tuple(words(k)) for k in keys), False) for label, t, keys in TEMPLATES]


def common_length(template: tuple[bytes, ...], doc: list[bytes]) -> int:
    """Words of the longest common subsequence, by bits of the template's places."""
    places: dict[bytes, int] = defaultdict(int)
    for i, w in enumerate(template):
        places[w] |= 1 << i
    all_ = (1 << len(template)) - 1
    row = all_
    for w in doc:
        held = row & places.get(w, 0)
        row = ((row + held) | (row - held)) & all_
    return len(template) - row.bit_count()


class Index:
    """Postings of the templates' words, and of each exact phrase's rarest word."""

    def __init__(self, idf: dict[bytes, float], rare: int = 6, agree: int = 3, least: float = 0.7) -> None:
        self.templates, self.rare, self.agree, self.least = _templates(), rare, agree, least
        rank = lambda w: (-idf.get(w, math.inf), w)
        self.exact: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        #: The words of each template that is aligned, the rarest first.
        self.ranked: dict[int, list[bytes]] = {}
        for k, t in enumerate(self.templates):
            ranked = sorted(set(t.words), key=rank)
            if t.exact:
                self.exact[ranked[0]] += [(k, at) for at, x in enumerate(t.words) if x == ranked[0]]
            else:
                self.ranked[k] = ranked
                for at, x in enumerate(t.words):
                    self.postings[x].append((k, at))
        self.known = frozenset(self.postings)

    def places(self, doc: list[bytes]) -> list[tuple[int, int, float]]:
        """(start, template, share of its words in order) of templates that pass, starts from 0."""
        found = set()
        there = set(doc)
        for w in there.intersection(self.exact):
            for at in [i for i, x in enumerate(doc) if x == w]:
                for k, p in self.exact[w]:
                    t = self.templates[k]
                    if at >= p and tuple(doc[at - p : at - p + len(t.words)]) == t.words:
                        found.add((at - p, k, 1.0))
        known = there & self.known
        # The rarest licence words that the document has, for each template that can pass with what is there and whose key phrases' words are.
        likely = {k: [w for w in ranked if w in known][: self.rare] for k, ranked in self.ranked.items() if self._can(k, known)}
        if likely:
            wanted = {w for ws in likely.values() for w in ws}
            at_word: dict[bytes, list[int]] = defaultdict(list)
            for i, w in enumerate(doc):
                if w in wanted:
                    at_word[w].append(i)
            for k, ws in likely.items():
                votes = sorted((at - p, p) for w in ws for t, p in self.postings[w] if t == k for at in at_word[w])
                found.update((start, k, share) for start, share in self._aligned(doc, k, votes))
        return sorted(found)

    def _can(self, k: int, known: set[bytes]) -> bool:
        t = self.templates[k]
        return all(w in known for key in t.keys for w in key) and sum(w in known for w in t.words) >= self.least * len(t.words)

    def _aligned(self, doc: list[bytes], k: int, votes: list[tuple[int, int]]) -> list[tuple[int, float]]:
        """(start, share) of template k where enough different places of it agree on a start, give or take the slack; places do not overlap."""
        t = self.templates[k]
        n, found, done = len(t.words), [], -1
        slack = max(3, n // 5)
        j = 0
        for i, (start, _) in enumerate(votes):
            while j < len(votes) and votes[j][0] <= start + slack:
                j += 1
            if start <= done or len({p for _, p in votes[i:j]}) < min(self.agree, len(self.ranked[k])):
                continue
            lo, hi = max(0, start - slack), max(0, votes[j - 1][0]) + n + slack
            part = doc[lo:hi]
            share = common_length(t.words, part) / n
            if share >= self.least and all(_has(part, key) for key in t.keys):
                found.append((max(0, start), share))
                done = start + n
        return found


def _has(doc: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    n = len(phrase)
    return any(tuple(doc[i : i + n]) == phrase for i in range(len(doc) - n + 1))


def licence_idf(docs: DataFrame, text_col: str = "text") -> dict[bytes, float]:
    """Inverse document frequency, over all rows, of each word of the templates: as many numbers as they have words."""
    vocabulary = frozenset(w for t in _templates() for w in t.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        rows = 0
        for b in batches:
            rows += b.num_rows
            for x in b.column(0):
                seen.update(vocabulary.intersection(words(x.as_py())))
        seen[b""] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {bytes(r.word): r.n for r in counts.collect()}
    total = df.pop(b"", 0)
    return {w: math.log((total + 1) / (df.get(w, 0) + 1)) for w in vocabulary}


def find_licences(docs: DataFrame, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, places), a row for each row of docs.

    Words are runs of 0-9, a-z and code points from U+0080 on, after A-Z became lower case. places: array
    of (start, label, exact, share) by start; exact ones are all places where a fixed phrase's words
    stand consecutively, the others templates of which at least the share least stands there in order, a
    fifth of its length apart at most, key phrases included. A null or empty text has no words and no places. Ids may be null or repeat and are
    passed on; other columns are not looked at. An empty table gives an empty one.
    """
    idf = licence_idf(docs, text_col)
    place = pa.struct([("start", pa.int64()), ("label", pa.string()), ("exact", pa.bool_()), ("share", pa.float64())])
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf, least=least)
        for b in batches:
            n, out = [], []
            for x in b.column(1):
                doc = words(x.as_py())
                n.append(len(doc))
                out.append([{"start": s, "label": index.templates[k].label, "exact": index.templates[k].exact, "share": q} for s, k, q in index.places(doc)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(out, pa.list_(place))], ["id", "n_words", "places"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = given.mapInArrow(run, f"id {id_type}, n_words long, places array<struct<start:long,label:string,exact:boolean,share:double>>")
    return made.select(F.col("id").alias(id_col), "n_words", "places")
