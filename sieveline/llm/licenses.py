"""License texts in documents: an exact set-similarity join of text blocks with templates, by containment.

A template of L words is looked for in blocks of w words, w the least power of two that is twice L at least, which
begin every w / 2 words: any copy lies whole in one of them. A block is linked where it holds `least` of the
template's different words. Words are ordered by the number of documents that hold them, the rarest first, and three
filters leave few pairs to compare: block and template must share a word of both their prefixes (with a smaller
overlap than the threshold's outside of them), the block must have enough words that any template has, and what
follows the shared word in both must be able to make up the threshold. None of them loses a link.

Templates are given by the caller and bounded, so that they and the order of their words go to every task; documents
are read twice, once for the counts and once for the join, and nothing but counts is shuffled.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that name a license, and the words of notices and licenses as their owners publish them.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
)

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(data: bytes) -> list[bytes]:
    """Words of a text in UTF-8, with A-Z in lower case; all bytes of characters beyond ASCII belong to words."""
    return _WORD.findall(data.lower())


@dataclass(frozen=True)
class Template:
    label: str
    words: frozenset[bytes]
    #: Words of a block.
    width: int
    #: Words that a block must share with it.
    need: int


def template(label: str, text: str, least: float) -> Template | None:
    """None for a text without words."""
    said = words_of(text.encode())
    different = frozenset(said)
    return Template(label, different, 1 << (2 * len(said) - 1).bit_length(), max(1, math.ceil(round(least * len(different), 9)))) if said else None


class Index:
    """Templates of one block width, by the words of their prefixes. Words are numbers in the global order, the rarest first."""

    def __init__(self, width: int, templates: Sequence[tuple[str, list[int], int]]):
        self.width, self.templates = width, [(label, frozenset(order), need, len(order)) for label, order, need in templates]
        self.least = min(need for _, _, need in templates)
        self.prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, order, need) in enumerate(templates):
            for i, word in enumerate(order[: len(order) - need + 1]):
                self.prefix[word].append((k, i))

    def links(self, block: list[int]) -> Iterator[tuple[int, int]]:
        """(template, shared words) of a block: its different words in the global order."""
        n, seen = len(block), set()
        for j, word in enumerate(block[: n - self.least + 1]):
            for k, i in self.prefix.get(word, ()):
                _, words, need, size = self.templates[k]
                # length, then position: a pair that is turned down at its first shared prefix word may come again at its next, which can only leave less
                if k in seen or n < need or 1 + min(size - i - 1, n - j - 1) < need:
                    continue
                seen.add(k)
                if (shared := len(words.intersection(block))) >= need:
                    yield k, shared

    def search(self, places: list[int], numbers: list[int], n_words: int) -> Iterator[tuple[str, int, int, float]]:
        """(label, first word, end, containment) of every block and template linked. places, numbers: where the text has words of templates, and which."""
        step = self.width // 2
        blocks = {b for p, w in zip(places, numbers, strict=True) if w in self.prefix for b in (p // step - 1, p // step) if b >= 0}
        for b in sorted(blocks):
            lo, hi = bisect.bisect_left(places, b * step), bisect.bisect_left(places, b * step + self.width)
            if hi - lo >= self.least and len(block := sorted(set(numbers[lo:hi]))) >= self.least:
                for k, shared in self.links(block):
                    label, _, _, size = self.templates[k]
                    yield label, b * step, min(b * step + self.width, n_words), shared / size


def named_places(words: list[bytes], phrases: Mapping[bytes, Sequence[tuple[list[bytes], str]]]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand one after the other. phrases: by their last word."""
    found = []
    for last, group in phrases.items():
        at = -1
        for _ in range(words.count(last)):
            at = words.index(last, at + 1)
            for phrase, label in group:
                first = at + 1 - len(phrase)
                if first >= 0 and words[first : at + 1] == phrase:
                    found.append((first, label))
    return found


def word_counts(docs: DataFrame, wanted: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How many documents hold each of the wanted words, a bounded set. A batch sends one row a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(wanted.intersection(words_of(text.as_py() or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


FOUND = "array<struct<label:string,start:long,end:long,containment:double>>"


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = 0.8, phrases: Mapping[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found (the blocks linked, by place and label).

    The score is the highest containment found, 1 where a phrase stands, else 0. Null and empty texts have no words and
    no labels; null ids stay; repeated rows stay rows of their own; an empty table gives no rows. Words equally frequent
    are ordered by themselves; templates without words are left out, and templates of equal texts all link. A text is
    searched in time in proportion to its length, in one task. Other columns are not looked at.
    """
    known = [t for label, text in templates if (t := template(label, text, least))]
    vocabulary = frozenset().union(*(t.words for t in known))
    counts = word_counts(docs, vocabulary, text_col)
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    widths = sorted({t.width for t in known})
    ranked = {w: [(t.label, sorted(order[x] for x in t.words), t.need) for t in known if t.width == w] for w in widths}
    named: dict[bytes, list[tuple[list[bytes], str]]] = defaultdict(list)
    for said, label in phrases.items():
        named[words_of(said.encode())[-1]].append((words_of(said.encode()), label))
    kinds = (pa.int64(),) * 5 + (pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [Index(w, ranked[w]) for w in widths]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py() or b"")
                base = named_places(words, named)
                numbers = [(p, n) for p, w in enumerate(words) if (n := order.get(w)) is not None]
                places, numbers = [p for p, _ in numbers], [n for _, n in numbers]
                found = [f for index in indexes for f in index.search(places, numbers, len(words))]
                said = {label for _, label in base}
                score = 1.0 if base else max((f[3] for f in found), default=0.0)
                starts = [p for p, _ in base]
                structs = [dict(zip(("label", "start", "end", "containment"), f, strict=True)) for f in sorted(found, key=lambda f: (f[1], f[2], f[0]))]
                rows.append((doc, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(said)), ",".join(sorted(said | {f[0] for f in found})), score, structs))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    schema = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found {FOUND}"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def scan_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = 0.8, phrases: Mapping[str, str] = PHRASES) -> str:
    """`scan` without `found` over documents in DuckDB's SQL: every block against every template of its width, without filters."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    known = [t for label, text in templates if (t := template(label, text, least))]
    rows = ", ".join(f"('{t.label}', {listed(sorted(w.decode() for w in t.words))}, {t.width}, {t.need})" for t in known)
    said = ", ".join(f"({listed(p.split())}, '{label}', {len(p.split())})" for p, label in phrases.items())
    return rf"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
t(label, said, width, need) AS (VALUES {rows}),
p(phrase, label, n) AS (VALUES {said}),
places AS (SELECT r, label, unnest(list_filter(range(0, len(words) - n + 1), lambda i: words[i + 1 : i + n] = phrase)) AS spot FROM w, p),
base AS (SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_sort(list(DISTINCT label)) AS b FROM places GROUP BY r),
blocks AS (SELECT r, words, width, unnest(range(0, len(words), width // 2)) AS start FROM w, (SELECT DISTINCT width FROM t)),
linked AS (SELECT r, label, len(list_intersect(words[start + 1 : start + b.width], said)) AS shared, need, len(said) AS size FROM blocks b JOIN t ON b.width = t.width),
own AS (SELECT r, list(DISTINCT label) AS l, max(shared / size) AS best FROM linked WHERE shared >= need GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b, []), coalesce(l, [])))), ','), '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN own USING (r)"""
