"""Licence scan with a positional rare-token index over licence texts, notices and names.

The index holds, for every licence word, its postings (template, place). Of each template, the file's highest-IDF words
that it holds are looked up; their postings, moved to the template's start, are intersected by relative position: where at
least two of them (the whole template, if it has fewer words) agree within a few words, the mandatory key phrases are
verified and the share of the template's IDF weight found in place is the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Base phrases: each place where the words stand one after another counts.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Names by which a licence is told: (label, the words).
NAMES = (
    ("apache-2.0", "apache license"), ("bsd", "bsd license"), ("cc-by-nc", "cc by nc"), ("cc-by-sa", "cc by sa"), ("gpl-notice", "gnu general public license"), ("isc", "isc license"),
    ("lgpl", "gnu lesser general public license"), ("mit", "mit license"), ("mpl-2.0", "mozilla public license"), ("unlicense", "released into the public domain"),
)
#: Texts and notices of licences: (label, mandatory key phrases, the text).
TEXTS = (
    ("apache-2.0", ("licensed under the apache license",), "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2 0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", ("redistribution and use in source and binary forms",), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("gpl-notice", ("gnu general public license", "free software"), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("isc", ("permission to use copy modify and or distribute",), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit-text", ("permission is hereby granted free of charge",), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", ("mozilla public license",), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http mozilla org MPL 2 0"),
    ("unlicense", ("free and unencumbered software",), "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non commercial, and by any means."),
    ("warranty", ("without warranty of any kind",), "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
)


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _find(words: list[bytes], phrase: list[bytes]) -> list[int]:
    return [p for p in range(len(words) - len(phrase) + 1) if words[p : p + len(phrase)] == phrase]


class Template(NamedTuple):
    label: str
    words: list[bytes]
    keys: list[tuple[int, list[bytes]]]  # place in the template, the phrase
    base: bool


def templates() -> list[Template]:
    out = [Template(label, words_of(text), [], True) for label, text in BASE.items()]
    out += [Template(label, words_of(text), [(0, words_of(text))], False) for label, text in NAMES]
    for label, keys, text in TEXTS:
        words = words_of(text)
        out.append(Template(label, words, [(_find(words, words_of(k))[0], words_of(k)) for k in keys], False))
    return out


class Index:
    """Postings (template, place) of every licence word, with the words' IDF."""

    def __init__(self, df: dict[bytes, int], n_docs: int, anchors: int = 6):
        self.templates, self.anchors = templates(), anchors
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1e-9 for t in self.templates for w in t.words}
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(dict)
        for n, t in enumerate(self.templates):
            for p, w in enumerate(t.words):
                self.postings[w].setdefault(n, []).append(p)
        self.total = [sum(self.idf[w] for w in t.words) for t in self.templates]

    def scan(self, words: list[bytes], slack: int = 2, least: float = 0.5) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, base labels, all labels, and the best IDF share of a template found in place."""
        starts: list[int] = []
        base_labels, labels, score = set(), set(), 0.0
        at: dict[bytes, list[int]] = {}  # the file's places of every licence word
        for p, w in enumerate(words):
            if w in self.postings:
                at.setdefault(w, []).append(p)
        held: dict[int, list[bytes]] = defaultdict(list)
        for w in sorted(at, key=lambda w: (-self.idf[w], w)):  # the file's licence words, highest IDF first
            for n in self.postings[w]:
                held[n].append(w)
        for n, own in held.items():
            label, whole, keys, base = self.templates[n]
            if any(w not in at for _, k in keys for w in k) or base and len(own) < len(set(whole)):
                continue
            if base:  # every word's postings, moved to the phrase's start, meet in one place
                hits = set.intersection(*({s - p for s in at[w]} for p, w in enumerate(whole)))
                if hits:
                    starts += hits
                    base_labels.add(label)
                    score = 1.0
                continue
            reach = max(slack, len(whole) // 20)
            votes: Counter = Counter()
            for w in own[: self.anchors]:
                votes.update({s for q in at[w] for p in self.postings[w][n] for s in range(q - p - reach, q - p + reach + 1)})
            need = min(2, len(own), len(whole))
            tried: set[int] = set()
            for s, v in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
                if v < need or tried.intersection(range(s - reach, s + reach + 1)) or not all(self._near(words, s + p, k, reach) for p, k in keys):
                    continue
                tried.add(s)
                share = sum(self.idf[w] for p, w in enumerate(whole) if w in at and w in words[max(0, s + p - reach) : max(0, s + p + reach + 1)]) / self.total[n]
                score = max(score, share)
                if share >= least:
                    labels.add(label)
                if share > 0.999:
                    break
        return starts, base_labels, labels | base_labels, min(1.0, score)

    @staticmethod
    def _near(words: list[bytes], at: int, key: list[bytes], slack: int) -> bool:
        return any(words[p : p + len(key)] == key for p in range(max(0, at - slack), max(0, at + slack + 1)))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word occurs (the licence vocabulary is fixed and small), and the number of rows."""
    vocabulary = {w for t in templates() for w in t.words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                count.update(vocabulary.intersection(words_of(t.as_py())))
                count[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in count], pa.string()), pa.array(list(count.values()), pa.int64())], names=["w", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df = {r["w"].encode(): r["n"] for r in rows}
    return df, df.pop(b"", 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slack: int = 2, least: float = 0.5) -> DataFrame:
    """Every row's licence findings: n_words, base_starts (word numbers), base_labels and labels (sorted), score.

    Word IDFs come from all rows. Null and empty texts have no words, no labels and score 0; repeated rows and ids are
    scanned one by one; other columns of docs are not read; an empty table gives an empty table.
    """
    index = Index(*document_frequencies(docs, text_col))
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base_starts", pa.list_(pa.int64())), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for t in batch.column(1):
                words = words_of(t.as_py())
                starts, base, labels, score = index.scan(words, slack, least)
                for c, v in zip(cols, (len(words), sorted(starts), sorted(base), sorted(labels), score), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, list(out)[1:], strict=True))], schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, base_starts array<long>, base_labels array<string>, labels array<string>, score double")
