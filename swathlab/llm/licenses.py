"""Licence scan by a positional index of rare words.

Templates are the runs of words that licence texts and notices have. Over all documents it is counted how
many hold each template word. The index has, for each template, the places of its words of highest IDF, as many as make up
more than what ``COVERAGE`` lets go: a notice that reaches the coverage has one of them at least. In each
file its licence words are looked up from the highest IDF down, each place proposing a start (its place less its place in the
template). A start is verified once: the key phrases must stand where the template has them, and the IDF-weighted share of
words in place must reach ``COVERAGE``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread
from .decontamination import fold

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Public licence wording: label, text, and the phrases that must be there; several texts may share a label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License",)),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("Apache License", "distributed on an AS IS BASIS"),
    ),
    ("mit", "Released under the MIT License", ("MIT License",)),
    ("mit", "Licensed under the MIT License", ("MIT License",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("Permission is hereby granted", "free of charge", "substantial portions of the Software"),
    ),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("Permission is hereby granted", "free of charge")),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("General Public License, version 3",)),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("General Public License, version 2",)),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("GNU General Public License", "version 3 of the License"),
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        ("GNU General Public License", "version 2 of the License"),
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("Lesser General Public License",)),
    ("agpl", "under the terms of the GNU Affero General Public License", ("Affero General Public License",)),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer.",
        ("Redistribution and use", "binary forms"),
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("Redistribution and use", "binary forms")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License",)),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License",)),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("Permission to use, copy, modify", "with or without fee"),
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose", ("Permission to use, copy, modify",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        ("provided as-is", "redistribute it freely"),
    ),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ("Boost Software License",)),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("CC BY-NC",)),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("CC BY-SA",)),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution 4.0",)),
    ("cc0", "Creative Commons Zero v1.0 Universal", ("Creative Commons Zero",)),
)
COVERAGE = 0.8

_COLUMNS = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType()}


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """(documents, documents that hold each template word), over all documents. At most one count for each template word."""
    vocabulary = frozenset(w for _, text, _ in TEMPLATES for w in fold(text).split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(vocabulary.intersection(fold(text.as_py()).split()))
                counts[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = spread(docs.select(text_col)).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found.pop(b"", 0), found


class TemplateIndex:
    """Postings of the templates' rare words, and what verifies a start."""

    def __init__(self, documents: int, frequencies: dict[bytes, int]):
        self.templates = []
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.idf = lambda w: math.log((documents + 1) / (frequencies.get(w, 0) + 1)) + 1e-9
        for at, (label, text, phrases) in enumerate(TEMPLATES):
            words = fold(text).split()
            keys = []
            for phrase in phrases:
                run = fold(phrase).split()
                keys.append((next(i for i in range(len(words)) if words[i : i + len(run)] == run), run))
            weights = [self.idf(w) for w in words]
            total, held = sum(weights), 0.0
            for i in sorted(range(len(words)), key=lambda i: (-weights[i], i)):
                self.postings.setdefault(words[i], []).append((at, i))
                held += weights[i]
                if held > (1 - COVERAGE + 1e-9) * total:
                    break
            self.templates.append((label, words, keys, weights, total))
        self.base = [(fold(phrase).split(), label) for phrase, label in BASE.items()]
        self.heads = {run[0]: [x for x in self.base if x[0][0] == run[0]] for run, _ in self.base}
        self.wanted = frozenset(self.postings) | frozenset(self.heads)

    def share(self, at: int, start: int, words: list[bytes]) -> float:
        """The weighted share of the template's words in place; 0 if a key phrase isn't."""
        _, run, keys, weights, total = self.templates[at]
        if any(words[start + i : start + i + len(key)] != key for i, key in keys):
            return 0.0
        return min(1.0, sum(w for w, a, b in zip(weights, run, words[start : start + len(run)], strict=False) if a == b) / total)

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score of a text."""
        words = fold(text).split()
        places: list[int] = []
        base: set[str] = set()
        held: dict[bytes, list[int]] = {}
        if not self.wanted.isdisjoint(words):
            for i, word in enumerate(words):
                if word in self.wanted:
                    for run, label in self.heads.get(word, ()):
                        if words[i : i + len(run)] == run:
                            places.append(i)
                            base.add(label)
                    if word in self.postings:
                        held.setdefault(word, []).append(i)
        labels, score = set(base), 1.0 if base else 0.0
        tried: set[tuple[int, int]] = set()
        for word in sorted(held, key=lambda w: (-self.idf(w), w)):
            for at, j in self.postings[word]:
                for i in held[word]:
                    if i >= j and (at, i - j) not in tried:
                        tried.add((at, i - j))
                        share = self.share(at, i - j, words)
                        if share >= COVERAGE - 1e-9:
                            labels.add(self.templates[at][0])
                            score = max(score, share)
        return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def scan_licenses(docs: DataFrame, text_col: str = "text", index: TemplateIndex | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words and no labels; their score is 0. Very long texts are scanned whole. Rows are
    independent, so repeated rows get equal results, and labels found with equal shares are all kept; an empty table gives
    an empty result. Columns of those names are replaced.
    """
    index = index or TemplateIndex(*document_frequencies(docs, text_col))
    names = list(_COLUMNS)
    kept = spread(docs).select(*[c for c in docs.columns if c not in names])
    columns = kept.columns
    at = columns.index(text_col)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.scan(text.as_py()) for text in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds))], names=[*columns, *names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in _COLUMNS.items())]))
