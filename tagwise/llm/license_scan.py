"""Licence scan: TF-IDF cosine to licence templates, then inheritance along the path.

A file's sentences, and its runs of as many words as a template has, are compared with
templates of headers as sparse TF-IDF vectors, the whole file with whole licence texts;
document frequencies come from all files. A file that is mostly licence text is the
licence file of its directory. Files without a licence of their own
inherit from the nearest ancestor directory that has one, by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import stored

# Characteristic sentences of headers and licence texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
    *[(name, f"This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by "
             f"the Free Software Foundation{end} either version {version} of the License, or (at your option) any later version.")
      for name, what, sep, kind, end, version in [("GPL-2.0", "program", ";", "General Public", ";", "2"), ("LGPL-2.1", "library", ";", "Lesser General Public", ";", "2.1"),
                                                  ("LGPL-3.0", "program", ":", "Lesser General Public", ",", "3"), ("AGPL-3.0", "program", ":", "Affero General Public", ",", "3")]],
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]
# A run of words inside a longer sentence says little if it is shorter than this; it must be the template almost word for word.
SHORT, ALIKE = 8, 0.95
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_UNIT = re.compile(r"\n|(?<=[.!?])\s+(?=[A-Z])")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def licence_texts() -> list[tuple[str, str]]:
    """Name and whole text of the licences in the folder beside this file."""
    return [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]


class Texts:
    """Cosine of a whole file with whole licence texts, given as word counts."""

    def __init__(self, texts: list[tuple[str, Counter]], n_docs: int, df: dict[str, int], threshold: float):
        self.threshold, self.top = threshold, math.log(n_docs + 1) + 1
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1 for _, t in texts for w in t}
        self.vectors = []
        for name, t in texts:
            size = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in t.items()))
            self.vectors.append((name, {w: n * self.idf[w] / size for w, n in t.items()}))
        self.squares = [{w: x * x for w, x in v.items()} for _, v in self.vectors]

    def best(self, words: list[str], present: set[str]) -> tuple[float, str | None]:
        """Highest cosine and its licence, if it reaches the threshold."""
        near = [i for i, sq in enumerate(self.squares) if sum(map(sq.__getitem__, sq.keys() & present)) >= self.threshold ** 2 - 1e-9]
        if not near:
            return 0.0, None
        v = {w: n * self.idf.get(w, self.top) for w, n in Counter(words).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cosine, i = max((sum(x * v.get(w, 0.0) for w, x in self.vectors[i][1].items()) / size, -i) for i in near)
        return (cosine, self.vectors[-i][0]) if cosine >= self.threshold else (0.0, None)


class Matcher:
    """Cosine of a sentence or a run of words with the templates."""

    def __init__(self, templates: list[tuple[str, str]], n_docs: int, df: dict[str, int], threshold: float):
        self.threshold, self.top = threshold, math.log(n_docs + 1) + 1
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1 for _, t in templates for w in words_of(t)}
        self.vectors = [(name, self._vector(words_of(t))) for name, t in templates]
        # Words such that a sentence sharing only the others with a template stays below the threshold.
        rare, common = set(self.idf), set()
        for w in sorted(self.idf, key=self.idf.get):
            if all(math.sqrt(sum(x * x for u, x in v.items() if u in common or u == w)) < threshold for _, v in self.vectors):
                common.add(w)
        self.rare = rare - common
        self.squares = [{w: x * x for w, x in v.items()} for _, v in self.vectors]
        self.lengths = [len(words_of(t)) for _, t in templates]

    def _vector(self, words: list[str]) -> dict[str, float]:
        v = {w: n * self.idf.get(w, self.top) for w, n in Counter(words).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    def best(self, words: list[str]) -> tuple[float, str | None]:
        """Highest cosine and its licence (the first template wins a tie), if it reaches the threshold."""
        if self.rare.isdisjoint(words):
            return 0.0, None
        v = self._vector(words)
        cosine, i = max(((sum(x * v.get(w, 0.0) for w, x in t.items()), -i) for i, (_, t) in enumerate(self.vectors)), default=(0.0, 0))
        return (cosine, self.vectors[-i][0]) if cosine >= self.threshold else (0.0, None)

    def runs(self, words: list[str], i: int) -> Iterator[tuple[float, int, int]]:
        """Cosine, start and end of the runs of template ``i``'s length that reach the
        threshold, the best first and without overlaps."""
        length, v = min(self.lengths[i], len(words)), self.vectors[i][1]
        least = max(self.threshold, ALIKE) if self.lengths[i] < SHORT else self.threshold
        # The squared weights of the template's words in a run bound its squared cosine.
        mass = np.cumsum([0.0, *map(self.squares[i].get, words, [0.0] * len(words))])
        found = []
        for a in np.flatnonzero(mass[length:] - mass[:len(mass) - length] >= least * least - 1e-9).tolist():
            u = {w: n * self.idf.get(w, self.top) for w, n in Counter(words[a:a + length]).items()}
            cosine = sum(x * v.get(w, 0.0) for w, x in u.items()) / math.sqrt(sum(x * x for x in u.values()))
            if cosine >= least:
                found.append((-cosine, a))
        taken = bytearray(len(words))
        for cosine, a in sorted(found):
            if not (taken[a] or taken[a + length - 1]):
                taken[a:a + length] = b"\1" * length
                yield -cosine, a, a + length

    def scan(self, text: str, texts: Texts | None = None) -> tuple[str | None, float, float]:
        """Licence, cosine, and the share of words in licence text: of the licence text that
        the whole file is, else of the best sentence or run of words."""
        words = words_of(text)
        present = set(words)
        if texts and (whole := texts.best(words, present))[1]:
            return whole[1], whole[0], 1.0
        near = [i for i, sq in enumerate(self.squares) if sum(map(sq.__getitem__, sq.keys() & present)) >= self.threshold ** 2 - 1e-9]
        best, name, inside, a = 0.0, None, bytearray(len(words)), 0
        if not near:                # nor can a sentence be
            return None, 0.0, 0.0
        for unit in _UNIT.split(text):
            part = words_of(unit)
            cosine, found = self.best(part)
            if found:
                inside[a:a + len(part)] = b"\1" * len(part)
                if cosine > best:
                    best, name = cosine, found
            a += len(part)
        for i in near:
            for cosine, a, b in self.runs(words, i):
                inside[a:b] = b"\1" * (b - a)
                if cosine > best + 1e-9:
                    best, name = cosine, self.vectors[i][0]
        return name, best, sum(inside) / len(words)


def _frequencies(texts: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and in how many each template word occurs: one short row per task and word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            found[""] += batch.num_rows
            for text in batch.column(0):
                found.update(vocabulary.intersection(words_of(text.as_py() or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["w", "n"])

    got = {r.w: r.n for r in texts.mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return got.pop("", 0), got


def scan_files(files: DataFrame, id_col: str, path_col: str, text_col: str, threshold: float = 0.75, file_share: float = 0.5,
               templates: list[tuple[str, str]] = TEMPLATES, text_threshold: float = 0.85) -> DataFrame:
    """``(id, path, own, cosine, share, license, inherited_from)`` for every row of ``files``.

    ``own`` is the licence whose whole text the file is at a cosine of ``text_threshold`` or
    more (its share is 1), else that of its best sentence or run of words, across line
    breaks, at ``threshold`` or more; a file with ``file_share`` of its words in such
    sentences and runs is a licence file. ``license``
    is the file's own, else that of the licence files in the nearest directory upwards (the
    highest share there wins, then the licence's name), with that directory's path; else
    null. Null texts are empty; a file with a null path inherits nothing. The whole text is
    compared. Other columns are not read."""
    rows = files.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{path_col}`").cast("string").alias("path"), F.col(f"`{text_col}`").cast("string").alias("text"))
    wholes = [(name, Counter(words_of(t))) for name, t in licence_texts()]
    vocabulary = {w for _, t in templates for w in words_of(t)}.union(*(t for _, t in wholes))
    n_docs, df = _frequencies(rows.select("text"), vocabulary)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, path string, own string, cosine double, share double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, texts = Matcher(templates, n_docs, df, threshold), Texts(wholes, n_docs, df, text_threshold)
        for batch in batches:
            got = [matcher.scan(t.as_py() or "", texts) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([g[i] for g in got], t) for i, t in
                                                                                 enumerate((pa.string(), pa.float64(), pa.float64())))], names=["id", "path", "own", "cosine", "share"])

    directory = F.regexp_replace("path", "/?[^/]*$", "")
    # written once: three branches below read it
    scanned = stored(rows.mapInArrow(scan, schema).withColumn("dir", directory), "scanned")
    licence_of = (scanned.where((F.col("share") >= file_share) & F.col("dir").isNotNull()).groupBy("dir", "own").agg(F.max("share").alias("share"))
                  .groupBy("dir").agg(F.min(F.struct(-F.col("share"), "own")).alias("m")).select(F.col("dir").alias("above"), F.col("m.own").alias("theirs")))
    # Each directory once: its ancestors, itself included, meet the licence files' directories.
    parts = F.split("dir", "/")
    ancestors = scanned.where("own IS NULL AND dir IS NOT NULL").select("dir").distinct().select(
        "dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))).alias("x")).select("dir", "x.*")
    nearest = ancestors.join(licence_of, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "theirs")).alias("m")).select("dir", "m.above", "m.theirs")
    out = scanned.join(nearest, "dir", "left")
    return out.select(F.col("id").alias(id_col), F.col("path").alias(path_col), "own", "cosine", "share", F.coalesce("own", "theirs").alias("license"),
                      F.when(F.col("own").isNull(), F.col("above")).alias("inherited_from"))
