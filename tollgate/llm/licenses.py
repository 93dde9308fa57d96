"""License scans: sparse TF-IDF cosine of headers and license files to templates, and inheritance along paths.

Three kinds of units of a text are compared: each line; each block of neighbouring lines that have
words and are all comments or all none, such as a header wrapped over several lines; and the whole
text. A unit is a vector over its words, weighted by term frequency and by how rare a word is among
all lines of the corpus. It carries the license whose template has the largest cosine with it, if
that is at least ``THRESHOLD``. Lines are compared with notices of a sentence, blocks and whole texts
with headers and full license texts besides. A text whose words are mostly in such lines, or in
such blocks, or which is one as a whole, is a license file, and so is one with a license file's
name; its license holds for the directory it is in and all below, up to the next license file: a
file without a license of its own gets that of its nearest ancestor directory, found by joining its
ancestors with the licensed directories.

A unit needs a look only if it has a word that is rare among lines: without one its cosine stays
below ``sqrt(1 - r)``, where r is the rare words' share of a template's squared length. Of those
units the ones remain that would be close if every word of no template had the least weight it can
have, by a count-min sketch: lines are counted for ``CELLS`` hash values of words, and a word is in no
more lines than its cell has. The lines with the remaining units' words are counted exactly then,
and the words weighed as those of templates are.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.common import free_prefix, held, in_arrow
from tollgate.llm.license_texts import TEXTS

THRESHOLD = 0.7

#: Short names of public licenses and the notices that name them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "BSD-3-Clause": ("SPDX-License-Identifier: BSD-3-Clause",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("All rights reserved.",),
}
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"


# What a comment line starts with.
COMMENT = r"^[ \t]*(//|/?\*|#|--|;|%|<!--)"
EDGES = ".,;:!?\"'()[]{}<>#*/|-"
PART = 65_536
CELLS = 16_384
SENT = 100_000  # so many words go to all executors; if there are more, all words are counted and joined


def terms(line: str) -> list[str]:
    """The lower-case words of a line, without punctuation at their ends."""
    return [t for t in [w.strip(EDGES) for w in line.lower().split()] if t]


def _parts(line: str) -> Iterator[str]:
    """A very long line in parts that end at white space."""
    at = 0
    while at < len(line):
        end = at + PART
        while end < len(line) and not line[end].isspace():
            end += 1
        yield line[at:end]
        at = end


def lines(text: str | None) -> list[str]:
    return (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")


def line_words(line: str) -> Counter[str]:
    words: Counter[str] = Counter()
    for part in _parts(line):
        words.update(terms(part))
    return words


def units(text: str | None) -> Iterator[tuple[str, int, Counter[str]]]:
    """Kind, first line with words, and words of each line, each block of several lines that is not all, and all."""
    every: Counter[str] = Counter()
    blocks: list[tuple[int, int, Counter[str]]] = []  # first line, lines, words
    before, first, n_lines = (-2, False), 0, 0
    for number, line in enumerate(lines(text)):
        words = line_words(line)
        if not words:
            continue
        yield "line", number, words
        is_comment = re.match(COMMENT, line) is not None
        if before == (number - 1, is_comment):
            start, n, block = blocks[-1]
            block.update(words)
            blocks[-1] = (start, n + 1, block)
        else:
            blocks.append((number, 1, Counter(words)))
        before, first, n_lines = (number, is_comment), first if n_lines else number, n_lines + 1
        every.update(words)
    for start, n, block in blocks:
        if 1 < n < n_lines:
            yield "block", start, block
    if n_lines:
        yield "text", first, every


def numbered(templates: dict[str, tuple[str, ...]], texts: dict[str, tuple[str, ...]]) -> list[tuple[str, bool, Counter[str]]]:
    """License, whether it is for lines too, and words of all templates, by name of the license, notices first."""
    return [(license, for_lines, Counter(terms(text))) for license in sorted({*templates, *texts})
            for for_lines, known in ((True, templates), (False, texts)) for text in known.get(license, ())]


@dataclass(frozen=True)
class Known:
    """Templates as unit vectors (license, weight by word), and the words without which nothing is close to any."""

    vectors: tuple[tuple[str, dict[str, float]], ...]
    rare: frozenset[str]


@dataclass(frozen=True)
class Templates:
    """What lines are compared with, what blocks and texts are compared with, and weights."""

    for_lines: Known
    for_more: Known
    weight: dict[str, float]
    total: int
    cells: np.ndarray

    def known(self, kind: str) -> Known:
        return self.for_lines if kind == "line" else self.for_more


def _counted(files: DataFrame, vocabulary: frozenset[str] | None, text_col: str) -> DataFrame:
    """``term``, ``n``: the lines with each word of the vocabulary (None: of all there are).

    Each batch sends on its sums.
    """
    shared = files.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                for line in lines(text):
                    found: set[str] = set()
                    for part in _parts(line):
                        found.update(terms(part))
                    seen.update(found if vocabulary is None else vocabulary & found)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    return in_arrow(files.select(text_col), run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def cell(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % CELLS


def document_frequencies(files: DataFrame, vocabulary: frozenset[str], text_col: str = "text") -> tuple[int, dict[str, int], np.ndarray]:
    """The number of lines with a word in all files, of lines with each word of the vocabulary, and for each cell the sum over its words of theirs."""
    shared = files.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocabulary, n_lines = shared.value, 0
        known: Counter[str] = Counter()
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                for line in lines(text):
                    found: set[str] = set()
                    for part in _parts(line):
                        found.update(terms(part))
                    n_lines += bool(found)
                    seen.update(found)
            for term, n in seen.items():
                cells[cell(term)] += n
                if term in vocabulary:
                    known[term] += n
        full = np.flatnonzero(cells)
        n_terms = len(known) + 1
        yield pa.RecordBatch.from_arrays([
            pa.array(["", *known, *[None] * len(full)], pa.string()), pa.array([*[None] * n_terms, *full.tolist()], pa.int32()),
            pa.array([n_lines, *known.values(), *cells[full].tolist()], pa.int64())], ["term", "cell", "n"])

    sums = in_arrow(files.select(text_col), run, "term string, cell int, n bigint").groupBy("term", "cell").agg(F.sum("n").alias("n"))
    seen, cells = {}, np.zeros(CELLS, np.int64)
    for row in sums.collect():  # no more than the vocabulary and the cells
        if row.term is None:
            cells[row.cell] = row.n
        else:
            seen[row.term] = row.n
    return seen.pop("", 0), seen, cells


def weigh(every: list[tuple[str, bool, Counter[str]]], total: int, seen: dict[str, int], cells: np.ndarray, threshold: float) -> Templates:
    """Weights from the corpus, and as ``rare`` all words but the most common ones that a unit may consist of without coming close."""
    weight = {t: log((1 + total) / max(seen.get(t, 0), 1)) + 1 for t in {t for _, _, words in every for t in words}}

    def known(notices: list[tuple[str, Counter[str]]]) -> Known:
        squares = [{t: (n * weight[t]) ** 2 for t, n in sorted(words.items())} for _, words in notices]
        sums = [sum(square.values()) for square in squares]
        vocabulary = {t for square in squares for t in square}
        common: set[str] = set()
        for word in sorted(vocabulary, key=lambda t: (-seen.get(t, 0), t)):
            trial = common | {word}
            if any(sum(x for t, x in square.items() if t in trial) >= threshold**2 * whole for square, whole in zip(squares, sums)):
                break
            common = trial
        vectors = tuple((license, {t: n * weight[t] / sqrt(whole) for t, n in sorted(words.items())}) for (license, words), whole in zip(notices, sums))
        return Known(vectors, frozenset(vocabulary - common))

    return Templates(known([(license, words) for license, for_lines, words in every if for_lines]), known([(license, words) for license, _, words in every]), weight, total, cells)


def closest(words: Counter[str], kind: str, templates: Templates, others: dict[str, int]) -> tuple[float, str]:
    """The largest cosine of a unit's words with a template for its kind, to 12 places, and its license; of equals the first by name.

    ``others`` has the numbers of lines with the words of no template.
    """
    total, vectors = templates.total, templates.known(kind).vectors
    own = {t: n * (templates.weight.get(t) or log((1 + total) / others[t]) + 1) for t, n in words.items()}
    length = sqrt(sum(w * w for w in own.values()))
    cosine = lambda vector: round(sum(w * own.get(t, 0.0) for t, w in vector.items()) / length, 12)
    best = max(((cosine(vector), k) for k, (_, vector) in enumerate(vectors)), key=lambda x: (x[0], -x[1]))
    return best[0], vectors[best[1]][0]


def may_be_close(words: Counter[str], kind: str, templates: Templates, threshold: float) -> bool:
    """Whether the unit is close to a template for some numbers of lines that its words of no template can have."""
    if templates.known(kind).rare.isdisjoint(words):
        return False
    weight, total = templates.weight, templates.total
    shared = [t for t in words if t in weight]
    # A cosine is at most the share that the words of templates have of the unit's length.
    most = sum((words[t] * weight[t]) ** 2 for t in shared) * (1 / threshold**2 - 1) * (1 + 1e-9)
    if words.total() - sum(words[t] for t in shared) > most:  # no weight is below one
        return False
    lines_at_most = {t: min(int(templates.cells[cell(t)]), total) for t in words if t not in weight}
    if sum((words[t] * (log((1 + total) / n) + 1)) ** 2 for t, n in lines_at_most.items()) > most:
        return False
    return closest(words, kind, templates, lines_at_most)[0] >= threshold - 1e-9


def scan(
    files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, text_col: str = "text",
    texts: dict[str, tuple[str, ...]] = TEXTS,
) -> DataFrame:
    """``path``, ``kind``, ``line`` (from 0), ``license``, ``cosine``, ``n_terms``, ``whole`` for each unit of ``files`` that is like a template.

    ``kind`` is ``line``, ``block`` or ``text``, ``line`` the unit's first line that has words. ``whole``
    tells that such units of a kind have over half the row's words. Whole texts are read; null and
    empty ones have no units.
    """
    every = numbered(templates, texts)
    vocabulary = frozenset(t for _, _, words in every for t in words)
    weighed = files.sparkSession.sparkContext.broadcast(weigh(every, *document_frequencies(files, vocabulary, text_col), threshold))
    schema = pa.schema([("row", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("n_terms", pa.int32()), ("size", pa.int64()),
                        ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("others", pa.list_(pa.string()))])

    def candidates(batches):
        known = weighed.value
        for batch in batches:
            rows: list[dict] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size, hits, row = 0, [], uuid.uuid4().hex
                for kind, number, words in units(text):
                    n = words.total()
                    if kind == "text":
                        size = n
                    if may_be_close(words, kind, known, threshold):
                        hits.append(dict(row=row, path=path, kind=kind, line=number, n_terms=n, terms=list(words), counts=list(words.values()),
                                         others=[t for t in words if t not in known.weight]))
                rows += [hit | {"size": size} for hit in hits]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def compare(batches):
        known = weighed.value
        for batch in batches:
            rows = batch.to_pylist()
            best = [closest(Counter(dict(zip(r["terms"], r["counts"]))), r["kind"], known, dict(r["found"] or [])) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array([license for _, license in best], pa.string()), pa.array([cosine for cosine, _ in best], pa.float64())],
                ["row", "path", "kind", "line", "n_terms", "size", "license", "cosine"])

    unit = ["row", "kind", "line"]
    found = held(in_arrow(files.select("path", text_col), candidates,
                          "row string, path string, kind string, line int, n_terms int, size bigint, terms array<string>, counts array<int>, others array<string>"))
    apart = found.select(*unit, F.explode("others").alias("term"))
    unknown = held(apart.select("term").distinct())
    n = unknown.count()
    if n:
        wanted = frozenset(r.term for r in unknown.collect()) if n <= SENT else None
        each = apart.join(_counted(files, wanted, text_col).join(unknown, "term"), "term")
        each = each.groupBy(*unit).agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("found"))
        found = found.join(each, unit, "left")
    else:
        found = found.withColumn("found", F.lit(None).cast("map<string,bigint>"))
    close = in_arrow(found.select("row", "path", "kind", "line", "n_terms", "size", "terms", "counts", "found"), compare,
                     "row string, path string, kind string, line int, n_terms int, size bigint, license string, cosine double").where(F.col("cosine") >= threshold)
    whole = (2 * F.sum("n_terms").over(Window.partitionBy("row", "kind")) > F.col("size")).alias("whole")
    return close.select("path", "kind", "line", "license", "cosine", "n_terms", whole)


def directory(path: Column) -> Column:
    """The path up to its last slash, without it; empty for a path without one."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """All directories of a path, from its own up to the empty one."""
    parts = F.split(directory(path), "/")
    return F.when(directory(path) == "", F.array(F.lit(""))).otherwise(
        F.concat(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit(""))))


def licenses(
    files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, text_col: str = "text",
    texts: dict[str, tuple[str, ...]] = TEXTS,
) -> DataFrame:
    """``files`` with ``license``, ``cosine``, ``license_line``, ``is_license_file`` and ``license_source``.

    ``license_source`` is ``own`` (the unit with the largest cosine, of equals the first by line, then
    the text, the line, the block; ``license_line`` is its first line),
    ``inherited`` (of the nearest directory above that has a license file; of several the first by
    path) or null, as are license and cosine then. Column ``path`` is needed; all columns are kept,
    those named like the added ones are replaced. A null path is a file in no directory's reach.
    Rows that repeat a path are one file: its best unit counts, and it is a license file if one of
    them is. An empty table gives no rows.
    """
    added = ["license", "cosine", "license_line", "is_license_file", "license_source"]
    files = files.drop(*added)
    at = free_prefix(files)
    hits = held(scan(files.where("path IS NOT NULL"), templates, threshold, text_col, texts))
    key = F.struct(F.col("cosine").alias("c"), (-F.col("line")).alias("l"), "kind")
    # Equal units of a path's repeated rows give the same best line.
    own = hits.groupBy("path").agg(F.max_by(F.struct("license", "cosine", "line"), key).alias("own"), F.max("whole").alias("whole"))
    name = F.regexp_extract("path", r"(?s)([^/]*)$", 1)
    own = own.withColumn("whole", F.col("whole") | name.rlike(FILE_NAMES))
    holders = own.where("whole").select(directory(F.col("path")).alias("dir"), "path", F.col("own.license").alias("license"), F.col("own.cosine").alias("cosine"))
    holders = holders.groupBy("dir").agg(F.min(F.struct("path", "license", "cosine")).alias("holder"))
    without = files.where("path IS NOT NULL").select("path").join(own.select("path"), "path", "left_anti").distinct().withColumn("dir", directory(F.col("path")))
    # Directories, not files, meet the licensed ones: the root and other wide ones have far fewer of these.
    below = without.groupBy("dir").agg(F.min("path").alias("path")).withColumnRenamed("dir", "from")
    above = below.select("from", F.posexplode(ancestors(F.col("path"))).alias("steps", "dir"))
    nearest = above.join(holders, "dir").groupBy("from").agg(F.min_by("holder", "steps").alias("holder")).withColumnRenamed("from", "dir")
    nearest = without.join(nearest, "dir")
    found = own.select(
        "path", F.col("own.license").alias("license"), F.col("own.cosine").alias("cosine"), F.col("own.line").alias("license_line"),
        F.col("whole").alias("is_license_file"), F.lit("own").alias("license_source"),
    ).unionByName(nearest.select(
        "path", F.col("holder.license").alias("license"), F.col("holder.cosine").alias("cosine"), F.lit(None).cast("int").alias("license_line"),
        F.lit(False).alias("is_license_file"), F.lit("inherited").alias("license_source"),
    )).withColumnRenamed("path", f"{at}path")
    return files.join(found, files.path == F.col(f"{at}path"), "left").drop(f"{at}path").withColumn("is_license_file", F.coalesce("is_license_file", F.lit(False)))
