"""License scans by conditional compression.

Words without which a template of license wording cannot be there give candidate blocks.  Each block is compressed
alone and with every template as a raw zstandard dictionary; templates are ranked by how much smaller the block gets, in
proportion to what they take themselves.  Those that save enough are confirmed, in this order, by the exact
differences in wording, in which words that tell one license from another (names, versions, NC, SA, ND) must agree.  Where
confirmed wordings overlap, the one that saves most stays.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, small_batches, table, utf8

#: Public wording of notices, by license identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("MIT", "This project is MIT licensed"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MIT", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("Apache-2.0", "Licensed under the Apache 2.0 License"),
    ("Apache-2.0", "Licensed under the Apache License 2.0"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "MPL-2.0", "EPL-2.0", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0")),
    ("Apache-1.0", "Licensed under the Apache License, Version 1.0"),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1"),
    ("MPL-1.0", "The contents of this file are subject to the Mozilla Public License Version 1.0"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    *((f"{name}-{v}", text.format(kind=kind, v=v.removesuffix(".0"))) for name, kind, v in (("GPL", "General", "1.0"), ("GPL", "General", "2.0"), ("GPL", "General", "3.0"), ("LGPL", "Library General", "2.0"), ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3.0"), ("AGPL", "Affero General", "3.0"))
      for text in ("This work is licensed under the GNU {kind} Public License, version {v}", "it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {v} of the License")),
    *((f"CC-{kind}-{v}", text) for v, port, no in (("4.0", "International", "NoDerivatives"), ("3.0", "Unported", "NoDerivs"), ("2.5", "Generic", "NoDerivs"), ("2.0", "Generic", "NoDerivs"), ("1.0", "Generic", "NoDerivs"))
      for kind, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", f"Attribution-{no}"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", f"Attribution-NonCommercial-{no}"))
      for text in (f"Licensed under CC {kind} {v}", f"This work is licensed under a Creative Commons {long} {v} {port} License")),
)
#: Share of a template's words that may differ, but one word at least; the cost of a difference that may not be.
DIFFERENT, NEVER = 0.15, 10**6
#: What a template saves of a block, in parts of what it takes itself, to be confirmed; times its reach that a block is long.
LEAST, BLOCK = 0.2, 2
#: Words that name a license, and its version.
NAME = re.compile(rb"spdx\S*|unlicense|unencumbered|apache\S*|mit|isc|gnu|[al]?gpl\S*|general|lesser|library|affero|mozilla|mpl\S*|bsd\S*|eclipse|epl\S*|\d-clause|artistic|boost|academic|microsoft|creative|commons|cc|cc-\S*|nc|nd|sa|by-\S+|(?:attribution|non-?commercial|share-?alike|no-?deriv)\S*")
NUMBER = re.compile(rb"v?(\d+(?:\.\d+)*)")
#: Words that are frequent in other texts as well.
FREQUENT = {b"under", b"the", b"general", b"mit", b"library", b"academic", b"creative"}
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
PARAMETERS = zs.ZstdCompressionParameters.from_level(6, write_content_size=False, write_checksum=False, write_dict_id=False)
ALONE = zs.ZstdCompressor(compression_params=PARAMETERS)


#: Marks at the ends of a word: punctuation, comment marks, typographic quotes and dashes (in UTF-8).
_MARKS = rb"(?:[-.,;:!?()\[\]{}\"'`*<>#/%=_~|+]|\xe2\x80[\x90-\xa6]|\xc2[\xab\xbb])+"
_ENDS = re.compile(rb"^" + _MARKS + rb"|" + _MARKS + rb"$")


def normal(word: bytes) -> bytes:
    """A word as compared: lower-cased, without marks at its ends, nothing if it is all marks; a version without v and .0 at its end."""
    word = _ENDS.sub(b"", word).lower()
    if number := NUMBER.fullmatch(word):
        word = number[1]
        while word.endswith(b".0"):
            word = word[:-2]
    return word


def distinguishing(word: bytes, versions: bool) -> bool:
    """Whether a word as compared tells a license from another: by its name, or by its version where the template has one."""
    return bool(NAME.fullmatch(word) or versions and NUMBER.fullmatch(word))


def differences(template: list[bytes], block: list[bytes], fixed: Callable[[bytes], bool] = lambda word: False) -> tuple[int, int, int]:
    """The least number of words to change, add or leave out to make the template of a run of the block, and that run.

    Of equal ones the run that ends first.  Each such word that is fixed counts as NEVER.
    """
    own, other = ([NEVER if fixed(w) else 1 for w in x] for x in (template, block))
    cost, start = np.zeros(len(block) + 1, np.int64), np.arange(len(block) + 1)
    for i, w in enumerate(template, 1):
        now, begun = np.empty_like(cost), np.empty_like(start)
        c = own[i - 1]
        now[0], begun[0] = cost[0] + c, 0
        for j, b in enumerate(block, 1):
            e = other[j - 1]
            now[j], begun[j] = min((cost[j - 1] + (w != b) * max(c, e), start[j - 1]), (cost[j] + c, start[j]), (now[j - 1] + e, begun[j - 1]), key=lambda x: x[0])
        cost, start = now, begun
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


class Scanner:
    """Templates ready to compress with and to compare."""

    def __init__(self, templates: tuple[tuple[str, str], ...], different: float = DIFFERENT):
        templates = tuple(dict.fromkeys(templates))
        self.names = [t[0] for t in templates]
        self.words = [[normal(w) for w in t[1].encode().split()] for t in templates]
        self.fixed = [functools.partial(distinguishing, versions=any(map(NUMBER.fullmatch, w))) for w in self.words]
        self.most = [max(int(different * len(w)), int(any(map(f, w)))) for w, f in zip(self.words, self.fixed, strict=True)]
        self.counts = [Counter(w) for w in self.words]
        shared = Counter(w for words in self.words for w in set(words))
        self.anchored: dict[bytes, list[int]] = {}
        for i, words in enumerate(self.words):
            always = [w for w in words if self.most[i] == 0 or self.fixed[i](w) and not NUMBER.fullmatch(w)]
            # a word that must agree, or one more word than may differ
            few = [min(always, key=lambda w: (w in FREQUENT, -shared[w] if len(w) > 2 else 0, w))] if always else self._rare(words, self.most[i])
            for w in few:
                self.anchored.setdefault(w, []).append(i)
        self.anchors = re.compile(b"|".join(sorted(map(re.escape, self.anchored), key=len, reverse=True)))
        span = [len(w) + m for w, m in zip(self.words, self.most, strict=True)]
        self.reach = max(span)
        self.near = {w: max(span[i] for i in of) for w, of in self.anchored.items()}  # how far from its anchor a template's run goes
        self.sizes = [len(self.compressed(b" ".join(w))) for w in self.words]
        self.dictionaries = [zs.ZstdCompressionDict(b" ".join(w), dict_type=zs.DICT_TYPE_RAWCONTENT) for w in self.words]
        for d in self.dictionaries:
            d.precompute_compress(compression_params=PARAMETERS)
        self.given = [zs.ZstdCompressor(compression_params=PARAMETERS, dict_data=d).compress for d in self.dictionaries]

    def compressed(self, block: bytes, template: int | None = None) -> bytes:
        """The block alone, or with a template as dictionary."""
        return ALONE.compress(block) if template is None else self.given[template](block)

    def reductions(self, block: bytes, templates: Iterable[int]) -> list[float]:
        """How much smaller each template makes the block, in parts of what it takes itself."""
        alone = len(self.compressed(block))
        return [(alone - len(self.compressed(block, i))) / self.sizes[i] for i in templates]

    @staticmethod
    def _rare(words: list[bytes], most: int) -> list[bytes]:
        """The longest words, one more than may differ; all if there are fewer."""
        return sorted(set(words), key=lambda w: (-len(w), w))[: most + 1]

    def _runs(self, i: int, words: list[bytes], low: int) -> Iterator[tuple[int, int, int]]:
        """(differences, begin, end) of each confirmed run of template i in words, which begin at low."""
        if (self.counts[i] - Counter(words)).total() > self.most[i]:  # each such word is a difference at least
            return
        n, a, b = differences(self.words[i], words, self.fixed[i])
        if n <= self.most[i] and b > a:
            yield n, low + a, low + b
            yield from self._runs(i, words[:a], low)
            yield from self._runs(i, words[b:], low + b)

    def _blocks(self, places: list[tuple[int, int]], n: int) -> Iterator[tuple[int, int]]:
        """Ranges of words round places (of a word, and how far runs go from it): whole runs are in one of them, however long these go on."""
        joined: list[list[int]] = []
        for at, near in places:
            low, high = max(0, at - near), min(n, at + near + 1)
            if joined and low <= joined[-1][1]:
                joined[-1] = [min(low, joined[-1][0]), max(high, joined[-1][1])]
            else:
                joined.append([low, high])
        step = BLOCK * self.reach
        for low, high in joined:
            for a in range(low, max(low + 1, high - 2 * self.reach), step):
                yield a, min(high, a + step + 2 * self.reach)

    def scan(self, text: bytes) -> list[tuple[str, int, int, int, float]]:
        """(license, begin, end, differences, reduction) of each confirmed wording, by bytes of the text, in order.

        Of confirmed wordings that overlap the one with the largest reduction stays, then that with the fewest differences,
        then the longest.
        """
        anchors = [m.start() for m in self.anchors.finditer(text.lower())]
        if not anchors:
            return []
        tokens = [(m.start(), m.end(), word) for m in _TOKEN.finditer(text) if (word := normal(m.group()))]  # marks that stand alone are none
        starts = np.array([t[0] for t in tokens])
        places = sorted({int(np.searchsorted(starts, a, "right")) - 1 for a in anchors} - {-1})
        places = [(at, self.near[tokens[at][2]]) for at in places if tokens[at][2] in self.anchored]
        found = set()
        for low, high in self._blocks(places, len(tokens)):
            words = [t[2] for t in tokens[low:high]]
            saved = self.reductions(b" ".join(words), range(len(self.words)))
            for i in sorted(range(len(saved)), key=lambda i: -saved[i]):
                if saved[i] < LEAST:
                    break
                for n, a, b in self._runs(i, words, low):
                    found.add((i, n, a, b))
        ranked = []
        for i, n, a, b in found:
            r = round(self.reductions(b" ".join(t[2] for t in tokens[a:b]), [i])[0], 6)
            ranked.append((-r, n / len(self.words[i]), a - b, a, i, n, b))
        out: list[tuple] = []
        for r, _, _, a, i, n, b in sorted(ranked):
            if r <= -LEAST and all(b <= x[5] or a >= x[6] for x in out):
                out.append((self.names[i], tokens[a][0], tokens[b - 1][1], n, -r, a, b))
        return [x[:5] for x in sorted(out, key=lambda x: x[1])]


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, different: float = DIFFERENT) -> DataFrame:
    """(doc_id, license, begin, end, differences, reduction, wording) of each license wording in docs (doc_id, text).

    begin and end count code points; wording is that part of the text; differences is 0 for a template's exact words
    (case, marks at word ends or alone, and v and .0 of versions aside), and at most ``different`` of its words, but one.
    reduction is what the template saves when the wording is compressed with it, in parts of what it takes itself; where
    wordings overlap the largest stays, of equal ones that with the fewest differences, then the longest.  Texts count
    whole, however long; those that are null, empty or without such wording give no row; equal rows give equal rows; a
    row without doc_id gives rows with a null one; other columns are left out, also those named like the result's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, different)
        for batch in batches:
            data, ends = utf8(batch.column("text"))
            out = []
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                text = bytes(data[a:b])
                for name, begin, end, n, r in scanner.scan(text):
                    at = len(text[:begin].decode())
                    part = text[begin:end].decode()
                    out.append({"doc_id": batch.column("doc_id")[i].as_py(), "license": name, "begin": at, "end": at + len(part), "differences": n, "reduction": r, "wording": part})
            yield pa.RecordBatch.from_pylist(out, schema=FOUND)

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, license string, begin long, end long, differences int, reduction double, wording string")


FOUND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("differences", pa.int32()), ("reduction", pa.float64()), ("wording", pa.string())])


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wording in all documents."""
    small_batches(spark)
    return licenses(table(spark, sf_dir, "documents"))
