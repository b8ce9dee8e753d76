"""License scans by patience alignment.

Text and template are aligned on words that are unique in both: the longest increasing subsequence of
such words stays, and the gaps between them are aligned in turn. Coverage is the share of the
template's words that found a partner. Only stretches of a text around a template's telling words
are aligned, each no longer than a few times the template, whatever the length of the text. Stretches
overlap: one starts at each telling word. The words that tell a license from its siblings must be
among the partners, whatever the coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kveil.llm.common import col, map_arrow, table

LEAST_COVERAGE = 0.8
WORDS = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

# Notices by which texts declare their license.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
# Words that tell a license notice from other text.
TELLING = {
    *"licensed license mit apache gnu gpl cc by-nc by-sa rights reserved redistribution permission".split(),
    *"software copyright sublicense redistribute".split(),
}
# By template, sets of words that name the license, one of each of which must find a partner,
# and words of its siblings, none of which may stand in the text among them or just before.
GPL = ([{"gnu", "general"}, {"3"}], {"lesser", "library", "affero", "documentation"})
NAMING: dict[str, tuple[list[set[str]], set[str]]] = {
    "MIT-notice": ([{"mit"}], {"modified"}),
    "Apache-2.0-notice": ([{"apache"}, {"2"}], set()),
    "Apache-2.0": ([{"apache"}, {"2"}], set()),
    "GPL-3.0-notice": GPL,
    "GPL-3.0": GPL,
    "CC-BY-4.0": ([{"cc"}, {"by"}, {"4"}], {"nc", "nd", "sa"}),
    "CC-BY-NC-4.0": ([{"cc"}, {"by-nc"}, {"4"}], {"nd", "sa"}),
    "CC-BY-SA-4.0": ([{"cc"}, {"by-sa"}, {"4"}], {"nc", "nd"}),
}
VERSION = re.compile(r"v?([0-9]+)(?:\.0)*")


def words_of(text: str) -> list[str]:
    return [plain(w) for w in WORDS.findall(text.lower())]


def plain(word: str) -> str:
    """Versions in one form: v2, 2 and 2.0 are one word."""
    version = VERSION.fullmatch(word)
    return version[1] if version else word


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, whose seconds increase too: patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        p = bisect_left(tops, b)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[p], piles[p] = b, i
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words in two sequences, in increasing order in both."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, m = gaps.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        once = {w: p for p, w in enumerate(b[k:m], k) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = increasing([(p, once[w]) for p, w in enumerate(a[i:j], i) if w in once])
        if not anchors:
            continue
        found += anchors
        for (p, q), (r, s) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)]):
            gaps.append((p + 1, r, q + 1, s))
    return sorted(found)


class Scanner:
    """Templates cut into words, with what a stretch must hold to reach the least coverage."""

    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE):
        self.least = least
        self.templates = {name: words_of(text) for name, text in templates.items()}
        self.telling = {n: Counter(w for w in ws if w in TELLING) for n, ws in self.templates.items()}
        for name, marks in self.telling.items():
            if not marks:
                raise ValueError(f"template {name} has no telling word")
        self.counts = {name: Counter(ws) for name, ws in self.templates.items()}
        self.naming = {n: self.naming_of(n) for n in self.templates}
        self.marks = sorted({w for marks in self.telling.values() for w in marks})

    def naming_of(self, name: str) -> tuple[list[set[str]], set[str]]:
        """The entry of NAMING, for a template that has all its words; others have none."""
        needed, others = NAMING.get(name, ([], set()))
        return (needed, others) if set().union(*needed) <= set(self.templates[name]) else ([], set())

    def names_it(self, words: list[str], pairs: list[tuple[int, int]], name: str) -> bool:
        """Whether aligned words hold those that tell the license from its siblings."""
        needed, others = self.naming[name]
        if not needed:
            return True
        known = set().union(*needed)
        found = [i for i, _ in pairs if words[i] in known]
        aligned = {words[i] for i in found}
        if any(aligned.isdisjoint(x) for x in needed):
            return False
        return others.isdisjoint(words[max(0, found[0] - 1) : found[-1] + 1])

    def regions(self, places: list[tuple[int, str]], name: str, size: int) -> Iterator[tuple[int, int]]:
        """Stretches that may hold a template: telling words no further apart than it is long.

        One starts at each telling word and ends before such a word comes once more than in the
        template, so a stray telling word before a notice only makes one stretch more. Each is
        given with a margin of the template's length and with margins cut at the neighbouring
        telling words, on the left, the right and both: in a notice given twice, words are unique
        only between the cuts.
        """
        words, marks = self.templates[name], self.telling[name]
        own = [(p, w) for p, w in places if w in marks]
        need = max(1, len(marks) - int(len(words) * (1 - self.least) + 1e-9))
        seen: Counter = Counter()
        given: set[tuple[int, int]] = set()
        end = 0
        for first, (start, _) in enumerate(own):
            if first:
                seen[own[first - 1][1]] -= 1
            while end < len(own) and (
                end == first or (own[end][0] - own[end - 1][0] <= len(words) and seen[own[end][1]] < marks[own[end][1]])
            ):
                seen[own[end][1]] += 1
                end += 1
            if sum(n > 0 for n in seen.values()) < need:
                continue
            low, high = max(0, start - len(words)), min(size, own[end - 1][0] + len(words) + 1)
            cut_low = max(low, own[first - 1][0] + 1) if first else low
            cut_high = min(high, own[end][0]) if end < len(own) else high
            for stretch in ((low, high), (cut_low, high), (low, cut_high), (cut_low, cut_high)):
                if stretch not in given:
                    given.add(stretch)
                    yield stretch

    def reaches(self, held: Counter, name: str) -> bool:
        """Whether words in these numbers could cover enough of a template in any order, and name its license."""
        if sum(min(n, held[w]) for w, n in self.counts[name].items()) < self.least * len(self.templates[name]) - 1e-9:
            return False
        return all(any(w in held for w in x) for x in self.naming[name][0])

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word + 1) by place; of overlapping ones the most words matched."""
        lowered = text.lower()
        if not any(m in lowered for m in self.marks):
            return []
        words = [plain(w) for w in WORDS.findall(lowered)]
        marks = set(self.marks)
        places = [(p, w) for p, w in enumerate(words) if w in marks]
        hits, whole = [], Counter(words)
        for name, template in self.templates.items():
            if not self.reaches(whole, name):
                continue
            for low, high in self.regions(places, name, len(words)):
                if not self.reaches(Counter(words[low:high]), name):
                    continue
                pairs = align(words[low:high], template)
                coverage = len(pairs) / len(template)
                if coverage >= self.least and self.names_it(words[low:high], pairs, name):
                    start, end = low + pairs[0][0], low + pairs[-1][0] + 1
                    hits.append((-len(pairs), -coverage, end - start, start, end, name))
        taken, out = bytearray(len(words)), []
        for _, coverage, _, start, end, name in sorted(set(hits)):
            if taken.find(1, start, end) < 0:
                taken[start:end] = b"\1" * (end - start)
                out.append((name, -coverage, start, end))
        return sorted(out, key=lambda x: (x[2], x[0]))


def scan_worker(templates: dict[str, str], least: float):
    kind = pa.list_(
        pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            found = [
                [dict(zip(("license", "coverage", "start", "end"), hit)) for hit in scanner.scan(t.as_py() or "")]
                for t in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], names=["id", "licenses"])

    return work


def license_scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    least_coverage: float = LEAST_COVERAGE,
) -> DataFrame:
    """(id, licenses) per row: the notices found in its whole text, each with coverage and place in words.

    Rows are scanned one by one, so null and repeated ids and repeated rows do no harm. Null and
    empty texts have no notices; an empty table gives an empty table. No other column is read.
    Overlapping finds give way to the one with more matched words; ties go to the higher coverage,
    then the shorter stretch, then the earlier place, then the name.
    """
    rows = df.select(col(id_col).alias("id"), col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, licenses array<struct<license:string,coverage:double,start:int,end:int>>"
    return map_arrow(rows, scan_worker(templates or TEMPLATES, least_coverage), shape)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its notices: their number, their names, and the best coverage."""
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "id AS doc_id",
        "CAST(size(licenses) AS BIGINT) AS n_licenses",
        "array_join(transform(licenses, x -> concat_ws(':', x.license, x.start, x.end)), ',') AS licenses",
        "round(array_max(transform(licenses, x -> x.coverage)), 6) AS best_coverage",
    )
