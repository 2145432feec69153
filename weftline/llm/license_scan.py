"""License scan: conditional compression against license templates, confirmed by exact wording differences."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from weftline.llm.common import slices, text_bytes

#: Wordings of public license statements. keys: words without which a statement is another license or version.
TEMPLATES: dict[str, tuple[str, str]] = {
    "MIT": ("Released under the MIT License.", "mit"),
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "permission granted",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "permission fee granted"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "apache 2.0 compliance",
    ),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution permitted conditions"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        "gnu general 3 foundation",
    ),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "gnu lesser 2.1"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "cc by 4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "cc by-nd 4.0"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "cc by-nc-sa 4.0"),
    "CC0-1.0": ("Released under CC0 1.0 Universal, dedicated to the public domain.", "cc0 1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    "Proprietary": ("Copyright. All rights reserved.", "all rights reserved"),
}
#: Parameters: least share of a span's compressed size that a template saves, most of a template's words that may be
#: missing, how many added words weigh as much as a missing one in the generous and in the tight alignment.
MIN_GAIN = 0.25
MAX_MISSING = 0.25
WEIGHTS = (4, 1)
WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
BREAK = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def aligned(wanted: np.ndarray, own: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost, first, missing) for each number of words of ``own``: the best span that ends there.

    A missing word costs ``weight``, an added one 1; the cost is the least over all spans that end
    there, and the shortest of equals counts. A row of the table is one numpy step.
    """
    at = np.arange(len(own) + 1)
    unit = len(own) + 2  # a number holds cost * unit + words in the span
    slope, best = at * (unit + 1), np.zeros(len(own) + 1, np.int64)
    for w in wanted:
        moved = best + weight * unit
        here = np.flatnonzero(own == w)
        moved[here + 1] = np.minimum(moved[here + 1], best[here] + 1)
        best = np.minimum.accumulate(moved - slope) + slope
    cost, length = best // unit, best % unit
    return cost, at - length, (len(wanted) + cost - length) // (weight + 1)


def differences(wanted: list[str], own: list[str]) -> tuple[list[str], list[str]]:
    """(missing, added) words."""
    missing, added = [], []
    for op, a, b, c, d in difflib.SequenceMatcher(None, wanted, own, autojunk=False).get_opcodes():
        if op != "equal":
            missing += wanted[a:b]
            added += own[c:d]
    return missing, added


@dataclass
class Scanner:
    """The templates with their compressors; built once in a task."""

    templates: dict[str, tuple[str, str]] = field(default_factory=lambda: TEMPLATES)

    def __post_init__(self) -> None:
        options = dict(level=9, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(**options)
        self.known, self.number = [], {}
        for name, (text, keys) in self.templates.items():
            own = words(text)
            raw = zstandard.ZstdCompressionDict(" ".join(own).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in own], np.int64)
            self.known.append((name, own, frozenset(keys.split()), zstandard.ZstdCompressor(dict_data=raw, **options), ids))
        self.needed = {tuple(k.encode() for k in sorted(t[2], key=len, reverse=True)) for t in self.known}

    def possible(self, low: bytes, start: int, stop: int) -> bool:
        """Whether the key words of some template all stand in the lower-case bytes from start to stop."""
        return any(all(low.find(k, start, stop) >= 0 for k in keys) for keys in self.needed)

    def gain(self, data: bytes, i: int) -> float:
        """The share of the compressed size of a span that template i as raw dictionary saves."""
        alone = len(self.plain.compress(data))
        return (alone - len(self.known[i][3].compress(data))) / alone

    def candidates(self, own: list[str], ids: np.ndarray, sentence: list[tuple[int, int]], lo: int, hi: int) -> list[tuple]:
        """(order, first word, end word, template number, gain, missing, added) of all spans among the words lo to hi that a template confirms.

        Key words may stand anywhere in the sentences that the span touches. More words in common
        less differences come first, then fewer differences, larger gain and the order of the templates.
        """
        there, out, seen = set(own[lo:hi]), [], set()
        for i, (_, wanted, keys, _, numbers) in enumerate(self.known):
            most = MAX_MISSING * len(wanted)
            if not keys <= there or sum(w not in there for w in wanted) > most:
                continue
            for weight in WEIGHTS:
                cost, first, missing = aligned(numbers, ids[lo:hi], weight)
                ends = np.flatnonzero(missing[1:] <= most) + 1
                ends = ends[np.isin(ids[lo + ends - 1], numbers)]
                taken: list[tuple[int, int]] = []
                for e in ends[np.argsort(cost[ends], kind="stable")].tolist():
                    a, b = lo + int(first[e]), lo + e
                    if not free(taken, a, b):
                        continue
                    insort(taken, (a, b))
                    if (i, a, b) in seen or not keys <= set(own[max(lo, sentence[a][0]) : min(hi, sentence[b - 1][1])]):
                        continue
                    seen.add((i, a, b))
                    gain = self.gain(" ".join(own[a:b]).encode(), i)
                    gone, added = differences(wanted, own[a:b])
                    if gain >= MIN_GAIN and len(gone) <= most:
                        unlike = len(gone) + len(added)
                        out.append(((len(gone) + unlike - len(wanted), unlike, -gain, i, a), a, b, i, gain, gone, added))
        return sorted(out, key=lambda c: c[0])

    def scan(self, text: str) -> list[tuple[int, int, str, float, list[str], list[str]]]:
        """(start, end, license, gain, missing, added) of each license statement, by place.

        Every span of words is compared, whatever lines it runs over; what the best spans leave is
        scanned again until nothing more is found. A statement reaches from its span to the ends of the
        sentence and line there, or to the next statement; all its other words are added ones.
        """
        places = [m.span() for m in WORD.finditer(text)]
        own = [text[a:b].lower() for a, b in places]
        starts, sentence = [a for a, _ in places], []
        cuts = sorted({bisect_left(starts, m.end()) for m in BREAK.finditer(text)} | {0, len(own)})
        for a, b in zip(cuts, cuts[1:]):
            sentence += [(a, b)] * (b - a)
        ids = np.array([self.number.get(w, -1) for w in own], np.int64)
        found, todo = [], [(0, len(own))]
        while todo:
            lo, hi = todo.pop()
            taken, best = [], []
            for c in self.candidates(own, ids, sentence, lo, hi):
                if free(taken, c[1], c[2]):
                    insort(taken, (c[1], c[2]))
                    best.append(c)
            if best:
                found += best
                edges = [lo, *(x for span in taken for x in span), hi]
                todo += [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b > a]
        found.sort(key=lambda c: c[1])
        out, before = [], 0
        for n, (_, a, b, i, gain, missing, added) in enumerate(found):
            lo, hi = max(before, sentence[a][0]), min(sentence[b - 1][1], found[n + 1][1] if n + 1 < len(found) else len(own))
            stop = places[hi - 1][1]
            while stop < len(text) and not text[stop].isspace() and not (hi < len(own) and stop >= places[hi][0]):
                stop += 1
            out.append((places[lo][0], stop, self.known[i][0], gain, missing, own[lo:a] + added + own[b:hi]))
            before = hi
        return out


def free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether the span from a to b meets none of the sorted, separate ones."""
    n = bisect_left(taken, (a, b))
    return (n == 0 or taken[n - 1][1] <= a) and (n == len(taken) or taken[n][0] >= b)


SCHEMA = "doc_id long, start long, stop long, license string, gain double, missing array<string>, added array<string>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A row for each license statement: its place in code points, license, gain, and the exact wording differences.

    Null and empty texts give no rows, a null id stays null, repeated rows give repeated results, and
    other columns are ignored. Of templates that meet at one place the one with more words in common less
    differences wins; ties go to fewer differences, then larger gain, then the order of the templates.
    Every span of a text is compared, over any lines; a task holds one Arrow batch.
    """
    wanted = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted)
        for batch in batches:
            for part in slices(batch, 1):
                raw, offs = text_bytes(part.column(1))
                data, bounds, own, rows = raw.tobytes(), offs.tolist(), [], []
                low = data.lower()
                for i in range(part.num_rows):
                    if scanner.possible(low, bounds[i], bounds[i + 1]):
                        found = scanner.scan(data[bounds[i] : bounds[i + 1]].decode("utf-8", "replace"))
                        rows += found
                        own += [i] * len(found)
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).cast(pa.int64()).take(pa.array(own)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                        ["doc_id", "start", "stop", "license", "gain", "missing", "added"],
                    )

    return docs.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, SCHEMA)
