"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment decides."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import slices
from .words import mix64, shingles, word_hashes

WORDS = 5
CONTAINMENT = 0.8
#: One minimum hash a band. A window that holds 0.8 of a template's shingles has a Jaccard similarity of 0.4 or more
#: with it, so the pair shares a band with a probability of 1 - 0.6 ** 16 > 0.9997 at least.
BANDS = 16
#: Public notice texts; case, marks and white space do not matter.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
                         "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                         "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                         "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                      "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
                      "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
                      "the Software is furnished to do so, subject to the following conditions:",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                      "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
           "conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-international": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


class Index:
    """Templates by the minimum hash of each band, and their shingles."""

    def __init__(self, templates: dict[str, str], words: int = WORDS, bands: int = BANDS):
        self.names = sorted(templates)
        values, ends = shingles(*word_hashes(pa.array([templates[n] for n in self.names], pa.string()), marks=False), words)
        self.sets = [np.unique(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        short = [n for n, s in zip(self.names, np.diff(ends)) if s < 1]
        if short:
            raise ValueError(f"templates without words: {short}")
        self.lengths = np.diff(ends)
        self.strides = np.maximum(1, self.lengths // 4)
        self.factors = mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        self.lows = [[int(((s * f) >> np.uint64(16)).min()) for s in self.sets] for f in self.factors]
        # a first sieve by the low 16 bits
        self.sieve = np.zeros((bands, 1 << 16), bool)
        for band, lows in enumerate(self.lows):
            self.sieve[band, [v & 0xFFFF for v in lows]] = True

    def candidates(self, values: np.ndarray, ends: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, template, window) whose window's minimum hash equals the template's in some band.

        Windows of a template's length and a quarter more start at every quarter. Window minima are looked at only
        where a template's minimum occurs at all, which gives the same candidates.
        """
        found: set[tuple[int, int, int]] = set()
        for a in range(0, len(values), 1 << 16):
            part = values[a:a + (1 << 16)]
            for band, factor in enumerate(self.factors):
                hashed = (part * factor) >> np.uint64(16)
                for at in np.flatnonzero(self.sieve[band][(hashed & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
                    value = int(hashed[at])
                    for template, low in enumerate(self.lows[band]):
                        if low == value:
                            self._windows(values, ends, a + at, template, factor, value, found)
        return found

    def _windows(self, values, ends, at: int, template: int, factor: np.uint64, value: int, found: set) -> None:
        text = int(np.searchsorted(ends, at, side="right")) - 1
        first, last = int(ends[text]), int(ends[text + 1])
        stride, length = int(self.strides[template]), int(self.lengths[template])
        for window in range(max(0, (at - first - length - stride) // stride + 1), (at - first) // stride + 1):
            key = (text, template, window)
            low = first + window * stride
            if key not in found and at < low + length + stride and int(((values[low:min(last, low + length + stride)] * factor) >> np.uint64(16)).min()) == value:
                found.add(key)

    def matches(self, values: np.ndarray, ends: np.ndarray, containment: float) -> list[tuple[int, int, float, int, int]]:
        """(text, template, containment, first shingle, past the last shingle) of verified places.

        Candidate windows of a template that overlap are one place; its share of the template's shingles is exact.
        """
        out = []
        places: dict[tuple[int, int], list[list[int]]] = {}
        for text, template, window in sorted(self.candidates(values, ends)):
            low = window * int(self.strides[template])
            high = low + int(self.lengths[template] + self.strides[template])
            spans = places.setdefault((text, template), [])
            if spans and low < spans[-1][1]:
                spans[-1][1] = high
            else:
                spans.append([low, high])
        for (text, template), spans in places.items():
            first, last = int(ends[text]), int(ends[text + 1])
            for low, high in spans:
                place = values[first + low:min(last, first + high)]
                held = np.isin(place, self.sets[template])
                share = len(np.unique(place[held])) / len(self.sets[template])
                if share >= containment:
                    hits = np.flatnonzero(held)
                    out.append((text, template, share, low + int(hits[0]), low + int(hits[-1]) + 1))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, words: int = WORDS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every place where a text holds ``containment`` or more of a template's shingles of ``words`` words.

    Returns ``id_col, license, containment, first_word, n_words`` (words are runs of letters and numbers, counted from
    0). Whole texts are scanned, in one pass without a shuffle; empty and null texts give no row, repeated rows give
    theirs again, a null id stays null. One row for each place, so a text may have several.
    """
    index = Index(templates or TEMPLATES, words)  # the given templates, a parameter
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                values, ends = shingles(*word_hashes(part.column(1), marks=False), words)
                found = index.matches(values, ends, containment)
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(rows), pa.array([index.names[f[1]] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64()),
                    pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] - f[3] + words - 1 for f in found], pa.int64())],
                    ["id", "license", "containment", "first_word", "n_words"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, license string, containment double, first_word long, n_words long").withColumnRenamed("id", id_col)
