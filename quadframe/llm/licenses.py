"""License scans: passages of normalised text against license templates, by Dice over word bigrams.

Normalised text is its lower-cased runs of letters and digits. Every passage as long as a template (the
whole text where that is shorter) is compared with it: twice the shared bigrams, repeats counted, over the
bigrams of both. A template is only tried where size bounds allow a match: text and template lengths must
be within the factor that the threshold leaves, and the text must hold enough of the template's bigrams;
a running count then leaves only passages that hold enough of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+")

# Statements and notices by which public licenses are named.
TEMPLATES = {
    "All-Rights-Reserved": "All rights reserved.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold, self.names = threshold, sorted(templates)
        split = [words(templates[n]) for n in self.names]
        if any(len(s) < 2 for s in split):
            raise ValueError("a template needs two words")
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for s in split for w in s}))}
        v = len(self.vocabulary)
        self.sizes = [len(s) for s in split]
        self.bigrams = [Counter(self.vocabulary[a] * v + self.vocabulary[b] for a, b in zip(s, s[1:])) for s in split]
        self.number = np.full(v * v, -1, np.int32)  # of the bigrams that any template has
        known = sorted({b for c in self.bigrams for b in c})
        self.number[known] = np.arange(len(known))
        self.has = np.zeros((len(split), len(known)), bool)
        for t, c in enumerate(self.bigrams):
            self.has[t, self.number[list(c)]] = True

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, best Dice, its first word, passages) for each license that is found. Of passages that
        overlap, the most similar counts, then the longer, then the earlier, then the license by name."""
        split = words(text)
        n = len(split)
        if n < 2:
            return []
        ids = np.array([self.vocabulary.get(w, -1) for w in split], np.int64)
        pairs = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * len(self.vocabulary) + ids[1:], -1)
        number = np.where(pairs >= 0, self.number[pairs], -1)
        if not (number >= 0).any():
            return []
        held, matches = self.has[:, number] & (number >= 0), []
        for t in np.flatnonzero(held.any(1)):
            size, passage = self.sizes[t] - 1, min(self.sizes[t], n) - 1
            need = self.threshold * (size + passage) / 2
            if passage < need or held[t].sum() < need - 1e-9:
                continue
            upto = np.concatenate([[0], np.cumsum(held[t])])
            starts = np.flatnonzero(upto[passage:] - upto[:-passage] >= math.ceil(need - 1e-9))
            for s in starts.tolist():
                shared = sum((Counter(pairs[s : s + passage][held[t, s : s + passage]].tolist()) & self.bigrams[t]).values())
                dice = 2 * shared / (size + passage)
                if dice >= self.threshold - 1e-12:
                    matches.append((-dice, -passage, s, self.names[t]))
        taken, found = np.zeros(n, bool), {}
        for dice, passage, s, name in sorted(matches):
            if not taken[s : s - passage + 1].any():
                taken[s : s - passage + 1] = True
                best = found.setdefault(name, [-dice, s, 0])
                best[2] += 1
        return [(name, *best) for name, best in sorted(found.items())]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, dice, first_word, n_passages: a row for each license of a document, and one with
    nulls (n_passages 0) for a document without any.

    A null, empty or one-word text has no license; repeated rows are scanned each; an empty table gives no
    rows. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("dice", pa.float64()), ("first_word", pa.int64()), ("n_passages", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                rows += [(doc, *m) for m in scanner.scan(text.as_py() or "") or [(None, None, None, 0)]]
            if rows:
                yield common.batch(dict(zip(schema.names, zip(*rows))), schema)

    common.ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, license string, dice double, first_word long, n_passages long")
