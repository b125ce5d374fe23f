"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A shingle is three consecutive words. Texts and templates are cut into windows of 8
shingles that start 4 apart (in templates 1 apart); a window's MinHash signature has
32 values and every value is a band of its own, so two windows of Jaccard similarity
s share a band with a probability of 1 - (1 - s) ** 32: at 0.3 and above more than
0.99998. The texts' half windows of 4 shingles are asked too, so a template of a single
shingle, which is a quarter of the half window that holds it, meets it with a
probability of 0.9999. Documents that share a band with a template's window are verified:
the share of the template's distinct shingles that occur in the document, counted
exactly over the whole text, must be ``LEAST`` (0.8) or more.

The templates' bands travel with the function; they are as large as the list of
templates, whose size is checked (``MOST_TEMPLATE_WORDS``).

Edge cases: a null or empty text, or one of under three words, matches nothing. A
template of fewer than three words can't be shingled and is an error. Documents
without doc_id are scanned as well and their matches carry a null doc_id. Rows that
repeat give their matches each. Further columns aren't read. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bough.llm import text as T

SHINGLE, WINDOW, STRIDE, BANDS = 3, 8, 4, 32
LEAST = 0.8
MOST_TEMPLATE_WORDS = 1_000_000

#: Notices as authors put them into their works.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "all-rights-reserved": "All rights reserved.",
    "proprietary": "All rights reserved. No part of this publication may be reproduced without permission",
}

_MULS = T.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _values(h: np.ndarray, band: int) -> np.ndarray:
    return (h * _MULS[band]) >> np.uint64(32)


class Templates:
    """Shingles and bands of the templates."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        row, h = T.words(pa.array([templates[k].lower() for k in self.names], pa.string()))
        if len(h) > MOST_TEMPLATE_WORDS:
            raise ValueError("too many templates for one pass; scan with parts of them")
        at, g = T.grams(row, h, SHINGLE)
        self.shingles = [np.unique(g[row[at] == k]) for k in range(len(self.names))]
        short = [n for n, s in zip(self.names, self.shingles, strict=True) if not len(s)]
        if short:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        pairs = []
        for k in range(len(self.names)):
            own = g[row[at] == k]
            windows = [own[i : i + WINDOW] for i in range(max(1, len(own) - WINDOW + 1))]
            for band in range(BANDS):
                values = np.unique([_values(w, band).min() for w in windows])
                pairs += [(band, int(v), k) for v in values]
        pairs.sort()
        self.bands = []
        for band in range(BANDS):
            mine = [(v, k) for b, v, k in pairs if b == band]
            seen = np.zeros(1 << 16, bool)
            value = np.array([v for v, _ in mine], np.uint64)
            seen[(value & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.bands.append((seen, value, np.array([k for _, k in mine], np.int64)))

    def candidates(self, row: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Distinct (row, template) pairs, as row * templates + template, of rows of shingles in order."""
        if not len(g):
            return np.zeros(0, np.int64)
        # blocks of STRIDE shingles of one row; a window is a block and the next of its row
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.append(begin, len(row)))
        per = -(-size // STRIDE)
        base = np.repeat(np.cumsum(per) - per, per)
        start = np.repeat(begin, per) + (np.arange(per.sum()) - base) * STRIDE
        owner = row[start].astype(np.int64)
        joined = np.flatnonzero(owner[1:] == owner[:-1])
        found = []
        for band, (seen, value, name) in enumerate(self.bands):
            least = np.minimum.reduceat(_values(g, band), start)
            window = least.copy()
            window[joined] = np.minimum(least[joined], least[joined + 1])
            for least_of in (window, least):
                hit = np.flatnonzero(seen[(least_of & np.uint64(0xFFFF)).astype(np.int64)])
                lo, hi = np.searchsorted(value, least_of[hit], "left"), np.searchsorted(value, least_of[hit], "right")
                several = hi - lo
                hit, lo, several = hit[several > 0], lo[several > 0], several[several > 0]
                at = np.repeat(lo, several) + np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
                found.append(np.repeat(owner[hit], several) * len(self.names) + name[at])
        return np.unique(np.concatenate(found))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, license, containment): the templates that a document contains."""
    known = Templates(TEMPLATES if templates is None else templates)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        row, h = T.words(part.column("text"))
        at, g = T.grams(row, h, SHINGLE)
        row = row[at]
        rows, names, shares = [], [], []
        n = len(known.names)
        for pair in known.candidates(row, g).tolist():
            r, k = divmod(pair, n)
            own = g[np.searchsorted(row, r, "left") : np.searchsorted(row, r, "right")]
            share = float(np.isin(known.shingles[k], own).mean())
            if share >= least:
                rows.append(r), names.append(known.names[k]), shares.append(share)
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "license", "containment"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.lower(docs["text"]).alias("text")).mapInArrow(T.in_slices(run), "doc_id long, license string, containment double")


_VALUES = ",\n  ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
_CLASS = r"([0-9a-z]|[^\x00-\x7F])+"
ORACLE = f"""
WITH t(license, text) AS (VALUES
  {_VALUES}),
tw AS (SELECT license, regexp_extract_all(lower(text), '{_CLASS}') AS w FROM t),
ts AS (SELECT DISTINCT license, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT license, w, unnest(range(1, len(w) - 1)) AS i FROM tw)),
tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '{_CLASS}') AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM dw))
SELECT ds.doc_id, ts.license, count(*)::DOUBLE / n AS containment
FROM ds JOIN ts USING (s) JOIN tn USING (license)
GROUP BY ds.doc_id, ts.license, n HAVING count(*)::DOUBLE / n >= {LEAST}
"""
