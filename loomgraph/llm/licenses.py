"""License scans: winnowed fingerprints of license templates pick candidates, banded alignment measures them."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bytetext as bt

#: Texts by which licenses are known (grants, notices, and the short lines that name them); `registered`
#: adds SPDX lines and the whole texts beside this file.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "bsd": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "lgpl-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "lgpl-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ],
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-nc-sa-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by-nc-nd-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "cc0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "epl-2.0": ["Licensed under the Eclipse Public License, Version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "epl-1.0": ["Licensed under the Eclipse Public License, Version 1.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "all-rights-reserved": ["All rights reserved."],
}
#: License -> identifiers of its SPDX lines.
SPDX = {
    "mit": ["MIT"], "isc": ["ISC"], "zlib": ["Zlib"], "unlicense": ["Unlicense"], "bsl-1.0": ["BSL-1.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"],
    "cc0-1.0": ["CC0-1.0"], "epl-1.0": ["EPL-1.0"], "artistic-1.0": ["Artistic-1.0"], "artistic-2.0": ["Artistic-2.0"],
    **{x: [x.upper()] for x in ("epl-2.0", "mpl-1.1", "mpl-2.0", "apache-2.0", "cc-by-4.0", "cc-by-sa-4.0", "cc-by-nd-4.0", "cc-by-nc-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0")},
    **{x: [x.upper(), f"{x.upper()}-only", f"{x.upper()}-or-later"] for x in ("gpl-1.0", "gpl-2.0", "gpl-3.0", "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "gfdl-1.2", "gfdl-1.3")},
}
SPDX_LINE = "SPDX-License-Identifier: "


def registered() -> dict[str, list[str]]:
    """All templates: those above, SPDX lines, whole texts."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for name, ids in SPDX.items():
        out.setdefault(name, []).extend(SPDX_LINE + i for i in ids)
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        out.setdefault(path.stem, []).append(path.read_text(encoding="utf-8"))
    return out


GRAM = 3
WINDOW = 4
BAND = 8
#: Templates of more tokens are aligned only where a bound does not rule it out.
LONG = 64
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s, e, r = bt.words(data, offsets, _BREAK)
    h = bt.spans_hash(bt.prefix(bt.lower(data)), s, e) if len(s) else np.zeros(0, np.uint64)
    return h, s, e, r


class Index:
    """The inverted index: winnowed gram hash -> (template, token position)."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names = [(name, i) for name, texts in templates.items() for i in range(len(texts))]
        texts = [t for v in templates.values() for t in v]
        data, offsets = bt.buffer_of(pa.array(texts, pa.large_string()))
        h, _, _, r = _tokens(data, offsets)
        self.tokens = [h[r == k] for k in range(len(texts))]
        self.whole = [t.startswith(SPDX_LINE) for t in texts]  # every token of an SPDX line tells
        found: dict[int, list[tuple[int, int]]] = {}
        for k, tokens in enumerate(self.tokens):
            keys, at = bt.grams(tokens, np.zeros(len(tokens), np.int64), GRAM)
            least = bt.sliding(keys, WINDOW, np.minimum)
            chosen = [j for j in range(len(keys)) if len(keys) < WINDOW or keys[j] in least[max(0, j - WINDOW + 1) : j + 1]]
            for j in chosen:
                found.setdefault(int(keys[j]), []).append((k, int(at[j])))
        self.keys = np.array(sorted(found), np.uint64)
        self.postings = [found[k] for k in sorted(found)]

    def candidates(self, keys: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """(template, document token where the template would begin) for each indexed gram among `keys`."""
        j = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[j] == keys)
        return sorted({(k, int(at[x]) - p) for x in hit for k, p in self.postings[j[x]]})


def at_most(template: np.ndarray, tokens: np.ndarray, band: int = BAND) -> np.ndarray:
    """For each `begin` from -(len(template) + band) on a number that `align` cannot exceed there: how many of the
    template's tokens occur at most `band` off the diagonal."""
    order = np.argsort(tokens, kind="stable")
    lo, hi = (np.searchsorted(tokens[order], template, side) for side in ("left", "right"))
    count = hi - lo
    i = np.repeat(np.arange(len(template)), count)
    d = order[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(len(i))] - i
    start, end = d - band, d + band + 1
    start[1:] = np.where(i[1:] == i[:-1], np.maximum(start[1:], end[:-1]), start[1:])  # a token counts once
    zero, size = len(template) + band, len(template) + len(tokens) + 2 * band + 2
    return np.cumsum(np.bincount(start + zero, minlength=size) - np.bincount(end + zero, minlength=size))


def align(template: np.ndarray, tokens: np.ndarray, begin: int, band: int = BAND) -> tuple[int, int, int]:
    """Longest common subsequence of the template and the tokens near the diagonal that starts at `begin`, at most
    `band` off it: (matched tokens, first and last matched document token)."""
    width = 2 * band + 1
    best = np.zeros(width + 1, np.int64)
    first = np.full(width + 1, -1)
    last = np.full(width + 1, -1)
    for i, t in enumerate(template):
        nb, nf, nl = np.zeros(width + 1, np.int64), np.full(width + 1, -1), np.full(width + 1, -1)
        for d in range(width):
            j = begin + i + d - band
            b, f, z = best[d + 1], first[d + 1], last[d + 1]  # a template token is skipped
            if d and nb[d - 1] > b:  # a document token is skipped
                b, f, z = nb[d - 1], nf[d - 1], nl[d - 1]
            if 0 <= j < len(tokens) and tokens[j] == t and best[d] + 1 > b:
                b, f, z = best[d] + 1, first[d] if first[d] >= 0 else j, j
            nb[d], nf[d], nl[d] = b, f, z
        best, first, last = nb, nf, nl
    d = int(best[:width].argmax())
    return int(best[d]), int(first[d]), int(last[d])


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, template, coverage, start_byte, end_byte): places where a template's tokens are matched.

    A place is reported if the alignment matches at least `coverage` of the template's tokens and no better place of the
    same template overlaps it; a place with tokens unmatched in it or in the template gives way to one of another license
    around it that matches more tokens, or as many and a greater share of its own.  Null and empty texts have no places, rows without an id are reported with a null id,
    repeated rows are reported each, an empty table gives no rows.
    """
    index = Index(templates or registered())  # about 1 MB, whatever the corpus is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            out = []
            for lo, _, data, offsets in bt.pieces(bt.column(b, "text")):
                h, s, e, r = _tokens(data, offsets)
                keys, at = bt.grams(h, r, GRAM)
                j = np.minimum(np.searchsorted(index.keys, keys), len(index.keys) - 1)
                for row in np.unique(r[at[index.keys[j] == keys]]):
                    a, z = np.searchsorted(r, [row, row + 1])
                    own = (at >= a) & (at < z)
                    hits, done, most = [], {}, {}
                    for k, begin in index.candidates(keys[own], at[own] - a):
                        if begin - done.get(k, -(1 << 60)) < BAND // 2:
                            continue  # the band of the last alignment covers this diagonal
                        least = (1.0 if index.whole[k] else coverage) * len(index.tokens[k])
                        done[k] = begin
                        if z - a < least:
                            continue
                        if len(index.tokens[k]) > LONG:
                            if k not in most:
                                most[k] = at_most(index.tokens[k], h[a:z])
                            if most[k][begin + len(index.tokens[k]) + BAND] < least:
                                continue
                        n, first, last = align(index.tokens[k], h[a:z], begin)
                        if n >= least:
                            hits.append((-n, k, first, last))
                    taken: list[tuple[int, int, int]] = []
                    for n, k, first, last in sorted(hits):
                        if -n < max(len(index.tokens[k]), last - first + 1) and any((-m, -m / len(index.tokens[k2])) > (-n, -n / len(index.tokens[k])) and f2 <= first and last <= l2 and index.names[k2][0] != index.names[k][0] for m, k2, f2, l2 in hits):
                            continue
                        if all(k != k2 or last < f2 or first > l2 for k2, f2, l2 in taken):
                            taken.append((k, first, last))
                            name, i = index.names[k]
                            out.append((ids[lo + row], name, i, -n / len(index.tokens[k]), int(s[a + first] - offsets[row]), int(e[a + last] - offsets[row])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "license", "template", "coverage", "start_byte", "end_byte"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, license string, template int, coverage double, start_byte long, end_byte long")


def op3_license_scans(spark, sf_dir: str) -> DataFrame:
    """All documents against all templates."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
