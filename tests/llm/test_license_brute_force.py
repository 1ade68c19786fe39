"""License scans against alignment at every place, and against plain search for the lines of the test documents."""

import re

import numpy as np
import pyarrow as pa

from loomgraph.llm import bytetext as bt
from loomgraph.llm import licenses

AT = "/root/testdata/sf0.01"
SOME = {"one": ["permission is hereby granted free of charge to any person who obtains a copy of this work and its documents"], "two": ["you may not use this file except in compliance with the license that stands beside it in the source tree"], "three": ["all rights are reserved by us"]}


def tokens(text):
    data, offsets = bt.buffer_of(pa.array([text or ""], pa.large_string()))
    return licenses._tokens(data, offsets)[0]


def best(template, text):
    """The greatest share of the template that alignment at any place matches."""
    t, x = tokens(template), tokens(text)
    return max((licenses.align(t, x, begin)[0] for begin in range(-len(t), len(x) + 1)), default=0) / len(t)


def test_edited_templates(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(80):
        name = ("one", "two", "three")[i % 3]
        w = SOME[name][0].split()
        for _ in range(int(rng.integers(0, 6))):
            j = int(rng.integers(0, len(w)))
            w[j : j + 1] = [[], ["other"], [w[j], "more"]][int(rng.integers(0, 3))]
        rows.append((i, " ".join(["before", *w, "after"])))
    rows += [(200, None), (201, ""), (202, rows[0][1]), (202, rows[0][1]), (None, rows[0][1]), (203, "free of charge to any person")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, license long, ids string")
    got = {}
    for r in licenses.scan(df, SOME).collect():
        got.setdefault((r.doc_id, r.license), []).append(r.coverage)
    for i, t in dict.fromkeys(rows):
        for name, (template,) in SOME.items():
            share = best(template, t) if t else 0
            if (i, name) in got:
                assert max(got[i, name]) <= share + 1e-9 and max(got[i, name]) >= 0.8
            else:
                assert share < 0.9  # what winnowing may miss is far from whole
    assert len(got[202, "one"]) == 2 and (None, "one") in got


def test_lines_of_the_test_documents(spark):
    lines = {"mit": "Released under the MIT License.", "all-rights-reserved": "All rights reserved.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0."}
    docs = spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    plain = lambda t: " ".join(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t.lower()))
    for r in docs.collect():
        for name, line in lines.items():
            if f" {plain(line)} " in f" {plain(r.text or '')} ":
                assert (r.doc_id, name) in got
