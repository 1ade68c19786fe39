"""Licenses beyond the lines of the test documents, and places that two licenses claim."""

from loomgraph.llm import licenses


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [set() for _ in texts]
    for r in licenses.scan(df).collect():
        out[r.doc_id].add(r.license)
    return out


def test_notices_and_spdx_lines(spark):
    texts = ["x y. All rights reserved. z", "a b SPDX-License-Identifier: GPL-2.0-or-later c", "SPDX-License-Identifier: LGPL-2.1", "SPDX-License-Identifier: GPL-9.0", "it is Licensed under CC BY-SA 4.0. now", "w Distributed under the Boost Software License, Version 1.0. w"]
    assert found(spark, texts) == [{"all-rights-reserved"}, {"gpl-2.0"}, {"lgpl-2.1"}, set(), {"cc-by-sa-4.0"}, {"bsl-1.0"}]


def test_the_license_that_explains_more_wins(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Released under the BSD License.", licenses.TEMPLATES["agpl-3.0"][1], licenses.TEMPLATES["gpl-2.0"][1]]
    assert found(spark, texts) == [{"cc-by-nc-4.0"}, {"cc-by-4.0"}, {"cc-by-nc-sa-4.0"}, {"cc-by-nc-4.0"}, {"bsd"}, {"agpl-3.0"}, {"gpl-2.0"}]


def test_whole_texts(spark):
    bodies = {k: v[-1] for k, v in licenses.registered().items() if k in ("gpl-2.0", "lgpl-2.1", "mpl-2.0", "cc0-1.0", "unlicense", "bsd", "bsl-1.0")}
    for name, got in zip(bodies, found(spark, [f"head {t.replace('software', 'program', 2)} tail" for t in bodies.values()])):
        assert name in got
