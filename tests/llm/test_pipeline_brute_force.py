"""The whole pipeline, row by row, against a plain version: with rows without id or text, repeated rows, shared ids, texts
without letters, copies, shared passages, benchmark items, and tables with nothing in them."""

import collections
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from loomgraph.llm import bpe, langid
from loomgraph.llm import bytetext as bt

AT = "/root/testdata/sf0.001"


def words(text):
    return text.encode().lower().split()


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_dedup(rows):
    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        key = (r["doc_id"], i)
        best[find(i)] = min(best.get(find(i), key), key)
    return [rows[i] for _, i in sorted(best.values())]


def span_dedup(rows, length=400):
    texts = [r["text"].encode() for r in rows]
    seen = collections.Counter(t[j : j + length] for t in texts for j in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                gone[j : j + length] = True
        out.append(r | {"text": bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore") if gone.any() else r["text"]})
    return out


def tokens(text):
    return re.findall(rb"[0-9]+(?:[.,][0-9]+)*|[A-Za-z0-9\x80-\xff]+", text.encode().lower())


def decontamination(rows, items, n=10):
    grams = set()
    for t in items:
        k = tokens(t)
        grams |= {tuple(k[i : i + n]) for i in range(len(k) - n + 1)} if len(k) >= n else {tuple(k)}
    sizes = {len(g) for g in grams} - {0}
    held = lambda k: any(tuple(k[i : i + s]) in grams for s in sizes for i in range(len(k) - s + 1))
    return [r for r in rows if not held(tokens(r["text"]))]


def plain(spark, rows, items, model):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    kept = []
    for r in rows:
        if r["doc_id"] is not None and any(c.isalpha() for c in r["text"] or ""):
            data, offsets = bt.buffer_of(pa.array([r["text"]], pa.large_string()))
            kept.append(r | {"lang": model.predict(langid.features(data, offsets))[0][0]})
    for stage in (near_dedup, span_dedup, lambda x: decontamination(x, items)):
        kept = stage(kept)
    return sorted((r["doc_id"], r["lang"], r["source"], ",".join(map(str, enc.encode_ordinary(r["text"])))) for r in kept)


def test_same_as_plain_version(spark, tmp_path):
    have = spark.read.parquet(f"{AT}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    real = [r.asDict() for r in have.where("doc_id < 120").collect()]
    item = "In which old harbour town did the sailors of the northern fleet build their first wooden lighthouse in spring"
    base = " ".join(f"w{chr(97 + i % 26)}o{i}rd" for i in range(90))
    other = " ".join(f"q{chr(97 + i % 26)}u{i}x" for i in range(90))
    passage = " ".join(f"p{chr(97 + i % 26)}as{i}" for i in range(70))
    odd = [None, "", "12 34 !!", "日本語のテキスト", base, base, base.replace("wao0rd", "changed"), f"{other} {passage}", f"{passage} {' '.join(reversed(other.split()))}", f"they asked: {item.lower()} and left", "a" * 3000]
    rows = real + [{"doc_id": 900 + i, "text": t, "lang": None, "source": "odd", "n_chars": 1} for i, t in enumerate(odd)]
    rows += [{"doc_id": 905, "text": base, "lang": "x", "source": "odd", "n_chars": 1}, {"doc_id": 908, "text": "another short text that shares its id with one more", "lang": "x", "source": "odd", "n_chars": 1}, {"doc_id": None, "text": "no id at all", "lang": "x", "source": "odd", "n_chars": 1}]
    spark.createDataFrame([tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in rows], have.schema).write.parquet(f"{tmp_path}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()] + [item]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = langid.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.lang, r.source, r.ids) for r in got) == plain(spark, rows, items, model)
    assert all(r.round_trip and r.n_tokens == len(r.ids.split(",")) * (r.ids != "") for r in got)


def test_every_stage_takes_an_empty_table_and_other_columns(spark, tmp_path):
    have = spark.read.parquet(f"{AT}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = have.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    more = have.limit(20).selectExpr("*", "1 as rid", "2 as node", "3 as row_id", "'x' as ids", "4 as lang_pred", "5 as score", "6 as k64", "7 as doc")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, str(tmp_path))
        assert out.count() > 0 and (name == "byte_bpe" or out.columns == list(corpus_pipeline.COLUMNS)), name
