"""The pipeline against its stages' brute-force meaning on the smallest tables."""

import corpus_pipeline
import public_tokenizers
import tiktoken

from loomgraph.llm import bpe

AT = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet").collect()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, AT).collect()}
    assert set(got) <= {d.doc_id for d in docs}
    items = [r.text for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    texts = {d.doc_id: d.text for d in docs}
    assert not [i for i in got if any(t in texts[i] for t in items)]
    first = {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        first.setdefault(d.text, d.doc_id)
    assert all(first[texts[i]] == i for i in got)  # of exact copies only the first
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert all(r.round_trip for r in got.values())
    assert all(len(enc.decode(list(map(int, r.ids.split(","))) if r.ids else [])) <= len(texts[i]) for i, r in got.items())
    assert len(corpus_pipeline.STAGES) == 5
