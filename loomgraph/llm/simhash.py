"""SimHash near-duplicates: fingerprints, a byte-position inverted index with count filtering, classes.

Method.  A 64-bit fingerprint has eight positional bytes.  Two fingerprints that differ in at most two bits share at
least six of them (the guaranteed minimum).  The inverted index therefore lists each distinct fingerprint under every
choice of six positional bytes (28 lists), which is the count filter made into a key: whoever shares six positional
bytes meets in a list, nobody else does.  Of each pair that meets the shared positional bytes are tallied, pairs that reach the
minimum are verified by their bits.  A list has at most 2**16 members, because the two bytes outside the key are
all that can differ; short lists are paired and verified, and a long list is split by masking every choice of two of
its 16 open bits, which links the same members with work in proportion to the list.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.components import connected_components
from loomgraph.llm.storage import cut

#: Seed of Spark's own xxhash64, so that fingerprints can be recomputed in SQL.
SEED = 42
#: Differing bits at most, and the positional bytes that two fingerprints then share at least.
RADIUS = 2
LEAST_SHARED = 8 - RADIUS
#: Lists of the inverted index up to this length are paired; longer ones are masked.
PAIRED = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text as an unsigned number; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        raw = digest(b" ".join(words), SEED)
        n = 1
    else:
        line = b" ".join(words)
        start, at = [], 0
        for w in words:
            start.append(at)
            at += len(w) + 1
        end = [s - 1 for s in start[shingle:]] + [len(line)]
        n = len(end)
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(start, end)])
    ones = np.zeros(64, np.int64)
    bits = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for lo in range(0, n, 65536):
        ones += np.unpackbits(bits[lo : lo + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row: fp is the fingerprint's 64 bits as a signed long.  Null texts have fp 0."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).astype(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) at two or fewer differing bits; enough of them that the
    components are those of all such links."""
    masks = []
    for open_bytes in combinations(range(8), 2):
        m = sum(0xFF << (8 * b) for b in open_bytes)
        bits = [8 * b + i for b in open_bytes for i in range(8)]
        masks.append((m, bits))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*[F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(signed(~m & ((1 << 64) - 1)))).alias("kept")) for i, (m, _) in enumerate(masks)])
    # as many tasks as the session deals out: each row becomes 28, however few bytes there are before
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = prints.select("fp").distinct().repartition(parts, F.xxhash64("fp")).select("fp", F.explode(keys).alias("k")).groupBy("k").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    tally = " + ".join(f"if((x ^ y) & {255 << (8 * b) if b < 7 else -(1 << 56)}L = 0, 1, 0)" for b in range(8))
    meets = f"{tally} >= {LEAST_SHARED} and bit_count(x ^ y) <= {RADIUS}"
    pairs = F.expr(f"flatten(transform(fps, (x, i) -> transform(filter(slice(fps, i + 2, size(fps)), y -> {meets}), y -> struct(greatest(x, y) as u, least(x, y) as v))))")
    short = lists.where(F.size("fps") <= PAIRED).select(F.explode(pairs).alias("e")).select("e.*").distinct()
    #: for a long list: every choice of two open bits (or one), masked out
    choices = F.array(*[F.array(*[F.lit(signed(~((1 << a) | (1 << b)) & ((1 << 64) - 1))) for a, b in combinations(bits, 2)]) for _, bits in masks])
    long = lists.where(F.size("fps") > PAIRED).select("k", F.explode("fps").alias("fp"))
    masked = long.select("fp", F.explode(F.element_at(choices, F.col("k.list") + 1)).alias("mask"))
    least = masked.groupBy("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("kept")).agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v < w")
    star = masked.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("kept"), F.col("fp").alias("u")).join(least.select("mask", "kept", "v"), ["mask", "kept"]).where("u <> v").select("u", "v").distinct()
    return short.union(star)


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for each row of `docs`.

    Rows with the same fingerprint are one class; classes link at two or fewer differing bits; component_id is the
    least doc_id reachable (rows without an id count only where no other id is there, giving null).  Empty and null
    texts have fingerprint zero and link like others.  Repeated rows stay repeated; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, shingle, id_col, text_col))
    ids = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(fingerprint_links(prints))
    classes = ids.join(roots, ids.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    classes = cut(classes)
    best = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = classes.join(best, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract query: 3-word shingles, links at two or fewer bits, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
