"""Vector search over symbols, and what surrounds a hit."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators import graph

#: Queries that `nearest` takes at once; more are taken in blocks.
MOST_QUERIES = 1000
Embed = Callable[[list[str]], np.ndarray]


def hashed_embedding(dimensions: int = 256) -> Embed:
    """An embedding without a model: signed hashed counts of words and letter triples."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, t in enumerate(texts):
            low = (t or "").lower()
            for piece in [*re.findall(r"\w+", low), *(low[j : j + 3] for j in range(len(low) - 2))]:
                h = xxhash.xxh64_intdigest(piece)
                out[i, h % dimensions] += 1.0 if h >> 63 else -1.0
        return out

    return embed


def embedded(texts: DataFrame, text_col: str, embed: Embed, batch: int = 64) -> DataFrame:
    """`texts` with a column `embedding` of unit length; `embed` gets at most `batch` texts at once, on the executors."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(column: pd.Series) -> pd.Series:
        parts = [embed(column[lo : lo + batch].fillna("").tolist()) for lo in range(0, len(column), batch)]
        v = np.vstack(parts) if parts else np.zeros((0, 1), np.float32)
        return pd.Series(list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)))

    return texts.withColumn("embedding", run(text_col))


def unit(df: DataFrame, c: str, name: str) -> DataFrame:
    """`df` with column `name`: the vector `c` scaled to length 1 (a zero vector stays); the length is worked out once."""
    length = F.expr(f"coalesce(nullif(sqrt(aggregate({c}, 0D, (a, y) -> a + cast(y as double) * y)), 0D), 1D)")
    return df.withColumn("__length", length).withColumn(name, F.transform(c, lambda x: x / F.col("__length"))).drop("__length")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, allowed: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors of the greatest inner product with each query, itself left out.

    `queries` (vec_id, embedding) are taken in blocks of MOST_QUERIES, each broadcast; a task keeps the best k of its rows
    for each query before anything is dealt out.  `allowed` is a condition on the vectors (kind, project); if none meets it
    there are no hits.  The order is that of the exact product; the score is rounded.
    """
    v = unit(vectors if allowed is None else vectors.where(allowed), "embedding", "v").select("vec_id", "v")
    asked = unit(queries, "embedding", "q").select(F.col("vec_id").alias("query_id"), "q")
    n = asked.count()
    blocks = max(1, -(-n // MOST_QUERIES))
    dot = F.expr("aggregate(zip_with(v, q, (a, b) -> a * b), 0D, (a, x) -> a + x)")
    w = Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id")
    found = None
    for i in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        scored = v.join(F.broadcast(block), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(dot, 9).alias("exact"))
        best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        found = best if found is None else found.union(best)
    return found.select("query_id", "vec_id", F.round("exact", 4).alias("score"), "rank")


def search(index: DataFrame, text: str, embed: Embed, graphs: dict[str, tuple[DataFrame, str, str]], top_k: int = 20, depth: int = 2, kind: str | None = None, project_id: str | None = None) -> DataFrame:
    """(rank, score, fqn, kind, project_id, summary, context) for one question: the nearest symbols of an index
    (vec_id, fqn, kind, project_id, summary, embedding) and what surrounds each in the graphs, sorted."""
    rows = index
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if project_id:
        rows = rows.where(F.col("project_id") == project_id)
    v = embed([text])[0].astype(float)
    question = index.sparkSession.createDataFrame([(-1, [float(x) for x in v])], "vec_id long, embedding array<double>")
    hits = nearest(rows.select("vec_id", "embedding"), question, top_k).select("vec_id", "score", "rank")
    found = F.broadcast(hits).join(rows.drop("embedding"), "vec_id")  # top_k rows
    around = graph.context(graphs, found.select("fqn"), depth).groupBy(F.col("root").alias("fqn")).agg(F.array_sort(F.collect_set("context")).alias("context"))
    out = found.join(around, "fqn", "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
    return out.select("rank", "score", "fqn", "kind", "project_id", "summary", "context").orderBy("rank")


def build_index(symbols: DataFrame, summaries: DataFrame, embed: Embed, batch: int = 64) -> DataFrame:
    """(vec_id, fqn, kind, project_id, summary, embedding): a vector for the summary of each symbol.  The search is exact,
    so that the table of vectors is the index."""
    rows = symbols.select("fqn", "kind", "project_id").join(summaries, "fqn").withColumn("vec_id", F.xxhash64("fqn"))
    return embedded(rows, "summary", embed, batch).select("vec_id", "fqn", "kind", "project_id", "summary", "embedding")
