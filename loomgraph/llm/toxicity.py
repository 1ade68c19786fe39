"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bytetext as bt
from loomgraph.llm.sampling import per_class

#: About so many labelled rows of each class are used to fit.
FIT_PER_CLASS = 4_000
#: Bytes of the longest text that is used to fit, so that what the driver gathers has a bound; all texts are scored.
FIT_LONGEST = 1 << 16
BITS = 22
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) pairs, each once: hashed words, their beginnings (6 and 7 bytes, for inflected words), pairs of
    neighbours, and pairs with one word between."""
    s, e, r = bt.words(data, offsets, _BREAK)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = bt.prefix(bt.lower(data))
    h = bt.spans_hash(sums, s, e)
    begin = [(bt.spans_hash(sums, s[at], s[at] + k) + np.uint64(0xBE61), r[at]) for k in (6, 7) for at in [np.flatnonzero(e - s > k)]]
    pair, at = bt.grams(h, r, 2)
    apart = np.flatnonzero(r[:-2] == r[2:]) if len(h) > 2 else np.zeros(0, np.int64)
    skip = bt.mix(h[apart] * bt.BASE + h[apart + 2] + np.uint64(0x5C1B))
    f = np.concatenate([h, pair, skip, *(x for x, _ in begin)]) >> np.uint64(64 - BITS)
    rows = np.concatenate([r, r[at], r[apart], *(x for _, x in begin)])
    both = np.unique((rows.astype(np.uint64) << np.uint64(BITS)) | f)
    return (both & np.uint64((1 << BITS) - 1)).astype(np.int64), (both >> np.uint64(BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal: w = 0 where |z| <= l1, else -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2)."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 20.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, f: np.ndarray) -> np.ndarray:
        z = self.z[f]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[f])) / self.alpha + self.l2))

    def learn(self, f: np.ndarray, y: float, weight: float = 1.0) -> None:
        f = np.append(f, 1 << BITS)  # the last coordinate is the bias
        w = self.weights(f)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y)
        sigma = (np.sqrt(self.n[f] + g * g) - np.sqrt(self.n[f])) / self.alpha
        self.z[f] += g - sigma * w
        self.n[f] += g * g

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Coordinates and weights that are not zero, and the bias."""
        w = self.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w[:-1])
        return at.astype(np.int32), w[at].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class_rows: int = FIT_PER_CLASS, epochs: int = 6, toxic_weight: float = 6.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Learns labels.toxic of rows whose crc32(doc_id as text) mod 3 is not 1; without such rows all weights are zero.

    A document that is labelled twice is toxic if one label says so.  Texts of more than FIT_LONGEST bytes do not fit.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(per_class(known, "toxic", per_class_rows))  # at most about 2 x per_class_rows pairs

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in bt.pieces(bt.column(b, "text")):
                f, r = features(data, offsets)
                ends = np.searchsorted(r, np.arange(hi - lo + 1)).astype(np.int32)
                x = [f[a:z].astype(np.int32).tobytes() for a, z in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    rows = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= FIT_LONGEST).join(chosen, "doc_id").select("doc_id", F.col("toxic").cast("int").alias("y"), "text").mapInArrow(extract, "doc_id long, y int, x binary").toPandas()
    rows = rows.sort_values("doc_id")
    model, rng = Ftrl(), np.random.default_rng(3)
    x, y = [np.frombuffer(v, np.int32) for v in rows["x"]], rows["y"].to_numpy(float)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            model.learn(x[i], y[i], toxic_weight if y[i] else 1.0)
    return model.compact()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, from its whole text alone.

    Null texts are scored as empty ones (the bias alone).  Rows without an id are scored too and are not held out;
    repeated rows stay repeated; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS pairs, in practice a few thousand

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = sent.value
        table = np.zeros(1 << BITS, np.float32)
        table[at] = w
        for b in batches:
            for lo, hi, data, offsets in bt.pieces(bt.column(b, "text")):
                f, r = features(data, offsets)
                z = np.bincount(r, table[f], minlength=hi - lo) + bias
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Fits on labels.toxic and scores every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
