"""Document quality: random Fourier features over document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bytetext as bt
from loomgraph.llm.sampling import per_class
from loomgraph.llm.storage import cut

#: About so many labelled rows of each class are used to fit.
FIT_PER_CLASS = 12_000
FOURIER = 300
_MASK = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "blank": [32, 9],
    "line": [10],
    "stop": [*b".!?"],
    "comma": [*b",;:"],
    "symbol": [*b"#$%&*+/<=>@\\^_`|~{}[]"],
    "quote": [*b"\"'()-"],
    "wide": [*range(128, 256)],
}
_SETS = np.zeros((len(_MASK), 256), bool)
for _i, _v in enumerate(_MASK.values()):
    _SETS[_i, _v] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
STATISTICS = len(_MASK) + 14


def _repeats(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: how many, how many different, and how often the most frequent one."""
    count = np.bincount(rows, minlength=n)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    different = np.bincount(r[new], minlength=n)
    most = np.zeros(n)
    if len(h):
        at = np.flatnonzero(new)
        np.maximum.at(most, r[at], np.diff([*at, len(h)]))
    return count, different, most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATISTICS numbers for each row: shares of byte classes, word and line shapes, and repetition."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = np.zeros((n, STATISTICS))
    share = lambda a, b: a / np.maximum(b, 1)
    if len(data):
        for i, mask in enumerate(_SETS):
            c = np.concatenate([[0], np.cumsum(mask[data])])
            out[:, i] = share(c[offsets[1:]] - c[offsets[:-1]], size)
    k = len(_MASK)
    sums = bt.prefix(bt.lower(data))
    s, e, r = bt.words(data, offsets)
    h = bt.spans_hash(sums, s, e)
    count, different, most = _repeats(h, r, n)
    length = (e - s).astype(float)
    total = np.bincount(r, length, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, r, length)
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(count)
    out[:, k + 2] = share(total, count)
    out[:, k + 3] = np.sqrt(np.maximum(share(np.bincount(r, length**2, minlength=n), count) - out[:, k + 2] ** 2, 0))
    out[:, k + 4] = np.log1p(longest)
    out[:, k + 5] = share(different, count)
    out[:, k + 6] = share(most, count)
    out[:, k + 7] = share(np.bincount(r, length <= 3, minlength=n), count)
    capital = _SETS[0][data[s]] if len(s) else np.zeros(0, bool)
    out[:, k + 8] = share(np.bincount(r, capital, minlength=n), count)
    g, at = bt.grams(h, r, 3)
    c3, d3, m3 = _repeats(g, r[at], n)
    out[:, k + 9] = np.where(c3 > 0, share(d3, c3), 1)
    out[:, k + 10] = share(m3, c3)
    s, e, r = bt.words(data, offsets, _LINE)
    lines, dl, ml = _repeats(bt.spans_hash(sums, s, e), r, n)
    out[:, k + 11] = np.where(lines > 0, share(dl, lines), 1)
    out[:, k + 12] = np.log1p(share(size, lines))
    out[:, k + 13] = share(ml, lines) * (lines > 1)
    return out


class Scorer:
    """The fitted scorer: scaling, random directions, ridge weights, and the steps of the calibration."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 11):
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        rng = np.random.default_rng(seed)
        width = np.sqrt(2 * len(mean))  # the usual distance between scaled rows
        self.directions = rng.normal(size=(len(mean), FOURIER)) / width
        self.phases = rng.uniform(0, 2 * np.pi, FOURIER)
        self.weights = np.zeros(FOURIER + 1)
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.sqrt(2 / FOURIER) * np.cos(x @ self.directions + self.phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip(np.interp(raw, *self.steps) if self.steps else raw, 0, 1)


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (raw score, calibrated value) at the middle of each pool, rising."""
    order = np.lexsort((y, raw))
    pools: list[list[float]] = []
    for r, v, w in zip(raw[order], y[order], weight[order]):
        pools.append([r * w, v * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(docs: DataFrame, labels: DataFrame, per_class_rows: int = FIT_PER_CLASS, ridge: float = 1e-3) -> Scorer | None:
    """Learns labels.quality of rows whose crc32(doc_id as text) mod 5 is not 0; None without such rows.  A document that
    is labelled twice is of the lower quality."""
    known = labels.where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if not sizes:
        return None
    weight = {q: n / min(n, per_class_rows) for q, n in sizes.items()}  # undoes the sampling
    chosen = F.broadcast(per_class(known, "quality", per_class_rows))  # at most about 2 x per_class_rows pairs

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in bt.pieces(bt.column(b, "text"), rows=20_000):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATISTICS).cast(pa.list_(pa.float64()))], ["y", "fold", "x"])

    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int").alias("fold")
    table = cut(docs.join(chosen, "doc_id").select(F.col("quality").cast("int").alias("y"), fold, "text").mapInArrow(measure, "y int, fold int, x array<double>").repartition(16))
    cells = [F.col("x")[i] for i in range(STATISTICS)]
    m = table.agg(*[F.avg(c) for c in cells], *[F.stddev_pop(c) for c in cells], F.count("*")).first()
    if not m[-1]:
        return None
    scorer = Scorer(np.array(m[:STATISTICS], float), np.array(m[STATISTICS:-1], float))

    shape = (FOURIER + 1, FOURIER + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = np.zeros((2, *shape)), np.zeros((2, FOURIER + 1))
        for b in batches:
            y, fold = b.column(0).to_numpy().astype(float), b.column(1).to_numpy()
            z = scorer.lift(np.stack(b.column(2).to_numpy(zero_copy_only=False)))
            w = np.array([weight.get(int(v), 1.0) for v in y])
            for k in (0, 1):
                mine = fold == k
                a[k] += (z[mine] * w[mine, None]).T @ z[mine]
                c[k] += (z[mine] * w[mine, None]).T @ y[mine]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in a]), pa.array([x.tobytes() for x in c]), pa.array([0, 1], pa.int32())], ["a", "c", "fold"])

    a, c = np.zeros((2, *shape)), np.zeros((2, FOURIER + 1))
    for r in table.mapInArrow(sums, "a binary, c binary, fold int").collect():  # two rows from each of the few partitions of the sample
        a[r["fold"]] += np.frombuffer(r["a"]).reshape(shape)
        c[r["fold"]] += np.frombuffer(r["c"])

    def solved(a: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a + max(ridge * np.trace(a) / len(a), 1e-9) * np.eye(len(a)), c)

    scorer.weights = solved(a.sum(axis=0), c.sum(axis=0))
    # a row is calibrated by weights that the other half of the sample gave
    other = [solved(a[1 - k], c[1 - k]) for k in (0, 1)]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, fold = scorer.lift(np.stack(b.column(2).to_numpy(zero_copy_only=False))), b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(fold == 0, z @ other[0], z @ other[1]))], ["y", "raw"])

    seen = table.mapInArrow(rate, "y int, raw double").toPandas()  # at most about 2 x per_class_rows pairs
    y = seen["y"].to_numpy(float)
    scorer.steps = isotonic(seen["raw"].to_numpy(), y, np.array([weight.get(int(v), 1.0) for v in y]))
    return scorer


def score(docs: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, from its whole text alone.

    Null texts are scored as empty ones; without a fitted scorer every score is 0.5.  Rows without an id are scored too
    and are not held out; repeated rows stay repeated; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # under 100 KB, whatever the corpus is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in bt.pieces(bt.column(b, "text"), rows=20_000):
                s = sent.value.score(statistics(data, offsets)) if sent.value else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(s)], ["doc_id", "score"])

    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Fits on labels.quality and scores every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
