"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import bytetext as bt
from loomgraph.llm.sampling import per_class

DIMENSIONS = 4096
#: About so many documents of each language are used to fit; more are not needed for linear models of this size.
FIT_PER_LANGUAGE = 400
#: Families of languages by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indic": "hi ur bn pa gu mr ne".split(),
    "semitic": "ar he mt am".split(),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER = ~(_LETTER | (np.arange(256) >= 128))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed counts of letter n-grams (1 to 3 bytes, everything else one space), root-scaled to unit length, by row."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    if len(data):
        x = bt.lower(data).astype(np.uint32)
        x[_OTHER[data]] = 32
        row = np.repeat(np.arange(n), np.diff(offsets))
        flat = np.zeros(n * DIMENSIONS)
        h = np.zeros(len(x), np.uint32)
        for k in range(min(3, len(x))):
            h = h[: len(x) - k] * np.uint32(257) + x[k:]
            ok = row[: len(h)] == row[k:]
            slot = ((h ^ np.uint32(k * 0x3779B1)) * np.uint32(0x85EBCA6B) >> np.uint32(20)).astype(np.int64)
            flat += np.bincount((row[: len(h)] * DIMENSIONS + slot)[ok], minlength=n * DIMENSIONS)
        out = np.sqrt(flat).reshape(n, DIMENSIONS).astype(np.float32)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (last one the bias) of a linear SVM with squared hinge loss, by dual coordinate descent; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    d = (x * x).sum(axis=1) + 0.5 / c
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c
            a = max(0.0, alpha[i] - g / d[i])
            if a != alpha[i]:
                w += (a - alpha[i]) * y[i] * x[i]
                alpha[i] = a
    return w


class Hierarchy:
    """Pairwise SVMs between families and between the languages of each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        langs = np.array(langs, dtype=object)
        family = np.array([_FAMILY.get(v, v) for v in langs], dtype=object)
        self.families = sorted(set(family))
        self.members = {f: sorted(set(langs[family == f])) for f in self.families}
        self.between = self._pairs(x, family, self.families)
        self.within = {f: self._pairs(x[family == f], langs[family == f], m) for f, m in self.members.items()}

    @staticmethod
    def _pairs(x: np.ndarray, of: np.ndarray, names: list[str]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        pairs = list(combinations(range(len(names)), 2))
        weights = [linear_svm(x[sel], np.where(of[sel] == names[a], 1.0, -1.0)) for a, b in pairs for sel in [(of == names[a]) | (of == names[b])]]
        return np.array(weights).reshape(len(pairs), x.shape[1] + 1), pairs

    @staticmethod
    def _vote(x: np.ndarray, model: tuple[np.ndarray, list[tuple[int, int]]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The winner of each row by votes, then margins, and its least margin as a value between 0 and 1."""
        weights, pairs = model
        if not pairs:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = x @ weights[:, :-1].T.astype(np.float32) + weights[:, -1]
        votes, least = np.zeros((len(x), k)), np.full((len(x), k), np.inf)
        for j, (a, b) in enumerate(pairs):
            m = margin[:, j]
            votes[:, a] += (m >= 0) + 1e-3 * np.tanh(m)
            votes[:, b] += (m < 0) - 1e-3 * np.tanh(m)
            least[:, a], least[:, b] = np.minimum(least[:, a], m), np.minimum(least[:, b], -m)
        best = votes.argmax(axis=1)
        return best, 1 / (1 + np.exp(-4 * least[np.arange(len(x)), best]))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        fam, score = self._vote(x, self.between, len(self.families))
        out = np.empty(len(x), dtype=object)
        for i, f in enumerate(self.families):
            at = np.flatnonzero(fam == i)
            if len(at):
                best, p = self._vote(x[at], self.within[f], len(self.members[f]))
                out[at] = np.array(self.members[f], dtype=object)[best]
                score[at] *= p
        return list(out), score


def fit(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> Hierarchy | None:
    """Learns from text and non-null lang of rows whose crc32(doc_id as text) mod 4 is not 2; None without such rows."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).select("doc_id", "lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in bt.pieces(bt.column(b, "text"), rows=128):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "lang", "x"])

    got = per_class(rows, "lang", per_language).mapInArrow(vectors, "doc_id long, lang string, x binary").toPandas().sort_values("doc_id")
    if got.empty:
        return None
    return Hierarchy(np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), DIMENSIONS), got["lang"].tolist())


def append(docs: DataFrame, model: Hierarchy | None, text_col: str = "text") -> DataFrame:
    """Each row of `docs` with its lang_pred and score, from its whole text alone; rows and other columns are untouched.

    A null text, a text without a letter, or no fitted model gives `und` with score 0.  Columns of `docs` with those two
    names are replaced; repeated rows stay repeated; an empty table gives no rows.  Rows go through a worker a few
    hundred at a time, so that its memory does not follow their number.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few weight vectors, whatever the corpus is
    kept = docs.drop("lang_pred", "score")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for lo, hi, data, offsets in bt.pieces(bt.column(b, text_col), rows=128):
                letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
                some = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in np.flatnonzero(~some):
                    t = data[offsets[i] : offsets[i + 1]]
                    some[i] = bool((t >= 128).any()) and any(map(str.isalpha, t.tobytes().decode("utf-8", "replace")))
                lang, score = m.predict(features(data, offsets)) if m else (["und"] * (hi - lo), np.zeros(hi - lo))
                found = [pa.array([v if s else "und" for v, s in zip(lang, some)], pa.string()), pa.array(np.where(some, score, 0.0))]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)).slice(lo, hi - lo) for c in names] + found, [*names, "lang_pred", "score"])

    kind = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(run, kind)


def identify(docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, as `append` gives them.  Rows without an id are not held out."""
    got = append(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
    return got.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Fits on the documents' own lang and predicts every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, fit(docs))
