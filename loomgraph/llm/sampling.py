"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 24


def per_class(rows: DataFrame, label: str, bound: int) -> DataFrame:
    """About `bound` rows at most of each class: a row stays if the hash of its doc_id falls under the class's share.

    Whether a row stays hangs on its doc_id alone, so a lost executor's work comes back the same.  The class counts
    are the only thing the driver sees; rows without a label or a doc_id are left out.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    counts = rows.groupBy(label).count().collect()  # one row a class
    share = None
    for value, n in counts:
        chosen = F.lit(min(_STEPS, int(_STEPS * bound / n)))
        share = (F if share is None else share).when(F.col(label) == F.lit(value), chosen)
    if share is None:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(_STEPS)) < share)
