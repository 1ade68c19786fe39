"""Soft edges: suggested links that stay apart from confirmed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("source", "target", "type")
#: The type of an edge that names none, and the confidence below which an edge is doubtful.
DEFAULT_TYPE, LOW = "ai_soft_edge", 0.5


def stripped(c: str) -> Column:
    """A text without white space at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def normalize(edges: DataFrame) -> DataFrame:
    """Trimmed ends, a default type, texts for missing notes, and an error for rows that cannot be imported (blank end,
    confidence that is no number between 0 and 1, evidence that is no list).

    `confidence` may be a number or a text; `evidence` a list, or a text column with `evidence_is_list` beside it.
    """
    out = edges.withColumns({c: stripped(c) for c in KEY}).withColumn("type", F.when(F.col("type") == "", DEFAULT_TYPE).otherwise(F.col("type")))
    number = F.col("confidence").try_cast("double")
    error = F.when((F.col("source") == "") | (F.col("target") == ""), "missing endpoint").when(F.col("confidence").isNotNull() & ~F.coalesce(number.between(0, 1), F.lit(False)), "confidence out of range")
    if "evidence_is_list" in edges.columns:
        error = error.when(~F.coalesce("evidence_is_list", F.lit(True)), "evidence is not a list")
    out = out.withColumn("error", error).withColumn("confidence", number)
    if "evidence" in edges.columns:
        out = out.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    return out.withColumn("notes", F.coalesce("notes", F.lit(""))) if "notes" in edges.columns else out


def valid(edges: DataFrame) -> DataFrame:
    """Normalised edges; any that cannot be imported is an error that names it."""
    checked = normalize(edges)
    bad = F.concat_ws(" ", F.lit("soft edge cannot be imported:"), "error", F.lit("("), "source", F.lit("->"), "target", F.lit(")"))
    return checked.withColumn("source", F.when(F.col("error").isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("source"))).drop("error")


def merge(have: DataFrame, new: DataFrame, order: str = "ordinal") -> DataFrame:
    """Edges by key; a new edge replaces one we have, a later one an earlier one."""
    both = have.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*KEY).orderBy(F.desc("__side"), F.desc(order))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__side")


def sorted_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy(*KEY)


def _seen(edges: DataFrame) -> DataFrame:
    keyed = edges.withColumns({c: stripped(c) for c in KEY}).withColumn("type", F.when(F.col("type") == "", DEFAULT_TYPE).otherwise(F.col("type")))
    return keyed.withColumn("confidence_given", F.col("confidence").isNotNull()).withColumn("confidence", F.col("confidence").try_cast("double")).withColumn("__n", F.row_number().over(Window.partitionBy(*KEY).orderBy("ordinal")))


def quality(edges: DataFrame) -> DataFrame:
    """By type: how many edges, how many without or with a low confidence, its range, without evidence, without an end,
    and repeated keys.  A confidence that is no number counts as missing."""
    return _seen(edges).groupBy("type").agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence").isNull()).alias("no_confidence"), F.count_if(F.col("confidence") < LOW).alias("low_confidence"),
        F.min("confidence").alias("least"), F.max("confidence").alias("greatest"), F.count_if(F.size(F.coalesce("evidence", F.array().cast("array<string>"))) == 0).alias("no_evidence"),
        F.count_if(F.col("source") == "").alias("no_source"), F.count_if(F.col("target") == "").alias("no_target"), F.count_if(F.col("__n") > 1).alias("repeated"),
    )


def warnings(edges: DataFrame) -> DataFrame:
    """(ordinal, warning): what is doubtful about each edge.  A confidence that is no number gives none."""
    ends = F.concat_ws(" -> ", "source", "target")
    found = F.array_compact(F.array(
        F.when(F.col("__n") > 1, F.concat(F.lit("Duplicate edge: "), ends, F.lit(" ("), F.col("type"), F.lit(")"))),
        F.when(~F.col("confidence_given"), F.concat(F.lit("Confidence missing for: "), ends)).when(F.col("confidence") < LOW, F.concat(F.lit("Low confidence ("), F.col("confidence").cast("string"), F.lit(") for: "), ends)),
        F.when(F.size(F.coalesce("evidence", F.array().cast("array<string>"))) == 0, F.concat(F.lit("Evidence empty for: "), ends)),
    ))
    return _seen(edges).select("ordinal", F.posexplode(found).alias("place", "warning")).select("ordinal", "place", "warning")


def ranked(edges: DataFrame, limit: int) -> DataFrame:
    """The `limit` edges of highest confidence (none, or no number, counts as 0), then by source, target and ordinal."""
    return edges.withColumn("confidence", F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))).orderBy(F.desc("confidence"), "source", "target", "ordinal").limit(limit)


def snapshot(candidates: DataFrame) -> DataFrame:
    """(n, fqns): how many candidates there are, and their names, sorted: for a report of bounded size."""
    return candidates.agg(F.count_distinct("fqn").alias("n"), F.array_sort(F.collect_set("fqn")).alias("fqns"))
