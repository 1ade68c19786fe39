"""Structural hotspots and shared mutable state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import graph
from loomgraph.sources.shared import kept

#: The words that sort writers, and the names of types with a broad responsibility.
INIT_WORDS = (".ctor", "_load", "initui", "initialize", "_shown", "setparamdefault")
EVENT_WORDS = ("_click", "_checkedchanged", "_selectedindexchanged", "_scroll", "_propvaluechanged", "_domainchanged", "_formclosed", "_formclosing")
BROAD_NAMES = ("manager", "controller", "global", "registry", "serviceprovider", "locator")
#: Test markers in names and paths.
TEST_MARKERS = (".unittest.", ".tests.", ".test.", "\\unittest\\", "\\tests\\", "\\test\\", "\\integrationtests\\", "\\livetests\\", "\\browser.tests\\")
#: Weights of the score.
WEIGHTS = {"effective_fan_in": 0.25, "effective_fan_out": 0.20, "loc": 0.20, "parameter_count": 0.10, "is_async": 0.10, "coupling": 0.15}
#: What a threading hazard is read from.
THREAD_FLAGS = ("has_ui_dispatch", "has_task_spawn", "has_background_worker", "has_do_events", "has_lock", "has_callback", "has_thread_start", "has_blocking_wait")
HAZARD = "(has_do_events and (has_ui_dispatch or has_background_worker or has_task_spawn)) or (has_ui_dispatch and (has_task_spawn or has_background_worker or has_thread_start or has_blocking_wait))"


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def writer_category(fqn: str) -> Column:
    low = F.lower(fqn)
    return F.when(any_of(low, INIT_WORDS), "init").when(any_of(low, EVENT_WORDS), "event").otherwise("runtime")


def is_test(symbols: DataFrame, projects: DataFrame) -> DataFrame:
    """`symbols` with is_test: of a test project, or marked so by name or path."""
    flagged = symbols.join(projects.select(F.col("id").alias("project_id"), "is_test_project"), "project_id", "left")
    return flagged.withColumn("is_test", F.coalesce("is_test_project", F.lit(False)) | any_of(F.lower(F.concat_ws(" ", "fqn", "file_path")), TEST_MARKERS)).drop("is_test_project")


def class_roll_up(symbols: DataFrame, degrees: DataFrame) -> DataFrame:
    """(fqn, fan_in): a symbol's own in-degree, and for a class its direct members' as well."""
    own = symbols.join(degrees.select(F.col("node").alias("fqn"), "in_degree"), "fqn", "left").select("fqn", "kind", "containing_type", F.coalesce("in_degree", F.lit(0)).alias("d"))
    members = own.where("containing_type is not null").groupBy(F.col("containing_type").alias("fqn")).agg(F.sum("d").alias("m"))
    return own.join(members, "fqn", "left").select("fqn", (F.col("d") + F.when(F.col("kind") == "class", F.coalesce("m", F.lit(0))).otherwise(0)).alias("fan_in"))


def hotspots(symbols: DataFrame, projects: DataFrame, edges: DataFrame, coupling: DataFrame) -> DataFrame:
    """Measures and scores of all symbols, those of tests included and marked (is_test).

    `edges` is the `graph.marked` simple call graph.  A class's fan_in holds its members' as well, its effective fan_in
    does not; every measure is divided by its greatest value over all symbols (0 counts as 1).
    """
    degree, weight = graph.degrees(edges), graph.weighted_degrees(edges)
    named = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    m = is_test(symbols.drop("fan_in"), projects).join(class_roll_up(symbols, degree), "fqn")
    m = m.join(degree.select(F.col("node").alias("fqn"), F.col("out_degree").alias("fan_out")), "fqn", "left")
    m = m.join(weight.select(F.col("node").alias("fqn"), F.round("weighted_in", 3).alias("effective_fan_in"), F.round("weighted_out", 3).alias("effective_fan_out")), "fqn", "left")
    m = m.join(named, "project_id", "left").join(coupling.select(F.col("name").alias("project"), F.col("static_coupling").alias("coupling")), "project", "left")
    m = kept(m.fillna(0, ["fan_out", "effective_fan_in", "effective_fan_out", "coupling", "loc", "parameter_count"]).fillna(False, ["is_async"]))
    top = m.agg(*[F.coalesce(F.nullif(F.max(c), F.lit(0)), F.lit(1)).alias(f"max_{c}") for c in WEIGHTS if c != "is_async"])
    score = F.lit(0.0)
    for c, w in WEIGHTS.items():
        score = score + F.lit(w) * (F.col(c).cast("double") if c == "is_async" else F.col(c).cast("double") / F.col(f"max_{c}"))
    scored = m.crossJoin(F.broadcast(top))  # top is one row
    danger = (F.col("fan_in") * F.col("loc")).alias("danger_score")
    measures = ("loc", "fan_in", "fan_out", "effective_fan_in", "effective_fan_out", "parameter_count", "coupling")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in THREAD_FLAGS if c in symbols.columns]
    return scored.select("fqn", "kind", "project", "file_path", "line_start", *measures, danger, F.round(score, 4).alias("score"), *flags, F.expr(HAZARD).alias("is_hazard"), "is_test")


def ranked(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """By falling score, then name; the first `limit` with their rank."""
    order = [F.desc("score"), "fqn"]
    if limit is None:
        return scored.orderBy(*order)
    return numbered(scored, order, limit)


def numbered(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first `limit` rows in an order, with their rank; only they meet in one task."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def reasons() -> Column:
    """Why a class's measures are an anti-pattern; empty if they are not."""
    broad = any_of(F.lower("fqn"), BROAD_NAMES)
    found = F.array_compact(F.array(
        F.when(F.col("danger_score") >= 2000, "high fan-in x LOC"),
        F.when((F.col("loc") >= 1500) & (F.col("fan_in") >= 5), "very large class with multiple callers"),
        F.when(broad & (F.col("danger_score") >= 500), "broad-responsibility name with notable fan-in x LOC"),
    ))
    return F.when(F.col("kind") == "class", found).otherwise(F.array().cast("array<string>"))


def anti_patterns(scored: DataFrame) -> DataFrame:
    """(fqn, reason) for classes."""
    return scored.select("fqn", F.explode(reasons()).alias("reason"))


def threading_hazards(symbols: DataFrame) -> DataFrame:
    """Symbols that pump events beside other threads, or mix user-interface dispatch with waiting or spawning."""
    return symbols.where(HAZARD)


def shared_state(accesses: DataFrame, symbols: DataFrame, projects: DataFrame | None = None, names: bool = False, least_writers: int = 2) -> DataFrame:
    """Owned fields and properties outside tests with `least_writers` writers or more: their writers and readers by
    category, the risk, and how far the writing spreads; with `names` also who writes, sorted."""
    owned = symbols.where(F.col("kind").isin("field", "property"))
    if projects is not None:
        tests = projects.where("is_test_project").select(F.col("id").alias("project_id"))
        owned = owned.join(tests, "project_id", "left_anti")
    owned = owned.select(F.col("fqn").alias("target"))
    a = accesses.join(owned, "target", "left_semi").where(~any_of(F.lower("target"), (".unittest.", ".tests.", ".test.")))
    writes, reads, outside = F.col("access_kind").isin("write", "read_write"), F.col("access_kind").isin("read", "read_write"), F.col("is_external")
    cat = writer_category("accessor")
    sets = {"writers": writes, "readers": reads, "external": writes & outside, "internal_writers": writes & ~outside, **{c: writes & (cat == c) for c in ("init", "event", "runtime")}}
    if names:
        g = a.groupBy("target").agg(*[F.array_sort(F.collect_set(F.when(cond, F.col("accessor")))).alias(f"{c}_names") for c, cond in sets.items() if c != "readers"], F.count_distinct(F.when(reads, F.col("accessor"))).alias("readers"))
        g = g.withColumns({c: F.size(f"{c}_names").cast("long") for c in sets if c != "readers"})
    else:
        g = a.groupBy("target").agg(*[F.count_distinct(F.when(cond, F.col("accessor"))).alias(c) for c, cond in sets.items()])
    kind = F.when(F.col("writers") < 2, "none").when(F.col("external") >= 2, "external").when(F.col("external") == 1, "mixed").otherwise("internal")
    return g.where(F.col("writers") >= least_writers).select("*", ((F.col("runtime") * 100 + F.col("event") * 30 + F.col("init")) / 10.0).alias("risk"), kind.alias("spread"))


def risks(state: DataFrame) -> DataFrame:
    """(risk_class, n): fields written while the program runs or reacts (high), and those that only start-up writes (low)."""
    high = (F.col("runtime") > 0) | (F.col("event") > 0)
    return state.groupBy(F.when(high, "high").otherwise("low").alias("risk_class")).agg(F.count("*").alias("n"))


def ranked_state(state: DataFrame, limit: int) -> DataFrame:
    """The riskiest fields first, then those with more writers, then by name."""
    return numbered(state, [F.desc("risk"), F.desc("writers"), "target"], limit)
