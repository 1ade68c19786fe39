"""Listings, markers, summaries and snippets over symbols and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import short_name


def holds(c: str, text: str | None) -> Column:
    """Case-blind match anywhere; % and _ in the text are wildcards, a back-slash is only a character."""
    return F.lit(True) if not text else F.coalesce(F.ilike(F.col(c), F.lit(f"%{text}%"), F.lit("\x00")), F.lit(False))


def list_files(files: DataFrame, projects: DataFrame, project: str | None, pattern: str | None, limit: int) -> DataFrame:
    """The first `limit` files by project and path; project: name or id, pattern: path or name."""
    named = files.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id")
    found = named.where((holds("project", project) | holds("project_id", project)) & (holds("file_path", pattern) | holds("file_name", pattern)))
    return found.orderBy("project", "file_path").limit(limit).select("project", "project_id", "file_name", "file_path")


def list_symbols(symbols: DataFrame, projects: DataFrame, fan_in: DataFrame, query: str | None, kind: str | None, project: str | None, file: str | None, limit: int) -> DataFrame:
    """The first `limit` symbols by falling fan-in and length, then name."""
    named = symbols.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id").join(fan_in, "fqn", "left")
    found = named.where((holds("fqn", query) | holds("name", query)) & (F.lit(True) if not kind else F.col("kind") == kind) & (holds("project", project) | holds("project_id", project)) & holds("file_path", file))
    return found.orderBy(F.desc_nulls_last("fan_in"), F.desc_nulls_last("loc"), "fqn").limit(limit).select("fqn", "name", "kind", "project", "file_path", "line_start", "loc", "fan_in")


def summaries(symbols: DataFrame, edges: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(fqn, summary): a line each for kind, name and flags, measures, fan-in and fan-out, up to three callers and callees,
    all bases and up to three derived types, by name; lines that would be empty are left out."""

    def side(pairs: DataFrame, key: str, other: str, name: str, most: int | None) -> DataFrame:
        listed = F.array_sort(F.collect_set(other))
        some = listed if most is None else F.slice(listed, 1, most)
        return pairs.groupBy(F.col(key).alias("fqn")).agg(F.count("*").alias(f"n_{name}"), F.array_join(F.transform(some, short_name), ", ").alias(name))

    s = symbols
    for part in (side(edges, "callee", "caller", "called_by", 3), side(edges, "caller", "callee", "calls", 3), side(inheritance, "derived", "base", "inherits", None), side(inheritance, "base", "derived", "inherited_by", 3)):
        s = s.join(part, "fqn", "left")
    flags = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"is_{f}"), f) for f in ("async", "static", "abstract")])), " ")
    access = F.when(F.coalesce("accessibility", F.lit("")) != "", F.concat(F.lit("["), F.col("accessibility"), F.lit("] "))).otherwise("")
    head = F.btrim(F.concat(F.col("kind"), F.lit(" "), F.col("fqn"), F.lit(" "), access, F.when(flags != "", F.concat(F.lit(" ["), flags, F.lit("]"))).otherwise("")))
    labelled = lambda label, c: F.concat(F.lit(label), F.col(c).cast("string"))
    measures = F.nullif(F.concat_ws(" | ", labelled("LOC:", "loc"), labelled("params:", "parameter_count"), F.when(F.col("return_type") != "", labelled("returns:", "return_type"))), F.lit(""))
    met = F.col("n_called_by").isNotNull() | F.col("n_calls").isNotNull()
    fans = F.when(met, F.concat(F.lit("fan_in:"), F.coalesce("n_called_by", F.lit(0)).cast("string"), F.lit(" | fan_out:"), F.coalesce("n_calls", F.lit(0)).cast("string")))
    lines = [head, measures, fans, *[labelled(f"{c}: ", c) for c in ("called_by", "calls", "inherits", "inherited_by")]]
    return s.select("fqn", F.concat_ws("\n", *lines).alias("summary"))


def marker_hits(texts: DataFrame, markers: list[str]) -> DataFrame:
    """(doc_id, marker) for each marker that a text holds."""
    found = F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains("text", m))
    return texts.select("doc_id", F.explode(found).alias("marker"))


def excluded(paths: DataFrame, folders: list[str], wildcard: str, glob: str) -> DataFrame:
    """(path, excluded): in a folder of that name, or a file name or path that matches."""
    parts = F.split(F.lower(F.replace("path", F.lit("\\"), F.lit("/"))), "/")
    name = F.element_at(parts, -1)
    whole = F.array_join(parts, "/")
    return paths.select("path", (F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, folders))) | name.rlike(wildcard_pattern(wildcard)) | whole.rlike(glob_pattern(glob))).alias("excluded"))


def wildcard_pattern(text: str) -> str:
    """* and ? over a whole name, in lower case."""
    return "^" + re.escape(text.lower()).replace(r"\*", ".*").replace(r"\?", ".") + "$"


def glob_pattern(text: str) -> str:
    """** over folders, * and ? inside one; not bound to the beginning unless it starts with **."""
    p = re.escape(text.lower()).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if text.startswith("**") else "(?:^|/)") + p + "$"


#: Lines around a snippet's line, and how far a name is looked for from where it should be.
CONTEXT, NEAR = 4, 50


def _cut(texts: DataFrame, at: Column, context: int) -> DataFrame:
    """line_start, line_end and snippet: the lines around line number `at` (from 1), without blank ones at the edges; no
    row where nothing is left."""
    blank = lambda x: F.regexp_replace(x, r"\s", "") == ""
    rows = texts.withColumn("__at", at).where("__at is not null")
    rows = rows.withColumn("__from", F.greatest(F.col("__at") - context, F.lit(1)))
    rows = rows.withColumn("__cut", F.slice("lines", F.col("__from"), F.col("__at") + context - F.col("__from") + 1))
    full = F.filter(F.transform("__cut", lambda x, i: F.when(~blank(x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("__full", full).where(F.size("__full") > 0).withColumn("__lo", F.array_min("__full")).withColumn("__hi", F.array_max("__full"))
    snippet = F.array_join(F.slice("__cut", F.col("__lo") + 1, F.col("__hi") - F.col("__lo") + 1), "\n")
    out = rows.withColumn("line_start", (F.col("__from") + F.col("__lo")).cast("int")).withColumn("line_end", (F.col("__from") + F.col("__hi")).cast("int")).withColumn("snippet", snippet)
    return out.drop("lines", "__at", "__from", "__cut", "__full", "__lo", "__hi")


def snippets(texts: DataFrame, marker: str | Column | None = None, line: str | None = None, context: int = CONTEXT) -> DataFrame:
    """`texts` (with a column text) with line_start, line_end and snippet: around a line number (`line`: a column; past the
    end means the last line), else around the first line that holds the marker, else around the first line.

    Empty texts and windows of blank lines give no row; a byte-order mark is dropped.
    """
    lines = F.split(F.regexp_replace("text", "^\ufeff", ""), "\n")
    rows = texts.where(F.coalesce("text", F.lit("")) != "").withColumn("lines", lines)
    at = F.lit(1)
    if marker is not None:
        wanted = F.lit(marker) if isinstance(marker, str) else marker
        at = F.greatest(F.array_position(F.transform("lines", lambda x: F.contains(x, wanted)), F.lit(True)).cast("int"), F.lit(1))
    if line is not None:
        at = F.when(F.col(line) > 0, F.least(F.col(line).cast("int"), F.size("lines"))).otherwise(at)
    return _cut(rows, at, context).drop("text")


def focal_snippets(texts: DataFrame, context: int = CONTEXT, near: int = NEAR) -> DataFrame:
    """`texts` (text, name, containing_type, line_start) with the snippet around the line that holds a symbol's name,
    nearest to where the symbol begins: below before above, at most `near` lines away; no row where none holds it.

    A constructor is looked for by its type's name, a property's accessor by the property's.
    """
    name = F.coalesce("name", F.lit(""))
    name = F.when(name == ".ctor", F.substring_index(F.coalesce("containing_type", F.lit("")), ".", -1)).when(name.startswith("get_") | name.startswith("set_"), F.expr("substr(name, 5)")).otherwise(name)
    rows = texts.where(F.coalesce("text", F.lit("")) != "").withColumn("lines", F.split(F.regexp_replace("text", "^\ufeff", ""), "\n")).withColumn("__name", name)
    rows = rows.withColumn("__base", F.greatest(F.least(F.coalesce("line_start", F.lit(1)).cast("int"), F.size("lines")), F.lit(1)))
    holding = F.filter(F.transform("lines", lambda x, i: F.when(F.contains(x, F.col("__name")), (i + 1))), lambda i: i.isNotNull() & (F.abs(i - F.col("__base")) <= near))
    nearest = F.array_min(F.transform(holding, lambda i: F.struct(F.abs(i - F.col("__base")).alias("far"), F.when(i < F.col("__base"), 1).otherwise(0).alias("above"), i.alias("at"))))
    return _cut(rows.drop("line_start", "text"), nearest["at"], context).drop("__name", "__base")


#: What the text of a method tells of threads where nothing better is known (contains, or ends with).
THREAD_TEXT = {
    "has_task_spawn": ("Task.Run", "TaskFactory.StartNew"),
    "has_ui_dispatch": ("Dispatcher.Invoke", "Dispatcher.BeginInvoke", "Control.Invoke", "Control.BeginInvoke", "SynchronizationContext.Post", "SynchronizationContext.Send"),
    "has_do_events": ("Application.DoEvents",),
    "has_thread_start": ("ThreadPool.QueueUserWorkItem", "Parallel.For", "new Thread("),
    "has_blocking_wait": (".Wait(", ".Join(", ".Result"),
}


def thread_flags(bodies: DataFrame, text_col: str = "body") -> DataFrame:
    """`bodies` with a column for each of THREAD_TEXT, read from the text alone."""
    has = lambda words: F.coalesce(_any(F.col(text_col), words, "contains"), F.lit(False))
    flags = {flag: has(words) for flag, words in THREAD_TEXT.items()}
    generic = F.coalesce(F.col(text_col).contains("Task<") & F.col(text_col).contains(".Run"), F.lit(False))
    return bodies.withColumns({**flags, "has_task_spawn": flags["has_task_spawn"] | generic})


def _any(c: Column, words: tuple[str, ...], how: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | getattr(c, how)(w)
    return out
