"""The tables of a scan as Parquet: schemas, merging arrivals, storing edges, resetting projects, exporting graphs.

A table is replaced as a whole by writing the new one beside it and moving it into place, so that a job that dies leaves
the old one.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators import graph
from loomgraph.sources.shared import append_lines, exists, move, remove, written_lines

_FLAGS = "is_static is_abstract is_sealed is_async is_partial is_generic is_extension_method is_disposable is_volatile".split()
_THREADS = "has_callback has_ui_dispatch has_task_spawn has_background_worker has_do_events has_lock has_thread_start has_blocking_wait".split()
_RULES = "rule_id string, rule_family string, rule_mode string"
#: The tables and their columns.
SCHEMAS = {
    "analysis_runs": "id string, solution_path string, started_at timestamp, completed_at timestamp, status string, total_projects int, analyzed_projects int, failed_projects int, command_line string, config_hash string",
    "solutions": "id string, analysis_run_id string, file_path string, name string, project_count int",
    "projects": "id string, solution_id string, analysis_run_id string, name string, file_path string, assembly_name string, target_framework string, project_type string, is_test_project boolean, is_sdk_style boolean, document_count int, analysis_status string, error_message string",
    "project_dependencies": "source_project_id string, target_project_id string",
    "source_files": "id string, project_id string, file_path string, file_name string",
    "symbols": "id string, document_id string, project_id string, fqn string, name string, kind string, namespace string, containing_type string, accessibility string, " + ", ".join(f"{f} boolean" for f in _FLAGS) + ", line_start int, line_end int, loc bigint, parameter_count int, return_type string, " + ", ".join(f"{f} boolean" for f in _THREADS) + ", fan_in bigint",
    "symbol_relationships": f"source_id string, target_id string, relationship_type string, {_RULES}",
    "method_calls": f"caller_id string, callee_id string, call_count bigint, call_type string, {_RULES}",
    "inheritance": "derived_id string, base_id string, kind string",
    "field_accesses": "accessor_fqn string, target_fqn string, access_kind string, is_external boolean",
}


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """`df` with the columns and types of a table; columns that an older table lacks are null."""
    return df.sparkSession.createDataFrame([], schema(name)).unionByName(df.select(*[F.col(f.name).cast(f.dataType) for f in schema(name) if f.name in df.columns]), allowMissingColumns=True)


def stable_id(c: str | Column, case_blind: bool = False) -> Column:
    """The id of a symbol (its name's hash), or of a path (case does not count)."""
    text = F.col(c) if isinstance(c, str) else c
    return F.sha2(F.lower(text) if case_blind else text, 256)


class Store:
    """The tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def init(self) -> None:
        """Creates the tables that are not there yet."""
        for name in SCHEMAS:
            if not exists(self.spark, f"{self.folder}/{name}"):
                self.replace(name, self.spark.createDataFrame([], schema(name)))

    def table(self, name: str) -> DataFrame:
        """A table with all its columns, whatever columns it was written with; empty if it is not there."""
        at = f"{self.folder}/{name}"
        if not exists(self.spark, at):
            return self.spark.createDataFrame([], schema(name))
        return conform(self.spark.read.option("mergeSchema", True).parquet(at), name)

    def replace(self, name: str, df: DataFrame) -> None:
        """Puts `df` in the place of a table; `df` may be made from that table."""
        at, beside = f"{self.folder}/{name}", f"{self.folder}/.{name}-{uuid.uuid4().hex}"
        conform(df, name).write.parquet(beside)
        if exists(self.spark, at):
            gone = f"{self.folder}/.{name}-{uuid.uuid4().hex}"
            move(self.spark, at, gone)
            move(self.spark, beside, at)
            remove(self.spark, gone)
        else:
            move(self.spark, beside, at)

    def reset(self) -> None:
        """Empties every table but the runs."""
        for name in SCHEMAS:
            if name != "analysis_runs":
                self.replace(name, self.spark.createDataFrame([], schema(name)))

    def reset_projects(self, ids: list[str]) -> None:
        """Drops what some projects are the source of; edges into them from elsewhere stay."""
        gone = self.table("symbols").where(F.col("project_id").isin(*ids)).select("id", "fqn")
        left = {name: self.table(name).join(gone.select(F.col("id").alias(c)), c, "left_anti") for name, c in (("method_calls", "caller_id"), ("inheritance", "derived_id"), ("symbol_relationships", "source_id"))}
        left["field_accesses"] = self.table("field_accesses").join(gone.select(F.col("fqn").alias("accessor_fqn")), "accessor_fqn", "left_anti")
        left["project_dependencies"] = self.table("project_dependencies").where(~F.col("source_project_id").isin(*ids))
        left["source_files"] = self.table("source_files").where(~F.col("project_id").isin(*ids))
        left["symbols"] = self.table("symbols").where(~F.col("project_id").isin(*ids))
        for name, df in left.items():  # symbols last: the others are told by them
            self.replace(name, df)

    def save_symbols(self, arrivals: DataFrame) -> None:
        """Merges symbols (with an ordinal) into those that are there, by name."""
        have = self.table("symbols").withColumn("ordinal", F.lit(-1).cast("long"))
        new = conform_with(arrivals, "symbols", "ordinal")
        self.replace("symbols", fold(have.unionByName(new)))

    def _ids(self, fqn: str, id_col: str) -> DataFrame:
        return self.table("symbols").select(F.col("fqn").alias(fqn), F.col("id").alias(id_col))

    def save_calls(self, calls: DataFrame) -> None:
        """Adds calls by name (caller, callee, ...): of those that agree in all but the count the first stays; an end that
        no symbol has drops the call."""
        one = first_wins(calls, ["caller", "callee", "call_type", *graph.RULE_FIELDS])
        found = one.join(self._ids("caller", "caller_id"), "caller").join(self._ids("callee", "callee_id"), "callee")
        self.replace("method_calls", self.table("method_calls").unionByName(conform(found, "method_calls")))

    def save_accesses(self, accesses: DataFrame) -> None:
        """Adds field accesses by name; of those that agree in accessor, target and kind the first stays."""
        have = self.table("field_accesses").withColumn("ordinal", F.lit(-1).cast("long"))
        new = conform_with(accesses.withColumnsRenamed({"accessor": "accessor_fqn", "target": "target_fqn"}), "field_accesses", "ordinal")
        self.replace("field_accesses", first_wins(have.unionByName(new), ["accessor_fqn", "target_fqn", "access_kind"]))

    def save_dependencies(self, refs: DataFrame) -> None:
        """Adds project references that are not there."""
        both = self.table("project_dependencies").unionByName(conform(refs, "project_dependencies"))
        self.replace("project_dependencies", both.dropDuplicates(["source_project_id", "target_project_id"]))

    def save_inheritance(self, edges: DataFrame) -> None:
        """Adds inheritance by name, each once; an end that no symbol has drops the edge."""
        found = edges.select("derived", "base", "kind").distinct().join(self._ids("derived", "derived_id"), "derived").join(self._ids("base", "base_id"), "base")
        self.replace("inheritance", self.table("inheritance").unionByName(conform(found, "inheritance")))

    def save_type_uses(self, uses: DataFrame) -> None:
        """Adds type uses by name that are not there, each once; null rule fields are equal to null."""
        keys = ["source_id", "target_id", "relationship_type", *graph.RULE_FIELDS]
        found = uses.withColumnRenamed("type", "relationship_type").join(self._ids("source", "source_id"), "source").join(self._ids("target", "target_id"), "target")
        new = conform(found, "symbol_relationships").distinct()
        have = self.table("symbol_relationships")
        self.replace("symbol_relationships", have.unionByName(graph.not_yet_known(new, have, keys).select(*new.columns)))

    def put(self, name: str, rows: DataFrame) -> None:
        """Adds rows by id (runs, solutions, projects, files); a row replaces the one of its id, a later one an earlier."""
        have = self.table(name).withColumn("ordinal", F.lit(-1).cast("long"))
        new = conform_with(rows if "ordinal" in rows.columns else rows.withColumn("ordinal", F.lit(0).cast("long")), name, "ordinal")
        w = Window.partitionBy("id").orderBy(F.desc("ordinal"))
        self.replace(name, have.unionByName(new).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "ordinal"))

    def finish_run(self, run_id: str, status: str, **counts: int) -> None:
        """Marks a run as ended."""
        mine = F.col("id") == run_id
        df = self.table("analysis_runs").withColumn("status", F.when(mine, status).otherwise(F.col("status"))).withColumn("completed_at", F.when(mine, F.current_timestamp()).otherwise(F.col("completed_at")))
        self.replace("analysis_runs", df.withColumns({c: F.when(mine, n).otherwise(F.col(c)) for c, n in counts.items()}))

    def by_name(self, name: str) -> DataFrame:
        """A table of edges with the names of its ends: the ends that are no symbols are left out."""
        names = self.table("symbols").select("id", "fqn")
        source, target = {"method_calls": ("caller", "callee"), "inheritance": ("derived", "base"), "symbol_relationships": ("source", "target")}[name]
        side = lambda c: names.select(F.col("id").alias(f"{c}_id"), F.col("fqn").alias(c))
        df = self.table(name).join(side(source), f"{source}_id").join(side(target), f"{target}_id").drop(f"{source}_id", f"{target}_id")
        return df.withColumnRenamed("relationship_type", "type")

    def accesses_by_name(self) -> DataFrame:
        return self.table("field_accesses").withColumnsRenamed({"accessor_fqn": "accessor", "target_fqn": "target"})

    def count_fan_in(self) -> None:
        """Sets every symbol's fan_in to the number of edge rows that end at it."""
        counted = graph.row_fan_in(self.table("symbols"), self.by_name("method_calls"), self.by_name("inheritance"), self.accesses_by_name(), self.by_name("symbol_relationships"))
        self.replace("symbols", self.table("symbols").drop("fan_in").join(counted, "fqn"))

    def named_symbols(self) -> DataFrame:
        """Symbols with the path and name of their file."""
        files = self.table("source_files").select(F.col("id").alias("document_id"), "file_path", "file_name")
        return self.table("symbols").join(files, "document_id", "left")

    def graphs(self) -> dict[str, tuple[DataFrame, DataFrame]]:
        """(nodes, links) of the five graphs."""
        home = self.table("projects").select(F.col("id").alias("project_id"), F.col("name").alias("project"))
        s = self.named_symbols().join(home, "project_id", "left").withColumns({"file": F.coalesce("file_path", F.lit("")), "project": F.coalesce("project", F.lit(""))})
        node = lambda df, *more: df.select(F.col("fqn").alias("id"), "kind", "file", "project", *more)
        call_flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("has_ui_dispatch", "has_task_spawn", "has_background_worker", "has_do_events", "has_lock", "has_callback", "is_async", "has_thread_start", "has_blocking_wait")]
        in_calls = s.where(F.col("kind").isin(*graph.CALL_NODE_KINDS))
        ends = in_calls.select("fqn")
        calls = self.by_name("method_calls").join(ends.select(F.col("fqn").alias("caller")), "caller", "left_semi").join(ends.select(F.col("fqn").alias("callee")), "callee", "left_semi")
        accesses = self.accesses_by_name()
        touched = accesses.select(F.explode(F.array("accessor", "target")).alias("id")).distinct()
        kinds = self.table("symbols").select(F.col("fqn").alias("id"), "kind", F.coalesce("is_volatile", F.lit(False)).alias("is_volatile"))
        projects = self.table("projects")
        names = projects.select("id", "name")
        refs = self.table("project_dependencies").join(names.select(F.col("id").alias("source_project_id"), F.col("name").alias("source")), "source_project_id").join(names.select(F.col("id").alias("target_project_id"), F.col("name").alias("target")), "target_project_id")
        rules = list(graph.RULE_FIELDS)
        return {
            "call": (node(in_calls, *call_flags), calls.select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.col("call_type").alias("type"), "call_count", *rules)),
            "inheritance": (node(s.where(F.col("kind").isin(*graph.INHERITANCE_NODE_KINDS))), self.by_name("inheritance").select(F.col("derived").alias("source"), F.col("base").alias("target"), F.col("kind").alias("type"))),
            "dependency": (projects.select(F.col("name").alias("id"), F.lit("project").alias("kind"), F.col("file_path").alias("file"), F.col("name").alias("project")), refs.select("source", "target", F.lit("depends_on").alias("type"))),
            "field_access": (touched.join(kinds, "id", "left").select("id", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("is_volatile", F.lit(False)).alias("is_volatile")), accesses.select(F.col("accessor").alias("source"), "target", F.col("access_kind").alias("type"), "is_external")),
            "type_dependency": (node(s), self.by_name("symbol_relationships").select("source", "target", "type", *rules)),
        }


def conform_with(df: DataFrame, name: str, *more: str) -> DataFrame:
    """`conform` that keeps some further columns."""
    kind = schema(name)
    cast = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kind]
    return df.select(*cast, *more)


def first_wins(df: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """The first row of each key by the ordinal; without one any row stays."""
    if order not in df.columns:
        return df.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", order)


def fold(arrivals: DataFrame) -> DataFrame:
    """Symbols that arrive more than once under a name (with an ordinal) become one: the first known file, namespace, type
    and return type; the last id, project, name, kind, accessibility and fan-in; any flag; the widest lines; the sum
    of the lines of code; the most parameters (unknown counts as 0 among several, and stays unknown alone)."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ordinal", c)))[c].alias(c)
    last = lambda c: F.max(F.struct("ordinal", c))[c].alias(c)
    several = F.count("*") > 1
    or_single = lambda c, merged: F.when(several, merged).otherwise(F.max(c)).alias(c)
    return arrivals.withColumn("id", F.coalesce("id", stable_id("fqn"))).groupBy("fqn").agg(
        *[first(c) for c in ("document_id", "namespace", "containing_type", "return_type")], *[last(c) for c in ("id", "project_id", "name", "kind", "accessibility", "fan_in")],
        *[or_single(c, F.bool_or(F.coalesce(c, F.lit(False)))) for c in (*_FLAGS, *_THREADS)],
        F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), or_single("loc", F.sum(F.coalesce("loc", F.lit(0)))), or_single("parameter_count", F.max(F.coalesce("parameter_count", F.lit(0)))),
    )


def write_graph(path: str | Path, kind: str, nodes: DataFrame, links: DataFrame, run_id: str, mode: str = "full", solution: str = "") -> None:
    """One graph as node-link JSON, a line for each node and link: tasks write the lines, which are put together as bytes."""
    about = {"type": kind, "generated_at": datetime.now(timezone.utc).isoformat(), "analysis_run_id": run_id, "scan_mode": mode, "solution_path": solution}
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    parts = [(df.sparkSession, written_lines(df.select(F.concat(F.lit(","), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("line")))) for df in (nodes, links)]
    head = '{"directed": true, "multigraph": false, "graph": ' + json.dumps(about, ensure_ascii=False) + ', "nodes": [\n'
    for more, before, (spark, lines) in zip((False, True), (head, '], "links": [\n'), parts):
        with open(at, "ab" if more else "wb") as f:
            f.write(before.encode())
        append_lines(spark, lines, at)
        remove(spark, lines)
    with open(at, "ab") as f:
        f.write(b"]}\n")


def export_graphs(store: Store, folder: str, run_id: str, mode: str = "full", solution: str = "") -> None:
    """The five graphs of a store, as files."""
    from loomgraph.sources.files import GRAPH_FILES

    for kind, (nodes, links) in store.graphs().items():
        write_graph(Path(folder) / GRAPH_FILES[kind], kind, nodes, links, run_id, mode, solution)


def write_index(index: DataFrame, folder: str) -> None:
    """The vectors of `operators.retrieval.build_index` with what they stand for."""
    index.write.mode("overwrite").parquet(folder)
