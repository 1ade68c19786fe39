"""Readers for what a scan leaves on disk: graphs as node-link JSON, soft edges, reports, texts, project files, settings.

Files are read through Spark where they may be many or large; settings and paths are read by the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from json.decoder import WHITESPACE
from pathlib import Path
from typing import Any, TextIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators import soft_edges
from loomgraph.sources.shared import exists, for_tasks, kept, kept_blocks

#: Characters of a graph file that are read, and handed to Spark, at once.
PIECE, BLOCK = 1 << 20, 1 << 24

#: The graphs of a scan by file.
GRAPH_FILES = {"call": "call_graph.json", "inheritance": "inheritance_graph.json", "dependency": "dependency_graph.json", "field_access": "field_access_graph.json", "type_dependency": "type_dependency_graph.json"}
_FLAGS = ("has_ui_dispatch", "has_task_spawn", "has_background_worker", "has_do_events", "has_lock", "has_callback", "is_async", "has_thread_start", "has_blocking_wait", "is_volatile")
NODE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "kind", "file", "project")] + [T.StructField(c, T.BooleanType()) for c in _FLAGS])
LINK = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "target", "type", "rule_id", "rule_family", "rule_mode")] + [T.StructField("call_count", T.LongType()), T.StructField("is_external", T.BooleanType())])
SOFT = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "target", "type", "confidence", "evidence", "notes")])


@dataclass
class Graph:
    """One graph: its nodes, its edges (a simple digraph: source, target, type, ...), and what its file says of itself."""

    nodes: DataFrame
    edges: DataFrame
    about: dict[str, str]


def first_existing(candidates: list[Path]) -> Path | None:
    return next((p for p in candidates if p.exists()), None)


def graph_path(folder: str, file_name: str) -> Path | None:
    """Where a graph file is: in the folder itself, or in its output/graphs or graphs."""
    at = Path(folder)
    return first_existing([at / file_name, at / "output" / "graphs" / file_name, at / "graphs" / file_name])


def soft_edge_path(graphs_folder: str, reports_folder: str | None = None) -> Path | None:
    """Where the soft edges are: in the reports, else beside or below the graphs."""
    at = Path(graphs_folder)
    own = [Path(reports_folder) / "ai_soft_edges.json"] if reports_folder else []
    return first_existing([*own, at.parent / "reports" / "ai_soft_edges.json", at / "output" / "reports" / "ai_soft_edges.json", at / "reports" / "ai_soft_edges.json"])


def report_path(reports_folder: str) -> Path:
    """The isolation report: under its present name, else under the one it had before."""
    now = Path(reports_folder) / "structural_isolation_candidates.json"
    return now if now.exists() else Path(reports_folder) / "dead_code_candidates.json"


def load_json(path: str | Path) -> Any:
    """One JSON file; a byte-order mark is allowed."""
    return json.loads(Path(path).read_text(encoding="utf-8-sig"))


def _no_graph(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], NODE), spark.createDataFrame([], LINK), {})


class _Text:
    """A JSON text that is read a piece at a time: `value` and `char` go on where the one before ended."""

    def __init__(self, f: TextIO):
        self.f, self.held, self.at, self.decoder = f, "", 0, json.JSONDecoder()

    def more(self) -> bool:
        new = self.f.read(max(PIECE, len(self.held) - self.at))
        self.held, self.at = self.held[self.at :] + new, 0
        return bool(new)

    def char(self, take: str = "") -> str:
        """The next character but for white space, which is passed if it is among `take`."""
        while True:
            self.at = WHITESPACE.match(self.held, self.at).end()
            if self.at < len(self.held):
                break
            if not self.more():
                raise ValueError("the text ends too early")
        c = self.held[self.at]
        self.at += c in take
        return c

    def value(self) -> tuple[Any, str]:
        """The next value and its text."""
        self.char()
        while True:
            try:
                found, end = self.decoder.raw_decode(self.held, self.at)
                if end < len(self.held) or not self.more():  # a number may go on
                    break
            except json.JSONDecodeError as e:
                cut_off = e.msg.startswith("Unterminated") or e.pos > len(self.held) - 16
                if not cut_off or not self.more():
                    raise
        text, self.at = self.held[self.at : end], end
        return found, text

    def each(self, brackets: str) -> Iterator[None]:
        """Once for each member of a list or an object, which is to be taken meanwhile."""
        if self.char(brackets[0]) != brackets[0]:
            raise ValueError(f"{brackets[0]} expected")
        if self.char(brackets[1]) == brackets[1]:
            return
        while True:
            yield
            c = self.char("," + brackets[1])
            if c == brackets[1]:
                return
            if c != ",":
                raise ValueError(f"{brackets[1]} expected")


def _items(f: TextIO, about: dict[str, str], lists: set[str]) -> Iterator[tuple[str, int, str]]:
    """(list, place, JSON) of each node and link of a graph; `about` is filled with what the file says of itself, `lists`
    with the names of those that are there."""
    text = _Text(f)
    for _ in text.each("{}"):
        key, _ = text.value()
        if not isinstance(key, str) or text.char(":") != ":":
            raise ValueError("a name expected")
        if key in ("nodes", "links", "edges") and text.char() != "n":
            lists.add(key)
            for i, _ in enumerate(text.each("[]")):
                yield key, i, text.value()[1]
        else:
            found, _ = text.value()
            if key == "graph" and found is not None:
                about |= _about(found)


def _blocks(path: str | Path, about: dict[str, str], lists: set[str]) -> Iterator[pa.Table]:
    """The items of a graph file as (part, ordinal, item), some BLOCK characters at a time."""
    held, size = [], 0
    with open(path, encoding="utf-8-sig") as f:
        for item in _items(f, about, lists):
            held.append(item)
            size += len(item[2])
            if size >= BLOCK:
                yield pa.table(dict(zip(("part", "ordinal", "item"), zip(*held))))
                held, size = [], 0
    if held:
        yield pa.table(dict(zip(("part", "ordinal", "item"), zip(*held))))


def _about(found: Any) -> dict[str, str]:
    return {k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in found.items()} if isinstance(found, dict) else {}


def _lines(spark: SparkSession, path: str | Path, about: dict[str, str]) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, links) of a graph file of the layout that `sinks.store.write_graph` has, a line for each and a comma in front
    of all but the first; none if the file is of another.  `about` is filled with what the file says of itself.

    Lines are read by tasks.  That each is one object, and what stands between the objects, is tested for every line.
    """
    with open(path, "rb") as f:
        head = f.readline(PIECE)
    try:
        text = head.decode()
        says = json.loads(text + "]}") if text.endswith('"nodes": [\n') else None
    except ValueError:
        return None
    if not isinstance(says, dict) or list(says) != ["directed", "multigraph", "graph", "nodes"] or says["nodes"] != []:
        return None
    whole = T.StructType([*NODE.fields, *LINK.fields, T.StructField("_bad", T.StringType())])
    read = spark.read.text(for_tasks(spark, path)).select("value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("ordinal"))
    item = F.when(F.col("value").startswith(",{"), F.expr("substr(value, 2)")).when(F.col("value").startswith("{") & ~F.col("value").endswith("["), F.col("value"))
    split = read.select("ordinal", item.alias("item"), F.col("value").startswith(",").alias("comma"), "value")
    one = (F.json_array_length(F.concat(F.lit("["), "item", F.lit("]"))) == 1) & F.is_valid_utf8("item")
    rows = kept(split.select("ordinal", "comma", F.when(F.col("item").isNull(), F.col("value")).alias("frame"), F.coalesce(one, F.lit(False)).alias("one"), F.from_json("item", whole, {"columnNameOfCorruptRecord": "_bad"}).alias("e")).select("ordinal", "comma", "frame", "one", "e.*"))
    frame = rows.where("frame is not null").select("ordinal", "frame").limit(4).sort("ordinal").collect()
    if [r.frame for r in frame] != [text[:-1], '], "links": [', "]}"]:
        return None
    block, line = frame[1].ordinal
    items = rows.where("frame is null").withColumn("is_node", (F.col("ordinal.block") < block) | ((F.col("ordinal.block") == block) & (F.col("ordinal.line") < line)))
    firsts = F.sum((~F.col("comma")).cast("long")).alias("firsts")
    found = items.groupBy("is_node").agg(firsts, F.min("ordinal").alias("least"), F.min(F.when(~F.col("comma"), F.col("ordinal"))).alias("first"), F.max("ordinal").alias("to"), F.sum((~F.col("one") | F.col("_bad").isNotNull()).cast("long")).alias("bad")).collect()
    if any(r.bad or r.firsts != 1 or r["first"] != r.least or r.least < frame[0].ordinal or r.to > frame[2].ordinal for r in found):
        return None
    about |= _about(says["graph"])
    return items.where("is_node").select("ordinal", "_bad", *NODE.names), items.where("not is_node").select("ordinal", "_bad", *LINK.names)


def read_graph(spark: SparkSession, path: str | Path | None) -> Graph:
    """A graph from node-link JSON, whose edges may be called links or edges; of parallel edges the last one in the file
    stays, nulls included.  A file that is missing or cannot be read is an empty graph.  Tasks read files of the store's layout
    (`_lines`).  Of others the driver reads a piece at a time and every node and link becomes a row, so that no graph is one
    record in one task.

    Nodes that only edges name are nodes too.
    """
    if path is None or not Path(path).exists():
        return _no_graph(spark)
    about: dict[str, str] = {}
    lists: set[str] = set()
    by_line = _lines(spark, path, about)
    if by_line is not None:
        return _graph(*by_line, about)
    try:
        listed = kept_blocks(spark, _blocks(path, about, lists), "part string, ordinal long, item string")
    except (ValueError, RecursionError):
        return _no_graph(spark)

    def parsed(part: str, schema: T.StructType) -> DataFrame:
        whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
        rows = listed.where(F.col("part") == part).select("ordinal", F.from_json("item", whole, {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
        return kept(rows.select("ordinal", "e.*"))

    edge, node = parsed("edges" if "edges" in lists else "links", LINK), parsed("nodes", NODE)
    if edge.where("_bad is not null").head(1) or node.where("_bad is not null").head(1):
        return _no_graph(spark)
    return _graph(node, edge, about)


def _graph(node: DataFrame, edge: DataFrame, about: dict[str, str]) -> Graph:
    """The graph of nodes and links as they are listed, each with its ordinal."""
    last = F.max(F.struct("ordinal", *[c for c in LINK.names if c not in ("source", "target")])).alias("last")
    edges = edge.where("source is not null and target is not null").groupBy("source", "target").agg(last).select("source", "target", "last.*").drop("ordinal")
    nodes = node.where("id is not null").drop("ordinal", "_bad").dropDuplicates(["id"])
    bare = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return Graph(nodes.unionByName(bare, allowMissingColumns=True), edges, about)


def read_graphs(spark: SparkSession, folder: str) -> dict[str, Graph]:
    """The five graphs of a scan."""
    return {name: read_graph(spark, graph_path(folder, file)) for name, file in GRAPH_FILES.items()}


def graph_about(path: str | Path) -> dict[str, Any]:
    """What a graph file says of itself (run, mode, solution)."""
    return load_json(path).get("graph", {})


def _raw_soft(spark: SparkSession, payload: Any) -> tuple[list[Any], dict]:
    if isinstance(payload, list):
        return payload, {}
    edges = payload.get("edges", []) if isinstance(payload, dict) else None
    if not isinstance(edges, list):
        raise ValueError("soft edges must be a list, or an object with a list of edges")
    return edges, {k: v for k, v in payload.items() if k != "edges"}


def soft_rows(spark: SparkSession, edges: list[Any]) -> DataFrame:
    """Edges of a payload as rows with their ordinal; a list of evidence becomes texts, anything else is told apart."""
    rows = []
    for i, e in enumerate(edges):
        if not isinstance(e, dict):
            raise ValueError("each soft edge must be an object")
        evidence = e.get("evidence", [])
        is_list = evidence is None or isinstance(evidence, list)
        text = lambda v: None if v is None else str(v)
        rows.append((text(e.get("source")), text(e.get("target")), text(e.get("type")), text(e.get("confidence")), [str(x) for x in evidence or []] if is_list else [], is_list, text(e.get("notes")), i))
    return spark.createDataFrame(rows, "source string, target string, type string, confidence string, evidence array<string>, evidence_is_list boolean, notes string, ordinal long")


def read_soft_import(spark: SparkSession, path: str | Path) -> tuple[DataFrame, dict]:
    """(edges, header) of a file to import; its edges are checked as they are read."""
    edges, about = _raw_soft(spark, load_json(path))
    header = {"schema_version": about.get("schema_version", 1), "generated_by": about.get("generated_by", "external_ai"), "notes": about.get("notes", "")}
    return soft_edges.valid(soft_rows(spark, edges)).drop("evidence_is_list"), header


def read_soft_overlay(spark: SparkSession, path: str | Path | None) -> DataFrame:
    """The overlay graph's edges: those with both ends, a default type, the last of parallel ones; empty if the file is
    missing, cannot be read, or is a bare list."""
    empty = soft_rows(spark, [])
    rows = empty
    if path is not None and Path(path).exists():
        try:
            payload = load_json(path)
            rows = soft_rows(spark, payload["edges"]) if isinstance(payload, dict) else empty
        except (ValueError, KeyError):
            rows = empty
    ends = rows.where("source <> '' and target <> ''").withColumn("type", F.coalesce("type", F.lit(soft_edges.DEFAULT_TYPE)))
    last = ends.groupBy("source", "target").agg(F.max(F.struct("ordinal", "type", F.col("confidence").try_cast("double").alias("confidence"), "evidence", F.coalesce("notes", F.lit("")).alias("notes"))).alias("last"))
    return last.select("source", "target", "last.*")


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_path, text, modified_at) of whole files; bytes that are no UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "")
    return files.select(F.col("path").alias("file_path"), text.alias("text"), F.col("modificationTime").alias("modified_at"))


def last_run(runs: DataFrame) -> DataFrame:
    """(last_run): when the last completed run began; null if none was."""
    return runs.where("status = 'completed'").agg(F.max("started_at").cast("timestamp").alias("last_run"))


def changed_projects(projects: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """(id) of the projects to scan again: with a file (of their own or a document) changed after the last completed run or
    gone (null time); all of them if no run was completed."""
    since = last_run(runs)
    newest = files.groupBy(F.col("project_id").alias("id")).agg(F.max("modified_at").alias("newest"), F.bool_or(F.col("modified_at").isNull()).alias("gone"))
    both = projects.select("id").join(newest, "id", "left").crossJoin(F.broadcast(since))  # one row
    return both.where("last_run is null or gone or newest > last_run").select("id")


def project_closure(path: str | Path) -> list[Path]:
    """A project file and those that it imports, by way of any number of others; each once, missing ones left out."""
    found: list[Path] = []
    queue = [Path(path).resolve()]
    while queue:
        at = queue.pop(0)
        if at in found or not at.is_file():
            continue
        found.append(at)
        for name in re.findall(r'(?i)<(?:[\w.-]+:)?Import\s[^>]*?\bProject\s*=\s*"([^"]+)"', at.read_text(encoding="utf-8-sig", errors="replace")):
            queue.append((at.parent / name.replace("\\", "/")).resolve())
    return found


def _element(c: str, name: str) -> Column:
    """The trimmed text of the first element of that local name, whatever its case and prefix; null if there is none."""
    found = F.regexp_extract(c, rf"(?is)<(?:[\w.-]+:)?{name}(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?{name}\s*>", 1)
    return F.nullif(F.btrim(found, F.lit(" \t\r\n")), F.lit(""))


#: What names a test project: in its names, in its file.
TEST_NAMES = (".test", "tests", "integrationtest", "unittest")
TEST_PACKAGES = ("microsoft.net.test.sdk", "mstest", "nunit", "xunit", "coverlet.msbuild")


def project_metadata(files: DataFrame) -> DataFrame:
    """(file_path, name, assembly_name, target_framework, project_type, is_test_project, is_sdk_style) of project files
    (file_path, text): from their XML, a test project by its own flag, else by its names, else by its packages."""
    stem = F.regexp_replace(F.substring_index(F.replace("file_path", F.lit("\\"), F.lit("/")), "/", -1), "[.][^.]*$", "")
    rows = files.withColumn("__xml", F.regexp_replace(F.coalesce("text", F.lit("")), "(?s)<!--.*?-->", ""))
    name = F.coalesce(_element("__xml", "AssemblyName"), stem)
    rows = rows.withColumns({"name": name, "assembly_name": _element("__xml", "AssemblyName"), "target_framework": F.coalesce(_element("__xml", "TargetFramework"), _element("__xml", "TargetFrameworks")), "project_type": F.coalesce(_element("__xml", "OutputType"), F.lit("Library"))})
    names = F.lower(F.concat_ws(" ", "name", stem, "assembly_name", "file_path"))
    some = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    flag = F.lower(_element("__xml", "IsTestProject"))
    test = F.when(flag.isin("true", "false"), flag == "true").otherwise(some(names, TEST_NAMES) | some(F.lower("__xml"), TEST_PACKAGES))
    sdk = F.col("__xml").rlike(r"(?is)<project[^>]*\ssdk\s*=") | F.col("__xml").rlike(r"(?is)<sdk[\s/>]")
    return rows.select("file_path", "name", "assembly_name", "target_framework", "project_type", test.alias("is_test_project"), sdk.alias("is_sdk_style"))


def declared_markup(projects: DataFrame) -> DataFrame:
    """(file_path, include) of the markup files that project files name in their items."""
    found = F.regexp_extract_all("text", F.lit(r'(?i)(?:Include|Update)\s*=\s*"([^"]+\.a?xaml)"'), F.lit(1))
    return projects.select("file_path", F.explode(found).alias("include"))


def markup_paths(declared: DataFrame, walked: DataFrame) -> DataFrame:
    """(path) of markup files, declared or found by walking, each once whatever its case; build folders are left out."""
    every = declared.select("path").union(walked.select("path")).withColumn("path", F.replace("path", F.lit("\\"), F.lit("/")))
    kept = every.where(F.lower("path").rlike(r"[.]a?xaml$") & ~F.lower("path").rlike("/(bin|obj)/"))
    return kept.groupBy(F.lower("path").alias("__low")).agg(F.min("path").alias("path")).select("path")


def load_settings(path: str | Path) -> dict[str, Any]:
    """Settings from a YAML file of nested keys, lists and plain values; none if the file is missing."""
    at = Path(path)
    if not at.exists():
        return {}
    text = at.read_text(encoding="utf-8-sig")
    try:
        import yaml
    except ImportError:
        return _plain_yaml(text)
    return yaml.safe_load(text) or {}


def _scalar(text: str) -> Any:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def _plain_yaml(text: str) -> dict[str, Any]:
    """Nested keys by indentation, lists of plain values, comments."""
    root: dict[str, Any] = {}
    stack: list[tuple[int, Any, Any, str | None]] = [(-1, root, None, None)]
    for line in text.splitlines():
        bare = line.split(" #", 1)[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        indent, item = len(bare) - len(bare.lstrip()), bare.strip()
        while len(stack) > 1 and indent <= stack[-1][0] and not (item.startswith("- ") and indent == stack[-1][0] and isinstance(stack[-1][1], list)):
            stack.pop()
        _, here, parent, name = stack[-1]
        if item.startswith("-"):
            if isinstance(here, dict) and not here and parent is not None:
                here = parent[name] = []
                stack[-1] = (stack[-1][0], here, parent, name)
            here.append(_scalar(item[1:]))
            continue
        key, _, value = item.partition(":")
        if value.strip():
            here[key.strip()] = _scalar(value)
        else:
            here[key.strip()] = {}
            stack.append((indent, here[key.strip()], here, key.strip()))
    return root


@dataclass
class Workspace:
    """Where a workspace's tables, graphs, reports and vectors are."""

    tables: str
    graphs: str
    reports: str
    vectors: str


def workspace(folder: str | None, settings: dict[str, Any] | None = None) -> Workspace:
    """The paths of a workspace folder; without one, those that the settings name."""
    if folder:
        out = Path(folder) / "output"
        return Workspace(str(out / "tables"), str(out / "graphs"), str(out / "reports"), str(out / "embeddings"))
    s = settings or {}
    part = lambda a, b: (s.get(a) or {}).get(b) or ""
    return Workspace(part("database", "path"), part("graphs", "directory"), str(Path(part("output", "directory")) / "reports"), part("output", "embeddings_dir"))


#: What moves a solution or a project file down the list of those to open, in points.
_SKIPPED = "/(bin|obj|[.]git|[.]vs)/"


def best_candidate(paths: DataFrame, root: str) -> DataFrame:
    """(path) of the solution to open below a folder, else of the project: shallow ones first, those below src before
    others, demos, samples, tests and extensions last; ties by the shorter path, then by name."""
    low = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    inner = F.lower(F.regexp_replace(F.expr(f"substr(replace(path, chr(92), '/'), {len(root.rstrip('/')) + 1})"), "^/", ""))
    rows = paths.where(low.rlike(r"[.](sln|slnx|csproj)$") & ~low.rlike(_SKIPPED)).withColumn("project", low.endswith(".csproj")).withColumn("inner", inner)
    deep = (F.length("inner") - F.length(F.replace("inner", F.lit("/"), F.lit("")))) * 10
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    solution = points(F.col("inner").startswith("src/"), -20) + points(F.col("inner").contains("/extension/"), 30) + points(F.col("inner").contains("/demo/"), 10)
    project = points(F.col("inner").startswith("src/"), -10) + points(F.col("inner").rlike("demo|sample|test"), 20) + points(F.col("inner").contains("/extension/"), 30)
    return rows.orderBy("project", deep + F.when(F.col("project"), project).otherwise(solution), F.length("path"), "path").limit(1).select("path")


def vector_index(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table of vectors that `sinks.store.write_index` wrote; None if there is none."""
    return spark.read.parquet(folder) if exists(spark, folder) else None
