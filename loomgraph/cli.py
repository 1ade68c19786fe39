"""The command line over a workspace: scan records into tables, reports, listings, related symbols, questions, soft edges.

A workspace has output/tables (Parquet, `sinks.store`), output/graphs (node-link JSON), output/reports and
output/embeddings.  `scan` starts from extracted records: a folder of Parquet tables (arrivals, calls, inheritance,
type_uses, field_accesses, projects, source_files, and optionally records for the rules).
"""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import candidates, dsl, graph, hotspots, isolation, navigate, retrieval, similarity, soft_edges
from loomgraph.sinks import reports
from loomgraph.sinks.store import Store, export_graphs, write_index
from loomgraph.sources import files

SETTINGS = "loomgraph.yml"


def session() -> SparkSession:
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("loomgraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class Context:
    """What a command works on: the session, the workspace's paths, its tables and graphs."""

    def __init__(self, workspace: str | None, settings: dict[str, Any] | None = None):
        self.spark, self.settings = session(), files.load_settings(SETTINGS) if settings is None else settings
        self.folder, self.at = workspace, files.workspace(workspace, self.settings)
        self.store = Store(self.spark, self.at.tables)

    def graphs(self) -> dict[str, files.Graph]:
        return files.read_graphs(self.spark, self.at.graphs)

    def soft(self) -> DataFrame:
        return files.read_soft_overlay(self.spark, files.soft_edge_path(self.at.graphs, self.at.reports))

    def symbols(self) -> DataFrame:
        return self.store.named_symbols()

    def projects(self) -> DataFrame:
        return self.store.table("projects")


def _need(path: str | Path, label: str) -> bool:
    if Path(path).exists():
        return True
    print(f"{label} not found at {path}", file=sys.stderr)
    return False


def _dump(x: Any) -> str:
    return json.dumps(x, indent=2, ensure_ascii=False, default=str)


def _dicts(df: DataFrame) -> list[dict[str, Any]]:
    """Rows of a frame that a limit bounds."""
    return [r.asDict(recursive=True) for r in df.collect()]


def calls_of(g: files.Graph) -> DataFrame:
    """The call graph's edges with the column names of calls."""
    return g.edges.select(F.col("source").alias("caller"), F.col("target").alias("callee"), F.coalesce("type", F.lit("calls")).alias("call_type"), *graph.RULE_FIELDS, "call_count")


def _marked(c: Context, g: files.Graph) -> DataFrame:
    kinds = g.nodes.select(F.col("id").alias("fqn"), "kind")
    return graph.marked(calls_of(g), kinds)


def _ends(gs: dict[str, files.Graph]) -> dict[str, tuple[DataFrame, str, str]]:
    return {n: (g.edges, "source", "target") for n, g in gs.items() if n != "dependency"}


def scan(c: Context, records: str, mode: str = "full", rules: str | None = None) -> dict[str, Any]:
    """Reads extracted records into the tables, runs the rules, counts fan-in and writes the graphs."""
    read = lambda name: c.spark.read.parquet(f"{records}/{name}.parquet") if Path(f"{records}/{name}.parquet").exists() else None
    c.store.init()
    if mode == "full":
        c.store.reset()
    run_id = uuid.uuid4().hex
    projects, arrivals = read("projects"), read("arrivals")
    if mode == "incremental" and projects is not None and read("source_files") is not None and "modified_at" in read("source_files").columns:
        changed = files.changed_projects(projects, read("source_files"), c.store.table("analysis_runs")).select("id").collect()  # one row a project
        again = [r.id for r in changed]
        c.store.reset_projects(again)
        projects, arrivals = projects.where(F.col("id").isin(*again)), arrivals.where(F.col("project_id").isin(*again))
    c.store.put("analysis_runs", c.spark.createDataFrame([(run_id, datetime.now(timezone.utc), "running")], "id string, started_at timestamp, status string"))
    for name, df in (("projects", projects), ("source_files", read("source_files"))):
        if df is not None:
            c.store.put(name, df)
    if arrivals is not None:
        c.store.save_symbols(arrivals)
    calls, uses = read("calls"), read("type_uses")
    if rules and read("records") is not None:
        every = read("records").unionByName(dsl.symbol_records(c.store.table("symbols").select("fqn", "name", "kind", "containing_type", "namespace", "parameter_count", "return_type")))
        usable, wrong = dsl.load_rules(rules)
        for name, why in wrong.items():
            print(f"rule file {name} skipped: {why}", file=sys.stderr)
        scoped = dsl.in_scope(usable)
        if scoped:
            edges, _ = dsl.emitted(scoped, every)
            is_call = F.col("type") != "candidate_type_dependency"
            made = edges.where(is_call).select(F.col("source_fqn").alias("caller"), F.col("target_fqn").alias("callee"), F.col("type").alias("call_type"), *graph.RULE_FIELDS, F.lit(1).cast("long").alias("call_count"))
            calls = made if calls is None else calls.unionByName(made, allowMissingColumns=True)
            types = edges.where(~is_call).select(F.col("source_fqn").alias("source"), F.col("target_fqn").alias("target"), "type", *graph.RULE_FIELDS)
            uses = types if uses is None else uses.unionByName(types, allowMissingColumns=True)
    with_rules = lambda df: df.withColumns({f: F.lit(None).cast("string") for f in graph.RULE_FIELDS if f not in df.columns})
    if calls is not None:
        c.store.save_calls(with_rules(calls))
    if uses is not None:
        c.store.save_type_uses(with_rules(uses))
    if read("inheritance") is not None:
        c.store.save_inheritance(read("inheritance"))
    if read("field_accesses") is not None:
        c.store.save_accesses(read("field_accesses"))
    if read("project_refs") is not None:
        c.store.save_dependencies(graph.included_references(read("project_refs"), c.projects()).select(F.col("source").alias("source_project_id"), F.col("target").alias("target_project_id")))
    c.store.count_fan_in()
    export_graphs(c.store, c.at.graphs, run_id, mode)
    c.store.finish_run(run_id, "completed")
    return {"run": run_id, "mode": mode, "symbols": c.store.table("symbols").count()}


def doctor(c: Context) -> str:
    if not _need(c.at.tables, "Tables"):
        return "tables not found"
    return f"{c.store.table('symbols').count()} symbols; environment is complete"


def write_hotspots(c: Context) -> dict[str, int]:
    gs = c.graphs()
    refs = gs["dependency"].edges.select("source", "target")
    by_name = c.projects().select(F.col("name").alias("id"), "name").distinct()
    scored = hotspots.hotspots(c.symbols(), c.projects(), _marked(c, gs["call"]), graph.coupling(refs, by_name))
    state = hotspots.shared_state(c.store.accesses_by_name(), c.symbols(), c.projects(), names=True)
    return reports.write_hotspots(c.at.reports, scored, state)


def decided(c: Context, gs: dict[str, files.Graph], soft: DataFrame | None = None) -> DataFrame:
    """The cascade over the stored symbols and the graphs."""
    s = c.symbols()
    bases = gs["inheritance"].edges.select(F.col("source").alias("derived"), F.col("target").alias("base"))
    return isolation.cascade(s, c.projects(), s.select("fqn", "fan_in"), calls_of(gs["call"]), bases, gs["type_dependency"].edges.select("source", "target"), soft)


def write_isolation(c: Context, with_soft: bool = False) -> int:
    gs = c.graphs()
    soft = c.soft() if with_soft else None
    every = decided(c, gs, soft)
    kept = every.where("drop_reason is null")
    first = kept.orderBy(F.desc("loc"), "fqn").limit(50).select("fqn")
    near = similarity.related(c.symbols(), similarity.feature_sets(_ends(gs)), first, 3, least=0.45)
    near = near.groupBy(F.col("source").alias("fqn")).agg(F.array_sort(F.collect_list(F.struct("rank", "fqn", "kind", "score", "reasons"))).alias("related"))
    found = isolation.signals(kept, _ends(gs))
    maps = {"call": graph.rule_counts(calls_of(gs["call"])), "type": graph.rule_counts(gs["type_dependency"].edges, "source", "target")}
    types = graph.type_counts(_marked(c, gs["call"])).select("node", "direction", F.lit("type").alias("attribute"), F.col("type").alias("value"), "n")
    found = found.join(isolation.count_maps(maps["call"].union(types), "fqn", "call"), "fqn", "left").join(isolation.count_maps(maps["type"], "fqn", "type"), "fqn", "left").join(near, "fqn", "left")
    found = found.withColumn("nearest", F.expr("related[0].reasons")).withColumn("category", isolation.category(F.expr("related[0].score"), F.expr("related[0].reasons"))).withColumn("labels", isolation.labels(F.col("rules")))
    out = isolation.explained(found, "nearest").drop("nearest", "rules", "drop_reason")
    softly = None if soft is None else isolation.soft_suppressed(every, soft)
    reports.write_isolation(c.at.reports, out, isolation.rule_counters(every), isolation.category_counts(out), isolation.rule_summary(kept, maps), softly)
    return kept.count()


def related(c: Context, name: str, top_k: int, same_kind: bool, with_soft: bool) -> tuple[dict[str, Any] | None, list[Any]]:
    """(source, related symbols), or (None, suggestions) if no symbol is named."""
    s = c.symbols()
    one = similarity.resolve(s, name).first()
    if one is None:
        return None, [r.fqn for r in similarity.suggest(s, name).orderBy("rank").collect()]
    source = s.where(F.col("fqn") == one.fqn).select("fqn", "kind")
    features = similarity.feature_sets(_ends(c.graphs()), c.soft() if with_soft else None)
    found = similarity.related(s, features, source, top_k, same_kind).orderBy("rank").select("fqn", "kind", "score", "reasons")
    return source.first().asDict(), _dicts(found)


def ai_candidates(c: Context, kind: str, limit: int) -> list[dict[str, Any]]:
    """The best candidates of a kind, or of all, with what surrounds them."""
    gs, s = c.graphs(), c.symbols()
    fan = s.select("fqn", "fan_in")
    bare = s.drop("fan_in")
    paths = c.store.table("source_files").select("file_path", "project_id")
    there = [r.file_path for r in paths.select("file_path").distinct().toLocalIterator() if r.file_path and Path(r.file_path).exists()]
    texts = files.read_texts(c.spark, there).withColumn("file_path", F.regexp_replace("file_path", "^file:(//)?", "")).join(paths, "file_path") if there else paths.withColumn("text", F.lit(None).cast("string")).limit(0)
    by_kind: dict[str, DataFrame] = {}
    if kind in ("all", "xaml"):
        by_kind["xaml"] = candidates.xaml_candidates(bare, c.projects(), fan, calls_of(gs["call"]), gs["type_dependency"].edges, texts)
    for k in ("reflection", "di"):
        if kind in ("all", k):
            by_kind[k] = candidates.code_candidates(texts, c.projects(), bare, fan, calls_of(gs["call"]), k, snippets=True)
    return _dicts(candidates.merged(by_kind, limit))


def build_index(c: Context, embed: retrieval.Embed | None = None) -> int:
    gs = c.graphs()
    bases = gs["inheritance"].edges.select(F.col("source").alias("derived"), F.col("target").alias("base"))
    summaries = navigate.summaries(c.symbols(), calls_of(gs["call"]), bases)
    index = retrieval.build_index(c.symbols(), summaries, embed or retrieval.hashed_embedding(), int((c.settings.get("embedding") or {}).get("batch_size") or 64))
    write_index(index, c.at.vectors)
    return files.vector_index(c.spark, c.at.vectors).count()


def ask(c: Context, text: str, kind: str | None = None, project: str | None = None, embed: retrieval.Embed | None = None) -> list[dict[str, Any]]:
    index = files.vector_index(c.spark, c.at.vectors)
    if index is None:
        return []
    settings = c.settings.get("retrieval") or {}
    ends = {n: e for n, e in _ends(c.graphs()).items() if n in graph.LABELS}
    return _dicts(retrieval.search(index, text, embed or retrieval.hashed_embedding(), ends, int(settings.get("top_k") or 20), int(settings.get("graph_expansion_depth") or 2), kind, project))


def show_soft_edges(c: Context, limit: int, as_json: bool) -> str:
    at = Path(c.at.reports) / "ai_soft_edges.json"
    if not _need(at, "Soft edge report"):
        return ""
    rows = files.soft_rows(c.spark, files.load_json(at).get("edges", []))
    quality, warnings = _dicts(soft_edges.quality(rows).orderBy("type")), [r.warning for r in soft_edges.warnings(rows).orderBy("ordinal", "place").collect()]
    edges = _dicts(soft_edges.ranked(rows, limit).select("source", "target", "type", "confidence", "evidence", "notes"))
    if as_json:
        return _dump({"quality_summary": quality, "quality_warnings": warnings, "edges": edges})
    lines = [f"WARNING: {len(warnings)} quality issues found in AI soft edges.", *(f"  - {w}" for w in warnings[:3]), ""] if warnings else []
    for e in edges:
        lines += [f"[{e['type']}] confidence={e['confidence']:.2f} {e['source']} -> {e['target']}", *(f"  - {x}" for x in e["evidence"][:3])]
    return "\n".join(lines)


def show_hotspots(c: Context, limit: int, as_json: bool) -> str:
    at = Path(c.at.reports) / "hotspots.json"
    if not _need(at, "Hotspot report"):
        return ""
    d = files.load_json(at)
    rows = d.get("hotspots", [])[:limit]
    if as_json:
        return _dump({"schema_version": d.get("schema_version", 1), "report_kind": d.get("report_kind", "hotspots"), "hotspots": rows, "shared_mutable_state": d.get("shared_mutable_state", [])})
    return "\n".join(f"{i}. [{r['kind']}] {r['fqn']} | score={r['score']} | fan_in={r['fan_in']} | loc={r['loc']} | project={r['project']}" for i, r in enumerate(rows, 1))


def show_isolation(c: Context, limit: int, compare: bool, as_json: bool) -> str:
    at = files.report_path(c.at.reports)
    if not _need(at, "Structural isolation report"):
        return ""
    d = files.load_json(at)
    rows, comparison = d.get("candidates", [])[:limit], None
    if compare and _need(Path(c.at.reports) / "ai_soft_edges.json", "Soft edge report"):
        gs, soft = c.graphs(), c.soft()
        hard, with_soft = (decided(c, gs, s).where("drop_reason is null") for s in (None, soft))
        covered = hard.join(with_soft, "fqn", "left_anti").select("fqn")
        softly = _dicts(isolation.soft_suppressed(decided(c, gs, soft), soft).orderBy("fqn").limit(limit))
        comparison = {"comparison_kind": "ai_soft_edge_overlay", "hard_only_count": hard.count(), "with_ai_soft_edges_count": with_soft.count(), "soft_covered_by_ai_count": covered.count(), "soft_covered_by_ai": [r.fqn for r in covered.orderBy("fqn").limit(limit).collect()], "soft_only_suppressions": softly}
    mode = d.get("analysis_mode", "unknown")
    if as_json:
        out = {k: d.get(k) for k in ("analysis_mode", "report_kind", "rule_family_summary", "rule_mode_summary")} | {"candidates": rows}
        return _dump(out | ({"comparison": comparison} if comparison else {}))
    lines = [f"analysis_mode={mode}"]
    if comparison:
        lines.append(f"comparison: hard_only={comparison['hard_only_count']} | with_ai_soft_edges={comparison['with_ai_soft_edges_count']} | soft_covered_by_ai={comparison['soft_covered_by_ai_count']}")
    return "\n".join(lines + [f"{i}. [{r['kind']}] {r['fqn']} | category={r['category']} | loc={r['loc']} | why={r['why']}" for i, r in enumerate(rows, 1)])


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[tuple[str, ...], dict[str, Any]]) -> None:
        s = sub.add_parser(name)
        s.add_argument("--workspace", "-w")
        for names, how in options:
            s.add_argument(*names, **how)

    limit = lambda n: (("--limit", "-n"), {"type": int, "default": n})
    flag = lambda *names: (names, {"action": "store_true"})
    text = lambda *names: (names, {})
    command("scan", text("records"), (("--mode",), {"choices": ["full", "incremental"], "default": "full"}), text("--rules"))
    command("doctor")
    command("build-index")
    command("query", text("text"), text("--kind", "-k"), text("--project", "-p"))
    command("hotspots")
    for name in ("isolation", "deadcode"):
        command(name, flag("--with-ai-soft-edges"))
    command("related", text("symbol"), (("--top-k", "-n"), {"type": int, "default": 10}), (("--all-kinds",), {"action": "store_true"}), flag("--with-ai-soft-edges"), flag("--json"))
    command("files", text("--project", "-p"), text("--pattern"), limit(100), flag("--json"))
    command("symbols", (("query",), {"nargs": "?", "default": ""}), text("--kind", "-k"), text("--project", "-p"), text("--file"), limit(100), flag("--json"))
    command("import-ai-edges", text("path"), flag("--replace"))
    command("show-ai-edges", limit(20), flag("--json"))
    command("show-hotspots", limit(20), flag("--json"))
    for name in ("show-isolation", "show-deadcode"):
        command(name, limit(20), flag("--compare-ai-soft-edges"), flag("--json"))
    command("graph-meta")
    command("xaml-candidates", limit(20), flag("--json"))
    command("ai-candidates", (("--kind",), {"choices": ["all", "xaml", "reflection", "di"], "default": "all"}), limit(20), text("--bundle-path"), flag("--json"))
    return p


def run(argv: list[str], say: Callable[[str], None] = print) -> int:
    """One command; 0 if it did what it says."""
    a = _parser().parse_args(argv)
    c = Context(a.workspace)
    name = a.command
    if name == "scan":
        say(_dump(scan(c, a.records, a.mode, a.rules)))
    elif name == "doctor":
        say(doctor(c))
    elif name == "build-index":
        say(f"{build_index(c)} vectors")
    elif name == "query":
        for i, r in enumerate(ask(c, a.text, a.kind, a.project), 1):
            say(f"\n--- Result {i} (Score: {r['score']:.4f}) ---\nFQN: {r['fqn']} (Kind: {r['kind']}, Project: {r['project_id']})\nSummary: {r['summary']}")
            if r["context"]:
                say("\n".join(["Graph Context:", *(f"  - {x}" for x in r["context"])]))
    elif name == "hotspots":
        say(_dump(write_hotspots(c)))
    elif name in ("isolation", "deadcode"):
        say(f"{write_isolation(c, a.with_ai_soft_edges)} candidates")
    elif name == "related":
        source, found = related(c, a.symbol, a.top_k, not a.all_kinds, a.with_ai_soft_edges)
        if source is None:
            say("\n".join(["Closest matches:", *(f"  - {x}" for x in found)]))
        elif a.json:
            say(_dump({"source": source, "results": found}))
        else:
            say(f"Source: {source['fqn']} ({source['kind']})")
            for i, r in enumerate(found, 1):
                say("\n".join([f"\n--- Related {i} (score: {r['score']:.4f}) ---", f"FQN: {r['fqn']} (Kind: {r['kind']})", "Reasons:", *(f"  - {x}" for x in r["reasons"][:6])]))
    elif name == "files":
        rows = _dicts(navigate.list_files(c.store.table("source_files"), c.projects(), a.project, a.pattern, a.limit))
        say(_dump(rows) if a.json else "\n".join(f"[{r['project']}] {r['file_path']}" for r in rows))
    elif name == "symbols":
        s = c.symbols()
        rows = _dicts(navigate.list_symbols(s.drop("fan_in"), c.projects(), s.select("fqn", "fan_in"), a.query, a.kind, a.project, a.file, a.limit))
        say(_dump(rows) if a.json else "\n".join(f"[{r['kind']}] {r['fqn']} | project={r['project']} | fan_in={r['fan_in']} | loc={r['loc']} | {r['file_path'] or '(no file)'}" for r in rows))
    elif name == "import-ai-edges":
        try:
            say(_dump(reports.import_soft_edges(c.spark, a.path, c.at.reports, a.replace)))
        except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is told to its owner
            print(f"soft edges were not imported: {str(e).splitlines()[0]}", file=sys.stderr)
            return 1
    elif name == "show-ai-edges":
        say(show_soft_edges(c, a.limit, a.json))
    elif name == "show-hotspots":
        say(show_hotspots(c, a.limit, a.json))
    elif name in ("show-isolation", "show-deadcode"):
        say(show_isolation(c, a.limit, a.compare_ai_soft_edges, a.json))
    elif name == "graph-meta":
        at = files.graph_path(c.at.graphs, files.GRAPH_FILES["call"])
        if at is None:
            return 0 if _need(Path(c.at.graphs) / files.GRAPH_FILES["call"], "Call graph") else 1
        say(_dump(files.graph_about(at)))
    else:
        kind = "xaml" if name == "xaml-candidates" else a.kind
        found = ai_candidates(c, kind, a.limit)
        bundle = reports.bundle(c.folder, kind, found)
        path = getattr(a, "bundle_path", None)
        if path:
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            Path(path).write_text(_dump(bundle), encoding="utf-8")
        if a.json:
            say(_dump(bundle if name == "ai-candidates" else found))
        else:
            for i, r in enumerate(found, 1):
                say(f"{i}. [{r['candidate_kind']}] score={r['score']} | project={r['project']}\n   file={r['file_path']}\n   reasons={'; '.join(r['reasons'])}")
    return 0


def main() -> int:
    return run(sys.argv[1:])
