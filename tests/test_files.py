"""Readers, the store, graph files, the command line."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph import cli
from loomgraph.functions import text
from loomgraph.operators import candidates
from loomgraph.sinks.store import Store, export_graphs, fold, write_graph
from loomgraph.sources import files, markup
from loomgraph.streaming.ingest import follow


def test_graph_files(spark, tmp_path):
    doc = {"directed": True, "multigraph": False, "graph": {"type": "call", "analysis_run_id": "r1"}, "nodes": [{"id": "a", "kind": "method", "file": "A.cs"}, {"id": "b", "kind": "method"}], "links": [{"source": "a", "target": "b", "type": "calls", "rule_id": "r"}, {"source": "a", "target": "b", "type": "xaml_event", "rule_id": None}, {"source": "a", "target": "c", "type": "calls"}]}
    (tmp_path / "graphs").mkdir()
    at = tmp_path / "graphs" / "call_graph.json"
    at.write_text(json.dumps(doc))
    g = files.read_graph(spark, files.graph_path(str(tmp_path), "call_graph.json"))
    assert {(r.source, r.target, r.type, r.rule_id) for r in g.edges.collect()} == {("a", "b", "xaml_event", None), ("a", "c", "calls", None)}
    assert {r.id: r.kind for r in g.nodes.collect()} == {"a": "method", "b": "method", "c": None} and g.about["analysis_run_id"] == "r1"
    doc["edges"] = doc.pop("links")
    at.write_text(json.dumps(doc))
    assert files.read_graph(spark, at).edges.count() == 2
    at.write_text("{ not json")
    assert files.read_graph(spark, at).edges.count() == 0 and files.read_graph(spark, None).nodes.count() == 0
    write_graph(tmp_path / "out.json", "call", g.nodes, g.edges, "r2")
    back = files.read_graph(spark, tmp_path / "out.json")
    assert back.edges.count() == 2 and back.about["analysis_run_id"] == "r2" and json.loads((tmp_path / "out.json").read_text())["multigraph"] is False


def test_graph_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    links = [{"source": f"s{i % 40}", "target": f"t{i % 7}é\"]}},\\", "type": None if i % 3 else "a, b", "call_count": 10 ** (i % 12), "is_external": i % 2 == 0} for i in range(300)]
    doc = {"nodes": [{"id": f"s{i}", "kind": "method", "more": {"deep": [1, {"x": "]"}]}} for i in range(40)], "graph": {"a": "b", "n": 1, "none": None}, "other": [[], {}, "links"], "links": links}
    want = {(e["source"], e["target"]): (e["type"], e["call_count"], e["is_external"]) for e in links}
    monkeypatch.setattr(type(spark.read), "json", lambda *a, **b: pytest.fail("a graph is read as one record"))
    at = tmp_path / "g.json"
    for piece, block, indent in ((1 << 20, 1 << 24, None), (7, 500, None), (64, 2000, 2)):
        monkeypatch.setattr(files, "PIECE", piece)
        monkeypatch.setattr(files, "BLOCK", block)
        at.write_text("﻿" + json.dumps(doc, indent=indent, ensure_ascii=False), encoding="utf-8")
        g = files.read_graph(spark, at)
        assert {(r.source, r.target): (r.type, r.call_count, r.is_external) for r in g.edges.collect()} == want
        assert g.nodes.count() == 40 + 7 and g.about == {"a": "b", "n": "1", "none": None}
    for text in ("", "[]", "{", '{"links": [{"source": "a", "target": "b"}', '{"links": [{"source": "a" "target": "b"}]}', '{"links": {}}', '{"links": [{"source": "a", "target": "b", "call_count": "many"}]}'):
        at.write_text(text)
        assert files.read_graph(spark, at).edges.count() == 0, text
    at.write_text('{"links": [{"source": "a", "target": "b"}], "edges": [], "nodes": null}')
    assert files.read_graph(spark, at).edges.count() == 0
    at.write_text('{"links": [{"source": "a", "target": "b"}], "edges": null}')
    assert files.read_graph(spark, at).edges.count() == 1


def test_soft_edge_files(spark, tmp_path):
    at = tmp_path / "in.json"
    at.write_text("﻿" + json.dumps({"schema_version": 3, "edges": [{"source": " a ", "target": "b ", "confidence": 0.5, "evidence": ["match", 123], "notes": None}]}), encoding="utf-8")
    df, head = files.read_soft_import(spark, at)
    r = df.first()
    assert (r.source, r.target, r.type, r.confidence, r.evidence, r.notes, head["schema_version"]) == ("a", "b", "ai_soft_edge", 0.5, ["match", "123"], "", 3)
    for bad in ("x", {"source": "", "target": "b"}, {"source": "a", "target": "b", "confidence": 1.5}, {"source": "a", "target": "b", "confidence": "much"}, {"source": "a", "target": "b", "evidence": "text"}):
        at.write_text(json.dumps([bad]))
        with pytest.raises(Exception):  # noqa: B017, PT011
            files.read_soft_import(spark, at)[0].collect()
    at.write_text(json.dumps({"edges": [{"source": "a", "target": "b", "confidence": 0.1}, {"source": "a", "target": "b", "confidence": 0.9}, {"source": "", "target": "b"}]}))
    assert [(r.source, r.confidence, r.type) for r in files.read_soft_overlay(spark, at).collect()] == [("a", 0.9, "ai_soft_edge")]
    at.write_text("[]")
    assert files.read_soft_overlay(spark, at).count() == 0 and files.read_soft_overlay(spark, tmp_path / "none").count() == 0


def test_projects_and_markup(spark):
    rows = [("/r/App.csproj", '<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><TargetFrameworks>net8.0</TargetFrameworks><OutputType> Exe </OutputType></PropertyGroup><ItemGroup><Page Include="Views\\Main.xaml"/></ItemGroup></Project>'),
            ("/r/Lib.csproj", "<Project><AssemblyName>Lib.Core</AssemblyName><PackageReference Include='xunit'/></Project>"), ("/r/My.Tests.csproj", "<Project/>"), ("/r/UnitTest.csproj", "<Project><IsTestProject>false</IsTestProject></Project>"), ("/r/Odd.csproj", None)]
    df = spark.createDataFrame(rows, "file_path string, text string")
    got = {r.file_path[3:]: (r.name, r.target_framework, r.project_type, r.is_test_project, r.is_sdk_style) for r in files.project_metadata(df).collect()}
    assert got == {"App.csproj": ("App", "net8.0", "Exe", False, True), "Lib.csproj": ("Lib.Core", None, "Library", True, False), "My.Tests.csproj": ("My.Tests", None, "Library", True, False), "UnitTest.csproj": ("UnitTest", None, "Library", False, False), "Odd.csproj": ("Odd", None, "Library", False, False)}
    assert [r.include for r in files.declared_markup(df).collect()] == ["Views\\Main.xaml"]
    paths = lambda *xs: spark.createDataFrame([(x,) for x in xs], "path string")
    assert [r.path for r in files.markup_paths(paths("/r/A.xaml", "/r/obj/B.xaml"), paths("/R/a.XAML", "/r/c.cs")).collect()] == ["/R/a.XAML"]
    chosen = lambda *xs: files.best_candidate(paths(*xs), "/r").first().path
    assert chosen("/r/deep/er/App.sln", "/r/src/App.sln", "/r/A.csproj") == "/r/src/App.sln" and chosen("/r/demo/a/D.csproj", "/r/x/A.csproj", "/r/bin/B.csproj") == "/r/x/A.csproj"


XML = '<Window x:Class="App.MainWindow" xmlns="urn:w" xmlns:x="http://schemas.microsoft.com/winfx/2006/xaml" xmlns:v="clr-namespace:App.Views;assembly=App" Title="TestWindow"><v:Panel Name="P" Click="OnClick" Tag="{x:Static v:Keys.Main}" Kind="{x:Type v:Item}" DataType="v:Row"/><v:Panel.Inner/></Window>'


def test_xml(spark):
    df = spark.createDataFrame([("/r/Main.xaml", XML), ("/r/No.xaml", "<a b='1 &lt; 2'/>"), ("/r/Bad.xaml", "<a"), ("/r/None.xaml", None)], "file_path string, text string")
    got = [r.rec for r in markup.attribute_records(df).collect()]
    mine = [r["fqn"] for r in got if r["document.x_class"] == "App.MainWindow"]
    assert mine[:4] == ["xaml::App.MainWindow::Window::Class", "xaml::App.MainWindow::Window::Title", "xaml::App.MainWindow::Panel::Name", "xaml::App.MainWindow::Panel::Click"]
    other = next(r for r in got if r["document.path"] == "/r/No.xaml")
    assert (other["fqn"], other["value"], other["document.x_class"]) == ("xaml::No.xaml::a::b", "1 < 2", None)
    uses = {(r.target, r.type) for r in markup.documents(df).collect()}
    assert uses == {("App.MainWindow", "xaml_codebehind"), *((f"App.Views.{t}", "xaml_type_usage") for t in ("Panel", "Keys", "Item", "Row"))}
    assert [(r.fqn, r.name, r.containing_type) for r in markup.symbols(markup.documents(df)).collect()] == [("xaml::App.MainWindow::Main.xaml", "Main.xaml", "App.MainWindow")]


def test_texts_and_changes(spark, tmp_path):
    (tmp_path / "a.cs").write_bytes(b"\xef\xbb\xbfok \xff")
    r = files.read_texts(spark, str(tmp_path)).first()
    assert r.text.startswith("ok ") and r.modified_at is not None
    runs = spark.sql("select '1' as id, timestamp'2024-01-02' as started_at, 'completed' as status union all select '2', timestamp'2024-02-02', 'failed'")
    assert str(files.last_run(runs).first()[0]).startswith("2024-01-02")
    docs = spark.sql("select 'p' as project_id, timestamp'2024-01-03' as modified_at union all select 'q', timestamp'2024-01-01' union all select 'g', null")
    projects = spark.createDataFrame([("p",), ("q",), ("g",), ("n",)], "id string")
    assert sorted(x.id for x in files.changed_projects(projects, docs, runs).collect()) == ["g", "p"]
    assert files.changed_projects(projects, docs, runs.where("id = '2'")).count() == 4


def test_settings(tmp_path):
    at = tmp_path / "s.yml"
    at.write_text("# settings\nretrieval:\n  top_k: 20\n  graph_expansion_depth: 2\noutput:\n  directory: './out'  # here\nexclude:\n  - obj\n  - bin\nflag: true\nnone:\n")
    assert files._plain_yaml(at.read_text()) == {"retrieval": {"top_k": 20, "graph_expansion_depth": 2}, "output": {"directory": "./out"}, "exclude": ["obj", "bin"], "flag": True, "none": {}}
    assert files.load_settings(tmp_path / "none.yml") == {}
    w = files.workspace("/w")
    assert (w.graphs, w.reports) == ("/w/output/graphs", "/w/output/reports") and files.workspace(None, {"output": {"directory": "/o"}}).reports == "/o/reports"
    assert files.report_path(str(tmp_path)).name == "dead_code_candidates.json"


def records(spark, folder):
    """Extracted records of a small scan, as `scan` reads them."""
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    put("projects", [("p", "s", "Demo", False), ("q", "s", "Other", False)], "id string, solution_id string, name string, is_test_project boolean")
    (folder / "src").mkdir(parents=True, exist_ok=True)
    code = folder / "src" / "Loader.cs"
    code.write_text("using System;\nusing System.Reflection;\nclass PluginLoader {\n  object Load(Type t) {\n    return Activator.CreateInstance(t);\n  }\n}\n")
    put("source_files", [("d1", "p", str(code), "Loader.cs"), ("d2", "p", "C:\\w\\Widget.xaml", "Widget.xaml")], "id string, project_id string, file_path string, file_name string")
    s = lambda i, fqn, name, kind, owner, loc, line=1, doc="d1", project="p": (fqn, name, kind, owner, "Demo", project, doc, "public", loc, line, line + 2, 1, False, i)
    put("arrivals", [
        s(1, "Demo.Widget", "Widget", "class", None, 40), s(2, "Demo.Widget.ButtonClick(object, RoutedEventArgs)", "ButtonClick", "method", "Demo.Widget", 8), s(3, "Demo.Widget.OnLoaded(object, RoutedEventArgs)", "OnLoaded", "method", "Demo.Widget", 5),
        s(4, "xaml::Demo.Widget::Widget.xaml", "Widget.xaml", "xaml", "Demo.Widget", 10, doc="d2"), s(5, "PluginLoader.Load(Type)", "Load", "method", "PluginLoader", 2, 4), s(6, "Demo.Legacy.LoadPlugin()", "LoadPlugin", "method", "Demo.Legacy", 12), s(7, "Other.Use()", "Use", "method", "Other", 3, project="q"), s(8, "Demo.Widget.count", "count", "field", "Demo.Widget", 1),
    ], "fqn string, name string, kind string, containing_type string, namespace string, project_id string, document_id string, accessibility string, loc long, line_start int, line_end int, parameter_count int, is_async boolean, ordinal long")
    put("calls", [("Other.Use()", "Demo.Widget.ButtonClick(object, RoutedEventArgs)", "calls", 2, 1), ("Demo.Widget.ButtonClick(object, RoutedEventArgs)", "Other.Use()", "calls", 1, 2), ("Other.Use()", "Nobody()", "calls", 1, 3)], "caller string, callee string, call_type string, call_count long, ordinal long")
    put("field_accesses", [("Other.Use()", "Demo.Widget.count", "write", True, 1), ("Other.Use()", "Demo.Widget.count", "write", False, 2), ("Demo.Widget.ButtonClick(object, RoutedEventArgs)", "Demo.Widget.count", "write", False, 3)], "accessor string, target string, access_kind string, is_external boolean, ordinal long")
    put("project_refs", [("q", "p"), ("q", "gone")], "source string, target string")
    put("records", [("csharp_invocation", {"fqn": "Other.Use()", "method.name": "Resolve", "invocation.generic_arg[0]": "LoadPlugin"})], "source_type string, rec map<string,string>")
    rules = folder / "rules"
    rules.mkdir(exist_ok=True)
    (rules / "di.json").write_text(json.dumps({"id": "di.resolve", "scope": {"source": "csharp_invocation", "target": "csharp_symbol"}, "match": {"where": [{"field": "method.name", "op": "eq", "value": "Resolve"}]}, "bind": {"t": "$invocation.generic_arg[0]"}, "resolve": {"target": {"kind": "method", "where": [{"field": "name", "op": "eq", "value": "$t"}]}}, "emit": {"edge_kind": "candidate_call", "call_type": "service_provider_dispatch", "rule_id": "di.resolve", "rule_family": "di", "rule_mode": "candidate"}}))
    return folder


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    w = tmp_path_factory.mktemp("w")
    records(spark, w / "records")
    cli.scan(cli.Context(str(w), {}), str(w / "records"))
    return w


def say(*argv):
    out = []
    assert cli.run(list(argv), out.append) == 0
    return "\n".join(out)


def test_scan_counts_and_drops(spark, workspace):
    store = Store(spark, str(workspace / "output" / "tables"))
    s = {r.fqn: r for r in store.table("symbols").collect()}
    assert s["Demo.Widget.ButtonClick(object, RoutedEventArgs)"].fan_in == 1 and s["Demo.Widget.count"].fan_in == 2 and s["Demo.Widget"].id == spark.sql("select sha2('Demo.Widget', 256)").first()[0]
    assert store.table("method_calls").count() == 2 and store.table("field_accesses").count() == 2 and store.table("project_dependencies").count() == 1
    assert [r.is_external for r in store.table("field_accesses").where("accessor_fqn = 'Other.Use()'").collect()] == [True]
    assert [r.status for r in store.table("analysis_runs").collect()] == ["completed"]
    g = files.read_graphs(spark, str(workspace / "output" / "graphs"))
    assert g["call"].edges.count() == 2 and {r.id for r in g["dependency"].nodes.collect()} == {"Demo", "Other"} and g["field_access"].nodes.count() == 3


def test_scan_again_and_rules(spark, tmp_path):
    records(spark, tmp_path / "records")
    c = cli.Context(str(tmp_path), {})
    cli.scan(c, str(tmp_path / "records"), rules=str(tmp_path / "records" / "rules"))
    calls = c.store.by_name("method_calls").where("rule_family = 'di'").collect()
    assert [(r.caller, r.callee, r.call_type, r.rule_mode) for r in calls] == [("Other.Use()", "Demo.Legacy.LoadPlugin()", "service_provider_dispatch", "candidate")]
    c.store.reset_projects(["p"])
    assert [r.fqn for r in c.store.table("symbols").collect()] == ["Other.Use()"]
    assert c.store.table("method_calls").count() == 2  # edges from elsewhere stay, even into what is gone
    c.store.reset()
    assert c.store.table("symbols").count() == 0 and c.store.table("analysis_runs").count() == 1


def test_tables_of_an_older_shape(spark, tmp_path):
    spark.createDataFrame([("i", "A.x")], "id string, fqn string").write.parquet(f"{tmp_path}/symbols")
    t = Store(spark, str(tmp_path)).table("symbols")
    assert "rule_id" in Store(spark, str(tmp_path)).table("method_calls").columns and t.first().fqn == "A.x" and t.first().fan_in is None
    two = t.withColumn("ordinal", F.lit(1).cast("long")).union(t.withColumn("loc", F.lit(5).cast("long")).withColumn("is_async", F.lit(True)).withColumn("ordinal", F.lit(2).cast("long")))
    r = fold(two).first()
    assert (r.loc, r.is_async, r.is_static, r.parameter_count) == (5, True, False, 0) and fold(t.withColumn("ordinal", F.lit(1))).first().is_static is None


def test_listings(workspace):
    w = ("--workspace", str(workspace))
    assert "ButtonClick" in say("symbols", *w, "button%click") and say("files", *w, "--pattern", "widget", "--json").count("file_name") == 1
    assert "complete" in say("doctor", *w) and json.loads(say("graph-meta", *w))["type"] == "call"


def test_reports(workspace):
    w = ("--workspace", str(workspace))
    assert json.loads(say("hotspots", *w)) == {"high": 1}
    text = (workspace / "output" / "reports" / "hotspots.md").read_text()
    assert "## Top 50 Hotspots (General)" in text and "## Shared Mutable State (Runtime/Event - High Risk)" in text
    assert json.loads(say("show-hotspots", *w, "--json", "-n", "2"))["hotspots"][0]["score"] > 0
    assert "candidates" in say("deadcode", *w) and "Demo.Legacy.LoadPlugin()" in say("show-isolation", *w)


def test_soft_edges_and_comparison(workspace, capsys):
    w = ("--workspace", str(workspace))
    at = workspace / "soft.json"
    at.write_text(json.dumps({"edges": [{"source": "PluginLoader.Load(Type)", "target": "Demo.Legacy.LoadPlugin()", "confidence": 0.8, "evidence": ["reflection"]}]}))
    assert json.loads(say("import-ai-edges", *w, str(at)))["edge_count"] == 1
    at.write_text(json.dumps([{"source": "x", "target": "y", "confidence": 0.2}]))
    assert json.loads(say("import-ai-edges", *w, str(at)))["edge_count"] == 2
    assert "quality issues" in say("show-ai-edges", *w) and len(json.loads(say("show-ai-edges", *w, "--json"))["edges"]) == 2
    say("isolation", *w)
    assert "soft_covered_by_ai=1" in say("show-isolation", *w, "--compare-ai-soft-edges")
    say("isolation", *w, "--with-ai-soft-edges")
    assert json.loads(say("show-deadcode", *w, "--json"))["analysis_mode"] == "hard+ai-soft-edges"
    at.write_text(json.dumps([{"source": "", "target": "y"}]))
    assert cli.run(["import-ai-edges", *w, str(at)], print) == 1 and "not imported" in capsys.readouterr().err
    at.write_text("[]")
    assert json.loads(say("import-ai-edges", *w, str(at), "--replace"))["edge_count"] == 0


def test_candidates(workspace):
    w = ("--workspace", str(workspace))
    x = json.loads(say("xaml-candidates", *w, "--json"))
    assert [(c["xaml_fqn"], c["score"], [h["fqn"] for h in c["weak_handlers"]]) for c in x] == [("xaml::Demo.Widget::Widget.xaml", 7, ["Demo.Widget.OnLoaded(object, RoutedEventArgs)"])]
    bundle = json.loads(say("ai-candidates", *w, "--json", "--bundle-path", str(workspace / "b.json")))
    assert bundle["bundle_schema_version"] == 1.2 and json.loads((workspace / "b.json").read_text())["kind"] == "all"
    r = next(c for c in bundle["candidates"] if c["candidate_kind"] == "reflection")
    assert r["score"] == 1 + 3 + 3 and r["pattern_hits"] == ["Activator.CreateInstance"] and r["review_guidance"]["evidence_checklist"]
    assert [s["line_start"] for s in r["context_snippets"]][0] == 1 and "Activator" in r["context_snippets"][0]["text"]


def test_related_and_questions(workspace):
    w = ("--workspace", str(workspace))
    assert "Closest matches" in say("related", *w, "Demo.Widget.OnLoad") or "Source" in say("related", *w, "Demo.Widget.OnLoad")
    got = json.loads(say("related", *w, "OnLoaded", "--json"))
    assert got["source"]["kind"] == "method" and got["results"][0]["fqn"].startswith("Demo.Widget.ButtonClick")
    assert say("query", *w, "load a plugin") == "" and say("build-index", *w) == "8 vectors"
    assert "FQN:" in say("query", *w, "load a plugin", "--kind", "method") and say("query", *w, "x", "--kind", "enum") == ""


def test_code_candidate_scores(spark):
    s = spark.createDataFrame([("A.PluginLoader.Load(Type)", "Load", "method", "A.PluginLoader", "/a.cs", 2, 4), ("A.PluginLoader.x", "x", "field", "A.PluginLoader", "/a.cs", 1, 2)], "fqn string, name string, kind string, containing_type string, file_path string, loc long, line_start long")
    texts = spark.createDataFrame([("/a.cs", "p", "x Activator.CreateInstance(t) x"), ("/t.cs", "t", "Activator.CreateInstance"), ("/b.cs", "p", "nothing"), ("/c.xml", "p", ".Invoke("), ("/n.cs", "p", None)], "file_path string, project_id string, text string")
    projects = spark.createDataFrame([("p", "P", False), ("t", "T", True)], "id string, name string, is_test_project boolean")
    fan = spark.createDataFrame([("A.PluginLoader.Load(Type)", 0)], "fqn string, fan_in long")
    none = spark.createDataFrame([], "caller string, callee string, call_type string")
    got = candidates.code_candidates(texts, projects, s, fan, none, "reflection").collect()
    assert [(r.file_path, r.score, r.hard_edge_count) for r in got] == [("/a.cs", 5, 0)]
    edges = spark.createDataFrame([("A.PluginLoader.Load(Type)", "x", "reflection_constructor_dispatch")], none.schema)
    assert candidates.code_candidates(texts, projects, s, fan, edges, "reflection").first().score == 3
    assert candidates.focal_symbols(s, fan, "reflection").first().score == 4 + 3 + 2


def test_records_that_keep_arriving(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"))
    store.init()
    one = lambda i, loc: spark.createDataFrame([("A.x", "x", loc, i)], "fqn string, name string, loc long, ordinal long")
    for i, loc in ((1, 5), (2, 7)):
        one(i, loc).write.mode("append").parquet(str(tmp_path / "in"))
        follow(spark, str(tmp_path / "in"), one(0, 0).schema, store, str(tmp_path / "seen"), once=True).awaitTermination()
    assert [(r.fqn, r.loc) for r in store.table("symbols").collect()] == [("A.x", 12)]


def test_imported_projects(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csproj").write_text('<Project><Import Label="x" Project="sub\\b.projitems"/><Import Project="none.props"/></Project>')
    (tmp_path / "sub" / "b.projitems").write_text('<Project><Import Project="../a.csproj"/></Project>')
    assert [p.name for p in files.project_closure(tmp_path / "a.csproj")] == ["a.csproj", "b.projitems"]


@pytest.mark.parametrize("code,kind", [("x = 1", "write"), ("a.x ??= 1", "read_write"), ("x == 1", "read"), ("x => 1", "read"), ("--x", "read_write"), ("F(out x)", "write"), ("F(ref x)", "read_write"), ("xx = 1", "read"), (None, "read")])
def test_access_kinds(spark, code, kind):
    df = spark.createDataFrame([(code, "x")], "c string, n string")
    assert df.select(text.access_kind(F.col("c"), F.col("n"))).first()[0] == kind
