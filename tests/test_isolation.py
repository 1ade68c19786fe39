"""The cascade of isolation, its counters, explanations and report on one small project."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, isolation
from loomgraph.sinks import reports

SYMBOL = "fqn string, name string, kind string, containing_type string, accessibility string, project_id string, file_path string, loc long"
CALL = "caller string, callee string, call_type string, rule_id string, rule_family string, rule_mode string, call_count long"


def method(fqn, name, owner, path, loc):
    return fqn, name, "method", owner, "public", "p", f"C:\\repo\\{path}", loc


SYMBOLS = [
    ("App.PlainUtility", "PlainUtility", "class", None, "public", "p", "C:\\repo\\Services\\PlainUtility.cs", 50),
    ("App.CustomFileUploaderService", "CustomFileUploaderService", "class", None, "public", "p", "C:\\repo\\Uploaders\\Custom.cs", 40),
    method("App.CustomFileUploaderService.CreateUploader()", "CreateUploader", "App.CustomFileUploaderService", "Uploaders\\Custom.cs", 10),
    method("App.EditorView.OnLoaded()", "OnLoaded", "App.EditorView", "Views\\EditorView.axaml.cs", 20),
    method("App.WidgetRenderer.Render()", "Render", "App.WidgetRenderer", "WidgetRenderer.cs", 30),
    method("App.Model.ActiveToolName.get", "get", "App.Model", "Model.cs", 4),
    method("App.Startup.Configure(x)", "Configure", "App.Startup", "Startup.cs", 20),
    method("App.LogMiddleware.Invoke(x)", "Invoke", "App.LogMiddleware", "Middleware\\Log.cs", 20),
    method("App.HomeController.Config()", "Config", "App.HomeController", "Controllers\\Home.cs", 20),
    method("App.AuthFilter.OnActionExecuting(x)", "OnActionExecuting", "App.AuthFilter", "Filters\\Auth.cs", 20),
    method("App.TerminalViewModel.Receive(FooMessage)", "Receive", "App.TerminalViewModel", "Terminal.cs", 4),
    method("App.TerminalViewModel.Receive(int)", "Receive", "App.TerminalViewModel", "Terminal.cs", 4),
    method("App.Box.BindingPathPropertyChanged(DependencyObject, DependencyPropertyChangedEventArgs)", "BindingPathPropertyChanged", "App.Box", "Box.cs", 6),
    method("App.Runtime.IListener.OnKeyboardCommand(x)", "OnKeyboardCommand", "App.Runtime", "Runtime.cs", 6),
]


@pytest.fixture(scope="module")
def scene(spark):
    s = spark.createDataFrame(SYMBOLS, SYMBOL)
    projects = spark.createDataFrame([("p", "P", False)], "id string, name string, is_test_project boolean")
    fan_in = s.select("fqn", F.when(F.col("name") == "CreateUploader", 1).otherwise(0).alias("fan_in"))
    calls = spark.createDataFrame([("App.PlainUtility", "App.DownstreamService.Execute()", "calls", "di.service_configuration", "di", "hard", 1)], CALL)
    uses = spark.createDataFrame([("App.PlainUtility", "App.Dependency", "xaml_type_usage", "xaml.command_binding", "xaml", "hard")], "source string, target string, type string, rule_id string, rule_family string, rule_mode string")
    none = spark.createDataFrame([], "derived string, base string, kind string")
    return s, projects, fan_in, calls, none, uses


def test_what_is_kept_and_why(scene):
    d = isolation.cascade(*scene)
    kept = d.where("drop_reason is null").orderBy(F.desc("loc"), "fqn").collect()
    assert [r["loc"] for r in kept] == [50, 30, 20, 6, 4, 4]
    primary = {r["fqn"].split(".")[-1].split("(")[0]: (r["labels"] or [None])[0] for r in d.where("drop_reason is null").withColumn("labels", isolation.labels(F.col("rules"))).collect()}
    assert primary == {"PlainUtility": None, "OnLoaded": "xaml.codebehind_callback", "Render": "ui.render_callback", "Receive": "mvvm.message_recipient", "BindingPathPropertyChanged": "xaml.dependency_property_callback"}
    assert {r["fqn"]: r["drop_reason"] for r in d.collect()}["App.CustomFileUploaderService"] == "live_members"


def test_counters(scene):
    got = {(r["policy"], r["rule"]): r["n"] for r in isolation.rule_counters(isolation.cascade(*scene)).collect()}
    suppress = {"aspnet.startup_method": 1, "di.service_configuration": 1, "aspnet.middleware_invoke": 1, "aspnet.controller_action": 1, "aspnet.action_filter_callback": 1, "dotnet.explicit_interface_implementation": 2}
    label = {"xaml.codebehind_callback": 1, "ui.lifecycle_or_render_callback": 2, "ui.render_callback": 1, "mvvm.message_recipient": 2, "xaml.dependency_property_callback": 1}
    assert got == {("suppress", k): n for k, n in suppress.items()} | {("label", k): n for k, n in label.items()}


def test_soft_edges_cover_a_candidate(spark, scene):
    soft = spark.createDataFrame([("Loader", "App.PlainUtility", "ai_reflection"), ("Boot", "App.PlainUtility", "ai_reflection")], "source string, target string, type string")
    d = isolation.cascade(*scene, soft)
    assert {r["fqn"]: r["drop_reason"] for r in d.collect()}["App.PlainUtility"] == "soft_called"
    assert [tuple(r) for r in isolation.soft_suppressed(d, soft).collect()] == [("App.PlainUtility", "class", ["Boot", "Loader"], ["ai_reflection"], 2)]


def explained(scene):
    s, projects, fan_in, calls, none, uses = scene
    d = isolation.cascade(*scene).where("drop_reason is null")
    accesses = s.sparkSession.createDataFrame([], "accessor string, target string, access_kind string")
    found = isolation.signals(d, {"call": (calls, "caller", "callee"), "type_dependency": (uses, "source", "target"), "inheritance": (none, "derived", "base"), "field_access": (accesses, "accessor", "target")})
    types = graph.type_counts(graph.marked(calls, s)).select("node", "direction", F.lit("type").alias("attribute"), F.col("type").alias("value"), "n")
    maps = {"call": graph.rule_counts(calls), "type": graph.rule_counts(uses, "source", "target")}
    found = found.join(isolation.count_maps(maps["call"].union(types), "fqn", "call"), "fqn", "left").join(isolation.count_maps(maps["type"], "fqn", "type"), "fqn", "left")
    return d, maps, found


def test_signals_and_explanation(scene):
    _, _, found = explained(scene)
    row = isolation.explained(found).where("fqn = 'App.PlainUtility'").first()
    assert (row["callers"], row["callees"], row["used_types"], row["containing_type_users"]) == (0, 1, 1, 0)
    assert (row["call_out_rule_family"], row["call_out_rule_id"], row["call_out_rule_mode"]) == ({"di": 1}, {"di.service_configuration": 1}, {"hard": 1})
    assert (row["type_out_rule_family"], row["type_out_rule_id"], row["type_out_rule_mode"]) == ({"xaml": 1}, {"xaml.command_binding": 1}, {"hard": 1})
    assert row["why"] == "no callers; no type users; no derived types; framework context: outbound calls touch di; outbound type usage touch xaml"
    assert "symbol still calls 1 downstream method(s)" in row["facts"] and "outbound call rule ids: di.service_configuration=1" in row["facts"]
    near = isolation.explained(found.withColumn("near", F.array(F.lit("same kind"), F.lit("same file"))), "near").where("fqn = 'App.PlainUtility'").first()
    assert "nearest sibling looks like same kind, same file" in near["why"]


def test_report(scene, tmp_path):
    d, maps, found = explained(scene)
    out = isolation.explained(found).withColumn("labels", isolation.labels(F.col("rules"))).withColumn("category", F.lit("isolated")).withColumn("related", F.expr("cast(null as array<struct<rank:int,fqn:string,kind:string,score:double,reasons:array<string>>>)")).drop("rules", "drop_reason")
    summary = isolation.rule_summary(d, maps)
    assert {tuple(r) for r in summary.where("attribute = 'rule_family'").collect()} == {("call_outbound", "rule_family", "di", 1), ("type_outbound", "rule_family", "xaml", 1)}
    reports.write_isolation(str(tmp_path), out, isolation.rule_counters(isolation.cascade(*scene)), isolation.category_counts(out), summary)
    a, b = (json.loads((tmp_path / f"{n}.json").read_text()) for n in ("structural_isolation_candidates", "dead_code_candidates"))
    assert a == b and len(a["candidates"]) == 6 and a["candidates"][0]["fqn"] == "App.PlainUtility" and a["analysis_mode"] == "hard-only"
    assert a["suppressed_by_family"]["aspnet"] == 4 and a["labeled_by_rule"]["mvvm.message_recipient"] == 2 and a["rule_mode_summary"]["call_outbound"] == {"hard": 1}
    text = (tmp_path / "structural_isolation_candidates.md").read_text()
    assert "## Suppressed Convention Patterns" in text and "| 1 | `isolated` |" in text and text == (tmp_path / "dead_code_candidates.md").read_text()


def test_designer_files_are_user_interface(spark):
    df = spark.createDataFrame([("A", "C:\\r\\A.Designer.cs"), ("MyForm", None), ("B", "C:\\r\\B.cs")], "n string, p string")
    assert [r[0] for r in df.select(isolation.ui_type(F.col("n"), F.col("p"))).collect()] == [True, True, False]
