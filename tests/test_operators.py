"""Operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import dsl, graph, hotspots, isolation, navigate, similarity, soft_edges


CALL = "caller string, callee string, call_type string, rule_id string, rule_family string, rule_mode string, call_count long"


def test_parallel_edges_collapse_and_weights(spark):
    calls = spark.createDataFrame([("a", "b", "calls", None, None, None, 1), ("a", "b", "lifecycle_entrypoint", "r", "f", "hard", 1), ("framework::x", "b", "delegate_reference", None, None, None, 2), ("b", "b", "calls", None, " ", None, 1)], CALL)
    edges = graph.simple_digraph(calls)
    assert edges.count() == 3
    assert {r["node"]: (r["in_degree"], r["out_degree"]) for r in graph.degrees(edges).collect()}["b"] == (3, 1)
    marked = graph.marked(edges, spark.createDataFrame([("b", "method")], "fqn string, kind string"))
    weights = {r["node"]: (r["weighted_in"], r["weighted_out"]) for r in graph.weighted_degrees(marked).collect()}
    assert weights["b"] == (pytest.approx(0.35 + 0.15 + 1.0), 1.0) and weights["a"] == (0.0, 0.35)
    assert ("b", "in", "delegate_reference:framework_source", 1) in [tuple(r) for r in graph.type_counts(marked).collect()]
    assert ("b", "in", "rule_mode", "hard", 1) in [tuple(r) for r in graph.rule_counts(edges).collect()]


def test_framework_ends_weigh_less(spark):
    calls = spark.createDataFrame([("framework::x", "m", "calls", None, None, None, 1), ("lib", "m", "calls", None, None, None, 1), ("page", "m", "calls", None, None, None, 1), ("n", "m", "calls", None, None, None, 1)], CALL)
    nodes = spark.createDataFrame([("lib", "framework_method"), ("page", "xaml"), ("n", "method"), ("m", "method")], "fqn string, kind string")
    marked = graph.marked(calls, nodes)
    assert {r["node"]: r["weighted_in"] for r in graph.weighted_degrees(marked).collect()}["m"] == pytest.approx(3 * 0.35 + 1)
    assert ("m", "in", "calls:framework_source", 3) in [tuple(r) for r in graph.type_counts(marked).collect()]


def test_walk_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "caller string, callee string")
    got = {tuple(r) for r in graph.expand(edges, spark.createDataFrame([("a",)], "fqn string"), 5).collect()}
    assert got == {("a", n, d) for n in "bc" for d in ("callers", "callees")}


def test_surroundings_in_words(spark):
    calls = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "A"), ("E", "D")], "caller string, callee string")
    roots = spark.createDataFrame([("A",)], "fqn string")
    assert {r["context"] for r in graph.context({"call": (calls, "caller", "callee")}, roots, 2).collect()} == {"Calls: B", "Calls: C", "Called by: D", "Called by: E"}
    types = spark.createDataFrame([("User", "TypeA"), ("TypeA", "TypeB")], "source string, target string")
    got = graph.context({"type_dependency": (types, "source", "target")}, spark.createDataFrame([("TypeA",)], "fqn string"), 1)
    assert {r["context"] for r in got.collect()} == {"Used as type by: User", "Uses type: TypeB"}


def test_dispatch_fallback_and_lambdas(spark):
    methods = spark.createDataFrame([("T.f(a)", "f", "T", 1), ("T.f(a, b)", "f", "T", 2), ("T.g()", "g", "T", 0)], "fqn string, name string, containing_type string, parameter_count long")
    asked = spark.createDataFrame([("x", "T", "f", 1), ("y", "T", "f", 7), ("z", " ", "f", 1), ("w", "T", "none", 0)], "caller string, containing_type string, method_name string, argument_count long")
    assert {(r["caller"], r["callee"]) for r in graph.fallback_targets(asked, methods).collect()} == {("x", "T.f(a)"), ("y", "T.f(a)"), ("y", "T.f(a, b)")}
    calls = spark.createDataFrame([("l", "T.g()", "calls", "r", None, None, 3), ("l", "T.f(a)", "event_subscribe", None, None, None, 1)], CALL)
    made = graph.promote_lambdas(calls, spark.createDataFrame([("l", "T.outer()")], "fqn string, enclosing string")).where("caller = 'T.outer()'").collect()
    assert {(r["callee"], r["call_type"], r["call_count"], r["rule_id"]) for r in made} == {("T.g()", "lambda_dispatch", 3, None), ("T.f(a)", "event_subscribe", 1, None)}
    edges, new = graph.override_edges(spark.createDataFrame([("Base.Lib.Run(x)", "T.g()"), ("T.f(a)", "T.g()")], "base string, override string"), methods)
    assert [tuple(r) for r in new.select("fqn", "name", "kind", "containing_type").collect()] == [("Base.Lib.Run(x)", "Run", "framework_method", "Base.Lib")] and edges.count() == 2


def test_type_uses_that_count(spark):
    uses = spark.createDataFrame([("m", "Repo<Item, System.Int32>"), ("m", "object"), ("m", "System.Text.StringBuilder")], "source string, target string")
    assert {r["target"] for r in graph.kept_type_uses(uses).collect()} == {"Repo", "Item"}


def test_fold_keeps_nulls_of_single_arrivals(spark):
    rows = [("x", "n", None, None, "p", 1, 2, 5, None, False, 1), ("y", "n", None, "int", "p", 4, 9, 5, None, False, 1), ("y", "m", "N", None, "q", 2, 3, 6, 2, True, 2)]
    df = spark.createDataFrame(rows, "fqn string, name string, namespace string, return_type string, project_id string, line_start long, line_end long, loc long, parameter_count long, is_async boolean, ordinal long")
    got = {r["fqn"]: r for r in graph.fold_symbols(df).collect()}
    assert got["x"]["parameter_count"] is None
    y = got["y"]
    assert (y["name"], y["namespace"], y["return_type"], y["line_start"], y["line_end"], y["loc"], y["parameter_count"], y["is_async"]) == ("m", "N", "int", 2, 9, 11, 2, True)


@pytest.mark.parametrize(
    "op,value,expected",
    [
        ("exists", None, {"null": True, "text": True, "missing": False}),
        ("eq", "v", {"null": False, "text": True, "missing": False}),
        ("neq", "v", {"null": True, "text": False, "missing": False}),
        ("neq", None, {"null": True, "text": True, "missing": False}),
        ("eq", None, {"null": False, "text": False, "missing": False}),
        ("in", ["u", "v"], {"null": False, "text": True, "missing": False}),
        ("neq", "$unknown", {"null": False, "text": False, "missing": False}),
        ("regex", "^v$", {"null": False, "text": True, "missing": False}),
    ],
)
def test_conditions_tell_missing_from_null(spark, op, value, expected):
    df = spark.createDataFrame([("null", {"k": None}), ("text", {"k": "v"}), ("missing", {"other": "v"})], "n string, rec map<string,string>")
    got = df.select("n", dsl.condition(dsl.Condition("k", op, value), F.col("rec"), {}).alias("c")).collect()
    assert {r["n"]: r["c"] for r in got} == expected


def test_rules_are_validated():
    with pytest.raises(dsl.RuleError):
        dsl.parse("{}")
    good = '{"Id": "r", "scope": {"source": "s", "target": "t"}, "match": {"where": [{"field": "a", "op": "OP", "value": "x"}]}, "resolve": {"target": {"where": []}}, "emit": {"edge_kind": "candidate_call", "rule_id": "r", "rule_family": "f", "rule_mode": "candidate"}}'
    assert dsl.parse("﻿" + good.replace("OP", "eq")).id == "r"
    with pytest.raises(dsl.RuleError):
        dsl.parse(good.replace("OP", "near"))
    for old, new, why in (('"rule_mode": "candidate"', '"rule_mode": "hard"', "only candidates"), ('"op": "eq"', '"op": "has_base_type"', "reserved"), ('"rule_family": "f", ', "", "rule_family"), ('"candidate_call"', '"call"', "edge kind"), ('"field": "a"', '"field": " "', "without a field"), ('"op": "eq", "value": "x"', '"op": "regex", "value": "("', "pattern")):
        with pytest.raises(dsl.RuleError, match=why):
            dsl.parse(good.replace("OP", "eq").replace(old, new))


RULE = '{"id": "r", "scope": {"source": "a", "target": "b"}, "match": {"where": []}, "bind": {"x": "$v", "y": "text"}, "resolve": {"target": {"where": [{"field": "n", "op": "OP", "value": "$x"}]}}, "emit": {"edge_kind": "candidate_call", "rule_id": "r", "rule_family": "f", "rule_mode": "candidate"}}'


@pytest.mark.parametrize("op,found", [("eq", {"t1"}), ("suffix", {"t1", "t2"}), ("prefix", {"t1", "t3"}), ("contains", {"t1", "t2", "t3", "t4"}), ("regex", {"t1", "t2", "t3", "t4"})])
def test_variables_become_keys_and_lose_nothing(spark, op, found):
    rows = [("a", {"fqn": "s", "v": "Load"}), ("a", {"fqn": "unbound"}), ("a", {"fqn": "null", "v": None}), ("b", {"fqn": "t1", "n": "Load"}), ("b", {"fqn": "t2", "n": "PreLoad"}), ("b", {"fqn": "t3", "n": "Loader"}), ("b", {"fqn": "t4", "n": "xLoadx"}), ("b", {"fqn": "t5", "n": "x"}), ("c", {"fqn": "t6", "n": "Load"}), ("b", {"fqn": "t7"})]
    records = spark.createDataFrame(rows, "source_type string, rec map<string,string>")
    rule = dsl.parse(RULE.replace("OP", op))
    assert {(r["source_fqn"], r["target_fqn"]) for r in dsl.run(rule, records).collect()} == {("s", t) for t in found}
    assert dsl.keyed(rule) == (op != "regex")
    bound = {(r["source_fqn"], r["name"], r["value"]) for r in dsl.bindings(rule, records).collect()}
    assert bound == {("s", "x", "Load"), ("null", "x", None), ("s", "y", "text"), ("unbound", "y", "text"), ("null", "y", "text")}


def test_missing_ends_are_diagnosed(spark):
    records = spark.createDataFrame([("a", {"v": "k"}), ("a", {"fqn": "s", "v": "k"}), ("b", {"fqn": "t", "n": "k"}), ("b", {"n": "k"})], "source_type string, rec map<string,string>")
    edges, wrong = dsl.emitted([dsl.parse(RULE.replace("OP", "eq"))], records)
    assert [(r["source_fqn"], r["target_fqn"], r["type"], r["rule_mode"]) for r in edges.collect()] == [("s", "t", "calls", "candidate")]
    assert sorted(r["diagnostic"] for r in wrong.collect()) == ["missing_source_fqn", "missing_source_fqn", "missing_target_fqn"]


def test_rules_of_a_folder(tmp_path):
    (tmp_path / "good.json").write_text("\ufeff" + RULE.replace("OP", "eq"), encoding="utf-8")
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    rules, wrong = dsl.load_rules(str(tmp_path))
    assert [r.id for r in rules] == ["r"] and list(wrong) == ["bad.json"]
    assert dsl.load_rules(str(tmp_path / "none")) == ([], {}) and dsl.in_scope(rules) == []


def test_shared_state_needs_two_writers(spark):
    a = spark.createDataFrame([("A.x", "S.v", "write", True, 1), ("B.y_click(", "S.v", "read_write", True, 1), ("C", "Other", "write", True, 1), ("A.x", "S.w", "write", False, 1)], "accessor string, target string, access_kind string, is_external boolean, ordinal long")
    s = spark.createDataFrame([("S.v", "property", "p"), ("S.w", "field", "p")], "fqn string, kind string, project_id string")
    r = hotspots.shared_state(a, s).collect()
    assert [(x["target"], x["writers"], x["risk"], x["spread"]) for x in r] == [("S.v", 2, 13.0, "external")]
    assert {x["target"]: x["spread"] for x in hotspots.shared_state(a, s, least_writers=0).collect()} == {"S.v": "external", "S.w": "none"}
    named = hotspots.shared_state(a, s, names=True).first()
    assert (named["event_names"], named["runtime_names"], named["external"]) == (["B.y_click("], ["A.x"], 2)
    tests = spark.createDataFrame([("p", True)], "id string, is_test_project boolean")
    assert hotspots.shared_state(a, s, tests).count() == 0


SYMBOL = "fqn string, name string, kind string, containing_type string, namespace string, project_id string, file_path string, loc long, parameter_count long, return_type string, is_async boolean, line_start long, has_ui_dispatch boolean, has_task_spawn boolean, has_background_worker boolean, has_do_events boolean, has_thread_start boolean, has_blocking_wait boolean"


def test_hotspot_scores(spark):
    method = lambda name, loc, ui: (f"App.Editor.{name}()", name, "method", "App.Editor", "App", "p-ui", None, loc, 0, None, ui, 1, ui, False, False, False, False, ui)
    plain = lambda fqn, name, kind, project, loc: (fqn, name, kind, None, "App", project, None, loc, 0, None, False, 1, *[False] * 6)
    s = spark.createDataFrame([plain("App.Editor", "Editor", "class", "p-ui", 2000), method("Load", 30, True), method("Save", 20, False), plain("App.State.Value", "Value", "property", "p-core", 5)], SYMBOL)
    projects = spark.createDataFrame([("p-core", "Core", False), ("p-ui", "UI", False)], "id string, name string, is_test_project boolean")
    calls = spark.createDataFrame([("App.Editor.Load()", "App.Editor.Save()", "calls", None, None, None, 1), ("framework::ui.lifecycle.OnLoaded", "App.Editor.Load()", "lifecycle_entrypoint", None, None, None, 1)], CALL)
    refs = spark.createDataFrame([("p-ui", "p-core")], "source string, target string")
    got = {r["fqn"]: r for r in hotspots.hotspots(s, projects, graph.marked(calls, s), graph.coupling(refs, projects)).collect()}
    assert {k: r["score"] for k, r in got.items()} == {"App.Editor.Load()": 0.5405, "App.Editor.Save()": 0.402, "App.Editor": 0.35, "App.State.Value": 0.1505}
    assert (got["App.Editor"]["fan_in"], got["App.Editor"]["effective_fan_in"], got["App.Editor"]["danger_score"], got["App.Editor"]["coupling"]) == (2, 0, 4000, 1)
    assert got["App.Editor.Load()"]["is_hazard"] and got["App.Editor.Load()"]["effective_fan_in"] == 0.35
    scored = hotspots.hotspots(s, projects, graph.marked(calls, s), graph.coupling(refs, projects))
    assert [tuple(r) for r in hotspots.anti_patterns(scored).collect()] == [("App.Editor", "high fan-in x LOC")]


def test_convention_rules(spark):
    cols = "fqn string, name string, kind string, containing_type string, accessibility string, file_path string"
    rows = [
        ("App.W.Render()", "Render", "method", "App.WidgetRenderer", "public", None),
        ("App.V.OnLoaded(object, RoutedEventArgs)", "OnLoaded", "method", "App.EditorView", "private", "C:\\repo\\Views\\EditorView.axaml.cs"),
        ("App.Startup.Configure(x)", "Configure", "method", "App.Startup", "public", None),
        ("App.T.I.Do(x)", "Do", "method", "App.T", "public", None),
        ("App.ViewModel.Save()", "Save", "method", "App.ViewModel", "public", None),
        ("App.ViewModel.SaveCommand", "SaveCommand", "property", "App.ViewModel", "public", None),
        ("l", "l", "lambda", None, None, None),
    ]
    s = spark.createDataFrame(rows, cols)
    none = spark.createDataFrame([], "derived string, base string")
    got = {r["name"]: r["rules"] for r in isolation.with_siblings(s, none).withColumn("rules", isolation.rule_array()).collect()}
    assert got["Render"] == ["ui.render_callback", "ui.lifecycle_or_render_callback"]
    assert got["OnLoaded"] == ["xaml.codebehind_callback", "ui.event_handler_signature", "ui.lifecycle_or_render_callback"]
    assert got["Configure"] == ["aspnet.startup_method", "di.service_configuration"]
    assert got["Do"] == ["dotnet.explicit_interface_implementation"]
    assert got["Save"] == ["mvvm.command_method"] and got["SaveCommand"] == [] and got["l"] == ["synthetic.lambda"]


def test_soft_edges_right_wins(spark):
    cols = "source string, target string, type string, confidence double, ordinal long"
    have, new = spark.createDataFrame([("a", "b", "t", 0.9, 9)], cols), spark.createDataFrame([("a", "b", "t", 0.1, 1), ("c", "d", "t", None, 2)], cols)
    assert sorted((r["source"], r["confidence"]) for r in soft_edges.merge(have, new).collect()) == [("a", 0.1), ("c", None)]
    bad = soft_edges.normalize(spark.createDataFrame([(" ", "b", None, 2.0, 1), ("a", "\tb\n", None, 2.0, 1)], cols)).collect()
    assert [r["error"] for r in bad] == ["missing endpoint", "confidence out of range"] and (bad[1]["type"], bad[1]["target"]) == ("ai_soft_edge", "b")


def test_soft_edge_quality(spark):
    rows = [("S1", "T1", "A", "0.9", ["e"], 1), ("S1", "T1", "A", "0.4", ["e"], 2), ("", "T2", "B", None, [], 3), ("S3", "", "B", "no number", ["e"], 4)]
    df = spark.createDataFrame(rows, "source string, target string, type string, confidence string, evidence array<string>, ordinal long")
    got = {r["type"]: r for r in soft_edges.quality(df).collect()}
    assert (got["A"]["n"], got["A"]["repeated"], got["A"]["low_confidence"], got["A"]["least"], got["A"]["greatest"]) == (2, 1, 1, 0.4, 0.9)
    assert (got["B"]["no_confidence"], got["B"]["no_evidence"], got["B"]["no_source"], got["B"]["no_target"]) == (2, 1, 1, 1)
    said = [r["warning"] for r in soft_edges.warnings(df).orderBy("ordinal", "place").collect()]
    assert said == ["Duplicate edge: S1 -> T1 (A)", "Low confidence (0.4) for: S1 -> T1", "Confidence missing for:  -> T2", "Evidence empty for:  -> T2"]


def test_tokens_and_patterns(spark):
    df = spark.createDataFrame([("App.ListUtils.tryGetLast_x",)], "n string")
    assert sorted(df.select(similarity.name_tokens(F.col("n"))).first()[0]) == ["app", "get", "last", "list", "try", "utils", "x"]
    p = spark.createDataFrame([("C:\\r\\obj\\A.cs",), ("C:\\r\\A.g.cs",), ("C:\\r\\gen\\deep\\A.cs",), ("C:\\r\\B.cs",)], "path string")
    got = {r["path"][-8:]: r["excluded"] for r in navigate.excluded(p, ["obj"], "*.g.cs", "gen/**/A.cs").collect()}
    assert list(got.values()) == [True, True, True, False]


def test_user_text_may_hold_wildcards(spark):
    df = spark.createDataFrame([("a_b\\c",), ("axb",), ("A_B",)], "n string")
    held = lambda text: {r["n"] for r in df.where(navigate.holds("n", text)).collect()}
    assert held("a_b") == {"a_b\\c", "axb", "A_B"} and held("\\c") == {"a_b\\c"} and held("x%") == {"axb"} and held(None) == held("") == {"a_b\\c", "axb", "A_B"}


def test_snippets(spark):
    text = "\n\n" + "\n".join(f"line {i}" for i in range(3, 20)) + "\n \n"
    df = spark.createDataFrame([(1, text, 5), (2, "only\nthis", 9), (3, "", 1), (4, "   \n ", 1)], "doc_id long, text string, at long")
    got = {r["doc_id"]: (r["line_start"], r["line_end"], r["snippet"]) for r in navigate.snippets(df, "line 5", context=4).collect()}
    assert got[1] == (3, 9, "\n".join(f"line {i}" for i in range(3, 10))) and got[2] == (1, 2, "only\nthis") and set(got) == {1, 2}
    by_line = {r["doc_id"]: (r["line_start"], r["line_end"]) for r in navigate.snippets(df, line="at", context=1).collect()}
    assert by_line == {1: (4, 6), 2: (1, 2)}


@pytest.mark.parametrize("name,owner,start,line", [("b", None, 2, 2), ("x", None, 3, 4), (".ctor", "N.Top", 1, 1), ("get_y", None, 1, 5), ("none", None, 1, None)])
def test_focal_snippets(spark, name, owner, start, line):
    df = spark.createDataFrame([("Top x\nb\nc\nx\ny", name, owner, start)], "text string, name string, containing_type string, line_start long")
    got = navigate.focal_snippets(df, context=0).collect()
    assert [r["line_start"] for r in got] == ([line] if line else [])


def test_summary(spark):
    s = spark.createDataFrame([("method", "Demo.Widget.Render()", "public", 12, 1, "System.Void", True, True, False), ("class", "Lone", None, None, None, None, False, False, False)], "kind string, fqn string, accessibility string, loc long, parameter_count long, return_type string, is_async boolean, is_static boolean, is_abstract boolean")
    calls = spark.createDataFrame([("Demo.Run()", "Demo.Widget.Render()"), ("Demo.Widget.Render()", "A.Initialize()"), ("Demo.Widget.Render()", "B.Draw()")], "caller string, callee string")
    up = spark.createDataFrame([("Demo.Widget.Render()", "Demo.BaseWidget"), ("Demo.DerivedWidget", "Demo.Widget.Render()")], "derived string, base string")
    got = {r["fqn"]: r["summary"] for r in navigate.summaries(s, calls, up).collect()}
    assert got["Demo.Widget.Render()"].split("\n") == ["method Demo.Widget.Render() [public]  [async static]", "LOC:12 | params:1 | returns:System.Void", "fan_in:1 | fan_out:2", "called_by: Run()", "calls: Initialize(), Draw()", "inherits: BaseWidget", "inherited_by: DerivedWidget"]
    assert got["Lone"] == "class Lone"
