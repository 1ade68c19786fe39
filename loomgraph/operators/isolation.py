"""Structurally isolated symbols: convention rules, the cascade of reasons to drop, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import base_name, rendered
from loomgraph.operators.hotspots import any_of

#: Policy and priority of each convention rule (the family is what stands before the first dot).
RULES = {
    "synthetic.xaml": ("suppress", 5),
    "synthetic.lambda": ("suppress", 5),
    "synthetic.framework_method": ("suppress", 5),
    "dotnet.host_entry_type": ("suppress", 100),
    "dotnet.lifecycle_method": ("suppress", 80),
    "dotnet.explicit_interface_implementation": ("suppress", 85),
    "dotnet.extension_or_behavior_type": ("suppress", 60),
    "dotnet.host_builder_factory": ("suppress", 85),
    "xaml.codebehind_callback": ("label", 95),
    "xaml.partial_event_handler": ("label", 90),
    "xaml.dependency_property_callback": ("label", 100),
    "ui.lifecycle_or_render_callback": ("label", 70),
    "ui.render_callback": ("label", 75),
    "ui.event_handler_signature": ("label", 80),
    "ui.event_handler_name": ("label", 78),
    "ui.lifecycle_method": ("label", 72),
    "ui.value_converter": ("label", 88),
    "mvvm.message_recipient": ("label", 92),
    "mvvm.behavior_callback": ("label", 82),
    "mvvm.command_method": ("label", 86),
    "aspnet.convention_type": ("suppress", 70),
    "aspnet.middleware_invoke": ("suppress", 95),
    "aspnet.pipeline_extension": ("suppress", 75),
    "aspnet.startup_method": ("suppress", 100),
    "aspnet.action_filter_callback": ("suppress", 90),
    "aspnet.controller_action": ("suppress", 98),
    "aspnet.endpoint_mapping": ("suppress", 88),
    "di.module_type": ("suppress", 70),
    "di.module_load": ("suppress", 90),
    "di.service_configuration": ("suppress", 92),
    "serialization.converter_type": ("suppress", 70),
    "serialization.callback_method": ("label", 84),
}
#: Names and tokens that the rules look for.
LIFECYCLE_NAMES = (
    "onstartup", "oninitialize", "onactivated", "onapplytemplate", "onframeworkinitializationcompleted", "render", "drawitem", "ondrawitem", "onrender", "onupdate",
    "onpointerpressed", "onpointermoved", "onpointerreleased", "onkeydown", "onkeyup", "ontextinput", "onloaded", "onselectionchanged", "onviewmodelpropertychanged",
)
EVENT_TOKENS = (
    "_click(", "_load(", "_changed(", "_tick(", "_shown(", "_checkedchanged(", "_selectedindexchanged(", "_textchanged(", "_valuechanged(", "_formclosed(", "_formclosing(", "_resize(", "_paint(", "_dragdrop(",
    "_dragenter(", "_keydown(", "_keyup(", "_keypress(", "_dowork(", "_runworkercompleted(", "_progresschanged(", "_mouseup(", "_mousedown(", "_mousemove(", "_doubleclick(", "_afterselect(", "_cellcontentclick(", "_elapsed(",
)
UI_SUFFIXES = ("Form", "Control", "Dialog", "Window", "Page", "View", "Panel")
TEST_MARKERS = (".unittest.", ".tests.", ".test.", "unittest\\", "tests\\", "test\\", "\\integrationtests\\", "\\livetests\\", "\\browser.tests\\")


def _ends(c: Column, *suffixes: str) -> Column:
    return reduce(lambda a, b: a | b, [c.endswith(s) for s in suffixes])


def _first(*cases: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for cond, rule in reversed(cases):
        out = F.when(cond, rule).otherwise(out)
    return out


def ui_type(name: Column, file_path: Column | None = None) -> Column:
    """Named like a part of a user interface, or (with a path) from a designer's file."""
    last = F.substring_index(name, ".", -1)
    by_name = F.coalesce(_ends(last, *UI_SUFFIXES) | last.startswith("Form"), F.lit(False))
    if file_path is None:
        return by_name
    return by_name | F.coalesce(base_name(file_path).contains(".Designer."), F.lit(False))


def with_siblings(symbols: DataFrame, inheritance: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """`asked` (all symbols by default) with what the rules ask of a symbol's type: its receive methods, its bases, its
    command members."""
    low = F.lower("name")
    message = any_of(F.lower("fqn"), (".messages.", "message)", "message,"))
    of_type = symbols.where("containing_type is not null").groupBy("containing_type").agg(
        F.count(F.when((F.col("kind") == "method") & (low == "receive"), 1)).alias("receives"),
        F.max(F.when((F.col("kind") == "method") & (low == "receive"), message)).alias("some_message"),
    )
    bases = inheritance.groupBy(F.col("derived").alias("containing_type")).agg(F.max(F.lower("base").contains("irecipient")).alias("recipient"))
    commands = symbols.where(F.col("kind").isin("field", "property")).select("containing_type", low.alias("member")).distinct()
    commands = commands.select("containing_type", F.explode(F.array(F.when(F.col("member").endswith("_command"), F.expr("left(member, length(member) - 8)")), F.when(F.col("member").endswith("command"), F.expr("left(member, length(member) - 7)")))).alias("low")).where("low <> ''").distinct().withColumn("has_command", F.lit(True))
    return (symbols if asked is None else asked).withColumn("low", low).join(of_type, "containing_type", "left").join(bases, "containing_type", "left").join(commands, ["containing_type", "low"], "left")


def rule_array() -> Column:
    """The rules that hold for a row of `with_siblings`, by falling priority, then id."""
    name, low, fqn, path = F.col("name"), F.col("low"), F.lower("fqn"), F.lower(F.coalesce("file_path", F.lit("")))
    ct = F.lower(F.substring_index(F.coalesce("containing_type", F.lit("")), ".", -1))
    tail = F.substring_index(name, ".", -1)
    folder = lambda *x: any_of(path, tuple(f"\\{f}\\" for f in x))
    types = _first(
        (tail.isin("App", "Program", "Startup"), "dotnet.host_entry_type"),
        (_ends(tail, "Controller", "Middleware", "ActionFilter") & folder("controllers", "middleware", "filters"), "aspnet.convention_type"),
        (tail.endswith("Module"), "di.module_type"),
        (tail.endswith("Converter"), "serialization.converter_type"),
        (_ends(tail, "Behavior", "Extension", "Extensions", "ExtensionMethods"), "dotnet.extension_or_behavior_type"),
    )
    aspnet = _first(
        (low.isin("invoke", "invokeasync") & (ct.endswith("middleware") | folder("middleware")), "aspnet.middleware_invoke"),
        (low.startswith("use") & _ends(ct, "extensions", "middleware"), "aspnet.pipeline_extension"),
        (low.isin("configure", "configureservices") & (ct == "startup"), "aspnet.startup_method"),
        (low.isin("onactionexecuting", "onactionexecuted") & (ct.endswith("filter") | folder("controllers", "filters")), "aspnet.action_filter_callback"),
        (folder("controllers") & ct.endswith("controller") & (F.lower("accessibility") == "public"), "aspnet.controller_action"),
        (low.startswith("map") & (_ends(ct, "endpoint", "endpoints", "extensions") | folder("endpoints")), "aspnet.endpoint_mapping"),
        (low.startswith("create") & _ends(ct, "webserver", "host", "builder"), "dotnet.host_builder_factory"),
    )
    message = any_of(fqn, (".messages.", "message)", "message,"))
    recipient = (low == "receive") & (message | F.coalesce("recipient", F.lit(False)) | ((F.col("receives") >= 2) & F.col("some_message")))
    mvvm = _first(
        (F.coalesce(recipient, F.lit(False)), "mvvm.message_recipient"),
        (low.startswith("handle") & _ends(ct, "behavior", "adapter"), "mvvm.behavior_callback"),
        (ct.endswith("viewmodel") & F.coalesce("has_command", F.lit(False)), "mvvm.command_method"),
    )
    di = _first(((low == "load") & ct.endswith("module"), "di.module_load"), (low.isin("configure", "configureservices"), "di.service_configuration"))
    serial = _first((low.isin("convert", "convertback"), "ui.value_converter"), (_ends(ct, "converter", "contractresolver") & low.isin("readjson", "writejson", "canconvert", "createproperty", "createdictionarycontract", "createcontract"), "serialization.callback_method"))
    inside = F.expr("case when containing_type is not null and startswith(fqn, concat(containing_type, '.')) then contains(split_part(substr(fqn, length(containing_type) + 2), '(', 1), '.') else false end")
    signature = fqn.contains("(object,") & any_of(fqn, ("eventargs)", "eventargs,", "(object, system.windows.forms.", "(object, system.componentmodel."))
    code_behind = _ends(path, ".axaml.cs", ".xaml.cs")
    partial = (any_of(path, (".axaml.cs", ".xaml.cs", "\\views\\", "\\controls\\")) & name.startswith("On") & _ends(name, "Requested", "Changed", "Activated", "Selected") & F.col("containing_type").isNotNull())
    owner = ui_type(F.col("containing_type"))
    method = [
        F.when(F.col("low").isin("main", "mainasync", "dispose") | any_of(fqn, (".dispose(", ".wndproc(", ".initializecomponent(")), "dotnet.lifecycle_method"),
        F.when(low.isin(*LIFECYCLE_NAMES), "ui.lifecycle_or_render_callback"),
        F.when(low.isin("render", "drawitem", "onupdate") & _ends(ct, "renderer", "shape", "annotation", "control", "tool"), "ui.render_callback"),
        F.when(code_behind & name.startswith("On"), "xaml.codebehind_callback"),
        F.when(partial, "xaml.partial_event_handler"),
        F.when(low.endswith("propertychanged") & fqn.contains("(dependencyobject, dependencypropertychangedeventargs)"), "xaml.dependency_property_callback"),
        F.when(owner & signature, "ui.event_handler_signature"),
        F.when(owner & any_of(fqn, EVENT_TOKENS), "ui.event_handler_name"),
        F.when(any_of(fqn, (".onpaint(", ".onload(", ".onshown(", ".onclosing(", ".onclosed(")), "ui.lifecycle_method"),
        mvvm, aspnet, di, serial,
        F.when(inside, "dotnet.explicit_interface_implementation"),
    ]
    kind = F.col("kind")
    found = F.when(kind.isin("xaml", "lambda", "framework_method"), F.array(F.concat(F.lit("synthetic."), kind))).when(kind.isin("class", "interface"), F.array(types)).when(kind == "method", F.array(*method)).otherwise(F.array().cast("array<string>"))
    order = [r for r, _ in sorted(RULES.items(), key=lambda x: (-x[1][1], x[0]))]
    present = F.array_distinct(F.array_compact(found))
    return F.filter(F.array(*map(F.lit, order)), lambda r: F.array_contains(present, r))


def suppressed(rules: Column) -> Column:
    return F.arrays_overlap(rules, F.array(*[F.lit(r) for r, (p, _) in RULES.items() if p == "suppress"]))


def cascade(symbols: DataFrame, projects: DataFrame, fan_in: DataFrame, calls: DataFrame, inheritance: DataFrame, uses: DataFrame, soft: DataFrame | None = None) -> DataFrame:
    """Symbols with no fan-in, their rules, and why each is dropped (null: it is a candidate).

    The reasons are tried in a fixed order; a suppressing rule comes first, so that rules can be counted over the rows
    that are dropped later.  Every test is a left join on the symbol's name or its type's, all in one projection.
    """
    counted = fan_in.select("fqn", "fan_in")
    alive = counted.where("fan_in > 0").select("fqn").union(calls.select("callee"))
    live = symbols.where("containing_type is not null").select("fqn", "containing_type").join(alive, "fqn", "left_semi")
    # what edges tell of a name, in one grouped pass and one join
    told = [(calls, "callee", "called"), (uses, "target", "used"), (live, "containing_type", "has_live"), (inheritance, "base", "has_derived"), *([(soft, "target", "soft")] if soft is not None else [])]
    each = reduce(DataFrame.union, [df.select(F.col(key).alias("fqn"), F.lit(name).alias("mark")) for df, key, name in told])
    marks = each.groupBy("fqn").agg(*[F.max(F.col("mark") == name).alias(name) for name in ("called", "used", "has_live", "has_derived", "soft")])
    bare = symbols.join(counted.where("fan_in = 0"), "fqn", "left_semi")
    s = with_siblings(symbols, inheritance, bare).withColumn("rules", rule_array())
    s = s.join(projects.select(F.col("id").alias("project_id"), "is_test_project"), "project_id", "left").join(marks, "fqn", "left")
    s = s.join(uses.select(F.col("target").alias("containing_type"), F.lit(True).alias("type_used")).distinct(), "containing_type", "left")
    test = F.coalesce("is_test_project", F.lit(False)) | any_of(F.lower(F.concat_ws(" ", "fqn", "file_path")), TEST_MARKERS)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    is_type = F.col("kind").isin("class", "interface")
    reason = (
        F.when(suppressed(F.col("rules")), "suppressed_by_rule").when(test, "test_artifact").when(yes("called"), "called").when(yes("soft"), "soft_called").when(yes("used"), "used_as_type")
        .when((F.col("kind") == "constructor") & (ui_type(F.col("containing_type")) | yes("type_used")), "constructor_of_used_type")
        .when(is_type & yes("has_live"), "live_members").when(is_type & yes("has_derived"), "has_derived").when(is_type & ui_type(F.col("name"), F.col("file_path")), "ui_type")
        .when(F.lower("fqn").contains("main("), "entry_point")
        .when((F.col("kind") == "method") & (_ends(F.col("fqn"), ".get", ".set") | F.col("name").isin("get", "set", "add", "remove")), "accessor")
    )
    return s.select("fqn", "kind", F.coalesce("loc", F.lit(0)).alias("loc"), "file_path", "containing_type", "rules", reason.alias("drop_reason"))


def labels(rules: Column) -> Column:
    """The rules that do not suppress, the weightiest first."""
    return F.filter(rules, lambda r: r.isin(*[r for r, (p, _) in RULES.items() if p == "label"]))


def soft_suppressed(decided: DataFrame, soft: DataFrame) -> DataFrame:
    """(fqn, kind, sources, edge_types, edge_count) of the symbols that only a soft edge reaches: up to eight sources and
    types, sorted."""
    some = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, 8)
    into = soft.groupBy(F.col("target").alias("fqn")).agg(some("source").alias("sources"), some("type").alias("edge_types"), F.count("*").alias("edge_count"))
    return decided.where("drop_reason = 'soft_called'").join(into, "fqn").select("fqn", "kind", "sources", "edge_types", "edge_count")


#: The counts that tell how far a symbol is connected (graph, direction).
SIGNALS = {
    "callers": ("call", "in"), "type_users": ("type_dependency", "in"), "field_users": ("field_access", "in"), "derived_types": ("inheritance", "in"),
    "callees": ("call", "out"), "used_types": ("type_dependency", "out"), "used_fields": ("field_access", "out"),
}


def signals(candidates: DataFrame, graphs: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """`candidates` (fqn, containing_type, ...) with one column for each of SIGNALS and containing_type_users.

    `graphs` has for each name a simple digraph and its end columns; all graphs' degrees are one grouped pass.
    """
    ends = []
    for name, (edges, source, target) in graphs.items():
        for node, direction in ((target, "in"), (source, "out")):
            column = next((s for s, at in SIGNALS.items() if at == (name, direction)), None)
            if column:
                ends.append(edges.select(F.col(node).alias("node"), F.lit(column).alias("signal")))
    counted = reduce(DataFrame.union, ends).groupBy("node", "signal").agg(F.count("*").alias("n"))
    wide = counted.groupBy("node").agg(*[F.coalesce(F.sum(F.when(F.col("signal") == s, F.col("n"))), F.lit(0)).alias(s) for s in SIGNALS])
    out = candidates.join(wide.withColumnRenamed("node", "fqn"), "fqn", "left").join(wide.select(F.col("node").alias("containing_type"), F.col("type_users").alias("containing_type_users")), "containing_type", "left")
    return out.fillna(0, [*SIGNALS, "containing_type_users"])


def rule_summary(candidates: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """(bucket, attribute, value, n): how often the candidates' edges carry each rule field; `counts` has the
    `graph.rule_counts` of the call and the type graph under "call" and "type"."""
    each = [n.join(candidates.select(F.col("fqn").alias("node")), "node", "left_semi").withColumn("bucket", F.concat(F.lit(f"{name}_"), F.col("direction"), F.lit("bound"))) for name, n in counts.items()]
    return reduce(DataFrame.union, each).groupBy("bucket", "attribute", "value").agg(F.sum("n").alias("n"))


CATEGORIES = ("isolated", "structural-sibling", "near-family")


def category(score: Column, reasons: Column) -> Column:
    """What the likest symbol makes of a candidate (null score: none is near)."""
    some = lambda *starts: F.exists(reasons, lambda r: reduce(lambda a, b: a | b, [r.startswith(s) for s in starts]))
    near = F.arrays_overlap(reasons, F.array(F.lit("same containing type"), F.lit("same namespace")))
    overlap = some("shared callers", "shared callees", "shared used types", "shared used fields")
    return F.when(score.isNull(), "isolated").when((score >= 0.7) & near & some("name tokens "), "near-family").when((score >= 0.55) & (overlap | near), "structural-sibling").otherwise("isolated")


def category_counts(categorised: DataFrame) -> DataFrame:
    """(category, n) for every category, 0 where no candidate has it."""
    every = categorised.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return every.join(categorised.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def prioritised(categorised: DataFrame) -> DataFrame:
    """By category (isolated first), then the longest, then by name."""
    return categorised.orderBy(F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")), F.desc("loc"), "fqn")


def count_maps(counts: DataFrame, key: str, prefix: str) -> DataFrame:
    """One row a node with map columns <prefix>_<direction>_<attribute> from rows (node, direction, attribute, value, n)."""
    cells = counts.groupBy("node").agg(*[
        F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when((F.col("direction") == d) & (F.col("attribute") == a), F.struct("value", "n"))), lambda e: e.isNotNull()))).alias(f"{prefix}_{d}_{a}")
        for d in ("in", "out") for a in ("type", "rule_family", "rule_id", "rule_mode")
    ])
    return cells.withColumnRenamed("node", key)


def explained(candidates: DataFrame, nearest_reasons: str | None = None) -> DataFrame:
    """`candidates` (of `signals`, with `count_maps` of the call and the type graph under call_* and type_*) with `why`
    and the list `facts`: which references are missing, what is still connected, and which frameworks touch it."""
    zero = lambda c: F.col(c) == 0
    kind = F.col("kind")
    member, is_type, made = kind.isin("field", "property"), kind.isin("class", "interface"), kind == "constructor"
    missing = [
        (zero("callers"), "no callers", "call graph has no inbound callers"),
        (zero("type_users"), "no type users", "type dependency graph has no inbound type users"),
        (zero("field_users") & member, "no field readers/writers", "field access graph shows no inbound readers or writers"),
        (zero("derived_types") & is_type, "no derived types", "inheritance graph has no derived types"),
        (zero("containing_type_users") & made, "owning type has no detected type users", "constructor's owning type has no inbound type users"),
    ]
    short = F.array_compact(F.array(*[F.when(c, s) for c, s, _ in missing]))
    has = lambda c: F.size(F.coalesce(c, F.map_from_entries(F.array().cast("array<struct<k:string,v:bigint>>")))) > 0
    listed = [(f"{g}_{d}_{a}", f"{w} {g} {t}") for g, d, w, a, t in (
        ("call", "in", "inbound", "type", "edge types"), ("call", "out", "outbound", "type", "edge types"), ("call", "in", "inbound", "rule_family", "rule families"), ("call", "out", "outbound", "rule_family", "rule families"),
        ("call", "out", "outbound", "rule_id", "rule ids"), ("call", "out", "outbound", "rule_mode", "rule modes"), ("type", "in", "inbound", "rule_family", "rule families"), ("type", "out", "outbound", "rule_family", "rule families"),
        ("type", "out", "outbound", "rule_id", "rule ids"), ("type", "out", "outbound", "rule_mode", "rule modes"),
    )]
    touched = [(f"{g}_{d}_rule_family", t) for g, d, t in (("call", "in", "inbound calls"), ("call", "out", "outbound calls"), ("type", "in", "inbound type usage"), ("type", "out", "outbound type usage"))]
    touches = F.array_compact(F.array(*[F.when(has(c), F.concat(F.lit(f"{t} touch "), F.array_join(F.array_sort(F.map_keys(c)), ", "))) for c, t in touched]))
    out = candidates.withColumn("__short", short).withColumn("__touch", F.array_join(touches, "; "))
    bare = F.size("__short") == 0
    near = F.lit(None).cast("array<string>") if nearest_reasons is None else F.col(nearest_reasons)
    two = F.array_join(F.slice(near, 1, 2), ", ")
    facts = F.array_compact(F.array(
        *[F.when(c, t) for c, _, t in missing],
        F.when(F.col("callees") > 0, F.format_string("symbol still calls %d downstream method(s)", "callees")),
        F.when(F.col("used_types") > 0, F.format_string("symbol still depends on %d downstream type(s)", "used_types")),
        *[F.when(has(c), F.concat(F.lit(f"{t}: "), rendered(c))) for c, t in listed],
        F.when(F.col("__touch") != "", F.concat(F.lit("framework context: "), F.col("__touch"))),
        F.when(bare, "all checked structural graphs lacked inbound references"),
        F.when(near.isNotNull() & (two != ""), F.concat(F.lit("nearest related symbol suggests family resemblance: "), two)).when(near.isNotNull(), "related-symbol search found a nearby structural sibling"),
    ))
    why = F.concat_ws("; ", F.when(bare, "no inbound structural references").otherwise(F.array_join("__short", "; ")), F.when(near.isNotNull() & (two != ""), F.concat(F.lit("nearest sibling looks like "), two)).when(near.isNotNull(), "has nearby structural sibling"), F.when(F.col("__touch") != "", F.concat(F.lit("framework context: "), F.col("__touch"))))
    return out.withColumn("why", why).withColumn("facts", facts).drop("__short", "__touch")


def rule_counters(decided: DataFrame) -> DataFrame:
    """(policy, rule, family, n): suppressing rules over suppressed rows, labels over the rows that are not."""
    each = decided.select((F.coalesce(F.col("drop_reason") == "suppressed_by_rule", F.lit(False))).alias("gone"), F.explode("rules").alias("rule"))
    policy = F.when(F.col("rule").isin(*[r for r, (p, _) in RULES.items() if p == "suppress"]), "suppress").otherwise("label")
    counted = each.withColumn("policy", policy).where(F.col("gone") == (F.col("policy") == "suppress"))
    return counted.groupBy("policy", "rule").agg(F.count("*").alias("n")).withColumn("family", F.substring_index("rule", ".", 1))
