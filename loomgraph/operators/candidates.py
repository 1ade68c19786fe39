"""Places where the graph is likely to lack edges: markup, reflection, and dependency injection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import navigate

#: Texts that tell of reflection and of dependency injection, in the order in which they are reported.
MARKERS = {
    "reflection": ("Activator.CreateInstance", ".GetTypes(", ".GetExportedTypes(", ".GetConstructor(", ".Invoke(", ".IsAssignableFrom(", "Assembly.Load(", "Assembly.LoadFrom("),
    "di": ("GetRequiredService<", "GetService<", ".Resolve<", "AddSingleton", "AddScoped", "AddTransient", "RegisterType<", "RegisterAssemblyModules", ".As<", "IServiceCollection", "ContainerBuilder"),
}
#: Edge types that show a dispatch was recovered, words in names that make a symbol worth a look, and the
#: types that are proposed for suggested edges.
DISPATCH_TYPES = {"reflection": ("reflection_constructor_dispatch",), "di": ("service_provider_dispatch", "autofac_resolve_dispatch", "autofac_module_load")}
TYPE_HINTS = {
    "reflection": ("loader", "factory", "provider", "module", "registry", "resolver", "builder", "activator"),
    "di": ("startup", "module", "registr", "service", "provider", "container", "factory", "builder"),
}
METHOD_HINTS = {
    "reflection": ("load", "create", "build", "resolve", "discover", "get", "activate"),
    "di": ("configure", "register", "resolve", "create", "build", "get"),
}
SOFT_TYPES = {"xaml": ("ai_xaml_candidate_event", "ai_xaml_candidate_command_binding"), "reflection": ("ai_reflection_candidate_dispatch",), "di": ("ai_di_candidate_dispatch", "ai_factory_candidate_dispatch")}
EVENT_TYPES, COMMAND_TYPES = ("xaml_event", "xaml_action_binding"), ("xaml_command_binding", "xaml_navigation")
FOCAL_KINDS = ("method", "constructor")
#: Candidates of each kind that are ranked together when all kinds are asked for.
OVERFETCH = 50


def is_callback(fqn: Column) -> Column:
    """Whether a signature is that of a user-interface callback; every known marker ends in EventArgs."""
    return fqn.contains("EventArgs")


def _some(c: Column, words: tuple[str, ...], how: str) -> Column:
    return reduce(lambda a, b: a | b, [getattr(c, how)(w) for w in words])


def focal_symbols(symbols: DataFrame, fan_in: DataFrame, kind: str, per_file: int = 5) -> DataFrame:
    """(file_path, fqn, kind, fan_in, loc, score, rank): the methods and constructors of each file worth looking at first:
    constructors, those that nothing reaches, and those with telling names."""
    owner, low = F.lower(F.substring_index(F.coalesce("containing_type", F.lit("")), ".", -1)), F.lower(F.coalesce("name", F.lit("")))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    reached = F.when(F.coalesce("fan_in", F.lit(0)) == 0, 4).when(F.col("fan_in") == 1, 2).otherwise(0)
    score = points(F.col("kind") == "constructor", 2) + reached + points(_some(owner, TYPE_HINTS[kind], "contains"), 3) + points(_some(low, METHOD_HINTS[kind], "startswith"), 2)
    s = symbols.where(F.col("kind").isin(*FOCAL_KINDS)).join(fan_in, "fqn", "left").withColumn("score", score)
    w = Window.partitionBy("file_path").orderBy(F.desc("score"), F.desc(F.coalesce("loc", F.lit(0))), F.coalesce("fan_in", F.lit(0)), "fqn")
    kept = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_file)
    return kept.select("file_path", "fqn", "name", "containing_type", "line_start", "kind", "fan_in", "loc", "score", "rank")


def marker_files(texts: DataFrame, projects: DataFrame, kind: str) -> DataFrame:
    """(file_path, project, text, hits): C# files outside test projects whose text (file_path, project_id, text) holds
    markers of the kind, with those that it holds in their order."""
    home = projects.where("not coalesce(is_test_project, false)").select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    hits = F.filter(F.array(*map(F.lit, MARKERS[kind])), lambda m: F.contains(F.coalesce("text", F.lit("")), m))
    code = texts.where(F.lower("file_path").endswith(".cs")).join(home, "project_id")
    return code.withColumn("hits", hits).where(F.size("hits") > 0).select("file_path", "project", "text", "hits")


def code_candidates(texts: DataFrame, projects: DataFrame, symbols: DataFrame, fan_in: DataFrame, edges: DataFrame, kind: str, snippets: bool = False) -> DataFrame:
    """(candidate_kind, project, file_path, score, reasons, pattern_hits, hard_edge_count, focal_symbols) of the files with
    markers of reflection or of injection and a focal symbol.

    A marker counts 1; no recovered dispatch edge from the focal symbols 3, one or two of them 1; each of up to three
    focal symbols that nothing reaches 1.  `edges` is the call graph (caller, callee, call_type).
    """
    files = marker_files(texts, projects, kind)
    focal = focal_symbols(symbols, fan_in, kind).join(files.select("file_path"), "file_path", "left_semi")
    hard = edges.where(F.col("call_type").isin(*DISPATCH_TYPES[kind])).groupBy(F.col("caller").alias("fqn")).agg(F.count("*").alias("hard"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "fqn", "kind", "fan_in", "loc", "name", "containing_type", "line_start")))
    per = focal.join(hard, "fqn", "left").groupBy("file_path").agg(F.sum(F.coalesce("hard", F.lit(0))).alias("hard_edge_count"), F.count_if(F.coalesce("fan_in", F.lit(0)) == 0).alias("bare"), listed.alias("focal"))
    n = F.size("hits")
    none, few = F.col("hard_edge_count") == 0, F.col("hard_edge_count") <= 2
    score = n + F.when(none, 3).when(few, 1).otherwise(0) + F.least(F.col("bare"), F.lit(3)).cast("int")
    reasons = F.array_compact(F.array(
        F.format_string(f"file contains %d {kind} marker(s)", n),
        F.when(none, f"no recovered hard {kind} dispatch edges from focal symbols").when(few, F.format_string(f"only %d recovered hard {kind} dispatch edge(s)", "hard_edge_count")),
        F.when(F.col("bare") > 0, F.format_string("%d focal symbol(s) still have fan_in=0", "bare")),
    ))
    out = files.join(per, "file_path").withColumn("score", score).withColumn("reasons", reasons)
    columns = [F.lit(kind).alias("candidate_kind"), "project", "file_path", "score", "reasons", F.slice("hits", 1, 8).alias("pattern_hits"), "hard_edge_count", F.expr("transform(focal, f -> struct(f.fqn, f.kind, f.fan_in, f.loc))").alias("focal_symbols")]
    if not snippets:
        return out.select(*columns)
    first = navigate.snippets(out.select("file_path", "text", F.expr("hits[0]").alias("marker")), F.col("marker"), context=5)
    first = first.select("file_path", F.struct("file_path", "line_start", "line_end", F.concat(F.lit("Found marker '"), F.col("marker"), F.lit("'")).alias("reason"), F.col("snippet").alias("text")).alias("s1"))
    asked = out.select("file_path", "text", F.expr("focal[0].name").alias("name"), F.expr("focal[0].containing_type").alias("containing_type"), F.expr("focal[0].line_start").alias("line_start"))
    second = navigate.focal_snippets(asked).select("file_path", F.struct("file_path", "line_start", "line_end", F.concat(F.lit("Focal symbol: "), F.col("name")).alias("reason"), F.col("snippet").alias("text")).alias("s2"))
    return out.select(*columns).join(first, "file_path", "left").join(second, "file_path", "left").withColumn("context_snippets", F.array_compact(F.array("s1", "s2"))).drop("s1", "s2")


def xaml_candidates(symbols: DataFrame, projects: DataFrame, fan_in: DataFrame, calls: DataFrame, uses: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(candidate_kind, xaml_fqn, project, file_path, containing_type, event_edges, command_edges, weak_handlers, reasons,
    score) of the markup symbols that may lack edges.

    No event edge counts 3, no command edge 2, each of up to five callbacks of the type that nothing reaches 1, a shared
    or resource file 1; a score of 0 is no candidate.  With `texts` (file_path, text) snippets are added.
    """
    x = symbols.where("kind = 'xaml'").select(F.col("fqn").alias("xaml_fqn"), "project_id", "containing_type", F.coalesce("file_path", F.lit("")).alias("file_path"))
    x = x.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id")
    out_of = lambda edges, source, type_col, types, name: edges.where(F.col(type_col).isin(*types)).groupBy(F.col(source).alias("xaml_fqn")).agg(F.count("*").alias(name))
    x = x.join(out_of(calls, "caller", "call_type", EVENT_TYPES, "event_edges"), "xaml_fqn", "left").join(out_of(uses, "source", "type", COMMAND_TYPES, "command_edges"), "xaml_fqn", "left").fillna(0, ["event_edges", "command_edges"])
    weak = symbols.where("kind = 'method'").join(fan_in, "fqn", "left").where((F.coalesce("fan_in", F.lit(0)) == 0) & is_callback(F.col("fqn")))
    weak = weak.groupBy("containing_type").agg(F.array_sort(F.collect_list(F.struct("fqn", "file_path", "loc", "line_start"))).alias("weak"))
    x = x.join(weak, "containing_type", "left").withColumn("n", F.greatest(F.size(F.coalesce("weak", F.expr("cast(array() as array<struct<fqn:string,file_path:string,loc:bigint,line_start:bigint>>)"))), F.lit(0)))
    shared = F.contains("file_path", F.lit("\\Shared\\")) | F.col("file_path").endswith(".xaml")
    points = [
        (F.col("event_edges") == 0, 3, F.lit("xaml has no recovered event/action edges")),
        (F.col("command_edges") == 0, 2, F.lit("xaml has no recovered command/navigation edges")),
        (F.col("n") > 0, F.least(F.col("n"), F.lit(5)), F.format_string("%d likely UI callback(s) still have fan_in=0", "n")),
        (shared, 1, F.lit("shared or resource-linked XAML can hide ownership boundaries")),
    ]
    score = reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p, _ in points])
    reasons = F.array_compact(F.array(*[F.when(c, text) for c, _, text in points]))
    out = x.withColumn("score", score.cast("int")).withColumn("reasons", reasons).where("score > 0")
    columns = [F.lit("xaml").alias("candidate_kind"), "xaml_fqn", "project", "file_path", "containing_type", "event_edges", "command_edges", F.slice(F.coalesce("weak", F.expr("cast(array() as array<struct<fqn:string,file_path:string,loc:bigint,line_start:bigint>>)")), 1, 10).alias("weak_handlers"), "reasons", "score"]
    if texts is None:
        return out.select(*columns)
    t = texts.select("file_path", "text")
    head = navigate.snippets(out.select("xaml_fqn", "file_path").join(t, "file_path"), "x:Class", context=5)
    head = head.select("xaml_fqn", F.struct("file_path", "line_start", "line_end", F.lit("XAML definition").alias("reason"), F.col("snippet").alias("text")).alias("s1"))
    handler = out.select("xaml_fqn", F.expr("weak[0].file_path").alias("file_path"), F.expr("weak[0].line_start").alias("at")).join(t, "file_path")
    handler = navigate.snippets(handler, line="at").select("xaml_fqn", F.struct("file_path", "line_start", "line_end", F.lit("First disconnected handler").alias("reason"), F.col("snippet").alias("text")).alias("s2"))
    return out.select(*columns).join(head, "xaml_fqn", "left").join(handler, "xaml_fqn", "left").withColumn("context_snippets", F.array_compact(F.array("s1", "s2"))).drop("s1", "s2")


def with_context(candidates: DataFrame, kind: str) -> DataFrame:
    """`candidates` with context_files, context_symbols and suggested_soft_edge_types."""
    if kind == "xaml":
        files = F.concat(F.array("file_path"), F.expr("transform(weak_handlers, h -> h.file_path)"))
        names = F.concat(F.array("xaml_fqn"), F.expr("transform(slice(weak_handlers, 1, 5), h -> h.fqn)"))
    else:
        files, names = F.array("file_path"), F.expr("transform(slice(focal_symbols, 1, 5), f -> f.fqn)")
    first_seen = F.array_distinct(F.filter(files, lambda f: F.coalesce(f, F.lit("")) != ""))
    return candidates.withColumns({"context_files": first_seen, "context_symbols": names, "suggested_soft_edge_types": F.array(*map(F.lit, SOFT_TYPES[kind]))})


def ordered(candidates: DataFrame, limit: int) -> DataFrame:
    """The `limit` highest scores; ties by name (markup) or path."""
    key = "xaml_fqn" if "xaml_fqn" in candidates.columns else "file_path"
    return candidates.orderBy(F.desc("score"), key).limit(limit)


def merged(by_kind: dict[str, DataFrame], limit: int) -> DataFrame:
    """The best `limit` of several kinds together, by score, kind and path; each kind gives its best OVERFETCH at least."""
    each = [ordered(with_context(df, kind), limit if len(by_kind) == 1 else max(limit, OVERFETCH)) for kind, df in by_kind.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each).orderBy(F.desc("score"), "candidate_kind", "file_path").limit(limit)
