"""Edges and nodes: normalisation on ingest, simple digraphs, degrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.shared import kept

#: Call types whose edges weigh less, in hundredths.
LOW_CONFIDENCE = ("delegate_reference",)
FRAMEWORK_CONVENTION = (
    "event_dispatch", "lifecycle_entrypoint", "serialization_callback", "mvvm_toolkit_message_dispatch", "autofac_module_load",
    "autofac_reflection_registration", "service_provider_dispatch", "autofac_resolve_dispatch", "reflection_constructor_dispatch", "xaml_event",
)
#: Kinds of nodes that stand for a framework, and the prefix of names that do.
FRAMEWORK_KINDS = ("framework_method", "xaml")
FRAMEWORK_PREFIX = "framework::"
#: Kinds that the call graph and the inheritance graph list as nodes.
CALL_NODE_KINDS = ("method", "constructor", "event", "lambda", "xaml", "framework_method")
INHERITANCE_NODE_KINDS = ("class", "interface")
RULE_FIELDS = ("rule_id", "rule_family", "rule_mode")


def aggregate_calls(calls: DataFrame) -> DataFrame:
    """Sums call_count over edges that agree in everything else; null rule fields group with null."""
    return calls.groupBy("caller", "callee", "call_type", *RULE_FIELDS).agg(F.sum("call_count").alias("call_count"))


def merge_accesses(accesses: DataFrame) -> DataFrame:
    """One access for each (accessor, target, is_external): read and write make read_write, else the first kind stays."""
    kind = F.when(F.max(F.when(F.col("access_kind") == "read", 1).otherwise(0)) + F.max(F.when(F.col("access_kind") == "write", 1).otherwise(0)) == 2, "read_write")
    return accesses.groupBy("accessor", "target", "is_external").agg(F.coalesce(kind, F.min(F.struct("ordinal", "access_kind"))["access_kind"]).alias("access_kind"))


def fold_symbols(arrivals: DataFrame) -> DataFrame:
    """Symbols that arrive more than once under a name become one: first known texts, widest lines, summed loc.

    A symbol that arrives once keeps its nulls; where several arrive, an unknown parameter count counts as 0.
    """
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ordinal", c)))[c].alias(c)
    last = lambda c: F.max(F.struct("ordinal", c))[c].alias(c)
    return arrivals.groupBy("fqn").agg(
        last("name"), last("project_id"), first("namespace"), first("return_type"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.sum("loc").alias("loc"),
        F.when(F.count("*") > 1, F.max(F.coalesce("parameter_count", F.lit(0)))).otherwise(F.max("parameter_count")).alias("parameter_count"), F.bool_or("is_async").alias("is_async"), F.count("*").alias("arrivals"),
    )


def resolve_endpoints(edges: DataFrame, symbols: DataFrame, source: str, target: str) -> DataFrame:
    """Edges by symbol id; an edge with an endpoint that no symbol has is left out."""
    ids = symbols.select("fqn", F.sha2("fqn", 256).alias("id"))
    s, t = ids.select(F.col("fqn").alias(source), F.col("id").alias("source_id")), ids.select(F.col("fqn").alias(target), F.col("id").alias("target_id"))
    return edges.join(s, source).join(t, target).drop(source, target)


def not_yet_known(edges: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that `known` does not hold; null keys are equal to null."""
    e, k = edges.alias("e"), known.select(*keys).distinct().alias("k")
    on = F.lit(True)
    for c in keys:
        on = on & F.col(f"e.{c}").eqNullSafe(F.col(f"k.{c}"))
    return e.join(k, on, "left_anti")


def row_fan_in(symbols: DataFrame, calls: DataFrame, inheritance: DataFrame, accesses: DataFrame, uses: DataFrame) -> DataFrame:
    """(fqn, fan_in): the number of edge rows of any sort that end at a symbol, 0 if none."""
    ends = [calls.select(F.col("callee").alias("fqn")), inheritance.select(F.col("base").alias("fqn")), accesses.select(F.col("target").alias("fqn")), uses.select(F.col("target").alias("fqn"))]
    counted = None
    for e in ends:
        c = e.groupBy("fqn").count()
        counted = c if counted is None else counted.union(c)
    total = counted.groupBy("fqn").agg(F.sum("count").alias("n"))
    return symbols.join(total, "fqn", "left").select("fqn", F.coalesce("n", F.lit(0)).alias("fan_in"))


def simple_digraph(edges: DataFrame, source: str = "caller", target: str = "callee", type: str = "call_type") -> DataFrame:  # noqa: A002
    """One edge for each (source, target): of parallel edges the last one by (type, rule_id) stays, nulls first."""
    order = [F.desc_nulls_last(c) for c in (type, *[c for c in RULE_FIELDS if c in edges.columns])]
    w = Window.partitionBy(source, target).orderBy(*order)
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def call_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """The call graph's edges: both ends are symbols of a kind that is a call node."""
    nodes = symbols.where(F.col("kind").isin(*CALL_NODE_KINDS)).select("fqn")
    return simple_digraph(calls).join(nodes.select(F.col("fqn").alias("caller")), "caller", "left_semi").join(nodes.select(F.col("fqn").alias("callee")), "callee", "left_semi")


def degrees(edges: DataFrame, source: str = "caller", target: str = "callee") -> DataFrame:
    """(node, in_degree, out_degree) of a simple digraph; a self-loop counts once each way."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(target).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col(source).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def marked(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call edges with caller_framework and callee_framework: whether the end stands for a framework, by the prefix of its
    name or by the kind of its node."""
    nodes = symbols.where(F.col("kind").isin(*FRAMEWORK_KINDS)).select("fqn").distinct()
    out = edges
    for end in ("caller", "callee"):
        known = nodes.select(F.col("fqn").alias(end), F.lit(True).alias("__known"))
        out = out.join(known, end, "left").withColumn(f"{end}_framework", F.col(end).startswith(FRAMEWORK_PREFIX) | F.coalesce("__known", F.lit(False))).drop("__known")
    return out


def hundredths(framework: Column, call_type: str = "call_type") -> Column:
    """An edge's weight: low for loose references, lower for what a framework calls or is called by."""
    t = F.col(call_type)
    return F.when(t.isin(*LOW_CONFIDENCE), 15).when(t.isin(*FRAMEWORK_CONVENTION) | framework, 35).otherwise(100)


def weighted_degrees(edges: DataFrame) -> DataFrame:
    """(node, weighted_in, weighted_out) of `marked` edges, summed in hundredths and so in any order."""
    end = lambda node, other, i, o: F.struct(F.col(node).alias("node"), i(hundredths(F.col(f"{other}_framework"))).alias("i"), o(hundredths(F.col(f"{other}_framework"))).alias("o"))
    none, own = (lambda w: F.lit(0)), (lambda w: w)
    ends = edges.select(F.explode(F.array(end("callee", "caller", own, none), end("caller", "callee", none, own))).alias("e")).select("e.*")
    return ends.groupBy("node").agg((F.sum("i") / 100.0).alias("weighted_in"), (F.sum("o") / 100.0).alias("weighted_out"))


def type_counts(edges: DataFrame) -> DataFrame:
    """(node, direction, type, n) of `marked` edges: edges into and out of a node by type, marked where the other end
    stands for a framework."""
    kind = lambda end, mark: F.concat(F.coalesce("call_type", F.lit("unknown")), F.when(F.col(f"{end}_framework"), mark).otherwise(""))
    ends = F.array(
        F.struct(F.col("callee").alias("node"), F.lit("in").alias("direction"), kind("caller", ":framework_source").alias("type")),
        F.struct(F.col("caller").alias("node"), F.lit("out").alias("direction"), kind("callee", ":framework_target").alias("type")),
    )
    return edges.select(F.explode(ends).alias("e")).groupBy("e.node", "e.direction", "e.type").agg(F.count("*").alias("n"))


def rule_counts(edges: DataFrame, source: str = "caller", target: str = "callee") -> DataFrame:
    """(node, direction, attribute, value, n) for the rule fields of a simple digraph, trimmed; blank ones are left out."""
    cells = [F.struct(F.col(node).alias("node"), F.lit(d).alias("direction"), F.lit(c).alias("attribute"), F.trim(c).alias("value")) for node, d in ((target, "in"), (source, "out")) for c in RULE_FIELDS]
    each = edges.select(F.explode(F.array(*cells)).alias("e")).select("e.*").where("value <> ''")
    return each.groupBy("node", "direction", "attribute", "value").agg(F.count("*").alias("n"))


def coupling(refs: DataFrame, projects: DataFrame) -> DataFrame:
    """(name, static_coupling): ends of project references at a project."""
    ends = refs.select(F.col("source").alias("id")).union(refs.select(F.col("target").alias("id"))).groupBy("id").count()
    return projects.join(ends, "id", "left").groupBy("name").agg(F.sum(F.coalesce("count", F.lit(0))).alias("static_coupling"))


#: How each graph names what leads to a node and what it leads to.
LABELS = {"call": ("Called by", "Calls"), "inheritance": ("Inherited by", "Inherits"), "type_dependency": ("Used as type by", "Uses type")}


def expand(edges: DataFrame, roots: DataFrame, depth: int = 2, source: str = "caller", target: str = "callee", labels: tuple[str, str] = ("callers", "callees")) -> DataFrame:
    """(root, node, direction): nodes within `depth` steps against and along the edges, each direction on its own; the
    root itself is not among them.  Cycles end because a node is taken once."""
    against, along = labels
    pairs = edges.select(source, target).distinct()
    links = pairs.select(F.explode(F.array(F.struct(F.lit(against).alias("direction"), F.col(target).alias("node"), F.col(source).alias("next")), F.struct(F.lit(along).alias("direction"), F.col(source).alias("node"), F.col(target).alias("next")))).alias("e")).select("e.*")
    seen = front = roots.select(F.col("fqn").alias("root"), F.col("fqn").alias("node"), F.explode(F.array(F.lit(against), F.lit(along))).alias("direction"))
    for step in range(depth):
        front = front.join(links, ["direction", "node"]).select("root", F.col("next").alias("node"), "direction").distinct().join(seen, ["root", "node", "direction"], "left_anti")
        if step + 1 < depth:
            front = kept(front)  # the next step starts from a table, not from all steps before
        seen = seen.union(front)
    return seen.where("root <> node")


def context(graphs: dict[str, tuple[DataFrame, str, str]], roots: DataFrame, depth: int = 2) -> DataFrame:
    """(root, context): what surrounds each root in several graphs (name -> edges, source, target), in words."""
    found = [expand(edges, roots, depth, source, target, LABELS[name]) for name, (edges, source, target) in graphs.items()]
    return reduce(DataFrame.union, found).select("root", F.concat_ws(": ", "direction", "node").alias("context")).distinct()


def dispatch_targets(calls: DataFrame, inheritance: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls to a method of a base type lead to the methods of that name in derived types as well (dynamic_dispatch)."""
    table = dispatch_map(inheritance, methods).select(F.col("base").alias("callee"), F.col("override").alias("target"))
    return calls.select("caller", "callee").join(table, "callee").select("caller", F.col("target").alias("callee"), F.lit("dynamic_dispatch").alias("call_type")).distinct()


def fallback_targets(unresolved: DataFrame, methods: DataFrame) -> DataFrame:
    """(caller, callee, call_type) for calls that were not resolved (caller, containing_type, method_name,
    argument_count): the methods of that name in the caller's type, those of as many parameters if there are any."""
    found = unresolved.where("trim(containing_type) <> '' and trim(method_name) <> ''").distinct()
    known = methods.select("containing_type", F.col("name").alias("method_name"), F.col("fqn").alias("callee"), "parameter_count")
    both = found.join(known, ["containing_type", "method_name"]).withColumn("exact", F.col("parameter_count") == F.col("argument_count"))
    w = Window.partitionBy("caller", "containing_type", "method_name", "argument_count")
    best = both.withColumn("some", F.max("exact").over(w)).where("exact or not some")
    return best.select("caller", "callee", F.lit("calls_fallback").alias("call_type")).distinct()


def override_edges(overrides: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, symbols): a call edge from each overridden method (base, override) to its override, and a symbol of kind
    framework_method for each base that no symbol has."""
    edges = overrides.select(F.col("base").alias("caller"), F.col("override").alias("callee"), F.lit("override_dispatch").alias("call_type"), F.lit(1).cast("long").alias("call_count"))
    unknown = overrides.select(F.col("base").alias("fqn")).distinct().join(symbols.select("fqn"), "fqn", "left_anti")
    head = F.substring_index("fqn", "(", 1)
    made = unknown.select("fqn", F.substring_index(head, ".", -1).alias("name"), F.lit("framework_method").alias("kind"), F.expr("substring(substring_index(fqn, '(', 1), 1, greatest(length(substring_index(fqn, '(', 1)) - length(substring_index(substring_index(fqn, '(', 1), '.', -1)) - 1, 0))").alias("containing_type"), F.lit(0).cast("long").alias("loc"))
    return edges, made


def promote_lambdas(calls: DataFrame, lambdas: DataFrame) -> DataFrame:
    """`calls` with those that a lambda makes (lambdas: fqn, enclosing) given to the enclosing method as well; a plain
    call becomes lambda_dispatch, and rule fields are not carried over."""
    inner = calls.join(lambdas.select(F.col("fqn").alias("caller"), "enclosing"), "caller")
    kind = F.when(F.col("call_type") == "calls", "lambda_dispatch").otherwise(F.col("call_type"))
    made = inner.select(F.col("enclosing").alias("caller"), "callee", kind.alias("call_type"), "call_count")
    return calls.unionByName(made, allowMissingColumns=True)


def dispatch_map(inheritance: DataFrame, methods: DataFrame) -> DataFrame:
    """(base, override): methods of a base type and those of the same name in the types derived from it."""
    m = methods.select("fqn", "name", "containing_type")
    up, down = m.alias("b"), m.alias("o")
    table = inheritance.alias("i").join(up, F.col("b.containing_type") == F.col("i.base")).join(down, (F.col("o.containing_type") == F.col("i.derived")) & (F.col("o.name") == F.col("b.name")))
    return table.select(F.col("b.fqn").alias("base"), F.col("o.fqn").alias("override")).where("base <> override").distinct()


def kept_type_uses(uses: DataFrame) -> DataFrame:
    """Type uses worth an edge: neither the root object type nor a type of the base library; each generic type with its
    arguments as uses of their own."""
    parts = F.filter(F.split("target", "[<>,]"), lambda t: F.trim(t) != "")
    each = uses.withColumn("target", F.explode(F.transform(parts, lambda t: F.trim(t))))
    return each.where(~(F.col("target").isin("object", "System.Object") | F.col("target").startswith("System."))).distinct()


def included_references(refs: DataFrame, projects: DataFrame) -> DataFrame:
    """Project references both of whose ends are included; each once, without a project's reference to itself."""
    ids = projects.select("id")
    both = refs.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return both.select("source", "target").distinct()
