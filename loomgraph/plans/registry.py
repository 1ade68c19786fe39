"""Registered queries: each applies an operator to the bound tables; ORACLE_SQL says the same in plain SQL."""

from __future__ import annotations

import atexit
import json
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import candidates, dsl, graph, hotspots, isolation, navigate, retrieval, similarity, soft_edges
from loomgraph.sinks import reports
from loomgraph.sinks.store import Store, export_graphs, write_graph
from loomgraph.sources import files, markup
from loomgraph.sources.binding import frame, with_bindings
from loomgraph.sources.shared import kept, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The bound tables by name, read when they are asked for; `stored` ones are written once for a query that uses them
    more than once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._at, self._stored = spark, (spark, sf_dir), {}

    def __getattr__(self, name: str) -> DataFrame:
        return frame(*self._at, name)

    def stored(self, name: str) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = kept(frame(*self._at, name))
        return self._stored[name]


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[Tables], DataFrame]):  # noqa: ANN202
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = with_bindings(sql)
        return f

    return register


_RULE_FIELDS = "rule_id, rule_family, rule_mode"


def _simple(table: str, source: str = "caller", target: str = "callee", kind: str = "call_type", rules: bool = True) -> str:
    order = ", ".join(f"{c} desc nulls last" for c in (kind, *(("rule_id", "rule_family", "rule_mode") if rules else ())))
    return f"(select * exclude (n) from (select *, row_number() over (partition by {source}, {target} order by {order}) as n from {table}) where n = 1)"


_SIMPLE = _simple("method_calls")
_NODES = "(select fqn from symbols where kind in ('method', 'constructor', 'event', 'lambda', 'xaml', 'framework_method'))"
_FRAMEWORK = "({0} like 'framework::%' or {0} in (select fqn from symbols where kind in ('framework_method', 'xaml')))"
_MARKED = f"(select *, {_FRAMEWORK.format('caller')} as cf, {_FRAMEWORK.format('callee')} as tf from {_SIMPLE})"
_CONVENTION = "('event_dispatch', 'lifecycle_entrypoint', 'serialization_callback', 'mvvm_toolkit_message_dispatch', 'autofac_module_load', 'autofac_reflection_registration', 'service_provider_dispatch', 'autofac_resolve_dispatch', 'reflection_constructor_dispatch', 'xaml_event')"
_WEIGHT = "case when call_type = 'delegate_reference' then 15 when call_type in " + _CONVENTION + " or {0} then 35 else 100 end"
_WEIGHTED = f"(select node, cast(sum(i) as double) / 100 as weighted_in, cast(sum(o) as double) / 100 as weighted_out from (select callee as node, {_WEIGHT.format('cf')} as i, 0 as o from {_MARKED} union all select caller, 0, {_WEIGHT.format('tf')} from {_MARKED}) group by 1)"
_FAN_IN = """select s.fqn, cast(coalesce(n, 0) as bigint) as fan_in from symbols s left join (select fqn, sum(c) as n from (
    select callee as fqn, count(*) as c from {calls} group by 1 union all select base, count(*) from {inheritance} group by 1
    union all select target, count(*) from {accesses} group by 1 union all select target, count(*) from {uses} group by 1) group by 1) x on x.fqn = s.fqn"""
_ALL_FAN_IN = _FAN_IN.format(calls="method_calls", inheritance="inheritance", accesses="field_accesses", uses="type_uses")
_EARLY = _FAN_IN.format(calls="early_calls", inheritance="early_inheritance", accesses="thin_accesses", uses="early_uses")


def _graphs(t: Tables, calls: str = "thin_calls", accesses: str = "thin_accesses") -> dict[str, tuple[DataFrame, str, str]]:
    """The four symbol graphs as simple digraphs."""
    ends = lambda df, a, b, kind: (graph.simple_digraph(df, a, b, kind), a, b)
    return {
        "call": ends(t.stored(calls), "caller", "callee", "call_type"),
        "inheritance": ends(t.stored("inheritance"), "derived", "base", "kind"),
        "type_dependency": ends(t.stored("type_uses"), "source", "target", "type"),
        "field_access": ends(t.stored(accesses), "accessor", "target", "access_kind"),
    }


@query(f"select caller, callee, call_type, {_RULE_FIELDS}, cast(sum(call_count) as bigint) as call_count from method_calls group by all")
def call_aggregate(t: Tables) -> DataFrame:
    return graph.aggregate_calls(t.method_calls)


@query("""select accessor, target, is_external, case when bool_or(access_kind = 'read') and bool_or(access_kind = 'write') then 'read_write' else arg_min(access_kind, ordinal) end as access_kind from field_accesses group by 1, 2, 3""")
def field_access_merge(t: Tables) -> DataFrame:
    return graph.merge_accesses(t.field_accesses)


@query(f"select distinct source, target, type, {_RULE_FIELDS} from type_uses")
def type_dep_distinct(t: Tables) -> DataFrame:
    return t.type_uses.dropDuplicates(["source", "target", "type", "rule_id", "rule_family", "rule_mode"])


@query("select distinct m.fqn as source, u.target from methods m, unnest(case when m.k % 3 = 0 then ['System.Collections.Generic.List'] when m.k % 3 = 1 then ['Repository', m.containing_type] else ['object'] end) as u(target) where not (u.target in ('object', 'System.Object') or u.target like 'System.%')")
def type_use_filter(t: Tables) -> DataFrame:
    """Types as written, with generic arguments: those worth an edge."""
    written = F.expr("case k % 3 when 0 then 'System.Collections.Generic.List<object>' when 1 then concat('Repository<', containing_type, '>') else 'object' end")
    return graph.kept_type_uses(t.methods.select(F.col("fqn").alias("source"), written.alias("target")))


@query("""select fqn, arg_max(name, ordinal) as name, arg_max(project_id, ordinal) as project_id, arg_min(namespace, ordinal) filter (namespace is not null) as namespace, arg_min(return_type, ordinal) filter (return_type is not null) as return_type,
    min(line_start) as line_start, max(line_end) as line_end, cast(sum(loc) as bigint) as loc, case when count(*) > 1 then max(coalesce(parameter_count, 0)) else max(parameter_count) end as parameter_count, bool_or(is_async) as is_async, count(*) as arrivals from arrivals group by fqn""")
def symbol_upsert_fold(t: Tables) -> DataFrame:
    return graph.fold_symbols(t.arrivals)


@query(f"""select c.call_type, {_RULE_FIELDS}, c.call_count, sha256(a.fqn) as source_id, sha256(b.fqn) as target_id from method_calls c join symbols a on a.fqn = c.caller join symbols b on b.fqn = c.callee""")
def edge_endpoint_resolution(t: Tables) -> DataFrame:
    return graph.resolve_endpoints(t.method_calls, t.symbols, "caller", "callee")


@query("""select m.caller, m.callee, m.call_type, m.rule_id from method_calls m where not exists (select 1 from thin_calls k where k.caller = m.caller and k.callee = m.callee and k.rule_id is not distinct from m.rule_id)""")
def relationship_not_exists(t: Tables) -> DataFrame:
    return graph.not_yet_known(t.method_calls.select("caller", "callee", "call_type", "rule_id"), t.thin_calls, ["caller", "callee", "rule_id"])


@query(_ALL_FAN_IN)
def db_fan_in(t: Tables) -> DataFrame:
    return graph.row_fan_in(t.symbols, t.method_calls, t.inheritance, t.field_accesses, t.type_uses)


@query(f"select s.fqn, s.kind, coalesce(s.file_path, '') as file, coalesce(p.name, '') as project from symbols s left join projects p on p.id = s.project_id where s.fqn in {_NODES}")
def graph_nodes_call(t: Tables) -> DataFrame:
    home = t.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    return t.symbols.where(F.col("kind").isin(*graph.CALL_NODE_KINDS)).join(home, "project_id", "left").select("fqn", "kind", F.coalesce("file_path", F.lit("")).alias("file"), F.coalesce("project", F.lit("")).alias("project"))


@query(f"select caller, callee, call_type, {_RULE_FIELDS}, call_count from {_SIMPLE} where caller in {_NODES} and callee in {_NODES}")
def graph_edges_call(t: Tables) -> DataFrame:
    return graph.call_edges(t.method_calls, t.symbols)


@query("""select e.fqn, coalesce(s.kind, 'unknown') as kind from (select accessor as fqn from field_accesses union select target from field_accesses union select 'System.Console.Out') e left join symbols s on s.fqn = e.fqn""")
def graph_nodes_field_access(t: Tables) -> DataFrame:
    """The ends of field accesses, one of which is no symbol."""
    outside = t.field_accesses.limit(1).select(F.lit("System.Console.Out").alias("fqn"))
    ends = t.field_accesses.select(F.explode(F.array("accessor", "target")).alias("fqn")).union(outside).distinct()
    return ends.join(t.symbols.select("fqn", "kind"), "fqn", "left").select("fqn", F.coalesce("kind", F.lit("unknown")).alias("kind"))


@query("select fqn, kind from symbols where kind in ('class', 'interface')")
def graph_nodes_inheritance(t: Tables) -> DataFrame:
    return t.symbols.where(F.col("kind").isin(*graph.INHERITANCE_NODE_KINDS)).select("fqn", "kind")


@query("select d.fqn as derived, b.fqn as base, i.kind from inheritance i join symbols d on d.fqn = i.derived join symbols b on b.fqn = i.base")
def graph_edges_inheritance(t: Tables) -> DataFrame:
    s = t.symbols.select("fqn")
    return t.inheritance.join(s.withColumnRenamed("fqn", "derived"), "derived").join(s.withColumnRenamed("fqn", "base"), "base")


@query(f"select source, target, type, {_RULE_FIELDS} from {_simple('type_uses', 'source', 'target', 'type')}")
def graph_edges_type_dependency(t: Tables) -> DataFrame:
    return graph.simple_digraph(t.type_uses, "source", "target", "type")


@query("select a.name as source, b.name as target from project_refs r join projects a on a.id = r.source join projects b on b.id = r.target")
def graph_project_dependency(t: Tables) -> DataFrame:
    p = t.projects.select("id", "name")
    return t.project_refs.join(p.select(F.col("id").alias("source"), F.col("name").alias("s")), "source").join(p.select(F.col("id").alias("target"), F.col("name").alias("t")), "target").select(F.col("s").alias("source"), F.col("t").alias("target"))


@query("select source, target from project_refs where source in (select id from projects where not is_test_project) and target in (select id from projects where not is_test_project)")
def project_refs_included(t: Tables) -> DataFrame:
    return graph.included_references(t.project_refs, t.projects.where("not is_test_project"))


@query("""select node, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree from (select callee as node, count(distinct caller) as i, 0 as o from method_calls group by 1 union all select caller, 0, count(distinct callee) from method_calls group by 1) group by 1""")
def degree_simple(t: Tables) -> DataFrame:
    return graph.degrees(graph.simple_digraph(t.method_calls))


@query(f"select * from {_WEIGHTED}")
def degree_weighted(t: Tables) -> DataFrame:
    return graph.weighted_degrees(graph.marked(graph.simple_digraph(t.method_calls), t.symbols))


@query(f"""select node, direction, type, count(*) as n from (select callee as node, 'in' as direction, call_type || case when cf then ':framework_source' else '' end as type from {_MARKED}
    union all select caller, 'out', call_type || case when tf then ':framework_target' else '' end from {_MARKED}) group by 1, 2, 3""")
def edge_type_counts(t: Tables) -> DataFrame:
    return graph.type_counts(graph.marked(graph.simple_digraph(t.method_calls), t.symbols))


def _rule_counts_sql(simple: str, source: str, target: str) -> str:
    each = [f"select {node} as node, '{d}' as direction, '{c}' as attribute, trim({c}) as value from {simple}" for node, d in ((target, "in"), (source, "out")) for c in ("rule_id", "rule_family", "rule_mode")]
    return f"select node, direction, attribute, value, count(*) as n from ({' union all '.join(each)}) where value <> '' group by 1, 2, 3, 4"


@query(_rule_counts_sql(_SIMPLE, "caller", "callee"))
def edge_rule_counts(t: Tables) -> DataFrame:
    return graph.rule_counts(graph.simple_digraph(t.method_calls))


@query(_rule_counts_sql(_simple("type_uses", "source", "target", "type"), "source", "target"))
def type_rule_counts(t: Tables) -> DataFrame:
    return graph.rule_counts(graph.simple_digraph(t.type_uses, "source", "target", "type"), "source", "target")


_COUPLING = "select p.name, cast(count(e.id) as bigint) as static_coupling from projects p left join (select source as id from project_refs union all select target from project_refs) e on e.id = p.id group by 1"


@query(_COUPLING)
def static_coupling(t: Tables) -> DataFrame:
    return graph.coupling(t.project_refs, t.projects)


_DEGREE = "(select callee as node, count(distinct caller) as d from method_calls group by 1)"
_ROLLUP = f"""select s.fqn, cast(coalesce(d.d, 0) + case when s.kind = 'class' then coalesce(m.d, 0) else 0 end as bigint) as fan_in from symbols s left join {_DEGREE} d on d.node = s.fqn
    left join (select x.containing_type as ct, sum(coalesce(y.d, 0)) as d from symbols x left join {_DEGREE} y on y.node = x.fqn where x.containing_type is not null group by 1) m on m.ct = s.fqn"""


@query(_ROLLUP)
def class_fan_in_rollup(t: Tables) -> DataFrame:
    return hotspots.class_roll_up(t.symbols, graph.degrees(graph.simple_digraph(t.method_calls)))


_TEST = "(coalesce(p.is_test_project, false) or regexp_matches(lower(s.fqn || ' ' || coalesce(s.file_path, '')), '[.](unittest|tests|test)[.]|\\\\(unittest|tests|test|integrationtests|livetests|browser[.]tests)\\\\'))"
_HAZARD = "(has_do_events and (has_ui_dispatch or has_background_worker or has_task_spawn)) or (has_ui_dispatch and (has_task_spawn or has_background_worker or has_thread_start or has_blocking_wait))"
_HOTSPOT = f"""m as (select s.fqn, s.kind, s.loc, r.fan_in, cast(coalesce(o.d, 0) as bigint) as fan_out, round(coalesce(w.weighted_in, 0), 3) as effective_fan_in, round(coalesce(w.weighted_out, 0), 3) as effective_fan_out, cast(coalesce(c.static_coupling, 0) as bigint) as coupling, coalesce(s.parameter_count, 0) as parameter_count, s.is_async, {_TEST} as is_test, {_HAZARD} as is_hazard
    from symbols s left join projects p on p.id = s.project_id join ({_ROLLUP}) r on r.fqn = s.fqn left join (select caller as node, count(distinct callee) as d from method_calls group by 1) o on o.node = s.fqn
    left join {_WEIGHTED} w on w.node = s.fqn left join ({_COUPLING}) c on c.name = p.name),
    x as (select coalesce(nullif(max(effective_fan_in), 0), 1) as a, coalesce(nullif(max(loc), 0), 1) as b, coalesce(nullif(max(effective_fan_out), 0), 1) as c, coalesce(nullif(max(parameter_count), 0), 1) as d, coalesce(nullif(max(coupling), 0), 1) as e from m),
    scored as (select m.*, cast(fan_in * loc as bigint) as danger_score,
    round(0.25::double * (effective_fan_in / a) + 0.20::double * (effective_fan_out / c) + 0.20::double * (loc::double / b) + 0.10::double * (parameter_count::double / d) + 0.10::double * is_async::int::double + 0.15::double * (coupling::double / e), 4) as score from m, x)"""


def _scored(t: Tables) -> DataFrame:
    edges = graph.marked(graph.simple_digraph(t.stored("method_calls")), t.stored("symbols"))
    return hotspots.hotspots(t.stored("symbols"), t.projects, kept(edges), graph.coupling(t.project_refs, t.projects))


_MEASURES = "fqn, kind, loc, fan_in, fan_out, effective_fan_in, effective_fan_out, parameter_count, coupling, danger_score, score, is_test"


@query(f"with {_HOTSPOT} select {_MEASURES}, is_hazard from scored")
def hotspot_scores(t: Tables) -> DataFrame:
    return _scored(t).select(*_MEASURES.split(", "), "is_hazard")


@query(f"with {_HOTSPOT} select fqn, score, cast(row_number() over (order by score desc, fqn) as int) as rank from scored where not is_test order by score desc, fqn limit 50")
def hotspot_report(t: Tables) -> DataFrame:
    """The report's first list: a feature of fifty rows."""
    return hotspots.ranked(_scored(t).where("not is_test"), 50).select("fqn", "score", "rank")


@query(f"""with {_HOTSPOT} select fqn, unnest(list_filter([case when danger_score >= 2000 then 'high fan-in x LOC' end, case when loc >= 1500 and fan_in >= 5 then 'very large class with multiple callers' end,
    case when danger_score >= 500 and regexp_matches(lower(fqn), 'manager|controller|global|registry|serviceprovider|locator') then 'broad-responsibility name with notable fan-in x LOC' end], lambda r: r is not null)) as reason from scored where kind = 'class'""")
def hotspot_antipatterns(t: Tables) -> DataFrame:
    return hotspots.anti_patterns(_scored(t))


@query(f"""select fqn from symbols where {_HAZARD}""")
def threading_hazards(t: Tables) -> DataFrame:
    return hotspots.threading_hazards(t.symbols).select("fqn")


_STATE = """a as (select f.*, case when regexp_matches(lower(accessor), '[.]ctor|_load|initui|initialize|_shown|setparamdefault') then 'init' when regexp_matches(lower(accessor), '_click|_checkedchanged|_selectedindexchanged|_scroll|_propvaluechanged|_domainchanged|_formclosed|_formclosing') then 'event' else 'runtime' end as cat
    from {accesses} f join symbols s on s.fqn = f.target and s.kind in ('field', 'property') left join projects p on p.id = s.project_id where not coalesce(p.is_test_project, false) and not regexp_matches(lower(target), '[.](unittest|tests|test)[.]')),
    g as (select target, count(distinct accessor) filter (access_kind <> 'read') as writers, count(distinct accessor) filter (access_kind <> 'write') as readers, count(distinct accessor) filter (access_kind <> 'read' and is_external) as external, count(distinct accessor) filter (access_kind <> 'read' and not is_external) as internal_writers,
    count(distinct accessor) filter (access_kind <> 'read' and cat = 'init') as init, count(distinct accessor) filter (access_kind <> 'read' and cat = 'event') as event, count(distinct accessor) filter (access_kind <> 'read' and cat = 'runtime') as runtime from a group by 1),
    state as (select *, (100 * runtime + 30 * event + init) / 10.0::double as risk, case when writers < 2 then 'none' when external >= 2 then 'external' when external = 1 then 'mixed' else 'internal' end as spread from g)"""
_DENSE_STATE, _THIN_STATE = _STATE.format(accesses="field_accesses"), _STATE.format(accesses="thin_accesses")


@query(f"with {_DENSE_STATE} select * from state where writers >= 2")
def shared_mutable_state(t: Tables) -> DataFrame:
    return hotspots.shared_state(t.field_accesses, t.symbols, t.projects)


@query(f"with {_THIN_STATE} select target, spread, writers from state")
def shared_state_spread(t: Tables) -> DataFrame:
    """How far the writing of every field spreads, fields with fewer than two writers included."""
    return hotspots.shared_state(t.thin_accesses, t.symbols, t.projects, least_writers=0).select("target", "spread", "writers")


@query(f"with {_DENSE_STATE} select target, risk, writers, cast(row_number() over (order by risk desc, writers desc, target) as int) as rank from state where writers >= 2 and (runtime > 0 or event > 0) order by risk desc, writers desc, target limit 40")
def shared_state_report(t: Tables) -> DataFrame:
    """The report's list of risky fields: a feature of forty rows."""
    return hotspots.ranked_state(hotspots.shared_state(t.field_accesses, t.symbols, t.projects).where("runtime > 0 or event > 0"), 40).select("target", "risk", "writers", "rank")


@query(f"with {_DENSE_STATE} select case when runtime > 0 or event > 0 then 'high' else 'low' end as risk_class, count(*) as n from state where writers >= 2 group by 1")
def shared_state_risks(t: Tables) -> DataFrame:
    return hotspots.risks(hotspots.shared_state(t.field_accesses, t.symbols, t.projects))


@query("select p.name as project, p.id as project_id, f.file_name, f.file_path from source_files f join projects p on p.id = f.project_id where f.file_path ilike '%s_r%view%' or f.file_name ilike '%s_r%view%' order by 1, 4 limit 20")
def files_list(t: Tables) -> DataFrame:
    """A listing of twenty files; the user's % and _ are wildcards."""
    return navigate.list_files(t.source_files, t.projects, None, "s_r%View", 20)


@query(f"""select s.fqn, s.name, s.kind, p.name as project, s.file_path, s.line_start, s.loc, f.fan_in from symbols s join projects p on p.id = s.project_id join ({_ALL_FAN_IN}) f on f.fqn = s.fqn
    where (s.fqn ilike '%load%' or s.name ilike '%load%') and s.kind = 'method' and (p.name ilike '%a%' or p.id ilike '%a%') and s.file_path ilike '%repo%' order by f.fan_in desc, s.loc desc, s.fqn limit 25""")
def symbols_list(t: Tables) -> DataFrame:
    return navigate.list_symbols(t.symbols, t.projects, db_fan_in(t), "load", "method", "a", "repo", 25)


@query("""with q as (select unnest(['supplier1view', 'upplier1vie', 'nothing here', 'receive', 'xaml']) as question),
    n as (select question, (select count(*) from symbols where lower(name) = question) as n1, (select min(fqn) from symbols where lower(name) = question) as f1, (select count(*) from symbols where contains(lower(fqn), question)) as n2, (select min(fqn) from symbols where contains(lower(fqn), question)) as f2 from q)
    select question, case when n1 = 1 then f1 when n2 = 1 then f2 end as fqn, case when n1 = 1 then 1 when n2 = 1 then 2 end as tier from n where n1 = 1 or n2 = 1""")
def symbol_resolve(t: Tables) -> DataFrame:
    s = t.stored("symbols")
    found = None
    for q in ("supplier1view", "upplier1vie", "nothing here", "receive", "xaml"):
        one = similarity.resolve(s, q).withColumn("question", F.lit(q))
        found = one if found is None else found.union(one)
    return found


@query(r"""select file_path as path, bool_or(list_contains(string_split(lower(replace(file_path, chr(92), '/')), '/')[:-2], 'tests') or regexp_matches(lower(regexp_extract(file_path, '[^/\\]+$')), '^.*view[.]xaml[.]cs$') or regexp_matches(lower(replace(file_path, chr(92), '/')), '(?:^|/)services/[^/]*manager[.]cs$')) as excluded from types group by 1""")
def exclusion_filter(t: Tables) -> DataFrame:
    return navigate.excluded(t.types.select(F.col("file_path").alias("path")).distinct(), ["tests", "obj"], "*View.xaml.cs", "services/*Manager.cs")


@query(f"select s.fqn, {_TEST} as is_test from symbols s left join projects p on p.id = s.project_id")
def test_symbol_flags(t: Tables) -> DataFrame:
    return hotspots.is_test(t.symbols, t.projects).select("fqn", "is_test")


@query("select cast(max(started_at) as timestamp) as last_run from runs where status = 'completed'")
def last_completed_run(t: Tables) -> DataFrame:
    return files.last_run(t.runs).select(F.col("last_run").cast("timestamp_ntz").alias("last_run"))


@query("select p.id from projects p join source_files f on f.project_id = p.id where f.modified_at > (select max(started_at) from runs where status = 'completed') group by 1")
def incremental_projects(t: Tables) -> DataFrame:
    return files.changed_projects(t.projects, t.source_files, t.runs)


@query("""select s.id as path, min(p.name) as name, bool_or(contains(lower(p.name), 'an')) as picked from solutions s join projects p on p.solution_id = s.id group by 1""")
def solution_projects(t: Tables) -> DataFrame:
    both = t.solutions.select(F.col("id").alias("solution_id")).join(t.projects.select("solution_id", "name"), "solution_id")
    return both.groupBy(F.col("solution_id").alias("path")).agg(F.min("name").alias("name"), F.bool_or(navigate.holds("name", "an")).alias("picked"))


def _early_fan_in(t: Tables) -> DataFrame:
    return graph.row_fan_in(t.stored("symbols"), t.early_calls, t.early_inheritance, t.stored("thin_accesses"), t.early_uses)


_SOFT_FROM = 3


def _decided(t: Tables, soft: bool = False) -> DataFrame:
    """The cascade over the thin graphs, with the fan-in of an earlier scan."""
    edges = t.stored("soft_edges").where(f"confidence >= {_SOFT_FROM} and trim(source) <> ''").select("source", "target") if soft else None
    if "fan_in" not in t._stored:
        t._stored["fan_in"] = kept(_early_fan_in(t))
    return isolation.cascade(t.stored("symbols"), t.projects, t._stored["fan_in"], t.stored("thin_calls"), t.stored("inheritance"), t.stored("type_uses"), edges)


_UI = "regexp_matches(regexp_extract(coalesce({0}, ''), '[^.]*$'), '(Form|Control|Dialog|Window|Page|View|Panel)$|^Form')"
_TYPE_RULE = r"""case when regexp_extract(name, '[^.]*$') in ('App', 'Program', 'Startup') then 'dotnet.host_entry_type'
    when regexp_matches(name, '(Controller|Middleware|ActionFilter)$') and regexp_matches(p, '\\(controllers|middleware|filters)\\') then 'aspnet.convention_type'
    when ends_with(name, 'Module') then 'di.module_type' when ends_with(name, 'Converter') then 'serialization.converter_type'
    when regexp_matches(name, '(Behavior|Extension|Extensions|ExtensionMethods)$') then 'dotnet.extension_or_behavior_type' end"""
_METHOD_RULES = r"""[
    case when low in ('main', 'mainasync', 'dispose') or regexp_matches(f, '[.](dispose|wndproc|initializecomponent)[(]') then 'dotnet.lifecycle_method' end,
    case when low in ('onstartup', 'oninitialize', 'onactivated', 'onapplytemplate', 'onframeworkinitializationcompleted', 'render', 'drawitem', 'ondrawitem', 'onrender', 'onupdate', 'onpointerpressed', 'onpointermoved', 'onpointerreleased', 'onkeydown', 'onkeyup', 'ontextinput', 'onloaded', 'onselectionchanged', 'onviewmodelpropertychanged') then 'ui.lifecycle_or_render_callback' end,
    case when low in ('render', 'drawitem', 'onupdate') and regexp_matches(ct, '(renderer|shape|annotation|control|tool)$') then 'ui.render_callback' end,
    case when regexp_matches(p, '[.]a?xaml[.]cs$') and starts_with(name, 'On') then 'xaml.codebehind_callback' end,
    case when z.containing_type is not null and regexp_matches(p, '[.]a?xaml[.]cs|\\(views|controls)\\') and regexp_matches(name, '^On.*(Requested|Changed|Activated|Selected)$') then 'xaml.partial_event_handler' end,
    case when ends_with(low, 'propertychanged') and contains(f, '(dependencyobject, dependencypropertychangedeventargs)') then 'xaml.dependency_property_callback' end,
    case when @OWNER@ and contains(f, '(object,') and regexp_matches(f, 'eventargs[),]|[(]object, system[.](windows[.]forms|componentmodel)[.]') then 'ui.event_handler_signature' end,
    case when @OWNER@ and regexp_matches(f, '_(click|load|changed|tick|shown|checkedchanged|selectedindexchanged|textchanged|valuechanged|formclosed|formclosing|resize|paint|dragdrop|dragenter|keydown|keyup|keypress|dowork|runworkercompleted|progresschanged|mouseup|mousedown|mousemove|doubleclick|afterselect|cellcontentclick|elapsed)[(]') then 'ui.event_handler_name' end,
    case when regexp_matches(f, '[.](onpaint|onload|onshown|onclosing|onclosed)[(]') then 'ui.lifecycle_method' end,
    case when low = 'receive' and (regexp_matches(f, '[.]messages[.]|message[),]') or z.containing_type in (select derived from inheritance where contains(lower(base), 'irecipient')) or (sib.n >= 2 and sib.msg)) then 'mvvm.message_recipient'
         when starts_with(low, 'handle') and regexp_matches(ct, '(behavior|adapter)$') then 'mvvm.behavior_callback'
         when ends_with(ct, 'viewmodel') and low <> '' and exists (select 1 from symbols c where c.kind in ('field', 'property') and c.containing_type = z.containing_type and lower(c.name) in (z.low || 'command', z.low || '_command')) then 'mvvm.command_method' end,
    case when low in ('invoke', 'invokeasync') and (ends_with(ct, 'middleware') or regexp_matches(p, '\\middleware\\')) then 'aspnet.middleware_invoke'
         when starts_with(low, 'use') and regexp_matches(ct, '(extensions|middleware)$') then 'aspnet.pipeline_extension'
         when low in ('configure', 'configureservices') and ct = 'startup' then 'aspnet.startup_method'
         when low in ('onactionexecuting', 'onactionexecuted') and (ends_with(ct, 'filter') or regexp_matches(p, '\\(controllers|filters)\\')) then 'aspnet.action_filter_callback'
         when regexp_matches(p, '\\controllers\\') and ends_with(ct, 'controller') and lower(accessibility) = 'public' then 'aspnet.controller_action'
         when starts_with(low, 'map') and (regexp_matches(ct, '(endpoint|endpoints|extensions)$') or regexp_matches(p, '\\endpoints\\')) then 'aspnet.endpoint_mapping'
         when starts_with(low, 'create') and regexp_matches(ct, '(webserver|host|builder)$') then 'dotnet.host_builder_factory' end,
    case when low = 'load' and ends_with(ct, 'module') then 'di.module_load' when low in ('configure', 'configureservices') then 'di.service_configuration' end,
    case when low in ('convert', 'convertback') then 'ui.value_converter' when regexp_matches(ct, '(converter|contractresolver)$') and low in ('readjson', 'writejson', 'canconvert', 'createproperty', 'createdictionarycontract', 'createcontract') then 'serialization.callback_method' end,
    case when z.containing_type is not null and starts_with(fqn, z.containing_type || '.') and contains(split_part(substr(fqn, length(z.containing_type) + 2), '(', 1), '.') then 'dotnet.explicit_interface_implementation' end]"""
_SUPPRESS = "[" + ", ".join(f"'{r}'" for r in ("synthetic.xaml", "synthetic.lambda", "synthetic.framework_method", "dotnet.host_entry_type", "dotnet.lifecycle_method", "dotnet.explicit_interface_implementation", "dotnet.extension_or_behavior_type", "dotnet.host_builder_factory", "aspnet.convention_type", "aspnet.middleware_invoke", "aspnet.pipeline_extension", "aspnet.startup_method", "aspnet.action_filter_callback", "aspnet.controller_action", "aspnet.endpoint_mapping", "di.module_type", "di.module_load", "di.service_configuration", "serialization.converter_type")) + "]"
_CASCADE = f"""fan as ({_EARLY}), z as (select s.*, lower(s.name) as low, lower(s.fqn) as f, lower(coalesce(s.file_path, '')) as p, lower(regexp_extract(coalesce(s.containing_type, ''), '[^.]*$')) as ct, fan.fan_in from symbols s join fan on fan.fqn = s.fqn),
    sib as (select containing_type, count(*) as n, bool_or(regexp_matches(f, '[.]messages[.]|message[),]')) as msg from z where kind = 'method' and low = 'receive' group by 1),
    r as (select z.*, list_filter(case when kind in ('xaml', 'lambda', 'framework_method') then ['synthetic.' || kind] when kind in ('class', 'interface') then [{_TYPE_RULE}] when kind = 'method' then {_METHOD_RULES.replace("@OWNER@", _UI.format("z.containing_type"))} else [] end, lambda x: x is not null) as rules
    from z left join sib on sib.containing_type = z.containing_type where fan_in = 0),
    d as (select r.fqn, r.kind, r.loc, r.file_path, r.containing_type, r.rules, case when list_has_any(r.rules, {_SUPPRESS}) then 'suppressed_by_rule'
    when coalesce(pr.is_test_project, false) or regexp_matches(f || ' ' || p, '[.](unittest|tests|test)[.]|(unittest|tests|test)\\\\|\\\\(integrationtests|livetests|browser[.]tests)\\\\') then 'test_artifact'
    when r.fqn in (select callee from thin_calls) then 'called' @SOFT@
    when r.fqn in (select target from type_uses) then 'used_as_type'
    when r.kind = 'constructor' and ({_UI.format("r.containing_type")} or coalesce(r.containing_type in (select target from type_uses), false)) then 'constructor_of_used_type'
    when r.kind in ('class', 'interface') and r.fqn in (select m.containing_type from z m where m.containing_type is not null and (m.fan_in > 0 or m.fqn in (select callee from thin_calls))) then 'live_members'
    when r.kind in ('class', 'interface') and r.fqn in (select base from inheritance) then 'has_derived'
    when r.kind in ('class', 'interface') and ({_UI.format("r.name")} or contains(regexp_extract(coalesce(r.file_path, ''), '[^/\\\\]*$'), '.Designer.')) then 'ui_type' when contains(f, 'main(') then 'entry_point'
    when r.kind = 'method' and (regexp_matches(r.fqn, '[.](get|set)$') or r.name in ('get', 'set', 'add', 'remove')) then 'accessor' end as drop_reason from r left join projects pr on pr.id = r.project_id)"""
_SOFT_INTO = f"(select * from soft_edges where confidence >= {_SOFT_FROM} and trim(source) <> '')"
_HARD = _CASCADE.replace("@SOFT@", "")
_SOFT = _CASCADE.replace("@SOFT@", f"when r.fqn in (select target from {_SOFT_INTO}) then 'soft_called'")


@query(f"with {_HARD} select fqn, unnest(rules) as rule from d")
def convention_rules(t: Tables) -> DataFrame:
    return _decided(t).select("fqn", F.explode("rules").alias("rule"))


@query(f"with {_HARD} select fqn, kind, loc, drop_reason from d")
def isolation_drop_reason(t: Tables) -> DataFrame:
    return _decided(t).select("fqn", "kind", "loc", "drop_reason")


@query(f"with {_HARD} select fqn, kind, loc from d where drop_reason is null")
def isolation_candidates(t: Tables) -> DataFrame:
    return _decided(t).where("drop_reason is null").select("fqn", "kind", "loc")


@query(f"""with {_HARD}, e as (select unnest(rules) as rule, coalesce(drop_reason = 'suppressed_by_rule', false) as gone from d), c as (select *, case when list_contains({_SUPPRESS}, rule) then 'suppress' else 'label' end as policy from e)
    select policy, rule, count(*) as n, split_part(rule, '.', 1) as family from c where gone = (policy = 'suppress') group by 1, 2""")
def rule_suppression_counts(t: Tables) -> DataFrame:
    return isolation.rule_counters(_decided(t))


@query(f"with {_SOFT} select fqn, drop_reason from d")
def isolation_soft(t: Tables) -> DataFrame:
    return _decided(t, soft=True).select("fqn", "drop_reason")


@query(f"""with {_SOFT} select d.fqn, d.kind, array_to_string(list_sort(list_distinct(list(s.source)))[:8], ';') as sources, array_to_string(list_sort(list_distinct(list(s.type)))[:8], ';') as edge_types, count(*) as edge_count
    from d join {_SOFT_INTO} s on s.target = d.fqn where d.drop_reason = 'soft_called' group by 1, 2""")
def isolation_soft_suppressed(t: Tables) -> DataFrame:
    soft = t.stored("soft_edges").where(f"confidence >= {_SOFT_FROM} and trim(source) <> ''")
    return isolation.soft_suppressed(_decided(t, soft=True), soft).withColumns({"sources": F.array_join("sources", ";"), "edge_types": F.array_join("edge_types", ";")})


@query(f"with {_HARD} select fqn from d where drop_reason is null and fqn in (select target from {_SOFT_INTO})")
def isolation_compare(t: Tables) -> DataFrame:
    hard, soft = _decided(t).where("drop_reason is null"), _decided(t, soft=True).where("drop_reason is null")
    return hard.join(soft, "fqn", "left_anti").select("fqn")


_SIGNAL_SQL = {
    "callers": ("callee", "thin_calls", "caller"), "type_users": ("target", "type_uses", "source"), "field_users": ("target", "thin_accesses", "accessor"), "derived_types": ("base", "inheritance", "derived"),
    "callees": ("caller", "thin_calls", "callee"), "used_types": ("source", "type_uses", "target"), "used_fields": ("accessor", "thin_accesses", "target"),
}
_SIGNALS = ", ".join(f"(select count(distinct {other}) from {table} where {node} = c.fqn) as {s}" for s, (node, table, other) in _SIGNAL_SQL.items()) + ", case when c.containing_type is null then 0 else (select count(distinct source) from type_uses where target = c.containing_type) end as containing_type_users"


@query(f"with {_HARD} select c.fqn, {_SIGNALS} from d c where c.drop_reason is null")
def isolation_signals(t: Tables) -> DataFrame:
    found = isolation.signals(_decided(t).where("drop_reason is null"), _graphs(t))
    return found.select("fqn", *isolation.SIGNALS, "containing_type_users")


def _rule_maps(t: Tables) -> dict[str, DataFrame]:
    g = _graphs(t)
    return {"call": graph.rule_counts(g["call"][0]), "type": graph.rule_counts(g["type_dependency"][0], "source", "target")}


@query(f"""with {_HARD}, k as (select fqn from d where drop_reason is null), n as (select 'call' as g, * from ({_rule_counts_sql(_simple("thin_calls"), "caller", "callee")}) union all select 'type', * from ({_rule_counts_sql(_simple("type_uses", "source", "target", "type"), "source", "target")}))
    select g || '_' || direction || 'bound' as bucket, attribute, value, cast(sum(n) as bigint) as n from n where node in (select fqn from k) group by 1, 2, 3""")
def isolation_rule_summary(t: Tables) -> DataFrame:
    return isolation.rule_summary(_decided(t).where("drop_reason is null"), _rule_maps(t))


def _explained(t: Tables, related: DataFrame | None = None) -> DataFrame:
    found = isolation.signals(_decided(t).where("drop_reason is null"), _graphs(t))
    maps = _rule_maps(t)
    types = graph.type_counts(graph.marked(_graphs(t)["call"][0], t.stored("symbols"))).select("node", "direction", F.lit("type").alias("attribute"), F.col("type").alias("value"), "n")
    found = found.join(isolation.count_maps(maps["call"].union(types), "fqn", "call"), "fqn", "left").join(isolation.count_maps(maps["type"], "fqn", "type"), "fqn", "left")
    return found if related is None else found.join(related, "fqn", "left")


_MISSING = """array_to_string(list_filter([case when callers = 0 then 'no callers' end, case when type_users = 0 then 'no type users' end, case when field_users = 0 and kind in ('field', 'property') then 'no field readers/writers' end,
    case when derived_types = 0 and kind in ('class', 'interface') then 'no derived types' end, case when containing_type_users = 0 and kind = 'constructor' then 'owning type has no detected type users' end], lambda x: x is not null), '; ')"""


def _touch_sql(table: str, node: str, label: str) -> str:
    return f"(select '{label} touch ' || string_agg(distinct trim(rule_family), ', ' order by trim(rule_family)) from {table} where {node} = c.fqn and trim(rule_family) <> '')"


_TOUCHES = f"""array_to_string(list_filter([{_touch_sql(_simple("thin_calls"), "callee", "inbound calls")}, {_touch_sql(_simple("thin_calls"), "caller", "outbound calls")},
    {_touch_sql(_simple("type_uses", "source", "target", "type"), "target", "inbound type usage")}, {_touch_sql(_simple("type_uses", "source", "target", "type"), "source", "outbound type usage")}], lambda x: x is not null), '; ')"""


@query(f"""with {_HARD}, e as (select c.*, {_SIGNALS}, {_TOUCHES} as touches from d c where c.drop_reason is null), m as (select *, {_MISSING} as missing from e)
    select fqn, case when missing = '' then 'no inbound structural references' else missing end || case when touches <> '' then '; framework context: ' || touches else '' end as why from m""")
def isolation_explained(t: Tables) -> DataFrame:
    return isolation.explained(_explained(t)).select("fqn", "why")


_NORMAL = "(select trim(source) as source, trim(target) as target, case when trim(type) = '' then 'ai_soft_edge' else trim(type) end as type, confidence, evidence, ordinal, case when trim(source) = '' or trim(target) = '' then 'missing endpoint' when confidence > 1 or confidence < 0 then 'confidence out of range' end as error from soft_edges)"


def _soft(t: Tables) -> DataFrame:
    """Soft edges with their evidence as a list."""
    return t.soft_edges.withColumn("evidence", F.when(F.col("evidence").isNotNull(), F.array("evidence")).otherwise(F.array().cast("array<string>")))


@query(f"select * exclude (evidence), case when evidence is null then 0 else 1 end as n_evidence from {_NORMAL}")
def soft_edge_normalize(t: Tables) -> DataFrame:
    return soft_edges.normalize(_soft(t)).withColumn("n_evidence", F.size("evidence")).drop("evidence")


@query(f"select source, target, type, arg_max(ordinal, (ordinal % 2) * 100000000 + ordinal) as ordinal from {_NORMAL} group by 1, 2, 3")
def soft_edge_merge(t: Tables) -> DataFrame:
    n = soft_edges.normalize(_soft(t))
    return soft_edges.merge(n.where("ordinal % 2 = 0"), n.where("ordinal % 2 = 1")).select(*soft_edges.KEY, "ordinal")


@query(f"""select type, count(*) as n, count(*) filter (confidence is null) as no_confidence, count(*) filter (confidence < 0.5) as low_confidence, min(confidence) as least, max(confidence) as greatest, count(*) filter (evidence is null) as no_evidence,
    count(*) filter (source = '') as no_source, count(*) filter (target = '') as no_target, count(*) - count(distinct (source, target)) as repeated from {_NORMAL} group by 1""")
def soft_edge_quality(t: Tables) -> DataFrame:
    return soft_edges.quality(_soft(t))


@query(f"""with n as (select *, row_number() over (partition by source, target, type order by ordinal) as k, source || ' -> ' || target as ends from {_NORMAL}), w as (select ordinal, list_filter([case when k > 1 then 'Duplicate edge: ' || ends || ' (' || type || ')' end,
    case when confidence is null then 'Confidence missing for: ' || ends when confidence < 0.5 then 'Low confidence for: ' || ends end, case when evidence is null then 'Evidence empty for: ' || ends end], lambda x: x is not null) as l from n)
    select ordinal, unnest(l) as warning, cast(generate_subscripts(l, 1) - 1 as int) as place from w""")
def soft_edge_warnings(t: Tables) -> DataFrame:
    return soft_edges.warnings(_soft(t)).withColumn("warning", F.regexp_replace("warning", r"^Low confidence \([^)]*\)", "Low confidence"))


@query("select source, target, type, coalesce(confidence, 0) as confidence, ordinal from soft_edges order by 4 desc, 1, 2, 5 limit 50")
def soft_edge_rank(t: Tables) -> DataFrame:
    """The list of the fifty surest edges."""
    return soft_edges.ranked(t.soft_edges, 50).drop("evidence")


@query(f"with {_SOFT} select count(distinct fqn) as n, array_to_string(list_sort(list_distinct(list(fqn))), ' ') as fqns from d where drop_reason is null")
def isolation_snapshot(t: Tables) -> DataFrame:
    return soft_edges.snapshot(_decided(t, soft=True).where("drop_reason is null")).withColumn("fqns", F.array_join("fqns", " "))


_DSL_OPS = {
    "eq": ("Load", "name = 'Load'"),
    "neq": ("Load", "name <> 'Load'"),
    "in": (["Load", "Render"], "name in ('Load', 'Render')"),
    "contains": ("oad", "contains(name, 'oad')"),
    "prefix": ("On", "starts_with(name, 'On')"),
    "suffix": ("et", "ends_with(name, 'et')"),
    "regex": ("^(On|Get)[A-Z]", "regexp_matches(name, '^(On|Get)[A-Z]')"),
}


def _dsl_operator(op: str, value: object, sql: str) -> None:
    def run(t: Tables) -> DataFrame:
        records = dsl.symbol_records(t.symbols.select("fqn", "name", "kind"))
        return records.where(dsl.condition(dsl.Condition("name", op, value), F.col("rec"))).select(F.element_at("rec", F.lit("fqn")).alias("fqn"))

    run.__name__ = f"dsl_op_{op}"
    query(f"select fqn from symbols where {sql}")(run)


for _op, (_value, _sql) in _DSL_OPS.items():
    _dsl_operator(_op, _value, _sql)


@query("select call_id from invocations where generic_arg is not null")
def dsl_op_exists(t: Tables) -> DataFrame:
    """`exists` over records of which some lack the key."""
    records = _invocation_records(t)
    return records.where(dsl.condition(dsl.Condition("invocation.generic_arg[0]", "exists"), F.col("rec"))).select(F.element_at("rec", F.lit("call_id")).alias("call_id"))


def _invocation_records(t: Tables) -> DataFrame:
    made = dsl.invocation_records(t.invocations.withColumn("method_fqn", F.col("call_id")))
    return made.withColumn("rec", F.map_concat("rec", F.create_map(F.lit("call_id"), F.element_at("rec", F.lit("method.fqn")))))


_RULE = """{{"id": "di.{id}", "scope": {{"source": "csharp_invocation", "target": "csharp_symbol"}}, "match": {{"where": [{{"field": "method.name", "op": "in", "value": {names}}}, {{"field": "invocation.generic_arg[0]", "op": "exists"}}]}},
    "bind": {{"service_type": "$invocation.generic_arg[0]", "way": "asked"}}, "resolve": {{"target": {{"kind": "{kind}", "where": [{{"field": "{field}", "op": "{op}", "value": "$service_type"}}]}}}},
    "emit": {{"edge_kind": "{edge}", {call} "rule_id": "di.{id}", "rule_family": "di", "rule_mode": "candidate"}}}}"""
RULES = [
    dsl.parse(_RULE.format(id="resolve_suffix", names='["Resolve"]', kind="method", field="containing_type", op="suffix", edge="candidate_call", call='"call_type": "resolve_dispatch",')),
    dsl.parse(_RULE.format(id="service_type", names='["GetService", "GetRequiredService"]', kind="class", field="name", op="eq", edge="candidate_type_dependency", call="")),
    dsl.parse(_RULE.format(id="member", names='["GetRequiredService"]', kind="constructor", field="fqn", op="contains", edge="candidate_call", call="")),
]
_EMIT = """(select distinct i.fqn as source_fqn, s.fqn as target_fqn, 'resolve_dispatch' as type, 'di.resolve_suffix' as rule_id, 'di' as rule_family, 'candidate' as rule_mode from invocations i join symbols s on s.kind = 'method' and ends_with(s.containing_type, i.generic_arg) where i.method_name = 'Resolve'
    union all select distinct i.fqn, s.fqn, 'candidate_type_dependency', 'di.service_type', 'di', 'candidate' from invocations i join symbols s on s.kind = 'class' and s.name = i.generic_arg where i.method_name in ('GetService', 'GetRequiredService')
    union all select distinct i.fqn, s.fqn, 'calls', 'di.member', 'di', 'candidate' from invocations i join symbols s on s.kind = 'constructor' and contains(s.fqn, i.generic_arg) where i.method_name = 'GetRequiredService')"""
_EDGE = "source_fqn, target_fqn, type, rule_id, rule_family, rule_mode"


def _records(t: Tables) -> DataFrame:
    return dsl.symbol_records(t.symbols.select("fqn", "name", "kind", "containing_type")).union(dsl.invocation_records(t.invocations))


def _emitted(t: Tables) -> DataFrame:
    return dsl.emitted(RULES, _records(t))[0]


@query("select fqn as source_fqn, name, case name when 'way' then 'asked' else generic_arg end as value from invocations, (values ('way'), ('service_type')) v(name) where method_name = 'Resolve' and generic_arg is not null")
def dsl_bind(t: Tables) -> DataFrame:
    return dsl.bindings(RULES[0], _records(t))


@query(f"select {_EDGE} from {_EMIT} where type = 'resolve_dispatch'")
def dsl_resolve_suffix(t: Tables) -> DataFrame:
    return dsl.run(RULES[0], _records(t)).drop("diagnostic")


@query(f"select {_EDGE} from {_EMIT} where rule_id = 'di.service_type'")
def dsl_resolve_equi(t: Tables) -> DataFrame:
    return dsl.run(RULES[1], _records(t)).drop("diagnostic")


@query(f"select {_EDGE} from {_EMIT} where type <> 'candidate_type_dependency'")
def dsl_emit_calls(t: Tables) -> DataFrame:
    return _emitted(t).where("type <> 'candidate_type_dependency'")


@query(f"select {_EDGE} from {_EMIT} where type = 'candidate_type_dependency'")
def dsl_emit_types(t: Tables) -> DataFrame:
    return _emitted(t).where("type = 'candidate_type_dependency'")


@query("""select 'missing_source_fqn' as diagnostic, count(distinct s.fqn) as n from invocations i join symbols s on s.kind = 'class' and s.name = i.generic_arg where i.method_name in ('GetService', 'GetRequiredService') and i.argument_count = 0""")
def dsl_diagnostics(t: Tables) -> DataFrame:
    """Rows that lack an end: here the callers of calls without arguments are blank."""
    blank = t.invocations.withColumn("fqn", F.when(F.col("argument_count") == 0, " ").otherwise(F.col("fqn")))
    records = dsl.symbol_records(t.symbols.select("fqn", "name", "kind", "containing_type")).union(dsl.invocation_records(blank))
    return dsl.emitted([RULES[1]], records)[1].groupBy("diagnostic").agg(F.count("*").alias("n"))


@query(f"select e.source_fqn, e.target_fqn, e.rule_id from {_EMIT} e join symbols a on a.fqn = e.source_fqn join symbols b on b.fqn = e.target_fqn")
def dsl_persisted(t: Tables) -> DataFrame:
    return dsl.persisted(_emitted(t), t.symbols).select("source_fqn", "target_fqn", "rule_id")


_MAP = "(select distinct b.fqn as base, o.fqn as override from inheritance i join methods b on b.containing_type = i.base join methods o on o.containing_type = i.derived and o.name = b.name and o.fqn <> b.fqn)"


@query(f"select base, override from {_MAP}")
def dispatch_map(t: Tables) -> DataFrame:
    return graph.dispatch_map(t.inheritance, t.methods)


@query(f"select distinct c.caller, m.override as callee, 'dynamic_dispatch' as call_type from method_calls c join {_MAP} m on m.base = c.callee")
def dynamic_dispatch_expand(t: Tables) -> DataFrame:
    return graph.dispatch_targets(t.method_calls, t.inheritance, t.methods)


_UNRESOLVED = "(select fqn as caller, containing_type, name as method_name, k % 5 as argument_count from methods)"


@query(f"""with c as (select u.caller, m.fqn as callee, m.parameter_count = u.argument_count as exact, max(m.parameter_count = u.argument_count) over (partition by u.caller, u.method_name, u.argument_count) as any_exact from {_UNRESOLVED} u join methods m on m.containing_type = u.containing_type and m.name = u.method_name)
    select distinct caller, callee, 'calls_fallback' as call_type from c where exact or not any_exact""")
def fallback_targets(t: Tables) -> DataFrame:
    m = t.methods
    return graph.fallback_targets(m.select(F.col("fqn").alias("caller"), "containing_type", F.col("name").alias("method_name"), F.expr("k % 5").alias("argument_count")), m)


@query(f"""select m.base as caller, m.override as callee, 'override_dispatch' as call_type, cast(1 as bigint) as call_count, cast(null as string) as kind, cast(null as string) as containing_type from {_MAP} m
    union all select 'System.IDisposable.Dispose()', fqn, 'override_dispatch', 1, null, null from methods where name = 'Dispose'
    union all select 'System.IDisposable.Dispose()', 'Dispose', null, null, 'framework_method', 'System.IDisposable' where (select count(*) from methods where name = 'Dispose') > 0""")
def override_dispatch(t: Tables) -> DataFrame:
    """Edges from overridden methods, and a symbol for the one that is none yet."""
    outer = t.methods.where("name = 'Dispose'").select(F.lit("System.IDisposable.Dispose()").alias("base"), F.col("fqn").alias("override"))
    edges, made = graph.override_edges(graph.dispatch_map(t.inheritance, t.methods).union(outer), t.symbols)
    none = lambda *cs: [F.lit(None).cast("string").alias(c) for c in cs]
    return edges.select("caller", "callee", "call_type", "call_count", *none("kind", "containing_type")).union(made.select(F.col("fqn").alias("caller"), F.col("name").alias("callee"), F.lit(None).cast("string"), F.lit(None).cast("long"), "kind", "containing_type"))


_LAMBDAS = "(select fqn, containing_type || '.Outer()' as enclosing from methods where kind = 'lambda')"


@query(f"""select caller, callee, call_type, call_count, rule_id from thin_calls union all select l.enclosing, c.callee, case when c.call_type = 'calls' then 'lambda_dispatch' else c.call_type end, c.call_count, null from thin_calls c join {_LAMBDAS} l on l.fqn = c.caller""")
def lambda_promotion(t: Tables) -> DataFrame:
    lambdas = t.methods.where("kind = 'lambda'").select("fqn", F.concat("containing_type", F.lit(".Outer()")).alias("enclosing"))
    return graph.promote_lambdas(t.thin_calls, lambdas).select("caller", "callee", "call_type", "call_count", "rule_id")


def _token_sql(c: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower(regexp_replace(replace({c}, '::', '.'), '([^.])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda y: y <> ''))"


# two capitals in a row need the replacement twice, as a match takes the letter before
_TOKENS = lambda c: _token_sql(f"regexp_replace(replace({c}, '::', '.'), '([^.])([A-Z])', '\\1_\\2', 'g')")


@query(f"""with x as (select kind, list_sort({_TOKENS('name')}) as k from symbols), c as (select kind, k, array_to_string(k, ' ') as id, count(*) as n from x where len(k) > 0 group by 1, 2),
    p as (select a.kind, a.id as a, b.id as b, a.n as n_a, b.n as n_b, len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k)))::double as s from c a join c b on a.kind = b.kind and a.id < b.id) select kind, a, b, n_a, n_b, round(s, 4) as score from p where s >= 0.6""")
def name_token_jaccard(t: Tables) -> DataFrame:
    return similarity.token_pairs(t.symbols)


_FEATURE_SQL = {
    "callers": ("thin_calls", "callee", "caller", 0.18), "callees": ("thin_calls", "caller", "callee", 0.18), "bases": ("inheritance", "derived", "base", 0.08), "derived": ("inheritance", "base", "derived", 0.08),
    "type_users": ("type_uses", "target", "source", 0.16), "used_types": ("type_uses", "source", "target", 0.16), "field_users": ("thin_accesses", "target", "accessor", 0.08), "used_fields": ("thin_accesses", "accessor", "target", 0.08),
}
_PAIRS = " union ".join(f"select '{f}' as feature, {node} as node, {other} as other, {w}::double as w from {table}" for f, (table, node, other, w) in _FEATURE_SQL.items())


@query(f"""with e as ({_PAIRS}), n as (select feature, node, count(*) as n from e group by 1, 2), s as (select a.node as source, b.node as fqn, a.feature, a.w, count(*) as k from e a join e b on a.feature = b.feature and a.other = b.other and a.node <> b.node where a.node in (select fqn from symbols where kind = 'constructor') group by 1, 2, 3, 4)
    select s.source, s.fqn, round(sum(k / (x.n + y.n - k)::double * w), 4) as score from s join n x on x.feature = s.feature and x.node = s.source join n y on y.feature = s.feature and y.node = s.fqn group by 1, 2""")
def graph_similarity(t: Tables) -> DataFrame:
    """All constructors against all nodes."""
    return similarity.graph_similarity(similarity.feature_sets(_graphs(t)), t.stored("symbols").where("kind = 'constructor'"))


_LISTS = ", ".join(f"(select list_sort(list(distinct {other})) from {table} where {node} = s.fqn) as {f}" for f, (table, node, other, _) in _FEATURE_SQL.items())
_LIKE = lambda a, b: f"(case when len(coalesce({a}, [])) > 0 and len(coalesce({b}, [])) > 0 then len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::double else 0 end)"
_SURE = " + ".join([f"0.35 * {_LIKE('a.tokens', 'b.tokens')}", *[f"case when a.{c} = b.{c} and a.{c}::string <> '' then {w} else 0 end" for c, w in (("kind", 0.2), ("containing_type", 0.2), ("namespace", 0.1), ("project_id", 0.08), ("file_name", 0.08), ("return_type", 0.05), ("parameter_count", 0.05))], *[f"{w} * {_LIKE(f'a.{f}', f'b.{f}')}" for f, (_, _, _, w) in _FEATURE_SQL.items()]])


@query(f"""with s as (select s.fqn, kind, name, containing_type, namespace, project_id, return_type, parameter_count, regexp_extract(file_path, '[^/\\\\]*$') as file_name, {_TOKENS('s.fqn')} as tokens, {_LISTS} from symbols s where kind in ('constructor')),
    p as (select a.fqn as source, b.fqn, b.kind, round(({_SURE})::double, 4) as score from s a join s b on a.fqn <> b.fqn) select *, cast(row_number() over (partition by source order by score desc, fqn) as int) as rank from p qualify rank <= 3""")
def related_topk_no_seqmatch(t: Tables) -> DataFrame:
    """The three most like each constructor, without the shapes of names."""
    s = t.stored("symbols")
    every = s.where("kind = 'constructor'")
    return similarity.related_in_blocks(s, similarity.feature_sets(_graphs(t), nodes=every), every, 3, shapes=False).drop("reasons")


def _near(t: Tables) -> DataFrame:
    """The nearest symbols of the report's first fifty candidates, which is how many the report looks at."""
    first = _decided(t).where("drop_reason is null").orderBy(F.desc("loc"), "fqn").limit(50).select("fqn")
    return similarity.related(t.stored("symbols"), similarity.feature_sets(_graphs(t)), first, 3, least=0.45)


@query()
def related_full(t: Tables) -> DataFrame:
    return _near(t).withColumn("reasons", F.array_join("reasons", "; "))


def _categorised(t: Tables) -> DataFrame:
    best = _near(t).where("rank = 1").select(F.col("source").alias("fqn"), "score", "reasons")
    return _decided(t).where("drop_reason is null").select("fqn", "loc").join(best, "fqn", "left").withColumn("category", isolation.category(F.col("score"), F.col("reasons")))


@query()
def isolation_category(t: Tables) -> DataFrame:
    return _categorised(t).select("fqn", "loc", "category")


@query()
def isolation_categories(t: Tables) -> DataFrame:
    return isolation.category_counts(_categorised(t))


@query()
def suggest_matches(t: Tables) -> DataFrame:
    """Ten names for one that is not known."""
    return similarity.suggest(t.symbols, "Supplier7Modul.Lod", 10)


_NORM = "sqrt(list_inner_product({0}.embedding::double[], {0}.embedding::double[]))"
_PRODUCT = f"round(list_inner_product(v.embedding::double[], w.embedding::double[]) / {_NORM.format('v')} / {_NORM.format('w')}, 9)"
_NEAREST = f"""with p as (select v.vec_id as query_id, w.vec_id, {_PRODUCT} as exact from vectors v join vectors w on w.vec_id <> v.vec_id where v.vec_id % 100 = 0 {{where}}), r as (select *, cast(row_number() over (partition by query_id order by exact desc, vec_id) as int) as rank from p) select query_id, vec_id, round(exact, 4) as score, rank from r where rank <= 20"""


@query(_NEAREST.format(where=""))
def vector_topk(t: Tables) -> DataFrame:
    """The nearest twenty of every vector whose id is divisible by 100."""
    return retrieval.nearest(t.vectors, t.vectors.where("vec_id % 100 = 0"), 20)


@query(_NEAREST.format(where="and w.label = 1"))
def vector_topk_filtered(t: Tables) -> DataFrame:
    return retrieval.nearest(t.vectors, t.vectors.where("vec_id % 100 = 0"), 20, "label = 1")


_ROOTS = "select fqn from symbols where kind in ('constructor', 'class')"
_WALKS = {"call": ("method_calls", "caller", "callee", "Called by", "Calls"), "inheritance": ("inheritance", "derived", "base", "Inherited by", "Inherits"), "type_dependency": ("type_uses", "source", "target", "Used as type by", "Uses type")}


def _walk_sql(i: int, edges: str, frm: str, to: str) -> str:
    return f"w{i}(root, node, k) as (select fqn, fqn, 0 from ({_ROOTS}) union select w{i}.root, e.{to}, k + 1 from w{i} join (select distinct {frm}, {to} from {edges}) e on e.{frm} = w{i}.node where k < 2)"


_STEPS = [(edges, b, a, into) for edges, a, b, into, _ in _WALKS.values()] + [(edges, a, b, out) for edges, a, b, _, out in _WALKS.values()]


@query("with " + ", ".join(_walk_sql(i, e, f, to) for i, (e, f, to, _) in enumerate(_STEPS)) + " " + " union all ".join(f"select distinct root, '{label}: ' || node as context from w{i} where node <> root" for i, (_, _, _, label) in enumerate(_STEPS)))
def bfs_expand(t: Tables) -> DataFrame:
    """What surrounds every constructor and class, two steps far, in the dense graphs."""
    ends = {"call": (t.stored("method_calls"), "caller", "callee"), "inheritance": (t.inheritance, "derived", "base"), "type_dependency": (t.type_uses, "source", "target")}
    return graph.context(ends, t.symbols.where("kind in ('constructor', 'class')").select("fqn"))


ORACLE_SQL["bfs_expand"] = "with recursive " + ORACLE_SQL["bfs_expand"][len("with ") :]


def _listed(pairs: str, node: str, other: str, most: str) -> str:
    return f"(select array_to_string(list_transform(list_sort(list_distinct(list({other}))){most}, lambda x: regexp_extract(x, '[^.]*$')), ', ') from {pairs} where {node} = s.fqn)"


@query(f"""with b as (select s.*, {_listed(_SIMPLE, 'callee', 'caller', '[:3]')} as cin, {_listed(_SIMPLE, 'caller', 'callee', '[:3]')} as cout, {_listed('inheritance', 'derived', 'base', '')} as up, {_listed('inheritance', 'base', 'derived', '[:3]')} as down,
    (select count(*) from {_SIMPLE} where callee = s.fqn) as i, (select count(*) from {_SIMPLE} where caller = s.fqn) as o, array_to_string(list_filter([case when is_async then 'async' end, case when is_static then 'static' end, case when is_abstract then 'abstract' end], lambda x: x is not null), ' ') as flags from symbols s)
    select fqn, concat_ws(chr(10), trim(kind || ' ' || fqn || ' ' || case when accessibility is not null then '[' || accessibility || '] ' else '' end || case when flags <> '' then ' [' || flags || ']' else '' end),
    concat_ws(' | ', 'LOC:' || loc, 'params:' || parameter_count, 'returns:' || return_type), case when i + o > 0 then 'fan_in:' || i || ' | fan_out:' || o end, 'called_by: ' || nullif(cin, ''), 'calls: ' || nullif(cout, ''), 'inherits: ' || nullif(up, ''), 'inherited_by: ' || nullif(down, '')) as summary from b""")
def symbol_summary(t: Tables) -> DataFrame:
    return navigate.summaries(t.symbols, graph.simple_digraph(t.method_calls), t.inheritance)


# texts stand for the C# files of types; real markers are put where frequent words of theirs are
_FILES = """(select t.file_path, t.project_id, replace(replace(replace(d.text, ' the ', ' Activator.CreateInstance '), ' of ', ' .Resolve< '), ' de ', ' services.AddSingleton ') as text from types t join files_text d on d.doc_id = t.k)"""
_MARKER_SQL = {kind: "[" + ", ".join(f"'{m}'" for m in markers) + "]" for kind, markers in candidates.MARKERS.items()}
_HOME = "p.id = f.project_id and not p.is_test_project"


def _texts(t: Tables) -> DataFrame:
    both = t.types.select("k", "file_path", "project_id").join(t.files_text.select(F.col("doc_id").alias("k"), "text"), "k")
    put = F.replace(F.replace(F.replace("text", F.lit(" the "), F.lit(" Activator.CreateInstance ")), F.lit(" of "), F.lit(" .Resolve< ")), F.lit(" de "), F.lit(" services.AddSingleton "))
    return both.select("file_path", "project_id", put.alias("text"))


@query(" union all ".join(f"select '{kind}' as kind, f.file_path, unnest(list_filter({words}, lambda m: contains(f.text, m))) as marker from {_FILES} f join projects p on {_HOME} where lower(f.file_path) like '%.cs'" for kind, words in _MARKER_SQL.items()))
def marker_hits(t: Tables) -> DataFrame:
    found = [candidates.marker_files(_texts(t), t.projects, kind).select(F.lit(kind).alias("kind"), "file_path", F.explode("hits").alias("marker")) for kind in candidates.MARKERS]
    return found[0].union(found[1])


def _focal_sql(kind: str) -> str:
    owners, starts = "|".join(candidates.TYPE_HINTS[kind]), "|".join(candidates.METHOD_HINTS[kind])
    return f"""(select * from (select z.*, cast(row_number() over (partition by file_path order by score desc, loc desc, fan_in, fqn) as int) as rank from (select s.file_path, s.fqn, s.kind, s.loc, fan.fan_in, case when s.kind = 'constructor' then 2 else 0 end + case when fan.fan_in = 0 then 4 when fan.fan_in = 1 then 2 else 0 end
        + case when regexp_matches(lower(regexp_extract(s.containing_type, '[^.]*$')), '{owners}') then 3 else 0 end + case when regexp_matches(lower(s.name), '^({starts})') then 2 else 0 end as score from symbols s join ({_EARLY}) fan on fan.fqn = s.fqn where s.kind in ('method', 'constructor')) z) where rank <= 5)"""


@query(f"select 'di' as hints, file_path, fqn, score, rank from {_focal_sql('di')} union all select 'reflection', file_path, fqn, score, rank from {_focal_sql('reflection')}")
def focal_symbols(t: Tables) -> DataFrame:
    fan = kept(_early_fan_in(t))
    found = [candidates.focal_symbols(t.stored("symbols"), fan, kind).select(F.lit(kind).alias("hints"), "file_path", "fqn", "score", "rank") for kind in ("di", "reflection")]
    return found[0].union(found[1])


def _code_sql(kind: str) -> str:
    types = "(" + ", ".join(f"'{x}'" for x in candidates.DISPATCH_TYPES[kind]) + ")"
    return f"""select '{kind}' as candidate_kind, f.file_path, p.name as project, len(hits) + case when hard = 0 then 3 when hard <= 2 then 1 else 0 end + least(bare, 3) as score, cast(hard as bigint) as hard_edge_count, array_to_string(hits[:8], ' ') as pattern_hits, names as focal
        from (select *, list_filter({_MARKER_SQL[kind]}, lambda m: contains(text, m)) as hits from {_FILES}) f join projects p on {_HOME}
        join (select file_path, sum((select count(*) from {_simple('thin_calls')} where caller = q.fqn and call_type in {types})) as hard, count(*) filter (fan_in = 0) as bare, string_agg(fqn, ' ' order by rank) as names from {_focal_sql(kind)} q group by 1) g on g.file_path = f.file_path
        where lower(f.file_path) like '%.cs' and len(hits) > 0"""


@query(f"{_code_sql('reflection')} union all {_code_sql('di')}")
def ai_candidates(t: Tables) -> DataFrame:
    """Files with markers of reflection and of injection, all of them."""
    fan, s, calls = kept(_early_fan_in(t)), t.stored("symbols"), graph.simple_digraph(t.stored("thin_calls"))
    found = [candidates.code_candidates(_texts(t), t.projects, s, fan, calls, kind) for kind in candidates.MARKERS]
    return found[0].union(found[1]).select("candidate_kind", "file_path", "project", F.col("score").cast("long").alias("score"), "hard_edge_count", F.array_join("pattern_hits", " ").alias("pattern_hits"), F.expr("array_join(transform(focal_symbols, f -> f.fqn), ' ')").alias("focal"))


_EVENTS, _COMMANDS = "('xaml_event', 'xaml_action_binding')", "('xaml_command_binding', 'xaml_navigation')"
_XAML = f"""with x as (select s.fqn as xaml_fqn, p.name as project, s.file_path, s.containing_type, (select count(*) from {_simple('thin_calls')} where caller = s.fqn and call_type in {_EVENTS}) as event_edges, (select count(*) from {_simple('type_uses', 'source', 'target', 'type')} where source = s.fqn and type in {_COMMANDS}) as command_edges,
    (select count(*) from symbols m join ({_EARLY}) f on f.fqn = m.fqn where m.kind = 'method' and m.containing_type = s.containing_type and f.fan_in = 0 and contains(m.fqn, 'EventArgs')) as weak from symbols s join projects p on p.id = s.project_id where s.kind = 'xaml'),
    y as (select *, cast(case when event_edges = 0 then 3 else 0 end + case when command_edges = 0 then 2 else 0 end + least(weak, 5) + case when contains(file_path, chr(92) || 'Shared' || chr(92)) or ends_with(file_path, '.xaml') then 1 else 0 end as bigint) as score from x)"""


@query(f"{_XAML} select xaml_fqn, project, file_path, event_edges, command_edges, least(weak, 10) as weak_handlers, score from y where score > 0")
def xaml_candidates(t: Tables) -> DataFrame:
    calls, uses = graph.simple_digraph(t.thin_calls), graph.simple_digraph(t.type_uses, "source", "target", "type")
    found = candidates.xaml_candidates(t.stored("symbols"), t.projects, kept(_early_fan_in(t)), calls, uses)
    return found.select("xaml_fqn", "project", "file_path", "event_edges", "command_edges", F.size("weak_handlers").cast("long").alias("weak_handlers"), F.col("score").cast("long").alias("score"))


@query(f"""{_XAML}, c as (select 'xaml' as candidate_kind, file_path, score from (select * from y where score > 0 order by score desc, xaml_fqn limit 50) union all select candidate_kind, file_path, score from (select * from ({_code_sql('reflection')}) order by score desc, file_path limit 50)
    union all select candidate_kind, file_path, score from (select * from ({_code_sql('di')}) order by score desc, file_path limit 50)) select * from c order by score desc, candidate_kind, file_path limit 20""")
def ai_candidates_merged(t: Tables) -> DataFrame:
    """The list of the twenty best of all kinds."""
    fan, s, calls = kept(_early_fan_in(t)), t.stored("symbols"), graph.simple_digraph(t.stored("thin_calls"))
    by_kind = {"xaml": candidates.xaml_candidates(s, t.projects, fan, calls, graph.simple_digraph(t.stored("type_uses"), "source", "target", "type"))}
    by_kind |= {kind: candidates.code_candidates(_texts(t), t.projects, s, fan, calls, kind) for kind in candidates.MARKERS}
    return candidates.merged(by_kind, 20).select("candidate_kind", "file_path", F.col("score").cast("long").alias("score"))


@query("""with x as (select page_id, regexp_extract_all(html, '[A-Za-z:-]+="[^"]*"') as l from pages_html), y as (select page_id, generate_subscripts(l, 1) - 1 as ordinal, unnest(l) as pair from x)
    select page_id, cast(ordinal as int) as ordinal, split_part(pair, '=', 1) as attribute, substr(pair, instr(pair, '=') + 2, length(pair) - instr(pair, '=') - 2) as value from y""")
def xaml_attributes(t: Tables) -> DataFrame:
    return markup.attribute_pairs(t.pages_html)


_CUT = """c as (select doc_id, l, pos, greatest(pos - 4, 1) as lo, l[greatest(pos - 4, 1):pos + 4] as w from a), f as (select doc_id, lo, w, list_filter(generate_series(1, len(w)), lambda i: regexp_matches(w[i], '[^ \\t\\n\\r\\f\\v]')) as full_at from c)
    select doc_id, cast(lo + full_at[1] - 1 as int) as line_start, cast(lo + full_at[-1] - 1 as int) as line_end, array_to_string(w[full_at[1]:full_at[-1]], chr(10)) as snippet from f where len(full_at) > 0"""


@query("with t as (select doc_id, string_split(text, chr(10)) as l from files_text where text <> ''), a as (select doc_id, l, coalesce(nullif(list_position(list_transform(l, lambda z: contains(z, 'License')), true), 0), 1) as pos from t), " + _CUT)
def snippets(t: Tables) -> DataFrame:
    """Around the first line that holds a marker, else around the first line."""
    return navigate.snippets(t.files_text, "License")


@query("""with t as (select doc_id, string_split(text, chr(10)) as l, least(doc_id % 7 + 1, len(string_split(text, chr(10)))) as base from files_text where text <> ''),
    h as (select doc_id, l, list_sort(list_transform(list_filter(generate_series(1, len(l)), lambda i: contains(l[i], 'tion ') and abs(i - base) <= 50), lambda i: {'far': abs(i - base), 'above': case when i < base then 1 else 0 end, 'i': i})) as found from t),
    a as (select doc_id, l, found[1].i as pos from h where len(found) > 0), """ + _CUT)
def focal_snippets(t: Tables) -> DataFrame:
    """Around the line that holds a name, nearest to where it should be."""
    asked = t.files_text.select("doc_id", "text", F.lit("get_tion ").alias("name"), F.lit(None).cast("string").alias("containing_type"), F.expr("cast(doc_id % 7 + 1 as int)").alias("line_start"))
    return navigate.focal_snippets(asked).select("doc_id", "line_start", "line_end", "snippet")


@query("select doc_id, len(string_split(text, chr(10))) as loc from files_text where text is not null")
def line_counts(t: Tables) -> DataFrame:
    return t.files_text.where("text is not null").select("doc_id", text.line_count(F.col("text")).cast("long").alias("loc"))


@query("select doc_id, contains(body, 'Task.Run') as has_task_spawn, contains(body, '.Result') or contains(body, '.Join(') as has_blocking_wait, contains(body, 'new Thread(') as has_thread_start from (select doc_id, replace(replace(replace(text, ' the ', ' Task.Run '), ' of ', ' x.Result '), ' de ', ' new Thread( ') as body from files_text where text is not null)")
def thread_flags(t: Tables) -> DataFrame:
    """Texts that stand for method bodies."""
    put = F.replace(F.replace(F.replace("text", F.lit(" the "), F.lit(" Task.Run ")), F.lit(" of "), F.lit(" x.Result ")), F.lit(" de "), F.lit(" new Thread( "))
    return navigate.thread_flags(t.files_text.where("text is not null").select("doc_id", put.alias("body"))).select("doc_id", "has_task_spawn", "has_blocking_wait", "has_thread_start")


_STATEMENTS = "case when {k} % 6 = 0 then 'x.' || {n} || ' = 1' when {k} % 6 = 1 then {n} || ' += 2' when {k} % 6 = 2 then 'f(out ' || {n} || ')' when {k} % 6 = 3 then '++this.' || {n} when {k} % 6 = 4 then 'f(ref ' || {n} || ')' else {n} || ' == ' || {n} || 'x' end"


@query("select fqn, case k % 6 when 0 then 'write' when 2 then 'write' when 5 then 'read' else 'read_write' end as access_kind from fields")
def access_kinds(t: Tables) -> DataFrame:
    """Statements that use a field."""
    rows = t.fields.withColumn("statement", F.expr(_STATEMENTS.format(k="k", n="name")))
    return rows.select("fqn", text.access_kind(F.col("statement"), F.col("name")).alias("access_kind"))


# -- the store, files and markup: what is written is read back and compared with SQL over the tables it came from --


def _folder(t: Tables) -> Path:
    """A folder of its own below the shared one, for files that the driver writes."""
    at = Path(shared_folder(t.spark).removeprefix("file://").removeprefix("file:")) / f"loomgraph-{uuid.uuid4().hex}"
    at.mkdir(parents=True)
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


def _store(t: Tables) -> Store:
    """A store with the methods and types of the bound tables as symbols."""
    s = Store(t.spark, str(_folder(t)))
    s.save_symbols(t.stored("symbols").withColumn("ordinal", F.lit(0).cast("long")).withColumn("document_id", F.col("file_path")))
    return s


@query("""select fqn, arg_max(name, ordinal) as name, arg_max(project_id, ordinal) as project_id, arg_min(namespace, ordinal) filter (namespace is not null) as namespace, arg_min(return_type, ordinal) filter (return_type is not null) as return_type, sha256(fqn) as id,
    cast(min(line_start) as int) as line_start, cast(max(line_end) as int) as line_end, cast(sum(loc) as bigint) as loc, cast(case when count(*) > 1 then max(coalesce(parameter_count, 0)) else max(parameter_count) end as int) as parameter_count, bool_or(is_async) as is_async from arrivals group by fqn""")
def store_symbols(t: Tables) -> DataFrame:
    """Arrivals merged in two steps."""
    s = Store(t.spark, str(_folder(t)))
    a = t.stored("arrivals")
    s.save_symbols(a.where("ordinal % 2 = 1"))
    s.save_symbols(a.where("ordinal % 2 = 0").withColumn("ordinal", F.col("ordinal") + 1_000_000))
    return s.table("symbols").select("fqn", "name", "project_id", "namespace", "return_type", "id", "line_start", "line_end", "loc", "parameter_count", "is_async")


ORACLE_SQL["store_symbols"] = ORACLE_SQL["store_symbols"].replace("from arrivals group by fqn", "from (select * replace (case when ordinal % 2 = 1 then ordinal else ordinal + 1000000 end as ordinal) from arrivals) group by fqn")


@query(f"select sha256(c.caller) as caller_id, sha256(c.callee) as callee_id, c.call_type, {_RULE_FIELDS}, c.call_count from method_calls c join symbols a on a.fqn = c.caller join symbols b on b.fqn = c.callee")
def store_calls(t: Tables) -> DataFrame:
    """Calls with every call doubled by a later one of another count, which loses."""
    s = _store(t)
    calls = t.stored("method_calls")
    s.save_calls(calls.withColumn("ordinal", F.lit(1)).union(calls.withColumn("call_count", F.lit(99).cast("long")).withColumn("ordinal", F.lit(2))))
    return s.table("method_calls")


@query("select accessor as accessor_fqn, target as target_fqn, access_kind, arg_min(is_external, ordinal) as is_external from field_accesses group by 1, 2, 3")
def store_accesses(t: Tables) -> DataFrame:
    s = Store(t.spark, str(_folder(t)))
    s.save_accesses(t.field_accesses)
    return s.table("field_accesses")


@query("select source as source_project_id, target as target_project_id from project_refs")
def store_dependencies(t: Tables) -> DataFrame:
    """The same references saved twice."""
    s = Store(t.spark, str(_folder(t)))
    refs = t.stored("project_refs").withColumnsRenamed({"source": "source_project_id", "target": "target_project_id"})
    s.save_dependencies(refs)
    s.save_dependencies(refs)
    return s.table("project_dependencies")


@query("select distinct sha256(i.derived) as derived_id, sha256(i.base) as base_id, i.kind from inheritance i join symbols d on d.fqn = i.derived join symbols b on b.fqn = i.base")
def store_inheritance(t: Tables) -> DataFrame:
    s = _store(t)
    s.save_inheritance(t.inheritance.union(t.inheritance))
    return s.table("inheritance")


@query(f"select distinct sha256(u.source) as source_id, sha256(u.target) as target_id, u.type as relationship_type, {_RULE_FIELDS} from type_uses u join symbols a on a.fqn = u.source join symbols b on b.fqn = u.target")
def store_type_uses(t: Tables) -> DataFrame:
    """A part of the uses first, then all of them: what is there is not added again, null rule fields or not."""
    s = _store(t)
    s.save_type_uses(t.stored("type_uses").where("rule_mode is null or rule_mode = 'hard'"))
    s.save_type_uses(t.stored("type_uses"))
    return s.table("symbol_relationships")


@query("select id, arg_max(status, ordinal) as status from run_events group by 1")
def store_put(t: Tables) -> DataFrame:
    """Rows by id, the last of which stays."""
    s = Store(t.spark, str(_folder(t)))
    runs = frame(*t._at, "run_events")
    for low in (0, 150):
        s.put("analysis_runs", runs.where(f"ordinal >= {low} and ordinal < {low + 150}"))
    return s.table("analysis_runs").select("id", "status")


@query("""select 'symbols' as name, count(*) as n from symbols where project_id not in ('n1', 'n2') union all select 'method_calls', count(*) from thin_calls c join symbols a on a.fqn = c.caller join symbols b on b.fqn = c.callee where a.project_id not in ('n1', 'n2')
    union all select 'field_accesses', count(*) from (select distinct accessor, target, access_kind from thin_accesses) f left join symbols a on a.fqn = f.accessor where a.project_id is null or a.project_id not in ('n1', 'n2')""")
def store_reset_projects(t: Tables) -> DataFrame:
    """What is left when two projects are dropped: edges into them from elsewhere stay."""
    s = _store(t)
    s.save_calls(t.thin_calls)
    s.save_accesses(t.thin_accesses)
    s.reset_projects(["n1", "n2"])
    counts = [s.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("symbols", "method_calls", "field_accesses")]
    return counts[0].union(counts[1]).union(counts[2])


@query("select 'analysis_runs' as name, 1 as n union all select 'symbols', 0 union all select 'projects', 0")
def store_reset(t: Tables) -> DataFrame:
    """A full reset keeps the runs alone; a table of an older shape gets the columns that it lacks."""
    s = _store(t)
    s.put("analysis_runs", t.spark.createDataFrame([("r", "completed")], "id string, status string"))
    s.put("projects", t.projects)
    s.reset()
    counts = [s.table(n).agg(F.lit(n).alias("name"), F.count("*").cast("int").alias("n")) for n in ("analysis_runs", "symbols", "projects")]
    return counts[0].union(counts[1]).union(counts[2])


@query("select fqn, cast(null as string) as document_id, cast(null as boolean) as is_async, cast(null as bigint) as fan_in from types")
def store_migration(t: Tables) -> DataFrame:
    """A table that was written with fewer columns, as the store reads it."""
    at = _folder(t)
    t.types.select("fqn").write.parquet(str(at / "symbols"))
    return Store(t.spark, str(at)).table("symbols").select("fqn", "document_id", "is_async", "fan_in")


@query("""select s.fqn, cast(coalesce(n, 0) as bigint) as fan_in from symbols s left join (select fqn, sum(c) as n from (select c.callee as fqn, count(*) as c from thin_calls c join symbols a on a.fqn = c.caller group by 1
    union all select i.base, count(*) from inheritance i group by 1 union all select target, count(*) from (select distinct accessor, target, access_kind from thin_accesses) group by 1) group by 1) x on x.fqn = s.fqn""")
def store_fan_in(t: Tables) -> DataFrame:
    s = _store(t)
    s.save_calls(t.thin_calls)
    s.save_inheritance(t.inheritance)
    s.save_accesses(t.thin_accesses)
    s.count_fan_in()
    return s.table("symbols").select("fqn", "fan_in")


@query(f"select source, target, type, {_RULE_FIELDS} from {_simple('type_uses', 'source', 'target', 'type')} where target not like 'System%'")
def graph_file_edges(t: Tables) -> DataFrame:
    """A graph written as node-link JSON and read back: of parallel links the last in the file stays."""
    at = _folder(t) / "type_dependency_graph.json"
    order = [F.asc_nulls_first(c) for c in ("source", "target", "type", *graph.RULE_FIELDS)]
    write_graph(at, "type_dependency", t.symbols.select(F.col("fqn").alias("id"), "kind"), t.type_uses.orderBy(*order), "run")
    return files.read_graph(t.spark, files.graph_path(str(at.parent), at.name)).edges.select("source", "target", "type", *graph.RULE_FIELDS)


@query("""select 'call' as graph, (select count(*) from symbols where kind in ('method', 'constructor', 'event', 'lambda', 'xaml', 'framework_method')) as nodes, (select count(distinct (c.caller, c.callee)) from method_calls c join symbols a on a.fqn = c.caller join symbols b on b.fqn = c.callee where a.kind not in ('class', 'interface', 'struct', 'field', 'property') and b.kind not in ('class', 'interface', 'struct', 'field', 'property')) as edges
    union all select 'inheritance', (select count(*) from (select fqn from symbols where kind in ('class', 'interface') union select d.fqn from inheritance i join symbols d on d.fqn = i.derived join symbols b on b.fqn = i.base union select b.fqn from inheritance i join symbols d on d.fqn = i.derived join symbols b on b.fqn = i.base)), (select count(distinct (i.derived, i.base)) from inheritance i join symbols d on d.fqn = i.derived join symbols b on b.fqn = i.base)
    union all select 'dependency', (select count(distinct name) from projects), (select count(*) from all_refs)
    union all select 'field_access', (select count(*) from (select accessor from field_accesses union select target from field_accesses)), (select count(distinct (accessor, target)) from field_accesses)
    union all select 'type_dependency', (select count(*) from symbols), (select count(distinct (source, target)) from all_uses)""")
def graph_files(t: Tables) -> DataFrame:
    """The five graph files of a store: how many nodes and edges each has when it is read."""
    s, at = _store(t), _folder(t)
    s.put("projects", t.projects)
    s.save_calls(t.method_calls)
    s.save_inheritance(t.inheritance)
    s.save_accesses(t.field_accesses)
    s.save_type_uses(t.all_uses)
    s.save_dependencies(t.all_refs.withColumnsRenamed({"source": "source_project_id", "target": "target_project_id"}))
    export_graphs(s, str(at), "run")
    found = [(name, g.nodes.count(), g.edges.count()) for name, g in files.read_graphs(t.spark, str(at)).items()]
    return t.spark.createDataFrame(found, "graph string, nodes long, edges long")


@query("""select source, target, type, case when ordinal % 2 = 1 then 0.9::double else confidence end as confidence from (select trim(source) as source, trim(target) as target, case when trim(type) = '' then 'ai_soft_edge' else trim(type) end as type, confidence, ordinal from soft_edges where ordinal < 200 and trim(source) <> '' and (confidence is null or confidence between 0 and 1))
    qualify row_number() over (partition by source, target, type order by ordinal % 2 desc, ordinal desc) = 1""")
def soft_edge_files(t: Tables) -> DataFrame:
    """Suggested edges imported from one file, then merged with those of another."""
    at = _folder(t)
    rows = t.stored("soft_edges").where("ordinal < 200 and trim(source) <> '' and (confidence is null or confidence between 0 and 1)").orderBy("ordinal").collect()
    for part in (0, 1):
        edges = [{"source": r.source, "target": r.target, "type": r.type, "confidence": 0.9 if part else r.confidence, "evidence": [r.evidence] if r.evidence else []} for r in rows if r.ordinal % 2 == part]
        (at / "in.json").write_text("\ufeff" + json.dumps({"schema_version": 1, "edges": edges} if part else edges), encoding="utf-8")
        reports.import_soft_edges(t.spark, str(at / "in.json"), str(at))
    found, _ = files.read_soft_import(t.spark, files.soft_edge_path(str(at / "graphs"), str(at)))
    return found.select("source", "target", "type", "confidence")


@query(f"select {_EDGE} from {_EMIT} where rule_id = 'di.service_type'")
def dsl_rule_folder(t: Tables) -> DataFrame:
    """The rules of a folder: one that holds, one of records that no scan offers, one that cannot be read."""
    at = _folder(t)
    good = _RULE.format(id="service_type", names='["GetService", "GetRequiredService"]', kind="class", field="name", op="eq", edge="candidate_type_dependency", call="")
    for name, rule in (("a", good), ("b", good.replace('"csharp_invocation"', '"assembly_attribute"')), ("c", good.replace('"eq"', '"has_attribute"'))):
        (at / f"{name}.json").write_text(rule, encoding="utf-8")
    rules, wrong = dsl.load_rules(str(at))
    assert len(rules) == 2 and list(wrong) == ["c.json"]
    return dsl.emitted(dsl.in_scope(rules), _records(t))[0]


_X = "http://schemas.microsoft.com/winfx/2006/xaml"
_MARKUP = f"""concat('<Window x:Class="', containing_type, '" xmlns="urn:w" xmlns:x="{_X}" xmlns:v="clr-namespace:App.Views;assembly=App" Title="', name, '"><v:Panel Click="On', cast(k as string), '" Tag="{{x:Static v:Keys.Main}}" Kind="{{x:Type v:Item', cast(k % 3 as string), '}}" DataType="v:Row"/><Grid/></Window>')"""


def _markup_files(t: Tables) -> DataFrame:
    return t.markup.select("file_path", F.expr(_MARKUP).alias("text"))


@query("""select containing_type as owner, u.element, u.name, u.value, 'xaml::' || containing_type || '::' || u.element || '::' || u.name as fqn from markup m, unnest([{'element': 'Window', 'name': 'Class', 'value': containing_type}, {'element': 'Window', 'name': 'Title', 'value': m.name}, {'element': 'Panel', 'name': 'Click', 'value': 'On' || k},
    {'element': 'Panel', 'name': 'Tag', 'value': '{x:Static v:Keys.Main}'}, {'element': 'Panel', 'name': 'Kind', 'value': '{x:Type v:Item' || (k % 3) || '}'}, {'element': 'Panel', 'name': 'DataType', 'value': 'v:Row'}]) as x(u)""")
def xml_attribute_records(t: Tables) -> DataFrame:
    """Attributes of markup files as records of the rule language."""
    value = lambda k: F.element_at("rec", F.lit(k))
    return markup.attribute_records(_markup_files(t)).select(value("document.x_class").alias("owner"), value("element.name").alias("element"), value("name").alias("name"), value("value").alias("value"), value("fqn").alias("fqn"))


@query("""select distinct 'xaml::' || containing_type || '::' || regexp_extract(file_path, '[^/\\\\]*$') as fqn, u.target, u.type from markup, unnest([{'target': containing_type, 'type': 'xaml_codebehind'}, {'target': 'App.Views.Panel', 'type': 'xaml_type_usage'}, {'target': 'App.Views.Keys', 'type': 'xaml_type_usage'},
    {'target': 'App.Views.Item' || (k % 3), 'type': 'xaml_type_usage'}, {'target': 'App.Views.Row', 'type': 'xaml_type_usage'}]) as x(u)""")
def xaml_documents(t: Tables) -> DataFrame:
    """The class behind each markup file and the types that it uses."""
    return markup.documents(_markup_files(t)).select("fqn", "target", "type").distinct()


@query("""select file_path, case when n % 3 = 0 then 'Lib.' || name else name end as name, case when n % 2 = 0 then 'net8.0' end as target_framework, case when n % 5 = 0 then 'Exe' else 'Library' end as project_type, case when n % 4 = 0 then n % 8 = 0 else n % 3 = 1 end as is_test_project, n % 2 = 0 as is_sdk_style
    from (select file_path, name, cast(substr(id, 2) as int) as n from projects)""")
def project_metadata(t: Tables) -> DataFrame:
    """Project files: names, frameworks, and whether they are tests by their flag, else by a package."""
    n = "cast(substr(id, 2) as int)"
    text_of = f"""concat('<Project', case when {n} % 2 = 0 then ' Sdk="Microsoft.NET.Sdk"><TargetFramework>net8.0</TargetFramework>' else '>' end, case when {n} % 3 = 0 then concat('<AssemblyName> Lib.', name, '</AssemblyName>') else '' end, case when {n} % 5 = 0 then '<OutputType>Exe</OutputType>' else '' end,
        case when {n} % 4 = 0 then concat('<IsTestProject>', case when {n} % 8 = 0 then 'True' else 'False' end, '</IsTestProject>') else '' end, case when {n} % 3 = 1 then '<PackageReference Include="NUnit"/>' else '' end, '</Project>')"""
    return files.project_metadata(t.projects.select("file_path", F.expr(text_of).alias("text"))).drop("assembly_name")


@query("""select min(path) as path from (select replace(file_path, chr(92), '/') as path from markup union all select upper(replace(file_path, chr(92), '/')) from markup where k % 2 = 0) group by lower(path)""")
def markup_paths(t: Tables) -> DataFrame:
    """Markup files that are declared, found by walking, or both in another case."""
    declared = t.markup.select(F.col("file_path").alias("path"))
    walked = t.markup.where("k % 2 = 0").select(F.upper("file_path").alias("path")).union(t.types.select(F.col("file_path").alias("path"))).union(declared.select(F.concat(F.lit("C:\\obj\\"), "path")))
    return files.markup_paths(declared, walked)


@query("""select path from (select '/r/' || case when k % 4 = 0 then 'src/' when k % 4 = 1 then 'demo/a/' when k % 4 = 2 then 'extension/x/y/' else 'bin/' end || name || case when k % 3 = 0 then '.sln' else '.csproj' end as path, k from types)
    where path not like '/r/bin/%' order by path like '%.csproj', (length(path) - length(replace(path, '/', '')) - 2) * 10 + case when path like '/r/src/%' then case when path like '%.sln' then -20 else -10 end else 0 end + case when path like '%/extension/%' and path not like '/r/extension/%' then 30 else 0 end
    + case when path like '%.csproj' and regexp_matches(lower(substr(path, 4)), 'demo|sample|test') then 20 else 0 end, length(path), path limit 1""")
def scan_target(t: Tables) -> DataFrame:
    """The solution that is opened below a folder: one row."""
    made = F.expr("concat('/r/', case k % 4 when 0 then 'src/' when 1 then 'demo/a/' when 2 then 'extension/x/y/' else 'bin/' end, name, case when k % 3 = 0 then '.sln' else '.csproj' end)")
    return files.best_candidate(t.types.select(made.alias("path")), "/r")


@query(f"""with v as (select vec_id, embedding, label from vectors), q as (select embedding from v where vec_id = 0), p as (select v.vec_id, round(list_inner_product(v.embedding::double[], w.embedding::double[]) / {_NORM.format('v')} / {_NORM.format('w')}, 9) as exact from v, q w where v.label = 1),
    r as (select vec_id, round(exact, 4) as score, cast(row_number() over (order by exact desc, vec_id) as int) as rank from p qualify rank <= 20)
    select rank, score, 'v' || vec_id as fqn, 'Called by: v' || (vec_id - 2) || ';Called by: v' || (vec_id - 1) || ';Calls: v' || (vec_id + 1) || ';Calls: v' || (vec_id + 2) as context from r""")
def vector_search(t: Tables) -> DataFrame:
    """A question against an index of one kind of symbols, with what surrounds each hit two steps far."""
    one = [float(x) for x in t.vectors.where("vec_id = 0").first()["embedding"]]
    index = t.vectors.select("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("fqn"), F.when(F.col("label") == 1, "method").otherwise("class").alias("kind"), F.lit("p").alias("project_id"), F.lit("").alias("summary"), "embedding")
    chain = t.vectors.select(F.explode(F.expr("array(vec_id - 2, vec_id - 1, vec_id, vec_id + 1)")).alias("i")).distinct().select(F.concat(F.lit("v"), F.col("i").cast("string")).alias("caller"), F.concat(F.lit("v"), (F.col("i") + 1).cast("string")).alias("callee"))
    hits = retrieval.search(index, "question", lambda _: np.array([one]), {"call": (chain, "caller", "callee")}, kind="method")
    return hits.select("rank", "score", "fqn", F.array_join("context", ";").alias("context"))


_FIRST = "(select fqn from d where drop_reason is null order by loc desc, fqn limit 50)"
_CATEGORY = f"""s as (select s.fqn, kind, name, containing_type, namespace, project_id, return_type, parameter_count, regexp_extract(file_path, '[^/\\\\]*$') as file_name, {_TOKENS('s.fqn')} as tokens, {_LISTS} from symbols s),
    pairs as (select a.fqn as source, b.fqn, round(({_SURE})::double, 4) as score, coalesce(a.containing_type = b.containing_type and a.containing_type <> '', false) or coalesce(a.namespace = b.namespace and a.namespace <> '', false) as near, {_LIKE('a.tokens', 'b.tokens')} > 0 as named,
    {_LIKE('a.callers', 'b.callers')} > 0 or {_LIKE('a.callees', 'b.callees')} > 0 or {_LIKE('a.used_types', 'b.used_types')} > 0 or {_LIKE('a.used_fields', 'b.used_fields')} > 0 as shared from s a join s b on a.fqn <> b.fqn and a.kind = b.kind and b.kind not in ('xaml', 'lambda', 'framework_method') where a.fqn in {_FIRST}),
    best as (select * from pairs qualify row_number() over (partition by source order by score desc, fqn) = 1), named as (select d.fqn, d.loc, case when best.score >= 0.7 and near and named then 'near-family' when best.score >= 0.55 and (shared or near) then 'structural-sibling' else 'isolated' end as category from d left join best on best.source = d.fqn and best.score >= 0.45 where d.drop_reason is null)"""


def _named(t: Tables) -> DataFrame:
    """Categories of candidates by their nearest symbol, shapes of names left out."""
    d = kept(_decided(t).where("drop_reason is null").select("fqn", "loc"))
    first = d.orderBy(F.desc("loc"), "fqn").limit(50).select("fqn")
    best = similarity.related(t.stored("symbols"), similarity.feature_sets(_graphs(t)), first, 1, shapes=False, least=0.45).select(F.col("source").alias("fqn"), "score", "reasons")
    return d.join(best, "fqn", "left").withColumn("category", isolation.category(F.col("score"), F.col("reasons"))).select("fqn", "loc", "category")


@query(f"with {_HARD}, {_CATEGORY} select * from named")
def isolation_category_no_seqmatch(t: Tables) -> DataFrame:
    return _named(t)


@query(f"with {_HARD}, {_CATEGORY} select c.category, count(named.fqn) as n from (values ('isolated'), ('structural-sibling'), ('near-family')) c(category) left join named on named.category = c.category group by 1")
def isolation_category_counts(t: Tables) -> DataFrame:
    return isolation.category_counts(_named(t))


@query(f"with {_HARD}, {_CATEGORY} select fqn, category, cast(row_number() over (order by list_position(['isolated', 'structural-sibling', 'near-family'], category), loc desc, fqn) as int) as rank from named qualify rank <= 20")
def isolation_report(t: Tables) -> DataFrame:
    """The report's first twenty rows: isolated ones first, then the longest."""
    rows = isolation.prioritised(_named(t)).limit(20)
    order = Window.orderBy(F.array_position(F.array(*map(F.lit, isolation.CATEGORIES)), F.col("category")), F.desc("loc"), "fqn")
    return rows.withColumn("rank", F.row_number().over(order)).select("fqn", "category", "rank")


@query(f"""{_XAML} select xaml_fqn, file_path || coalesce((select string_agg(distinct ';' || m.file_path, '') from symbols m join ({_EARLY}) f on f.fqn = m.fqn where m.kind = 'method' and m.containing_type = y.containing_type and f.fan_in = 0 and contains(m.fqn, 'EventArgs') and m.file_path <> y.file_path), '') as context_files from y where score > 0""")
def candidate_context(t: Tables) -> DataFrame:
    """The files that a markup candidate hangs together with, each once in the order of finding."""
    calls, uses = graph.simple_digraph(t.thin_calls), graph.simple_digraph(t.type_uses, "source", "target", "type")
    found = candidates.with_context(candidates.xaml_candidates(t.stored("symbols"), t.projects, kept(_early_fan_in(t)), calls, uses), "xaml")
    return found.select("xaml_fqn", F.array_join("context_files", ";").alias("context_files"))


@query("select event_id, ts as parsed from event_times")
def timestamp_round_trip(t: Tables) -> DataFrame:
    """Times written as ISO texts and read again: the first thousand events."""
    text_of = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return frame(*t._at, "event_times").select("event_id", F.to_timestamp_ntz(text_of, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("parsed"))
