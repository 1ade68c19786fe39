"""Canonical code-structure tables derived from the driver's star-schema tables.

Each binding is SQL that Spark and DuckDB both run, so that a query's operator (DataFrames over `frame`) and its check
(SQL over `with_bindings`) start from the same rows.  Back-slashes are always chr(92).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels")
#: Names of types by supplier key, so chosen that every convention rule has types it holds for.
TYPE_SUFFIXES = "Controller View Service ViewModel Manager Renderer Middleware Module Converter Behavior Extensions Startup Endpoints ActionFilter WebServer Adapter Form Factory ContractResolver Loader Provider Control Registry Filter".split()
FOLDERS = "Controllers Views Services Middleware Tests Endpoints Filters".split()
#: Names of methods by part key, likewise.
VERBS = (
    "Load OnLoaded Render Invoke Configure Get Receive Main Dispose RunMain get add Convert ReadJson OnActionExecuting MapRoutes CreateHost UseCors HandleClick btn_Click OnPaint OnSelectionChanged "
    "Value DrawItem Save Refresh GetLast TryGetFirst Build Register Resolve ConfigureServices OnUpdate OnKey init_Load Compute Update Delete Insert Parse Format Validate Execute"
).split()
_FLAGS = "is_async, is_static, is_abstract, has_ui_dispatch, has_task_spawn, has_background_worker, has_do_events, has_lock, has_callback, has_thread_start, has_blocking_wait"
_NO_FLAGS = ", ".join(f"false as {c}" for c in _FLAGS.split(", "))


def _choice(key: str, names: list[str]) -> str:
    """SQL for the name at `key` modulo their number."""
    return f"split_part('{','.join(names)}', ',', cast({key} % {len(names)} + 1 as int))"


_SUFFIX, _FOLDER, _VERB = _choice("s_suppkey", TYPE_SUFFIXES), _choice("s_suppkey", FOLDERS), _choice("p_partkey", VERBS)
_TYPE_NAME = f"case s_suppkey % {len(TYPE_SUFFIXES)} when 11 then 'Startup' else concat('Supplier', cast(s_suppkey as string), {_SUFFIX}) end"
_WORD = "concat(upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2))"
_METHOD_NAME = f"case when p_partkey % {len(VERBS)} = 22 then concat('Value', cast(p_partkey as string), 'PropertyChanged') when p_partkey % 3 <> 0 and (p_partkey % {len(VERBS)} = 5 or p_partkey % {len(VERBS)} > 34) then concat({_VERB}, {_WORD}) else {_VERB} end"
_SIGNATURE = f"""case p.p_partkey % {len(VERBS)} when 19 then concat('(object, RoutedEventArgs, P', cast(p.p_partkey as string), ')') when 22 then '(DependencyObject, DependencyPropertyChangedEventArgs)'
    else concat('(P', cast(p.p_partkey as string), case when p.p_partkey % 11 = 0 then ', FooMessage)' when p.p_partkey % 13 = 0 then ', MouseEventArgs)' else ')' end) end"""
_RULES = "case l.l_linestatus when 'F' then 'di.service' end as rule_id, case l.l_linestatus when 'F' then 'di' end as rule_family, case l.l_linestatus when 'F' then case l.l_returnflag when 'R' then 'hard' else 'candidate' end end as rule_mode"


def _edges(where: str) -> str:
    return f"""select case when l.a % 50 = 0 then concat('framework::', ma.fqn) else ma.fqn end as caller, mb.fqn as callee,
        case l.l_returnflag when 'A' then 'calls' when 'R' then 'delegate_reference' else case l.a % 4 when 0 then 'lifecycle_entrypoint' when 1 then 'service_provider_dispatch' when 2 then 'override_dispatch' else 'calls' end end as call_type,
        {_RULES}, cast(count(*) as bigint) as call_count
        from line_pairs l join methods ma on ma.k = l.a join methods mb on mb.k = l.b {where} group by 1, 2, 3, 4, 5, 6
        union all select x.fqn as caller, m.fqn as callee, 'xaml_event' as call_type, 'xaml.event' as rule_id, 'xaml' as rule_family, 'candidate' as rule_mode, cast(1 as bigint) as call_count
        from markup x join methods m on m.containing_type = x.containing_type where m.k % 5 = 0 and x.k % 2 = 1"""


def _accesses(where: str) -> str:
    return f"""select m.fqn as accessor, f.fqn as target, case l.l_returnflag when 'A' then 'read' when 'R' then 'write' else 'read_write' end as access_kind, m.containing_type <> f.containing_type as is_external,
        row_number() over (partition by m.fqn, f.fqn order by l.l_orderkey, l.l_linenumber, l.l_suppkey) as ordinal
        from lineitem l join orders o on o.o_orderkey = l.l_orderkey join methods m on m.k = l.l_partkey join fields f on f.k = o.o_custkey {where}
        union all select m.fqn as accessor, f.fqn as target, 'write' as access_kind, false as is_external, cast(1000000 + m.k as bigint) as ordinal from fields f join methods m on m.containing_type = f.containing_type where f.k % 50 = 3 and m.k % 7 < 3"""


def _uses(where: str) -> str:
    return f"""select m.fqn as source, t.fqn as target, case when l.l_linestatus = 'F' then 'type_usage' else 'xaml_type_usage' end as type, {_RULES}
        from lineitem l join methods m on m.k = l.l_partkey join types t on t.k = l.l_suppkey {where} group by 1, 2, 3, 4, 5, 6
        union all select x.fqn as source, t.fqn as target, case when x.k % 4 = 1 then 'xaml_command_binding' else 'xaml_codebehind' end as type, 'xaml.binding' as rule_id, 'xaml' as rule_family, 'hard' as rule_mode
        from markup x join types t on t.k = x.k"""


def _refs(where: str) -> str:
    return f"""select distinct concat('n', cast(c.c_nationkey as string)) as source, concat('n', cast(s.s_nationkey as string)) as target
        from lineitem l join orders o on o.o_orderkey = l.l_orderkey join customer c on c.c_custkey = o.o_custkey join supplier s on s.s_suppkey = l.l_suppkey
        where c.c_nationkey <> s.s_nationkey{where}"""


#: The tables of a scan.  `thin_*` hold a tenth of the edges, so that some symbols are not reached; `early_*` are a still
#: thinner scan from before, whose counts a later graph contradicts.  `type_uses` and `project_refs` are thin, too: `all_*`,
#: `method_calls` and `field_accesses` hold every edge.
BINDINGS = {
    "solutions": "select concat('r', cast(r_regionkey as string)) as id, r_name as name from region",
    "projects": "select concat('n', cast(n_nationkey as string)) as id, n_name as name, concat('r', cast(n_regionkey as string)) as solution_id, concat('C:', chr(92), 'repo', chr(92), n_name, '.csproj') as file_path, n_nationkey % 10 = 7 as is_test_project from nation",
    "runs": "select concat('run', cast(event_id as string)) as id, ts as started_at, case when event_type = 'error' then 'failed' else 'completed' end as status from events where event_id % 7 = 0 and event_id < 60",
    "run_events": "select concat('run', cast(cast(floor(event_id / 3) as bigint) % 40 as string)) as id, event_type as status, event_id as ordinal from events where event_id < 300",
    "event_times": "select event_id, ts from events where event_id < 1000",
    "types": f"""select s_suppkey as k, concat('App.N', cast(s_nationkey as string), case when s_suppkey % {len(TYPE_SUFFIXES)} = 11 then concat('.S', cast(s_suppkey as string)) else '' end, '.', {_TYPE_NAME}) as fqn,
        {_TYPE_NAME} as name, concat('App.N', cast(s_nationkey as string)) as namespace, concat('n', cast(s_nationkey as string)) as project_id,
        concat('C:', chr(92), 'repo', chr(92), {_FOLDER}, chr(92), 'Supplier', cast(s_suppkey as string), {_SUFFIX}, case s_suppkey % {len(TYPE_SUFFIXES)} when 1 then '.xaml.cs' when 17 then '.Designer.cs' else '.cs' end) as file_path,
        cast(abs(floor(s_acctbal / 4)) as bigint) as loc from supplier""",
    # types without members: some are derived from, some have names of the user interface
    "bare_types": """select s_suppkey as k, concat('App.Bare.', case s_suppkey % 5 when 0 then 'Base' else 'Bare' end, cast(s_suppkey as string), case s_suppkey % 5 when 0 then '' else 'Dialog' end) as fqn,
        concat(case s_suppkey % 5 when 0 then 'Base' else 'Bare' end, cast(s_suppkey as string), case s_suppkey % 5 when 0 then '' else 'Dialog' end) as name, concat('n', cast(s_nationkey as string)) as project_id,
        concat('C:', chr(92), 'repo', chr(92), 'Bare', chr(92), 'Bare', cast(s_suppkey as string), '.cs') as file_path from supplier where s_suppkey % 5 < 2""",
    "source_files": "select t.fqn as id, t.project_id, t.file_path, replace(t.file_path, concat('C:', chr(92), 'repo', chr(92)), '') as file_name, e.ts as modified_at from types t join events e on e.event_id = t.k",
    "markup": f"""select k, concat('xaml::', fqn, '::', name, '.xaml') as fqn, concat(name, '.xaml') as name, namespace, fqn as containing_type, project_id,
        concat('C:', chr(92), 'repo', chr(92), case when k % 2 = 0 then concat('Shared', chr(92)) else '' end, name, case when k % 3 = 0 then '.xaml' else '.axaml' end) as file_path, cast(20 as bigint) as loc from types where k % {len(TYPE_SUFFIXES)} in (1, 4, 16, 21)""",
    "methods": f"""select p.p_partkey as k, concat(t.fqn, '.', case when p.p_partkey % {len(VERBS)} = 33 then 'IListener.' else '' end, p.name, {_SIGNATURE}) as fqn, p.name, t.fqn as containing_type, t.namespace, t.project_id, t.file_path,
        cast(p.p_size as bigint) as loc, p.p_type as return_type, cast(p.p_partkey % 4 as bigint) as parameter_count,
        case when p.p_partkey % 41 = 5 then 'constructor' when p.p_partkey % 59 = 7 then 'lambda' when p.p_partkey % 61 = 9 then 'framework_method' when p.p_partkey % 67 = 11 then 'event' else 'method' end as kind
        from (select part.*, {_METHOD_NAME} as name, p_partkey % ns.n as sk from part cross join (select count(*) as n from supplier) ns) p join types t on t.k = p.sk
        union all select 10000000 + k as k, concat(fqn, case k % {len(TYPE_SUFFIXES)} when 7 then '.Load(' else '.Configure(' end, 'M', cast(k as string), ')') as fqn, case k % {len(TYPE_SUFFIXES)} when 7 then 'Load' else 'Configure' end as name, fqn as containing_type, namespace, project_id, file_path,
        cast(3 as bigint) as loc, 'void' as return_type, cast(0 as bigint) as parameter_count, 'method' as kind from types where k % {len(TYPE_SUFFIXES)} in (7, 11)""",
    "fields": f"""select c.c_custkey as k, concat(t.fqn, '.', case when c.c_custkey % 9 = 0 then concat('C', cast(c.c_custkey as string), '.') else '' end, c.name) as fqn, c.name, t.fqn as containing_type, t.namespace, t.project_id, t.file_path,
        case when c.c_mktsegment in ('BUILDING', 'MACHINERY') then 'property' else 'field' end as kind
        from (select customer.*, case when c_custkey % 9 = 0 then concat({_choice("c_custkey % ns.n", VERBS)}, case when c_custkey % 2 = 0 then 'Command' else '_Command' end) else concat('Field', cast(c_custkey as string)) end as name, c_custkey % ns.n as sk from customer cross join (select count(*) as n from supplier) ns) c join types t on t.k = c.sk""",
    "symbols": f"""select fqn, name, case when k % 6 = 3 then 'interface' when k % {len(TYPE_SUFFIXES)} = 22 then 'struct' else 'class' end as kind, namespace, cast(null as string) as containing_type, 'public' as accessibility, project_id, file_path, loc, cast(1 as bigint) as line_start, cast(0 as bigint) as parameter_count, cast(null as string) as return_type, {_NO_FLAGS} from types
        union all select fqn, name, 'class' as kind, 'App.Bare' as namespace, cast(null as string) as containing_type, 'public' as accessibility, project_id, file_path, cast(30 as bigint) as loc, cast(1 as bigint) as line_start, cast(0 as bigint) as parameter_count, cast(null as string) as return_type, {_NO_FLAGS} from bare_types
        union all select fqn, name, kind, namespace, containing_type, case when k % 2 = 0 then 'public' else 'private' end as accessibility, project_id, file_path, loc, k * 7 % 200 + 1 as line_start, parameter_count, return_type,
        k % 2 = 0 as is_async, k % 4 = 1 as is_static, k % 9 = 2 as is_abstract, k % 3 = 0 as has_ui_dispatch, k % 5 = 0 as has_task_spawn, k % 7 = 0 as has_background_worker, k % 11 = 0 as has_do_events, k % 19 = 0 as has_lock, k % 8 = 3 as has_callback, k % 13 = 0 as has_thread_start, k % 17 = 0 as has_blocking_wait from methods
        union all select fqn, name, kind, namespace, containing_type, 'private' as accessibility, project_id, file_path, cast(1 as bigint) as loc, k % 50 + 1 as line_start, cast(0 as bigint) as parameter_count, 'int' as return_type, {_NO_FLAGS} from fields
        union all select fqn, name, 'xaml' as kind, namespace, containing_type, cast(null as string) as accessibility, project_id, file_path, loc, cast(1 as bigint) as line_start, cast(null as bigint) as parameter_count, cast(null as string) as return_type, {_NO_FLAGS} from markup""",
    "line_pairs": "select l_partkey as a, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as b, l_returnflag, l_linestatus, l_quantity from lineitem",
    "method_calls": _edges("where l.b is not null"),
    "thin_calls": _edges("where l.b is not null and l.l_quantity >= 49"),
    "early_calls": _edges("where l.b is not null and l.l_quantity >= 50"),
    "field_accesses": _accesses(""),
    "thin_accesses": _accesses("where l.l_quantity <= 2"),
    "inheritance": f"""select d.fqn as derived, b.fqn as base, case when d.k % 2 = 0 then 'extends' else 'implements' end as kind from types d join types b on b.k = cast(floor(d.k / 2) as bigint) where d.k > 0
        union all select t.fqn as derived, b.fqn as base, 'extends' as kind from types t join bare_types b on b.k = t.k where b.k % 5 = 0
        union all select fqn as derived, 'App.Messaging.IRecipient' as base, 'implements' as kind from types where k % {2 * len(TYPE_SUFFIXES)} = 3""",
    "early_inheritance": "select d.fqn as derived, b.fqn as base, 'extends' as kind from types d join types b on b.k = cast(floor(d.k / 2) as bigint) where d.k > 0 and d.k % 5 = 2",
    "all_uses": _uses(""),
    "type_uses": _uses("where l.l_quantity = 25 and l.l_suppkey % 4 <> 0 "),
    "early_uses": _uses("where l.l_quantity = 25 and l.l_suppkey % 4 <> 0 and l.l_suppkey % 8 = 1"),
    "all_refs": _refs(""),
    "project_refs": _refs(" and o.o_orderpriority = '1-URGENT' and l.l_quantity >= 50"),
    "arrivals": """select m.fqn, m.name, case when l.l_discount > 0.05 then m.namespace end as namespace, case when l.l_returnflag = 'R' then m.return_type end as return_type, m.project_id,
        cast(l.l_linenumber as bigint) as line_start, cast(l.l_quantity as bigint) as line_end, m.loc, case when l.l_returnflag = 'N' then m.parameter_count end as parameter_count, l.l_linestatus = 'F' as is_async,
        row_number() over (partition by m.fqn order by l.l_orderkey, l.l_linenumber, l.l_suppkey) as ordinal from lineitem l join methods m on m.k = l.l_partkey""",
    "soft_edges": """select case when e.event_id % 97 = 0 then ' ' else m.fqn end as source, t.fqn as target, case when e.event_type = 'view' then '' else concat(' ', e.event_type, ' ') end as type, case when e.event_type = 'error' then cast(null as double) else e.value / 100 end as confidence,
        case when e.event_id % 3 <> 0 then e.event_type end as evidence, e.event_id as ordinal
        from events e cross join (select count(*) as n from part) np join methods m on m.k = e.user_id join methods t on t.k = e.event_id % np.n""",
    "invocations": """select m.fqn as fqn, concat('inv', cast(e.event_id as string)) as call_id, case e.event_type when 'click' then 'Resolve' when 'view' then 'GetService' when 'purchase' then 'GetRequiredService' else 'Other' end as method_name,
        case when e.event_type <> 'error' then t.name end as generic_arg, m.containing_type, e.event_id % 4 as argument_count
        from events e cross join (select count(*) as n from supplier) ns join types t on t.k = e.event_id % ns.n join methods m on m.k = e.user_id""",
    "vectors": "select vec_id, embedding, label from embeddings",
    "files_text": "select doc_id, text from documents",
    "pages_html": "select page_id, html from pages",
}


def _closure(names: list[str]) -> list[str]:
    """The bindings that `names` need, each after those it needs itself."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in BINDINGS:
            if other != name and re.search(rf"\b(from|join) {other}\b", BINDINGS[name]):
                visit(other)
        order.append(name)

    for n in names:
        visit(n)
    return order


def with_bindings(sql: str) -> str:
    """`sql` with the bindings that it names in front, as common table expressions."""
    used = [n for n in BINDINGS if re.search(rf"\b(from|join) {n}\b", sql)]
    if not used:
        return sql
    head = ", ".join(f"{n} as ({BINDINGS[n]})" for n in _closure(used))
    if sql.lstrip().lower().startswith("with "):
        return f"with {head}, {sql.lstrip()[5:]}"
    return f"with {head} {sql}"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One canonical table as a DataFrame."""
    sql = with_bindings(f"select * from {name}")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if re.search(rf"\b(from|join) {t}\b", sql)}
    return spark.sql(re.sub(r"\b(from|join) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}} {m[2]}" if m[2] in frames and not re.match(r" [a-z]\b", sql[m.end() :]) else (f"{m[1]} {{{m[2]}}}" if m[2] in frames else m[0]), sql), **frames)
