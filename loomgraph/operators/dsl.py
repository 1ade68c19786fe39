"""The declarative rule language: JSON rules compiled to column expressions and joins.

A record is a map from field names to texts.  A missing key and a null value differ: `exists` holds for a key that is
there, whatever its value; every other operator fails on a missing key, and on a null value all but `neq`.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The operators of conditions, those that are reserved for later, the kinds of edges, and the kinds of
#: records that a scan offers.
OPERATORS = ("eq", "neq", "in", "contains", "prefix", "suffix", "regex", "exists")
RESERVED_OPERATORS = ("has_attribute", "has_base_type", "is_assignable_to", "same_containing_type")
EDGE_KINDS = ("candidate_call", "candidate_type_dependency")
SOURCE_TYPES = ("csharp_symbol", "csharp_invocation", "xml_attribute")


@dataclass
class Condition:
    field: str
    op: str
    value: Any = None


@dataclass
class Rule:
    id: str
    source: str
    target: str | None
    where: list[Condition]
    bind: dict[str, str]
    target_kind: str | None
    target_where: list[Condition]
    emit: dict[str, str] = field(default_factory=dict)


class RuleError(ValueError):
    """A rule that cannot be compiled."""


def _folded(x: Any) -> Any:
    """Keys of objects in lower case: they are read whatever their case."""
    if isinstance(x, dict):
        return {k.lower(): (v if k.lower() == "bind" else _folded(v)) for k, v in x.items()}
    return [_folded(v) for v in x] if isinstance(x, list) else x


def _blank(x: Any) -> bool:
    return not (isinstance(x, str) and x.strip())


def problems(d: dict) -> list[str]:
    """What is wrong with a rule (keys in lower case); an empty list if it can be compiled."""
    found = []
    if _blank(d.get("id")):
        found.append("rule without an id")
    if _blank((d.get("scope") or {}).get("source")):
        found.append("scope without a source")
    target = ((d.get("resolve") or {}).get("target")) or {}
    for c in [*((d.get("match") or {}).get("where") or []), *(target.get("where") or [])]:
        if _blank(c.get("field")):
            found.append("condition without a field")
        op = c.get("op")
        if _blank(op):
            found.append("condition without an operator")
        elif op in RESERVED_OPERATORS:
            found.append(f"operator {op} is reserved")
        elif op not in OPERATORS:
            found.append(f"unknown operator {op}")
        elif op == "regex":
            for v in c.get("value") if isinstance(c.get("value"), list) else [c.get("value")]:
                try:
                    re.compile(v) if isinstance(v, str) else None
                except re.error:
                    found.append(f"pattern cannot be read: {v}")
    for k, v in (d.get("bind") or {}).items():
        if _blank(k):
            found.append("binding without a name")
        if _blank(v):
            found.append(f"binding {k} without an expression")
    emit = d.get("emit")
    if not emit:
        return [*found, "rule without an emit block"]
    if emit.get("edge_kind") not in EDGE_KINDS:
        found.append(f"unknown edge kind {emit.get('edge_kind')}")
    found += [f"emit without a {k}" for k in ("rule_id", "rule_family") if _blank(emit.get(k))]
    if emit.get("rule_mode") != "candidate":
        found.append("only candidates can be emitted")
    return found


def parse(text: str) -> Rule:
    """One rule from JSON (a byte-order mark is allowed); raises RuleError with everything that is wrong."""
    try:
        d = _folded(json.loads(text.lstrip("\ufeff")))
        wrong = problems(d)
        if wrong:
            raise RuleError("; ".join(wrong))
        target = ((d.get("resolve") or {}).get("target")) or {}
        conditions = lambda xs: [Condition(c["field"], c["op"], c.get("value")) for c in xs or []]
        return Rule(d["id"], d["scope"]["source"], d["scope"].get("target"), conditions((d.get("match") or {}).get("where")), d.get("bind") or {}, target.get("kind"), conditions(target.get("where")), d["emit"])
    except RuleError:
        raise
    except (AttributeError, KeyError, TypeError, ValueError) as e:
        raise RuleError(f"malformed rule: {e}") from e


def load_rules(folder: str) -> tuple[list[Rule], dict[str, str]]:
    """The rules of the .json files of a folder by file name, and what is wrong with those that cannot be read; a folder
    that does not exist has none."""
    rules, wrong = [], {}
    for path in sorted(Path(folder).glob("*.json")) if Path(folder).is_dir() else []:
        try:
            rules.append(parse(path.read_text(encoding="utf-8-sig")))
        except (OSError, UnicodeDecodeError, RuleError) as e:
            wrong[path.name] = str(e)
    return rules, wrong


def in_scope(rules: list[Rule], allowed: tuple[str, ...] = SOURCE_TYPES) -> list[Rule]:
    """The rules whose source records a scan offers."""
    return [r for r in rules if r.source in allowed]


def _test(value: Column, op: str, expected: Column) -> Column:
    if op in ("eq", "in", "neq"):
        return value == expected
    return {"contains": F.contains, "prefix": F.startswith, "suffix": F.endswith, "regex": F.regexp_like}[op](value, expected)


def condition(c: Condition, record: Column, bound: dict[str, Column] | None = None) -> Column:
    """The condition as a Boolean column that is never null."""
    has = F.map_contains_key(record, F.lit(c.field))
    if c.op == "exists":
        return has
    value = F.element_at(record, F.lit(c.field))
    raw = c.value if isinstance(c.value, list) else [c.value]
    expected: list[Column] = []
    for v in raw:
        if isinstance(v, str) and v.startswith("$"):
            name = v[1:]
            if bound is None or name not in bound:
                return F.lit(False)  # an unresolved variable fails every operator
            expected.append(bound[name])
        elif isinstance(v, str):
            expected.append(F.lit(v))
    if not expected:
        return has & F.lit(c.op == "neq")
    some = F.coalesce(reduce(lambda a, b: a | b, [_test(value, c.op, e) for e in expected]), F.lit(False))
    if c.op == "neq":
        variables = [e for e, v in zip(expected, raw) if isinstance(v, str) and v.startswith("$")]
        resolved = reduce(lambda a, b: a & b, [e.isNotNull() for e in variables], F.lit(True))
        return has & resolved & ~some
    return has & some


def conjunction(cs: list[Condition], record: Column, bound: dict[str, Column] | None = None) -> Column:
    return reduce(lambda a, b: a & b, [condition(c, record, bound) for c in cs], F.lit(True))


def bound_values(rule: Rule, record: Column) -> dict[str, tuple[Column, Column]]:
    """For each binding its value and whether it is bound: `$field` copies a field (unbound if the key is missing, bound to
    null if its value is), anything else is a text."""
    out = {}
    for name, v in rule.bind.items():
        at = v[1:] if v.startswith("$") else None
        out[name] = (F.lit(v), F.lit(True)) if at is None else (F.element_at(record, F.lit(at)), F.map_contains_key(record, F.lit(at)))
    return out


def bindings(rule: Rule, records: DataFrame) -> DataFrame:
    """(source_fqn, name, value) of the bound variables of each record that the rule matches."""
    matched = records.where(F.col("source_type") == rule.source).where(conjunction(rule.where, F.col("rec")))
    cells = [F.when(has, F.struct(F.lit(n).alias("name"), v.alias("value"))) for n, (v, has) in bound_values(rule, F.col("rec")).items()]
    if not cells:
        return matched.select(F.element_at("rec", F.lit("fqn")).alias("source_fqn"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value")).where("false")
    return matched.select(F.element_at("rec", F.lit("fqn")).alias("source_fqn"), F.explode(F.array_compact(F.array(*cells))).alias("b")).select("source_fqn", "b.name", "b.value")


def run(rule: Rule, records: DataFrame) -> DataFrame:
    """(source_fqn, target_fqn, type, rule_id, rule_family, rule_mode, diagnostic) of one rule over records
    (source_type, rec).

    A condition of the target on one variable becomes the key of a hash join: `eq` by its value; `suffix`, `prefix` and
    `contains` by the pieces of the target's value that are as long as some value of the variable (the different lengths
    are collected first; there are no more of them than characters in the longest value).  A list of values and
    `regex` are compared pair by pair: a rule with no key is a nested loop over its two kinds of records, and `keyed`
    tells which rules have one.
    """
    left = records.where(F.col("source_type") == rule.source).where(conjunction(rule.where, F.col("rec")))
    values = bound_values(rule, F.col("rec"))
    # an unbound variable fails every condition, as a null does in each of them but neq, which asks for it explicitly
    left = left.select(F.element_at("rec", F.lit("fqn")).alias("source_fqn"), *[F.when(has, v).alias(f"v_{n}") for n, (v, has) in values.items()])
    right = records if rule.target is None else records.where(F.col("source_type") == rule.target)
    if rule.target_kind:
        right = right.where(F.element_at("rec", F.lit("kind")) == rule.target_kind)
    right = right.where(conjunction([c for c in rule.target_where if not _variables(c)], F.col("rec"))).select(F.col("rec").alias("t_rec"))
    bound = {n: F.col(f"v_{n}") for n in values}
    on, rest = F.lit(True), []
    for i, c in enumerate(c for c in rule.target_where if _variables(c)):
        vs = _variables(c)
        alone = len(vs) == 1 and not isinstance(c.value, list) and vs[0] in bound
        value = F.element_at("t_rec", F.lit(c.field))
        if alone and c.op in ("eq", "in"):
            right = right.withColumn(f"k_{i}", value)
            on = on & (bound[vs[0]] == F.col(f"k_{i}"))
        elif alone and c.op in ("suffix", "prefix", "contains"):
            lengths = [r[0] for r in left.select(F.length(bound[vs[0]])).distinct().collect() if r[0] is not None]
            sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(value))
            piece = {"suffix": lambda n: F.array(F.substr(value, F.length(value) - n + 1)), "prefix": lambda n: F.array(F.substr(value, F.lit(1), n)), "contains": lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - n + 1, F.lit(1))), lambda j: F.substr(value, j, n))}[c.op]
            right = right.withColumn(f"k_{i}", F.explode(F.array_distinct(F.flatten(F.transform(sizes, piece)))))
            on = on & (bound[vs[0]] == F.col(f"k_{i}"))
        else:
            rest.append(c)
    joined = left.join(right, on).where(conjunction(rest, F.col("t_rec"), bound)).select("source_fqn", F.element_at("t_rec", F.lit("fqn")).alias("target_fqn")).distinct()
    e = rule.emit
    kind = e.get("call_type") or ("calls" if e["edge_kind"] == "candidate_call" else e["edge_kind"])
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    diagnostic = F.when(blank("source_fqn"), "missing_source_fqn").when(blank("target_fqn"), "missing_target_fqn")
    return joined.select("source_fqn", "target_fqn", F.lit(kind).alias("type"), F.lit(e.get("rule_id", rule.id)).alias("rule_id"), F.lit(e.get("rule_family")).alias("rule_family"), F.lit("candidate").alias("rule_mode"), diagnostic.alias("diagnostic"))


def keyed(rule: Rule) -> bool:
    """Whether a condition of the target gives `run` a key to join on."""
    return any(c.op in ("eq", "in", "suffix", "prefix", "contains") and len(_variables(c)) == 1 and not isinstance(c.value, list) and _variables(c)[0] in rule.bind for c in rule.target_where)


def emitted(rules: list[Rule], records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, diagnostics): the candidate edges of all rules, and the rows that lack an end."""
    found = run_all(rules, records)
    return found.where("diagnostic is null").drop("diagnostic"), found.where("diagnostic is not null")


def persisted(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """The candidate edges both of whose ends are symbols: the others are dropped when edges are stored."""
    ids = symbols.select("fqn")
    return edges.join(ids.withColumnRenamed("fqn", "source_fqn"), "source_fqn", "left_semi").join(ids.withColumnRenamed("fqn", "target_fqn"), "target_fqn", "left_semi")


def _variables(c: Condition) -> list[str]:
    return [v[1:] for v in (c.value if isinstance(c.value, list) else [c.value]) if isinstance(v, str) and v.startswith("$")]


def run_all(rules: list[Rule], records: DataFrame) -> DataFrame:
    """The edges of all rules."""
    return reduce(DataFrame.unionByName, [run(r, records) for r in rules])


def symbol_records(symbols: DataFrame) -> DataFrame:
    """Symbols as records; nulls become empty texts, numbers and flags texts."""
    cells = [x for c in symbols.columns for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return symbols.select(F.lit("csharp_symbol").alias("source_type"), F.create_map(*cells).alias("rec"))


def invocation_records(calls: DataFrame) -> DataFrame:
    """Invocations as records.  An unresolved one has only its caller and the method's name; of the rest, the generic
    argument's key is there only if there is one."""
    fields = {"method.name": "method_name", "method.fqn": "method_fqn", "method.containing_type": "method_type", "method.containing_namespace": "method_namespace", "argument_count": "argument_count", "invocation.generic_arg_count": "generic_arg_count", "invocation.generic_arg[0]": "generic_arg"}
    cells = [F.struct(F.lit("fqn").alias("key"), F.col("fqn").alias("value"))]
    cells += [F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value"))) for k, c in fields.items() if c in calls.columns]
    return calls.select(F.lit("csharp_invocation").alias("source_type"), F.map_from_entries(F.array_compact(F.array(*cells))).alias("rec"))
