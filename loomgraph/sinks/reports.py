"""Reports as JSON and Markdown.  Lists in Markdown are short; the rows of a JSON list are written one at a time."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import hotspots as hs
from loomgraph.operators import soft_edges as se

#: Rows of each list in the reports.
TOP_ANTI_PATTERNS, TOP_HAZARDS, TOP_HIGH_RISK, TOP_DETAILS, TOP_LOW_RISK, TOP_HOTSPOTS, TOP_SOFT, TOP_CANDIDATES = 20, 30, 40, 5, 20, 50, 30, 20


def utc_now() -> str:
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat().replace("+00:00", "Z")


def _rows(df: DataFrame) -> Iterable[str]:
    return (r.j for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator())


def write_json(path: Path, head: dict[str, Any], lists: dict[str, DataFrame]) -> None:
    """An object with plain fields and with lists that go to the file row by row."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("{\n" + ",\n".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False, default=str)}" for k, v in head.items()))
        for name, df in lists.items():
            f.write(f',\n{json.dumps(name)}: [')
            for i, row in enumerate(_rows(df)):
                f.write((",\n" if i else "\n") + row)
            f.write("]")
        f.write("\n}\n")


def _table(heads: str, rows: Iterable[Iterable[Any]]) -> list[str]:
    names = heads.split("|")
    return [f"| {' | '.join(n.strip() for n in names)} |", "|" + "---|" * len(names), *(f"| {' | '.join(map(str, r))} |" for r in rows), ""]


def _link(r: Any) -> str:
    name = (r["file_path"] or "").replace("\\", "/").rpartition("/")[2]
    return f"[`{r['fqn']}`]({name}#L{r['line_start'] or 0})" if name else f"`{r['fqn']}`"


def write_hotspots(folder: str, scored: DataFrame, state: DataFrame) -> dict[str, int]:
    """hotspots.json (all rows) and hotspots.md (the tops, tests left out); gives the number of risky fields by class.

    `state` is `hotspots.shared_state` with names."""
    at = Path(folder)
    ranked_state = state.orderBy(F.desc("risk"), F.desc("writers"), "target")
    full = scored.withColumn("anti_pattern_reasons", hs.reasons())
    write_json(at / "hotspots.json", {"schema_version": 1, "report_kind": "hotspots"}, {"hotspots": hs.ranked(full), "shared_mutable_state": ranked_state})
    shown = full.where("not is_test")
    lines = ["# Repository Hotspots", "", "> `Effective Fan-in/Fan-out` gives edges that a framework owns a lower weight; the edges themselves are all here.", ""]
    worst = hs.numbered(shown.where(F.size("anti_pattern_reasons") > 0), [F.desc("score"), "fqn"], TOP_ANTI_PATTERNS).collect()
    if worst:
        lines += ["## Anti-Pattern Warnings (God Class / Service Locator)", ""]
        lines += _table("Rank | Danger Score | Reason | Symbol (FQN) | LOC | Fan-in | Effective Fan-in", ((r["rank"], r["danger_score"], ", ".join(r["anti_pattern_reasons"]), _link(r), r["loc"], r["fan_in"], f"{r['effective_fan_in']:.2f}") for r in worst))
    hazards = hs.numbered(shown.where("is_hazard"), [F.desc("score"), "fqn"], TOP_HAZARDS).collect()
    if hazards:
        flags = [c for c in hs.THREAD_FLAGS if c in scored.columns]
        lines += ["## Threading Hazard Warnings", ""]
        lines += _table("# | Symbol (FQN) | " + " | ".join(c.removeprefix("has_") for c in flags), ((r["rank"], _link(r), *("yes" if r[c] else "-" for c in flags)) for r in hazards))
    high = hs.ranked_state(state.where("runtime > 0 or event > 0"), TOP_HIGH_RISK).collect()
    if high:
        lines += ["## Shared Mutable State (Runtime/Event - High Risk)", ""]
        lines += _table("# | Field | Risk Score | Runtime | Event | Init | Readers | Type", ((r["rank"], f"`{r['target']}`", f"{r['risk']:.1f}", r["runtime"], r["event"], r["init"], r["readers"], r["spread"]) for r in high))
        for r in high[:TOP_DETAILS]:
            lines += [f"<details><summary>{r['target']}</summary>", ""]
            for label, names in (("Runtime writers", r["runtime_names"]), ("Event writers", r["event_names"])):
                lines += [f"**{label}:**", *(f"- `{w}`" for w in names)] if names else []
            lines += ["", "</details>", ""]
    low = hs.ranked_state(state.where("runtime = 0 and event = 0"), TOP_LOW_RISK).collect()
    if low:
        lines += ["## Shared Mutable State (Init-only - Low Risk Wiring)", ""]
        lines += _table("# | Field | Init Writers | Readers | Type", ((r["rank"], f"`{r['target']}`", r["init"], r["readers"], r["spread"]) for r in low))
    lines += [f"## Top {TOP_HOTSPOTS} Hotspots (General)", ""]
    lines += _table("Rank | Score | Kind | Symbol (FQN) | LOC | Fan-in | Effective Fan-in | Fan-out | Effective Fan-out", ((r["rank"], f"{r['score']:.4f}", r["kind"], _link(r), r["loc"], r["fan_in"], f"{r['effective_fan_in']:.2f}", r["fan_out"], f"{r['effective_fan_out']:.2f}") for r in hs.numbered(shown, [F.desc("score"), "fqn"], TOP_HOTSPOTS).collect()))
    (at / "hotspots.md").write_text("\n".join(lines), encoding="utf-8")
    return {r["risk_class"]: r["n"] for r in hs.risks(state).collect()}


SIGNAL_LABELS = {"callers": "callers", "type_users": "type users", "field_users": "field users", "derived_types": "derived types", "callees": "callees", "used_types": "used types", "used_fields": "used fields", "containing_type_users": "owning type users"}


def _counts(rows: DataFrame, key: str) -> dict[str, int]:
    return {r[key]: r["n"] for r in rows.groupBy(key).agg(F.sum("n").alias("n")).orderBy(key).collect()}


def write_isolation(folder: str, candidates: DataFrame, counters: DataFrame, categories: DataFrame, summary: DataFrame, soft: DataFrame | None = None) -> None:
    """The isolation report, as Markdown and JSON, each under its present and its former name.

    `candidates`: fqn, kind, loc, file_path, labels, category, related (array of fqn, kind, score, reasons), the signals,
    why and facts; `counters`: `isolation.rule_counters`; `summary`: `isolation.rule_summary`; `soft`: what only soft edges
    reach (`isolation.soft_suppressed`), where they counted.
    """
    at = Path(folder)
    ordered = candidates.orderBy(F.array_position(F.array(*map(F.lit, ("isolated", "structural-sibling", "near-family"))), F.col("category")), F.desc("loc"), "fqn")
    by_category = {r["category"]: r["n"] for r in categories.collect()}
    counted = {f"{name}_by_{key}": _counts(counters.where(F.col("policy") == policy), column) for policy, name in (("suppress", "suppressed"), ("label", "labeled")) for key, column in (("rule", "rule"), ("family", "family"))}
    buckets: dict[str, dict[str, dict[str, int]]] = {a: {b: {} for b in ("call_inbound", "call_outbound", "type_inbound", "type_outbound")} for a in ("rule_family", "rule_mode")}
    for r in summary.where("attribute in ('rule_family', 'rule_mode')").collect():
        buckets[r["attribute"]][r["bucket"]][r["value"]] = r["n"]
    softly = [] if soft is None else [r.asDict() for r in soft.orderBy("fqn").limit(TOP_SOFT).collect()]
    head = {"analysis_mode": "hard-only" if soft is None else "hard+ai-soft-edges", "report_kind": "structural_isolation_candidates", "rule_family_summary": buckets["rule_family"], "rule_mode_summary": buckets["rule_mode"], **counted}
    lists = {"candidates": ordered, "suppressed_by_ai_soft_edges": soft if soft is not None else candidates.select("fqn").where("false")}
    top = ordered.limit(TOP_CANDIDATES).collect()
    lines = ["# Structural Isolation Candidates", "", "> **Warning**: these are places to look at, told from the structure alone, and no verdict that code is dead.", "", "## Investigation Categories", ""]
    lines += [f"- `{c}`: {n}" for c, n in by_category.items()] + [""]
    for title, name in (("Suppressed Convention Patterns", "suppressed"), ("Convention Labels Kept In Candidates", "labeled")):
        if counted[f"{name}_by_rule"]:
            lines += [f"## {title}", "", *_table("Family | Count", ((f"`{k}`", n) for k, n in counted[f"{name}_by_family"].items())), *_table("Rule | Count", ((f"`{k}`", n) for k, n in counted[f"{name}_by_rule"].items()))]
    if softly:
        ticked = lambda xs: ", ".join(f"`{x}`" for x in xs)
        lines += ["## Suppressed By AI Soft Edges", "", *_table("Symbol | Kind | Soft Edge Count | Soft Edge Types | Soft Sources", ((f"`{r['fqn']}`", r["kind"], r["edge_count"], ticked(r["edge_types"]), ticked(r["sources"])) for r in softly))]
    heads = "| Rank | Category | Primary Label | Labels | Related | LOC | Kind | Why It Looks Isolated | Symbol (FQN) | File |"
    lines += [heads, "|" + "---|" * 10]
    tail: list[str] = []
    if top:
        tail += ["", "## Why These Candidates Surfaced", ""]
        for c in top:
            tail += [f"<details><summary>`{c['fqn']}`</summary>", "", f"- category: `{c['category']}`", f"- why: {c['why']}"]
            tail += [f"- reason labels: {', '.join(f'`{x}`' for x in c['labels'])}"] if c["labels"] else []
            tail += [f"- structural signals: {', '.join(f'{label}={c[k]}' for k, label in SIGNAL_LABELS.items() if k in c)}"]
            tail += ["- explanation facts:", *(f"  - {x}" for x in c["facts"][:6])] if c["facts"] else []
            near = [f"  - `{r['fqn']}` ({r['kind']}, score {r['score']:.4f}) -- {', '.join(r['reasons'][:4])}" for r in c["related"] or []]
            tail += ["- nearby symbols:", *near] if near else ["- nearby symbols: none above the similarity threshold"]
            tail += ["", "</details>", ""]
        if any(c["related"] for c in top):
            tail += ["## Related Existing Implementations", ""]
            for c in top:
                if c["related"]:
                    tail += [f"<details><summary>`{c['fqn']}`</summary>", "", *(f"- `{r['fqn']}` ({r['kind']}, score {r['score']:.4f})" for r in c["related"]), "", "</details>", ""]
    names = ("structural_isolation_candidates", "dead_code_candidates")
    at.mkdir(parents=True, exist_ok=True)
    write_json(at / f"{names[0]}.json", head, lists)
    with open(at / f"{names[0]}.md", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
        for i, c in enumerate(ordered.toLocalIterator(), 1):
            primary = f"`{c['labels'][0]}`" if c["labels"] else "-"
            name = (c["file_path"] or "").replace("\\", "/").rpartition("/")[2]
            f.write(f"| {i} | `{c['category']}` | {primary} | {', '.join(f'`{x}`' for x in c['labels'][:3]) or '-'} | {len(c['related'] or [])} | {c['loc']} | {c['kind']} | {c['why']} | `{c['fqn']}` | {name} |\n")
        f.write("\n".join(tail))
    for suffix in ("json", "md"):
        (at / f"{names[1]}.{suffix}").write_bytes((at / f"{names[0]}.{suffix}").read_bytes())


def import_soft_edges(spark, path: str, folder: str, replace: bool = False) -> dict[str, Any]:  # noqa: ANN001
    """Reads soft edges from a file into ai_soft_edges.json of the reports: merged with those there, or in their place."""
    from loomgraph.sources import files

    new, header = files.read_soft_import(spark, path)
    target = Path(folder) / "ai_soft_edges.json"
    if not replace and target.exists():
        have, old = files.read_soft_import(spark, target)
        merged = se.merge(have, new)
        header = {"schema_version": max(old["schema_version"], header["schema_version"]), "generated_by": "loomgraph.import", "notes": header["notes"] or old["notes"]}
    else:
        merged = new
    rows = [r.asDict() for r in se.sorted_edges(merged).select("source", "target", "type", "confidence", "evidence", "notes").collect()]  # what people suggested
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(header | {"edges": rows}, indent=2, ensure_ascii=False), encoding="utf-8")
    return {"path": str(target), "edge_count": len(rows), "replace": replace}


#: What a reviewer of each kind of candidate should look for.
GUIDANCE = {
    "xaml": ("Find out whether the markup hooks up the handlers or commands that nothing reaches.", ["XAML x:Class", "event/action/command binding", "code-behind handler", "runtime hookup"], "There is no evidence, or the markup is unused.", ["xaml_fqn"], ["weak_handlers FQNs"]),
    "reflection": ("Find the types or methods that reflection reaches.", ["Activator.CreateInstance", "assembly load", "type discovery", "constructor/method invocation", "target type resolution"], "The target is only known at run time and cannot be bounded.", ["context_symbols FQNs"], ["The discovered target FQNs"]),
    "di": ("Find the implementations behind the interfaces that are asked for.", ["registration", "resolve call", "container module", "service interface to implementation relation"], "The resolution is ambiguous, or the container is not known.", ["context_symbols FQNs"], ["The injected implementation FQNs"]),
}


def bundle(workspace: str | None, kind: str, candidates: list[dict[str, Any]]) -> dict[str, Any]:
    """The candidates with what a reviewer needs to propose soft edges."""
    keys = ("review_goal", "evidence_checklist", "do_not_create_soft_edge_when", "suggested_source_fields", "suggested_target_fields")
    each = [c | ({"review_guidance": dict(zip(keys, GUIDANCE[c["candidate_kind"]]))} if c.get("candidate_kind") in GUIDANCE else {}) for c in candidates]
    at = workspace or "<workspace>"
    return {
        "bundle_schema_version": 1.2,
        "generated_at": utc_now(),
        "workspace": workspace,
        "kind": kind,
        "usage_notes": "Places where the graph may lack edges: look at them, they are no confirmed edges. Propose a soft edge only with evidence.",
        "soft_edge_output_contract": {"purpose": "Soft edges are suggestions and no edges of the graph.", "required_fields": ["source", "target", "type", "confidence", "evidence"], "constraints": ["Without evidence propose none.", "Leave ambiguous cases as candidates."]},
        "rule_mode_legend": {"HardEdge": "Confirmed by the parser.", "Candidate": "Suspected by a rule, to be reviewed."},
        "rule_family_summary": "Families are mostly xaml, reflection or di.",
        "recommended_commands": [f'python -m loomgraph symbols --workspace {at} "<fqn>"', f"python -m loomgraph import-ai-edges <soft_edges.json> --workspace {at}"],
        "candidates": each,
    }
