"""The graph files of a store hold every edge of the scan."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import registry
from loomgraph.sinks.store import write_graph
from loomgraph.sources import files
from tests.test_registry import AT


def test_graph_files_hold_every_edge(spark):
    t = registry.Tables(spark, AT)
    got = {r.graph: r.edges for r in registry.graph_files(t).collect()}
    lines = spark.read.parquet(f"{AT}/lineitem.parquet")
    methods, types, fields = (getattr(t, n).select(F.col("k").alias(f"k_{n}"), F.col("fqn").alias(n)) for n in ("methods", "types", "fields"))
    used = lines.join(methods, F.col("l_partkey") == F.col("k_methods")).join(types, F.col("l_suppkey") == F.col("k_types")).select("methods", "types").distinct().count()
    assert got["type_dependency"] == used + t.markup.count()
    orders = spark.read.parquet(f"{AT}/orders.parquet")
    touched = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(methods, F.col("l_partkey") == F.col("k_methods")).join(fields, F.col("o_custkey") == F.col("k_fields"))
    assert got["field_access"] >= touched.select("methods", "fields").distinct().count() > 0
    homes = [spark.read.parquet(f"{AT}/{n}.parquet") for n in ("customer", "supplier")]
    refs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(homes[0], F.col("o_custkey") == F.col("c_custkey")).join(homes[1], F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    assert got["dependency"] == refs.select("c_nationkey", "s_nationkey").distinct().count()
    assert got["call"] == t.method_calls.where("caller not like 'framework::%'").select("caller", "callee").distinct().count()


def test_files_of_the_store_are_read_by_tasks(spark, tmp_path, monkeypatch):
    at, n = tmp_path / "g [1].json", 500
    nodes = spark.range(n).select(F.concat(F.lit("n\n\"é,{"), F.col("id")).alias("id"), F.lit("method").alias("kind"))
    links = spark.range(3 * n).repartition(5).orderBy("id").select(F.concat(F.lit("n"), F.col("id") % n).alias("source"), F.lit("],  \"links\": [").alias("target"), F.col("id").cast("string").alias("type"))
    write_graph(at, "call", nodes, links, "run")
    doc = json.loads(at.read_text(encoding="utf-8"))
    assert len(doc["nodes"]) == n and [e["type"] for e in doc["links"]] == [str(i) for i in range(3 * n)]
    rows = lambda g: ({r.id for r in g.nodes.collect()}, {(r.source, r.target, r.type) for r in g.edges.collect()})
    with monkeypatch.context() as m:
        m.setattr(files, "_blocks", lambda *_: pytest.fail("the driver reads the graph"))
        for most in ("128m", "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            try:
                g = files.read_graph(spark, at)
                found = rows(g)
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
            assert found[1] == {(f"n{i % n}", '],  "links": [', str(i)) for i in range(2 * n, 3 * n)} and len(found[0]) == 2 * n + 1
            assert g.about["analysis_run_id"] == "run"
        write_graph(tmp_path / "none.json", "call", nodes.limit(0), links.limit(0), "run")
        assert rows(files.read_graph(spark, tmp_path / "none.json")) == (set(), set())
    lines = at.read_text(encoding="utf-8").split("\n")
    for change in ({2: lines[2] + lines[3]}, {2: lines[2] + " x"}, {2: lines[2][1:]}, {1: "," + lines[1]}, {n + 5: lines[n + 5] + "\n"}, {n + 5: ',{"source": "a", "target": "b", "call_count": "many"}'}, {len(lines) - 2: ""}):
        at.write_text("\n".join(change.get(i, line) for i, line in enumerate(lines)), encoding="utf-8")
        by_line = rows(files.read_graph(spark, at))
        with monkeypatch.context() as m:
            m.setattr(files, "_lines", lambda *_: None)
            assert rows(files.read_graph(spark, at)) == by_line, change
