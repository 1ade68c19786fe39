"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from loomgraph.operators import isolation
from loomgraph.plans import registry

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return c


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def tables(spark):
    """One set of bound tables for all queries: what several of them store is stored once."""
    return registry.Tables(spark, AT)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, tables, monkeypatch, name):
    monkeypatch.setattr(registry, "Tables", lambda *_: tables)
    got = registry.QUERIES[name](spark, AT)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


LARGER = "/root/testdata/sf0.01"


def test_no_branch_is_empty(spark):
    reasons = {r[0] for r in registry.QUERIES["isolation_drop_reason"](spark, LARGER).select("drop_reason").distinct().collect()}
    assert reasons == {None, "suppressed_by_rule", "test_artifact", "called", "used_as_type", "constructor_of_used_type", "live_members", "has_derived", "ui_type", "entry_point", "accessor"}
    assert "soft_called" in {r[0] for r in registry.QUERIES["isolation_soft"](spark, LARGER).select("drop_reason").distinct().collect()}


def test_every_rule_has_rows(spark):
    found = {r[0] for r in registry.QUERIES["convention_rules"](spark, LARGER).select("rule").distinct().collect()}
    assert set(isolation.RULES) - found <= set()
    assert {r["spread"] for r in registry.QUERIES["shared_state_spread"](spark, LARGER).collect()} == {"none", "internal", "mixed", "external"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
