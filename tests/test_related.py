"""Related symbols, their resolution and suggestions, vector search."""

import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import isolation, retrieval, similarity

SYMBOL = "fqn string, name string, kind string, containing_type string, namespace string, project_id string, file_path string, return_type string, parameter_count long"


def symbol(fqn, name, returns="Boolean", kind="method", owner="App.ListUtils", path="C:\\r\\ListUtils.cs"):
    return fqn, name, kind, owner, "App", "p", path, returns, 1


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame([symbol("App.ListUtils.TryGetLast()", "TryGetLast"), symbol("App.ListUtils.TryGetFirst()", "TryGetFirst"), symbol("App.ListUtils.GetLastOrDefault()", "GetLastOrDefault", "T"), symbol("xaml::App", "App", kind="xaml")], SYMBOL)


@pytest.fixture(scope="module")
def features(spark):
    calls = spark.createDataFrame([("App.Controller.UseList()", "App.ListUtils.TryGetLast()"), ("App.Controller.UseList()", "App.ListUtils.TryGetFirst()")], "caller string, callee string")
    uses = spark.createDataFrame([(f"App.ListUtils.{n}()", "IReadOnlyList<T>") for n in ("TryGetLast", "TryGetFirst", "GetLastOrDefault")], "source string, target string")
    empty = spark.createDataFrame([], "a string, b string")
    return similarity.feature_sets({"call": (calls, "caller", "callee"), "type_dependency": (uses, "source", "target"), "inheritance": (empty, "a", "b"), "field_access": (empty, "a", "b")})


def test_family_members_rank_first(spark, symbols, features):
    one = spark.createDataFrame([("App.ListUtils.TryGetLast()",)], "fqn string")
    got = [(r["fqn"], r["score"]) for r in similarity.related(symbols, features, one, 10).orderBy("rank").collect()]
    assert got == [("App.ListUtils.TryGetFirst()", 1.4643), ("App.ListUtils.GetLastOrDefault()", 1.0887)]
    reasons = similarity.related(symbols, features, one, 1).first()["reasons"]
    assert reasons[:2] == ["same kind", "name tokens 0.71"] and "shared callers 1.00" in reasons and "same file" in reasons and "name shape 0.76" in reasons
    assert similarity.related(symbols, features, one, 10, least=1.2).count() == 1
    with pytest.raises(ValueError):
        similarity.related(symbols, features, spark.range(1001).select(F.col("id").cast("string").alias("fqn")))


def test_looking_at_shapes_late_loses_nothing(spark):
    rng = np.random.default_rng(5)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    names = ["Load" + pick(["Item", "Items", "User", "Users", "Order"]) + pick(["", "Async", "Now", "Later"]) for _ in range(60)]
    rows = [(f"N{i % 3}.T{i % 5}.{n}(x{i})", n, "method", f"N{i % 3}.T{i % 5}", f"N{i % 3}", "p", f"/r/{pick(['Alpha', 'AlphaView', 'Beta'])}.cs", pick(["int", "void"]), i % 3) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, SYMBOL)
    nothing = spark.createDataFrame([], "node string, " + ", ".join(f"{f} array<string>" for f in similarity.FEATURES))
    got = similarity.related(df, nothing, df.limit(7).select("fqn"), 4).collect()
    tokens = {r.fqn: set(r.t) for r in df.select("fqn", similarity.name_tokens(F.col("fqn")).alias("t")).collect()}

    def score(a, b):
        s = 0.2 + 0.35 * len(tokens[a[0]] & tokens[b[0]]) / len(tokens[a[0]] | tokens[b[0]]) + 0.2 * (a[3] == b[3]) + 0.1 * (a[4] == b[4]) + 0.08 + 0.05 * (a[7] == b[7]) + 0.05 * (a[8] == b[8])
        r = difflib.SequenceMatcher(None, a[1], b[1]).ratio()
        s += 0.15 * r * (r > 0.55)
        f, g = a[6][3:-3], b[6][3:-3]
        q = difflib.SequenceMatcher(None, f.lower(), g.lower()).ratio()
        return round(s + (0.08 if f == g else 0.05 * q * (q >= 0.65)), 4)

    asked = {r.source for r in got}
    for a in rows:
        if a[0] in asked:
            every = {b[0]: score(a, b) for b in rows if b is not a}
            mine = {r.fqn: r.score for r in got if r.source == a[0]}
            assert all(mine[f] == pytest.approx(every[f], abs=1.01e-4) for f in mine) and sorted(mine.values()) == pytest.approx(sorted(every.values())[-4:], abs=1.01e-4)


def test_resolution_counts_each_tier_by_itself(spark):
    df = spark.createDataFrame([("A.Load", "Load"), ("B.Load", "Load"), ("C.Reload", "Reload"), ("D.Save", "Save")], "fqn string, name string")
    one = lambda q: [tuple(r) for r in similarity.resolve(df, q).collect()]
    assert one("load") == [] and one("A.Load") == [("A.Load", 0)] and one("SAVE") == [("D.Save", 1)] and one("c.rel") == [("C.Reload", 2)] and one("zzz") == []


def test_suggestions(spark):
    df = spark.createDataFrame([("A.Load",), ("A.Reload",), ("B.Save",)], "fqn string")
    got = [r["fqn"] for r in similarity.suggest(df, "reload", 2).orderBy("rank").collect()]
    assert got == ["A.Reload", "A.Load"]


def test_pairs_of_token_sets(spark):
    df = spark.createDataFrame([("method", "GetLastItem"), ("method", "GetFirstItem"), ("method", "GetLastItem"), ("method", "LastItemGet"), ("field", "GetLastItems"), ("method", "GetLastItemOf")], "kind string, name string")
    got = {(r["kind"], r["a"], r["b"], r["n_a"], r["n_b"], r["score"]) for r in similarity.token_pairs(df).collect()}
    assert got == {("method", "get item last", "get item last of", 3, 1, 0.75)}


@pytest.mark.parametrize("score,reasons,want", [(None, None, "isolated"), (0.8, ["same namespace", "name tokens 0.5"], "near-family"), (0.6, ["shared callers 0.5"], "structural-sibling"), (0.6, ["same kind"], "isolated"), (0.5, ["same namespace"], "isolated")])
def test_category(spark, score, reasons, want):
    df = spark.createDataFrame([(score, reasons)], "score double, reasons array<string>")
    assert df.select(isolation.category(F.col("score"), F.col("reasons"))).first()[0] == want
    counts = {r["category"]: r["n"] for r in isolation.category_counts(df.withColumn("category", F.lit(want))).collect()}
    assert counts[want] == 1 and sum(counts.values()) == 1 and len(counts) == 3


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(i, [float(y) for y in x], i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for most in (1000, 2):
        monkeypatch.setattr(retrieval, "MOST_QUERIES", most)
        got = retrieval.nearest(df, df.where("vec_id < 5"), 3).collect()
        for q in range(5):
            order = [i for i in np.argsort(-unit @ unit[q]) if i != q][:3]
            assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == order
    assert retrieval.nearest(df, df.where("vec_id < 5"), 3, "label = 9").count() == 0
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {r["score"] for r in retrieval.nearest(zero, zero, 1).collect()} == {0.0}


def test_questions(spark):
    s = spark.createDataFrame([("A.LoadUser", "method", "p", "method A.LoadUser"), ("A.SaveOrder", "method", "q", "method A.SaveOrder")], "fqn string, kind string, project_id string, summary string")
    embed = retrieval.hashed_embedding(64)
    index = retrieval.build_index(s.select("fqn", "kind", "project_id"), s.select("fqn", "summary"), embed)
    calls = spark.createDataFrame([("Main", "A.LoadUser")], "caller string, callee string")
    hits = retrieval.search(index, "load a user", embed, {"call": (calls, "caller", "callee")}, 2).collect()
    assert [h["fqn"] for h in hits] == ["A.LoadUser", "A.SaveOrder"] and hits[0]["context"] == ["Called by: Main"] and hits[1]["context"] == []
    assert [h["fqn"] for h in retrieval.search(index, "load a user", embed, {"call": (calls, "caller", "callee")}, 2, project_id="q").collect()] == ["A.SaveOrder"]
    assert retrieval.search(index, "x", embed, {"call": (calls, "caller", "callee")}, 2, kind="class").count() == 0


def test_any_number_of_sources(spark, monkeypatch):
    names = [f"App.{'Order' if i % 3 else 'Part'}{'Load' if i % 2 else 'Save'}{i}" for i in range(60)]
    symbols = spark.createDataFrame([(n, n[4:], "constructor", "App.T", "App", "p", f"C:/{i % 5}.cs", "void", i % 4) for i, n in enumerate(names)], "fqn string, name string, kind string, containing_type string, namespace string, project_id string, file_path string, return_type string, parameter_count long")
    features = similarity.feature_sets({"call": (spark.createDataFrame([(n, names[(i * 7) % 60]) for i, n in enumerate(names)], "s string, t string"), "s", "t")} | {g: (spark.createDataFrame([], "s string, t string"), "s", "t") for g in ("inheritance", "type_dependency", "field_access")})
    want = sorted(map(str, similarity.related(symbols, features, symbols, 3, shapes=False).collect()))
    monkeypatch.setattr(similarity, "MOST_SOURCES", 25)
    assert sorted(map(str, similarity.related_in_blocks(symbols, features, symbols, 3, shapes=False).collect())) == want and len(want) == 180
    assert similarity.related_in_blocks(symbols, features, symbols.limit(0), 3).count() == 0
