"""Composite plans on a small book, and the tool registry."""

from pyspark.sql import functions as F

from lectern.plans import indexing as P
from lectern.plans import tools


def test_index_books(spark):
    texts = spark.createDataFrame([("b", "# One\nalpha beta\n## Sub\ngamma\n# Two\nalpha")], "book_id string, text string")
    c = P.index_books(texts)
    got = [(r["node_id"], r["title"], r["text"], r["parent"]) for r in c.tables["nodes"].orderBy("line").collect()]
    assert got == [("0000", "One", "alpha beta", None), ("0001", "Sub", "gamma", 0), ("0002", "Two", "alpha", None)]
    assert {r["token"]: r["df"] for r in c.tables["df"].collect()}["alpha"] == 2
    assert {r["level"]: r["n"] for r in c.tables["vector_rows"].groupBy("level").agg(F.count("*").alias("n")).collect()} == {"L0": 1, "L1": 3, "L2": 3}


def test_refresh_notes(spark):
    stored = spark.createDataFrame([("a", "1", "old a"), ("b", "1", "old b"), ("c", "1", "old c")], "path string, hash string, row string")
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    rows, kinds = P.refresh_notes(files, stored, lambda d: d.withColumn("row", F.concat(F.lit("new "), "path")))
    assert sorted(r["row"] for r in rows.collect()) == ["new b", "new d", "old a"]
    assert {r["path"]: r["change"] for r in kinds.collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}


def test_claims(spark):
    nodes = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "delta")], "id long, text string")
    claims = spark.createDataFrame([(0, "alpha"), (1, "omega")], "q long, text string")
    assert {r["q"]: r["contradicted"] for r in P.claims_contradicted(claims, nodes, "q", "id").collect()} == {0: True, 1: False}


def test_tools():
    @tools.tool("search", keywords=tools.keywords_rule(), k=tools.Rule(int, 1, 50))
    def search(keywords, k=5):
        return keywords[:k] if keywords != ["boom"] else 1 / 0

    assert tools.call("search", keywords=["a", "b"], k=1) == {"result": ["a"]}
    assert "between" in tools.call("search", keywords=[])["error"]
    assert "unknown" in tools.call("search", keywords=["a"], x=1)["error"]
    assert "ZeroDivisionError" in tools.call("search", keywords=["boom"])["error"]
    assert "no tool" in tools.call("search", allowed=set(), keywords=["a"])["error"]
