"""Chains, rings and collisions of moves, and links spliced in place."""

from lectern.operators import reorganise as R


def test_chains_end_and_rings_stay(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(20)]
    moves = [("a", "b"), ("b", "c"), ("r1", "r2"), ("r2", "r1"), ("t1", "t2"), ("t2", "t3"), ("t3", "t1"), ("into", "t1"), ("s", "s"), ("x", "y2"), ("x", "y1"), *chain]
    got = {r["old"]: r["new"] for r in R.settled_moves(spark.createDataFrame(moves, "old string, new string")).collect()}
    assert got["a"] == got["b"] == "c" and got["x"] == "y1" and "r1" not in got and "s" not in got
    assert all(got[f"c{i}"] == "c20" for i in range(20))
    assert not {"t1", "t2", "t3", "into"} & set(got)


def test_links_are_spliced(spark):
    rows = [(1, "[[a]] x [[a#h|n]] [[ab]] [[b|q]]]] [[a"), (2, "none"), (3, ""), (4, None), (5, "[[b]][[a]]")]
    moves = spark.createDataFrame([("a", "d/a$1"), ("b", "e\\b")], "old string, new string")
    got = {r["k"]: (r["text"], r["links"]) for r in R.moved_texts(spark.createDataFrame(rows, "k long, text string"), moves, "k").collect()}
    assert got == {1: ("[[d/a$1]] x [[d/a$1#h|n]] [[ab]] [[e\\b|q]]]] [[a", 3), 5: ("[[e\\b]][[d/a$1]]", 2)}


def test_only_large_timelines_move(spark):
    files = [(f"t/2024-01-{i:02d}.md",) for i in range(1, 32)] + [("t/_目录x.md",), ("s/2024-01-01.md",), ("deep/er/2024-01-01.md",)]
    got = {r["old"]: r["new"] for r in R.planned_moves(spark.createDataFrame(files, "path string")).collect()}
    assert len(got) == 31 and got["t/2024-01-05"] == "t/2024/01/2024-01-05"
