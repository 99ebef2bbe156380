"""Folds over many ranges against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import nesting as H
from lectern.operators.structure import group_pages


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """So many ranges that groups reach over several."""
    held = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def nearest(levels, i, step, fits):
    j = i + step
    while 0 <= j < len(levels):
        if levels[j] is not None and levels[i] is not None and fits(levels[j], levels[i]):
            return j
        j += step
    return None


@pytest.mark.parametrize("deepest", [1, 3, 40])
def test_nearest_both_ways(spark, deepest):
    rng = random.Random(deepest)
    groups = {"a": 400, "b": 3, None: 60, "c": 1}
    levels = {g: [rng.randint(0, deepest) if rng.random() > 0.05 else None for _ in range(n)] for g, n in groups.items()}
    rows = [(g, i, x) for g, xs in levels.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g string, line long, level long")
    up = {(r["g"], r["line"]): r["parent"] for r in H.parents(df, "g").collect()}
    end = {(r["g"], r["line"]): r["until"] for r in H.subtree_end(df, "g").collect()}
    assert len(up) == len(end) == len(rows)
    for g, xs in levels.items():
        for i in range(len(xs)):
            assert up[g, i] == nearest(xs, i, -1, lambda a, b: a < b)
            assert end[g, i] == nearest(xs, i, 1, lambda a, b: a <= b)


def test_rising_and_falling_levels_over_ranges(spark):
    """Stacks of full depth that all ranges add to, and none."""
    n = 300
    df = spark.createDataFrame([("up", i, i) for i in range(n)] + [("down", i, n - i) for i in range(n)] + [("flat", i, 1) for i in range(n)], "g string, line long, level long")
    up = {(r["g"], r["line"]): r["parent"] for r in H.parents(df, "g").collect()}
    assert all(up["up", i] == (i - 1 if i else None) and up["down", i] is None and up["flat", i] is None for i in range(n))
    below = {(r["g"], r["line"]): r["descendants"] for r in H.descendants(df, "g").collect()}
    assert all(below["up", i] == n - 1 - i and below["down", i] == 0 and below["flat", i] == 0 for i in range(n))


def test_size_batches(spark):
    rng = random.Random(5)
    sizes = [rng.choice([0, 1, 5, 30, 200]) for _ in range(500)]
    want, first, held = [], 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held > 100 and i > first:
            want.append((first, i))
            first, held = i, n
    want.append((first, len(sizes)))
    df = spark.createDataFrame([("x", i, n) for i, n in enumerate(sizes)], "g string, i long, n long")
    got = sorted((r["batch"], r["first"], r["end"]) for r in H.size_batches(df, "g", ["i"], "n", 100).collect())
    assert got == [(b, *w) for b, w in enumerate(want)]


def test_page_groups(spark):
    rng = random.Random(6)
    docs = {d: [rng.choice([0, 1, 7, 40, 90]) for _ in range(n)] for d, n in enumerate([1, 2, 50, 300, 3])}
    df = spark.createDataFrame([(d, i, n) for d, ns in docs.items() for i, n in enumerate(ns)], "doc long, page long, tokens long")
    for overlap in (0, 1, 3):
        got = sorted((r["doc"], r["page_group"], r["first_page"], r["end_page"]) for r in H.page_groups(df, "doc", "page", "tokens", 60, overlap).collect())
        assert got == [(d, g, a, z) for d, ns in docs.items() for g, (a, z) in enumerate(group_pages(ns, 60, overlap))]


def test_lines_by_height(spark):
    items = [("p", 100.0, 3), ("p", 99.5, 1), ("p", 98.9, 2), ("p", 50.0, 1), ("q", 1.0, 1)]
    df = spark.createDataFrame(items, "page string, y double, x long")
    got = sorted((r["page"], r["line"], r["first"], r["end"]) for r in H.lines_by_height(df, "page", "y", "x", 1.0).collect())
    assert got == [("p", 0, 0, 2), ("p", 1, 2, 3), ("p", 2, 3, 4), ("q", 0, 0, 1)]


def test_empty(spark):
    none = spark.createDataFrame([], "g string, line long, level long")
    assert H.parents(none, "g").count() == 0 and H.descendants(none, "g").count() == 0
    assert H.size_batches(none, "g", ["line"], "level", 5).count() == 0
