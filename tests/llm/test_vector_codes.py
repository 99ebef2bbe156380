"""Codebooks by plain Lloyd rounds over every distance, against the pruned and persisted ones."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lectern.llm")

from lectern.llm import vector_codes as V


def plain(rows, parts=8, entries=16, rounds=6):
    """{row number: (code, error)} and the codebooks of rows of (id, vector, label)."""
    kept = {i: [math.floor(4096 * x) for x in v] for i, (_, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    width = len(next(iter(kept.values()))) // parts
    seeds, seen = [], set()
    for i in sorted(kept, key=lambda i: (rows[i][0], rows[i][1])):
        if rows[i][0] not in seen and len(seeds) < entries:
            seen.add(rows[i][0])
            seeds.append(i)
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(kept[i], p) for i in seeds] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), c) for c, e in enumerate(books[p]))

    for _ in range(rounds):
        own = {i: [nearest(v, p)[1] for p in range(parts)] for i, v in kept.items()}
        for p in range(parts):
            for c in range(len(seeds)):
                of = [cut(kept[i], p) for i in kept if own[i][p] == c]
                if of:
                    books[p][c] = [sum(x) // len(of) for x in zip(*of)]
    out = {}
    for i, v in kept.items():
        best = [nearest(v, p) for p in range(parts)]
        out[i] = ("".join(f"{c:02x}" for _, c in best), sum(d for d, _ in best))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want, sha = plain(rows)
    by_label = {}
    for i, (_, e) in want.items():
        by_label[rows[i][2]] = by_label.get(rows[i][2], 0) + e
    got = V.encode(df).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == sorted((rows[i][0], c, e, by_label[rows[i][2]]) for i, (c, e) in want.items())
    assert {r["codebooks_sha256"] for r in got} == {sha}


def test_equal_to_every_distance(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.3, (20, 16))
    check(spark, [(i, (centres[rng.integers(20)] + rng.normal(0, 0.05, 16)).tolist(), int(rng.integers(3)) if i % 9 else None) for i in range(600)])


def test_ties_copies_and_dropped_rows(spark):
    """Whole numbers of a grid tie often; a third of the rows are one vector under one label."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-2, 3, 16) / 4096).tolist(), 1) for i in range(200)] + [(500 + i, [0.0] * 16, 7) for i in range(100)]
    bad = [(900, None, 1), (901, [1.0] * 15 + [None], 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 2), (904, [float("-inf")] * 16, None)]
    check(spark, rows + bad + rows[:3])


def test_few_vectors_and_large_values(spark):
    check(spark, [(3, [1.5] * 8, None), (1, [-2.5] * 8, None), (1, [-2.5] * 8, 2)])
    df = spark.createDataFrame([(1, [1e30] * 8, 1), (2, [0.0] * 8, 1)], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: r["error"] for r in V.encode(df).collect()} == {1: 0, 2: 0}


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert V.encode(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(None, [0.5] * 8, "a"), (None, [0.25] * 8, None)], schema)
    assert sorted(r["code"] for r in V.encode(one).collect()) == ["00" * 8] * 2
    wide = spark.createDataFrame([(1, [0.5] * 8, "a")], schema).select("*", F.lit(1).alias("Label"), F.lit(2).alias("VEC_ID"))
    assert V.encode(wide).count() == 1
    assert [r["code"] for r in V.encode(spark.createDataFrame([(1, [], "a")], schema)).collect()] == ["00" * 8]
    with pytest.raises(ValueError, match="multiple of 8"):
        V.encode(spark.createDataFrame([(1, [0.5] * 9, "a")], schema))


def test_bounds_hold_and_prune():
    """No persisted bound is ever on the wrong side of its distance, and most distances are not computed."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 0.4, (16, 8, 8))
    x = V.integers(centres[rng.integers(16, size=3000)] + rng.normal(0, 0.03, (3000, 8, 8)))
    books = x[:16].transpose(1, 0, 2).copy()
    b = V.Block(x, 16)
    for _ in range(6):
        b.assign(books)
        true = np.sqrt(((x[:, :, None] - books[None]) ** 2).sum(3))
        assert (b.lower.astype(float) <= true + 1e-9).all()
        assert (np.take_along_axis(true, b.entry[:, :, None].astype(int), 2)[:, :, 0] <= b.upper.astype(float) + 1e-9).all()
        assert (b.entry == true.argmin(2)).all()
        new = V.next_books(books, b.sums(16))
        b.shift(V.movement(books, new))
        books = new
    assert b.distances < 0.5 * 6 * x.shape[0] * 8 * 16
