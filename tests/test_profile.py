"""Rounds of changes against one full build; what did not change is not read again."""

import random

from pyspark.sql import functions as F

from lectern.plans import profile as P


def derive(seen):
    def f(files):
        seen.append(sorted(r["file"] for r in files.select("file").collect()))
        return files.select("file", F.posexplode(F.split("text", " ")).alias("seq", "w")).select("file", F.left("w", F.lit(1)).alias("dimension"), F.col("w").alias("fact"), "seq")

    return f


def test_rounds_equal_one_build(spark, tmp_path):
    rng, state, at = random.Random(2), {}, P.empty_profile(spark)
    seen: list = []
    for mtime in range(1, 5):
        changed = rng.sample(range(20), 20 if mtime == 1 else 6)
        for f in changed:
            state[f] = (f, mtime, " ".join(rng.choice("ab") + str(rng.randint(0, 5)) for _ in range(rng.randint(1, 6))))
        files = spark.createDataFrame(list(state.values()), "file long, mtime long, text string")
        at = P.stored(P.refreshed(at, files, derive(seen)), str(tmp_path))
        assert seen[-1] == sorted(changed)
        full = P.refreshed(P.empty_profile(spark), files, derive([]))
        assert sorted(map(tuple, at.view.collect())) == sorted(map(tuple, full.view.collect()))
        assert sorted(map(tuple, P.in_order(at).collect())) == sorted(map(tuple, P.in_order(full).collect()))
    assert sorted(map(tuple, at.recorded.collect())) == sorted((f, m) for f, m, _ in state.values())
    sized = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([5, 6, 20, 1])], "file long, text string")
    assert sorted((r["first"], r["end"]) for r in P.hook_batches(sized, most=11).collect()) == [(0, 2), (2, 3), (3, 4)]
