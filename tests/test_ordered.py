"""Places over sorted ranges equal a window's, whatever the keys; the stored index's and vectors' blocks lose nothing."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import vectors as V
from lectern.operators.ordered import placed


def test_placed(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, "a", "a", "a", "b", ""]), r.choice([None, 1.5, 2.0, r.random()])) for i in range(3000)]
    d = spark.createDataFrame(rows, "id long, k string, x double")
    w = Window.partitionBy("k").orderBy(F.desc("x"), "id")
    got = {x["id"]: (x["p"], x["n"]) for x in placed(d, ["k"], [F.desc("x"), "id"], "p", "n").collect()}
    want = d.select("id", (F.row_number().over(w) - 1).alias("p"), F.count("*").over(Window.partitionBy("k")).alias("n")).collect()
    assert got == {x["id"]: (x["p"], x["n"]) for x in want}
    whole = sorted((x["place"], x["id"]) for x in placed(d, [], ["id"]).collect())
    assert whole == [(i, i) for i in range(3000)]
    assert placed(d.limit(0), ["k"], ["id"]).count() == 0


def test_query_blocks(spark):
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(25)], "q long, vector array<float>")
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)] + [(9, [1.0])], "id long, vector array<float>")
    whole = sorted(map(tuple, V.cosine_scores(v, q, "id", "q").collect()))
    assert sorted(map(tuple, V.cosine_scores(v, q, "id", "q", block=4).collect())) == whole and len(whole) == 25 * 7
    assert V.of_dimension(q, 3).count() == 0
