"""State that outlives batches: what a stream in several batches comes to, against the same rows at once."""

import pytest
from pyspark.sql import functions as F

from lectern.streaming import reducers as R

KIND = "user long, seq long, kind string, value double, done boolean"


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def batches(spark, path, f, rows, key):
    """The newest row of each key after the rows were streamed in three batches."""
    out = {}

    def keep(df, n):
        found = {}
        for r in df.collect():
            found.setdefault(r[key], []).append(r.asDict(recursive=True))
        out.update(found)

    for n in range(3):
        spark.createDataFrame(rows[n::3] if f is None else [r for r in rows if r[1] % 30 // 10 == n], KIND).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(KIND).parquet(f"{path}/in")
        f(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    return out


ROWS = [(u, s, ["a", "b", "c"][(u + s) % 3], None if s % 5 == 0 else float(s * u), (u, s) == (2, 17)) for u in range(1, 5) for s in range(30)]


def test_reducers_over_batches(spark, store, tmp_path):
    def f(d):
        return R.reduced(d, "user", "seq", last=("value",), first=("kind",), append="seq", merge=("kind", "value"), stop="done", cap=12)

    got = batches(spark, str(tmp_path), f, ROWS, "user")
    want = {r["user"]: [r.asDict(recursive=True)] for r in f(spark.createDataFrame(ROWS, KIND)).collect()}
    assert got == want
    assert got[2][0]["stopped"] and got[2][0]["items"] == list(range(5, 17)) and got[1][0]["items"] == list(range(18, 30))
    assert got[1][0]["value"] == 29.0 and got[1][0]["kind"] == "b"


def test_recently_used_over_batches(spark, store, tmp_path):
    def f(d):
        return R.recently_used(d.select("user", (F.col("seq") % 7).alias("item"), "seq"), "user", "item", "seq", 4, 2)

    got = batches(spark, str(tmp_path), f, ROWS, "user")
    assert {u: [(r["item"], r["at"], r["place"]) for r in rows] for u, rows in got.items()} == {u: [(1, 29, 1), (0, 28, 2), (6, 27, 3)] for u in range(1, 5)}
