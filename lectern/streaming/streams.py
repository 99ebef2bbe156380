"""Structured Streaming forms of the append logs, pointers and incremental indexing.

The library's batch operators have no event time; these take any streaming DataFrame and run with
``trigger(availableNow=True)`` over files as well as continuously.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators import changes


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """An append-only log; each batch is committed once."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_index(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, derive: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Keep what derive makes of the newest row of each key. A batch writes its own rows alone, into a folder of its
    number, so a batch that runs again after a failure writes the same folder anew; ``indexed_rows`` reads the table."""

    def batch(df: DataFrame, number: int) -> None:
        fresh = derive(changes.first_of(df, key, [F.desc(order)]))
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed_rows(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The table that incremental_index keeps: of each key all rows of the last batch that has it."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"]).select(*[c for c in rows.columns if c != "batch"])


def compacted(spark: SparkSession, path: str, key: str, to: str) -> None:
    """Write the table anew as one batch under another path, from which further batches can go on."""
    last = spark.read.option("basePath", path).parquet(f"{path}/batch=*").agg(F.max("batch")).first()[0]
    indexed_rows(spark, path, key).write.mode("overwrite").parquet(f"{to}/batch={last}")


def latest_values(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value, last): the last value of each key so far."""
    return stream.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias("last"))


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, by, n) of event-time windows; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"))


def debounced(stream: DataFrame, key: str, time: str, wait: str = "200 milliseconds") -> DataFrame:
    """The last row of each burst of a key, with how many rows it had: session windows that close after a silence."""
    others = [c for c in stream.columns if c not in (key, time)]
    last = F.max_by(F.struct(F.col(time).alias("last"), *others), time).alias("_row")
    g = stream.withWatermark(time, wait).groupBy(key, F.session_window(time, wait)).agg(last, F.count("*").alias("n"))
    return g.select(key, "session_window", F.col("_row.last").alias("last"), *[F.col(f"_row.{c}").alias(c) for c in others], "n")


def consolidation_pointer(stream: DataFrame, session: str, seq: str, tokens: str, target: int) -> DataFrame:
    """(session, pointer, consolidated): how far each session's log can be folded away, as state that outlives
    batches: the pointer moves whenever ``target`` tokens have gathered behind it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, pointer = state.get if state.exists else (0, -1)
        done = 0
        for d in batches:
            for n, size in sorted(zip(d[seq].tolist(), d[tokens].tolist())):
                held += size
                if held >= target:
                    done, held, pointer = done + held, 0, n
        state.update((int(held), int(pointer)))
        yield pd.DataFrame({session: [key[0]], "pointer": [int(pointer)], "consolidated": [int(done)]})

    kind = dict(stream.dtypes)[session]
    return stream.groupBy(session).applyInPandasWithState(step, f"{session} {kind}, pointer long, consolidated long", "held long, pointer long", "update", GroupStateTimeout.NoTimeout)


def fresh_values(stream: DataFrame, key: str, time: str, lifetime: str = "20 minutes") -> DataFrame:
    """The first row of each key within a lifetime: state of a key goes when the watermark has passed it, so a cache of
    this kind never holds more than what is still fresh."""
    return stream.withWatermark(time, lifetime).dropDuplicatesWithinWatermark([key])
