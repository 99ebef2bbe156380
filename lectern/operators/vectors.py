"""Exact vector search: cosine of every stored vector with each of a bounded block of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .lexical import kept_best, query_blocks, top

#: A block of queries is as many as eight bytes a component have room in this; scores that a task works out at a time.
BLOCK_BYTES, AT_ONCE = 8 << 20, 1 << 20


def of_dimension(queries: DataFrame, dimension: int) -> DataFrame:
    """The queries whose vectors the index can answer; for the others the vector signal is off."""
    return queries.where(F.size("vector") == dimension)


def _sides(some: DataFrame, query: str) -> list[tuple[list, np.ndarray, np.ndarray]]:
    """A block of queries by dimension: (keys, their vectors as a matrix, whether components are null)."""
    by: dict[int, list] = {}
    for r in some.collect():  # as many as have room in BLOCK_BYTES
        by.setdefault(len(r["vector"]), []).append(r)
    null = lambda rows: np.array([any(x is None for x in r["vector"]) for r in rows])
    return [([r[query] for r in rows], np.array([[np.nan if x is None else x for x in r["vector"]] for r in rows], np.float64), null(rows)) for rows in by.values()]


def _compared(sides: list, found):
    """(.., vector) -> what ``found(state)(batch without vectors, number of the first query, scores)`` makes of the cosines of a
    run of vectors with a run of queries; nan stands for those that have none, as components are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = found()
        for b in batches:
            at = b.num_columns - 1
            rest = b.select(range(at))
            size = pc.fill_null(pc.list_value_length(b.column(at)), -1).to_numpy(zero_copy_only=False)
            first = 0
            for keys, q, empty in sides:
                own = np.flatnonzero(size == q.shape[1])
                length = np.sqrt((q * q).sum(axis=1))
                step = max(1, AT_ONCE // len(keys))
                for lo in range(0, len(own), step):
                    some = pa.array(own[lo : lo + step])
                    flat = pc.list_flatten(b.column(at).take(some))
                    v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), -1)
                    null = pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(len(some), -1).any(axis=1)
                    with np.errstate(all="ignore"):
                        n = np.sqrt((v * v).sum(axis=1))[:, None] * length
                        score = np.where(n == 0, 0.0, v @ q.T / n)
                    yield from tell(rest.take(some), first, score, null[:, None] | empty)
                first += len(keys)

    return run


def _keyed(found: DataFrame, sides: list, queries: DataFrame, query: str) -> DataFrame:
    """found(_at, ..) with the queries' keys for their numbers."""
    schema = T.StructType([T.StructField("_at", T.IntegerType()), queries.schema[query]])
    keys = found.sparkSession.createDataFrame([(i, k) for i, k in enumerate(k for keys, *_ in sides for k in keys)], schema)
    return found.join(F.broadcast(keys), "_at").drop("_at")


def compared(vectors: DataFrame, queries: DataFrame, columns: list[str], query: str, found, more: list[T.StructField], block: int | None = None, each: int = 1) -> DataFrame:
    """(query, columns.., more..) of vectors(columns.., vector): what ``found`` tells of each run of vectors, as batches.
    Vectors stay in place; queries, for each of which a task keeps ``each`` scores, are a stated set sent to them in blocks."""
    schema = T.StructType([T.StructField("_at", T.IntegerType()), *[vectors.schema[c] for c in columns], *more])
    v = vectors.where("vector is not null").select(*columns, "vector")
    cores = v.sparkSession.sparkContext.defaultParallelism
    v = v.repartition(cores) if v.rdd.getNumPartitions() < cores else v
    q = queries.where("vector is not null").select(query, "vector")
    size = max(q.agg(F.max(F.size("vector"))).first()[0] or 1, each)
    parts = [_sides(some, query) for some in query_blocks(q, query, block or max(1, BLOCK_BYTES // 8 // size))]
    return reduce(DataFrame.unionByName, [_keyed(v.mapInArrow(_compared(sides, found), schema), sides, queries, query) for sides in parts])


def _batch(rest: pa.RecordBatch, row: np.ndarray, at: np.ndarray, names: list[str], *more: pa.Array) -> pa.RecordBatch:
    taken = [c.take(pa.array(row)) for c in rest.columns]
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *taken, *more], names=["_at", *rest.schema.names, *names])


def _over(bound: float | None, k: int | None):
    """Scores over a bound (None: all); with k, those that are among a task's k best of their query so far, or equal to them."""

    def found():
        highest: dict[int, np.ndarray] = {}

        def tell(rest: pa.RecordBatch, first: int, score: np.ndarray, null: np.ndarray):
            some = np.ones(score.shape, bool) if bound is None else ~null & ~(score <= bound - 1e-6)
            if k is not None:
                order = np.where(null, -np.inf, np.where(np.isnan(score), np.inf, score))
                held = highest[first] = kept_best(highest.get(first, order[:0]), order, k)
                if len(held) == k:
                    some &= order >= held.min(axis=0) - 2e-6  # scores are rounded later
            row, at = np.nonzero(some)
            if len(row):
                yield _batch(rest, row, at + first, ["score"], pa.array(score[row, at], mask=null[row, at], from_pandas=False))

        return tell

    return found


def cosine_scores(vectors: DataFrame, queries: DataFrame, key: str, query: str, where: Column | None = None, block: int | None = None, above: float | None = None, best: int | None = None) -> DataFrame:
    """(query, key, score). vectors(key, vector) stay in place; queries(query, vector) are a stated set that is sent
    to them in blocks. A query of another dimension than a vector has no score there. With ``above`` scores over it alone; with
    ``best`` so many of a query's best with all of their equals, and others."""
    v = (vectors if where is None else vectors.where(where)).select(key, "vector")
    scores = compared(v, queries, [key], query, _over(above, best), [T.StructField("score", T.DoubleType())], block, best or 1).select(query, key, F.round("score", 6).alias("score"))
    return scores if above is None else scores.where(F.col("score") > above)


def cosine_search(vectors: DataFrame, queries: DataFrame, key: str, query: str, k: int = 10, where: Column | None = None) -> DataFrame:
    return top(cosine_scores(vectors, queries, key, query, where, best=k), query, key, k)


def _by_group():
    def tell(rest: pa.RecordBatch, first: int, score: np.ndarray, null: np.ndarray):
        groups = rest.column(0).dictionary_encode("encode")
        code = groups.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        begin = np.flatnonzero(np.diff(code[order], prepend=-1))
        last = np.maximum.reduceat(np.where(null, -np.inf, np.where(np.isnan(score), np.inf, score))[order], begin, axis=0)
        nan = np.logical_or.reduceat((np.isnan(score) & ~null)[order], begin, axis=0)
        many = np.diff(np.append(begin, len(order)))
        row, at = np.divmod(np.arange(last.size), last.shape[1])
        best = np.where(nan, np.nan, last)[row, at]
        yield _batch(rest, order[begin][row], at + first, ["score", "chunks"], pa.array(best, mask=best == -np.inf, from_pandas=False), pa.array(many[row]))

    return tell


def pooled_scores(vectors: DataFrame, queries: DataFrame, node: str, query: str) -> DataFrame:
    """(query, node, score, chunks) of vectors(node, vector): ``pooled`` of all of ``cosine_scores``, which are never rows
    of their own."""
    parts = compared(vectors.select(node, "vector"), queries, [node], query, _by_group, [T.StructField("score", T.DoubleType()), T.StructField("chunks", T.LongType())])
    return parts.groupBy(query, node).agg(F.round(F.max("score"), 6).alias("score"), F.sum("chunks").alias("chunks"))


def pooled(hits: DataFrame, query: str, node: str) -> DataFrame:
    """(query, node, score, chunks): each node's best chunk and how many chunks it has."""
    return hits.groupBy(query, node).agg(F.max("score").alias("score"), F.count("*").alias("chunks"))


def with_level_fallback(hits: DataFrame, query: str, level: str = "level", first: str = "L2", second: str = "L1") -> DataFrame:
    """Hits of the first level; for queries that have none, those of the second."""
    some = F.max((F.col(level) == first).cast("int")).over(Window.partitionBy(query))
    return hits.withColumn("_some", some).where((F.col(level) == first) | ((F.col("_some") == 0) & (F.col(level) == second))).drop("_some")


def level_fallback(vectors: DataFrame, queries: DataFrame, key: str, query: str, above: float, first: str = "L2", second: str = "L1") -> DataFrame:
    """(query, key, score, level) of vectors(key, vector, level): hits over a bound of the first level; only queries that have
    none there are put to the second."""
    hits = lambda level, q: cosine_scores(vectors, q, key, query, F.col("level") == level, above=above).withColumn("level", F.lit(level))
    found = hits(first, queries)
    left = queries.join(found.select(query).distinct(), query, "left_anti")
    return found.unionByName(hits(second, left)).select(query, key, "score", "level")
