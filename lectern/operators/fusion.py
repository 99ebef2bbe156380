"""Fusion of signals: reciprocal ranks, weighted sums, boosts, re-ranking, scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import similarity as S


def ranked(signal: DataFrame, query: str, key: str) -> DataFrame:
    """With ``rank`` from 1: score downwards, ties by key, no shared ranks."""
    return signal.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key)).cast("long"))


def reciprocal_rank_fusion(signals: dict[str, DataFrame], query: str, key: str, candidates: tuple[str, ...] | None = None, k: int = 60) -> DataFrame:
    """(query, key, score, signals). Ranks are made within each signal; with ``candidates`` only keys of these
    signals can be results, and the others add to them alone."""
    parts = [ranked(df.select(query, key, "score"), query, key).select(query, key, F.lit(name).alias("signal"), S.reciprocal_rank(F.col("rank"), k).alias("part")) for name, df in signals.items()]
    fused = reduce(DataFrame.unionByName, parts).groupBy(query, key).agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("signals"), F.max(F.col("signal").isin(*(candidates or signals))).alias("_ok"))
    return fused.where("_ok").drop("_ok")


def weighted_fusion(a: DataFrame, b: DataFrame, query: str, key: str, wa: float = 0.7, wb: float = 0.3, weight: Column | None = None, digits: int = 6) -> DataFrame:
    """(query, key, score) = (wa a + wb b) * weight over the full outer join; what is missing counts 0."""
    x, y = a.select(query, key, F.col("score").alias("_a")), b.select(query, key, F.col("score").alias("_b"))
    both = x.join(y, [query, key], "full_outer").fillna(0.0, ["_a", "_b"])
    score = F.col("_a") * wa + F.col("_b") * wb
    return both.select(query, key, F.round(score * weight if weight is not None else score, digits).alias("score"))


def in_scope_or_all(hits: DataFrame, scope: DataFrame, query: str, key: str) -> DataFrame:
    """Hits in the query's scope; where no hit is in scope, all of them."""
    marked = hits.join(scope.select(query, key).distinct().withColumn("_in", F.lit(1)), [query, key], "left")
    return marked.withColumn("_any", F.max("_in").over(Window.partitionBy(query))).where("_in = 1 or _any is null").drop("_in", "_any")


def multi_keyword_fusion(hits: DataFrame, query: str, keyword: str, key: str, current: Column | None = None, per_hit: float = 0.1, boost: float = 0.2) -> DataFrame:
    """(query, key, best, hits, score): the best score of a node over keywords, a bonus a hit, one for the current node."""
    g = hits.groupBy(query, key).agg(F.max("score").alias("best"), F.count_distinct(keyword).alias("hits"))
    score = F.col("best") + per_hit * F.col("hits")
    if current is not None:
        score = score + F.when(current, boost).otherwise(0.0)
    return g.withColumn("score", F.round(score, 6))


def blended(hits: DataFrame, rerank: DataFrame, query: str, key: str, weight: float = 0.5, default: float = 0.5, drop_missing: bool = False, digits: int = 6) -> DataFrame:
    """score = weight * rerank + (1 - weight) * score where a rerank score is given (null: the default score);
    other rows keep theirs, or go with drop_missing."""
    r = rerank.select(query, key, F.coalesce("rerank", F.lit(default)).alias("_r"))
    j = hits.join(r, [query, key], "inner" if drop_missing else "left")
    mixed = weight * F.col("_r") + (1 - weight) * F.col("score")
    return j.withColumn("score", F.round(F.when(F.col("_r").isNotNull(), mixed).otherwise(F.col("score")), digits)).drop("_r")


def merged_tree_hits(hits: DataFrame, listed: DataFrame, query: str, key: str, weight: float = 0.5) -> DataFrame:
    """Blend in a list of nodes at positions 0, 1, ...: e^(-0.2 position). Where a query has such a list every hit keeps
    ``1 - weight`` of its score, listed nodes get ``weight`` of theirs, and those not among the hits are added."""
    t = listed.select(query, key, F.exp(-0.2 * F.col("position")).alias("_t"))
    j = hits.select(query, key, "score").join(t, [query, key], "full_outer")
    some = F.max("_t").over(Window.partitionBy(query)).isNotNull()
    score = F.when(some, (1 - weight) * F.coalesce("score", F.lit(0.0)) + weight * F.coalesce("_t", F.lit(0.0))).otherwise(F.col("score"))
    return j.select(query, key, F.round(score, 6).alias("score"))


def block_to_node(hits: DataFrame, query: str, node: str, block: str, blocks: int = 3) -> DataFrame:
    """(query, node, score, sources, blocks): a node's best block score and its first best blocks."""
    place = F.row_number().over(Window.partitionBy(query, node).orderBy(F.desc("score"), block))
    r = hits.withColumn("_p", place)
    return r.groupBy(query, node).agg(
        F.max("score").alias("score"), F.count("*").alias("sources"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_p") <= blocks, F.struct("_p", F.col(block).cast("string").alias("b"))))), lambda x: x["b"]), ",").alias("blocks")
    )


def early_stop(hits: DataFrame, query: str, key: str, threshold: float = 0.6) -> DataFrame:
    """(query, gate, stop): the three best scores weighed 0.6, 0.3, 0.1 against a threshold."""
    r = ranked(hits, query, key).where("rank <= 3")
    w = F.element_at(F.array(F.lit(0.6), F.lit(0.3), F.lit(0.1)), F.col("rank").cast("int"))
    return r.groupBy(query).agg(F.round(F.sum(F.col("score") * w), 6).alias("gate")).withColumn("stop", F.col("gate") >= threshold)


def books_then_hits(hits: DataFrame, query: str, book: str, key: str, books: int = 5, per_book: int = 5) -> DataFrame:
    """The best books by the sum of their best hits, and these hits."""
    own = hits.withColumn("place", F.row_number().over(Window.partitionBy(query, book).orderBy(F.desc("score"), key)).cast("long")).where(F.col("place") <= per_book)
    total = own.withColumn("total", F.round(F.sum("score").over(Window.partitionBy(query, book)), 6))
    return total.withColumn("book_rank", F.dense_rank().over(Window.partitionBy(query).orderBy(F.desc("total"), book)).cast("long")).where(F.col("book_rank") <= books)


def search_phase(results: Column, top: Column, most: Column, coverage: Column, block: Column, size: Column, forced: Column) -> Column:
    """What follows a first, lexical search: ``none`` (fewer than two results), ``stop`` (its best is sure: 0.7 of the
    most a query can score, 0.8 of the words, a substantial block, and no deeper reading is forced), ``hybrid`` (0.25 and
    more: search again with vectors and re-ranking) or ``keep``."""
    substance = F.when(F.coalesce(block, F.lit("")) != "", 20).otherwise(0) + F.least(F.coalesce(size, F.lit(0)) / 10, F.lit(30.0)) + F.when(F.coalesce(size, F.lit(0)) > 20, 15).otherwise(0)
    sure = (top / most >= 0.7) & (coverage >= 0.8) & (substance >= 40) & ~forced
    return F.when(results < 2, "none").when(sure, "stop").when(top / most >= 0.25, "hybrid").otherwise("keep")
