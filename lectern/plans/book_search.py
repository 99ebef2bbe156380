"""Search of a book in eight stages: recall depth, lexical, vector and card signals, scope, fusion by ranks and level,
re-ranking, and the blocks that matched. Model calls are tables or columns given beside the query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import similarity as S
from lectern.operators import fusion as U
from lectern.operators import lexical as L
from lectern.operators import vectors as V

CARD_BOUND = 0.3


#: The deepest recall there is: 50 hits, five times as many in a scope; of chunks three times as many.
DEEPEST = 250


def _best(hits: DataFrame, query: str, key: str, depth: DataFrame, times: int = 1) -> DataFrame:
    """Each query's hits down to ``times`` its own depth(query, _k)."""
    return L.top(hits, query, key, DEEPEST * times).join(depth, query).where(F.col("rank") <= F.col("_k") * times).drop("rank", "_k")


def _chunks(vectors: DataFrame, query_vectors: DataFrame, key: str, query: str, depth: DataFrame) -> DataFrame:
    """(query, block, key, score): three times as many L2 chunks as a query's depth; where it met none, its depth of L1."""
    own = vectors.withColumn("level", F.coalesce("level", F.lit("L2")))

    def best(level: str, queries: DataFrame, times: int) -> DataFrame:
        near = V.cosine_scores(own.withColumnRenamed(key, "_node"), queries, "block", query, F.col("level") == level, best=DEEPEST * times)
        return _best(near, query, "block", depth, times).join(own.where(F.col("level") == level).select("block", key, "level"), "block")

    two = best("L2", query_vectors, 3)
    return two.unionByName(best("L1", query_vectors.join(two.select(query).distinct(), query, "left_anti"), 1))


def recall_depth(queries: DataFrame, scope: DataFrame | None, query: str) -> DataFrame:
    """(query, _k): by the query's length, five times as deep where it has a scope."""
    k = queries.select(query, S.recall_k(F.col("text"), 50, 30, 15).alias("_k"))
    if scope is None:
        return k
    scoped = scope.select(query).distinct().withColumn("_scoped", F.lit(5))
    return k.join(scoped, query, "left").select(query, (F.col("_k") * F.coalesce("_scoped", F.lit(1))).alias("_k"))


def book_search(
    index: L.Index, queries: DataFrame, tree: DataFrame, key: str = "node", query: str = "query", vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
    cards: DataFrame | None = None, scope: DataFrame | None = None, rerank: Column | None = None, candidates: int = 20, weight: float = 0.5, k: int = 5, blocks: int = 3,
) -> DataFrame:
    """(query, key, score, bm25, vector, card, level, rank, blocks) of queries(query, text).

    vectors(block, key, vector, level) are a node's chunks, of level L2 where nothing else is said (those of L1 stand in for a
    query that meets none of L2, and name no blocks), cards(card, key, vector) its propositions, query_vectors(query,
    vector) the queries'; scope(query, key) limits a query unless nothing recalled lies in it; tree(key, depth,
    has_children) gives level weights; rerank is a score of (query, key) as a column. Cards add to what the other
    signals recall, but recall nothing of their own."""
    depth = recall_depth(queries, scope, query)
    signals = {"bm25": _best(L.best_scores(index, queries, key, query, DEEPEST), query, key, depth)}
    chunks = None
    if vectors is not None and query_vectors is not None:
        chunks = _chunks(vectors if "level" in vectors.columns else vectors.withColumn("level", F.lit("L2")), query_vectors, key, query, depth)
        signals["vector"] = V.pooled(chunks, query, key).select(query, key, "score")
        if cards is not None:
            near = _best(V.cosine_scores(cards.withColumnRenamed(key, "_node"), query_vectors, "card", query, best=DEEPEST), query, "card", depth)
            near = near.where(F.col("score") > CARD_BOUND).join(cards.select("card", key), "card")
            signals["card"] = V.pooled(near, query, key).select(query, key, "score")
    parts = []
    for name, hits in signals.items():
        r = U.ranked(hits, query, key)
        parts.append(r.select(query, key, F.lit(name).alias("_signal"), S.reciprocal_rank(F.col("rank")).alias("_part"), F.col("score").alias("_score")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    of = lambda name: F.coalesce(F.max(F.when(F.col("_signal") == name, F.col("_score"))), F.lit(0.0)).alias(name)
    fused = every.groupBy(query, key).agg(F.sum("_part").alias("_rrf"), of("bm25"), of("vector"), of("card"), F.max(F.col("_signal") != "card").alias("_recalled")).where("_recalled").drop("_recalled")
    if scope is not None:
        fused = U.in_scope_or_all(fused, scope, query, key)
    levelled = fused.join(tree.select(key, "depth", "has_children"), key, "left").withColumn("level", S.book_level_weight(F.col("depth"), F.coalesce("has_children", F.lit(False))))
    scored = levelled.select(query, key, F.round(F.col("_rrf") * F.col("level"), 9).alias("score"), "bm25", "vector", "card", "level")
    if rerank is not None:
        scored = U.ranked(scored, query, key).withColumn("score", F.round(F.when(F.col("rank") <= candidates, weight * rerank + (1 - weight) * F.col("score")).otherwise(F.col("score")), 9)).drop("rank")
    best = L.top(scored, query, key, k)
    if chunks is None:
        return best.withColumn("blocks", F.lit(None).cast("string"))
    return best.join(U.block_to_node(chunks.where("level = 'L2'"), query, key, "block", blocks).select(query, key, "blocks"), [query, key], "left")
