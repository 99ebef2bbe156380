"""Search over notes: vectors and keywords to a depth by the query's length, a filter of folders, weights of levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import similarity as S
from lectern.operators import lexical as L
from lectern.operators import vectors as V
from lectern.operators.reading import any_prefix

#: The deepest recall of a search over notes.
DEEPEST = 50


def _recalled(hits: DataFrame, query: str, key: str, depth: DataFrame) -> DataFrame:
    return L.top(hits, query, key, DEEPEST).join(depth, query).where(F.col("rank") <= F.col("_k")).drop("rank", "_k")


def note_search(
    nodes: DataFrame, queries: DataFrame, tree: DataFrame, key: str = "node", query: str = "query", vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, folders: dict[str, list[str]] | None = None, k: int = 10,
    vector_weight: float = 0.7, keyword_weight: float = 0.3, rerank: Column | None = None,
) -> DataFrame:
    """(query, key, vector, keyword, level, score, rank) of queries(query, text) over nodes(key, text).

    tree(key, file, depth, descendants) says where a node stands; what it does not know weighs half. vectors(block, key,
    vector) are chunks, of which a query recalls its depth before they are pooled; without them keywords have all the
    weight. ``folders`` lets only files in them through: for all queries under the key ``*``, else by a query's ``scope``
    column. ``rerank`` is a column that replaces the score, as a cross-encoder's hook."""
    depth = queries.select(query, S.vault_recall_k(F.col("text")).alias("_k"))
    words = _recalled(L.keyword_scores(nodes, queries, key, query).drop("hits"), query, key, depth).select(query, key, F.col("score").alias("keyword"))
    if vectors is None or query_vectors is None:
        both, vector_weight, keyword_weight = words.withColumn("vector", F.lit(0.0)), 0.0, 1.0
    else:
        near = _recalled(V.cosine_scores(vectors.withColumnRenamed(key, "_node"), query_vectors, "block", query, best=DEEPEST), query, "block", depth)
        pooled = V.pooled(near.join(vectors.select("block", key), "block"), query, key).select(query, key, F.greatest("score", F.lit(0.0)).alias("vector"))
        both = words.join(pooled, [query, key], "full_outer").fillna(0.0, ["vector", "keyword"])
    placed = both.join(tree.select(key, "file", "depth", "descendants"), key, "left")
    if folders:
        scope = F.coalesce(F.col("_scope"), F.lit("*"))
        placed = placed.join(queries.select(query, F.col("scope").alias("_scope") if "scope" in queries.columns else F.lit("*").alias("_scope")), query)
        allowed = F.lit(True)
        for name, prefixes in folders.items():
            allowed = F.when(scope == name, any_prefix(F.coalesce("file", F.lit("")), prefixes)).otherwise(allowed)
        placed = placed.where(allowed)
    level = S.vault_level_weight(F.col("depth"), F.col("descendants"))
    scored = placed.withColumn("level", level.cast("double")).withColumn("score", F.round((F.col("vector") * vector_weight + F.col("keyword") * keyword_weight) * F.col("level"), 6))
    if rerank is not None:
        scored = scored.withColumn("score", rerank)
    return L.top(scored.select(query, key, "vector", "keyword", "level", "score"), query, key, k)
