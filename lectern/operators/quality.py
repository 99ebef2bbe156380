"""Retrieval quality, answer scores and trace statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, query: str, key: str, counts: DataFrame | None = None) -> DataFrame:
    """(query, mrr, hit5, hit10, ndcg5) of ranked hits(query, key, rank) against relevant(query, key). With
    counts(query, n) relevant need not hold more than the hits that are."""
    rel = relevant.select(query, key).distinct().withColumn("_r", F.lit(1))
    n = rel.groupBy(query).agg(F.count("*").alias("_n")) if counts is None else counts.select(query, F.col("n").alias("_n"))
    j = hits.join(rel, [query, key], "left").withColumn("_r", F.coalesce("_r", F.lit(0)))
    found = F.when(F.col("_r") == 1, F.col("rank"))
    m = j.groupBy(query).agg(F.min(found).alias("_first"), F.sum(F.when(F.col("rank") <= 5, F.col("_r") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_dcg")).join(n, query, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.coalesce("_n", F.lit(0)), F.lit(5)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    ndcg = F.when(F.coalesce("_n", F.lit(0)) > 0, F.col("_dcg") / ideal).otherwise(0.0)
    return m.select(query, F.round(F.coalesce(1 / F.col("_first"), F.lit(0.0)), 6).alias("mrr"), F.coalesce((F.col("_first") <= 5).cast("int"), F.lit(0)).alias("hit5"), F.coalesce((F.col("_first") <= 10).cast("int"), F.lit(0)).alias("hit10"), F.round(ndcg, 6).alias("ndcg5"))


def stage_statistics(events: DataFrame, stage: str, value: str) -> DataFrame:
    """(stage, n, mean, least, most) of a measure."""
    return events.groupBy(stage).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.min(value), 4).alias("least"), F.round(F.max(value), 4).alias("most"))


def pooled_mean(groups: DataFrame, mean: str, n: str) -> DataFrame:
    """One row: the mean of group means weighed by their counts."""
    return groups.agg(F.round(F.sum(F.col(mean) * F.col(n)) / F.sum(n), 4).alias("pooled"), F.sum(n).cast("long").alias("n"))


def slowest(rows: DataFrame, value: str, key: str, n: int = 3) -> DataFrame:
    return rows.orderBy(F.desc(value), key).limit(n)


def bars(rows: DataFrame, value: str, width: int = 20) -> DataFrame:
    """With ``bar``: value against the greatest, as a number of marks."""
    top = rows.agg(F.max(value).alias("_top"))  # one row
    share = F.when(F.col("_top") > 0, F.round(F.col(value) / F.col("_top") * width)).otherwise(0).cast("int")
    return rows.crossJoin(F.broadcast(top)).withColumn("bar", F.repeat(F.lit("#"), share)).drop("_top")


def heading_quality(nodes: DataFrame, by: list[str], title: str, book_title: str) -> DataFrame:
    """(by, titles, duplicates, truncated, long, placeholders, verdict) of a level's titles; a share of 0.3 breaks a
    level, placeholders before truncations before duplicates."""
    from lectern.functions import text as X

    same = F.count("*").over(Window.partitionBy(*by, title))
    d = nodes.withColumn("_same", same)
    flag = lambda c: F.sum(c.cast("int")).cast("long")
    g = d.groupBy(*by).agg(F.count("*").alias("titles"), flag(F.col("_same") > 1).alias("duplicates"), flag(X.is_truncated(F.col(title))).alias("truncated"), flag(X.too_long_title(F.col(title))).alias("long"), flag(X.bare(F.col(title)) == X.bare(F.col(book_title))).alias("placeholders"))
    bad = lambda c: F.col(c) / F.col("titles") >= 0.3
    return g.withColumn("verdict", F.when(bad("placeholders"), "placeholders").when(bad("truncated") | bad("long"), "truncations").when(bad("duplicates"), "duplicates").otherwise("good"))


def mean_metrics(per_query: DataFrame, metrics: list[str], by: str | None = None) -> DataFrame:
    """(by, queries, metrics...): the mean of each metric over queries, in all or for each book."""
    g = per_query.groupBy(by) if by else per_query.groupBy()
    return g.agg(F.count("*").alias("queries"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])


def answerable(golden: DataFrame, catalog: DataFrame, book: str) -> tuple[DataFrame, DataFrame]:
    """(golden queries of books in the catalog, one row: how many are skipped because theirs is not)."""
    books = catalog.select(book).distinct()
    return golden.join(books, book, "left_semi"), golden.join(books, book, "left_anti").agg(F.count("*").alias("skipped"))
