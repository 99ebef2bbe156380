"""Answers scored in six dimensions, and a data set of them summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The most points of each dimension.
MOST = {"ACC": 30, "REL": 20, "COM": 15, "REF": 15, "SAF": 10, "STY": 10}
STRUCTURE = r"#{1,3}\s|\n[-*]\s|\n\d+\.\s"
GUIDANCE = "建议|你可以|进一步|尝试|推荐"


def _held(text: Column, words: Column) -> Column:
    """How many of the words a text holds."""
    return F.size(F.filter(words, lambda w: F.contains(text, w)))


def _steps(share: Column, full: int, half: int, some: int) -> Column:
    return F.when(share >= 0.8, full).when(share >= 0.5, half).when(share > 0, some).otherwise(0)


def answer_scores(answers: DataFrame, sentinels: list[str], overrides: dict[str, Column] | None = None) -> DataFrame:
    """With ACC, REL, COM, REF, SAF, STY, total and grade of answers(response, depth, expected, forbidden): words
    found in all of the text and in its first 800 characters, length and structure, block links from depth 2 on, words
    that must not leak (sentinels), and structure with guidance. An override that is not null replaces its score."""
    text, depth = F.coalesce("response", F.lit("")), F.coalesce("depth", F.lit(0))
    none = F.array().cast("array<string>")
    expected, forbidden = F.coalesce("expected", none), F.coalesce("forbidden", none)
    share = lambda t: F.when(F.size(expected) == 0, 1.0).otherwise(_held(t, expected) / F.size(expected))
    structured, guided = text.rlike(STRUCTURE), text.rlike(GUIDANCE)
    least = F.when(depth >= 2, 500).when(depth >= 1, 200).otherwise(30)
    leaks = _held(text, F.array(*[F.lit(w) for w in sentinels]).cast("array<string>"))
    scores = {
        "ACC": F.when(_held(text, forbidden) > 0, 0).otherwise(_steps(share(text), 30, 20, 10)),
        "REL": _steps(share(F.left(text, F.lit(800))), 20, 15, 10),
        "COM": F.when((F.length(text) >= least) & structured, 15).when(F.length(text) >= least * 0.6, 10).when(F.length(text) >= 30, 5).otherwise(0),
        "REF": F.when(depth <= 1, 15).when(text.rlike(r"\[\[[^\]]+#\^[\w-]+[^\]]*\]\]"), 15).when(text.rlike(r"\[\[[^\]]+\]\]"), 10).otherwise(0),
        "SAF": F.when(leaks == 0, 10).when(leaks <= 1, 5).otherwise(0),
        "STY": F.when(structured & guided, 10).when(structured | guided, 7).otherwise(5),
    }
    for name, score in (overrides or {}).items():
        scores[name] = F.coalesce(score, scores[name])
    d = answers.select(*answers.columns, *[c.cast("double").alias(n) for n, c in scores.items()])
    d = d.withColumn("total", sum((F.col(n) for n in list(MOST)[1:]), F.col("ACC")))
    return d.withColumn("grade", F.when(F.col("total") >= 80, "良好").when(F.col("total") >= 60, "及格").when(F.col("total") >= 40, "不及格").otherwise("严重"))


def _rounded_mean(value: Column, digits: int = 0) -> Column:
    return F.coalesce(F.round(F.avg(value), digits), F.lit(0.0))


def dataset_summary(scored: DataFrame, error: str = "error", passing: float = 60) -> DataFrame:
    """One row: cases, passed, errors, failed, mean total, share passed in per cent, and each dimension's mean. Cases
    with an error have no score, but count in the share."""
    ok = F.col(error).isNull()
    value = lambda c: F.when(ok, F.col(c))
    d = scored.agg(
        F.count("*").alias("cases"), F.count_if(ok & (F.col("total") >= passing)).alias("passed"), F.count_if(~ok).alias("errors"), _rounded_mean(value("total")).cast("long").alias("mean"), *[_rounded_mean(value(n), 1).alias(n) for n in MOST]
    )
    share = F.when(F.col("cases") > 0, F.round(100 * F.col("passed") / F.col("cases"))).otherwise(0.0).cast("long")
    return d.withColumn("failed", F.col("cases") - F.col("passed") - F.col("errors")).withColumn("pass_rate", share)


def category_summary(scored: DataFrame, category: str = "category", error: str = "error", passing: float = 60) -> DataFrame:
    """(category, cases, passed, mean) as in dataset_summary."""
    ok = F.col(error).isNull()
    return scored.groupBy(category).agg(F.count("*").alias("cases"), F.count_if(ok & (F.col("total") >= passing)).alias("passed"), _rounded_mean(F.when(ok, F.col("total"))).cast("long").alias("mean"))
