"""Similarities and score arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def search_idf(total: Column, df: Column) -> Column:
    return F.ln(1 + (total - df + 0.5) / (df + 0.5))


def clamped_idf(total: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.ln((total - df + 0.5) / (df + 0.5)))


def bm25_weight(idf: Column, tf: Column, length: Column, mean: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    ratio = F.when(mean > 0, length / mean).otherwise(F.lit(1.0))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * ratio))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return 1.0 / (k + rank)


def book_level_weight(depth: Column, has_children: Column) -> Column:
    """1.0 for a root, else 0.9 for a node with children and 0.7 for a leaf; 0.5 where the node is not known."""
    return F.when(depth.isNull(), 0.5).when(depth == 0, 1.0).when(has_children, 0.9).otherwise(0.7)


def vault_level_weight(depth: Column, descendants: Column) -> Column:
    """1.0 for a root with more than two nodes below it, 0.8 for another root, then 0.7, 0.5 and 0.3 by depth; 0.5 where the
    node is not known."""
    return F.when(depth.isNull(), 0.5).when((depth == 0) & (descendants > 2), 1.0).when(depth == 0, 0.8).when(depth == 1, 0.7).when(depth == 2, 0.5).otherwise(0.3)


def bigrams(text: Column) -> Column:
    t = F.regexp_replace(text, r"\s+", "")
    return F.when(F.length(t) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def all_bigrams(text: Column) -> Column:
    """Every pair of neighbouring characters, repeats included, white space apart."""
    t = F.regexp_replace(text, r"\s+", "")
    return F.when(F.length(t) >= 2, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def bigram_overlap(a: Column, b: Column) -> Column:
    """The share of b's bigrams, repeats included, that a has; 0 where either has none."""
    x, y = bigrams(a), all_bigrams(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.filter(y, lambda g: F.array_contains(x, g))) / F.size(y))


def string_similarity(a: Column, b: Column) -> Column:
    """1 if equal, the length ratio if one holds the other whatever the case, else the characters of the first that
    the second has, over the longer's length."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    common = F.size(F.filter(F.split(x, ""), lambda c: (c != "") & F.contains(y, c)))
    return F.when(a == b, 1.0).when(F.contains(x, y) | F.contains(y, x), F.least(F.length(a), F.length(b)) / longest).otherwise(common / longest)


def vault_recall_k(query: Column) -> Column:
    """How many hits a search over notes recalls: 50 for under 5 characters, 30 for under 15, else 10."""
    n = F.length(query)
    return F.when(n < 5, 50).when(n < 15, 30).otherwise(10)


def recall_k(query: Column, most: int, middle: int, least: int, last: int = 15) -> Column:
    """How many hits to recall by the query's length: under 5, up to ``last``, longer."""
    n = F.length(query)
    return F.when(n < 5, most).when(n <= last, middle).otherwise(least)


def djb2(text: Column) -> Column:
    """31-bit string hash over code points."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(0x7FFFFFFF))
