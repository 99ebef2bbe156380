"""Folds over ordered rows of a document: thinning, size batches, line grouping, pages split at headings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _per_group(rows: DataFrame, by: str, order: str, values: list[str], fold, schema: T.StructType) -> DataFrame:
    """fold(list of value tuples in order) -> output tuples, for each group; a group is one row of arrays."""
    per = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, *values))).alias("r")).select(by, *[F.col("r")[v].alias(v) for v in (order, *values)])
    out = T.StructType([per.schema[by], *schema.fields])
    names = [order, *values]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame([(key, *x) for key, *cols in zip(d[by], *[d[n] for n in names]) for x in fold(list(zip(*cols)))], columns=out.names)

    return per.mapInPandas(run, out)


def thin(levels: list[int], tokens: list[int], least: int) -> list[int]:
    """The row each node is merged into: itself, or the nearest kept ancestor of a subtree under ``least`` tokens."""
    n = len(levels)
    total, end = list(tokens), [n] * n
    for i in range(n - 1, -1, -1):
        j = i + 1
        while j < n and levels[j] > levels[i]:
            total[i] += tokens[j]
            j += 1
        end[i] = j
    into = list(range(n))
    for i in range(n):
        if into[i] == i and total[i] < least:
            for j in range(i + 1, end[i]):
                into[j] = i
    return into


def thinned(heads: DataFrame, by: str, order: str, level: str, tokens: str, least: int) -> DataFrame:
    """(by, order, into): nodes under a small subtree are merged into its root."""
    schema = T.StructType([T.StructField(order, T.LongType()), T.StructField("into", T.LongType())])

    def fold(rows):
        at = thin([int(r[1]) for r in rows], [int(r[2]) for r in rows], least)
        return [(int(r[0]), int(rows[k][0])) for r, k in zip(rows, at)]

    return _per_group(heads, by, order, [level, tokens], fold, schema)


def size_batches(rows: DataFrame, by: str, order: str, size: str, most: int = 12_000) -> DataFrame:
    """(by, order, batch): rows in order are gathered until a batch would pass ``most``."""
    schema = T.StructType([T.StructField(order, T.LongType()), T.StructField("batch", T.LongType())])

    def fold(items):
        out, batch, used = [], 0, 0
        for o, n in items:
            if used and used + n > most:
                batch, used = batch + 1, 0
            used += n
            out.append((int(o), batch))
        return out

    return _per_group(rows, by, order, [size], fold, schema)


def grouped_lines(items: DataFrame, by: str, order: str, y: str, tolerance: float = 3.0) -> DataFrame:
    """(by, order, line_no): items stand on one line while they are within the tolerance of its first."""
    schema = T.StructType([T.StructField(order, T.LongType()), T.StructField("line_no", T.LongType())])

    def fold(rows):
        out, line, anchor = [], -1, None
        for o, v in rows:
            if anchor is None or abs(v - anchor) > tolerance:
                line, anchor = line + 1, v
            out.append((int(o), line))
        return out

    return _per_group(items, by, order, [y], fold, schema)


def split_at_headings(pages: DataFrame, key: str, most_tokens: int = 4_500) -> DataFrame:
    """(key, part, text): pages over the limit are cut before headings; others stay whole."""
    from lectern.functions.text import token_estimate

    parts = F.when(token_estimate(F.col("text")) > most_tokens, F.split("text", r"(?m)(?=^#{1,6}\s)")).otherwise(F.array("text"))
    d = pages.select(key, F.posexplode(F.filter(parts, lambda x: F.trim(x) != "")).alias("part", "text"))
    return d.withColumn("part", F.col("part").cast("long"))


def inside_part(rows: DataFrame, by: str, order: str, kind: str) -> DataFrame:
    """With ``inside``: whether a part heading stands before, without a special one since."""
    w = Window.partitionBy(by).orderBy(order)
    flag = F.when(F.col(kind) == "part", 1).when(F.col(kind) == "special", 0)
    return rows.withColumn("inside", F.coalesce(F.last(flag, ignorenulls=True).over(w), F.lit(0)) == 1)


# Special titles that stand outside all parts, and those that belong to the chapter before.
OUTSIDE = "^(前言|序[言章]?|引言|导言|结束语|后记|参考文献|参考书目|致谢)$"
BELONGING = "^(结语|扩展阅读|附录)$"


def chapter_levels(chapters: DataFrame, by: str, order: str, title: str, tokens: str, least: int = 50) -> DataFrame:
    """With ``level``: parts 0; chapters, other specials and other titles 1 inside a part, else 0; sections 2; specials
    outside all parts 0 and end the part; those that belong to a chapter 2; other titles of few tokens 0."""
    from lectern.functions.marks import title_kind

    w = Window.partitionBy(by).orderBy(order)
    d = chapters.withColumn("_kind", title_kind(F.col(title))).withColumn("_top", (F.col("_kind") == "special") & F.col(title).rlike(OUTSIDE))
    d = d.withColumn("_in", F.coalesce(F.last(F.when(F.col("_kind") == "part", 1).when(F.col("_top"), 0), ignorenulls=True).over(w), F.lit(0)))
    level = (
        F.when((F.col("_kind") == "part") | F.col("_top"), 0)
        .when((F.col("_kind") == "section") | ((F.col("_kind") == "special") & F.col(title).rlike(BELONGING)), 2)
        .when((F.col("_kind") == "plain") & (F.col(tokens) < least), 0)
        .otherwise(F.col("_in"))
    )
    return d.withColumn("level", level.cast("long")).drop("_kind", "_top", "_in")
