"""Library shelves, reading notes, trees and answer checks: rules over keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import similarity as S
from lectern.functions import text as X
from lectern.operators import vectors as V
from lectern.operators.nesting import written


def any_prefix(path: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, p: a | path.startswith(p), prefixes, F.lit(False))


def any_contained(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(F.lower(text), F.lit(w.lower())), words, F.lit(False))


def library_search(books: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Books with the needle in any of the columns, whatever the case."""
    return books.where(reduce(lambda a, c: a | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower())), columns, F.lit(False)))


def first_rule(rows: DataFrame, column: str, rules: list[tuple[str, str]], name: str = "reason") -> DataFrame:
    """With ``reason``: that of the first (pattern, reason) whose pattern occurs; null if none does."""
    return rows.withColumn(name, F.coalesce(*[F.when(F.col(column).rlike(p), F.lit(r)) for p, r in rules]))


def keyword_matches(texts: DataFrame, keywords: DataFrame, key: str, word: str) -> DataFrame:
    """(key, word): keywords found anywhere in a text. Keywords are a stated set, sent to the texts in blocks."""
    blocks = V.query_blocks(keywords.select(word).distinct(), word)
    return reduce(DataFrame.unionByName, [texts.join(F.broadcast(b), F.contains(F.lower("text"), F.lower(word))).select(key, word) for b in blocks])


def outline_quality(entries: DataFrame, book: str, page: str, pages: DataFrame, least: int = 5, span: float = 0.6) -> DataFrame:
    """(book, entries, good): enough entries, and they span enough of the book's pages(book, pages)."""
    g = entries.groupBy(book).agg(F.count("*").alias("entries"), (F.max(page) - F.min(page)).alias("_span")).join(pages, book)
    return g.select(book, "entries", ((F.col("entries") >= least) & (F.col("_span") >= span * F.col("pages"))).alias("good"))


def depth_ladder(model: Column, initial: Column, correction: Column, booklist: Column, missing: Column) -> Column:
    """The depth of an answer: the model's if valid, else the first guess, else 2; a correction raises it to 2, a
    book list from 2 to 3; a failed existence check makes it 0."""
    d = F.when(model.between(0, 3), model).otherwise(F.coalesce(initial, F.lit(2)))
    d = F.when(correction, F.greatest(d, F.lit(2))).otherwise(d)
    d = F.when(booklist & (d == 2), F.lit(3)).otherwise(d)
    return F.when(missing, F.lit(0)).otherwise(d)


def best_similar(wanted: DataFrame, known: DataFrame, wanted_key: str, known_key: str, text: str, least: float = 0.4) -> DataFrame:
    """(wanted_key, known_key, similarity): each wanted text's most similar known text above a bound, the first of
    equals. Rows of one text are compared once, a known text by its least key; wanted texts, a stated set, are sent to the
    known texts in blocks, and a task keeps only the best of each.

    Known texts so long that all of a wanted text's characters are too small a part of them are not compared."""
    a = wanted.where(F.col(text).isNotNull()).select(F.col(text).alias("_a")).distinct()
    b = known.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("_b")).agg(F.min(known_key).alias(known_key))
    b = written(b.repartition(b.sparkSession.sparkContext.defaultParallelism), "known-texts")  # read a block of wanted texts
    found = []
    for block in V.query_blocks(written(a, "wanted-texts"), "_a"):
        most = F.greatest(F.length("_a"), F.octet_length(F.lower("_a")))  # as many characters as there are, in any case
        s = b.crossJoin(F.broadcast(block)).where(most >= least * F.greatest(F.length("_a"), F.length("_b"))).select("_a", known_key, F.round(S.string_similarity(F.col("_a"), F.col("_b")), 6).alias("similarity"))
        found.append(s.where(F.col("similarity") > least))
    best = reduce(DataFrame.unionByName, found).groupBy("_a").agg(F.max_by(F.struct(known_key, "similarity"), F.struct("similarity", -F.col(known_key))).alias("_x"))
    every = wanted.select(wanted_key, F.col(text).alias("_a")).join(best, "_a").groupBy(wanted_key)
    return every.agg(F.max_by("_x", F.struct("_x.similarity", -F.col(f"_x.{known_key}"))).alias("_x")).select(wanted_key, "_x.*")


def neighbours(rows: DataFrame, by: str, order: str, ok: Column, value: str) -> DataFrame:
    """With ``before`` and ``after``: the value of the nearest earlier and later row that is ok."""
    w = Window.partitionBy(by).orderBy(order)
    v = F.when(ok, F.col(value))
    return rows.withColumn("before", F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(v, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def nearest_number(wanted: DataFrame, known: DataFrame, by: str, key: str, number: str) -> DataFrame:
    """(key, nearest): the known number closest to each wanted one within a group, the lower of equals: one sort
    of both sides together instead of all pairs."""
    both = wanted.select(by, key, F.col(number).alias("_n"), F.lit(None).cast("long").alias("_k")).unionByName(known.select(by, F.lit(None).cast("long").alias(key), F.col(number).alias("_n"), F.col(number).cast("long").alias("_k")))
    w = Window.partitionBy(by).orderBy("_n")
    low = F.last("_k", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    high = F.first("_k", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = F.when(F.col("_h").isNull() | (F.col("_n") - F.col("_l") <= F.col("_h") - F.col("_n")), F.col("_l")).otherwise(F.col("_h"))
    return both.withColumn("_l", low).withColumn("_h", high).where(F.col(key).isNotNull()).select(by, key, near.alias("nearest"))


def run_difference(a: DataFrame, b: DataFrame, dimension: str, value: str, note: float = 0.5) -> DataFrame:
    """(dimension, a, b, delta, noted) of two runs' scores."""
    j = a.select(dimension, F.col(value).alias("a")).join(b.select(dimension, F.col(value).alias("b")), dimension, "full_outer")
    delta = F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 4)
    return j.withColumn("delta", delta).withColumn("noted", F.abs("delta") >= note)


def position_clusters(points: DataFrame, by: str, x: str, gap: float) -> DataFrame:
    """(by, cluster, mean, total, n): runs of sorted positions without a gap over ``gap``."""
    w = Window.partitionBy(by).orderBy(x)
    starts = F.coalesce((F.col(x) - F.lag(x).over(w) > gap).cast("int"), F.lit(1))
    runs = points.withColumn("_s", starts).withColumn("cluster", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "cluster").agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.sum(x), 2).alias("total"), F.count("*").alias("n"))


def subtree_sums(nodes: DataFrame, by: str, order: str, until: str, value: str) -> DataFrame:
    """With ``total``: a node's value and those of all nodes below it, from running sums over the pre-order; until
    is the order of the next node outside (null: to the end)."""
    w = Window.partitionBy(by).orderBy(order)
    run = nodes.withColumn("_upto", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)).withColumn("_all", F.sum(value).over(Window.partitionBy(by)))
    ends = run.select(F.col(by).alias("_by"), F.col(order).alias("_o"), F.col("_upto").alias("_end"))
    j = run.join(ends, (run[by] == ends["_by"]) & (run[until] == ends["_o"]), "left")
    return j.withColumn("total", (F.coalesce("_end", "_all") - F.col("_upto")).cast("long")).drop("_by", "_o", "_end", "_all", "_upto")


def answer_score(answers: DataFrame) -> DataFrame:
    """With ``score`` and ``grade`` of answers(chars, least_chars, found, expected, links, least_links, forbidden)."""
    part = lambda ok, full, share: F.when(ok, full).otherwise(F.round(full * share, 2))
    words = F.when(F.col("expected") > 0, F.round(40 * F.col("found") / F.col("expected"), 2)).otherwise(40.0)
    length = part(F.col("chars") >= F.col("least_chars"), 30.0, F.col("chars") / F.greatest("least_chars", F.lit(1)))
    links = part(F.col("links") >= F.col("least_links"), 20.0, F.col("links") / F.greatest("least_links", F.lit(1)))
    d = answers.withColumn("score", F.round(words + length + links + F.when(F.col("forbidden") > 0, 0.0).otherwise(10.0), 2))
    return d.withColumn("grade", F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").otherwise("D"))


def ordered_union(parts: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(key, reason, place): keys of all parts once, with the first part that has them."""
    all_ = reduce(DataFrame.unionByName, [d.select(key, F.lit(i).alias("place"), F.lit(n).alias("reason")) for i, (n, d) in enumerate(parts)])
    return all_.groupBy(key).agg(F.min(F.struct("place", "reason")).alias("x")).select(key, "x.reason", F.col("x.place").cast("long").alias("place"))


def dotted_parents(items: DataFrame, by: str, structure: str, order: str) -> DataFrame:
    """(.., parent): the order of the earlier row whose structure is this one's without its last number."""
    p = items.select(F.col(by).alias("_by"), F.col(structure).alias("_s"), F.col(order).alias("_o"))
    up = F.when(F.contains(structure, F.lit(".")), F.regexp_replace(structure, r"\.[^.]+$", ""))
    j = items.withColumn("_up", up).join(p, (F.col(by) == F.col("_by")) & (F.col("_up") == F.col("_s")) & (F.col("_o") < F.col(order)), "left")
    return j.groupBy(*items.columns).agg(F.max("_o").alias("parent"))


def capped_outline(nodes: DataFrame, by: str, order: str, depth: str, title: str, most: int = 200) -> DataFrame:
    """(by, outline): a group's first nodes as an indented list."""
    kept = nodes.withColumn("_p", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_p") <= most)
    line = F.concat(F.repeat(F.lit("  "), F.col(depth)), F.lit("- "), F.left(title, F.lit(100)))
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", line.alias("t")))), lambda x: x["t"]), "\n").alias("outline"))


def relative_time(then: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    ago = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit}前"))
    return F.when(s < 60, "刚刚").when(s < 3600, ago(60, "分钟")).when(s < 86400, ago(3600, "小时")).when(s < 7 * 86400, ago(86400, "天")).otherwise(F.date_format(then, "yyyy-MM-dd"))


def cited_validity(answers: DataFrame, known: DataFrame, key: str, bound: float = 0.3) -> DataFrame:
    """(key, cited, ghosts, ghostly) of answers(key, block): citations that no result holds, and whether they are
    more than ``bound`` of an answer's."""
    j = answers.select(key, "block").distinct().join(known.select(key, "block").distinct().withColumn("_k", F.lit(1)), [key, "block"], "left")
    g = j.groupBy(key).agg(F.count("*").alias("cited"), F.count_if(F.col("_k").isNull()).alias("ghosts"))
    return g.withColumn("ghostly", F.col("ghosts") / F.col("cited") > bound)


def display_title(text: Column) -> Column:
    return X.simple_title(X.clean_title(text))
