"""Change detection, upserts, retention, facets and other set-like operators over keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.ordered import placed


def change_classes(current: DataFrame, stored: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """(key, change): new, changed (any watched column differs), unchanged, or deleted."""
    a = current.select(key, F.lit(1).alias("_now"), *[F.col(c).alias(f"_a_{c}") for c in watched])
    b = stored.select(key, F.lit(1).alias("_then"), *[F.col(c).alias(f"_b_{c}") for c in watched])
    differs = reduce(lambda x, c: x | ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), watched, F.lit(False))
    kind = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(differs, "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


def to_sync(remote: DataFrame, local: DataFrame, excluded: DataFrame, key: str, watched: list[str], force: bool = False) -> DataFrame:
    """Remote rows that are not excluded and are new or changed against the local state (all of them by force)."""
    kept = remote.join(excluded.select(key), key, "left_anti")
    if force:
        return kept
    c = change_classes(kept, local, key, watched).where("change in ('new', 'changed')")
    return kept.join(c.select(key), key, "left_semi")


def upsert(stored: DataFrame, fresh: DataFrame, key: str | list[str]) -> DataFrame:
    """Stored rows whose key does not come anew, and all fresh rows."""
    return stored.join(fresh.select(key) if isinstance(key, list) else fresh.select(key), key, "left_anti").unionByName(fresh)


def newest(rows: DataFrame, order: list[Column], n: int, by: list[str] | None = None) -> DataFrame:
    """The n first rows in order, a group or over all (then by a top-n, which gathers n rows a partition alone)."""
    if not by:
        return rows.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_p", place).where(F.col("_p") <= n).drop("_p")


def archive_split(rows: DataFrame, by: str, order: str, most: int = 200, keep: int = 150) -> DataFrame:
    """With ``archived``: in groups of more than ``most`` rows all but the last ``keep``."""
    d = placed(rows, [by], [F.desc(order)], "_b", "_n")
    return d.withColumn("archived", (F.col("_n") > most) & (F.col("_b") >= keep)).drop("_n", "_b")


def first_of(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_p", place).where("_p = 1").drop("_p")


def facets(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: how many rows meet each condition, and all of them."""
    return rows.agg(F.count("*").alias("all_rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def value_counts(rows: DataFrame, column: str, unknown: str = "__unknown__") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(unknown)).alias("value")).agg(F.count("*").alias("n"))


def mode(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, mode, n): the most frequent value; of equals the one met first."""
    c = rows.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return c.groupBy(by).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("a"), "_first")).alias("x")).select(by, F.col(f"x.{value}").alias("mode"), F.col("x.n").alias("n"))


def directory_summary(files: DataFrame, directory: str, name: str, tokens: str, joiner: str = "、") -> DataFrame:
    """(directory, files, tokens, names): names in order, joined."""
    return files.groupBy(directory).agg(F.count("*").alias("files"), F.sum(tokens).cast("long").alias("tokens"), F.array_join(F.array_sort(F.collect_list(name)), joiner).alias("names"))


def reverse_links(links: DataFrame, source: str, target: str) -> DataFrame:
    """(target, sources, names): who links to each target, once each and in order."""
    d = links.select(source, target).distinct()
    return d.groupBy(target).agg(F.count("*").alias("sources"), F.array_join(F.transform(F.array_sort(F.collect_list(source)), lambda x: x.cast("string")), ",").alias("names"))


def removed_links(before: DataFrame, now: DataFrame, columns: list[str]) -> DataFrame:
    return before.select(*columns).distinct().join(now.select(*columns).distinct(), columns, "left_anti")


def _holders(needles: DataFrame, holders: DataFrame, needle: str, holder: str) -> DataFrame:
    """Rows of both with the needle inside the holder. A needle meets holders on the rarest of its character pairs (on
    itself if it is one character), so a common pair joins nothing but needles that have no rarer one."""
    from lectern.functions.similarity import bigrams

    grams = lambda c: F.when(F.length(c) == 1, F.array(F.col(c))).otherwise(bigrams(F.col(c)))
    n = needles.where(F.length(needle) > 0).withColumn("_id", F.xxhash64(needle))
    own = n.select(needle, "_id").distinct().withColumn("_g", F.explode(grams(needle)))
    single = own.where(F.length("_g") == 1).select("_g").distinct()
    held = holders.withColumn("_two", F.explode(F.array_distinct(F.concat(bigrams(F.col(holder)), F.filter(F.split(F.col(holder), ""), lambda c: c != "")))))
    held = held.where(F.length("_two") == 2).unionByName(held.where(F.length("_two") == 1).join(single, F.col("_two") == F.col("_g"), "left_semi"))
    often = held.groupBy(F.col("_two").alias("_g")).agg(F.count("*").alias("_n"))
    rarest = own.join(often, "_g", "left").groupBy(needle, "_id").agg(F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)), "_g")).alias("_g"))
    return n.join(rarest.select("_id", "_g"), "_id").join(held, F.col("_g") == F.col("_two")).where(F.contains(holder, needle)).drop("_id", "_g", "_two")


def fuzzy_first_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, title: str, author: str) -> DataFrame:
    """(left_key, right_key): each left row's first right row whose title holds the other's or is held by it, and
    whose authors hold one another or are empty; titles and authors in their normal form, empty titles match nothing."""
    from lectern.functions.text import normal_author, normal_title

    rows = left.select(left_key, normal_title(F.col(title)).alias("_ta"), normal_author(F.coalesce(author, F.lit(""))).alias("_aa"))
    a = rows.select("_ta", "_aa").distinct()
    # Of equal titles and authors the first row alone can be a match.
    b = right.select(right_key, normal_title(F.col(title)).alias("_tb"), normal_author(F.coalesce(author, F.lit(""))).alias("_ab")).groupBy("_tb", "_ab").agg(F.min(right_key).alias(right_key))
    pairs = _holders(b, a, "_tb", "_ta").unionByName(_holders(a, b, "_ta", "_tb")).where(
        (F.col("_aa") == "") | (F.col("_ab") == "") | F.contains(F.col("_aa"), F.col("_ab")) | F.contains(F.col("_ab"), F.col("_aa"))
    )
    first = pairs.groupBy("_ta", "_aa").agg(F.min(right_key).alias(right_key))
    return rows.join(first, ["_ta", "_aa"]).select(left_key, right_key)
