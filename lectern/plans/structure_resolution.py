"""A book's structure from several readings of its table of contents: corrected by bookmarks, checked against pages, chosen by
accuracy, and mended where it is wrong. Readings come from hooks; all books are resolved at once, without a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GATE = 0.6


def appears(title: Column, text: Column) -> Column:
    """Whether a page bears a title, white space and case apart; an empty title stands nowhere."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    return (plain(title) != "") & F.contains(plain(text), plain(title))


def corrected(items: DataFrame, bookmarks: DataFrame, book: str, place: list[str]) -> DataFrame:
    """Items(book, .., title, physical) with the page of the bookmark of the same book and form of title where there is one."""
    form = lambda c: F.regexp_replace(F.lower(c), r"[\s\-—:：.·]", "")
    first = bookmarks.groupBy(F.col(book).alias("_b"), form(F.col("title")).alias("_t")).agg(F.min_by("page", "order").alias("_page"))
    j = items.join(first, (F.col(book) == F.col("_b")) & (form(F.col("title")) == F.col("_t")), "left")
    return j.withColumn("physical", F.coalesce("_page", "physical")).drop("_b", "_t", "_page")


def resolved(items: DataFrame, pages: DataFrame, book: str, bookmarks: DataFrame | None = None, gate: float = GATE) -> DataFrame:
    """(book, strategy, place, title, page, state) of items(book, strategy, place, title, physical) against pages(book, page, text).

    Each strategy's items that lie in the book are checked on their pages; a book keeps the first strategy that is right
    for ``gate`` of its items, and none if no strategy is. A wrong item moves to the first page between its right
    neighbours that bears its title (``mended``), else it keeps its page (``wrong``)."""
    if bookmarks is not None:
        items = corrected(items, bookmarks, book, ["strategy", "place"])
    last = pages.groupBy(book).agg(F.max("page").alias("_last"))
    inside = items.join(last, book).where(F.col("physical").between(1, F.col("_last")))
    text = pages.select(F.col(book).alias("_b"), F.col("page").alias("_p"), F.col("text").alias("_text"))
    seen = inside.join(text, (F.col(book) == F.col("_b")) & (F.col("physical") == F.col("_p")), "left")
    checked = seen.withColumn("right", F.coalesce(appears(F.col("title"), F.col("_text")), F.lit(False))).drop("_b", "_p", "_text")
    share = checked.groupBy(book, "strategy").agg(F.avg(F.col("right").cast("int")).alias("_share")).where(F.col("_share") >= gate)
    chosen = checked.join(share.groupBy(book).agg(F.min("strategy").alias("strategy")), [book, "strategy"])
    # A table of contents is a small ordered list: its right neighbours are two running windows.
    w, page = Window.partitionBy(book).orderBy("place"), F.when(F.col("right"), F.col("physical"))
    low = F.coalesce(F.last(page, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    high = F.coalesce(F.first(page, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.col("_last"))
    placed = chosen.withColumn("_low", low).withColumn("_high", high)
    wrong = placed.where(~F.col("right") & (F.col("_low") <= F.col("_high")))
    asked = wrong.select(book, "place", "title", F.explode(F.sequence("_low", "_high")).alias("_at"))
    found = asked.join(text, (F.col(book) == F.col("_b")) & (F.col("_at") == F.col("_p"))).where(appears(F.col("title"), F.col("_text")))
    mended = found.groupBy(F.col(book).alias("_book"), F.col("place").alias("_place")).agg(F.min("_at").alias("_to"))
    j = placed.join(mended, (F.col(book) == F.col("_book")) & (F.col("place") == F.col("_place")), "left")
    state = F.when(F.col("right"), "right").when(F.col("_to").isNotNull(), "mended").otherwise("wrong")
    return j.select(book, "strategy", "place", "title", F.coalesce("_to", "physical").alias("page"), state.alias("state"))
