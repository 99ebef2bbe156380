"""Plans over the library: the shelf's synchronisation and the compilation of a note vault."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import changes as C
from lectern.operators.links import merge_plan
from lectern.operators.ordered import placed
from lectern.sources.files import classified_directories


@dataclass
class Sync:
    """to_sync: books with ``is_new``; state: the new state; log: one row of counters; results: a row a book tried."""

    to_sync: DataFrame
    results: DataFrame
    state: DataFrame
    log: DataFrame


def synced_shelf(remote: DataFrame, state: DataFrame, failed: DataFrame, now: Column, force: bool = False, least_notes: int = 0, articles: bool = False, key: str = "book_id") -> Sync:
    """One synchronisation of remote(book_id, title, book_type, notes, reviews, ...) against state of the same columns and
    last_sync_time. Books without a title, articles (type 3) and those with too few notes are left out; the new and the
    changed ones are tried; failed(book_id, error) holds what the fetch hook could not do, and keeps its old state."""
    books = remote.where(F.coalesce("title", F.lit("")) != "")
    if not articles:
        books = books.where(~F.coalesce(F.col("book_type") == 3, F.lit(False)))
    if least_notes > 0:
        books = books.where(F.col("notes") + F.col("reviews") >= least_notes)
    known = state.select(key, F.col("notes").alias("_notes"), F.col("reviews").alias("_reviews"), F.lit(True).alias("_known"))
    marked = books.join(known, key, "left").withColumn("is_new", F.col("_known").isNull())
    differs = F.col("is_new") | (F.col("notes") != F.col("_notes")) | (F.col("reviews") != F.col("_reviews"))
    to_sync = (marked if force else marked.where(differs)).drop("_notes", "_reviews", "_known")
    results = to_sync.join(failed.select(key, "error"), key, "left")
    done = results.where("error is null")
    fresh = done.select(*remote.columns, now.alias("last_sync_time"))
    counts = results.agg(
        F.count("*").alias("tried"), F.count_if(F.col("error").isNull() & F.col("is_new")).alias("added"), F.count_if(F.col("error").isNull() & ~F.col("is_new")).alias("updated"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("error_message"),
    )
    log = counts.crossJoin(books.agg(F.count("*").alias("total_books"))).select(
        "total_books", (F.col("added") + F.col("updated")).alias("synced_books"), (F.col("total_books") - F.col("tried")).alias("skipped_books"), "added", "updated", (F.col("errors") == 0).alias("success"), F.nullif("error_message", F.lit("")).alias("error_message")
    )
    return Sync(to_sync, results, C.upsert(state, fresh, key), log)


def mapping_with_stats(mapping: DataFrame, state: DataFrame, key: str = "book_id") -> DataFrame:
    """The mapping with what the last synchronisation knows of each book; nulls where it was never synchronised."""
    s = state.select(
        key, F.col("notes").alias("note_count"), F.col("reviews").alias("review_count"), F.coalesce("progress", F.lit(0.0)).alias("progress"), X.duration_text(F.coalesce("reading_time", F.lit(0))).alias("reading_time"),
        F.coalesce(F.date_format(F.timestamp_millis("last_sync_time"), "yyyy-MM-dd"), F.lit("")).alias("last_read_date"),
    )
    return mapping.join(s, key, "left")


def topic_groups(extractions: DataFrame, topic: str = "topic") -> DataFrame:
    """With ``topic`` as the notes' own topics name it: a proposal's mark is taken away."""
    return extractions.withColumn(topic, F.replace(topic, F.lit("新建:"), F.lit("")))


def overall_quality(layers: DataFrame, by: str, quality: str) -> DataFrame:
    """(by, quality, layers): poor if any layer is, else degraded if any is, else good."""
    worst = F.max(F.when(F.col(quality) == "poor", 2).when(F.col(quality) == "degraded", 1).otherwise(0))
    return layers.groupBy(by).agg(F.element_at(F.array(F.lit("good"), F.lit("degraded"), F.lit("poor")), worst + 1).alias("quality"), F.count("*").alias("layers"))


def reading_summary(entries: DataFrame, order: str, text: str, last: int = 5) -> DataFrame:
    """One row (books, recent): how many different titles in 《》 the log names, and the last of them in order of first mention."""
    named = entries.select(order, F.posexplode(F.regexp_extract_all(text, F.lit("《(.+?)》"), F.lit(1))).alias("_p", "title"))
    first = named.groupBy("title").agg(F.min(F.struct(F.col(order).alias("o"), F.col("_p").alias("p"))).alias("_first"))
    recent = first.orderBy(F.desc("_first")).limit(last).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", "title"))), lambda x: x["title"]), "、").alias("recent"))
    return first.agg(F.count("*").alias("books")).crossJoin(recent)


@dataclass
class Compiled:
    directories: DataFrame
    topics: DataFrame
    plans: DataFrame
    backlinks: DataFrame
    removed: DataFrame


def compiled_vault(files: DataFrame, extractions: DataFrame, links_before: DataFrame, links_now: DataFrame) -> Compiled:
    """The steps of a vault's compilation from files(path, existing), the concept hook's
    extractions(path, topic, tags, links) and the links (path, target) before and now: directories are classed, links the
    user took away since are remembered, extractions are grouped by topic, each note gets its merge plan, and each
    linked note its backlinks, counted once a source."""
    removed = C.removed_links(links_before, links_now, ["path", "target"])
    gone = removed.groupBy("path").agg(F.collect_set("target").alias("removed"))
    none = F.array().cast("array<string>")
    notes = files.select("path", F.coalesce("existing", none).alias("existing")).join(extractions.select("path", "tags", "links"), "path").join(gone, "path", "left")
    plans = merge_plan(notes.withColumn("removed", F.coalesce("removed", none)), "path")
    grouped = topic_groups(extractions).groupBy("topic").agg(F.count("*").alias("notes"), F.count_distinct("path").alias("sources"))
    target = extractions.select("path", F.explode("links").alias("l")).select("path", F.col("l.target").alias("target"))
    backlinks = target.join(removed, ["path", "target"], "left_anti").distinct().groupBy("target").agg(F.count("*").alias("sources"))
    return Compiled(classified_directories(files.select("path")), grouped, plans, backlinks, removed)


def latest_logs(logs: DataFrame, order: str, most: int = 10) -> DataFrame:
    return logs.orderBy(F.desc(order)).limit(most)


def shelf_order(books: DataFrame, status: str, by: list[Column]) -> DataFrame:
    """With ``place``: books under way come first, then the others by the given columns."""
    return placed(books, [], [F.when(F.col(status) == "processing", 0).otherwise(1), *by])
