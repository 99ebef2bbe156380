"""Notes, tables of contents and service records: joins and rules that complete the shelves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators.ordered import placed


def toc_with_pages(toc: DataFrame, found: DataFrame, by: str, title: str, start: str) -> DataFrame:
    """Every toc row with every page of the same title in its book that does not lie before its start."""
    return toc.join(found.select(by, title, F.col("page").alias("found_page")), [by, title]).where(F.col("found_page") >= F.col(start))


def bookmark_of(titles: DataFrame, bookmarks: DataFrame, key: str, mark: str, title: str, least: int = 3) -> DataFrame:
    """(key, mark): a title's first bookmark of the same form (without blanks and ``-—:：.·``, in lower case), else the first
    of ``least`` characters or more that holds the title or is held by it; an empty title is held by all of these."""
    from lectern.operators.changes import _holders

    form = F.regexp_replace(F.lower(title), r"[\s\-—:：.·]", "")
    a = titles.select(key, form.alias("_a"))
    b = bookmarks.groupBy(form.alias("_b")).agg(F.min(mark).alias(mark))  # of equal forms the first alone can be met
    long = b.where(F.length("_b") >= least)
    forms = a.select("_a").distinct()
    held = _holders(long, forms, "_b", "_a").select("_a", mark).unionByName(_holders(forms.where("_a <> ''"), long, "_a", "_b").select("_a", mark))
    empty = forms.where("_a = ''").crossJoin(F.broadcast(long.agg(F.min(mark).alias(mark)).where(F.col(mark).isNotNull())))  # a row at most on either side
    part = held.unionByName(empty).groupBy("_a").agg(F.min(mark).alias("_y"))
    exact = b.select(F.col("_b").alias("_a"), F.col(mark).alias("_x"))
    return a.join(exact, "_a", "left").join(part, "_a", "left").select(key, F.coalesce("_x", "_y").alias(mark)).where(F.col(mark).isNotNull())


def with_popularity(highlights: DataFrame, popular: DataFrame, keys: list[str], count: str = "readers") -> DataFrame:
    """Highlights with how many readers marked the same place; 0 where none are known."""
    return highlights.join(popular.select(*keys, count), keys, "left").withColumn(count, F.coalesce(count, F.lit(0).cast("long")))


def topics(extractions: DataFrame, topic: str, tag: str, most: int = 5) -> DataFrame:
    """(topic, mentions, tags): each topic's first distinct tags in order."""
    return extractions.groupBy(topic).agg(F.count("*").alias("mentions"), F.array_join(F.slice(F.array_sort(F.collect_set(tag)), 1, most), ",").alias("tags"))


def merged_facts(old: DataFrame, new: DataFrame, dimension: str, fact: str) -> DataFrame:
    """(dimension, facts): old facts in order, then new ones not among them."""
    rows = old.select(dimension, fact, F.lit(0).alias("_s"), "seq").unionByName(new.select(dimension, fact, F.lit(1).alias("_s"), "seq"))
    first = rows.groupBy(dimension, fact).agg(F.min(F.struct("_s", "seq")).alias("o"))
    return first.groupBy(dimension).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", fact))), lambda x: x[fact]), "；").alias("facts"))


def substantive_score(blocks: DataFrame, by: str, block: str, text: str) -> DataFrame:
    """(by, score): the best block's 20 with a block id, a tenth of its length up to 30, 15 over 20 characters; 0 where no
    block has an id."""
    named, size = F.coalesce(F.col(block), F.lit("")) != "", F.length(F.coalesce(text, F.lit("")))
    best = F.max(F.when(named, 20.0).otherwise(0.0) + F.least(size / 10, F.lit(30.0)) + F.when(size > 20, 15.0).otherwise(0.0))
    return blocks.groupBy(by).agg(F.round(F.when(F.max(named), best).otherwise(0.0), 4).alias("score"))


def sync_counters(log: DataFrame, status: str) -> DataFrame:
    return log.groupBy(status).agg(F.count("*").alias("n"))


def index_health(nodes: DataFrame, by: str, title: str, summary: str) -> DataFrame:
    """(by, nodes, blank, blank_share, chapters, misplaced, healthy): titles that are blank or ##, titles of numbered
    chapters, summaries under such a blank title; healthy with chapters and none of the others."""
    bad = F.trim(F.coalesce(title, F.lit(""))).isin("", "##")
    chapter = F.coalesce(F.col(title).rlike("^第[一二三四五六七八九十百千\\d]+章"), F.lit(False))
    g = nodes.groupBy(by).agg(
        F.count("*").alias("nodes"), F.count_if(bad).alias("blank"), F.round(100 * F.avg(bad.cast("int")), 1).alias("blank_share"), F.count_if(chapter).alias("chapters"), F.count_if(bad & (F.length(F.coalesce(summary, F.lit(""))) > 0)).alias("misplaced")
    )
    return g.withColumn("healthy", (F.col("blank") == 0) & (F.col("chapters") > 0) & (F.col("misplaced") == 0))


def enriched_tree(tree: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Tree rows with the start, end, summary and text of the flat nodes of the same id where these have them."""
    fields = ("start", "end", "summary", "text")
    j = tree.join(nodes.select(key, *[F.col(f).alias(f"_{f}") for f in fields]), key, "left")
    own = {f: F.coalesce(f"_{f}", f) for f in ("start", "end")} | {f: F.coalesce(F.nullif(f"_{f}", F.lit("")), F.nullif(f, F.lit(""))) for f in ("summary", "text")}
    return j.select(*[own[c].alias(c) if c in own else F.col(c) for c in tree.columns])


def normalised_notebook(raw: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(highlights, reviews) of a service's answers raw(key, chapters, highlights, reviews) as JSON: a highlight's chapter
    title is that of the chapter list, else its own, else empty; reviews are unnested, with defaults."""
    chapters = raw.select(key, F.explode(F.from_json("chapters", "array<struct<chapterUid:int,title:string>>")).alias("c")).select(key, F.col("c.chapterUid").alias("chapter_uid"), F.col("c.title").alias("_title"))
    marks = raw.select(key, F.explode(F.from_json("highlights", "array<struct<bookmarkId:string,markText:string,chapterUid:int,chapterName:string,createTime:bigint>>")).alias("h"))
    marks = marks.select(key, F.col("h.bookmarkId").alias("bookmark_id"), F.col("h.markText").alias("mark_text"), F.col("h.chapterUid").alias("chapter_uid"), F.col("h.chapterName").alias("_name"), F.col("h.createTime").alias("create_time"))
    highlights = marks.join(chapters.dropDuplicates([key, "chapter_uid"]), [key, "chapter_uid"], "left").withColumn("chapter_title", F.coalesce("_title", "_name", F.lit(""))).drop("_title", "_name")
    kind = "array<struct<reviewId:string,review:struct<reviewId:string,content:string,htmlContent:string,chapterUid:int,chapterTitle:string,chapterName:string,createTime:bigint,type:int>>>"
    r = raw.select(key, F.explode(F.from_json("reviews", kind)).alias("r")).select(key, "r.reviewId", F.col("r.review").alias("v"))
    content = F.coalesce(F.col("v.content"), F.lit(""))
    reviews = r.select(
        key, F.coalesce("v.reviewId", "reviewId").alias("review_id"), content.alias("content"), F.when(F.coalesce("v.htmlContent", F.lit("")) != "", X.html_text(F.col("v.htmlContent"))).otherwise(content).alias("md_content"),
        F.coalesce("v.chapterUid", F.lit(0)).alias("chapter_uid"), F.coalesce("v.chapterTitle", "v.chapterName", F.lit("")).alias("chapter_title"), F.coalesce("v.createTime", F.lit(0).cast("long")).alias("create_time"), F.coalesce("v.type", F.lit(1)).alias("type"),
    )
    return highlights, reviews


# What an index's status says.
UNDER_WAY = ["processing", "indexing", "started", "created", "running", "active", "pending", "queued", "uploading"]
READY = ["ready", "completed", "success"]


def index_changes(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """(key, new, changed, completed) of index states(key, status, progress, message): changed if status or message
    differ or progress moved by 5 and more, completed if it was under way and is ready."""
    b = before.select(key, F.lit(True).alias("_known"), F.lower("status").alias("_s"), F.col("progress").alias("_p"), F.coalesce("message", F.lit("")).alias("_m"))
    j = now.join(b, key, "left").withColumn("_k", F.coalesce("_known", F.lit(False)))
    status = F.lower(F.coalesce("status", F.lit("")))
    differs = (F.when(status == "", "unknown").otherwise(status) != F.col("_s")) | (F.abs(F.coalesce("progress", F.lit(0)) - F.col("_p")) >= 5) | (F.coalesce("message", F.lit("")) != F.col("_m"))
    return j.select(key, (~F.col("_k")).alias("new"), (F.col("_k") & F.coalesce(differs, F.lit(False))).alias("changed"), (F.col("_k") & F.coalesce(F.col("_s").isin(*UNDER_WAY), F.lit(False)) & status.isin(*READY)).alias("completed"))


def merged_index_lists(fresh: DataFrame, current: DataFrame, key: str, order: str, active: str | None = None) -> DataFrame:
    """Fresh indexes in order but the one being made, then its current row, then current rows that are temporary or under
    way and not among the fresh ones; the first of a key stays."""
    cols = fresh.columns
    busy = F.startswith(key, F.lit("temp_")) | F.lower("status").isin(*UNDER_WAY)
    part = lambda d, n: d.select(*cols, F.lit(n).alias("_part"))
    rest = current.join(fresh.select(key), key, "left_anti").where(busy)
    every = part(fresh.where(F.col(key) != F.lit(active or "")), 0).unionByName(part(current.where(F.col(key) == F.lit(active or "")), 1)).unionByName(part(rest, 2))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_part", order))
    return every.withColumn("_r", place).where("_r = 1").drop("_r", "_part")


def toggled_archive(catalog: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The catalog(key, archived) after wanted keys were toggled, with ``toggled``; unknown ones come in archived."""
    w = wanted.select(key).distinct().withColumn("_w", F.lit(True))
    j = catalog.select(key, F.coalesce("archived", F.lit(False)).alias("archived"), F.lit(True).alias("_c")).join(w, key, "full_outer")
    hit = F.coalesce("_w", F.lit(False))
    return j.select(key, F.when(F.col("_c").isNull(), True).when(hit, ~F.col("archived")).otherwise(F.col("archived")).alias("archived"), hit.alias("toggled"))


def routed_intents(inputs: DataFrame, rules: list[tuple[str, str, list[str], int]], key: str, text: str, fallback: tuple[str, list[str], int], default: int = 10) -> DataFrame:
    """(key, intents, tools, iterations): of all rules (pattern, intent, tools, iterations) that any text of a key meets,
    the intents and tools once each, in order of the rules, and the most iterations; the fallback where none does."""
    hit = F.array(*[F.when(F.col(text).rlike(p), F.lit(i)) for i, (p, *_) in enumerate(rules)])
    g = inputs.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(hit))))).alias("_hits"))
    of = F.array(*[F.struct(F.lit(intent).alias("intent"), F.array(*[F.lit(t) for t in tools]).cast("array<string>").alias("tools"), F.lit(n or default).alias("n")) for _, intent, tools, n in rules])
    met = F.transform("_hits", lambda i: F.get(of, i))
    none = F.size("_hits") == 0
    return g.select(
        key, F.when(none, F.array(F.lit(fallback[0]))).otherwise(F.array_distinct(F.transform(met, lambda x: x["intent"]))).alias("intents"),
        F.when(none, F.array(*[F.lit(t) for t in fallback[1]]).cast("array<string>")).otherwise(F.array_distinct(F.flatten(F.transform(met, lambda x: x["tools"])))).alias("tools"),
        F.when(none, F.lit(fallback[2])).otherwise(F.array_max(F.transform(met, lambda x: x["n"]))).alias("iterations"),
    )


def complete_indexes(files: DataFrame, book: str, name: str, needed: tuple[str, ...] = ("tree.json", "book-meta.json", "bm25.json")) -> DataFrame:
    return files.where(F.col(name).isin(*needed)).groupBy(book).agg((F.count_distinct(name) == len(needed)).alias("complete"))


def with_preface(sections: DataFrame, by: str, start: str, title: str) -> DataFrame:
    """A preface row before books whose first section starts after page 1."""
    first = sections.groupBy(by).agg(F.min(start).alias("_f")).where("_f > 1")
    rows = first.select(by, F.lit(1).cast(sections.schema[start].dataType).alias(start), F.lit("Preface").alias(title))
    return sections.select(by, start, title).unionByName(rows)


def siblings(nodes: DataFrame, by: list[str], order: str, title: str) -> DataFrame:
    """With ``siblings``: the titles of the other nodes below the same parent, in order. A parent's children are a level
    of one table of contents."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_ = F.collect_list(F.struct(F.col(order).alias("o"), F.col(title).alias("t"))).over(w)
    return nodes.withColumn("siblings", F.array_join(F.transform(F.filter(all_, lambda x: x["o"] != F.col(order)), lambda x: x["t"]), ","))


def paragraph_ids(paragraphs: DataFrame, by: str, section: str, order: str) -> DataFrame:
    """With ``block_id``: s{section}-{place of three digits} in each section."""
    d = placed(paragraphs, [by, section], [order], "_place")
    number = X.padded(F.col("_place") + 1, 3)
    return d.withColumn("block_id", F.concat(F.lit("s"), F.col(section).cast("string"), F.lit("-"), number)).drop("_place")


def split_at_anchors(pages: DataFrame, anchors: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, anchor, part): the text from each found anchor to the next one."""
    at = F.instr(F.col(html), F.concat(F.lit('id="'), F.col("anchor"), F.lit('"')))
    found = pages.join(anchors, key).withColumn("_at", at).where("_at > 0")
    following = F.lead("_at").over(Window.partitionBy(key).orderBy("_at", "anchor"))
    return found.withColumn("_next", F.coalesce(following, F.length(html) + 1)).select(key, "anchor", F.substring(html, F.col("_at"), F.col("_next") - F.col("_at")).alias("part"))


def section_text(nodes: DataFrame, wanted: DataFrame, key: str, text: str = "text", most: int = 8_000) -> DataFrame:
    """Wanted sections with their text, cut at ``most`` characters; unknown ids stay with null."""
    cut = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n..."))).otherwise(F.col(text))
    return wanted.join(nodes.select(key, cut.alias(text), (F.length(text) > most).alias("cut")), key, "left")


def resolved_ids(requested: DataFrame, indexed: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """(key, book): requested ids that are indexed, or are mapped to an indexed one."""
    direct = requested.join(indexed.select(key), key, "left_semi").select(key, F.col(key).alias("book"))
    rest = requested.join(indexed.select(key), key, "left_anti").join(mapping.select(key, "book"), key)
    return direct.unionByName(rest.join(indexed.select(F.col(key).alias("book")), "book", "left_semi").select(key, "book"))


def newer_than_recorded(files: DataFrame, recorded: DataFrame, key: str, time: str) -> DataFrame:
    return files.join(recorded.select(key, F.col(time).alias("_t")), key, "left").where(F.col("_t").isNull() | (F.col(time) > F.col("_t"))).drop("_t")


def dropped_fields(nodes: DataFrame, fields: list[str]) -> DataFrame:
    return nodes.drop(*fields)


TEMPLATE_FILTERS = {
    "formatDate": lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd"),
    "formatDateTime": lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm"),
    "split": lambda c, by=",": F.split(c, by),
    "replace": lambda c, old="", new="": F.replace(c, F.lit(old), F.lit(new)),
    "trim": lambda c: F.trim(c),
}


def template_filter(name: str, c: Column, **arguments) -> Column:
    return TEMPLATE_FILTERS[name](c, **arguments)
