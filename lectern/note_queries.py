"""Queries over notes, contents and service records, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import notes as O
from lectern.operators import structure as N
from lectern.queries import _LINES, nodes, query, t


@query("WITH d AS (SELECT source, md5(text) AS title, doc_id FROM documents) SELECT a.source, a.title, a.doc_id AS start, b.doc_id AS found_page FROM d a JOIN d b ON a.source = b.source AND a.title = b.title AND b.doc_id >= a.doc_id")
def jn13_contents_with_pages(spark, d):
    docs = t(spark, d, "documents").select("source", F.md5("text").alias("title"), "doc_id")
    return O.toc_with_pages(docs.withColumnRenamed("doc_id", "start"), docs.withColumnRenamed("doc_id", "page"), "source", "title", "start")


@query("""WITH k AS (SELECT user_id, event_type, count(*) AS readers FROM events WHERE event_id % 4 = 0 GROUP BY 1, 2) SELECT event_id, user_id, event_type, coalesce(readers, 0) AS readers FROM events LEFT JOIN k USING (user_id, event_type)""")
def jn19_with_popularity(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type")
    return O.with_popularity(e, e.where("event_id % 4 = 0").groupBy("user_id", "event_type").agg(F.count("*").alias("readers")), ["user_id", "event_type"])


@query("SELECT source, count(*) AS mentions, array_to_string(list_slice(list_sort(list_distinct(list(lang))), 1, 3), ',') AS tags FROM documents GROUP BY 1")
def ag22_topics(spark, d):
    return O.topics(t(spark, d, "documents"), "source", "lang", 3)


@query("""WITH r AS (SELECT user_id, event_type, 0 AS s, event_id AS seq FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, 1, event_id FROM events WHERE event_id % 2 = 1),
 f AS (SELECT user_id, event_type, min(s * 1000000000 + seq) AS o FROM r GROUP BY 1, 2) SELECT user_id, string_agg(event_type, '；' ORDER BY o) AS facts FROM f GROUP BY 1""")
def ag37_merged_facts(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq"))
    return O.merged_facts(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"), "user_id", "event_type")


@query("""WITH b AS (SELECT doc_id // 4 AS grp, CASE WHEN doc_id % 7 < 2 THEN 'p' || doc_id::VARCHAR ELSE '' END AS block, left(text, (doc_id % 60)::INT) AS text FROM documents)
 SELECT grp, round(CASE WHEN max((block <> '')::INT) = 0 THEN 0 ELSE max(CASE WHEN block <> '' THEN 20 ELSE 0 END + least(length(text) / 10, 30) + CASE WHEN length(text) > 20 THEN 15 ELSE 0 END) END, 4)::DOUBLE AS score FROM b GROUP BY 1""")
def ag42_substantive_score(spark, d):
    """Four documents are one answer's blocks, cut at up to 59 characters; some answers have no block id."""
    blocks = nodes(spark, d).select(F.floor(F.col("doc_id") / 4).alias("grp"), F.when(F.col("doc_id") % 7 < 2, F.concat(F.lit("p"), F.col("doc_id").cast("string"))).otherwise("").alias("block"), F.left("text", (F.col("doc_id") % 60).cast("int")).alias("text"))
    return O.substantive_score(blocks, "grp", "block", "text")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def ag46_sync_counters(spark, d):
    return O.sync_counters(t(spark, d, "orders"), "o_orderstatus")


@query("""WITH d AS (SELECT source, CASE WHEN doc_id % 97 = 0 THEN '##' WHEN doc_id % 10 = 0 THEN '第' || (doc_id % 100)::VARCHAR || '章' ELSE text END AS title, lang FROM documents), g AS (SELECT source, count(*) AS nodes, count(*) FILTER (trim(title) IN ('', '##')) AS blank,
 round(100 * avg((trim(title) IN ('', '##'))::INT), 1) AS blank_share, count(*) FILTER (regexp_matches(title, '^第[一二三四五六七八九十百千0-9]+章')) AS chapters, count(*) FILTER (trim(title) IN ('', '##') AND length(lang) > 0) AS misplaced FROM d GROUP BY 1)
 SELECT *, blank = 0 AND chapters > 0 AND misplaced = 0 AS healthy FROM g""")
def ag48_index_health(spark, d):
    number = F.concat(F.lit("第"), (F.col("doc_id") % 100).cast("string"), F.lit("章"))
    title = F.when(F.col("doc_id") % 97 == 0, "##").when(F.col("doc_id") % 10 == 0, number).otherwise(F.col("text"))
    return O.index_health(t(spark, d, "documents").select("source", title.alias("title"), "lang"), "source", "title", "lang")


@query("SELECT doc_id, source, 's' || (doc_id % 4)::VARCHAR || '-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS block_id FROM (SELECT *, row_number() OVER (PARTITION BY source, doc_id % 4 ORDER BY doc_id) AS n FROM documents)")
def wn23_paragraph_ids(spark, d):
    n = nodes(spark, d).select("doc_id", "source", (F.col("doc_id") % 4).alias("section"))
    return O.paragraph_ids(n, "source", "section", "doc_id").drop("section")


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, line, list(line ORDER BY line) OVER (PARTITION BY doc_id, line // 8) AS a FROM ln)
 SELECT doc_id, line, array_to_string(list_transform(list_sort(list_filter(a, lambda x: x <> line)), lambda x: x::VARCHAR), ',') AS siblings FROM s""")
def ar5_siblings(spark, d):
    """A text's lines, eight below each parent."""
    n = N.lines(nodes(spark, d), "doc_id").select("doc_id", "line", F.floor(F.col("line") / 8).alias("parent"), F.col("line").cast("string").alias("title"))
    return O.siblings(n, ["doc_id", "parent"], "line", "title").select("doc_id", "line", "siblings")


@query("SELECT i.k, left(d.text, 500) || CASE WHEN length(d.text) > 500 THEN chr(10) || '...' ELSE '' END AS text, length(d.text) > 500 AS cut FROM (SELECT item_id * 37 AS k FROM benchmark) i LEFT JOIN documents d ON d.doc_id = i.k")
def tx33_section_text(spark, d):
    wanted = t(spark, d, "benchmark").select((F.col("item_id") * 37).alias("k"))
    return O.section_text(nodes(spark, d).withColumnRenamed("doc_id", "k"), wanted, "k", most=500)


@query("SELECT a.event_id, a.user_id FROM events a LEFT JOIN (SELECT user_id, max(event_id) AS m FROM events WHERE event_id % 3 = 0 GROUP BY 1) r ON a.user_id = r.user_id WHERE r.m IS NULL OR a.event_id > r.m")
def dt7_newer_than_recorded(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id")
    recorded = e.where("event_id % 3 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return O.newer_than_recorded(e, recorded, "user_id", "event_id").select("event_id", "user_id")
