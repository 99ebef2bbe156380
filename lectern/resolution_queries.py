"""Queries of structure resolution, best blocks and reorganisation, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import best_blocks as K
from lectern.operators import reorganise as R
from lectern.operators import structure as N
from lectern.plans import structure_resolution as P
from lectern.queries import _LINES, asked, nodes, query, t

#: A text's lines are pages; every third one is named by the contents, by its first twelve characters. The first reading
#: is a page off in a third of the books and at every fifth item in the others, the second at every fourth.
_READ = f"""{_LINES}, pg AS (SELECT doc_id, line + 1 AS page, text FROM ln), last AS (SELECT doc_id, max(page) AS n FROM pg GROUP BY 1), ti AS (SELECT doc_id, page, page // 3 AS place, left(text, 12) AS title FROM pg WHERE page % 3 = 1 AND length(text) > 0),
 it AS (SELECT doc_id, 0 AS strategy, place, title, page + CASE WHEN doc_id % 3 = 0 OR place % 5 = 4 THEN 1 ELSE 0 END AS physical FROM ti UNION ALL SELECT doc_id, 1, place, title, page + CASE WHEN place % 4 = 3 THEN 2 WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END FROM ti)"""
_PLAIN = "regexp_replace(lower({0}), '\\s+', '', 'g')"
_ON = f"({_PLAIN.format('i.title')} <> '' AND contains({_PLAIN.format('p.text')}, {_PLAIN.format('i.title')}))"


@query(f"""WITH {_READ}, ck AS (SELECT i.*, last.n, coalesce({_ON}, false) AS ok FROM it i JOIN last USING (doc_id) LEFT JOIN pg p ON p.doc_id = i.doc_id AND p.page = i.physical WHERE physical BETWEEN 1 AND last.n),
 ch AS (SELECT doc_id, min(strategy) AS strategy FROM (SELECT doc_id, strategy FROM ck GROUP BY ALL HAVING avg(ok::INT) >= 0.6) GROUP BY 1), k AS (SELECT ck.* FROM ck JOIN ch USING (doc_id, strategy)),
 w AS (SELECT *, coalesce(last_value(CASE WHEN ok THEN physical END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS low, coalesce(first_value(CASE WHEN ok THEN physical END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS high FROM k),
 m AS (SELECT i.doc_id, i.place, min(p.page) AS goes FROM w i JOIN pg p ON p.doc_id = i.doc_id AND p.page BETWEEN low AND high WHERE NOT ok AND {_ON} GROUP BY 1, 2)
 SELECT w.doc_id, strategy, w.place, title, coalesce(goes, physical) AS page, CASE WHEN ok THEN 'right' WHEN goes IS NOT NULL THEN 'mended' ELSE 'wrong' END AS state FROM w LEFT JOIN m ON m.doc_id = w.doc_id AND m.place = w.place""")
def rt22_resolved_structure(spark, d):
    pages = N.lines(nodes(spark, d), "doc_id").select("doc_id", (F.col("line") + 1).alias("page"), "text")
    i, p = F.col("doc_id"), F.col("place")
    titles = pages.where((F.col("page") % 3 == 1) & (F.length("text") > 0)).select("doc_id", "page", F.floor(F.col("page") / 3).alias("place"), F.left("text", F.lit(12)).alias("title"))
    read = lambda n, off: titles.select("doc_id", F.lit(n).alias("strategy"), "place", "title", (F.col("page") + off).alias("physical"))
    items = read(0, F.when((i % 3 == 0) | (p % 5 == 4), 1).otherwise(0)).unionByName(read(1, F.when(p % 4 == 3, 2).when(i % 9 == 0, 1).otherwise(0)))
    return P.resolved(items, pages, "doc_id")


_PAIRS = "list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"


@query(f"""WITH {_LINES}, b AS (SELECT doc_id * 1000000 + line AS block, regexp_replace(left(text, 120), '\\s+', '', 'g') AS t FROM ln), c AS (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM benchmark),
 bg AS (SELECT block, unnest({_PAIRS.format('t')}) AS g, length(t) - 1 AS n FROM b WHERE length(t) >= 2), cg AS (SELECT DISTINCT item_id, unnest({_PAIRS.format('t')}) AS g FROM c WHERE length(t) >= 2), s AS (SELECT item_id, block, count(*) / any_value(n) AS score FROM bg JOIN cg USING (g) GROUP BY 1, 2)
 SELECT item_id, arg_min(block, (-score, block)) AS block, round(max(score), 6) AS score FROM s GROUP BY 1""")
def jn30_best_block(spark, d):
    """The line of all documents, up to 120 characters of it, that each benchmark text is most like."""
    lines = N.lines(nodes(spark, d), "doc_id").select((F.col("doc_id") * 1_000_000 + F.col("line")).alias("block"), F.left("text", F.lit(120)).alias("excerpt"))
    return K.best_blocks(asked(spark, d), lines, "item_id", "text", "block", "block", "excerpt")


#: Notes of 25 directories, of which ten are no timelines; every text links its own note in three forms.
_NOTED = """n AS (SELECT o_orderkey AS k, 'd' || (o_orderkey % 25)::VARCHAR AS dir, CASE WHEN o_orderkey % 25 < 10 AND o_orderkey % 3 > 0 THEN 'note-' ELSE '' END || strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey::VARCHAR AS name, strftime(o_orderdate, '%Y/%m') AS ym FROM orders),
 x AS (SELECT *, dir || '/' || name AS old, 'see [[' || dir || '/' || name || '#^p1|' || name || ']] and [[' || dir || '/' || name || ']] not [[' || dir || '/' || name || '0]] [x] [[other|' || dir || ']]' AS text FROM n),
 g AS (SELECT dir FROM n GROUP BY 1 HAVING count(*) > 30 AND avg((NOT starts_with(name, 'note-'))::INT) > 0.6), m AS (SELECT k, old, dir || '/' || ym || '/' || name AS new FROM x WHERE dir IN (SELECT dir FROM g) AND NOT starts_with(name, 'note-'))"""


def _notes(spark, d):
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    name = F.concat(F.when((k % 25 < 10) & (k % 3 > 0), "note-").otherwise(""), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), k.cast("string"))
    return o.select(k.alias("k"), F.concat(F.lit("d"), (k % 25).cast("string"), F.lit("/"), name).alias("old"), name.alias("name"), F.concat(F.lit("d"), (k % 25).cast("string")).alias("dir"))


@query(f"WITH {_NOTED} SELECT old, new FROM m")
def rt21_planned_moves(spark, d):
    return R.planned_moves(_notes(spark, d).select(F.concat("old", F.lit(".md")).alias("path"))).select("old", "new")


@query(f"WITH {_NOTED} SELECT k, replace(replace(text, '[[' || m.old || '#', '[[' || new || '#'), '[[' || m.old || ']]', '[[' || new || ']]') AS text, 2::BIGINT AS links FROM x JOIN m USING (k)")
def tx29_links_after_moves(spark, d):
    notes = _notes(spark, d)
    link = lambda *more: F.concat(F.lit("[["), F.col("old"), *[F.lit(m) if isinstance(m, str) else m for m in more], F.lit("]]"))
    texts = notes.select("k", F.concat(F.lit("see "), link("#^p1|", F.col("name")), F.lit(" and "), link(), F.lit(" not "), link("0"), F.lit(" [x] [[other|"), "dir", F.lit("]]")).alias("text"))
    moves = R.planned_moves(notes.select(F.concat("old", F.lit(".md")).alias("path")))
    return R.moved_texts(texts, moves, "k")
