"""Queries of the small relational rules that searches, shelves and sources are made of, each with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import similarity as S
from lectern.operators import changes as C
from lectern.operators import fusion as U
from lectern.operators import notes as O
from lectern.operators import quality as Q
from lectern.operators import structure as N
from lectern.operators import vectors as V
from lectern.plans import indexing as P
from lectern.plans.note_search import note_search
from lectern.queries import _BM25, _COS, _LEN, _LINES, _STATED, _STATES, _TOK, _WORDS, _bm, _cos, _states, _topk, index, item_vectors, nodes, query, t, vector_queries, vectors
from lectern.rule_queries import rule
from lectern.sources import files as R
from lectern.sources.folders import work_dir

# Signals -------------------------------------------------------------------------------------------------------


@query(f"WITH {_STATED}, c AS (SELECT item_id, doc_id // 2 AS node, score FROM cs JOIN embeddings ON doc_id = vec_id WHERE label < 3) SELECT item_id, node, max(score) AS score, count(*) AS chunks FROM c GROUP BY 1, 2")
def ag7_card_scores(spark, d):
    """A node's best card; cards are the vectors of three labels, two of them a node."""
    cards = vectors(spark, d).where("label < 3").select("doc_id", "vector")
    hits = V.cosine_scores(cards, vector_queries(spark, d), "doc_id", "item_id").withColumn("node", F.floor(F.col("doc_id") / 2))
    return V.pooled(hits, "item_id", "node")


@query(f"WITH {_BM25}, {_topk('bm', 50, name='b')} SELECT item_id AS stage, count(*) AS n, round(avg(score), 4) AS mean, round(min(score), 4) AS least, round(max(score), 4) AS most FROM b GROUP BY 1")
def ag13_score_statistics(spark, d):
    return Q.stage_statistics(_bm(spark, d).withColumnRenamed("item_id", "stage"), "stage", "score")


@query(f"WITH {_BM25}, {_COS}, {_topk('bm', 50, name='b')}, {_topk('cs', 50, name='c')} SELECT item_id, doc_id FROM b UNION SELECT item_id, doc_id FROM c")
def st1_candidates(spark, d):
    return _bm(spark, d).select("item_id", "doc_id").union(_cos(spark, d).select("item_id", "doc_id")).distinct()


@query(f"WITH {_BM25}, {_topk('bm', 50, name='b')} SELECT item_id, doc_id, score FROM b WHERE doc_id IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2'))")
def st2_in_scope(spark, d):
    return _bm(spark, d).join(nodes(spark, d).where("source in ('src1', 'src2')").select("doc_id"), "doc_id", "left_semi").select("item_id", "doc_id", "score")


@query(f"WITH {_TOK}, df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1) SELECT token, round(greatest(0, ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5))), 6) AS idf FROM df")
def ma4_clamped_idf(spark, d):
    found = index(spark, d)
    return found.terms.crossJoin(F.broadcast(found.statistics.select("total"))).select("token", F.round(S.clamped_idf(F.col("total"), F.col("df")), 6).alias("idf"))


@query(f"WITH {_BM25}, {_topk('bm', 10, name='b')} SELECT item_id, doc_id, round(0.5 * exp(-0.2 * (rank - 1)), 6) AS score FROM b")
def ma8_list_decay(spark, d):
    """A list alone, blended with no hits: half of what each place is worth."""
    listed = _bm(spark, d, 10).select("item_id", "doc_id", (F.col("rank") - 1).alias("position"))
    none = listed.limit(0).select("item_id", "doc_id", F.lit(0.0).alias("score"))
    return U.merged_tree_hits(none, listed, "item_id", "doc_id")


@query(f"WITH {_COS}, {_topk('cs', 50, name='c')}, k AS (SELECT item_id, doc_id, item_id % 4 AS asked, rank FROM c) SELECT asked, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) AS sources FROM k GROUP BY 1, 2")
def ag9_sub_queries(spark, d):
    """Ten queries are one question's sub-queries: a block's reciprocal ranks in each, added up."""
    r = U.ranked(_cos(spark, d).drop("rank"), "item_id", "doc_id").withColumn("asked", F.col("item_id") % 4)
    return r.groupBy("asked", "doc_id").agg(F.round(F.sum(S.reciprocal_rank(F.col("rank"))), 6).alias("score"), F.count("*").alias("sources"))


# Structure -----------------------------------------------------------------------------------------------------


@query(f"WITH {_LINES}, h AS (SELECT doc_id, line FROM ln WHERE line % 4 = 1), n AS (SELECT doc_id, count(*) AS lines FROM ln GROUP BY 1) SELECT doc_id, line, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line), lines)::BIGINT AS \"end\" FROM h JOIN n USING (doc_id)")
def wn4_section_ranges(spark, d):
    """Every fourth line is a heading."""
    rows = N.lines(nodes(spark, d), "doc_id")
    total = rows.groupBy("doc_id").agg(F.count("*").alias("lines"))
    return N.section_ranges(rows.where("line % 4 = 1").select("doc_id", "line"), "doc_id", total)


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS entries, min(line) AS first, max(line) AS last FROM ln WHERE length(text) BETWEEN 1 AND 80 GROUP BY 1")
def ag21_outline_coverage(spark, d):
    rows = N.lines(nodes(spark, d), "doc_id").where(F.length("text").between(1, 80))
    return rows.groupBy("doc_id").agg(F.count("*").alias("entries"), F.min("line").alias("first"), F.max("line").alias("last"))


# Shelves -------------------------------------------------------------------------------------------------------


@query(f"WITH {_STATES} SELECT a.k, CASE WHEN b.k IS NULL THEN 'new' WHEN a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p THEN 'changed' ELSE 'unchanged' END AS change FROM a LEFT JOIN b ON a.k = b.k")
def jn16_three_classes(spark, d):
    now, then = _states(spark, d)
    return C.change_classes(now, then, "k", ["s", "p"]).where("change <> 'deleted'")


@query("""WITH r AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 4 = 0), i AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0), m AS (SELECT c_custkey AS id, c_custkey + 1 AS book FROM customer WHERE c_custkey % 3 = 2)
 SELECT id, id AS book FROM r WHERE id IN (SELECT id FROM i) UNION ALL SELECT r.id, book FROM r JOIN m USING (id) WHERE book IN (SELECT id FROM i) AND r.id NOT IN (SELECT id FROM i)""")
def jn23_resolved_ids(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    asked = t(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("id")).distinct()
    return O.resolved_ids(asked, c.where("id % 3 = 0"), c.where("id % 3 = 2").select("id", (F.col("id") + 1).alias("book")), "id")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 8 = 0) AS archived FROM customer")
def jn31_archived(spark, d):
    c = t(spark, d, "customer").select("c_custkey")
    gone = t(spark, d, "orders").where("o_orderkey % 8 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(gone, "c_custkey", "left_semi").withColumn("archived", F.lit(True)).unionByName(c.join(gone, "c_custkey", "left_anti").withColumn("archived", F.lit(False)))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 10 <> 0 UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 10 <> 0")
def st12_excluded_books(spark, d):
    """The excluded books after every seventh was excluded and every tenth taken back."""
    k = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    more = C.upsert(k.where("k % 6 = 0"), k.where("k % 7 = 0"), "k")
    return more.join(k.where("k % 10 = 0"), "k", "left_anti")


@query("""SELECT conv_id, max(length(text)) AS longest, arg_max(turn, (length(text), -turn)) AS turn FROM conversations GROUP BY 1 HAVING count(*) > 1""")
def ag39_longest_message(spark, d):
    c = t(spark, d, "conversations")
    g = c.groupBy("conv_id").agg(F.max(F.length("text")).cast("long").alias("longest"), F.max_by("turn", F.struct(F.length("text"), -F.col("turn"))).alias("turn"), F.count("*").alias("n"))
    return g.where("n > 1").drop("n")


# Sources -------------------------------------------------------------------------------------------------------

_PATHS = ["notes/{p_name}/a.md", "notes/.trash/{p_name}.md", "Templates/{p_name}.md", "deep/Templates/{p_partkey}/x.md", "draft-{p_size}.md", "notes/draft-{p_size}.md", "{p_brand}/Templates2/x.md"]
rule("fp4_excluded_folder", _PATHS, lambda c: R.path_matches(c, "**/Templates/**"), "list_contains(string_split(s, '/'), 'Templates')")
rule("sc2_excluded_glob", _PATHS, lambda c: R.path_matches(c, "draft-*.md"), "regexp_matches(s, '^draft-[^/]*\\.md$')")
rule("sc3_directory_of", _PATHS, lambda c: R.directory_of(c, ["notes", "deep/Templates"]), "CASE WHEN regexp_extract(s, '^(.*)/[^/]*$', 1) = 'notes' OR starts_with(s, 'notes/') THEN 'notes' WHEN starts_with(s, 'deep/Templates/') THEN 'deep/Templates' ELSE regexp_extract(s, '^(.*)/[^/]*$', 1) END")
rule("sc4_derived_files", ["---\ntitle: {p_name}\ntype: pdf\n---\nx", "---\ntype: epub\nindexed: true\n---\n{p_name}", "---\ntype: note\n---\n", "type: pdf\n{p_name}", "---\r\ntype: epub  \r\n---\r\n{p_type}"], R.is_derived,
     "regexp_matches(regexp_extract(s, '(?s)\\A---\\r?\\n(.*?)\\r?\\n---', 1), '(?m)^type:\\s*(pdf|epub)\\s*$') AND NOT regexp_matches(regexp_extract(s, '(?s)\\A---\\r?\\n(.*?)\\r?\\n---', 1), '(?m)^indexed:\\s*true\\s*$')")


@query("SELECT vec_id::VARCHAR AS \"chunkId\", 'L' || (vec_id % 3)::VARCHAR AS level, len(embedding)::BIGINT AS dimension FROM embeddings WHERE vec_id % 9 <> 0")
def sc5_vector_lines(spark, d):
    """All vectors as JSON lines, every ninth cut off in the middle; corrupt lines are passed over."""
    path, i = f"{work_dir(spark)}/vectors-{uuid.uuid4().hex}", F.col("doc_id")
    line = F.to_json(F.struct(i.cast("string").alias("chunkId"), F.concat(F.lit("L"), (i % 3).cast("string")).alias("level"), "vector"))
    vectors(spark, d).select(F.when(i % 9 == 0, F.left(line, F.lit(40))).otherwise(line).alias("value")).write.text(path)
    return R.json_lines(spark, path, R.VECTOR).select("chunkId", "level", F.size("vector").cast("long").alias("dimension"))


# Notes ---------------------------------------------------------------------------------------------------------


def _asked_notes(spark, d):
    """Queries of 3 to 42 characters; those of even items look into two folders."""
    i = F.col("item_id")
    return t(spark, d, "benchmark").select("item_id", F.left("text", (i % 40 + 3).cast("int")).alias("text"), F.when(i % 2 == 0, "some").alias("scope"))


def _note_tree(spark, d):
    i = F.col("doc_id")
    return nodes(spark, d).select("doc_id", F.concat("source", F.lit("/"), i.cast("string"), F.lit(".md")).alias("file"), (i % 5).alias("depth"), (i % 4).alias("descendants"))


_NOTE = f"""qs AS (SELECT item_id, left(text, (3 + item_id % 40)::INT) AS text FROM benchmark), dep AS (SELECT item_id, CASE WHEN length(text) < 5 THEN 50 WHEN length(text) < 15 THEN 30 ELSE 10 END AS k FROM qs),
 te AS (SELECT DISTINCT item_id, unnest({_WORDS.format('text')}) AS token FROM qs), po AS (SELECT DISTINCT doc_id, unnest({_WORDS.format('text')}) AS token FROM documents), hi AS (SELECT item_id, doc_id, count(*) AS n FROM te JOIN po USING (token) GROUP BY 1, 2),
 kw AS (SELECT item_id, doc_id, round(n / max(n) OVER (PARTITION BY item_id), 6) AS score FROM hi), kr AS (SELECT item_id, doc_id, score FROM kw JOIN dep USING (item_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= any_value(k) OVER (PARTITION BY item_id))"""
_LEVEL = "CASE WHEN d.doc_id IS NULL THEN 0.5 WHEN d.doc_id % 5 = 0 AND d.doc_id % 4 > 2 THEN 1.0 WHEN d.doc_id % 5 = 0 THEN 0.8 WHEN d.doc_id % 5 = 1 THEN 0.7 WHEN d.doc_id % 5 = 2 THEN 0.5 ELSE 0.3 END"


@query(f"""WITH {_COS}, {_NOTE}, vr AS (SELECT item_id, doc_id, score FROM cs JOIN dep USING (item_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= any_value(k) OVER (PARTITION BY item_id)), vp AS (SELECT item_id, doc_id // 2 AS doc_id, greatest(max(score), 0) AS score FROM vr GROUP BY 1, 2),
 m AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.score, 0) AS vector, coalesce(a.score, 0) AS keyword FROM kr a FULL JOIN vp b ON a.item_id = b.item_id AND a.doc_id = b.doc_id),
 s AS (SELECT m.*, ({_LEVEL})::DOUBLE AS level, round((vector * 0.7 + keyword * 0.3) * ({_LEVEL})::DOUBLE, 6) AS score FROM m LEFT JOIN documents d USING (doc_id) WHERE item_id % 2 = 1 OR coalesce(starts_with(source, 'src1') OR starts_with(source, 'src3'), false)), {_topk('s', 10)}
 SELECT item_id, doc_id, vector, keyword, level, score, rank FROM r""")
def rt7_note_search(spark, d):
    chunks = vectors(spark, d).select(F.col("doc_id").alias("block"), F.floor(F.col("doc_id") / 2).alias("doc_id"), "vector")
    return note_search(nodes(spark, d), _asked_notes(spark, d), _note_tree(spark, d), "doc_id", "item_id", chunks, item_vectors(spark, d), {"some": ["src1", "src3"]})


@query(f"""WITH {_NOTE}, s AS (SELECT kr.item_id, kr.doc_id, 0.0::DOUBLE AS vector, kr.score AS keyword, ({_LEVEL})::DOUBLE AS level, round(kr.score * ({_LEVEL})::DOUBLE, 6) AS score FROM kr LEFT JOIN documents d USING (doc_id)), {_topk('s', 10)} SELECT item_id, doc_id, vector, keyword, level, score, rank FROM r""")
def rt7_keywords_alone(spark, d):
    """Without vectors the keywords have all the weight."""
    return note_search(nodes(spark, d), _asked_notes(spark, d).drop("scope"), _note_tree(spark, d), "doc_id", "item_id")


_CLAIMED = f"""cl AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'zq' || item_id::VARCHAR || 'x' ELSE string_split(text, ' ')[3] END AS text FROM benchmark), ct AS (SELECT DISTINCT item_id, unnest({_WORDS.format('text')}) AS token FROM cl)"""


@query(f"""WITH {_TOK}, {_LEN}, {_CLAIMED}, bm AS (SELECT item_id, doc_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM ct JOIN tf USING (token) JOIN df USING (token) JOIN len USING (doc_id) CROSS JOIN st GROUP BY 1, 2)
 SELECT item_id, coalesce(max(score), 0) >= 3 AS contradicted FROM cl LEFT JOIN bm USING (item_id) GROUP BY 1""")
def rt14_contradicted_claims(spark, d):
    """Claims that one word stands nowhere, a third of them true, against the whole stored index."""
    claim = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("zq"), F.col("item_id").cast("string"), F.lit("x"))).otherwise(F.get(F.split("text", " "), F.lit(2)))
    claims = t(spark, d, "benchmark").select("item_id", claim.alias("text"))
    return P.claims_contradicted(claims, index(spark, d), "item_id", "doc_id", 3.0)
