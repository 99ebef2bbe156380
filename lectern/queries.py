"""Registry of the library's queries, each with SQL that gives the same rows.

Tables stand for the library's entities: documents are section nodes (source = book), embeddings are vectors,
benchmark texts are queries and cards, labels.quality is relevance, conversations are chat logs, events are
traces, orders are two states of a shelf.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import similarity as S
from lectern.functions import text as X
from lectern.operators import changes as C
from lectern.operators import fusion as U
from lectern.operators import lexical as L
from lectern.operators import quality as Q
from lectern.operators import sessions as M
from lectern.operators import structure as N
from lectern.operators import vectors as V
from lectern.plans.book_search import book_search
from lectern.sources.folders import work_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt out where it has fewer parts than there are cores: a small file of one row group is one task's work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return dealt(t(spark, d, "documents").select("doc_id", "text", "source"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").select("item_id", "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return vectors(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("item_id"), "vector")


def item_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector for each query text: the one of its number."""
    return vectors(spark, d).select(F.col("doc_id").alias("item_id"), "vector").join(asked(spark, d).select("item_id"), "item_id", "left_semi")


_STORED: dict[tuple, str] = {}


def state_of(spark: SparkSession, d: str, name: str) -> tuple:
    """The files of a table with their sizes and times, a row a file: another table, or the same one written anew, differs."""
    files = spark.read.format("binaryFile").load(f"{d}/{name}.parquet").select("path", "length", "modificationTime")
    return tuple(sorted((r[0], r[1], str(r[2])) for r in files.collect()))


def index(spark: SparkSession, d: str) -> L.Index:
    """The lexical index of the documents, built once a session and state of the table, then read."""
    at = (spark.sparkContext.applicationId, state_of(spark, d, "documents"))
    if at not in _STORED:
        path = f"{work_dir(spark)}/lexical-{uuid.uuid4().hex}"
        L.write_index(nodes(spark, d), "doc_id", path)
        _STORED[at] = path
    return L.read_index(spark, _STORED[at])


_WORDS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> '')"
_TOK = f"tok AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS token FROM documents), tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL)"
_LEN = f"len AS (SELECT doc_id, len({_WORDS.format('text')})::BIGINT AS length FROM documents), st AS (SELECT count(*) AS total, avg(length) AS mean FROM len), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1)"
_TERMS = f"terms AS (SELECT DISTINCT item_id, unnest({_WORDS.format('text')}) AS token FROM benchmark)"
_BM25 = f"""{_TOK}, {_LEN}, {_TERMS}, bm AS (SELECT item_id, doc_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score
 FROM terms JOIN tf USING (token) JOIN df USING (token) JOIN len USING (doc_id) CROSS JOIN st GROUP BY 1, 2)"""
_COS_OF = """q AS (SELECT vec_id AS item_id, embedding AS qv FROM embeddings WHERE {0}),
 cs AS (SELECT item_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS score FROM embeddings CROSS JOIN q)"""
_STATED, _COS = _COS_OF.format("vec_id % 50 = 0"), _COS_OF.format("vec_id IN (SELECT item_id FROM benchmark)")


def _topk(src: str, k: int, by: str = "item_id", key: str = "doc_id", name: str = "r") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {key}) AS rank FROM {src} QUALIFY rank <= {k})"


@query(f"WITH {_TOK} SELECT token, count(*) AS df FROM tf GROUP BY 1")
def ag2_document_frequency(spark, d):
    return L.document_frequency(L.postings(nodes(spark, d), "doc_id"))


@query(f"WITH {_TOK} SELECT doc_id, token, tf FROM tf")
def ag1_term_frequency(spark, d):
    return L.postings(nodes(spark, d), "doc_id")


@query(f"WITH {_TOK}, {_LEN} SELECT total, round(mean, 6) AS mean FROM st")
def ag3_length_statistics(spark, d):
    return L.statistics(L.lengths(nodes(spark, d), "doc_id")).select("total", F.round("mean", 6).alias("mean"))


@query(f"WITH {_BM25}, {_topk('bm', 10)} SELECT item_id, doc_id, score, rank FROM r")
def rt2_bm25_search(spark, d):
    return L.bm25_search(index(spark, d), asked(spark, d), "doc_id", "item_id")


@query(f"""WITH terms AS (SELECT DISTINCT item_id, unnest({_WORDS.format('text')}) AS token FROM benchmark), post AS (SELECT DISTINCT doc_id, unnest({_WORDS.format('text')}) AS token FROM documents),
 h AS (SELECT item_id, doc_id, count(*) AS hits FROM terms JOIN post USING (token) GROUP BY 1, 2) SELECT item_id, doc_id, hits, round(hits / max(hits) OVER (PARTITION BY item_id), 6) AS score FROM h""")
def ag5_keyword_scores(spark, d):
    return L.keyword_scores(nodes(spark, d), asked(spark, d), "doc_id", "item_id")


@query(f"""WITH {_TOK}, {_TERMS}, df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS total FROM documents),
 v AS (SELECT item_id, sum(CASE WHEN df IS NOT NULL THEN greatest(0, ln((total - df + 0.5) / (df + 0.5))) * 2.5 END) AS v FROM terms LEFT JOIN df USING (token) CROSS JOIN n GROUP BY 1)
 SELECT item_id, round(CASE WHEN v > 0 THEN v ELSE 10.0 END, 6) AS max_score FROM v""")
def ag40_theoretical_maximum(spark, d):
    return L.theoretical_maximum(index(spark, d), asked(spark, d), "item_id")


@query(f"""WITH {_TERMS}, a AS (SELECT doc_id AS item_id, lower(text) AS answer FROM documents), n AS (SELECT item_id, count(*) AS n FROM terms GROUP BY 1)
 SELECT item_id, round(sum(contains(answer, token)::INT) / max(n), 6) AS coverage FROM terms JOIN a USING (item_id) JOIN n USING (item_id) GROUP BY 1""")
def ag43_keyword_coverage(spark, d):
    return L.keyword_coverage(nodes(spark, d).select(F.col("doc_id").alias("item_id"), "text"), asked(spark, d), "item_id")


@query(f"WITH {_STATED}, {_topk('cs', 10)} SELECT item_id, doc_id, score, rank FROM r")
def tk2_cosine_search(spark, d):
    return V.cosine_search(vectors(spark, d), vector_queries(spark, d), "doc_id", "item_id")


@query(f"WITH {_STATED}, p AS (SELECT item_id, label, max(score) AS score, count(*) AS chunks FROM cs JOIN embeddings ON doc_id = vec_id GROUP BY 1, 2) SELECT item_id, label, score, chunks FROM p")
def ag6_chunk_pooling(spark, d):
    return V.pooled_scores(vectors(spark, d), vector_queries(spark, d), "label", "item_id")


@query(f"""WITH {_STATED}, h AS (SELECT item_id, doc_id, score, CASE WHEN label < 3 THEN 'L2' ELSE 'L1' END AS level FROM cs JOIN embeddings ON doc_id = vec_id WHERE score > 0.2),
 m AS (SELECT *, max((level = 'L2')::INT) OVER (PARTITION BY item_id) AS s FROM h) SELECT item_id, doc_id, score, level FROM m WHERE level = 'L2' OR s = 0""")
def tk4_level_fallback(spark, d):
    level = F.when(F.col("label") < 3, "L2").otherwise("L1")
    return V.level_fallback(vectors(spark, d).withColumn("level", level), vector_queries(spark, d), "doc_id", "item_id", 0.2)


def _bm(spark, d, k=50):
    return L.bm25_search(index(spark, d), asked(spark, d), "doc_id", "item_id", k)


def _cos(spark, d, k=50):
    return V.cosine_search(vectors(spark, d), item_vectors(spark, d), "doc_id", "item_id", k)


_TWO = f"{_BM25}, {_COS}, {_topk('bm', 50, name='b')}, {_topk('cs', 50, name='c')}"
_RRF = f"{_TWO}, f AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) AS signals FROM (SELECT item_id, doc_id, rank FROM b UNION ALL SELECT item_id, doc_id, rank FROM c) GROUP BY 1, 2)"


@query(f"WITH {_RRF} SELECT item_id, doc_id, score, signals FROM f")
def ag8_reciprocal_rank_fusion(spark, d):
    return U.reciprocal_rank_fusion({"bm25": _bm(spark, d), "vector": _cos(spark, d)}, "item_id", "doc_id")


@query(f"""WITH {_TWO}, w AS (SELECT coalesce(b.item_id, c.item_id) AS item_id, coalesce(b.doc_id, c.doc_id) AS doc_id, round((0.7 * coalesce(b.score, 0) + 0.3 * coalesce(c.score, 0)), 6) AS score
 FROM b FULL JOIN c ON b.item_id = c.item_id AND b.doc_id = c.doc_id), {_topk('w', 10)} SELECT item_id, doc_id, score, rank FROM r""")
def rt9_weighted_fusion(spark, d):
    return L.top(U.weighted_fusion(_bm(spark, d), _cos(spark, d), "item_id", "doc_id"), "item_id", "doc_id", 10)


@query(f"""WITH {_RRF}, s AS (SELECT f.*, coalesce(source IN ('src1', 'src2') AND item_id % 2 = 0, false) AS inn FROM f LEFT JOIN documents USING (doc_id)), m AS (SELECT *, max(inn::INT) OVER (PARTITION BY item_id) AS a FROM s),
 x AS (SELECT item_id, doc_id, score FROM m WHERE inn OR a = 0), {_topk('x', 10)} SELECT item_id, doc_id, score, rank FROM r""")
def fp2_scope_fallback(spark, d):
    fused = U.reciprocal_rank_fusion({"bm25": _bm(spark, d), "vector": _cos(spark, d)}, "item_id", "doc_id")
    where = fused.join(nodes(spark, d).where("source in ('src1', 'src2')").select("doc_id"), "doc_id", "left_semi").where("item_id % 2 = 0")
    return L.top(U.in_scope_or_all(fused, where, "item_id", "doc_id").select("item_id", "doc_id", "score"), "item_id", "doc_id", 10)


_RT5 = f"""WITH {_BM25}, {_COS}, scope AS (SELECT item_id, doc_id FROM documents CROSS JOIN benchmark WHERE source IN ('src1', 'src2') AND item_id % 2 = 0),
 dep AS (SELECT item_id, CASE WHEN length(text) < 5 THEN 50 WHEN length(text) <= 15 THEN 30 ELSE 15 END * CASE WHEN item_id % 2 = 0 THEN 5 ELSE 1 END AS k FROM benchmark),
 b AS (SELECT item_id, doc_id, score FROM bm JOIN dep USING (item_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= k),
 ch AS (SELECT item_id, cs.doc_id AS block, cs.doc_id // 2 AS doc_id, score FROM cs JOIN embeddings e ON cs.doc_id = e.vec_id JOIN dep USING (item_id) WHERE {{0}} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, cs.doc_id) <= {{1}} * k),
 v AS (SELECT item_id, doc_id, max(score) AS score FROM ch GROUP BY 1, 2),
 ca AS (SELECT item_id, cs.doc_id, score FROM cs JOIN embeddings e ON cs.doc_id = e.vec_id JOIN dep USING (item_id) WHERE label < 3 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, cs.doc_id) <= k),
 c AS (SELECT item_id, doc_id, max(score) AS score FROM ca WHERE score > 0.3 GROUP BY 1, 2),
 r AS (SELECT 's' AS s, * FROM b UNION ALL SELECT 'v', * FROM v UNION ALL SELECT 'c', * FROM c), p AS (SELECT *, 1.0 / (60 + row_number() OVER (PARTITION BY s, item_id ORDER BY score DESC, doc_id)) AS part FROM r),
 f AS (SELECT item_id, doc_id, sum(part) AS rrf, coalesce(max(CASE WHEN s = 's' THEN score END), 0) AS bm25, coalesce(max(CASE WHEN s = 'v' THEN score END), 0) AS vector, coalesce(max(CASE WHEN s = 'c' THEN score END), 0) AS card FROM p GROUP BY 1, 2 HAVING max((s <> 'c')::INT) = 1),
 m AS (SELECT f.*, max((scope.doc_id IS NOT NULL)::INT) OVER (PARTITION BY f.item_id) AS anyin, scope.doc_id IS NOT NULL AS inn FROM f LEFT JOIN scope ON f.item_id = scope.item_id AND f.doc_id = scope.doc_id),
 w AS (SELECT *, CASE WHEN doc_id NOT IN (SELECT doc_id FROM documents) THEN 0.5 WHEN doc_id % 7 = 0 THEN 1.0 WHEN doc_id % 3 = 0 THEN 0.9 ELSE 0.7 END AS level FROM m WHERE inn OR anyin = 0), x AS (SELECT *, round(rrf * level, 9) AS s0 FROM w),
 y AS (SELECT item_id, doc_id, bm25, vector, card, level, round(CASE WHEN row_number() OVER (PARTITION BY item_id ORDER BY s0 DESC, doc_id) <= 20 THEN 0.5 * (doc_id % 100 / 100.0) + 0.5 * s0 ELSE s0 END, 9) AS score FROM x), {_topk('y', 5, name='z')},
 bl AS (SELECT item_id, doc_id, block, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, block) AS p FROM ch WHERE {{1}} = 3), bs AS (SELECT item_id, doc_id, string_agg(block::VARCHAR, ',' ORDER BY p) AS blocks FROM bl WHERE p <= 3 GROUP BY 1, 2)
 SELECT item_id, doc_id, round(score, 7) AS score, bm25, vector, card, level::DOUBLE AS level, rank, blocks FROM z LEFT JOIN bs USING (item_id, doc_id)"""


def _hybrid(spark, d, level):
    e = vectors(spark, d)
    chunks = e.select(F.col("doc_id").alias("block"), F.floor(F.col("doc_id") / 2).alias("doc_id"), "vector", level.alias("level"))
    cards = e.where("label < 3").select(F.col("doc_id").alias("card"), "doc_id", "vector")
    tree = nodes(spark, d).select("doc_id", F.when(F.col("doc_id") % 7 == 0, 0).otherwise(1).alias("depth"), (F.col("doc_id") % 3 == 0).alias("has_children"))
    scope = nodes(spark, d).where("source in ('src1', 'src2')").select("doc_id").crossJoin(F.broadcast(asked(spark, d).where("item_id % 2 = 0").select("item_id")))
    found = book_search(index(spark, d), asked(spark, d), tree, "doc_id", "item_id", chunks, item_vectors(spark, d), cards, scope, F.col("doc_id") % 100 / 100.0)
    return found.withColumn("score", F.round("score", 7))


@query(_RT5.replace("{0}", "label <> 9").replace("{1}", "3"))
def rt5_hybrid_search(spark, d):
    """All eight stages: even items have a scope, cards are the vectors of three labels, chunks of label 9 are of another
    level, levels and re-ranking by id."""
    return _hybrid(spark, d, F.when(F.col("label") == 9, "L1").otherwise("L2"))


@query(_RT5.replace("{0}", "true").replace("{1}", "1"))
def rt5_without_chunks(spark, d):
    """An index of the older form: no L2 chunks, so L1 stands in, as deep as the other signals and without blocks."""
    return _hybrid(spark, d, F.lit("L1"))


@query(f"""WITH {_BM25}, {_topk('bm', 20, name='b')}, k AS (SELECT item_id % 5 AS grp, item_id, doc_id, score FROM b), g AS (SELECT grp, doc_id, max(score) AS best, count(DISTINCT item_id) AS hits FROM k GROUP BY 1, 2)
 SELECT grp, doc_id, best, hits, round(best + 0.1 * hits + CASE WHEN doc_id % 10 = 0 THEN 0.2 ELSE 0 END, 6) AS score FROM g""")
def rt11_keyword_fusion(spark, d):
    hits = _bm(spark, d, 20).withColumn("grp", F.col("item_id") % 5)
    return U.multi_keyword_fusion(hits, "grp", "item_id", "doc_id", F.col("doc_id") % 10 == 0)


@query(f"""WITH {_BM25}, {_topk('bm', 10, name='b')} SELECT item_id, doc_id, round(CASE WHEN doc_id % 3 = 0 THEN 0.5 * (doc_id % 100 / 100.0) + 0.5 * score ELSE score END, 7) AS score FROM b""")
def ma9_rerank_blend(spark, d):
    hits = _bm(spark, d, 10).select("item_id", "doc_id", "score")
    rerank = hits.where("doc_id % 3 = 0").select("item_id", "doc_id", (F.col("doc_id") % 100 / 100.0).alias("rerank"))
    return U.blended(hits, rerank, "item_id", "doc_id", digits=7)


@query(f"""WITH {_BM25}, {_topk('bm', 10, name='b')}, l AS (SELECT item_id, doc_id, rank - 1 AS position FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score, doc_id) AS rank FROM bm QUALIFY rank <= 10) WHERE item_id % 3 > 0),
 j AS (SELECT coalesce(b.item_id, l.item_id) AS item_id, coalesce(b.doc_id, l.doc_id) AS doc_id, b.score, exp(-0.2 * position) AS t FROM b FULL JOIN l ON b.item_id = l.item_id AND b.doc_id = l.doc_id)
 SELECT item_id, doc_id, round(CASE WHEN max(t) OVER (PARTITION BY item_id) IS NULL THEN score ELSE 0.5 * coalesce(score, 0) + 0.5 * coalesce(t, 0) END, 6) AS score FROM j""")
def jn9_tree_hits(spark, d):
    """Hits of all items, blended with a list for two thirds of them: their ten weakest nodes."""
    scores = L.bm25_scores(index(spark, d), asked(spark, d), "doc_id", "item_id")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("score", "doc_id"))
    listed = scores.where("item_id % 3 > 0").withColumn("position", place - 1).where("position < 10")
    return U.merged_tree_hits(L.top(scores, "item_id", "doc_id", 10), listed, "item_id", "doc_id")


@query(f"""WITH {_BM25}, {_topk('bm', 20, name='b')}, h AS (SELECT b.*, source, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS p FROM b JOIN documents USING (doc_id))
 SELECT item_id, source, max(score) AS score, count(*) AS sources, string_agg(CASE WHEN p <= 3 THEN doc_id::VARCHAR END, ',' ORDER BY p) AS blocks FROM h GROUP BY 1, 2""")
def ag10_block_rollup(spark, d):
    hits = _bm(spark, d, 20).join(nodes(spark, d).select("doc_id", "source"), "doc_id")
    return U.block_to_node(hits, "item_id", "source", "doc_id")


@query(f"WITH {_BM25}, {_topk('bm', 3, name='b')} SELECT item_id, round(sum(score * CASE rank WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.1 END), 6) AS gate, round(sum(score * CASE rank WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.1 END), 6) >= 0.6 AS stop FROM b GROUP BY 1")
def ag41_early_stop(spark, d):
    return U.early_stop(_bm(spark, d, 10).drop("rank"), "item_id", "doc_id")


@query(f"""WITH {_BM25}, {_topk('bm', 50, name='b')}, h AS (SELECT item_id, doc_id, score, source, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS place FROM b JOIN documents USING (doc_id) QUALIFY place <= 5),
 g AS (SELECT item_id, source, round(sum(score), 6) AS total FROM h GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY total DESC, source) AS book_rank FROM g QUALIFY book_rank <= 5)
 SELECT item_id, source, doc_id, score, place, total, book_rank FROM h JOIN k USING (item_id, source)""")
def rt12_cross_book_search(spark, d):
    hits = _bm(spark, d).drop("rank").join(nodes(spark, d).select("doc_id", "source"), "doc_id")
    return U.books_then_hits(hits, "item_id", "source", "doc_id")


@query(f"""WITH {_BM25}, {_topk('bm', 10, name='b')}, rel AS (SELECT item_id, doc_id FROM benchmark CROSS JOIN labels WHERE quality = 1 AND (doc_id + item_id) % 3 = 0), n AS (SELECT item_id, count(*) AS n FROM rel GROUP BY 1),
 j AS (SELECT b.item_id, b.rank, (rel.doc_id IS NOT NULL)::INT AS r FROM b LEFT JOIN rel ON rel.item_id = b.item_id AND rel.doc_id = b.doc_id),
 m AS (SELECT item_id, min(CASE WHEN r = 1 THEN rank END) AS f, sum(CASE WHEN rank <= 5 THEN r / log2(rank + 1) ELSE 0 END) AS dcg FROM j GROUP BY 1)
 SELECT item_id, round(coalesce(1.0 / f, 0), 6) AS mrr, coalesce((f <= 5)::INT, 0) AS hit5, coalesce((f <= 10)::INT, 0) AS hit10,
 round(CASE WHEN coalesce(n, 0) > 0 THEN dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg5 FROM m LEFT JOIN n USING (item_id)""")
def ag33_retrieval_metrics(spark, d):
    """Relevance is asked for the hits alone; how many there are for a query is counted by the rule, without pairs."""
    good = t(spark, d, "labels").where("quality = 1").select("doc_id")
    hits = _bm(spark, d, 10)
    relevant = hits.where((F.col("doc_id") + F.col("item_id")) % 3 == 0).join(good, "doc_id", "left_semi").select("item_id", "doc_id")
    by = good.groupBy((F.col("doc_id") % 3).alias("_m")).agg(F.count("*").alias("n"))
    counts = asked(spark, d).select("item_id", ((3 - F.col("item_id") % 3) % 3).alias("_m")).join(F.broadcast(by), "_m").select("item_id", "n")
    return Q.retrieval_metrics(hits, relevant, "item_id", "doc_id", counts)


# Changes -------------------------------------------------------------------------------------------------------

_STATES = """a AS (SELECT o_orderkey AS k, o_orderstatus AS s, round(o_totalprice * CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END, 2) AS p FROM orders WHERE o_orderkey % 5 <> 0),
 b AS (SELECT o_orderkey AS k, o_orderstatus AS s, round(o_totalprice, 2) AS p FROM orders WHERE o_orderkey % 7 <> 0)"""


def _states(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    now = o.where("k % 5 <> 0").withColumn("p", F.round(F.col("p") * F.when(F.col("k") % 11 == 0, 2).otherwise(1), 2))
    return now, o.where("k % 7 <> 0").withColumn("p", F.round("p", 2))


@query(f"""WITH {_STATES} SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'deleted' WHEN a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p THEN 'changed' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def jn24_change_classes(spark, d):
    now, then = _states(spark, d)
    return C.change_classes(now, then, "k", ["s", "p"])


@query(f"""WITH {_STATES} SELECT a.k, a.s, a.p FROM a LEFT JOIN b ON a.k = b.k WHERE a.k % 13 <> 0 AND (b.k IS NULL OR a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p)""")
def jn15_to_sync(spark, d):
    now, then = _states(spark, d)
    return C.to_sync(now, then, now.where("k % 13 = 0"), "k", ["s", "p"])


@query(f"WITH {_STATES} SELECT k, s, p FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, s, p FROM a")
def st10_upsert(spark, d):
    now, then = _states(spark, d)
    return C.upsert(then, now, "k")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def wn20_keep_newest(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts")
    return C.newest(e, [F.desc("ts"), F.desc("event_id")], 5, ["user_id"]).select("event_id", "user_id")


@query("""SELECT event_id, event_type, (count(*) OVER (PARTITION BY event_type) > 200 AND row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) > 150) AS archived FROM events""")
def wn19_retention(spark, d):
    return C.archive_split(t(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id")


@query("SELECT count(*) AS all_rows, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 2000) AS long_texts FROM documents")
def ag29_facets(spark, d):
    return C.facets(t(spark, d, "documents"), {"english": F.col("lang") == "en", "long_texts": F.col("n_chars") > 2000})


@query("SELECT coalesce(source, '__unknown__') AS value, count(*) AS n FROM documents GROUP BY 1")
def ag30_value_counts(spark, d):
    return C.value_counts(t(spark, d, "documents"), "source")


@query("""WITH c AS (SELECT source, n_chars % 10 AS v, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1, 2)
 SELECT source, v AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, f) = 1""")
def ag18_mode(spark, d):
    return C.mode(t(spark, d, "documents").withColumn("v", F.col("n_chars") % 10), "source", "v", "doc_id")


@query("SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS tokens, string_agg(doc_id::VARCHAR, '、' ORDER BY doc_id::VARCHAR) AS names FROM documents GROUP BY 1")
def ag14_directory_summary(spark, d):
    docs = t(spark, d, "documents").withColumn("name", F.col("doc_id").cast("string"))
    return C.directory_summary(docs, "source", "name", "n_chars")


_LINKS = "l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages)"


def _links(spark, d):
    return t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))


@query(f"WITH {_LINKS} SELECT target, count(*) AS sources, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS names FROM l GROUP BY 1")
def ag24_reverse_links(spark, d):
    return C.reverse_links(_links(spark, d), "page_id", "target")


@query(f"WITH {_LINKS} SELECT page_id, target FROM l WHERE page_id % 3 = 0 EXCEPT SELECT page_id, target FROM l WHERE length(target) % 2 = 0")
def jn25_removed_links(spark, d):
    links = _links(spark, d)
    return C.removed_links(links.where("page_id % 3 = 0"), links.where(F.length("target") % 2 == 0), ["page_id", "target"])


_NORMAL = "regexp_replace(lower({0}), '[\\s\\p{{P}}]+', '', 'g')"
_TITLE = "lower(regexp_replace({0}, '[^A-Za-z]+', '', 'g'))"


@query(f"""WITH a AS (SELECT p_partkey AS k, {_TITLE.format('p_name')} AS t FROM part), b AS (SELECT p_partkey AS k2, {_TITLE.format("CASE WHEN p_partkey % 9 = 0 THEN left(p_name, 1) ELSE string_split(p_name, ' ')[1] END")} AS t2 FROM part)
 SELECT k, min(k2) AS k2 FROM a JOIN b ON t <> '' AND t2 <> '' AND (contains(t, t2) OR contains(t2, t)) GROUP BY 1""")
def jn17_fuzzy_match(spark, d):
    """Names against first words, of which one in nine is a single letter."""
    p = t(spark, d, "part").select("p_partkey", "p_name")
    a = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("title"), F.lit("").alias("author"))
    word = F.when(F.col("p_partkey") % 9 == 0, F.left("p_name", F.lit(1))).otherwise(F.split("p_name", " ")[0])
    return C.fuzzy_first_match(a, p.select(F.col("p_partkey").alias("k2"), word.alias("title"), F.lit("").alias("author")), "k", "k2", "title", "author")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def st3_except_keys(spark, d):
    return t(spark, d, "customer").select("c_custkey").join(t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


# Sessions ------------------------------------------------------------------------------------------------------


def _chat(spark, d):
    return t(spark, d, "conversations")


@query("""WITH n AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM n WHERE role = 'user' AND nr = 'assistant' QUALIFY b <= 3)
 SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round, text AS question, answer FROM p""")
def wn14_recent_rounds(spark, d):
    return M.recent_rounds(_chat(spark, d), "conv_id", "turn")


@query("SELECT conv_id, max_by(text, turn) AS text, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1")
def wn15_last_assistant(spark, d):
    return M.last_by_role(_chat(spark, d), "conv_id", "turn")


@query("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER w AS p, coalesce(sum(round(length(text) / 2)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS removed FROM conversations WHERE turn >= conv_id % 2 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 u AS (SELECT * FROM r WHERE role = 'user' AND p > 1), b AS (SELECT conv_id, coalesce(min(CASE WHEN removed >= 300 THEN turn END), max(turn)) AS boundary FROM u GROUP BY 1)
 SELECT DISTINCT r.conv_id, boundary, u.removed FROM r LEFT JOIN b USING (conv_id) LEFT JOIN u ON u.conv_id = b.conv_id AND u.turn = boundary""")
def wn16_consolidation_boundary(spark, d):
    """Odd conversations have their watermark after the first turn."""
    return M.consolidation_boundary(_chat(spark, d).withColumn("since", F.col("conv_id") % 2), "conv_id", "turn", 300, "since")


@query("""WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4), f AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS f FROM l)
 SELECT conv_id, turn, role, text FROM f WHERE turn >= f""")
def wn17_aligned_history(spark, d):
    return M.aligned_history(_chat(spark, d), "conv_id", "turn", 4).select("conv_id", "turn", "role", "text")


@query("""SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) > 1 AND count(*) OVER (PARTITION BY conv_id) > 4
 THEN '[已压缩] ' || CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END ELSE text END AS text FROM conversations""")
def wn18_compressed(spark, d):
    return M.compressed(_chat(spark, d), "conv_id", "turn", "assistant", 1).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, count(*) AS messages, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def ag39_session_sizes(spark, d):
    return M.session_sizes(_chat(spark, d), "conv_id")


# Structure and text --------------------------------------------------------------------------------------------

_LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)"


@query(f"WITH {_LINES} SELECT doc_id, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS next_line, length(text) AS chars FROM ln WHERE length(text) > 80")
def wn3_next_start(spark, d):
    rows = N.lines(nodes(spark, d), "doc_id").where(F.length("text") > 80)
    return rows.select("doc_id", "line", F.lead("line").over(Window.partitionBy("doc_id").orderBy("line")).alias("next_line"), F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id, source, lpad(n::VARCHAR, greatest(6, length(n::VARCHAR))::INT, '0') AS node_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)")
def wn24_preorder_ids(spark, d):
    return N.numbered(nodes(spark, d).select("doc_id", "source"), "source", ["doc_id"], 6)


@query(f"""WITH {_LINES}, h AS (SELECT doc_id, line, CASE WHEN length(text) < 40 THEN 1 WHEN length(text) < 120 THEN 2 ELSE 3 END AS level FROM ln),
 p AS (SELECT a.doc_id, a.line, a.level, max(b.line) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.line < a.line AND b.level < a.level GROUP BY 1, 2, 3) SELECT doc_id, line, level::BIGINT AS level, parent FROM p""")
def wn6_parents(spark, d):
    rows = N.lines(nodes(spark, d), "doc_id")
    level = F.when(F.length("text") < 40, 1).when(F.length("text") < 120, 2).otherwise(3).cast("long")
    return N.parents(rows.select("doc_id", "line", level.alias("level")), "doc_id")


@query(f"""SELECT doc_id, ceil(0.25 * length(text))::BIGINT AS estimate FROM documents""")
def tx4_token_estimate(spark, d):
    return nodes(spark, d).select("doc_id", X.token_estimate(F.col("text")).alias("estimate"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 120) || ' ... ' || right(text, 80) END AS cut FROM documents")
def tx23_head_and_tail(spark, d):
    return nodes(spark, d).select("doc_id", X.head_and_tail(F.col("text"), 200).alias("cut"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_id FROM documents")
def ma13_content_ids(spark, d):
    return nodes(spark, d).select("doc_id", X.content_id(F.col("text")).alias("content_id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= 3600 THEN (o_orderkey // 3600)::VARCHAR || '小时' || (o_orderkey % 3600 // 60)::VARCHAR || '分钟' ELSE (o_orderkey // 60)::VARCHAR || '分钟' END AS duration FROM orders")
def dt1_duration(spark, d):
    return t(spark, d, "orders").select("o_orderkey", X.duration_text(F.col("o_orderkey")).alias("duration"))


@query("WITH q AS (SELECT item_id, left(text, (item_id % 20)::INT) AS q FROM benchmark) SELECT item_id, CASE WHEN length(q) < 5 THEN 50 WHEN length(q) <= 15 THEN 30 ELSE 15 END AS book_k, CASE WHEN length(q) < 5 THEN 50 WHEN length(q) < 15 THEN 30 ELSE 10 END AS vault_k FROM q")
def tk3_dynamic_k(spark, d):
    """Queries of 0 to 19 characters: the depths of a book's search and of a search over notes."""
    q = F.left("text", (F.col("item_id") % 20).cast("int"))
    return asked(spark, d).select("item_id", S.recall_k(q, 50, 30, 15).alias("book_k"), S.vault_recall_k(q).alias("vault_k"))


@query("""WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part), g AS (SELECT p_partkey, list_transform(range(1, length(replace(a, ' ', ''))), lambda i: substr(replace(a, ' ', ''), i, 2)) AS x,
 list_transform(range(1, length(replace(b, ' ', ''))), lambda i: substr(replace(b, ' ', ''), i, 2)) AS y FROM p) SELECT p_partkey, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_filter(y, lambda g: list_contains(x, g))) / len(y) END, 6) AS overlap FROM g""")
def ma11_bigram_overlap(spark, d):
    return t(spark, d, "part").select("p_partkey", F.round(S.bigram_overlap(F.lower("p_name"), F.lower("p_type")), 6).alias("overlap"))


@query("""WITH p AS (SELECT p_partkey, p_name AS a, p_type AS b, lower(p_name) AS x, lower(p_type) AS y FROM part)
 SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN least(length(a), length(b)) / greatest(length(a), length(b), 1) ELSE len(list_filter(string_split(x, ''), lambda c: c <> '' AND contains(y, c))) / greatest(length(a), length(b), 1) END, 6) AS similarity FROM p""")
def ma10_string_similarity(spark, d):
    return t(spark, d, "part").select("p_partkey", F.round(S.string_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


# Traces --------------------------------------------------------------------------------------------------------


@query("SELECT event_type AS stage, count(*) AS n, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events GROUP BY 1")
def ag32_stage_statistics(spark, d):
    return Q.stage_statistics(t(spark, d, "events").withColumnRenamed("event_type", "stage"), "stage", "value")


@query("WITH g AS (SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1) SELECT round(sum(mean * n) / sum(n), 4) AS pooled, sum(n)::BIGINT AS n FROM g")
def ag32_pooled_mean(spark, d):
    g = Q.stage_statistics(t(spark, d, "events"), "event_type", "value")
    return Q.pooled_mean(g, "mean", "n")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 3")
def ag32_slowest(spark, d):
    return Q.slowest(t(spark, d, "events").select("event_id", "value"), "value", "event_id")


@query("SELECT source, n, repeat('#', round(n / max(n) OVER () * 20)::INT) AS bar FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def ag45_bars(spark, d):
    return Q.bars(t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "n")


# Folds: tested against a plain version, no SQL -----------------------------------------------------------------


@query()
def wn9_chunks(spark, d):
    rows = N.lines(nodes(spark, d), "doc_id").withColumn("block", F.concat(F.lit("p"), X.padded(F.col("line"), 3)))
    return N.chunks(rows, "doc_id", "line", "block")
