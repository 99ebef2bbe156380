"""More of the library's queries, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import similarity as S
from lectern.functions import text as X
from lectern.operators import changes as C
from lectern.operators import fusion as U
from lectern.operators import lexical as L
from lectern.operators import quality as Q
from lectern.operators import reading as R
from lectern.operators import structure as N
from lectern.operators.ordered import placed
from lectern.queries import _BM25, _COS, _LINES, _NORMAL, _WORDS, _bm, _chat, _cos, _topk, asked, nodes, query, t


@query("SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1') OR starts_with(source, 'src3')")
def fp3_directory_prefix(spark, d):
    return nodes(spark, d).where(R.any_prefix(F.col("source"), ["src1", "src3"])).select("doc_id", "source")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ar') OR contains(lower(p_brand), 'ar')")
def fp6_library_search(spark, d):
    return R.library_search(t(spark, d, "part"), "AR", ["p_name", "p_brand"]).select("p_partkey")


@query("SELECT conv_id, turn FROM conversations WHERE length(trim(text)) > 10 AND (contains(lower(text), 'the ') OR contains(lower(text), ' que '))")
def fp11_history_search(spark, d):
    return _chat(spark, d).where((F.length(F.trim("text")) > 10) & R.any_contained(F.col("text"), ["the ", " que "])).select("conv_id", "turn")


_KEYS = "k AS (SELECT DISTINCT string_split(trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')), ' ')[2] AS word FROM benchmark)"


@query(f"WITH {_KEYS} SELECT doc_id, word FROM documents JOIN k ON length(word) > 5 AND contains(lower(text), word)")
def fp13_annotation_match(spark, d):
    words = asked(spark, d).select(F.get(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9_]+", " ")), " "), F.lit(1)).alias("word")).where("length(word) > 5")
    return R.keyword_matches(nodes(spark, d), words, "doc_id", "word")


@query("""WITH e AS (SELECT source, doc_id AS page FROM documents WHERE n_chars > 3000), p AS (SELECT source, max(doc_id) - min(doc_id) AS pages FROM documents GROUP BY 1)
 SELECT source, count(*) AS entries, count(*) >= 5 AND max(page) - min(page) >= 0.6 * max(pages) AS good FROM e JOIN p USING (source) GROUP BY 1""")
def fp15_outline_quality(spark, d):
    docs = t(spark, d, "documents").select("source", F.col("doc_id").alias("page"), "n_chars")
    return R.outline_quality(docs.where("n_chars > 3000"), "source", "page", docs.groupBy("source").agg((F.max("page") - F.min("page")).alias("pages")))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)not|nicht') THEN 'denial' WHEN regexp_matches(text, '(?i)the|der') THEN 'article' END AS reason FROM conversations")
def fp18_first_rule(spark, d):
    return R.first_rule(_chat(spark, d), "text", [("(?i)not|nicht", "denial"), ("(?i)the|der", "article")]).select("conv_id", "turn", "reason")


@query("""SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 0 WHEN (event_id % 7 = 0) AND b = 2 THEN 3 ELSE b END AS depth FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN greatest(a, 2) ELSE a END AS b
 FROM (SELECT event_id, CASE WHEN event_id % 6 BETWEEN 0 AND 3 THEN event_id % 6 ELSE coalesce(CASE WHEN event_id % 4 <> 0 THEN event_id % 4 END, 2) END AS a FROM events))""")
def fp31_depth_ladder(spark, d):
    i = F.col("event_id")
    return t(spark, d, "events").select("event_id", R.depth_ladder(i % 6, F.when(i % 4 != 0, i % 4), i % 5 == 0, i % 7 == 0, i % 17 == 0).alias("depth"))


@query(f"""WITH {_BM25}, {_COS}, {_topk('bm', 20, name='b')}, {_topk('cs', 20, name='c')} SELECT coalesce(b.item_id, c.item_id) AS item_id, coalesce(b.doc_id, c.doc_id) AS doc_id,
 round(0.6 * coalesce(c.score, 0) + 0.4 * coalesce(b.score, 0), 6) AS score FROM b FULL JOIN c ON b.item_id = c.item_id AND b.doc_id = c.doc_id""")
def jn5_cards_and_text(spark, d):
    return U.weighted_fusion(_cos(spark, d, 20), _bm(spark, d, 20), "item_id", "doc_id", 0.6, 0.4)


@query("""SELECT e.user_id, e.event_type, count(*) AS n FROM events e ANTI JOIN (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0) k ON e.user_id = k.user_id AND e.event_type = k.event_type GROUP BY 1, 2""")
def jn20_composite_anti(spark, d):
    e = t(spark, d, "events")
    return e.join(e.where("event_id % 3 = 0").select("user_id", "event_type"), ["user_id", "event_type"], "left_anti").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT p_partkey AS k, p_name AS x FROM part WHERE p_partkey % 50 = 0), b AS (SELECT p_partkey AS k2, p_type AS y FROM part),
 r AS (SELECT k, k2, round(CASE WHEN x = y THEN 1.0 WHEN contains(lower(x), lower(y)) OR contains(lower(y), lower(x)) THEN least(length(x), length(y)) / greatest(length(x), length(y), 1)
 ELSE len(list_filter(string_split(lower(x), ''), lambda c: c <> '' AND contains(lower(y), c))) / greatest(length(x), length(y), 1) END, 6) AS similarity FROM a CROSS JOIN b)
 SELECT k, k2, similarity FROM r WHERE similarity > 0.4 QUALIFY row_number() OVER (PARTITION BY k ORDER BY similarity DESC, k2) = 1""")
def jn26_best_similar(spark, d):
    """The stated query set, every name whose id is divisible by 50, against all types."""
    p = t(spark, d, "part")
    wanted = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("x"))
    return R.best_similar(wanted, p.select(F.col("p_partkey").alias("k2"), F.col("p_type").alias("x")), "k", "k2", "x")


@query("""SELECT source, w.doc_id, k.doc_id AS nearest FROM documents w JOIN documents k USING (source) QUALIFY row_number() OVER (PARTITION BY w.doc_id ORDER BY abs(k.doc_id - w.n_chars), k.doc_id) = 1""")
def jn27_nearest_number(spark, d):
    """Each document's number of characters against the numbers of its source's documents."""
    n = t(spark, d, "documents").select("source", "doc_id", "n_chars")
    return R.nearest_number(n.select("source", "doc_id", F.col("n_chars").alias("n")), n.select("source", F.col("doc_id").alias("n")), "source", "doc_id", "n")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 first_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events""")
def jn33_neighbours(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type")
    return R.neighbours(e, "user_id", "event_id", F.col("event_type") != "error", "event_id").drop("event_type")


@query("""WITH a AS (SELECT event_type AS dim, round(avg(value), 4) AS v FROM events WHERE event_id % 2 = 0 AND event_type <> 'view' GROUP BY 1), b AS (SELECT event_type AS dim, round(avg(value), 4) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1)
 SELECT coalesce(a.dim, b.dim) AS dim, a.v AS a, b.v AS b, round(coalesce(b.v, 0) - coalesce(a.v, 0), 4) AS delta, abs(round(coalesce(b.v, 0) - coalesce(a.v, 0), 4)) >= 0.5 AS noted FROM a FULL JOIN b ON a.dim = b.dim""")
def jn36_run_difference(spark, d):
    e = t(spark, d, "events").withColumnRenamed("event_type", "dim")
    g = lambda x: x.groupBy("dim").agg(F.round(F.avg("value"), 4).alias("v"))
    return R.run_difference(g(e.where("event_id % 2 = 0 and dim <> 'view'")), g(e.where("event_id % 2 = 1")), "dim", "v")


@query(f"""WITH {_LINES}, x AS (SELECT source, text AS title FROM ln JOIN documents USING (doc_id) WHERE length(ln.text) BETWEEN 1 AND 150), y AS (SELECT *, count(*) OVER (PARTITION BY source, title) AS same FROM x),
 g AS (SELECT source, count(*) AS titles, sum((same > 1)::INT)::BIGINT AS duplicates, sum((trim(title) LIKE '%...')::INT)::BIGINT AS truncated, sum((length(title) > 100)::INT)::BIGINT AS long,
 sum(({_NORMAL.format('title')} = {_NORMAL.format('source')})::INT)::BIGINT AS placeholders FROM y GROUP BY 1)
 SELECT *, CASE WHEN placeholders / titles >= 0.3 THEN 'placeholders' WHEN truncated / titles >= 0.3 OR long / titles >= 0.3 THEN 'truncations' WHEN duplicates / titles >= 0.3 THEN 'duplicates' ELSE 'good' END AS verdict FROM g""".replace("SELECT source, text AS title FROM ln JOIN documents USING (doc_id)", "SELECT source, ln.text AS title FROM ln JOIN documents USING (doc_id)"))
def ag16_title_quality(spark, d):
    rows = N.lines(nodes(spark, d), "doc_id").where(F.length("text").between(1, 150)).join(nodes(spark, d).select("doc_id", "source"), "doc_id")
    return Q.heading_quality(rows.select("source", F.col("text").alias("title")), ["source"], "title", "source")


_TREE = f"""{_LINES}, h AS (SELECT doc_id, line, CASE WHEN length(text) < 40 THEN 1 WHEN length(text) < 120 THEN 2 ELSE 3 END AS level, length(text) AS chars FROM ln)"""


@query(f"WITH {_TREE}, u AS (SELECT a.doc_id, a.line, any_value(a.chars) AS own, min(b.line) AS until FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.line > a.line AND b.level <= a.level GROUP BY 1, 2) SELECT u.doc_id, u.line, until, sum(h.chars)::BIGINT AS total FROM u JOIN h ON u.doc_id = h.doc_id AND h.line >= u.line AND (until IS NULL OR h.line < until) GROUP BY 1, 2, 3")
def ag20_subtree_sums(spark, d):
    rows = N.lines(nodes(spark, d), "doc_id")
    level = F.when(F.length("text") < 40, 1).when(F.length("text") < 120, 2).otherwise(3)
    h = N.subtree_end(rows.select("doc_id", "line", level.cast("long").alias("level"), F.length("text").alias("chars")), "doc_id")
    return R.subtree_sums(h, "doc_id", "line", "until", "chars").select("doc_id", "line", "until", "total")


@query("SELECT strftime(ts, '%Y/%m') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ag25_by_month(spark, d):
    return t(spark, d, "events").groupBy(F.date_format("ts", "yyyy/MM").alias("month"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS calls, round(sum(value), 2) AS total FROM events GROUP BY ROLLUP (event_type)")
def ag31_usage_rollup(spark, d):
    return t(spark, d, "events").rollup("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("total"))


_ANSWER = "x AS (SELECT doc_id, length(text)::BIGINT AS chars, 1000 AS least_chars, doc_id % 5 AS found, 4 AS expected, doc_id % 3 AS links, 2 AS least_links, doc_id % 7 AS forbidden FROM documents)"


@query(f"""WITH {_ANSWER}, y AS (SELECT doc_id, round(round(40 * found / expected, 2) + CASE WHEN chars >= least_chars THEN 30 ELSE round(30.0 * (chars / least_chars), 2) END + CASE WHEN links >= least_links THEN 20 ELSE round(20.0 * (links / least_links), 2) END + CASE WHEN forbidden > 0 THEN 0 ELSE 10 END, 2) AS score FROM x)
 SELECT doc_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM y""")
def ag35_answer_score(spark, d):
    i = F.col("doc_id")
    a = nodes(spark, d).select("doc_id", F.length("text").cast("long").alias("chars"), F.lit(1000).alias("least_chars"), (i % 5).alias("found"), F.lit(4).alias("expected"), (i % 3).alias("links"), F.lit(2).alias("least_links"), (i % 7).alias("forbidden"))
    return R.answer_score(a).select("doc_id", "score", "grade")


@query("SELECT source, count(*) AS books, count(*) FILTER (n_chars >= 2000) AS finished, round(100.0 * count(*) FILTER (n_chars >= 2000) / count(*), 2) AS percent, round(sum(n_chars) / 3600.0) AS hours FROM documents GROUP BY 1")
def ag38_reading_statistics(spark, d):
    done = F.count_if(F.col("n_chars") >= 2000)
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("books"), done.alias("finished"), F.round(100.0 * done / F.count("*"), 2).alias("percent"), F.round(F.sum("n_chars") / 3600.0).alias("hours"))


@query("""WITH a AS (SELECT DISTINCT user_id, event_type AS block FROM events), k AS (SELECT DISTINCT user_id, event_type AS block FROM events WHERE event_id % 4 = 0), j AS (SELECT a.user_id, k.block IS NULL AS g FROM a LEFT JOIN k USING (user_id, block))
 SELECT user_id, count(*) AS cited, count(*) FILTER (g) AS ghosts, count(*) FILTER (g) / count(*) > 0.3 AS ghostly FROM j GROUP BY 1""")
def ag44_ghost_citations(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("block"))
    return R.cited_validity(e, e.where("event_id % 4 = 0"), "user_id")


@query("""WITH s AS (SELECT event_type, value, CASE WHEN value - lag(value) OVER (PARTITION BY event_type ORDER BY value) > 0.5 OR lag(value) OVER (PARTITION BY event_type ORDER BY value) IS NULL THEN 1 ELSE 0 END AS s FROM events),
 c AS (SELECT event_type, value, sum(s) OVER (PARTITION BY event_type ORDER BY value ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM s) SELECT event_type, cluster, round(sum(value), 2) AS total, count(*) AS n FROM c GROUP BY 1, 2""")
def ag47_position_clusters(spark, d):
    return R.position_clusters(t(spark, d, "events").select("event_type", "value"), "event_type", "value", 0.5).drop("mean")


@query("SELECT doc_id, round(n_chars * CASE WHEN source = 'src1' THEN 1.5 ELSE 1 END, 2)::DOUBLE AS score FROM documents ORDER BY score DESC, doc_id LIMIT 25")
def tk7_current_boost(spark, d):
    s = F.round(F.col("n_chars") * F.when(F.col("source") == "src1", 1.5).otherwise(1.0), 2)
    return t(spark, d, "documents").select("doc_id", s.alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY (source <> 'src0')::INT, n_chars DESC, doc_id) AS place FROM documents")
def tk11_library_order(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang", "n_chars", (F.col("source") != "src0").alias("other"))
    return placed(rows, ["lang"], ["other", F.desc("n_chars"), "doc_id"]).select("doc_id", (F.col("place") + 1).alias("place"))


@query("""WITH x AS (SELECT doc_id, 0 AS place, 'scope' AS reason FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 1, 'cited' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2, 'current' FROM documents WHERE doc_id % 2 = 0)
 SELECT doc_id, arg_min(reason, place) AS reason, min(place)::BIGINT AS place FROM x GROUP BY 1""")
def st4_ordered_union(spark, d):
    n = nodes(spark, d).select("doc_id")
    return R.ordered_union([("scope", n.where("doc_id % 5 = 0")), ("cited", n.where("doc_id % 3 = 0")), ("current", n.where("doc_id % 2 = 0"))], "doc_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def st9_last_record(spark, d):
    return C.first_of(t(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query(f"SELECT doc_id, len({_WORDS.format('text')})::BIGINT AS tokens, len(list_distinct({_WORDS.format('text')}))::BIGINT AS distinct_tokens FROM documents")
def tx1_token_lists(spark, d):
    words = X.lexical_tokens(F.col("text"))
    return nodes(spark, d).select("doc_id", F.size(words).cast("long").alias("tokens"), F.size(F.array_distinct(words)).cast("long").alias("distinct_tokens"))


@query(f"SELECT p_partkey, {_NORMAL.format('p_name')} AS bare FROM part")
def tx6_bare_titles(spark, d):
    return t(spark, d, "part").select("p_partkey", X.bare(F.col("p_name")).alias("bare"))


@query("SELECT page_id, CASE WHEN contains(url, ':') THEN trim(string_split(url, ':')[1]) WHEN contains(url, '-') THEN trim(string_split(url, '-')[1]) ELSE url END AS title FROM pages")
def tx10_simple_title(spark, d):
    return t(spark, d, "pages").select("page_id", X.simple_title(F.col("url")).alias("title"))


@query("SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)[1] AS first_link, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))::BIGINT AS links FROM pages")
def tx25_links(spark, d):
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return t(spark, d, "pages").select("page_id", F.get(found, F.lit(0)).alias("first_link"), F.size(found).cast("long").alias("links"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN left(text, 100) || '... (' || (length(text) - 100)::VARCHAR || ' more)' ELSE text END AS cut FROM conversations")
def tx31_truncated_results(spark, d):
    n = F.length("text")
    cut = F.when(n > 100, F.concat(F.left("text", F.lit(100)), F.lit("... ("), (n - 100).cast("string"), F.lit(" more)"))).otherwise(F.col("text"))
    return _chat(spark, d).select("conv_id", "turn", cut.alias("cut"))


@query("SELECT doc_id, greatest(least((length(text) // 500) * 2, 15), 3) AS cards FROM documents")
def ma12_card_count(spark, d):
    return nodes(spark, d).select("doc_id", F.greatest(F.least(F.floor(F.length("text") / 500) * 2, F.lit(15).cast("long")), F.lit(3).cast("long")).alias("cards"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN true ELSE false END AS expired FROM events")
def dt5_days_and_expiry(spark, d):
    return t(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("ts") < F.expr("timestamp_ntz'2024-01-10'")).alias("expired"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id // 3 FROM documents)")
def ar1_leaf_nodes(spark, d):
    n = nodes(spark, d).select("doc_id", F.floor(F.col("doc_id") / 3).alias("parent"))
    return n.select("doc_id").join(n.select(F.col("parent").alias("doc_id")), "doc_id", "left_anti")


_DOTTED = "i AS (SELECT source, doc_id AS o, CASE doc_id % 3 WHEN 0 THEN (doc_id // 60)::VARCHAR WHEN 1 THEN (doc_id // 60)::VARCHAR || '.' || (doc_id % 60)::VARCHAR ELSE (doc_id // 60)::VARCHAR || '.' || (doc_id % 60 - 1)::VARCHAR || '.1' END AS s FROM documents)"


@query(f"WITH {_DOTTED} SELECT a.source, a.o, a.s, max(b.o) AS parent FROM i a LEFT JOIN i b ON a.source = b.source AND b.o < a.o AND contains(a.s, '.') AND b.s = regexp_replace(a.s, '\\.[^.]+$', '') GROUP BY 1, 2, 3")
def ar2_dotted_parents(spark, d):
    i, top = F.col("doc_id"), F.floor(F.col("doc_id") / 60).cast("string")
    s = F.when(i % 3 == 0, top).when(i % 3 == 1, F.concat(top, F.lit("."), (i % 60).cast("string"))).otherwise(F.concat(top, F.lit("."), (i % 60 - 1).cast("string"), F.lit(".1")))
    return R.dotted_parents(nodes(spark, d).select("source", F.col("doc_id").alias("o"), s.alias("s")), "source", "s", "o")


@query("SELECT source, string_agg(repeat('  ', (doc_id % 3)::INT) || '- ' || left(text, 20), chr(10) ORDER BY doc_id) AS outline FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10) GROUP BY 1")
def ar10_outline(spark, d):
    n = nodes(spark, d).select("source", "doc_id", (F.col("doc_id") % 3).cast("int").alias("depth"), F.left("text", F.lit(20)).alias("title"))
    return R.capped_outline(n, "source", "doc_id", "depth", "title", 10)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def js4_parsed_properties(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object(X.json_in_text(F.concat(F.lit("answer: ```json "), "props", F.lit("```"))), "$.k").try_cast("bigint").alias("k"))


@query("SELECT user_id, max_by(event_type, event_id) AS last_type, min_by(event_type, event_id) AS first_type, count(*) AS n FROM events GROUP BY 1")
def sm1_stream_states(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.min_by("event_type", "event_id").alias("first_type"), F.count("*").alias("n"))


@query(f"""WITH {_BM25}, {_COS}, {_topk('bm', 20, name='b')}, l AS (SELECT item_id, doc_id, 0.5 AS s FROM b), {_topk('cs', 20, name='c')} SELECT coalesce(l.item_id, c.item_id) AS item_id, coalesce(l.doc_id, c.doc_id) AS doc_id, round(least(coalesce(l.s, 0) + 0.5 * coalesce(c.score, 0), 1), 7) AS score
 FROM l FULL JOIN c ON l.item_id = c.item_id AND l.doc_id = c.doc_id""")
def rt8_directory_and_vector(spark, d):
    listed = _bm(spark, d, 20).select("item_id", "doc_id", F.lit(1.0).alias("score"))
    both = U.weighted_fusion(listed, _cos(spark, d, 20), "item_id", "doc_id", 0.5, 0.5, digits=7)
    return both.withColumn("score", F.least("score", F.lit(1.0)))


@query(f"""WITH {_BM25}, {_topk('bm', 20, name='b')}, g AS (SELECT item_id % 5 AS grp, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) AS sources FROM b GROUP BY 1, 2), {_topk('g', 10, by='grp')} SELECT grp, doc_id, score, sources, rank FROM r""")
def rt10_multi_query_rrf(spark, d):
    g = _bm(spark, d, 20).groupBy((F.col("item_id") % 5).alias("grp"), "doc_id").agg(F.round(F.sum(S.reciprocal_rank(F.col("rank"))), 6).alias("score"), F.count("*").alias("sources"))
    return L.top(g, "grp", "doc_id", 10)
