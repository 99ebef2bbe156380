"""Queries of folds over groups of any size and depth, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import similarity as S
from lectern.functions import text as X
from lectern.operators import nesting as H
from lectern.operators import notes as O
from lectern.operators import structure as N
from lectern.operators.ordered import placed
from lectern.queries import _LINES, nodes, query, t

#: Lines of all documents as one group, at depths of 1 to 40 by a rule of their length and place.
_DEEP = f"{_LINES}, h AS (SELECT doc_id * 1000000 + line AS line, (length(text) + line) % 40 + 1 AS level FROM ln)"


def _deep(spark, d):
    rows = N.lines(nodes(spark, d), "doc_id")
    return rows.select(F.lit(0).alias("all"), (F.col("doc_id") * 1_000_000 + F.col("line")).alias("line"), ((F.length("text") + F.col("line")) % 40 + 1).alias("level"))


@query(f"WITH {_DEEP} SELECT a.line, a.level, max(b.line) AS parent FROM h a LEFT JOIN h b ON b.line < a.line AND b.level < a.level GROUP BY 1, 2")
def wn6_parents_any_depth(spark, d):
    return H.parents(_deep(spark, d), "all").select("line", "level", "parent")


@query(f"WITH {_DEEP} SELECT a.line, min(b.line) AS until FROM h a LEFT JOIN h b ON b.line > a.line AND b.level <= a.level GROUP BY 1")
def wn7_subtree_ends(spark, d):
    return H.subtree_end(_deep(spark, d), "all").select("line", "until")


@query(f"""WITH {_LINES}, h AS (SELECT doc_id, line, (length(text) + line) % 9 AS level FROM ln), e AS (SELECT a.doc_id, a.line, min(b.line) AS until FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.line > a.line AND b.level <= a.level GROUP BY 1, 2)
 SELECT e.doc_id, e.line, (coalesce(until, n) - e.line - 1)::BIGINT AS descendants FROM e JOIN (SELECT doc_id, count(*) AS n FROM h GROUP BY 1) USING (doc_id)""")
def ar3_descendants(spark, d):
    """Levels from 0 on."""
    rows = N.lines(nodes(spark, d), "doc_id").select("doc_id", "line", ((F.length("text") + F.col("line")) % 9).alias("level"))
    return H.descendants(rows, "doc_id").select("doc_id", "line", "descendants")


@query("""WITH RECURSIVE i AS (SELECT row_number() OVER w - 1 AS p, sum(n) OVER w - n AS b, sum(n) OVER w AS r FROM (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents) WINDOW w AS (ORDER BY doc_id)),
 w(batch, first) AS (SELECT 0, 0 UNION ALL SELECT w.batch + 1, min(j.p)::INT FROM w JOIN i f ON f.p = w.first JOIN i j ON j.p > w.first AND j.r > f.b + 12000 GROUP BY ALL)
 SELECT batch::BIGINT AS batch, first::BIGINT AS first, coalesce(lead(first) OVER (ORDER BY batch), (SELECT count(*) FROM i))::BIGINT AS "end" FROM w""")
def wn12_size_batches(spark, d):
    """All documents in order, in batches of at most 12,000 characters."""
    docs = nodes(spark, d).select(F.lit(0).alias("all"), "doc_id", F.length("text").cast("long").alias("n"))
    return H.size_batches(docs, "all", ["doc_id"], "n", 12_000).select("batch", "first", "end")


@query("""WITH RECURSIVE i AS (SELECT user_id, -value AS r, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS p FROM events), n AS (SELECT user_id, count(*) AS n FROM i GROUP BY 1),
 w(user_id, line, first) AS (SELECT user_id, 0, 0 FROM n UNION ALL SELECT w.user_id, w.line + 1, min(j.p)::INT FROM w JOIN i f ON f.user_id = w.user_id AND f.p = w.first JOIN i j ON j.user_id = w.user_id AND j.p > w.first AND j.r > 5.0 + f.r GROUP BY ALL)
 SELECT user_id, line::BIGINT AS line, first::BIGINT AS first, coalesce(lead(first) OVER (PARTITION BY user_id ORDER BY line), n)::BIGINT AS "end" FROM w JOIN n USING (user_id)""")
def wn22_lines_by_height(spark, d):
    """A user's events by value, in lines of those within 5 of a line's first."""
    return H.lines_by_height(t(spark, d, "events"), "user_id", "value", "event_id", 5.0)


@query(f"""WITH RECURSIVE {_LINES}, p AS (SELECT doc_id, line, ceil(0.25 * length(text))::BIGINT AS n FROM ln), q AS (SELECT doc_id, line, sum(n) OVER w - n AS b, sum(n) OVER w AS r FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
 m AS (SELECT doc_id, count(*) AS pages, CASE WHEN sum(n) <= 400 THEN 400 ELSE ceil((sum(n) / ceil(sum(n) / 400) + 400) / 2) END AS most FROM p GROUP BY 1),
 w(doc_id, g, first, closed) AS (SELECT doc_id, 0, 0, -1 FROM m UNION ALL SELECT w.doc_id, w.g + 1, greatest(min(j.line) - 1, 0)::INT, min(j.line)::INT FROM w JOIN m ON m.doc_id = w.doc_id JOIN q f ON f.doc_id = w.doc_id AND f.line = w.first JOIN q j ON j.doc_id = w.doc_id AND j.line > w.closed AND j.r > f.b + m.most GROUP BY ALL)
 SELECT doc_id, g::BIGINT AS page_group, first::BIGINT AS first_page, coalesce(lead(closed) OVER (PARTITION BY doc_id ORDER BY g), pages)::BIGINT AS end_page FROM w JOIN m USING (doc_id)""")
def wn11_page_groups(spark, d):
    """A text's lines are its pages."""
    pages = N.lines(nodes(spark, d), "doc_id").select("doc_id", F.col("line").alias("page"), X.token_estimate(F.col("text")).alias("tokens"))
    return H.page_groups(pages, "doc_id", "page", "tokens", 400)


_WEIGHED = _LINES + """, h AS (SELECT doc_id, line, (length(text) + line) % 5 AS depth FROM ln), e AS (SELECT a.doc_id, a.line, a.depth, min(b.line) AS until FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.line > a.line AND b.depth <= a.depth GROUP BY 1, 2, 3),
 g AS (SELECT e.*, coalesce(until, n) - line - 1 AS below FROM e JOIN (SELECT doc_id, count(*) AS n FROM h GROUP BY 1) USING (doc_id))"""


@query(f"WITH {_WEIGHED} SELECT doc_id, line, (CASE WHEN depth = 0 AND below > 2 THEN 1.0 WHEN depth = 0 THEN 0.8 WHEN depth = 1 THEN 0.7 WHEN depth = 2 THEN 0.5 ELSE 0.3 END)::DOUBLE AS weight FROM g")
def ma7_vault_level_weight(spark, d):
    """A text's lines as a tree of depths 0 to 4."""
    rows = N.lines(nodes(spark, d), "doc_id").select("doc_id", "line", ((F.length("text") + F.col("line")) % 5).alias("depth"))
    return H.descendants(rows, "doc_id", level="depth").select("doc_id", "line", S.vault_level_weight(F.col("depth"), F.col("descendants")).alias("weight"))


_MARKED = """a AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN left(p_name, 1) WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '-') WHEN 3 THEN '.' WHEN 4 THEN p_name || ' (' || p_brand || ')' ELSE p_name END AS t FROM part),
 b AS (SELECT p_partkey AS mark, CASE WHEN p_partkey % 8 = 0 THEN string_split(p_name, ' ')[1] WHEN p_partkey % 12 = 0 THEN left(p_name, 2) ELSE replace(p_name, ' ', ' · ') END AS t FROM part WHERE p_partkey % 4 = 0)"""


@query(f"""WITH {_MARKED}, x AS (SELECT k, lower(regexp_replace(t, '[\\s\\-—:：.·]', '', 'g')) AS t FROM a), y AS (SELECT mark, lower(regexp_replace(t, '[\\s\\-—:：.·]', '', 'g')) AS t FROM b)
 SELECT k, coalesce(min(CASE WHEN x.t = y.t THEN mark END), min(CASE WHEN length(y.t) > 2 AND (contains(x.t, y.t) OR contains(y.t, x.t)) THEN mark END)) AS mark FROM x JOIN y ON x.t = y.t OR (length(y.t) > 2 AND (contains(x.t, y.t) OR contains(y.t, x.t))) GROUP BY 1""")
def jn14_bookmark_of(spark, d):
    """Titles in six forms, one of them empty in the form they are compared in, against names and first words."""
    p, k, name = t(spark, d, "part"), F.col("p_partkey"), F.col("p_name")
    forms = F.when(k % 6 == 0, F.left(name, F.lit(1))).when(k % 6 == 1, F.upper(name)).when(k % 6 == 2, F.replace(name, F.lit(" "), F.lit("-"))).when(k % 6 == 3, ".").when(k % 6 == 4, F.concat(name, F.lit(" ("), "p_brand", F.lit(")"))).otherwise(name)
    marks = F.when(k % 8 == 0, F.split(name, " ")[0]).when(k % 12 == 0, F.left(name, F.lit(2))).otherwise(F.replace(name, F.lit(" "), F.lit(" · ")))
    titles = p.select(k.alias("k"), forms.alias("title"))
    return O.bookmark_of(titles, p.where("p_partkey % 4 = 0").select(k.alias("mark"), marks.alias("title")), "k", "mark", "title")
