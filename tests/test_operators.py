"""Operators on small fixtures, against expectations worked out by hand or by a plain version."""

import math

from pyspark.sql import functions as F

from lectern.functions import similarity as S
from lectern.functions import text as X
from lectern.operators import changes as C
from lectern.operators import fusion as U
from lectern.operators import lexical as L
from lectern.operators import quality as Q
from lectern.operators import sessions as M
from lectern.operators import structure as N


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_lexical_tokens(spark):
    got = one(spark, X.lexical_tokens(F.lit("机器学习")))
    assert set(got) == {"机器学习", "机", "器", "学", "习", "机器", "器学", "学习"}
    assert one(spark, X.lexical_tokens(F.lit("hello你好"))) == ["你好", "你", "好", "你好", "hello"]
    assert one(spark, X.lexical_tokens(F.lit("hello hello hello"))) == ["hello"] * 3
    assert one(spark, X.lexical_tokens(F.lit(""))) == []
    assert one(spark, X.lexical_tokens(F.lit(None).cast("string"))) == []


def test_text_functions(spark):
    assert one(spark, X.token_estimate(F.lit("你好ab"))) == 3
    assert one(spark, X.normal_title(F.lit("深度学习（中文版）"))) == "深度学习"
    assert one(spark, X.simple_title(F.lit("Deep: a story - two"))) == "Deep"
    assert one(spark, X.strip_markdown(F.lit("# A **b** [[x|y]] [l](u)"))) == "A b y l"
    assert one(spark, X.wiki_links(F.lit("[[a|b]] and [[c#d]]"))) == ["a", "c"]
    assert one(spark, X.chapter_ids(F.lit("[[a/3 - x]] and > — 12 and [[3-y]]"))) == ["0003", "0012"]
    assert one(spark, X.json_in_text(F.lit('<think>x</think>```json\n{"a": None,}\n```'))) == '{"a": null}'
    assert one(spark, X.duration_text(F.lit(66600))) == "18小时30分钟"
    assert one(spark, X.chunk_kind(F.lit("  > said"))) == "quote"
    assert one(spark, X.html_text(F.lit("<p>a&amp;b</p><script>x</script>c"))) == "a&b\n c"


def test_similarity(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert abs(one(spark, S.cosine(arr(1, 2), arr(1, 2))) - 1.0) < 1e-9
    assert one(spark, S.cosine(arr(1, 0), arr(0, 1))) == 0.0
    assert one(spark, S.cosine(arr(0, 0), arr(0, 1))) == 0.0
    assert abs(one(spark, S.clamped_idf(F.lit(100), F.lit(10))) * 2.5 - 5.385) < 1e-3
    assert one(spark, S.reciprocal_rank(F.lit(1))) == 1 / 61
    assert one(spark, S.string_similarity(F.lit("abc"), F.lit("abcdef"))) == 0.5


def test_bm25(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "hello world"), (2, "hello foo"), (3, "")], "id long, text string")
    asked = spark.createDataFrame([(0, "hello world")], "q long, text string")
    got = {r["id"]: r["score"] for r in L.bm25_search(L.index_of(nodes, "id"), asked, "id", "q").collect()}
    mean, total = 4 / 3, 3
    w = lambda df: math.log(1 + (total - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / mean))
    assert got == {1: round(w(2) + w(1), 6), 2: round(w(2), 6)}
    L.write_index(nodes, "id", f"{tmp_path}/index", 4, 2)
    stored = L.read_index(spark, f"{tmp_path}/index")
    assert {r["id"]: r["score"] for r in L.bm25_search(stored, asked, "id", "q").collect()} == got
    deep = L.bm25_search(stored, asked, "id", "q", F.length("text") - 10)
    assert [r["id"] for r in deep.collect()] == [1]


def test_fusion_and_scope(spark):
    a = spark.createDataFrame([(0, 1, 5.0), (0, 2, 4.0)], "q long, id long, score double")
    b = spark.createDataFrame([(0, 2, 1.0), (0, 3, 0.5)], "q long, id long, score double")
    fused = U.reciprocal_rank_fusion({"a": a, "b": b}, "q", "id", candidates=("a",))
    assert {r["id"]: r["score"] for r in fused.collect()} == {1: round(1 / 61, 6), 2: round(1 / 62 + 1 / 61, 6)}
    empty = a.limit(0)
    assert U.reciprocal_rank_fusion({"a": a, "b": empty}, "q", "id").count() == 2
    scope = spark.createDataFrame([(0, 9)], "q long, id long")
    assert U.in_scope_or_all(a, scope, "q", "id").count() == 2
    assert U.in_scope_or_all(a, spark.createDataFrame([(0, 2)], "q long, id long"), "q", "id").count() == 1


def test_changes(spark):
    now = spark.createDataFrame([(1, 5), (2, 6), (4, None)], "k long, n long")
    then = spark.createDataFrame([(1, 5), (2, 7), (3, 1), (4, None)], "k long, n long")
    got = {r["k"]: r["change"] for r in C.change_classes(now, then, "k", ["n"]).collect()}
    assert got == {1: "unchanged", 2: "changed", 3: "deleted", 4: "unchanged"}
    left = spark.createDataFrame([(1, "深度学习（中文版）", ""), (2, "Other", "x"), (3, "书", "")], "a long, title string, author string")
    right = spark.createDataFrame([(10, "深度学习", "Ian"), (11, "深度学习", "Ian"), (12, "Other", "y"), (13, "书", "")], "b long, title string, author string")
    assert [tuple(r) for r in C.fuzzy_first_match(left, right, "a", "b", "title", "author").orderBy("a").collect()] == [(1, 10), (3, 13)]


def test_sessions(spark):
    rows = [(1, i, r, x) for i, (r, x) in enumerate([("user", "a"), ("assistant", "b"), ("user", "c"), ("user", "d"), ("assistant", "e")])]
    m = spark.createDataFrame(rows, "s long, n long, role string, text string")
    assert [(r["round"], r["question"], r["answer"]) for r in M.recent_rounds(m, "s", "n").orderBy("round").collect()] == [(1, "a", "b"), (2, "d", "e")]
    assert M.aligned_history(m, "s", "n", 4).count() == 3


def test_structure(spark):
    text = "# A\n```\n# not\n```\n## B\ntext\n### C\n## D"
    rows = N.lines(spark.createDataFrame([(1, text)], "id long, text string"), "id")
    heads = N.parents(N.headings(rows, "id"), "id").orderBy("line").collect()
    assert [(h["title"], h["level"], h["parent"]) for h in heads] == [("A", 1, None), ("B", 2, 0), ("C", 3, 4), ("D", 2, 0)]
    note = "> [!quote]+ one\n> first\n> second\n\n> [!note] two\n> third"
    rows = N.lines(spark.createDataFrame([(1, note)], "id long, text string"), "id")
    assert [(r["kind"], r["text"]) for r in N.callouts(rows, "id").orderBy("first").collect()] == [("quote", "first second"), ("note", "third")]


def test_folds():
    assert [len(x) for x in N.split_long("A" * 400 + "。" + "B" * 500, 800)] == [800, 101]  # not in the upper half
    assert [len(x) for x in N.split_long("A" * 401 + "。" + "B" * 500, 800)] == [402, 500]
    assert len(N.chunk_paragraphs([("p0", "short")])) == 1
    two = N.chunk_paragraphs([("p0", "x" * 150), ("p1", "y" * 200), ("p2", "z" * 10)])
    assert [x[:2] for x in two] == [("p0", ["p0", "p1"]), ("p1", ["p1", "p2"])]
    assert N.group_pages([10, 10, 10], 20, 1) == [(0, 1), (0, 2), (1, 3)] and N.group_pages([], 5) == [(0, 0)]


def test_metrics(spark):
    hits = spark.createDataFrame([(0, i, i) for i in range(1, 11)], "q long, id long, rank long")
    rel = spark.createDataFrame([(0, 2), (0, 7)], "q long, id long")
    r = Q.retrieval_metrics(hits, rel, "q", "id").first()
    assert (r["mrr"], r["hit5"], r["hit10"]) == (0.5, 1, 1)
    assert abs(r["ndcg5"] - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-6
