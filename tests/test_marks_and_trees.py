"""Position-carrying text functions and folds, on small cases."""

from pyspark.sql import functions as F

from lectern.functions import marks as K
from lectern.operators import trees as R


def test_matches():
    assert K.fuzzy_matches("aaa", "aa") == [(0, 2, "exact"), (1, 3, "exact")]
    text = "so **bold** [[x|words]] here"
    assert [(text[a:z], h) for a, z, h in K.fuzzy_matches(text, "bold words")] == [("bold** [[x|words", "stripped")]
    assert K.fuzzy_matches("A, b! C", "a b c")[0][2] == "bare"
    assert K.fuzzy_matches("", "x") == [] and K.fuzzy_matches("x", "") == []
    assert K.already_marked("<mark>text", 6)


def test_links():
    assert K.insert_links("Deep Learning and deep; `Deep`", ["Deep", "Deep Learning"]) == "[[Deep Learning]] and deep; `Deep`"
    assert K.balanced_links("[[a]] [[b]]") and not K.balanced_links("[[a [[b]]") and not K.balanced_links("a]]")
    assert K.block_context("one\ntwo ^b1\nthree", "b1", 3) == "one\ntwo ^b1"


def test_json():
    assert K.first_array('x [1, "]", [2]] y') == '[1, "]", [2]]'
    got = K.cards('[{"answer": "a"}, {"answer": ""}, {"answer": "b", "type": "t", "tags": ["x"]}]')
    assert [(c["id"], c["type"]) for c in got] == [("card_001", "概念"), ("card_002", "t")]
    assert K.front_matter("---\na: 1\ntags: [x, y]\nlist:\n  - p\n  - q\n---\n") == {"a": "1", "tags": "x,y", "list": "p,q"}
    assert K.reading_segments("One. Two. Three.\n\nFour", 9) == ["One. Two.", "Three.", "Four"]


def test_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert [tuple(x) for x in one(K.split_blocks(F.lit("first ^a1\nsecond ^a2")))] == [("a1", "first"), ("a2", "second")]
    assert tuple(one(K.page_marks(F.lit("<start_index_3> x <start_index_9>")))) == (3, 9)
    assert one(K.dotted_leaders(F.lit("Intro........12"))) == "Intro: 12"
    assert [tuple(x) for x in one(K.labelled_facts(F.lit("[likes] a；b\nno\n[age] 3")))] == [("likes", "a"), ("likes", "b"), ("age", "3")]
    assert one(K.title_kind(F.lit("第三章 x"))) == "chapter" and one(K.title_kind(F.lit("Preface"))) == "special"
    assert one(K.moved_links(F.lit("[[a.b]] [[a.b|c]] [[axb]]"), "a.b", "new")) == "[[new]] [[new|c]] [[axb]]"
    d = spark.createDataFrame([("so **bold** x", "bold x")], "t string, p string")
    assert d.select(K.match_column(F.col("t"), F.col("p")).alias("m")).first()["m"][0]["how"] == "stripped"


def test_folds(spark):
    assert R.thin([1, 2, 2, 1], [10, 1, 1, 100], 50) == [0, 0, 0, 3]
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 6, 7, 20, 1])], "d long, o long, n long")
    got = [r["batch"] for r in R.size_batches(rows, "d", "o", "n", 12).orderBy("o").collect()]
    assert got == [0, 0, 1, 2, 3]
    ys = spark.createDataFrame([(1, i, y) for i, y in enumerate([0.0, 2.0, 4.0, 10.0])], "d long, o long, y double")
    assert [r["line_no"] for r in R.grouped_lines(ys, "d", "o", "y").orderBy("o").collect()] == [0, 0, 1, 2]
    pages = spark.createDataFrame([(1, "# a\nx\n# b\ny"), (2, "short")], "p long, text string")
    assert R.split_at_headings(pages, "p", 2).where("p = 1").count() == 2
