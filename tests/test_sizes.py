"""Work that grows with the rows, not with their pairs, and whole results all the same: against plain loops."""

import random
import re

from lectern.operators import best_blocks as K
from lectern.operators import lexical as L
from lectern.operators import links as W
from lectern.operators import reading as R
from lectern.operators import vectors as V


def most_rows(df) -> int:
    """The most rows that an operator of df's plan puts out."""
    df.collect()

    def rows(p) -> int:
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return rows(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return rows(p.plan())
        own, kids = p.metrics().get("numOutputRows"), p.children()
        return max([own.get().value() if own.isDefined() else 0] + [rows(kids.apply(i)) for i in range(kids.size())])

    return rows(df._jdf.queryExecution().executedPlan())


def plain_repair(w, known):
    """The known block for one wanted block, by looking at each."""
    bare = lambda x: re.sub("^p", "", x)
    number = lambda x: int(m[0]) if (m := re.findall(r"[0-9]+", x)) else None
    found = []
    for o, k in known:
        if w == k:
            found.append((0, 0, o, k))
        elif k.startswith(bare(w)) or bare(w).startswith(bare(k)):
            found.append((1, 0, o, k))
        elif number(k) is not None and number(w) is not None:
            found.append((2, abs(number(k) - number(w)), o, k))
    return min(found)[3] if found else None


def test_repaired_blocks(spark):
    """jn27_block_repair: odd ids against a plain loop; a large group's rows are not paired."""
    r = random.Random(4)
    some = lambda: r.choice(["p", "", "pp", "x-", "p0", "p1", "10", "p 7"]) + r.choice(["", "", "y", "7z"] + [str(r.randrange(120))] * 6)
    wanted = [(r.randrange(3), i, some()) for i in range(300)] + [(9, 300, "p1"), (None, 301, "p1"), (0, 302, None)]
    known = [(r.randrange(3), i, some()) for i in range(60)] + [(None, 60, "p1"), (0, 61, None)]
    got = W.repaired_blocks(spark.createDataFrame(wanted, "a long, k long, b string"), spark.createDataFrame(known, "a long, o long, b string"), "a", "k", "b", "o")
    want = {k: x for a, k, b in wanted if a is not None and b is not None and (x := plain_repair(b, [(o, c) for g, o, c in known if g == a and c is not None])) is not None}
    assert {x["k"]: x["b"] for x in got.collect()} == want
    ids = [(0, i, f"p{i:05d}") for i in range(4_000)]
    many = W.repaired_blocks(spark.createDataFrame([(a, i, b + "5") for a, i, b in ids], "a long, k long, b string"), spark.createDataFrame(ids, "a long, o long, b string"), "a", "k", "b", "o")
    assert most_rows(many) < 100_000 and many.count() == 4_000


def plain_similarity(a, b):
    """As ``similarity.string_similarity`` defines it."""
    x, y, most = a.lower(), b.lower(), max(len(a), len(b), 1)
    if a == b:
        return 1.0
    return round(min(len(a), len(b)) / most if y in x or x in y else sum(c in y for c in x) / most, 6)


def test_best_similar(spark):
    """jn26_best_similar: against a plain loop; rows of equal texts are compared once."""
    r = random.Random(6)
    some = lambda: "".join(r.choice("abAB c") for _ in range(r.choice([0, 1, 2, 5, 9, 30])))
    a, b = [(i, some()) for i in range(120)] + [(500, None)], [(i, some()) for i in range(200, 300)] + [(501, None)]
    got = R.best_similar(spark.createDataFrame(a, "k long, x string"), spark.createDataFrame(b, "k2 long, x string"), "k", "k2", "x")
    want = {}
    for k, x in a[:-1]:
        best = max((plain_similarity(x, y), -k2) for k2, y in b[:-1])
        if best[0] > 0.4:
            want[k] = (-best[1], best[0])
    assert {x["k"]: (x["k2"], x["similarity"]) for x in got.collect()} == want
    many = R.best_similar(spark.range(3_000).selectExpr("id AS k", "concat('name ', id % 7) AS x"), spark.range(5_000).selectExpr("id AS k2", "concat('type name ', id % 5) AS x"), "k", "k2", "x")
    assert most_rows(many) <= 3_000 and many.count() == 3_000


def test_best_blocks(spark):
    """jn30_best_block: against a plain loop, with ties, repeats, odd characters and empty texts; no pair goes through a shuffle."""
    r = random.Random(7)
    some = lambda n: "".join(r.choice("abcd \n好的𝒳é") for _ in range(n))
    contexts = [(i, some(r.choice([0, 1, 3, 20, 60]))) for i in range(50)] + [(90, None)]
    blocks = [(i, -(i % 7) if i < 40 else i, some(r.choice([0, 1, 2, 3, 9, 300]))) for i in range(400)] + [(900, 0, None)]
    bare = lambda x: re.sub(r"[ \n]+", "", x or "")
    pairs = lambda x: [x[i : i + 2] for i in range(len(x) - 1)]
    blocks = [(b, o * 1000 + b, x) for b, o, x in blocks]
    want = {}
    for k, c in contexts:
        has = set(pairs(bare(c)))
        every = [(-sum(g in has for g in p) / len(p), o, b) for b, o, x in blocks if (p := pairs(bare(x)))]
        best = min(every)
        if best[0] < 0:
            want[k] = (best[2], round(-best[0], 6))
    c, b = spark.createDataFrame(contexts, "k long, c string"), spark.createDataFrame(blocks, "b long, o long, x string")
    got = K.best_blocks(c, b.repartition(3), "k", "c", "b", "o", "x")
    assert {x["k"]: (x["b"], x["score"]) for x in got.collect()} == want
    assert most_rows(K.best_blocks(c, b, "k", "c", "b", "o", "x")) <= len(blocks) and K.best_blocks(c.limit(0), b, "k", "c", "b", "o", "x").count() == 0


def test_stored_search(spark, tmp_path):
    """rt2_bm25_search and those that search alike: the rows of a full scoring, equals included, from an index of many
    parts; what a search moves does not grow with queries times nodes."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["好", "a的b"]
    rows = [(f"n{i}", " ".join(r.choice(words[: r.choice([3, 42])]) for _ in range(r.choice([0, 3, 12])))) for i in range(2_000)] + [("none", None)]
    nodes = spark.createDataFrame(rows, "node string, text string")
    queries = spark.createDataFrame([(i, " ".join(r.sample(words, 4))) for i in range(60)] + [(90, "unknown"), (91, "")], "q int, text string")
    L.write_index(nodes, "node", f"{tmp_path}/index", 4, 8)
    stored, fresh = L.read_index(spark, f"{tmp_path}/index"), L.index_of(nodes, "node")
    for of in ("postings", "terms"):
        columns = sorted(getattr(fresh, of).drop("bucket").columns)
        assert sorted(map(tuple, getattr(stored, of).select(columns).collect())) == sorted(map(tuple, getattr(fresh, of).select(columns).collect()))
    want = sorted(map(tuple, L.top(L.bm25_scores(fresh, queries, "node", "q"), "q", "node", 10).select("q", "node", "score", "rank").collect()))
    found = L.bm25_search(stored, queries, "node", "q", 10)
    assert sorted(map(tuple, found.select("q", "node", "score", "rank").collect())) == want
    assert most_rows(L.bm25_search(stored, queries, "node", "q", 10)) < stored.postings.count() + 2_000
    assert L.bm25_search(stored, queries.where("q > 89"), "node", "q").count() == 0


def test_vectors(spark):
    """tk2_cosine_search, tk4_level_fallback, ag6_chunk_pooling: against plain loops, with ties, other dimensions, vectors
    without length and null components; pairs are no rows."""
    r = random.Random(9)
    some = lambda: [float(r.randrange(-2, 3)) for _ in range(4)]
    rows = [(i, some() if i % 50 else [0.0] * 4, "L2" if i % 3 == 0 else "L1") for i in range(400)] + [(900, [1.0], "L2"), (901, None, "L2"), (902, [1.0, None, 0.0, 0.0], "L1")]
    asked = [(i, some()) for i in range(30)] + [(90, [0.0] * 4), (91, [1.0]), (92, None)]
    cosine = lambda a, b: 0.0 if not (n := (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5) else round(sum(x * y for x, y in zip(a, b)) / n, 6)
    pairs = [(q, i, None if None in v else cosine(v, w), at) for q, w in asked if w for i, v, at in rows if v and len(v) == len(w)]
    v, q = spark.createDataFrame(rows, "id int, vector array<float>, level string"), spark.createDataFrame(asked, "q long, vector array<float>")
    order = lambda x: str(x)
    same = lambda got, want: sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    plus = lambda s: None if s is None else s + 0.0
    pairs = [(q_, i, plus(s), at) for q_, i, s, at in pairs]
    got = V.cosine_scores(v, q, "id", "q", block=7)
    assert sorted(((x["q"], x["id"], plus(x["score"])) for x in got.collect()), key=order) == sorted((p[:3] for p in pairs), key=order)
    best = []
    for k in {p[0] for p in pairs}:
        best += [(k, p[1]) for p in sorted((p for p in pairs if p[0] == k), key=lambda p: (p[2] is None, -(p[2] or 0.0), p[1]))[:7]]
    assert same(V.cosine_search(v, q, "id", "q", 7).select("q", "id"), best)
    over = [p for p in pairs if p[2] is not None and p[2] > 0.9]
    some_ = {p[0] for p in over if p[3] == "L2"}
    assert same(V.level_fallback(v, q, "id", "q", 0.9), [p for p in over if p[3] == "L2" or p[0] not in some_])
    groups = {}
    for k, _, s, at in pairs:
        groups.setdefault((k, at), []).append(s)
    pooled = {(x["q"], x["level"]): (plus(x["score"]), x["chunks"]) for x in V.pooled_scores(v, q, "level", "q").collect()}
    assert pooled == {k: (max((x for x in s if x is not None), default=None), len(s)) for k, s in groups.items()}
    large = spark.range(20_000).selectExpr("id", "transform(sequence(1, 16), x -> cast(sin(id * x) as float)) AS vector", "id % 5 AS level")
    stated = large.where("id % 50 = 0").selectExpr("id AS q", "vector")
    assert most_rows(V.cosine_search(large, stated, "id", "q")) < 400_000 and most_rows(V.pooled_scores(large, stated, "level", "q")) < 400_000
