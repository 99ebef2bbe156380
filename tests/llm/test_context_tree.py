"""Scores against a plain weighting: probabilities with and without the byte, by recursion over all contexts."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("lectern.llm")

from lectern.llm import context_tree as X
from lectern.llm import queries

SF = "/root/testdata/sf0.001"


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Plain:
    """Counts of each decision in each context; weighted probabilities by their definition."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.kids = depth, Counter(), defaultdict(set)
        for t in texts:
            t = b"\xff" * depth + t + b"\xff"
            for i in range(depth, len(t)):
                for node, bit in self.decisions(t[i]):
                    for d in range(depth + 1):
                        context = t[i - d : i]
                        self.n[context, node, bit] += 1
                        if d:
                            self.kids[context[1:], node].add(context)

    @staticmethod
    def decisions(byte):
        return [((1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1) for j in range(8)]

    def log(self, context, node, more=None):
        """Log weighted probability; more = (context of full length, bit) counts one decision on top."""
        a, b = self.n[context, node, 0], self.n[context, node, 1]
        on = more is not None and more[0].endswith(context)
        if on:
            a, b = a + (more[1] == 0), b + (more[1] == 1)
        if len(context) == self.depth:
            return kt(a, b)
        kids = set(self.kids[context, node])
        if on:
            kids.add(more[0][len(more[0]) - len(context) - 1 :])
        own, below = kt(a, b), sum(self.log(k, node, more) for k in kids)
        high = max(own, below)
        return math.log(0.5) + high + math.log(math.exp(own - high) + math.exp(below - high))

    def score(self, text):
        t, out = b"\xff" * self.depth + text + b"\xff", 0.0
        for i in range(self.depth, len(t)):
            for node, bit in self.decisions(t[i]):
                out += self.log(b"", node, (t[i - self.depth : i], bit)) - self.log(b"", node)
        return out / math.log(10)


@pytest.mark.parametrize("depth", [5, 3, 2])
def test_equal_to_plain_weighting(spark, depth):
    texts = ["the cat sat on the mat", "the cat ate", "", "ätsch", "The THE the", None, "zebra zebra", "the cat sat on the mat"]
    learn = [True, True, True, True, False, True, False, True]
    df = spark.createDataFrame(list(zip(range(8), texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in X.score_documents(df, ~F.col("doc_id").isin(4, 6), depth=depth, block=16).collect()}
    raw = [(t or "").encode().lower() for t in texts]
    model = Plain([t for t, yes in zip(raw, learn) if yes], depth)
    for i, t in enumerate(raw):
        assert got[i]["score"] == pytest.approx(model.score(t), abs=1e-6)
        assert got[i]["bits_per_byte"] == pytest.approx(-got[i]["score"] * math.log2(10) / (len(t) + 1))


def test_probabilities_add_up():
    """All 256 bytes after one context have probability one together."""
    import numpy as np

    raw, begin, size = X.joined([b"abracadabra", b"abba"], 3)
    seen = np.concatenate([g for g, _ in X.grams(raw, begin, size, 3)])
    asked = (int(seen[4]) >> 8 << 8) + np.arange(256)
    g, n = X.counted(np.concatenate((seen, asked)), np.concatenate((np.ones(len(seen), np.int64), np.zeros(256, np.int64))))
    tree = X.Subtree(g, n, 3, 0)
    p = 10 ** tree.scores(np.zeros(len(tree.roots()[0])), np.ones(len(tree.roots()[0])))
    assert p[np.searchsorted(g, asked)].sum() == pytest.approx(1)


def test_registered_base_columns(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode().lower() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    count = Counter()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    for i, t in docs.items():
        if not held[i]:
            count.update([*t.split(), b" "])
    total, distinct = sum(count.values()), len(count)
    rows = queries.QUERIES["op13_lm_score"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = [*docs[r["doc_id"]].split(), b" "]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(words), sum(w in count for w in words), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words))
        assert r["score"] < 0


def test_edges(spark):
    schema = "doc_id string, text string, DOC_ID int, Text int"
    assert X.score_documents(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    rows = [("a", "x" * 300_000, 1, 1), ("a", "x" * 300_000, 1, 1), (None, None, None, None)]
    got = X.score_documents(spark.createDataFrame(rows, schema), F.lit(True)).collect()
    assert len(got) == 3 and got[0]["score"] == got[1]["score"] and got[0]["bits_per_byte"] < 0.01
    none = X.score_documents(spark.createDataFrame(rows[2:], schema), F.lit(False)).collect()[0]
    assert none["score"] == pytest.approx(8 * math.log10(0.5)) and none["base_score"] == 0 and none["n_known"] == 0
