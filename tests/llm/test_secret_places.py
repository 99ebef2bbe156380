"""Values of every form at their exact places, what is said about secrets left alone, and the forest against plain trees."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lectern.llm")

from lectern.llm import secret_scan as S

R = random.Random(3)
ALNUM = string.ascii_letters + string.digits
TOKEN = "".join(R.choice(ALNUM) for _ in range(30))
SHORT = "aR7k!w9Qz#x2Lm"
LINES = "\n".join("".join(R.choice(ALNUM + "+/") for _ in range(64)) for _ in range(5))
CASES = [
    ("SECRET_KEY=", TOKEN[:20], ""), ("DB_PASSWORD=", TOKEN, ""), ("export AWS_SECRET_ACCESS_KEY=\"", TOKEN, '"'), ("GITLAB_TOKEN=", "glpat-" + TOKEN[:20], ""), ("my_api_key_live: ", TOKEN, ""),
    ("DATABASE_URL=postgres://admin:", "s3cr3tPw9xQ", "@host/db"), ("Authorization: Bearer ", TOKEN[:24], ""), ("the password is ", SHORT, ""), ('secret="', "correct horse battery staple", '"'),
    ("x ", "-----BEGIN RSA PRIVATE KEY-----\n" + LINES, ""), ("x ", "-----BEGIN PRIVATE KEY-----\n" + LINES + "\n-----END PRIVATE KEY-----", " y"),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_exact_place(spark, case):
    before, value, after = CASES[case]
    text = f"here {before}{value}{after}"
    df = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    got = [(r["start"], r["length"], r["value"]) for r in S.scan(df).collect()]
    assert got == [(len(f"here {before}"), len(value), value)]
    out = S.redacted(df, length="n_chars").first()
    assert out["text"] == f"here {before}[secret]{after}" and out["n_chars"] == len(out["text"])


def test_talk_about_secrets_stays(spark):
    rows = ["the password is required for it", "a token is something else", "https://user:password@example.com/x", "say -----BEGIN PRIVATE KEY----- and go on", 'password="enter your password here"', "secretary: Miss Moneypenny", "the bearer of good news arrived yesterday"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert S.scan(df).collect() == []
    assert sorted((r["doc_id"], r["text"]) for r in S.redacted(df).collect()) == list(enumerate(rows))


def test_forest_equals_plain_trees(spark):
    """The compiled expression gives the mean of the trees' leaves."""
    trees, texts = S.forest(), S.labelled_findings(200, 41)
    d = S.with_candidates(spark.createDataFrame(texts, "text string, secret int"), "text").select("text", F.explode("_found").alias("f"))
    want = {}
    for r in d.select("text", *[F.col("f")[n] for n in S.FEATURES]).collect():
        leaves = []
        for tree in trees:
            while not isinstance(tree, float):
                f, cut, low, high = tree
                tree = low if r[1 + f] <= cut else high
            leaves.append(tree)
        want.setdefault(r[0], []).append(round(float(np.mean(leaves)), 6))
    rows = spark.createDataFrame([(t, t) for t, _ in texts], "doc_id string, text string")
    got = {}
    for r in S.scan(rows, threshold=0.0).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert {t: sorted(x) for t, x in got.items()} == {t: pytest.approx(sorted(x), abs=2e-6) for t, x in want.items()}


def test_clashing_names_and_empty_table(spark):
    kind = "doc_id long, text string, Text string, DOC_ID string, f string, finding int"
    one = spark.createDataFrame([(1, f"api_key={TOKEN}", "x", "y", "z", 3), (2, None, None, None, None, None)], kind)
    assert [r["value"] for r in S.scan(one).collect()] == [TOKEN]
    assert S.scan(one.limit(0)).count() == 0 and S.redacted(one).columns == one.columns
