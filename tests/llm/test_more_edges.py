"""Empty tables, clashing names and long texts where they were not covered; toxicity scores by plain loops."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lectern.llm")

from lectern.llm import best_fit_packing, chat_format, decontamination, license_scan, quality_model, quality_rules, token_counts, toxicity
from lectern.llm.text_arrays import ODD
from lectern.llm.token_counts import vocabulary

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, Text string, DOC_ID int, score string"
BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
LABELS = "doc_id long, quality int, toxic int"


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOC), spark.createDataFrame([], LABELS)
    assert token_counts.count_tokens(none, BYTE).count() == 0
    assert quality_rules.judge(none, labels).count() == 0
    assert license_scan.scan(none).count() == 0
    items = spark.createDataFrame([(1, "some words that stand in no text at all, since there is no text")], "item_id long, text string")
    assert decontamination.contaminated(none, items).count() == 0
    some = spark.createDataFrame([(1, "a text of its own " * 9, "en", "s", 9)], DOC)
    assert decontamination.contaminated(some, items.limit(0)).where("item_id is not null" if "item_id" in decontamination.contaminated(some, items.limit(0)).columns else "false").count() == 0


def test_clashing_names(spark):
    rows = [(1, "under the mit license, we say hello to you all", "en", "s", 5, "other", 7, "z"), (2, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, CLASH)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, BYTE).collect()}[2] == 0
    assert "mit" in {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()}[1].split(",")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], LABELS)
    assert quality_model.score_documents(df, labels, F.lit(True)).count() == 2
    assert toxicity.score_documents(df, labels, F.lit(True)).count() == 2
    chat = spark.createDataFrame([(1, 0, "user", "hi", "x", "y"), (1, 1, "assistant", "yo", "x", "y")], "conv_id long, turn long, role string, text string, Text string, ROLE string")
    got = chat_format.read_back(chat_format.blocks(chat, BYTE)).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got] == [(1, 2, 2)]


def test_very_long_texts(spark):
    words = "word " * 60_000
    df = spark.createDataFrame([(1, words + "mit license " + words, "en", "s", 1)], DOC)
    r = license_scan.scan(df).first()
    assert r["n_words"] == 120_002 and r["first_word"] is None or r["first_word"] >= 60_000
    chat = spark.createDataFrame([(1, 0, "user", words), (1, 1, "assistant", words)], "conv_id long, turn long, role string, text string")
    assert [r["loss_chars"] for r in chat_format.read_back(chat_format.blocks(chat, BYTE)).collect()] == [len(words)]


def test_packing_ties(spark):
    """Equal documents fill sequences whole, each piece in a place of its own."""
    df = spark.createDataFrame([(i, "one two three four five six seven", "en", "s", 1) for i in range(600)], DOC)
    rows = best_fit_packing.packed(df, WORD).collect()
    size = rows[0]["length"]
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == 600 and len(by) == -(-600 // (2048 // size))
    assert all([o for o, _ in sorted(v)] == [i * size for i in range(len(v))] for v in by.values())


def plain_score(text, weight, bias):
    """Every bag's mean and every passage by loops over words and grams."""
    raw = (text or "").encode()
    letters = lambda b: 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128
    marked = [(b + 32 if 65 <= b < 91 else b) if letters(b) else 0 for b in raw] + [0]

    def mixed(h):
        h ^= h >> 31
        h = h * 0xBF58476D1CE4E5B9 % 2**64
        return h ^ (h >> 29)

    def span(a, z):
        return sum((marked[i] + 1) * pow(ODD, i - a, 2**64) for i in range(a, z)) % 2**64

    bags = []
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw):
        low, high = max(m.start() - 1, 0), min(m.end() + 1, len(marked))
        bag = [mixed(span(m.start(), m.end()))]
        for n in toxicity.GRAMS:
            bag += [mixed((span(i, i + n) + n) % 2**64) for i in range(low, high - n + 1)]
        bags.append([weight[h % len(weight)] for h in bag])
    if not bags:
        return 1 / (1 + np.exp(-bias))
    size, step, best = toxicity.PASSAGE, toxicity.PASSAGE // 2, -np.inf
    many = max(1, -(-(len(bags) - size) // step) + 1)
    for k in range(many):
        a = min(k * step, max(len(bags) - size, 0))
        own = [w for bag in bags[a : a + size] for w in bag]
        best = max(best, sum(own) / len(own))
    return 1 / (1 + np.exp(-np.clip(best + bias, -60, 60)))


def test_toxicity_by_loops():
    rng = np.random.default_rng(1)
    weight = rng.normal(0, 3, 1 << 12)
    texts = ["You absolute FOOL", "a b c d e f g h i j k l m", "", None, "naïve Ünïcode wörds!", "one", "x-y z_9 ... 42", "the quick brown fox jumps over the lazy dog again and again"]
    # Each text by itself: what stands before a text's first word is the text's own beginning.
    got = [float(toxicity.scores([t], weight, -1.5)[0]) for t in texts]
    assert got == pytest.approx([plain_score(t, weight, -1.5) for t in texts], abs=1e-9)
    assert toxicity.scores(texts, weight, -1.5).shape == (len(texts),)


def test_contract_phrases(spark, tmp_path):
    """op4's first phrase is "under the mit license"; places that overlap all count, also of phrases given."""
    from lectern.llm import queries

    rows = [(1, "Used under the MIT License."), (2, "the mit license alone"), (3, "x the mit license, under-the MIT license under the mit license"), (4, "under the mit licenses")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in queries.QUERIES["op4_license_scan"](spark, str(tmp_path)).collect()}
    assert got == {1: (5, 1, 1, 1, "mit"), 2: (4, 0, None, None, ""), 3: (12, 2, 4, 8, "mit"), 4: (4, 0, None, None, "")}
    some = license_scan.scan(spark.createDataFrame([(1, "Ding dong ding dong ding bell")], "doc_id long, text string"), phrases={"ding dong ding": "ding", "bell": "bell"}).first()
    assert tuple(some[c] for c in columns) == (6, 3, 0, 5, "bell,ding")


def test_common_windows_alone(spark):
    """Items of one beginning, of which a passage keeps little but that beginning: common keys are looked up as well."""
    import random

    import pyarrow as pa

    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 8)))
    head = " ".join(word() for _ in range(14))
    tails = [" ".join(word() for _ in range(17)) for _ in range(decontamination.HOT + 20)]
    items = [f"{head} {t}" for t in tails]
    texts = [f"{word()} {head} {''.join('z' if k % 3 == 0 and c != ' ' else c for k, c in enumerate(t))} {word()}" for t in tails]
    near = [i for i, t in enumerate(texts) if decontamination.distance(items[i], t)[0] <= 0.2 * len(items[i])]
    assert len(near) > 40
    got = dict(decontamination._found(decontamination.Index(items, 0.8), pa.array(texts)))
    assert all(i in got.get(i, {}) for i in near)
    # Runs of any size give the same.
    decontamination.RUN, run = 100, decontamination.RUN
    try:
        assert dict(decontamination._found(decontamination.Index(items, 0.8), pa.array(texts))) == got
    finally:
        decontamination.RUN = run


def test_short_items(spark):
    """Items of any length are found, as brute force finds them; so are texts of few characters and many words."""
    import random

    import pyarrow as pa

    r = random.Random(6)
    some = lambda n: " ".join("".join(r.choice("abcdé日本   ") for _ in range(n)).split())
    plain = lambda t: " ".join(decontamination.WORD.findall(t.lower()))
    items = sorted({plain(some(r.randint(2, 31))) for _ in range(40)} - {""})
    items = [t for t in items if len(t) < decontamination.LEAST]
    texts = [some(r.randint(0, 120)) for _ in range(40)] + ["", None] + [f"{some(20)} {t[:-1]}a {some(20)}" for t in items] + items
    got = dict(decontamination._found(decontamination.Index(items, 0.8), pa.array(texts, pa.string()), block_chars=300))
    want = {d: {i: x for i, t in enumerate(items) if (x := decontamination.distance(t, plain(text or ""))[0]) <= int(0.2 * len(t) + 1e-9)} for d, text in enumerate(texts)}
    assert {d: {i: x for i, (x, _, _) in own.items()} for d, own in got.items()} == {d: own for d, own in want.items() if own}
    rows = spark.createDataFrame([(1, "They say the Capital of France is Paris, no doubt"), (2, "他说数据库系统概念与设计实现方法很好"), (3, "nothing of it"), (None, None)], "doc_id long, text string")
    it = spark.createDataFrame([(7, "the capital of France is Pariz"), (8, "数据库系统概念与设计实现方法"), (9, "?!"), (10, None)], "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]): x for x in decontamination.contaminated(rows, it).collect()}
    assert set(found) == {(1, 7), (2, 8)} and (found[1, 7]["distance"], found[1, 7]["start"], found[1, 7]["end"]) == (1, 9, 39)
    assert sorted(x["doc_id"] or 0 for x in decontamination.clean(rows, it).collect()) == [0, 3]
