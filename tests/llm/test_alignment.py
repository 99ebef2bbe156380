"""Groups, links and corpus counts by loops over tokens, from the libraries' own tokens of whole texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lectern.llm")

from lectern.llm import alignment as L
from lectern.llm import queries
from lectern.llm.bpe_transducer import _unicode_bytes
from lectern.llm.token_counts import vocabulary

SF = "/root/testdata/sf0.001"
PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    return a, b


def plain(texts, libraries):
    """One tuple of figures a text."""
    a, b = libraries
    to_byte, out, counts = _unicode_bytes(), [], Counter()
    for t in texts:
        links, groups, spans = [], [], ([], [])
        if t:
            for k, ids in enumerate((a.encode(" " + t, add_special_tokens=False).ids, b.encode(t))):
                at = 0
                for i in ids:
                    if k:
                        p = b.id_to_piece(i)
                        x = bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
                    else:
                        x = bytes(to_byte[c] for c in a.id_to_token(i))
                    spans[k].append((at, at + len(x), i, x))
                    at += len(x)
            if any(b"".join(x for *_, x in s) != (" " + t).encode() for s in spans):
                spans = ([], [])
        for p, q, i, _ in spans[0]:
            links += [(i, j) for r, s, j, _ in spans[1] if r < q and p < s]
        shared = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        for low, high in zip([0, *shared], shared):
            groups.append("|".join(",".join(str(i) for p, q, i, _ in s if low <= p and q <= high) for s in spans))
        counts.update(links)
        out.append((len(spans[0]), len(spans[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(n_a, n_b, g, len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), sha) for n_a, n_b, g, x, sha in out]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_equal_to_loops(spark, libraries):
    texts = [
        "Hello world", "Hello world", " two  blanks ", "", None, "tabs\tand\n\nlines \n x", "naïve café 東京 😀 ok", "a<|endoftext|>b </s> <s> [INST]", "a ▁ b", "▁", " ", "\n", " no break 　 wide",
        "x" * 500, "don't we'll THEY'RE", "é combining", "1234567 8,9.0", "\x00 nul", "<0x41> <unk>", "zero​width", "ﬁne ½ Ⅷ", "end ",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in L.align(df, *PATHS, most=40).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, libraries)


def test_registered_query(spark, libraries):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    short = [r for r in rows if len(r["text"] or "") < 4000]
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in queries.QUERIES["op11_token_alignment"](spark, SF).collect()}
    assert len(got) == len(rows)
    want = plain([r["text"] for r in short], libraries)
    assert [(*got[r["doc_id"]][:4], got[r["doc_id"]][6]) for r in short] == [(*w[:4], w[6]) for w in want]


def test_edges(spark):
    schema = "doc_id string, text string, DOC_ID int, Text int"
    assert L.align(spark.createDataFrame([], schema), *PATHS).count() == 0
    none = L.align(spark.createDataFrame([(None, None, 1, 1), ("a", "", None, None)], schema), *PATHS).collect()
    assert sorted(tuple(r[n] for n in NAMES) for r in none) == [(0, 0, 0, 0, 0, 0, "")] * 2
    long = L.align(spark.createDataFrame([("a", "word " * 100_000, 1, 1)] * 2, schema), *PATHS).collect()
    assert len(long) == 2 and long[0] == long[1] and long[0]["n_best"] == long[0]["n_links"] > 100_000
    assert long[0]["count_sum"] > long[0]["n_links"]


def test_corpus_wide_columns(spark, libraries):
    """Counts over several slices and parts: ties of a B id's highest count are all best."""
    texts = ["alpha beta", "alphabeta beta", "beta beta gamma", "gam ma", "gamma"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_best"], r["count_sum"]) for r in L.align(df, *PATHS, most=10).collect()}
    assert [got[i] for i in range(len(texts))] == [w[4:6] for w in plain(texts, libraries)]


def test_decimals():
    digits, length = L._decimals()
    assert all(bytes(digits[i, : length[i]]) == str(i).encode() for i in np.random.default_rng(1).integers(0, 100_000, 500).tolist() + [0, 9, 10, 99_999])
