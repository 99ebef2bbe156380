"""The registered queries opN at the smallest scale, over whole tables, against plain versions of their contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

pytest.importorskip("lectern.llm")

from lectern.llm import queries
from lectern.llm.token_counts import vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got, places = {}, defaultdict(list)
    for r in rows(spark, "op1_best_fit_packing"):
        got[r["doc_id"], r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    want = {}
    for i, x in texts.items():
        ids = t.encode(x, add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), 2048):
            cut = ids[p : p + 2048]
            want[i, p // 2048] = (p, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))
    assert got == want
    for own in places.values():
        ends = np.cumsum([0] + [n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == ends[:-1].tolist() and ends[-1] <= 2048
    total = sum(n for _, n, _ in want.values())
    assert len(places) <= 1.25 * -(-total // 2048) + 1


def test_op2(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(spark, "op2_token_counts")}
    assert got == {i: (len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 1024) for i, x in texts.items()}


def test_op3(spark, texts):
    def plain(text):
        w = WORD.findall(text)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = Counter(windows)
        repeated = len({k for i, x in enumerate(windows) if many[x] > 1 for k in range(i, i + 8)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, len(w) < 20 or 100 * repeated > 30 * len(w)

    for r in rows(spark, "op3_quality_rules"):
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_op4(spark, texts):
    phrases = {("the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    for r in rows(spark, "op4_license_scan"):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r["doc_id"]]))
        at = [(i, p) for p in phrases for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        first, last = (min(i for i, _ in at), max(i for i, _ in at)) if at else (None, None)
        base = sorted({phrases[p] for _, p in at})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), first, last, ",".join(base))
        labels = [x for x in r["labels"].split(",") if x]
        assert labels == sorted(set(labels)) and set(base) <= set(labels) and 0 <= r["score"] <= 1


def test_op5(spark):
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        talks[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    talks[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in rows(spark, "op5_chat_format")}
    assert set(got) == set(talks)
    for i, own in talks.items():
        own = [x[1:] for x in sorted(own)]
        loss = "".join(t for role, t in own if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (len(own), digest("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), digest(loss))
        assert tuple(got[i][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want
        assert got[i]["formatted_chars"] >= sum(len(t) for _, t in own)


@pytest.mark.parametrize("name, label, modulus, rest, threshold", [("op6_quality_model", "quality", 5, 0, 0.3), ("op10_toxicity", "toxic", 3, 1, 0.7)])
def test_models(spark, texts, name, label, modulus, rest, threshold):
    got = {r["doc_id"]: r for r in rows(spark, name)}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)


def test_op7(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    plain = lambda x: " ".join(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", x.lower()))
    bare = {i: f" {plain(x)} " for i, x in texts.items()}
    want = {(d, i) for i, x in items.items() for d, t in bare.items() if f" {plain(x)} " in t}
    found = rows(spark, "op7_decontamination")
    assert {(r["doc_id"], r["item_id"]) for r in found if r["distance"] == 0} == want and want
    assert all(r["similarity"] >= 0.8 for r in found)


def test_op8(spark, texts):
    fps = {}
    for i, x in texts.items():
        w = lower(x).encode().split()
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        ones = np.zeros(64, int)
        for b in s:
            h = xxhash.xxh64_intdigest(b, 42)
            ones += np.array([h >> k & 1 for k in range(64)])
        fps[i] = sum(1 << k for k in range(64) if 2 * ones[k] > len(s))
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op8_simhash_near_dedup")}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def test_op9(spark):
    """Every assignment of a long hexadecimal value to a telling name in the documents is found, at its place. The
    smallest tables hold none, so these are the next ones."""
    larger = SF.replace("sf0.001", "sf0.01")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text").collect()}
    want = {(i, m.start(1), len(m[1])) for i, x in texts.items() for m in re.finditer(r"(?i)(?:token|password|secret|api_key)[\"']?\s*[:=]\s*[\"']?([0-9a-f]{16,})", x)}
    got = {(r["doc_id"], r["start"], r["length"]) for r in queries.op9_secret_scan(spark, larger).collect()}
    assert want and want <= got and len(got) <= 1.2 * len(want)
