"""The pipeline at the smallest scale, stage by stage, and against plain versions of its decisions."""

import pytest

pytest.importorskip("lectern.llm")

import corpus_pipeline
from lectern.llm._shared import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secrets", "packing"]


def test_decisions(spark, stages):
    texts = [{r["doc_id"]: r["text"] for r in s.select("doc_id", "text").collect()} for s in stages[:-1]]
    for before, after in zip(texts[:3], texts[1:4]):
        assert set(after) <= set(before) and all(before[i] == t for i, t in after.items())
    assert set(texts[4]) == set(texts[3])
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i, t in texts[2].items() if any(x in t for x in items)}
    assert not held & set(texts[3])
    copies = {}
    for i, t in texts[1].items():
        copies.setdefault(t, []).append(i)
    for own in copies.values():
        assert len(set(own) & set(texts[2])) <= 1 and not (set(own) - {min(own)}) & set(texts[2])
    changed = [i for i, t in texts[4].items() if t != texts[3][i]]
    assert all("[secret]" in texts[4][i] for i in changed)


def test_packed_whole(stages):
    last = stages[-1].collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in stages[-2].select("doc_id").collect()}
    ends = {}
    for r in sorted(last, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048


def test_edges(spark, tmp_path):
    """Nulls, repeated ids and rows, clashing names, empty tables through every stage."""
    from pyspark.sql import types as T

    r = __import__("random").Random(17)
    text = lambda: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(6)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (None, c), (3, None), (4, ""), (5, f'{text()} token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"'), (6, " ".join(text() for _ in range(60)))]
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("Text", T.StringType()), ("C0", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    docs = spark.createDataFrame([(i, t, None, None, len(t or ""), "other", 7) for i, t in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, c[20:200])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    every = [docs]
    for name, stage in corpus_pipeline.STAGES:
        every.append(written(stage(spark, every[-1], str(tmp_path)), name))
    assert all(x.columns == docs.columns for x in every[:-1])
    ids = [sorted((x[0] for x in d.collect()), key=str) for d in every[:-1]]
    assert ids[1] == sorted([1, 1, 2, None, None, None, 5, 6], key=str)
    assert ids[2] == sorted([1, None, None, 5, 6], key=str) and ids[3] == ids[4] == sorted([1, None, 5, 6], key=str)
    assert every[-1].count() >= 4 and any("[secret]" in x[1] for x in every[4].collect())
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = written(stage(spark, none, str(tmp_path)), name)
    assert none.count() == 0


def test_run_keeps_what_it_returns(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
