"""Sources, sinks and streams over files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.sources import files, sinks
from lectern.streaming import streams


def test_scan_notes(spark, tmp_path):
    for name, text in {"a/one.md": "x", "a/b/two.md": "y", ".trash/no.md": "z", "a/book.md": "---\ntype: pdf\n---\nq", "a/kept.md": "---\ntype: pdf\nindexed: true\n---\nq", "a/no.txt": "t"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r["path"]: r for r in files.scan_notes(spark, str(tmp_path)).collect()}
    assert set(got) == {"a/one.md", "a/b/two.md", "a/kept.md"}
    assert got["a/b/two.md"]["directory"] == "a/b" and len(got["a/one.md"]["hash"]) == 16
    assert files.scan_notes(spark, str(tmp_path), subdirectories=["a/b"]).count() == 1


def test_json_sources(spark, tmp_path):
    p = tmp_path / "v.jsonl"
    p.write_text('{"chunkId":"c","nodeId":"n","vector":[1.0]}\nbroken\n')
    assert files.json_lines(spark, str(p), files.VECTOR).count() == 1
    with pytest.raises(Exception):
        files.json_lines(spark, str(p), files.CARD_VECTOR, strict=True).collect()
    assert files.json_or_empty(spark, str(tmp_path / "none.json"), files.CHUNK).count() == 0
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.jsonl").write_text("\n".join(json.dumps(x) for x in [{"_type": "metadata", "id": "1", "title": "t"}, {"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]) + "\nbad\n")
    meta, messages = files.sessions(spark, str(tmp_path / "s"))
    assert meta.first()["title"] == "t" and [(r["seq"], r["content"]) for r in messages.orderBy("seq").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "h.txt").write_text("one\n\n---\n\ntwo\n\n---\n\nthree\n")
    assert [(r["seq"], r["entry"]) for r in files.history(spark, str(tmp_path / "h.txt"), 2).orderBy("seq").collect()] == [(1, "two"), (2, "three")]
    (tmp_path / "p1.json").write_text('{"a": 3, "b": 0}')
    (tmp_path / "p2.json").write_text('{"version": 2, "pages": {"a": {"page": 4, "lastReadAt": 9}}}')
    assert [tuple(r) for r in files.last_pages(spark, str(tmp_path / "p1.json")).collect()] == [("a", 3, 0)]
    assert [tuple(r) for r in files.last_pages(spark, str(tmp_path / "p2.json")).collect()] == [("a", 4, 9)]


def test_directories(spark):
    d = spark.createDataFrame([("book/_目录.md",), ("book/x.md",), ("log/2024-01-02.md",), ("log/2024-01-03.md",), ("mix/a.md",), ("root.md",)], "path string")
    assert {r["directory"]: r["kind"] for r in files.classified_directories(d).collect()} == {"book": "book", "log": "timeline", "mix": "mixed"}


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    p = str(tmp_path / "t")
    sinks.upsert_table(a, p, "k", "0001")
    to = sinks.upsert_table(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), p, "k", "0002")
    assert sorted(tuple(r) for r in spark.read.parquet(to).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    for n in (9, 10, 11):  # versions count, whatever the order of their names as text
        to = sinks.upsert_table(spark.createDataFrame([(n, "x")], "k long, v string"), str(tmp_path / "v"), "k", f"v{n}")
    assert spark.read.parquet(to).count() == 3
    note = sinks.directory_note(spark.createDataFrame([("d", "b.md", "two"), ("d", "a.md", None)], "directory string, name string, summary string")).first()["note"]
    assert note == "# d\n\n- [[a]]\n- [[b]] two"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, i * 10) for i in range(6)], "n long, k long, v long")
    rows.where("n < 4").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        streams.incremental_index(stream(), str(tmp_path / "out"), "k", "n", str(tmp_path / "cp")).awaitTermination()
        rows.where("n >= 4").write.mode("append").parquet(str(tmp_path / "in"))
    held = lambda at: sorted((r["k"], r["v"]) for r in streams.indexed_rows(spark, str(tmp_path / at), "k").collect())
    assert held("out") == [(0, 40), (1, 50)]
    streams.compacted(spark, str(tmp_path / "out"), "k", str(tmp_path / "whole"))
    assert held("whole") == [(0, 40), (1, 50)] and len(list(tmp_path.glob("whole/*"))) == 1
    q = streams.latest_values(stream(), "k", "n", "v").writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["k"]: r["v"] for r in spark.table("latest").collect()} == {0: 40, 1: 50}
    q = streams.consolidation_pointer(stream().where("n < 4"), "k", "n", "v", 20).writeStream.format("memory").queryName("pointer").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["k"]: r["pointer"] for r in spark.table("pointer").collect()} == {0: 2, 1: 3}
