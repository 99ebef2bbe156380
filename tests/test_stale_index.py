"""A stored index belongs to a state of its table."""

from lectern import queries as Q


def test_a_table_written_anew_has_a_new_index(spark, tmp_path):
    def write(text):
        spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")

    tokens = lambda: sorted(r["token"] for r in Q.index(spark, str(tmp_path)).terms.collect())
    write("alpha beta")
    assert tokens() == ["alpha", "beta"]
    at = dict(Q._STORED)
    assert tokens() == ["alpha", "beta"] and Q._STORED == at  # built once
    write("gamma")
    assert tokens() == ["gamma"]
