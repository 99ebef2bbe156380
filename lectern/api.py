"""The library in a few calls: index documents or notes, search what was indexed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import lexical as L
from lectern.plans import indexing as P
from lectern.plans.book_search import book_search
from lectern.sources import files as S


def index_documents(texts: DataFrame, path: str) -> None:
    """texts(book_id, text) in Markdown -> sections, vector rows and a lexical index under path."""
    context = P.run_steps(P.Context({"texts": texts}), [s for s in P.BOOK_STEPS if s[0] != "lexical"])
    for name in ("nodes", "vector_rows"):
        context.tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    nodes = texts.sparkSession.read.parquet(f"{path}/nodes")
    L.write_index(nodes.select(F.concat_ws("/", "book_id", "node_id").alias("node"), F.concat_ws("\n", "title", "text").alias("text")), "node", f"{path}/lexical")


def search(spark: SparkSession, path: str, queries: DataFrame, **signals) -> DataFrame:
    """The best sections of each of queries(query, text) in what index_documents wrote; signals as in book_search."""
    nodes = spark.read.parquet(f"{path}/nodes")
    kids = nodes.where("parent is not null").select("book_id", F.col("parent").alias("line")).distinct().withColumn("_kids", F.lit(True))
    tree = nodes.join(kids, ["book_id", "line"], "left").select(F.concat_ws("/", "book_id", "node_id").alias("node"), (F.col("level") - 1).alias("depth"), F.coalesce("_kids", F.lit(False)).alias("has_children"))
    found = book_search(L.read_index(spark, f"{path}/lexical"), queries, tree, **signals)
    return found.join(nodes.select(F.concat_ws("/", "book_id", "node_id").alias("node"), "book_id", "title"), "node")


def index_notes(spark: SparkSession, root: str, path: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bring the index of a note folder up to date; returns the changes (path, change)."""
    notes = S.scan_notes(spark, root)
    try:
        stored = spark.read.parquet(f"{path}/current")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = derive(notes).limit(0)
    rows, kinds = P.refresh_notes(notes, stored, derive)
    rows.write.mode("overwrite").parquet(f"{path}/next")
    kinds.write.mode("overwrite").parquet(f"{path}/changes")
    spark.read.parquet(f"{path}/next").write.mode("overwrite").parquet(f"{path}/current")
    return spark.read.parquet(f"{path}/changes")
