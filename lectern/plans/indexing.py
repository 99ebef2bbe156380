"""Composite plans: a book's index from its text, an incremental note index, checks against whole books."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import changes as C
from lectern.operators import fusion as U
from lectern.operators import lexical as L
from lectern.operators import structure as N
from lectern.operators import vectors as V


@dataclass
class Context:
    """Tables by name, passed from step to step."""

    tables: dict[str, DataFrame] = field(default_factory=dict)


Step = Callable[[Context], Context]


def run_steps(context: Context, steps: list[tuple[str, Step]], progress: Callable[[str], None] = lambda name: None) -> Context:
    for name, step in steps:
        progress(name)
        context = step(context)
    return context


def sections(context: Context) -> Context:
    """texts(book_id, text) -> nodes(book_id, line, level, title, parent, end, text, node_id): a section each heading."""
    lines = N.lines(context.tables["texts"], "book_id")
    total = lines.groupBy("book_id").agg(F.count("*").alias("lines"))
    heads = N.section_ranges(N.parents(N.headings(lines, "book_id"), "book_id"), "book_id", total)
    of = F.last(F.when(F.col("_head"), F.col("line")), ignorenulls=True).over(_ordered("book_id", "line"))
    marked = lines.join(heads.select("book_id", "line", F.lit(True).alias("_head")), ["book_id", "line"], "left").withColumn("_of", of).where("_of is not null and _head is null")
    body = marked.groupBy("book_id", F.col("_of").alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    nodes = heads.join(body, ["book_id", "line"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    context.tables["nodes"] = N.numbered(nodes, "book_id", ["line"])
    return context


def _ordered(by: str, order: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(by).orderBy(order)


def lexical_index(context: Context) -> Context:
    """nodes -> postings, df, lengths, statistics over title and text."""
    n = context.tables["nodes"].select(F.concat_ws("/", "book_id", "node_id").alias("node"), F.concat_ws("\n", "title", "text").alias("text"))
    post, size = L.postings(n, "node"), L.lengths(n, "node")
    context.tables |= {"postings": post, "df": L.document_frequency(post), "lengths": size, "statistics": L.statistics(size)}
    return context


def vector_rows(context: Context) -> Context:
    """nodes -> texts to embed: the book at L0, each section's title at L1, its text at L2."""
    n = context.tables["nodes"]
    book = n.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "title"))), lambda x: x["title"]), " ").alias("text")).select("book_id", F.lit("BOOK").alias("chunk_id"), F.lit("L0").alias("level"), "text")
    one = n.select("book_id", F.concat("node_id", F.lit("_summary")).alias("chunk_id"), F.lit("L1").alias("level"), F.col("title").alias("text"))
    two = n.where("text <> ''").select("book_id", F.col("node_id").alias("chunk_id"), F.lit("L2").alias("level"), "text")
    context.tables["vector_rows"] = book.unionByName(one).unionByName(two).withColumn("text", X.strip_controls(F.col("text")))
    return context


BOOK_STEPS: list[tuple[str, Step]] = [("sections", sections), ("lexical", lexical_index), ("vectors", vector_rows)]


def index_books(texts: DataFrame, steps: list[tuple[str, Step]] | None = None) -> Context:
    return run_steps(Context({"texts": texts}), steps or BOOK_STEPS)


def refresh_notes(files: DataFrame, stored: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows of the new index, change classes): what derive makes of new and changed files replaces their old
    rows, deleted files lose theirs, the others stay."""
    kinds = C.change_classes(files, stored.select("path", "hash").distinct(), "path", ["hash"])
    fresh = derive(files.join(kinds.where("change in ('new', 'changed')").select("path"), "path", "left_semi"))
    kept = stored.join(kinds.where("change = 'unchanged'").select("path"), "path", "left_semi")
    return kept.unionByName(fresh), kinds


def _index(nodes: DataFrame | L.Index, key: str) -> L.Index:
    """A stored index as it is; one of nodes(key, text) that is used once."""
    return nodes if isinstance(nodes, L.Index) else L.index_of(nodes, key)


def hybrid(nodes: DataFrame | L.Index, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, key: str, query: str, k: int = 10, recall: int = 50) -> DataFrame:
    """The flagship: lexical and vector recall, reciprocal ranks, the k best. nodes is a stored index, or texts."""
    signals = {"bm25": L.bm25_search(_index(nodes, key), queries, key, query, recall), "vector": V.cosine_search(vectors, query_vectors, key, query, recall)}
    return L.top(U.reciprocal_rank_fusion(signals, query, key), query, key, k)


def claims_contradicted(claims: DataFrame, nodes: DataFrame | L.Index, query: str, key: str, least: float = 0.3) -> DataFrame:
    """(query, contradicted): claims of absence for which the whole book does have a hit at the bound or above. nodes is
    a stored index, or texts."""
    hits = L.bm25_scores(_index(nodes, key), claims, key, query).groupBy(query).agg(F.max("score").alias("best"))
    return claims.select(query).join(hits, query, "left").select(query, (F.coalesce("best", F.lit(0.0)) >= least).alias("contradicted"))
