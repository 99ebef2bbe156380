"""Sources over files: note trees, JSON lines, logs. All read through Spark, from any store it reaches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Folders that hold no notes of the user's own.
EXCLUDED = ("**/.obsidian/**", "**/.trash/**", "**/Templates/**")
VECTOR = T.StructType([T.StructField("chunkId", T.StringType()), T.StructField("nodeId", T.StringType()), T.StructField("blockIds", T.ArrayType(T.StringType())), T.StructField("type", T.StringType()), T.StructField("level", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
CHUNK = T.StructType([T.StructField("chunkId", T.StringType()), T.StructField("nodeId", T.StringType()), T.StructField("blockIds", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()), T.StructField("type", T.StringType())])
CARD_VECTOR = T.StructType([T.StructField("cardId", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])


def path_matches(path: Column, pattern: str) -> Column:
    """``**/X/**`` is membership of a path's parts; other patterns are globs over the whole path."""
    if pattern.startswith("**/") and pattern.endswith("/**") and "*" not in pattern[3:-3]:
        return F.array_contains(F.split(path, "/"), pattern[3:-3])
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], "\\" + pattern[i] if not pattern[i].isalnum() and pattern[i] not in "/_ " else pattern[i])
            i += 1
    return path.rlike(f"^{out}$")


def is_derived(content: Column) -> Column:
    """Notes made from a book: their front matter names the type, and they do not ask to be indexed."""
    front = F.regexp_extract(content, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    return front.rlike(r"(?m)^type:\s*(pdf|epub)\s*$") & ~front.rlike(r"(?m)^indexed:\s*true\s*$")


def directory_of(path: Column, subdirectories: list[str] | None = None) -> Column:
    """The first of the given directories that holds the path, else its parent."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.coalesce(*[F.when((parent == s) | path.startswith(s.rstrip("/") + "/"), F.lit(s)) for s in subdirectories or []], parent)


def scan_notes(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED, subdirectories: list[str] | None = None) -> DataFrame:
    """(path, directory, content, hash, mtime, size) of the Markdown notes under root that are not derived files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), "^" + re.escape(base) + "/", "")
    d = raw.select(path.alias("path"), F.col("content").cast("string").alias("content"), F.substring(F.sha2("content", 256), 1, 16).alias("hash"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    for p in excluded:
        d = d.where(~path_matches(F.col("path"), p))
    if subdirectories:
        d = d.where(F.greatest(*[F.col("path").startswith(s.rstrip("/") + "/").cast("int") for s in subdirectories], F.lit(0)) == 1)
    return d.where(~is_derived(F.col("content"))).withColumn("directory", directory_of(F.col("path"), subdirectories))


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines; corrupt lines are dropped, or fail the read when strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def json_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document, or no rows where it does not exist."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def indexed_books(spark: SparkSession, pattern: str) -> DataFrame:
    """(book_id, title) of every folder whose book-meta.json has a title."""
    d = spark.read.schema("bookId string, title string").option("multiLine", True).json(pattern).withColumn("_at", F.input_file_name())
    folder = F.regexp_extract("_at", r"([^/]+)/[^/]+$", 1)
    return d.where("title is not null and title <> ''").select(F.coalesce("bookId", folder).alias("book_id"), "title")


def classified_directories(files: DataFrame, most: int = 30) -> DataFrame:
    """(directory, files, kind, needs_reorg) of first-level directories: book with an index note, timeline where
    over 0.6 of the names are dates, else mixed."""
    d = files.withColumn("directory", F.split("path", "/")[0]).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    dated = F.col("name").rlike(r"^\d{4}[-./]?\d{2}([-./]?\d{2})?")
    g = d.where(F.contains("path", F.lit("/"))).groupBy("directory").agg(F.count("*").alias("files"), F.max(F.col("name") == "_目录.md").alias("_book"), F.avg(dated.cast("int")).alias("_dated"))
    kind = F.when(F.col("_book"), "book").when(F.col("_dated") > 0.6, "timeline").otherwise("mixed")
    return g.select("directory", "files", kind.alias("kind"), ((kind != "book") & (F.col("files") > most)).alias("needs_reorg"))


def sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of session logs: a metadata line, then one line a message; corrupt lines are skipped."""
    # A log is read whole, so that its lines keep their order however files are cut.
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("_n", "value"))
    kind = "_type string, id string, title string, createdAt string, role string, content string, ts string, hidden boolean"
    d = raw.withColumn("j", F.from_json("value", kind)).where("j is not null")
    meta = d.where(F.col("j._type") == "metadata").select("file", "j.id", "j.title", "j.createdAt")
    body = d.where("j._type is null and j.role is not null")
    seq = (F.row_number().over(Window.partitionBy("file").orderBy("_n")) - 1).cast("long")
    return meta, body.select("file", seq.alias("seq"), "j.role", "j.content", "j.ts", F.coalesce("j.hidden", F.lit(False)).alias("hidden"))


def history(spark: SparkSession, path: str, last: int = 50, separator: str = "\n\n---\n\n") -> DataFrame:
    """(file, seq, entry): the last entries of each text log."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.filter(F.split("value", separator), lambda x: F.trim(x) != "").alias("e"))
    kept = F.slice("e", F.greatest(F.size("e") - last + 1, F.lit(1)), F.lit(last))
    return raw.select("file", F.greatest(F.size("e") - last, F.lit(0)).cast("long").alias("_from"), F.posexplode(kept).alias("seq", "entry")).select("file", (F.col("_from") + F.col("seq")).alias("seq"), F.btrim("entry", F.lit(" \t\r\n")).alias("entry"))


def last_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, last_read_at) of either layout: path to a page number, or to an object with one; pages from 1."""
    raw = spark.read.text(path, wholetext=True)
    pages = F.coalesce(F.from_json(F.get_json_object("value", "$.pages"), "map<string,string>"), F.from_json("value", "map<string,string>"))
    d = raw.select(F.explode(pages).alias("path", "v"))
    page = F.coalesce(F.get_json_object("v", "$.page").try_cast("int"), F.col("v").try_cast("int"))
    return d.select("path", page.alias("page"), F.coalesce(F.get_json_object("v", "$.lastReadAt").try_cast("long"), F.lit(0).cast("long")).alias("last_read_at")).where("page >= 1")
