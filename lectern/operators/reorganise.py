"""Reorganisation of a note vault: which files move, where chains of moves end, and every link to them put right at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.files import classified_directories
from lectern.sources.folders import work_dir

#: What a link begins with: its target, up to a part, an alias or its end.
HEAD = r"\[\[([^\]#|]+)(?=[#|\]])"
DATED = r"^(\d{4})[-_]?(\d{2})"


def planned_moves(files: DataFrame, most: int = 30) -> DataFrame:
    """(path, old, new) of files(path): dated notes of a first-level directory that is a timeline of over ``most`` files move
    into a folder of their year and one of their month. old and new are link targets, without .md."""
    kinds = classified_directories(files, most).where("kind = 'timeline' AND needs_reorg").select("directory")
    d = files.select("path", F.regexp_extract("path", r"^([^/]+)/([^/]+)\.md$", 1).alias("directory"), F.regexp_extract("path", r"^([^/]+)/([^/]+)\.md$", 2).alias("_name"))
    year, month = F.regexp_extract("_name", DATED, 1), F.regexp_extract("_name", DATED, 2)
    dated = d.where((F.col("directory") != "") & (year != "") & (F.col("_name") != "_目录")).join(kinds, "directory", "left_semi")
    return dated.select("path", F.concat_ws("/", "directory", "_name").alias("old"), F.concat_ws("/", "directory", year, month, "_name").alias("new"))


def settled_moves(moves: DataFrame) -> DataFrame:
    """(old, new) of moves(old, new): a chain of moves leads to its end at once, of several moves of one target the first by
    name counts, and what is in a ring or leads into one moves nothing. Pointers double, so a chain of n takes log n
    joins; whoever goes on after that many goes round."""
    spark, now = moves.sparkSession, moves.where("old <> new").groupBy("old").agg(F.min("new").alias("new"))
    for _ in range(max(1, now.count()).bit_length() + 1):
        path = f"{work_dir(spark)}/moves-{uuid.uuid4().hex}"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        then = now.select(F.col("old").alias("new"), F.col("new").alias("_to"))
        if now.join(then, "new", "left_semi").limit(1).count() == 0:
            return now
        now = now.join(then, "new", "left").select("old", F.coalesce("_to", "new").alias("new"))
    return now.join(now.select(F.col("old").alias("new")), "new", "left_anti").select("old", "new")


def moved_texts(texts: DataFrame, moves: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text, links) of the texts that change: links[[old]], [[old#part]] and [[old|alias]] of moves(old, new) now name the
    new target; ``links`` counts them. Targets of all texts meet the moves in one join; texts without a moved link are
    neither sorted nor rewritten."""
    targets = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(HEAD), F.lit(1))).alias("_p", "_target"))
    hit = targets.join(moves.select(F.col("old").alias("_target"), F.col("new").alias("_new")), "_target")
    per = hit.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_p", "_new"))).alias("_moved"))  # a text's own links
    d = texts.select(key, text).join(per, key)
    heads, gaps = F.regexp_extract_all(text, F.lit(HEAD), F.lit(1)), F.split(text, HEAD, -1)
    written = F.transform(heads, lambda t, i: F.concat(F.lit("[["), F.coalesce(F.element_at("_moved", i), t)))
    body = F.array_join(F.zip_with(written, F.slice(gaps, 2, F.size(gaps)), lambda h, g: F.concat(h, F.coalesce(g, F.lit("")))), "")
    return d.select(key, F.concat(F.get(gaps, F.lit(0)), body).alias(text), F.size("_moved").cast("long").alias("links"))
