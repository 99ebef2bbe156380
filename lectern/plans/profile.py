"""A reader's profile as a view that is kept by differences: changed files take their old facts back and give new ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import nesting as H
from lectern.operators.notes import newer_than_recorded
from lectern.operators.ordered import placed

FACTS, VIEW = "file {kind}, dimension string, fact string, seq long", "dimension string, fact string, files long, first_file {kind}, first_seq long"


@dataclass
class Profile:
    """facts(file, dimension, fact, seq): what each file says; view(dimension, fact, files, first_file, first_seq): each fact once, how
    many files say it and where it stands first; recorded(file, mtime): what was read."""

    facts: DataFrame
    view: DataFrame
    recorded: DataFrame


def empty_profile(spark: SparkSession, kind: str = "long") -> Profile:
    return Profile(spark.createDataFrame([], FACTS.format(kind=kind)), spark.createDataFrame([], VIEW.format(kind=kind)), spark.createDataFrame([], f"file {kind}, mtime long"))


def refreshed(profile: Profile, files: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> Profile:
    """The profile after files(file, mtime, ..): derive, the hook's work, sees only files that are newer than recorded and makes
    (file, dimension, fact, seq) of them. The view is made anew for facts that these files say or no longer say; all
    other rows stay as they are."""
    fresh = newer_than_recorded(files, profile.recorded, "file", "mtime")
    changed = fresh.select("file").distinct()
    new = derive(fresh).select("file", "dimension", "fact", F.col("seq").cast("long").alias("seq"))
    old = profile.facts.join(changed, "file", "left_semi")
    facts = profile.facts.join(changed, "file", "left_anti").unionByName(new)
    touched = old.select("dimension", "fact").unionByName(new.select("dimension", "fact")).distinct()
    where = F.min(F.struct("file", "seq"))
    # Counted a file first, so that a fact that many files say is summed before it moves.
    per = facts.join(touched, ["dimension", "fact"], "left_semi").groupBy("dimension", "fact", "file").agg(F.min("seq").alias("seq"))
    again = per.groupBy("dimension", "fact").agg(F.count("*").alias("files"), where.alias("_w")).select("dimension", "fact", "files", F.col("_w.file").alias("first_file"), F.col("_w.seq").alias("first_seq"))
    view = profile.view.join(touched, ["dimension", "fact"], "left_anti").unionByName(again)
    recorded = profile.recorded.join(changed, "file", "left_anti").unionByName(fresh.groupBy("file").agg(F.max("mtime").alias("mtime")))
    return Profile(facts, view, recorded)


def stored(profile: Profile, path: str) -> Profile:
    """The profile written as a version of its own under path, from which the next round goes on."""
    at, spark, out = f"{path}/profile-{uuid.uuid4().hex}", profile.view.sparkSession, []
    for name in ("facts", "view", "recorded"):
        df = getattr(profile, name)
        df.write.parquet(f"{at}/{name}")
        out.append(spark.read.schema(df.schema).parquet(f"{at}/{name}"))
    return Profile(*out)


def in_order(profile: Profile) -> DataFrame:
    """(dimension, place, fact, files): each dimension's facts in order of where they stand first."""
    d = placed(profile.view, ["dimension"], ["first_file", "first_seq", "fact"])
    return d.select("dimension", "place", "fact", "files")


def hook_batches(files: DataFrame, text: str = "text", most: int = 12_000) -> DataFrame:
    """(batch, first, end): new files in order in batches of at most ``most`` characters for the hook."""
    sized = files.select(F.lit(0).alias("all"), "file", F.length(text).cast("long").alias("_n"))
    return H.size_batches(sized, "all", ["file"], "_n", most).select("batch", "first", "end")
