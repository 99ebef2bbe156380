"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies, dealt out where it has fewer parts than there are cores: a small file of one row group is
    one task's work."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or on a local master a folder of our own.

    A cluster has to name one: no machine's own folder would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="lectern-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_tables: list[str] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors. Columns
    are written under names of our own, so that names that differ in case alone cannot clash."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def remove_tables(spark: SparkSession, names: list[str]) -> None:
    """Remove tables that ``written`` made and that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in names:
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _tables.remove(path)


def tables() -> list[str]:
    """The paths of all tables that ``written`` has made and that still stand."""
    return list(_tables)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, matched exactly, so that extra columns (``Text`` beside ``text``) cannot clash."""
    at = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{at[n]}").alias(n) for n in names])


def by_place(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with columns c0, c1, ... so that no name can clash, and the new names of the given columns."""
    places = [df.columns.index(n) for n in names]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{i}" for i in places]


def crc_of(col: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def ship(spark: SparkSession) -> None:
    """Give this package's code to the executors, once a context, by Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_lectern_code", None):
        return
    package = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="lectern-code-")) / "lectern_code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path(package.name) / f.relative_to(package))
    context.addPyFile(str(at))
    context._lectern_code = str(at)


_kept: dict[str, dict] = {}


def kept_by(operator: str) -> dict:
    """What a Python worker keeps between tasks of an operator; what other operators kept there goes."""
    for other in [k for k in _kept if k != operator]:
        del _kept[other]
    return _kept.setdefault(operator, {})


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow, whose functions executors can import."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def packed(rows: DataFrame, words: bool) -> DataFrame:
    """rows(block, item, value) with all of a batch's items of a block in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, value = b.column(0).to_numpy(), b.column(2).to_numpy()
            by = np.argsort(block, kind="stable")
            items = b.column(1).to_pylist() if words else b.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], block[by][1:] != block[by][:-1], [True]))) if len(by) else []
            out = [(int(block[by[a]]), b"\n".join(items[i] for i in by[a:z].tolist()) if words else items[by[a:z]].tobytes(), value[by[a:z]].tobytes()) for a, z in zip(edge, edge[1:])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["block", "items", "value"])

    return map_arrow(rows, run, "block long, items binary, value binary")
