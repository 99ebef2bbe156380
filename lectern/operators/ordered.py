"""Places and running sums over groups of any size: sorted ranges are counted each, then put one after another.

A window over a key gathers the key's rows in one task. Here rows are sorted into ranges by (key, order), each range is
numbered for itself, and counts of the ranges before it, one row a key and range, are added. The ranges are written
once, so that numbers stay the same if tasks run again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.sources.folders import work_dir


def _ranges(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """rows with ``_part``, the range each lies in, written and read again."""
    path = f"{work_dir(rows.sparkSession)}/ranges-{uuid.uuid4().hex}"
    rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def placed(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "place", count: str | None = None) -> DataFrame:
    """With ``name``: the place of each row in its group in order, from 0; ``count`` names a column of the group's size."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = _ranges(rows, [*[F.col(b) for b in by], *order])
    per = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    # Before a range stand those of smaller numbers; a null key has ranges as any other.
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before).withColumn("_all", F.sum("_n").over(w)).select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("_part").alias("_p"), "_before", "_all")
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    on = F.col("_part") == F.col("_p")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    j = dealt.withColumn("_own", own).join(per, on).withColumn(name, (F.col("_before") + F.col("_own")).cast("long"))
    return (j.withColumn(count, F.col("_all")) if count else j).select(*rows.columns, name, *([count] if count else []))


def summed(rows: DataFrame, by: list[str], order: list[Column | str], value: str, name: str) -> DataFrame:
    """With ``name``: the sum of value over the rows before this one in its group, in order (0 for the first)."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = _ranges(rows, [*[F.col(b) for b in by], *order])
    per = dealt.groupBy(*by, "_part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("_part").alias("_p"), before.alias("_before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on = F.col("_part") == F.col("_p")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    return dealt.withColumn("_own", own).join(per, on).select(*rows.columns, (F.col("_before") + F.col("_own")).alias(name))
