"""The profile after two rounds, with SQL of one full build."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans import profile as P
from lectern.queries import _chat, query
from lectern.sources.folders import work_dir

#: A session is a file; its facts are the first words of its messages, after a change the last ones.
_FACTS = """f AS (SELECT conv_id AS file, role AS dimension, lower(CASE WHEN conv_id % 5 = 0 THEN regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1) ELSE regexp_extract(text, '[A-Za-z]+') END) AS fact, turn AS seq FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn % 2 = 1 AND conv_id % 2 = 0)),
 p AS (SELECT dimension, fact, count(DISTINCT file) AS files, min((file, seq)) AS w FROM f GROUP BY 1, 2)"""


def _profile(spark, d):
    chat = _chat(spark, d).withColumnRenamed("conv_id", "file")
    first = lambda x: x.select("file", F.col("role").alias("dimension"), F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("fact"), F.col("turn").alias("seq"))
    last = lambda x: x.select("file", F.col("role").alias("dimension"), F.lower(F.regexp_extract("text", "([A-Za-z]+)[^A-Za-z]*$", 1)).alias("fact"), F.col("turn").alias("seq"))
    before = chat.where("file % 4 <> 0").withColumn("mtime", F.lit(1).cast("long"))
    # In the second round every fourth session is new, every fifth was written anew and some lost messages.
    now = chat.where("NOT (file % 5 = 0 AND turn % 2 = 1 AND file % 2 = 0)").withColumn("mtime", F.when(F.col("file") % 5 == 0, 2).otherwise(1).cast("long"))
    one = P.stored(P.refreshed(P.empty_profile(spark), before, first), work_dir(spark))
    both = lambda x: last(x.where("mtime = 2")).unionByName(first(x.where("mtime = 1")))
    return P.stored(P.refreshed(one, now, both), work_dir(spark))


@query(f"WITH {_FACTS} SELECT dimension, row_number() OVER (PARTITION BY dimension ORDER BY w, fact) - 1 AS place, fact, files FROM p")
def rt27_profile(spark, d):
    return P.in_order(_profile(spark, d))
