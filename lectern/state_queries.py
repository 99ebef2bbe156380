"""Queries of keyed state over whole tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.queries import query, t
from lectern.streaming import reducers as R

_SESSION = """e AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 4 > 0 THEN value END AS value, CASE WHEN event_id % 3 = 0 THEN event_id % 7 END AS depth, event_id % 50 = 49 AS stop FROM events),
 s AS (SELECT user_id, min(event_id) FILTER (stop) AS stops FROM e GROUP BY 1)"""


def _session(spark, d):
    e, i = t(spark, d, "events"), F.col("event_id")
    return e.select("user_id", "event_id", "event_type", F.when(i % 4 > 0, F.col("value")).alias("value"), F.when(i % 3 == 0, i % 7).alias("depth"), (i % 50 == 49).alias("stop"))


@query(f"""WITH {_SESSION}, k AS (SELECT e.* FROM e JOIN s USING (user_id) WHERE stops IS NULL OR event_id < stops)
 SELECT user_id, max_by(value, event_id) FILTER (value IS NOT NULL) AS value, min_by(depth, event_id) FILTER (depth IS NOT NULL) AS depth, stops IS NOT NULL AS stopped, coalesce(string_agg(event_type, ',' ORDER BY event_id), '') AS visited FROM s LEFT JOIN k USING (user_id) GROUP BY user_id, stops""")
def sm1_session_updates(spark, d):
    """A user's events are a session's updates: the last value and the first depth before the first interrupt, and what
    was visited."""
    out = R.reduced(_session(spark, d), "user_id", "event_id", last=("value",), first=("depth",), append="event_type", stop="stop")
    return out.select("user_id", "value", "depth", "stopped", F.array_join("items", ",").alias("visited"))


@query(f"""WITH {_SESSION}, m AS (SELECT user_id, event_type, max_by(coalesce(value, -1), event_id) AS v FROM e GROUP BY 1, 2), r AS (SELECT user_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10),
 l AS (SELECT user_id, event_type, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10)
 SELECT user_id, f AS merged, i AS items FROM (SELECT user_id, string_agg(event_type || '=' || floor(v)::BIGINT::VARCHAR, ',' ORDER BY event_type) AS f FROM m GROUP BY 1) JOIN (SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS i FROM l GROUP BY 1) USING (user_id)""")
def sm2_state_reducers(spark, d):
    """A map of types merged field by field, and a list of the last ten items."""
    e = _session(spark, d).withColumn("value", F.coalesce("value", F.lit(-1.0)))
    out = R.reduced(e, "user_id", "event_id", append="event_type", merge=("event_type", "value"), cap=10)
    field = F.transform("fields", lambda x: F.concat(x["field"], F.lit("="), F.floor(x["value"]).cast("string")))
    return out.select("user_id", F.array_join(field, ",").alias("merged"), F.array_join("items", ",").alias("items"))


@query("""WITH u AS (SELECT user_id, event_id % 20 AS item, max(floor(epoch(ts))::BIGINT) AS "at" FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at" DESC, item) AS place, max("at") OVER (PARTITION BY user_id) AS newest FROM u)
 SELECT user_id, item, "at", place FROM n WHERE place <= 8 AND "at" >= newest - 864000""")
def sm4_recently_used(spark, d):
    """The eight items that each user used last, none from over ten days before the newest."""
    e = t(spark, d, "events").select("user_id", (F.col("event_id") % 20).alias("item"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"))
    return R.recently_used(e, "user_id", "item", "at", 8, 864_000)
