"""Chat logs: rounds, boundaries, compression and history windows, one ordered log a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recent_rounds(messages: DataFrame, session: str, seq: str, n: int = 3) -> DataFrame:
    """(session, round, question, answer): the newest n pairs of a user turn and the assistant turn right after it,
    in order from 1."""
    w = Window.partitionBy(session).orderBy(seq)
    pairs = messages.withColumn("_next", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w)).where("role = 'user' and _next = 'assistant'")
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(seq)))
    last = pairs.withColumn("_b", back).where(F.col("_b") <= n)
    return last.select(session, F.row_number().over(w).cast("long").alias("round"), F.col("text").alias("question"), "answer")


def last_by_role(messages: DataFrame, session: str, seq: str, role: str = "assistant") -> DataFrame:
    return messages.where(F.col("role") == role).groupBy(session).agg(F.max_by("text", seq).alias("text"), F.max(seq).alias("last"))


def consolidation_boundary(messages: DataFrame, session: str, seq: str, target: int | str, since: str | None = None) -> DataFrame:
    """(session, boundary, removed), target being a number or a column: counted from the session's watermark (column ``since``, the first message without
    one), the first later user turn before which at least ``target`` estimated tokens stand, else the last later user
    turn, else null; and the tokens from the watermark to it."""
    w = Window.partitionBy(session).orderBy(seq)
    kept = messages if since is None else messages.where(F.col(seq) >= F.coalesce(since, F.lit(0)))
    before = F.coalesce(F.sum(F.round(F.length("text") / 2)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    able = (F.col("role") == "user") & (F.row_number().over(w) > 1)
    goal = F.col(target) if isinstance(target, str) else F.lit(target)
    rows = kept.select(session, F.col(seq).alias("_s"), before.alias("_r"), able.alias("_u"), goal.alias("_t"))
    first, last = F.min(F.when(F.col("_u") & (F.col("_r") >= F.col("_t")), F.struct("_s", "_r"))), F.max(F.when(F.col("_u"), F.struct("_s", "_r")))
    at = rows.groupBy(session).agg(F.coalesce(first, last).alias("x"))
    return at.select(session, F.col("x._s").alias("boundary"), F.col("x._r").alias("removed"))


def aligned_history(messages: DataFrame, session: str, seq: str, n: int) -> DataFrame:
    """The last n messages of each session from its first user turn among them on."""
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(seq)))
    last = messages.withColumn("_b", back).where(F.col("_b") <= n)
    first = F.min(F.when(F.col("role") == "user", F.col(seq))).over(Window.partitionBy(session))
    return last.withColumn("_f", first).where(F.col(seq) >= F.col("_f")).drop("_b", "_f")


def compressed(messages: DataFrame, session: str, seq: str, role: str, whole: int = 2, most: int = 150, least: int = 4, mark: str = "[已压缩] ") -> DataFrame:
    """In sessions of more than ``least`` messages those of a role but its newest ``whole`` are marked and cut to
    ``most`` characters; a session with no more of that role stays as it is."""
    back = F.row_number().over(Window.partitionBy(session, "role").orderBy(F.desc(seq)))
    old = (F.col("role") == role) & (F.col("_b") > whole) & (F.count("*").over(Window.partitionBy(session)) > least)
    short = F.when(F.length("text") > most, F.concat(F.left("text", F.lit(most)), F.lit("..."))).otherwise(F.col("text"))
    return messages.withColumn("_b", back).withColumn("text", F.when(old, F.concat(F.lit(mark), short)).otherwise(F.col("text"))).drop("_b")


def inherited_depth(messages: DataFrame, session: str, seq: str, short: int = 5, long: int = 200) -> DataFrame:
    """With ``continues``: a user turn of at most ``short`` characters after two turns and a long last answer."""
    w = Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    answer = F.last(F.when(F.col("role") == "assistant", F.length("text")), ignorenulls=True).over(w)
    yes = (F.col("role") == "user") & (F.length("text") <= short) & (F.count("*").over(w) >= 2) & (F.coalesce(answer, F.lit(0)) > long)
    return messages.withColumn("continues", yes)


def session_sizes(messages: DataFrame, session: str) -> DataFrame:
    return messages.groupBy(session).agg(F.count("*").alias("messages"), F.sum(F.length("text")).cast("long").alias("chars"))


def consolidated(messages: DataFrame, session: str, seq: str, threshold: int, ratio: float = 0.5, rounds: int = 5) -> DataFrame:
    """(session, since): each session's watermark after up to ``rounds`` rounds. While the messages from it on have
    ``threshold`` estimated tokens, it moves to the boundary that leaves ``ratio`` of these; without one it stays. What
    a model makes of the messages before it is a hook's work."""
    at = messages.select(session).distinct().withColumn("since", F.lit(0).cast("long"))
    for _ in range(rounds):
        live = messages.join(at, session).where(F.col(seq) >= F.col("since"))
        size = F.round(F.sum(F.length("text")).over(Window.partitionBy(session)) / 2)
        over = live.withColumn("_size", size).where(F.col("_size") >= threshold).withColumn("_goal", F.col("_size") - threshold * ratio)
        moved = consolidation_boundary(over, session, seq, "_goal", "since").select(session, "boundary")
        at = at.join(moved, session, "left").select(session, F.coalesce("boundary", "since").alias("since"))
    return at
