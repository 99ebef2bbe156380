"""Quality rules whose cutoffs are certified on labelled rows.

Every rule rejects a document whose statistic lies above a cutoff. A cutoff is used only if the exact
binomial bound on the labelled good documents of its stratum shows that the rule rejects at most
``alpha / number of rules`` of the stratum's good documents, at confidence ``1 - delta`` over all
(stratum, rule, cutoff) tests together (Bonferroni). A stratum with too few labels to certify a cutoff
rejects nothing but the base failures.

Only DataFrame functions run on the rows; the driver sees one row of counts per stratum and label.

Defined cases: null or empty text has no words and fails the base rule; a null stratum is a stratum of its
own; repeated rows are judged each; extra columns stay and never clash; an empty table gives an empty result;
labels with a null quality or for unknown documents are ignored; labelled rows of one text in a stratum are one trial,
which is good if all their labels are, so copies of a text or of a label certify nothing.
Windows of eight words are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import by_place, only, written

WINDOW = 8
SPACE = r"[ \t-\r]+"
CUTOFFS = [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.34, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
RULES = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "capital_ratio": "n_capitals / greatest(word_chars, 1)",
    "shout_ratio": "n_shouts / greatest(word_chars, 1)",
}


def _kept_chars(pattern: str) -> Column:
    return F.length(F.regexp_replace("_text", f"[^{pattern}]+", "")).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs, whose text column is ``_text``, with the base columns and the counts behind the rules."""
    bare = F.btrim("_text", F.lit(" \t\n\x0b\f\r"))
    w = docs.withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)))
    w = w.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    w = w.withColumn("_hash", F.transform("_words", lambda x: F.xxhash64(x)))
    w = w.withColumn(
        "_seen",
        F.when(
            F.size("_hash") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("_hash") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_hash", i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Most documents repeat no window: only the others are sorted, and null stands for none.
    w = w.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_seen")) < F.size("_seen"),
            F.sort_array(F.transform("_seen", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda a, b: F.coalesce(F.get(F.col("_sorted"), a)["h"] == b["h"], F.lit(False))
    w = w.withColumn(
        "_at",
        F.sort_array(F.transform(F.filter("_sorted", lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"])),
    )
    steps = F.zip_with("_at", F.expr("slice(_at, 2, greatest(size(_at) - 1, 0))"), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    size = lambda c: F.size(c).cast("long")
    return w.select(
        *docs.columns,
        F.xxhash64("_text").alias("_same"),
        size("_words").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _kept_chars(r"#*$%&|<>").alias("n_symbols"),
        (size("_lines") - size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        size("_lines").alias("n_lines"),
        _kept_chars("A-Z").alias("n_capitals"),
        _kept_chars("!?").alias("n_shouts"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly, summed in logs; the sum stops where terms no longer count."""
    if k >= n:
        return 1.0
    log_p, log_q = math.log(p), math.log1p(-p)
    total = 0.0
    for j in range(k, -1, -1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * log_p + (n - j) * log_q)
        total += term
        if term < total * 1e-17 and j < n * p:
            break
    return min(total, 1.0)


def certify(stats: DataFrame, labels: DataFrame, key: str, stratum: str, alpha: float, delta: float, cost: float, at: str | None = None) -> dict:
    """{stratum: {rule: cutoff}} from statistics of labelled rows, whose key is in column ``at``; of the certified cutoffs of a rule the one
    with the most rejected bad rows, less ``cost`` for each rejected good one, and the highest of equals."""
    lab = only(labels, key, "quality").where("quality in (0, 1)").select(F.col(key).alias("_key"), "quality")
    names = sorted({w for e in RULES.values() for w in e.replace("(", " ").replace(",", " ").split() if w.startswith("n_") or w == "word_chars"})
    labelled = stats.where("not base_failed").join(lab, stats[at or key] == lab["_key"])
    trials = labelled.groupBy(F.col(stratum).alias("stratum"), "_same").agg(F.min("quality").alias("quality"), *[F.min(c).alias(c) for c in names])
    rows = (
        trials.groupBy("stratum", "quality")
        .agg(F.count("*").alias("n"), *[F.count_if(F.expr(e) > c).alias(f"{r}:{i}") for r, e in RULES.items() for i, c in enumerate(CUTOFFS)])
        .collect()
    )  # one row a stratum and label
    by = {(r["stratum"], r["quality"]): r for r in rows}
    strata = {s for s, _ in by}
    tests = max(1, len(strata) * len(RULES) * len(CUTOFFS))
    out: dict = {}
    for s in strata:
        good, bad = by.get((s, 1)), by.get((s, 0))
        if not good or not bad:
            continue
        for r in RULES:
            best = None
            for i, c in enumerate(CUTOFFS):
                k, caught = good[f"{r}:{i}"], bad[f"{r}:{i}"]
                if binomial_tail(good["n"], k, alpha / len(RULES)) <= delta / tests and caught - cost * k > 0:
                    best = max(best or (0, 0, 0), (caught - cost * k, i, c))
            if best:
                out.setdefault(s, {})[r] = best[2]
    return out


def verdict(cutoffs: dict, stratum: str) -> Column:
    """True where no certified rule of the row's stratum rejects it."""
    rejected = F.lit(False)
    for s, rules in sorted(cutoffs.items(), key=str):
        over = F.lit(False)
        for r, c in sorted(rules.items()):
            over = over | (F.expr(RULES[r]) > c)
        rejected = F.when(F.col(stratum).eqNullSafe(F.lit(s)), over).otherwise(rejected)
    return ~rejected


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, cost: float = 5.0) -> DataFrame:
    """(key, statistics, base_failed, kept) of every row. Statistics are made once and written, then fitted and applied."""
    d = only(docs, key, "text", stratum).select(key, F.col(stratum).alias("_stratum"), F.coalesce("text", F.lit("")).alias("_text"))
    stats = written(with_statistics(d).drop("_text"), "quality-stats")
    cutoffs = certify(stats, labels, key, "_stratum", alpha, delta, cost)
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(cutoffs, "_stratum"))


def kept_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, cost: float = 5.0) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep. Rows are written once with their statistics, so
    these are made once and no text moves to a join with the labels or with the verdicts."""
    rows, (k, text, own) = by_place(docs, key, "text", stratum)
    names = rows.columns
    rows = rows.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_stratum", F.col(own))
    stats = written(with_statistics(rows).drop("_text"), "quality-stats")
    cutoffs = certify(stats, labels, key, "_stratum", alpha, delta, cost, at=k)
    return stats.where(~F.col("base_failed") & verdict(cutoffs, "_stratum")).select(*names).toDF(*docs.columns)
