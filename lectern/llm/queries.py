"""The queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import crc_of, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .best_fit_packing import packed
    from .token_counts import vocabulary

    out = packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens, vocabulary

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import CONTRACT, scan

    return scan(table(spark, sf_dir, "documents"), phrases=CONTRACT).drop("detections")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import blocks, read_back
    from .token_counts import vocabulary

    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(blocks(rows.unionByName(more), vocabulary("byte_bpe_50k.json")))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import THRESHOLD, score_documents

    out = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_of() % 5 != 0)
    return out.select("doc_id", (crc_of() % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import grouped

    out = grouped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "finding", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, score_documents

    out = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_of() % 3 != 1)
    return out.select("doc_id", (crc_of() % 3 == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align
    from .token_counts import vocabulary

    return align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import encode

    return encode(table(spark, sf_dir, "embeddings"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_tree import score_documents

    return score_documents(table(spark, sf_dir, "documents"), crc_of() % 7 != 2)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_token_counts, op3_quality_rules, op4_license_scan, op5_chat_format, op6_quality_model, op7_decontamination, op8_simhash_near_dedup, op9_secret_scan, op10_toxicity, op11_token_alignment, op12_vector_codes, op13_lm_score)}

#: The rules of op3 in SQL: statistics, counts of labelled rows over each cutoff, exact binomial tails, cutoffs.
_OP3 = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
 win AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(list_slice(words, i, i + 7), ' '))) AS x FROM w WHERE len(words) >= 8),
 twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM win) WHERE n > 1),
 rep AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY 1),
 s AS (SELECT rid, doc_id, lang, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^!?]+', '', 'g')) AS n_shouts FROM w LEFT JOIN rep USING (rid)),
 b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
 r AS (SELECT rid, doc_id, lang, text, base_failed, unnest(range(5)) AS rule, unnest([n_symbols / greatest(word_chars, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1), n_capitals / greatest(word_chars, 1), n_shouts / greatest(word_chars, 1)]) AS v FROM b),
 cut AS (SELECT unnest(range({n})) AS i, unnest([{cutoffs}]::DOUBLE[]) AS c),
 l AS (SELECT doc_id, quality FROM labels WHERE quality IN (0, 1)),
 t AS (SELECT lang, text, rule, min(v) AS v, min(quality) AS quality FROM r JOIN l USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
 k AS (SELECT lang, rule, i, c, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND v > c) AS k, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality = 0 AND v > c) AS caught FROM t CROSS JOIN cut GROUP BY ALL),
 m AS (SELECT (count(DISTINCT lang) + max((lang IS NULL)::INT)) * 5 * {n} AS tests FROM k),
 p AS (SELECT k.*, CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha})))) END AS tail FROM k),
 best AS (SELECT lang, rule, c FROM p CROSS JOIN m WHERE n > 0 AND bad > 0 AND tail <= {delta} / tests AND caught - 5 * k > 0 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY caught - 5 * k DESC, i DESC) = 1),
 over_ AS (SELECT DISTINCT rid FROM r JOIN best ON r.lang IS NOT DISTINCT FROM best.lang AND r.rule = best.rule AND r.v > best.c)
 SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND over_.rid IS NULL AS kept
 FROM b LEFT JOIN over_ USING (rid)"""


def _op3_sql() -> str:
    from .quality_rules import CUTOFFS, RULES

    out = _OP3
    for name, value in {"n": len(CUTOFFS), "cutoffs": ", ".join(map(str, CUTOFFS)), "alpha": 0.05 / len(RULES), "delta": 0.05}.items():
        out = out.replace("{" + name + "}", str(value))
    return out


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds without bounds: every distance, one assignment and one update a round."""
    distance = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::BIGINT"
    out = [f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(4096 * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 x AS MATERIALIZED (SELECT rid, vec_id, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS v FROM kept CROSS JOIN range({parts}) AS r(p)),
 b0 AS MATERIALIZED (SELECT p, c, v FROM x JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM kept QUALIFY c < {entries}) USING (rid))"""]
    for r in range(rounds + 1):
        out.append(f" a{r} AS MATERIALIZED (SELECT rid, p, min({distance} * {entries} + c) AS best FROM x JOIN b{r} AS b USING (p) GROUP BY ALL)")
        if r < rounds:
            out.append(f""" n{r} AS (SELECT p, best % {entries} AS c, i, floor(sum(v[i]) / count(*))::BIGINT AS m FROM a{r} JOIN x USING (rid, p) CROSS JOIN range(1, 99) AS d(i) WHERE i <= len(v) GROUP BY ALL),
 b{r + 1} AS MATERIALIZED (SELECT b.p, b.c, coalesce(n.v, b.v) AS v FROM b{r} AS b LEFT JOIN (SELECT p, c, list(m ORDER BY i) AS v FROM n{r} GROUP BY ALL) AS n ON n.p = b.p AND n.c = b.c)""")
    out.append(f""" sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM b{rounds}),
 e AS (SELECT rid, string_agg(printf('%02x', (best % {entries})::INT), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY 1)
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN e USING (rid) CROSS JOIN sha""")
    return ",\n".join(out[:-1]) + ",\n" + out[-1]


ORACLE_SQL: dict[str, str] = {"op3_quality_rules": _op3_sql(), "op12_vector_codes": _op12_sql()}
