"""Rules over whole tables: texts made of a table's columns in the forms a rule tells apart, and SQL that computes the rule.

``{column}`` in a form stands for the row's value; the row's key picks the form.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import intents as I
from lectern.functions import marks as K
from lectern.functions import similarity as S
from lectern.functions import text as X
from lectern.operators import changes as C
from lectern.operators import fusion as U
from lectern.operators import links as W
from lectern.operators import notes as O
from lectern.operators import quality as Q
from lectern.operators import sessions as M
from lectern.operators import structure as N
from lectern.operators import trees as G
from lectern.plans import library as B
from lectern.queries import _LINES, _chat, asked, nodes, query, t
from lectern.sources.files import classified_directories


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _parts(form: str) -> list[tuple[str, bool]]:
    """The pieces of a form: (text or column, whether it is a column)."""
    return [(p, i % 2 == 1) for i, p in enumerate(re.split(r"\{(\w+)\}", form)) if p]


def formed(forms: list[str], key: str) -> Column:
    """The text of a row: its key's form with the row's values put in."""
    made = [F.concat(F.lit(""), *[F.col(p).cast("string") if own else F.lit(p) for p, own in _parts(f)]) for f in forms]
    return reduce(lambda c, i: c.when(F.col(key) % len(forms) == i, made[i]), range(1, len(forms)), F.when(F.col(key) % len(forms) == 0, made[0]))


def formed_sql(forms: list[str], key: str) -> str:
    """The same in SQL."""
    made = [" || ".join(f"{p}::VARCHAR" if own else quoted(p) for p, own in _parts(f)) or "''" for f in forms]
    return f"CASE {key} % {len(forms)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(made)) + " END"


def rule(name: str, forms: list[str], column, sql: str, table: str = "part", key: str = "p_partkey") -> None:
    """Register a rule on one text: ``column`` of the text in Spark, ``sql`` of the text ``s`` in SQL."""

    def run(spark, d):
        return t(spark, d, table).select(key, formed(forms, key).alias("s")).select(key, column(F.col("s")).alias("v"))

    run.__name__ = name
    query(f"WITH x AS (SELECT {key}, {formed_sql(forms, key)} AS s FROM {table}) SELECT {key}, {sql} AS v FROM x")(run)


def replaced(s: str, *pairs: tuple[str, str]) -> str:
    """Nested regexp_replace calls over s."""
    for pattern, to in pairs:
        s = f"regexp_replace({s}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return s


# Titles and names ----------------------------------------------------------------------------------------------

TITLES = ["# {p_name} &amp; {p_brand}", "* **{p_name}  {p_type}**", "-  {p_name}...", "{p_name}：{p_type}", "{p_name}—{p_brand}: {p_type}", "  {p_name} &lt;{p_brand}&gt; ", "第{p_partkey}章 {p_name} 复利与风险{p_type}…", "{p_name} | {p_brand}"]
_CLEAN = "trim(" + replaced("replace(replace(replace(replace(replace(s, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' ')", (r"^[#*\-\s]+|[*\s]+$", ""), (r"\s+", " ")) + ")"
rule("tx9_clean_title", TITLES, X.clean_title, _CLEAN)
rule("tx11_note_name", TITLES, X.file_name, f"left({replaced(_CLEAN, (r'[<>:"/\\|?*#]', ''))}, 100)")
rule("tx11_dashed_name", TITLES, X.dashed_name, f"trim({replaced('s', (r'[/\\:*?"<>|]', '-'), (r'\s+', '-'))})")
rule("tx10_title_separators", TITLES, X.simple_title, "CASE " + " ".join(f"WHEN contains(s, '{c}') THEN trim(string_split(s, '{c}')[1])" for c in "：:—-｜|") + " ELSE s END")
rule("fp17_language", TITLES, X.language, "CASE WHEN regexp_matches(s, '[㐀-䶿一-鿿豈-﫿]') THEN 'zh' ELSE 'en' END")
rule("fp16_truncated_title", TITLES, lambda c: X.is_truncated(c), "ends_with(trim(s), '...') OR ends_with(trim(s), '…')")
rule("fp16_long_title", TITLES + ["{p_name} {p_type} {p_name} {p_type} {p_brand} {p_name} {p_type}", "复{p_name}{p_type}{p_brand}"], X.too_long_title, "length(s) > CASE WHEN regexp_matches(s, '[㐀-䶿一-鿿豈-﫿]') THEN 50 ELSE 100 END")
_PUNCT = r"""[，。！？：；""''【】《》、·—…\-\.,!?;:'"()\[\]{}<>/\\@#$%^&*+=~`|]"""
_ROUND = r"（[^）]*）|\([^)]*\)"
rule("tx7_normal_title", ["{p_name}（{p_brand}）", "[{p_name}] {p_type}!", "【{p_brand}】{p_name}: A, B", "{p_name} ({p_type}) — 复利"], X.normal_title, f"lower({replaced('s', (_ROUND + '|【[^】]*】', ''), (_PUNCT, ''), (r'\s+', ''))})")
rule("tx7_normal_author", ["[美] {p_name}", "【英】 {p_brand} ({p_type})", "{p_name}，{p_brand}", "({p_type})"], X.normal_author, f"lower({replaced('s', (r'\[[^\]]*\]|' + _ROUND + '|【[^】]*】', ''), (_PUNCT, ''), (r'\s+', ''))})")
rule("tx44_file_key", ["00{p_partkey}-{p_name}.md", "{p_partkey} – {p_name}", "{p_name}.md", "0{p_name}"], W.file_key, f"trim({replaced('s', (r'\.md$', ''), (r'^0+(\d)', r'\1'))})")
rule("tx44_file_alias", ["00{p_partkey}-{p_name}.md", "{p_partkey} – {p_name}", "{p_name}.md", "{p_partkey}{p_name}"], W.file_alias, f"trim({replaced('s', (r'\.md$', ''), (r'^\d+\s*[-–]\s*', ''))})")
rule("ma13_short_ids", ["{p_name}", "{p_type}", ""], lambda c: X.content_id(c, 8), "substr(sha256(s), 1, 8)")
rule("ma14_djb2", ["{p_name}", "{p_type} {p_name}", "a", ""], S.djb2, "list_reduce(list_prepend(5381::BIGINT, list_transform(list_filter(string_split(s, ''), lambda c: c <> ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 33 + c) & 2147483647)")

# Notes ---------------------------------------------------------------------------------------------------------

NOTES = ["# {p_name}", "> {p_name} ^p{p_partkey}", "- {p_name}", "{p_partkey}. {p_type}", "  > {p_brand}", "+ {p_name}", "{p_name} {p_type}"]
rule("tx13_chunk_kind", NOTES, X.chunk_kind, "CASE WHEN starts_with(ltrim(s), '#') THEN 'heading' WHEN starts_with(ltrim(s), '>') THEN 'quote' WHEN regexp_matches(ltrim(s), '^([-*+]|\\d+\\.)\\s') THEN 'list' ELSE 'body' END")
_LINKED = ["see [[{p_brand}/{p_name}]] now", "[[{p_brand}/{p_name}|{p_type}]]", "[[{p_name}]] and [[{p_type}| {p_brand} ]]", "[[{p_name}#^]] [[{p_name}#^|{p_type}]]", "{p_name}", "[[{p_name}#p{p_partkey}]] [[{p_name}er]]"]
rule("tx19_spoken_links", _LINKED, X.spoken_links, replaced("s", (r"\[\[[^\]|]+\|\s*([^\]|]*?)\s*(\|[^\]]*)?\]\]", r"\1"), (r"\[\[\s*(?:[^\]|]*/)?([^\]|/]*?)\s*\]\]", r"\1")))
rule("tx27_book_prefix", _LINKED, lambda c: W.with_book_prefix(W.without_empty_blocks(c), F.lit("财富书")), replaced("s", (r"\[\[([^#\]]*)#\^\|([^\]]+)\]\]", r"[[\1|\2]]"), (r"\[\[([^#\]]*)#\^\]\]", r"[[\1]]"), (r"\[\[([^/\]]+)\]\]", r"[[财富书/\1]]")))
rule("tx20_link_targets", _LINKED, lambda c: F.array_join(X.wiki_links(c), ","), "array_to_string(regexp_extract_all(s, '\\[\\[([^\\]|#]+)', 1), ',')")
rule("tx21_block_ids", NOTES + ["{p_name} ^a-{p_partkey} x ^{p_partkey}"], lambda c: F.array_join(X.block_ids(c), ","), "array_to_string(regexp_extract_all(s, '\\^([A-Za-z0-9][A-Za-z0-9_-]*)', 1), ',')")
_PAGES = ["## {p_name}\n**{p_type}** [[{p_brand}|{p_name}]] ^p{p_partkey}", "`{p_name}` and [{p_brand}](u)  x", "- {p_name}\n> {p_type}\n```\ncode\n```\n~~{p_brand}~~", "![{p_name}](x) __{p_type}__ =={p_brand}=="]
rule("tx17_reading_text", _PAGES, X.strip_markdown, "trim(" + replaced("s", (r"(?s)```.*?```", " "), (r"`([^`]*)`", r"\1"), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[\[([^\]|]*)\|([^\]]*)\]\]", r"\2"), (r"\[\[([^\]]*)\]\]", r"\1"), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*>\s?", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"\*\*|__|~~|==", ""), (r"\s\^[A-Za-z0-9-]+", ""), (r"[ \t]+", " ")) + ")")
_FILES = ["---\ntitle: {p_name}\n---\n{p_type} [[{p_brand}]] %%{p_name}%% ^p1\n> [!note] {p_name}\n> {p_type}\nrest\n---\nend\n", "{p_name} [[{p_type}]]\n", "> [!tip]\n{p_name}", "{p_type} ^b{p_partkey}\n---\n{p_name}"]
_FRONT, _CALLOUT = (r"^---[\s\S]*?---\n", ""), (r"> \[!.*?\][^\n]*\n(> .*\n)*", "")
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
rule("tx14_indexed_text", _FILES, X.indexed_text, f"trim({replaced('s', _FRONT, _CALLOUT)}, {_BLANK})")
rule("tx14_card_source", _FILES, X.card_source, f"trim({replaced('s', _FRONT, (r'\[\[.*?\]\]', ''), _CALLOUT, (r'%%.*?%%', ''), (r'\^[a-zA-Z0-9_-]+', ''))}, {_BLANK})")
rule("tx14_reading_source", _FILES, X.reading_source, f"trim({replaced('s', _FRONT, (r'\[\[.*?\]\]', ''), _CALLOUT, (r'\n---+\n', '\n\n'))}, {_BLANK})")
rule("tx18_first_sentence", ["{p_name}。{p_type}！", "{p_name}", "{p_name}? {p_type}", "{p_name}\n{p_type}! {p_brand}"], lambda c: F.coalesce(X.first_sentence(c)["sentence"], F.lit("-")), "coalesce(nullif(regexp_extract(s, '(?s)^(.*?[。！？!?])', 1), ''), '-')")
rule("tx15_strip_controls", ["{p_name}\x01{p_type}", "\x02", "", "{p_name}\t{p_brand}\x0b"], X.strip_controls, "CASE WHEN trim({0}) = '' THEN ' ' ELSE {0} END".format(replaced("s", (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))))
rule("tx16_embedded_cut", ["{text}", "{text} {text}"], lambda c: F.concat_ws(",", F.length(X.truncated_for(c, F.lit("BAAI/bge-m3"))).cast("string"), F.length(X.truncated_for(c, F.lit("qwen"))).cast("string")), "length(left(s, 400))::VARCHAR || ',' || length(left(s, 8000))::VARCHAR", "documents", "doc_id")
_ASKED = ["什么是{p_name}？", "请问{p_name}, {p_type}.", "{p_name}！", "讲讲, {p_brand}", "{p_name} {p_type} {p_name} {p_type} {p_name} {p_type} {p_name} {p_type} {p_name} {p_type} {p_name} {p_type} {p_name} {p_type}"]
_BARE = f"trim({replaced('s', (r'(?i)^(什么是|如何理解|请问|帮我|解释一下|讲讲|详细说说)', ''), (r'[？?。.!！，,]', ''))})"
rule("tx24_topic", _ASKED, X.topic_of, f"CASE WHEN length({_BARE}) <= 150 THEN {_BARE} ELSE left({_BARE}, 90) || ' ... ' || right({_BARE}, 55) END")
rule("tk14_pre_search_depth", _ASKED + ["{p_brand}", "复利"], lambda c: F.when(F.length(c) < 8, 5).when(F.length(c) > 30, 15).otherwise(10), "CASE WHEN length(s) < 8 THEN 5 WHEN length(s) > 30 THEN 15 ELSE 10 END")
rule("js2_clean_json", ["{{'a': None, '{p_name}': [True, False,],}}".replace("{{", "{").replace("}}", "}"), "[{p_partkey}, 2, ]", "'{p_type}'"], X.clean_json, replaced("s", ("None", "null"), ("True", "true"), ("False", "false"), (r",\s*]", "]"), (r",\s*\}", "}"), ("'", '"')))
rule("tx42_heading_lines", ["Chapter {p_partkey}", "{p_name} sentence here", "THE END {p_partkey}", "{p_partkey}. {p_name}", "- {p_name}", "Ends with stop.", "Deep Value", "第三章 {p_name}"],
     lambda c: X.looks_like_heading(c, F.lit("x")), r"length(s) BETWEEN 4 AND 99 AND NOT regexp_matches(s, '[.，。；：]$') AND (regexp_matches(s, '^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$') OR regexp_matches(s, '^[A-Z\s\d]{5,}$') OR regexp_matches(s, '^(?i:Chapter|Section|Part|第[一二三四五六七八九十\d]+章|\d+\.)'))")

# Questions -----------------------------------------------------------------------------------------------------

QUESTIONS = ["你说{p_name}不对", "不，再看看{p_name}", "再搜索一下{p_type}", "明明就有{p_name}", "不对", "什么是{p_name}", "引错{p_name}了", "对比{p_name}和{p_type}", "{p_name}的异同", "你好！", "画一张{p_name}图", "make an infographic of {p_name}", "书中未提及{p_name}", "HELLO", "Bye!"]
_REASON = "CASE " + " ".join(f"WHEN regexp_matches(s, {quoted('|'.join(words))}) THEN {quoted(reason)}" for reason, words in I.CORRECTIONS.items()) + " END"
rule("fp18_correction_reason", QUESTIONS, I.correction_reason, _REASON)
rule("fp18_is_correction", QUESTIONS, I.is_correction, f"length(trim(s)) >= 3 AND ({_REASON}) IS NOT NULL")
rule("fp19_claims_absence", QUESTIONS, lambda c: I.claims_absence(c, F.lit("q")), f"s <> '' AND regexp_matches(s, {quoted(I.ABSENCE)})")
rule("fp22_compares_books", QUESTIONS, I.compares_books, " OR ".join(f"contains(lower(s), {quoted(w)})" for w in I.COMPARISONS))
rule("fp23_wants_diagram", QUESTIONS, I.wants_diagram, f"regexp_matches(s, {quoted(I.DIAGRAM)})")
rule("fp30_small_talk", QUESTIONS, lambda c: I.is_small_talk(c, F.lit(False), F.lit(False)), f"regexp_matches(trim(s), {quoted(I.GREETING)}) OR length(trim(s)) <= 5")


@query("WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '的' || left(p_name, 1) ELSE left(p_name, 4) || '了' END AS concept, p_partkey % 10 / 10.0 AS score, p_type AS content FROM part), y AS (SELECT *, regexp_replace(concept, '[的了着过吗呢吧啊\\s]', '', 'g') AS b FROM x) SELECT p_partkey, score >= 0.5 AND CASE WHEN length(b) < 2 THEN contains(lower(content), b) ELSE len(list_filter(range(1, length(b)), lambda i: contains(lower(content), substr(b, i, 2)))) > 0 END AS found FROM y")
def fp21_existence_match(spark, d):
    k = F.col("p_partkey")
    concept = F.when(k % 5 == 0, F.concat(F.lit("的"), F.left("p_name", F.lit(1)))).otherwise(F.concat(F.left("p_name", F.lit(4)), F.lit("了")))
    return t(spark, d, "part").select("p_partkey", I.strong_match(concept, k % 10 / 10.0, F.lower("p_type")).alias("found"))


@query("""WITH x AS (SELECT conv_id, text, regexp_matches(text, '[Tt]he') AS a, regexp_matches(text, 'que|und') AS b FROM conversations), g AS (SELECT conv_id, bool_or(a) AS a, bool_or(b) AS b FROM x GROUP BY 1)
 SELECT conv_id, CASE WHEN a AND b THEN 'search|compare' WHEN a THEN 'search' WHEN b THEN 'compare' ELSE 'chat' END AS intents, CASE WHEN a AND b OR b THEN 'search_book|read_section' WHEN a THEN 'search_book' ELSE 'none' END AS tools, (CASE WHEN b THEN 8 WHEN a THEN 3 ELSE 1 END)::BIGINT AS iterations FROM g""")
def fp26_routed_intents(spark, d):
    rules = [("[Tt]he", "search", ["search_book"], 3), ("que|und", "compare", ["search_book", "read_section"], 8)]
    out = O.routed_intents(_chat(spark, d), rules, "conv_id", "text", ("chat", ["none"], 1))
    return out.select("conv_id", F.array_join("intents", "|").alias("intents"), F.array_join("tools", "|").alias("tools"), F.col("iterations").cast("long").alias("iterations"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 'none' WHEN p_retailprice / 2000 >= 0.7 AND (p_size / 50.0) >= 0.4 AND (CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 20 END + least(length(p_type) * 8 / 10, 30) + CASE WHEN length(p_type) * 8 > 20 THEN 15 ELSE 0 END) >= 40 AND NOT p_partkey % 7 = 0 THEN 'stop'
 WHEN p_retailprice / 2000 >= 0.25 THEN 'hybrid' ELSE 'keep' END AS phase FROM (SELECT * REPLACE (p_retailprice - 900 AS p_retailprice) FROM part)""".replace("(p_size / 50.0) >= 0.4", "(p_size / 25.0) >= 0.8"))
def rt13_search_phase(spark, d):
    p, k = t(spark, d, "part"), F.col("p_partkey")
    phase = U.search_phase(k % 4, F.col("p_retailprice") - 900, F.lit(2000.0), F.col("p_size") / 25.0, F.when(k % 3 == 0, "").otherwise("p1"), F.length("p_type") * 8, k % 7 == 0)
    return p.select("p_partkey", phase.alias("phase"))


# Chats ---------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, round((length(text) + CASE WHEN turn % 3 = 0 THEN length(role) ELSE 0 END) / 2)::BIGINT AS n FROM conversations")
def tx5_message_tokens(spark, d):
    return _chat(spark, d).select("conv_id", "turn", X.message_tokens(F.col("text"), F.when(F.col("turn") % 3 == 0, F.col("role"))).alias("n"))


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 2 THEN left(text, 4) ELSE text END AS text FROM conversations),
 w AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN length(text) END IGNORE NULLS) OVER p AS answer, count(*) OVER p AS before FROM m WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT conv_id, turn, role = 'user' AND length(text) <= 5 AND before >= 2 AND coalesce(answer, 0) > 200 AS continues FROM w""")
def fp24_short_reply(spark, d):
    m = _chat(spark, d).withColumn("text", F.when(F.col("turn") % 4 == 2, F.left("text", F.lit(4))).otherwise(F.col("text")))
    return M.inherited_depth(m, "conv_id", "turn").select("conv_id", "turn", "continues")


@query("SELECT conv_id, turn, length(text) % 2 = 0 AS even FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1")
def jn12_first_of(spark, d):
    rows = _chat(spark, d).withColumn("key", F.concat_ws("/", F.col("conv_id").cast("string"), "role"))
    return C.first_of(rows, "key", [F.col("turn")]).select("conv_id", "turn", (F.length("text") % 2 == 0).alias("even"))


# Shelves and notebooks -----------------------------------------------------------------------------------------

_SHELF = """r AS (SELECT o_orderkey AS book_id, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE o_orderpriority END AS title, (o_orderkey % 4)::INT AS book_type, (o_orderkey % 9)::INT AS notes, (o_orderkey % 5)::INT AS reviews FROM orders WHERE o_orderkey % 11 <> 0),
 s AS (SELECT o_orderkey AS book_id, (CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 7 ELSE o_orderkey % 9 END)::INT AS notes, (o_orderkey % 5)::INT AS reviews FROM orders WHERE o_orderkey % 3 <> 0), f AS (SELECT o_orderkey AS book_id FROM orders WHERE o_orderkey % 13 = 0),
 b AS (SELECT r.*, s.book_id IS NULL AS is_new, s.notes AS n0, s.reviews AS r0 FROM r LEFT JOIN s USING (book_id) WHERE title <> '' AND book_type <> 3 AND r.notes + r.reviews >= 3), w AS (SELECT b.*, f.book_id IS NOT NULL AS failed FROM b LEFT JOIN f USING (book_id) WHERE is_new OR b.notes <> n0 OR b.reviews <> r0)"""


def _shelf(spark, d):
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    own = lambda notes: [k.alias("book_id"), F.when(k % 17 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), (k % 4).cast("int").alias("book_type"), notes.cast("int").alias("notes"), (k % 5).cast("int").alias("reviews")]
    state = o.where("o_orderkey % 3 <> 0").select(*own(F.when(k % 6 == 0, k % 7).otherwise(k % 9)), F.lit(1).cast("long").alias("last_sync_time"))
    failed = o.where("o_orderkey % 13 = 0").select(k.alias("book_id"), F.lit("late").alias("error"))
    return B.synced_shelf(o.where("o_orderkey % 11 <> 0").select(*own(k % 9)), state, failed, F.lit(2).cast("long"), least_notes=3)


@query(f"WITH {_SHELF} SELECT book_id, is_new FROM w")
def fp8_shelf_filters(spark, d):
    return _shelf(spark, d).to_sync.select("book_id", "is_new")


@query(f"""WITH {_SHELF} SELECT (SELECT count(*) FROM b) AS total_books, count(*) FILTER (NOT failed) AS synced_books, (SELECT count(*) FROM b) - count(*) AS skipped_books, count(*) FILTER (NOT failed AND is_new) AS added,
 count(*) FILTER (NOT failed AND NOT is_new) AS updated, count(*) FILTER (failed) = 0 AS success, count(*) FILTER (failed) AS errors FROM w""")
def rt23_sync_log(spark, d):
    log = _shelf(spark, d).log
    return log.select("total_books", "synced_books", "skipped_books", "added", "updated", "success", F.size(F.split("error_message", "; ")).cast("long").alias("errors"))


@query(f"WITH {_SHELF} SELECT book_id, notes, 2::BIGINT AS last_sync_time FROM w WHERE NOT failed UNION ALL SELECT book_id, notes, 1 FROM s WHERE book_id NOT IN (SELECT book_id FROM w WHERE NOT failed)")
def rt23_sync_state(spark, d):
    return _shelf(spark, d).state.select("book_id", "notes", "last_sync_time")


@query("""SELECT c_custkey AS book_id, n AS note_count, 0::BIGINT + n % 3 AS review_count, CASE WHEN o.c IS NULL THEN NULL ELSE 0.0 END::DOUBLE AS progress, CASE WHEN o.c IS NULL THEN NULL WHEN n * 700 >= 3600 THEN (n * 700 // 3600)::VARCHAR || '小时' || (n * 700 % 3600 // 60)::VARCHAR || '分钟' ELSE (n * 700 // 60)::VARCHAR || '分钟' END AS reading_time,
 CASE WHEN o.c IS NULL THEN NULL ELSE '2023-11-14' END AS last_read_date FROM customer LEFT JOIN (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1) o ON c = c_custkey""")
def jn18_mapping_stats(spark, d):
    n = F.col("notes")
    state = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("book_id")).agg(F.count("*").alias("notes")).select("book_id", "notes", (n % 3).alias("reviews"), F.lit(None).cast("double").alias("progress"), (n * 700).alias("reading_time"), F.lit(1_700_000_000_000).alias("last_sync_time"))
    return B.mapping_with_stats(t(spark, d, "customer").select(F.col("c_custkey").alias("book_id")), state)


@query("WITH q AS (SELECT user_id, CASE WHEN event_id % 31 = 0 THEN 'poor' WHEN event_id % 7 = 0 THEN 'degraded' ELSE 'good' END AS q FROM events WHERE event_id % 5 = 0) SELECT user_id, CASE WHEN bool_or(q = 'poor') THEN 'poor' WHEN bool_or(q = 'degraded') THEN 'degraded' ELSE 'good' END AS quality, count(*) AS layers FROM q GROUP BY 1")
def ag17_overall_quality(spark, d):
    i = F.col("event_id")
    layers = t(spark, d, "events").where("event_id % 5 = 0").select("user_id", F.when(i % 31 == 0, "poor").when(i % 7 == 0, "degraded").otherwise("good").alias("q"))
    return B.overall_quality(layers, "user_id", "q")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderpriority, o_orderkey) - 1 AS place FROM orders")
def tk11_shelf_order(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "processing").otherwise("ready").alias("status"), "o_orderpriority")
    return B.shelf_order(o, "status", [F.col("o_orderpriority"), F.col("o_orderkey")]).select("o_orderkey", "place")


@query("SELECT count(*) AS queries, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic FROM labels")
def ag34_mean_metrics(spark, d):
    return Q.mean_metrics(t(spark, d, "labels"), ["quality", "toxic"])


@query("SELECT source AS book, count(*) AS queries, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def ag34_mean_by_book(spark, d):
    rows = t(spark, d, "labels").join(nodes(spark, d).select("doc_id", F.col("source").alias("book")), "doc_id")
    return Q.mean_metrics(rows, ["quality", "toxic"], "book")


@query("WITH g AS (SELECT o_custkey % 40 AS book FROM orders) SELECT count(*) FILTER (book IN (SELECT s_suppkey % 31 FROM supplier)) AS kept, count(*) FILTER (book NOT IN (SELECT s_suppkey % 31 FROM supplier)) AS skipped FROM g")
def jn32_golden_queries(spark, d):
    golden = t(spark, d, "orders").select((F.col("o_custkey") % 40).alias("book"))
    kept, skipped = Q.answerable(golden, t(spark, d, "supplier").select((F.col("s_suppkey") % 31).alias("book")), "book")
    return kept.agg(F.count("*").alias("kept")).crossJoin(skipped)


@query("""WITH n AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderkey % 100 AS p, CASE WHEN o_orderkey % 8 = 0 THEN o_orderpriority END AS m FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'Pending' ELSE o_orderstatus END AS s, o_orderkey % 100 + o_orderkey % 7 AS p, CASE WHEN o_orderkey % 16 = 0 THEN o_orderpriority ELSE '' END AS m FROM orders WHERE o_orderkey % 3 <> 0),
 st AS (SELECT id, CASE s WHEN 'F' THEN 'ready' WHEN 'O' THEN 'processing' ELSE '' END AS s, p, m FROM n), sb AS (SELECT id, CASE s WHEN 'F' THEN 'ready' WHEN 'O' THEN 'processing' WHEN 'P' THEN '' ELSE s END AS s, p, m FROM b)
 SELECT st.id, sb.id IS NULL AS new, sb.id IS NOT NULL AND (CASE WHEN st.s = '' THEN 'unknown' ELSE st.s END <> lower(sb.s) OR abs(st.p - sb.p) >= 5 OR coalesce(st.m, '') <> sb.m) AS changed, sb.id IS NOT NULL AND lower(sb.s) IN ('processing', 'pending') AND st.s = 'ready' AS completed FROM st LEFT JOIN sb USING (id)""")
def jn38_index_changes(spark, d):
    o, k, s = t(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(s == "F", "ready").when(s == "O", "processing").otherwise("")
    now = o.where("o_orderkey % 10 <> 0").select(k.alias("id"), status.alias("status"), (k % 100).alias("progress"), F.when(k % 8 == 0, F.col("o_orderpriority")).alias("message"))
    before = o.where("o_orderkey % 3 <> 0").select(k.alias("id"), F.when(k % 9 == 0, "Pending").otherwise(status).alias("status"), (k % 100 + k % 7).alias("progress"), F.when(k % 16 == 0, F.col("o_orderpriority")).otherwise("").alias("message"))
    return O.index_changes(now, before, "id")


@query("""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 2 = 0 END AS a FROM orders WHERE o_orderkey % 3 <> 0), w AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0)
 SELECT coalesce(c.id, w.id) AS id, CASE WHEN c.id IS NULL THEN true WHEN w.id IS NOT NULL THEN NOT coalesce(a, false) ELSE coalesce(a, false) END AS archived, w.id IS NOT NULL AS toggled FROM c FULL JOIN w ON c.id = w.id""")
def st11_toggled_archive(spark, d):
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    catalog = o.where("o_orderkey % 3 <> 0").select(k.alias("id"), F.when(k % 4 > 0, k % 2 == 0).alias("archived"))
    return O.toggled_archive(catalog, o.where("o_orderkey % 5 = 0").select(k.alias("id")), "id")


@query("""WITH s AS (SELECT source, doc_id % 50 + CASE WHEN source IN ('src1', 'src2') THEN 1 ELSE 2 END AS start, lang AS title FROM documents) SELECT source, start, title FROM s UNION ALL SELECT source, 1, 'Preface' FROM s GROUP BY 1 HAVING min(start) > 1""")
def ar4_preface(spark, d):
    start = F.col("doc_id") % 50 + F.when(F.col("source").isin("src1", "src2"), 1).otherwise(2)
    return O.with_preface(t(spark, d, "documents").select("source", start.alias("start"), F.col("lang").alias("title")), "source", "start", "title")


@query("""WITH a AS (SELECT p_partkey, list_distinct([p_size % 5, p_partkey % 4]) AS a, list_distinct([p_partkey % 5, p_size % 3]) AS b FROM part)
 SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS blocks FROM a""")
def st8_searched_blocks(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    both = F.array_union(F.array(s.cast("long") % 5, k % 4), F.array(k % 5, s.cast("long") % 3))
    return t(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(both), ",").alias("blocks"))


# Structure -----------------------------------------------------------------------------------------------------

_MARKED = f"{_LINES}, m AS (SELECT doc_id, line, CASE (doc_id + line) % 7 WHEN 0 THEN '# ' || left(text, 12) WHEN 2 THEN '```' WHEN 3 THEN '### ' || left(text, 9) || '  ' WHEN 5 THEN '####### x' ELSE text END AS text FROM ln)"


@query(f"""WITH {_MARKED}, f AS (SELECT *, regexp_matches(text, '^\\s*```') AS mark, sum(regexp_matches(text, '^\\s*```')::INT) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 1 AS inside FROM m)
 SELECT doc_id, line, length(regexp_extract(text, '^(#{{1,6}})\\s', 1))::BIGINT AS level, trim(regexp_replace(text, '^#{{1,6}}\\s+', '')) AS title FROM f WHERE NOT mark AND NOT inside AND regexp_matches(text, '^#{{1,6}}\\s+\\S')""")
def wn5_headings_outside_fences(spark, d):
    rows, k = N.lines(nodes(spark, d), "doc_id"), (F.col("doc_id") + F.col("line")) % 7
    cut = lambda n: F.left("text", F.lit(n))
    text = F.when(k == 0, F.concat(F.lit("# "), cut(12))).when(k == 2, "```").when(k == 3, F.concat(F.lit("### "), cut(9), F.lit("  "))).when(k == 5, "####### x").otherwise(F.col("text"))
    return N.headings(rows.withColumn("text", text), "doc_id")


@query(f"""WITH {_LINES}, h AS (SELECT doc_id, line, (length(text) + line) % 4 + 1 AS level, length(text) AS n FROM ln), p AS (SELECT a.doc_id, a.line, a.n, max(b.line) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.line < a.line AND b.level < a.level GROUP BY 1, 2, 3),
 k AS (SELECT doc_id, parent AS line, max(line) AS e, sum(n) AS more FROM p WHERE parent IS NOT NULL GROUP BY 1, 2) SELECT doc_id, line, parent, coalesce(e, line) AS "end", (n + coalesce(more, 0))::BIGINT AS total FROM p LEFT JOIN k USING (doc_id, line)""")
def wn27_rolled_up(spark, d):
    rows = N.lines(nodes(spark, d), "doc_id").select("doc_id", "line", ((F.length("text") + F.col("line")) % 4 + 1).alias("level"), F.length("text").cast("long").alias("n"))
    return N.rolled_up(rows, "doc_id", "n").select("doc_id", "line", "parent", "end", "total")


@query("""WITH w AS (SELECT o_custkey % 200 AS a, o_orderkey AS k, 'p' || lpad((o_orderkey % 90)::VARCHAR, 3, '0') || CASE WHEN o_orderkey % 4 = 0 THEN '7' ELSE '' END AS b FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT o_custkey % 200 AS a, o_orderkey AS o, CASE WHEN o_orderkey % 13 = 0 THEN 'x-y' ELSE 'p' || lpad((o_orderkey % 70)::VARCHAR, 3, '0') END AS b FROM orders WHERE o_orderkey % 3 = 1),
 j AS (SELECT w.k, n.b, n.o, CASE WHEN w.b = n.b THEN 0 WHEN starts_with(n.b, regexp_replace(w.b, '^p', '')) OR starts_with(regexp_replace(w.b, '^p', ''), regexp_replace(n.b, '^p', '')) THEN 1 WHEN regexp_matches(n.b, '\\d') THEN 2 END AS c, abs(TRY_CAST(regexp_extract(n.b, '(\\d+)', 1) AS BIGINT) - TRY_CAST(regexp_extract(w.b, '(\\d+)', 1) AS BIGINT)) AS far FROM w JOIN n USING (a))
 SELECT k, b FROM j WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY c, CASE WHEN c = 2 THEN far ELSE 0 END, o) = 1""")
def jn27_block_repair(spark, d):
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    number = lambda n: F.concat(F.lit("p"), F.lpad((k % n).cast("string"), 3, "0"))
    wanted = o.where("o_orderkey % 3 = 0").select((F.col("o_custkey") % 200).alias("a"), k.alias("k"), F.concat(number(90), F.when(k % 4 == 0, "7").otherwise("")).alias("b"))
    known = o.where("o_orderkey % 3 = 1").select((F.col("o_custkey") % 200).alias("a"), k.alias("o"), F.when(k % 13 == 0, "x-y").otherwise(number(70)).alias("b"))
    return W.repaired_blocks(wanted, known, "a", "k", "b", "o")


@query("""WITH e AS (SELECT item_id AS q, doc_id::VARCHAR AS entry, round((doc_id % 13 + 1) / 10.0, 2) AS score FROM benchmark JOIN documents ON doc_id % 40 = item_id % 40 AND item_id % 3 > 0), n AS (SELECT item_id AS q, doc_id AS k FROM benchmark JOIN documents ON doc_id % 60 = item_id % 60),
 m AS (SELECT q, max(score) AS top FROM e GROUP BY 1) SELECT q, entry, score, false AS annotation FROM e UNION ALL SELECT q, 'annotation-' || (row_number() OVER (PARTITION BY q ORDER BY k) - 1)::VARCHAR, round(coalesce(top, 0.02) * 1.3, 6), true FROM n LEFT JOIN m USING (q)""")
def tk8_annotations(spark, d):
    docs, q = nodes(spark, d).select("doc_id"), asked(spark, d).select(F.col("item_id").alias("q"))
    entries = q.where("q % 3 > 0").join(docs, F.col("doc_id") % 40 == F.col("q") % 40).select("q", F.col("doc_id").alias("k"), F.round((F.col("doc_id") % 13 + 1) / 10.0, 2).alias("score"))
    notes = q.join(docs, F.col("doc_id") % 60 == F.col("q") % 60).select("q", F.col("doc_id").alias("k"))
    return W.with_annotations(entries, notes, "q", "k")


# Tokens, marks and lists ---------------------------------------------------------------------------------------

_MIXED = ["{p_name} 机器学习 {p_brand}", "{p_type} of the 复利", "{p_name}你好 a a b", "自己投资{p_partkey}", "{p_type}", ""]
_CJK = "[㐀-䶿一-鿿豈-﫿]"
_RUNS = f"regexp_extract_all(s, '{_CJK}+')"
_OF = "list_transform(range(1, length({0}) + 2 - {1}), lambda i: substr({0}, i, {1}))"
_WORDS_OF = "list_filter(string_split_regex(lower(s), '[^a-z0-9_]+'), lambda w: w <> '')"
_LEXICAL = f"list_concat(flatten(list_transform({_RUNS}, lambda r: list_concat(CASE WHEN length(r) >= 2 THEN [r] ELSE [] END, list_concat({_OF.format('r', 1)}, {_OF.format('r', 2)})))), {_WORDS_OF})"
_STOPS = "[" + ", ".join(quoted(w) for w in X.STOP_WORDS) + "]"
_JOINED = "array_to_string(list_sort({0}), '|')"
joined = lambda c: F.array_join(F.array_sort(c), "|")
rule("tx1_lexical_tokens", _MIXED, lambda c: joined(X.lexical_tokens(c)), _JOINED.format(_LEXICAL))
rule("tx3_stop_words", _MIXED, lambda c: joined(X.query_tokens(c)), _JOINED.format(f"list_filter(list_distinct({_LEXICAL}), lambda w: NOT list_contains({_STOPS}, w))"))
rule("tx2_vault_tokens", _MIXED, lambda c: joined(X.vault_tokens(c)), _JOINED.format(f"list_distinct(CASE WHEN regexp_matches(s, '{_CJK}') THEN list_concat(list_filter(string_split_regex(lower(s), '[^a-z0-9_{_CJK[1:-1]}]+'), lambda w: w <> ''), flatten(list_transform({_RUNS}, lambda r: {_OF.format('r', 2)}))) ELSE {_WORDS_OF} END)"))
rule("fp20_existence_bigrams", _MIXED, lambda c: joined(S.bigrams(c)), _JOINED.format("list_distinct(" + _OF.format(replaced("s", (r"\s+", "")), 2) + ")"))
rule("fp20_asked_concept", ["书里有没有提到{p_name}？", "是否讨论了{p_type}", "作者有没有讲到《{p_brand}》的内容", "{p_name}吗？"], I.asked_concept, "trim(" + replaced("s", (r"^.*?(?:有没有|是否)(?:提到|讲到|说到|涉及|讨论)?\s*", ""), (r"[？?。！!《》]", ""), (r"\s*(?:的|内容|相关|有关)$", ""), (r"^[的了着过吗呢吧啊]+\s*|\s*[的了着过吗呢吧啊]+$", "")) + ")")
rule("tx11_bounded_name", ["{p_name}/{p_brand}:  {p_type}", "???", "{p_name}", ""], X.bounded_name, "coalesce(nullif(left(trim(" + replaced("s", (r'[\x00-\x1f\\/:*?"<>|]', ""), (r"\s+", " ")) + "), 240), ''), 'untitled')")
rule("tx38_dotted_leaders", ["{p_name}......{p_partkey}", "{p_name}. {p_type}", "{p_name} . . . . . . . {p_partkey}"], K.dotted_leaders, replaced("s", (r"\.{5,}", ": "), (r"(?:\. ){5,}\.?", ": ")))
rule("tx39_page_marks", ["<start_index_{p_partkey}> {p_name} <start_index_7>", "<start_index_{p_size}>", "{p_name}"], lambda c: F.concat_ws(",", K.page_marks(c)["first"].cast("string"), K.page_marks(c)["last"].cast("string")), "coalesce(regexp_extract_all(s, '<start_index_(\\d+)>', 1)[1] || ',' || regexp_extract_all(s, '<start_index_(\\d+)>', 1)[-1], '')")
rule("tx40_physical_index", ["<physical_index_{p_partkey}>", "{p_size}", "{p_name}"], lambda c: K.physical_index(c).cast("long"), "TRY_CAST(regexp_extract(s, '(\\d+)', 1) AS BIGINT)")
rule("tx37_title_kind", ["第一部 {p_name}", "第{p_partkey}章 {p_type}", "第2节 {p_name}", "1.{p_size} Setup", "前言", "Chapter {p_size}", "part two {p_name}", "{p_name}", "Appendix {p_brand}"], K.title_kind,
     r"CASE WHEN regexp_matches(s, '^(第[一二三四五六七八九十百零\d]+[部篇卷]|(?i:part|book|volume)\s)') THEN 'part' WHEN regexp_matches(s, '^(第[一二三四五六七八九十百零\d]+[章回]|(?i:chapter)\s)') THEN 'chapter' WHEN regexp_matches(s, '^(第[一二三四五六七八九十百零\d]+节|\d+\.\d+)') THEN 'section' WHEN regexp_matches(s, '^(?i:前言|序言?|目录|附录|后记|致谢|preface|foreword|contents|appendix|index|acknowledg)') THEN 'special' ELSE 'plain' END")
rule("tx29_moved_links", ["[[old]] {p_name} [[old#{p_brand}]]", "[[old|{p_name}]] [[older]]", "{p_type} [[{p_name}]]"], lambda c: K.moved_links(c, "old", "new"), replaced("s", (r"\[\[old([\]|#])", r"[[new\1")))
rule("tx41_facts", ["[{p_brand}] {p_name}；{p_type}", "[a] {p_name}\n[b] y;{p_type}", "{p_name}"], lambda c: F.array_join(F.transform(K.labelled_facts(c), lambda x: F.concat(x["dimension"], F.lit("="), x["fact"])), "|"),
     r"coalesce(array_to_string(flatten(list_transform(list_filter(string_split(s, chr(10)), lambda l: regexp_matches(l, '^\s*\[[^\]]+\]')), lambda l: list_transform(list_filter(string_split_regex(regexp_extract(l, '^\s*\[[^\]]+\]\s*(.*)$', 1), '[；;]'), lambda f: trim(f) <> ''), lambda f: regexp_extract(l, '\[([^\]]+)\]', 1) || '=' || trim(f)))), '|'), '')")
rule("js1_json_in_text", ["<think>{p_name}</think>```json\n{\"a\": {p_partkey}}\n```", "so: {\"a\": [{p_size}, 2,]} done", "{p_name}", "{\"a\": None, \"b\": \"{p_name}\"}"], X.json_in_text,
     "nullif(" + replaced("regexp_extract(CASE WHEN regexp_extract({0}, '(?s)```(?:json)?\\s*(.*?)```', 1) <> '' THEN regexp_extract({0}, '(?s)```(?:json)?\\s*(.*?)```', 1) ELSE {0} END, '(?s)([\\[{{].*[\\]}}])', 1)".format(replaced("s", (r"(?s)<think>.*?</think>", ""))), (r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r",\s*([\]}])", r"\1")) + ", '')")


@query("""WITH m AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'special' WHEN 1 THEN 'part' ELSE 'chapter' END AS kind FROM conversations)
 SELECT conv_id, turn, kind, coalesce(last_value(CASE kind WHEN 'part' THEN 1 WHEN 'special' THEN 0 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS inside FROM m""")
def wn26_inside_part(spark, d):
    k = (F.col("conv_id") + F.col("turn")) % 5
    rows = _chat(spark, d).select("conv_id", "turn", F.when(k == 0, "special").when(k == 1, "part").otherwise("chapter").alias("kind"))
    return G.inside_part(rows, "conv_id", "turn", "kind")


@query("""WITH f AS (SELECT 'd' || (o_custkey % 60)::VARCHAR || '/' || CASE WHEN o_custkey % 60 % 7 = 0 AND o_orderkey % 40 = 1 THEN '_目录.md' WHEN o_orderkey % 5 < o_custkey % 60 % 6 THEN '1995-01-0' || (o_orderkey % 9 + 1)::VARCHAR || '.md' ELSE o_orderkey::VARCHAR || '-' || o_orderpriority || '.md' END AS path FROM orders),
 g AS (SELECT string_split(path, '/')[1] AS directory, count(*) AS files, bool_or(ends_with(path, '/_目录.md')) AS book, avg(regexp_matches(regexp_extract(path, '([^/]+)$', 1), '^\\d{4}[-./]?\\d{2}([-./]?\\d{2})?')::INT) AS dated FROM f GROUP BY 1)
 SELECT directory, files, CASE WHEN book THEN 'book' WHEN dated > 0.6 THEN 'timeline' ELSE 'mixed' END AS kind, NOT book AND files > 30 AS needs_reorg FROM g""")
def sc12_directory_kinds(spark, d):
    o, k, c = t(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey") % 60
    name = F.when((c % 7 == 0) & (k % 40 == 1), "_目录.md").when(k % 5 < c % 6, F.concat(F.lit("1995-01-0"), (k % 9 + 1).cast("string"), F.lit(".md"))).otherwise(F.concat(k.cast("string"), F.lit("-"), "o_orderpriority", F.lit(".md")))
    return classified_directories(o.select(F.concat(F.lit("d"), c.cast("string"), F.lit("/"), name).alias("path")))


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderpriority AS title, o_orderkey % 50 AS start, NULL::BIGINT AS "end", CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'old' END AS summary FROM orders), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 9 END AS start, o_orderkey % 8 AS "end", CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE '' END AS summary FROM orders WHERE o_orderkey % 7 > 0)
 SELECT t.id, title, coalesce(n.start, t.start) AS start, coalesce(n."end", t."end") AS "end", coalesce(nullif(n.summary, ''), nullif(t.summary, '')) AS summary FROM t LEFT JOIN n USING (id)""")
def jn11_enriched_tree(spark, d):
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    tree = o.select(k.alias("id"), F.col("o_orderpriority").alias("title"), (k % 50).alias("start"), F.lit(None).cast("long").alias("end"), F.when(k % 4 == 0, "").otherwise("old").alias("summary"), F.lit(None).cast("string").alias("text"))
    flat = o.where("o_orderkey % 7 > 0").select(k.alias("id"), F.when(k % 3 == 0, k % 9).alias("start"), (k % 8).alias("end"), F.when(k % 5 == 0, "new").otherwise("").alias("summary"), F.lit("").alias("text"))
    return O.enriched_tree(tree, flat, "id").drop("text")


@query("""WITH n AS (SELECT p_partkey AS id, list_distinct([p_brand, p_container]) AS tags, [p_brand] AS existing, p_type AS target, CASE WHEN p_partkey % 3 = 0 THEN [p_type] ELSE [] END AS removed FROM (SELECT *, 'c' || (p_size % 7)::VARCHAR AS p_container FROM part))
 SELECT id, array_to_string(list_filter(tags, lambda x: NOT list_contains(existing, x)), '|') AS tags, CASE WHEN list_contains(removed, target) THEN '' ELSE '[[' || target || '|' || target || ']]' END AS links FROM n""")
def tx46_merge_plan(spark, d):
    tag, none = F.concat(F.lit("c"), (F.col("p_size") % 7).cast("string")), F.array().cast("array<string>")
    notes = t(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.array_distinct(F.array("p_brand", tag)).alias("tags"), F.array("p_brand").alias("existing"), F.array(F.struct(F.col("p_type").alias("target"), F.col("p_type").alias("text"))).alias("links"),
        F.when(F.col("p_partkey") % 3 == 0, F.array("p_type")).otherwise(none).alias("removed"),
    )
    out = W.merge_plan(notes, "id")
    return out.select("id", F.array_join("new_tags", "|").alias("tags"), F.array_join(F.transform("links", lambda x: x["replacement"]), "|").alias("links"))


@query("""WITH e AS (SELECT conv_id, turn, text, '《' || lower(regexp_extract(text, '[A-Za-z]+')) || '》《' || role || '》' AS entry FROM conversations), n AS (SELECT conv_id * 1000 + turn AS o, unnest(regexp_extract_all(entry, '《(.+?)》', 1)) AS title, generate_subscripts(regexp_extract_all(entry, '《(.+?)》', 1), 1) AS p FROM e),
 f AS (SELECT title, min(o * 10 + p) AS first FROM n GROUP BY 1), l AS (SELECT * FROM f ORDER BY first DESC LIMIT 5) SELECT (SELECT count(*) FROM f) AS books, string_agg(title, '、' ORDER BY first) AS recent FROM l""")
def ag28_reading_summary(spark, d):
    """The first word of every message, and its role, as titles read."""
    entry = F.concat(F.lit("《"), F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)), F.lit("》《"), F.col("role"), F.lit("》"))
    return B.reading_summary(_chat(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("n"), entry.alias("entry")), "n", "entry")


_VAULT = """e AS (SELECT DISTINCT o_custkey % 300 AS path, CASE WHEN o_orderkey % 3 = 0 THEN '新建:' ELSE '' END || o_orderpriority AS topic, 'n' || (o_orderkey % 50)::VARCHAR AS target FROM orders),
 r AS (SELECT DISTINCT path, target FROM e WHERE path % 4 = 0 EXCEPT SELECT path, target FROM e WHERE path % 8 = 0 AND length(target) = 2)"""


def _vault(spark, d):
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    e = o.select((F.col("o_custkey") % 300).cast("string").alias("path"), F.concat(F.when(k % 3 == 0, "新建:").otherwise(""), "o_orderpriority").alias("topic"), F.concat(F.lit("n"), (k % 50).cast("string")).alias("target")).distinct()
    before = e.where("cast(path as int) % 4 = 0").select("path", "target").distinct()
    now = before.where((F.col("path").cast("int") % 8 == 0) & (F.length("target") == 2))
    found = e.select("path", "topic", F.array("topic").alias("tags"), F.array(F.struct("target", F.col("target").alias("text"))).alias("links"))
    files = found.select("path").distinct().withColumn("existing", F.lit(None).cast("array<string>"))
    return B.compiled_vault(files, found, before, now)


@query(f"WITH {_VAULT} SELECT replace(topic, '新建:', '') AS topic, count(*) AS notes, count(DISTINCT path) AS sources FROM e GROUP BY 1")
def ag23_topic_groups(spark, d):
    return _vault(spark, d).topics


@query(f"WITH {_VAULT} SELECT target, count(DISTINCT path) AS sources FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.path = e.path AND r.target = e.target) GROUP BY 1")
def rt21_backlinks(spark, d):
    return _vault(spark, d).backlinks
