"""Rules over a few literal rows, Chinese texts among them, that the shared tables do not hold, and the rows that each
gives by its definition. The registered queries of these rules run over whole tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.functions import intents as I
from lectern.functions import marks as K
from lectern.functions import similarity as S
from lectern.functions import text as X
from lectern.operators import changes as C
from lectern.operators import evaluation as E
from lectern.operators import fusion as U
from lectern.operators import links as W
from lectern.operators import notes as O
from lectern.operators import quality as Q
from lectern.operators import reading as R
from lectern.operators import sessions as M
from lectern.operators import structure as N
from lectern.operators import trees as G
from lectern.plans import library as B


RULES: list[tuple] = []


def fixture(name: str, schema: str, rows: list[tuple], f, columns: str, expected: list[tuple]) -> None:
    """A rule over a few rows and the rows that it gives by its definition. Integers come out as long."""
    RULES.append((name, schema, rows, f, [c.strip() for c in columns.split(",")], expected))


def texts(name: str, column, pairs: list[tuple]) -> None:
    """A column function over single texts: (input, result) pairs, numbered from 0."""
    fixture(name, "id long, s string", [(i, s) for i, (s, _) in enumerate(pairs)], lambda d: d.select("id", column(F.col("s")).alias("v")), "id, v", [(i, v) for i, (_, v) in enumerate(pairs)])


def joined(c, by: str = "|"):
    return F.array_join(c, by)


# Tokens and plain text -----------------------------------------------------------------------------------------

texts("tx1_lexical_tokens", lambda c: joined(F.array_sort(X.lexical_tokens(c))), [("机器学习", "习|器|器学|学|学习|机|机器|机器学习"), ("Hello World", "hello|world"), ("hello你好", "hello|你|你好|你好|好"), ("", ""), ("hello hello hello", "hello|hello|hello"), ("书", "书")])
texts("tx2_vault_tokens", lambda c: joined(F.array_sort(X.vault_tokens(c))), [("hello你好", "hello你好|你好"), ("a a b", "a|b"), ("深度学习", "学习|度学|深度|深度学习")])
texts("tx3_stop_words", lambda c: joined(F.array_sort(X.query_tokens(c))), [("的", ""), ("自己", "己|自"), ("投资", "投|投资|资")])
texts("fp9_query_tokens", lambda c: joined(F.array_sort(X.query_tokens(c))), [("money money of 的", "money|of"), ("我", "")])
texts("fp17_language", X.language, [("深度 learning", "zh"), ("learning", "en"), ("", "en")])
texts("fp16_title_predicates", lambda c: F.concat_ws(",", X.is_truncated(c).cast("string"), X.too_long_title(c).cast("string")), [("An end...", "true,false"), ("终章…", "true,false"), ("x" * 101, "false,true"), ("长" * 51, "false,true"), ("长" * 50, "false,false"), ("x" * 100, "false,false")])
texts("tx9_clean_title", X.clean_title, [("# A &amp; B", "A & B"), ("* **Bold  title**", "Bold title"), ("-  x", "x")])
texts("tx10_simple_title", X.simple_title, [("深度学习：入门", "深度学习"), ("Money: a story", "Money"), ("plain", "plain"), ("A—B", "A")])
texts("tx13_chunk_kind", X.chunk_kind, [("# t", "heading"), ("> q", "quote"), ("- l", "list"), ("* l", "list"), ("+ l", "list"), ("text", "body"), ("  > q", "quote")])
texts("tx15_strip_controls", X.strip_controls, [("a\x01b\x0bc", "abc"), ("\x02", " "), ("", " "), ("a\tb", "a\tb")])
texts("tx16_bge_cut", lambda c: F.length(X.truncated_for(c, F.lit("BAAI/bge-m3"))).cast("string"), [("字" * 500, "400"), ("short", "5")])
texts("tx16_other_cut", lambda c: F.length(X.truncated_for(c, F.lit("qwen"))).cast("string"), [("字" * 9000, "8000"), ("short", "5")])
texts("tx18_first_sentence", lambda c: F.concat_ws("|", F.coalesce(X.first_sentence(c)["sentence"], F.lit("-")), X.first_sentence(c)["rest"]), [("第一句。第二句！", "第一句。|第二句！"), ("no end", "-|no end"), ("Ok? yes", "Ok?| yes"), ("a\nb!", "a\nb!|")])
texts("tx19_spoken_links", X.spoken_links, [("see [[a/b/笔记]] now", "see 笔记 now"), ("[[a/b|别名]]", "别名"), ("[[x]] and [[y| z ]]", "x and z"), ("none", "none")])
texts("tx24_topic", X.topic_of, [("什么是复利？", "复利"), ("请问如何理解风险。", "如何理解风险"), ("价值投资", "价值投资"), ("讲讲, a, b!", "a b")])
texts("tx27_book_prefix", lambda c: W.with_book_prefix(W.without_empty_blocks(c), F.lit("财富书")), [("[[0001-起点]]", "[[财富书/0001-起点]]"), ("[[财富书/a]]", "[[财富书/a]]"), ("[[财富书/a#^|名]]", "[[财富书/a|名]]"), ("[[x#^]]", "[[财富书/x]]")])
texts("tx38_dotted_leaders", K.dotted_leaders, [("Intro......12", "Intro: 12"), ("plain. text", "plain. text")])
texts("tx39_page_marks", lambda c: F.concat_ws(",", K.page_marks(c)["first"].cast("string"), K.page_marks(c)["last"].cast("string")), [("<start_index_3> a <start_index_7>", "3,7"), ("<start_index_2>", "2,2"), ("none", "")])
texts("tx40_physical_index", lambda c: K.physical_index(c).cast("string"), [("<physical_index_12>", "12"), ("7", "7"), ("x", None)])
texts("tx37_title_kind", K.title_kind, [("第一部 起源", "part"), ("第三章 复利", "chapter"), ("第2节", "section"), ("1.2 Setup", "section"), ("前言", "special"), ("Chapter 4", "chapter"), ("Part one", "part"), ("复利", "plain")])
texts("tx44_file_key", lambda c: F.concat_ws("|", W.file_key(c), W.file_alias(c)), [("0012-复利.md", "12-复利|复利"), ("3 – 风险", "3 – 风险|风险"), ("plain.md", "plain|plain")])
texts("ma14_djb2", lambda c: S.djb2(c).cast("string"), [("", "5381"), ("a", str(5381 * 33 + 97)), ("ab", str(((5381 * 33 + 97) * 33 + 98) & 0x7FFFFFFF))])
texts("ma13_short_ids", lambda c: X.content_id(c, 8), [("", "e3b0c442"), ("abc", "ba7816bf")])
texts("js1_json_in_text", X.json_in_text, [('<think>{"x": 1}</think>```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": [1, 2,]} done', '{"a": [1, 2]}'), ("none here", None), ('{"a": None, "b": True}', '{"a": null, "b": true}')])
texts("js5_first_array", lambda c: K.column(K.first_array, "string")(c), [('x [1, [2, "]"]] y', '[1, [2, "]"]]'), ("no", None), ("[1", None)])
texts("tx12_split_blocks", lambda c: joined(F.transform(K.split_blocks(c), lambda x: F.concat(x["block"], F.lit("="), x["text"]))), [("第一段 ^p001\n\n第二段 ^p002\n", "p001=第一段|p002=第二段"), ("none", "")])
texts("tx41_facts", lambda c: joined(F.transform(K.labelled_facts(c), lambda x: F.concat(x["dimension"], F.lit("="), x["fact"]))), [("[兴趣] 投资；阅读", "兴趣=投资|兴趣=阅读"), ("[a] x\n[b] y;z", "a=x|b=y|b=z"), ("no label", "")])
texts("tx17_reading_text", X.strip_markdown, [("## 标题\n**粗** [[a|别名]] ^p001", "标题\n粗 别名"), ("`code` and [t](u)", "code and t")])
texts("tx29_moved_links", lambda c: K.moved_links(c, "旧", "新"), [("[[旧]] [[旧#a]] [[旧|x]] [[旧的]]", "[[新]] [[新#a]] [[新|x]] [[旧的]]")])
texts("tx30_balanced_links", lambda c: K.column(K.balanced_links, "boolean")(c).cast("string"), [("[[a]] [[b]]", "true"), ("[[a [[b]]", "false"), ("a]]", "false"), ("", "true")])
texts("tx28_insert_links", lambda c: K.column(lambda t: K.insert_links(t, ["复利", "Money"]), "string")(c), [("谈 Money 与复利，再谈复利", "谈 [[Money]] 与[[复利]]，再谈复利"), ("[[复利]] Moneybag", "[[复利]] Moneybag")])
texts("tx32_block_context", lambda c: K.column(lambda t: K.block_context(t, "p2", 4), "string")(c), [("aaaa\nbb ^p2\ncccc\ndddd", "aaaa\nbb ^p2\ncccc"), ("none", None)])
texts("wn13_reading_segments", lambda c: K.column(lambda t: "|".join(K.reading_segments(t, 6)), "string")(c), [("短句。\n\n一二三。四五六。", "短句。|一二三。|四五六。"), ("", "")])
texts("wn10_split_long", lambda c: K.column(lambda t: "|".join(N.split_long(t, 10)), "string")(c), [("一二三四五六七。八九十一二", "一二三四五六七。|八九十一二"), ("一二三四五六，七八九十一", "一二三四五六，|七八九十一"), ("一。二三四五六七八九十一二", "一。二三四五六七八九|十一二"), ("短", "短")])
texts("fp20_existence_bigrams", lambda c: joined(S.bigrams(c)), [("价值投资", "价值|值投|投资"), ("a b", "ab"), ("x", "")])
texts("tk14_pre_search_depth", lambda c: F.when(F.length(c) < 8, "5").when(F.length(c) > 30, "15").otherwise("10"), [("短问题", "5"), ("这是一个长度适中的问题", "10"), ("长" * 31, "15")])
texts("dt1_reading_time", lambda c: X.duration_text(c.cast("long")), [("66600", "18小时30分钟"), ("59", "0分钟"), ("3600", "1小时0分钟"), ("600", "10分钟")])
texts("js7_front_matter", lambda c: K.column(lambda t: "|".join(f"{k}={v}" for k, v in K.front_matter(t).items()), "string")(c), [("---\ntitle: 书\ntags: [a, b]\n---\nx", "title=书|tags=a,b"), ("---\ntags:\n  - a\n  - b\n---", "tags=a,b"), ("none", "")])
texts("tx26_cited_chapters", lambda c: joined(X.chapter_ids(c)), [("见 [[财富书/24 - 复利]] 与 [[3–风险]]", "0024|0003"), ("> — 7 - 标题", "0007"), ("如 — 12 - 所说 > — 9", "0009|0012"), ("[[0 - x]] [[10000 - y]] [[0042 - z]]", "0042"), ("none", "")])

# Matching ------------------------------------------------------------------------------------------------------

fixture(
    "tx22_fuzzy_matches", "id long, t string, p string", [(0, "投资 投资", "投资"), (1, "这是**重点**内容", "是重点内"), (2, "价值，投资！", "价值投资"), (3, "ＡＢＣ１２", "abc12"), (4, "a+b=c", "abc"), (5, "none", "x"), (6, "aaaaaaa", "a")],
    lambda d: d.select("id", joined(F.transform(K.match_column(F.col("t"), F.col("p")), lambda x: F.concat_ws("-", x["begin"], x["end"]))).alias("v")), "id, v",
    [(0, "0-2|3-5"), (1, "1-9"), (2, "0-5"), (3, "0-5"), (4, "0-5"), (5, ""), (6, "0-1|1-2|2-3|3-4|4-5")],
)
fixture(
    "tx7_title_and_author", "id long, t string, a string", [(0, "深度学习（中文版）", "[美] Ian Goodfellow"), (1, "The Book: A, B!", "【英】 J. K. Rowling (ed.)"), (2, "[1] x", "张三，李四")],
    lambda d: d.select("id", X.normal_title(F.col("t")).alias("t"), X.normal_author(F.col("a")).alias("a")), "id, t, a", [(0, "深度学习", "iangoodfellow"), (1, "thebookab", "jkrowling"), (2, "1x", "张三李四")],
)


def _matched(d):
    remote = d.where("side = 'r'").select(F.col("id").alias("r"), "title", "author")
    return C.fuzzy_first_match(remote, d.where("side = 'i'").select(F.col("id").alias("i"), "title", "author"), "r", "i", "title", "author")


fixture(
    "jn17_shelf_match", "side string, id long, title string, author string",
    [("r", 1, "深度学习（中文版）", "[美] Ian Goodfellow"), ("r", 2, "书", ""), ("r", 3, "The Psychology of Money", "Other"), ("r", 4, "", "x"), ("r", 5, "乌合之众：大众心理", ""),
     ("i", 11, "深度学习", "Ian Goodfellow"), ("i", 12, "书", "张三"), ("i", 13, "psychology of money", "Morgan Housel"), ("i", 14, "乌合之众", "勒庞"), ("i", 15, "深度学习", "")],
    _matched, "r, i", [(1, 11), (2, 12), (5, 14)],
)


def _repaired(d):
    return W.repaired_blocks(d.where("side = 'w'").withColumnRenamed("o", "k"), d.where("side = 'k'"), "a", "k", "b", "o")


fixture(
    "jn27_block_repair", "side string, a long, o long, b string",
    [("w", 1, 1, "p010"), ("w", 1, 2, "p0105"), ("w", 1, 3, "p017"), ("w", 1, 4, "zzz"), ("w", 2, 5, "p1"), ("k", 1, 1, "p020"), ("k", 1, 2, "p010"), ("k", 1, 3, "p014"), ("k", 1, 4, "x-y")],
    _repaired, "k, b", [(1, "p010"), (2, "p010"), (3, "p020")],
)
fixture(
    "tx45_parsed_links", "k long, t string", [(1, "见 [[财富书/0001-起点#^p003|起点]] 和 [[0002]]"), (2, "[[别书/x.md#标题]] [[财富书/y#p9]] [[财富书/]]")],
    lambda d: (p := W.parsed_links(d, "k", "t")).select("k", "place", "book", "file", "heading", "block", "alias", joined(W.link_issues(F.lit("财富书")), ",").alias("issues")),
    "k, place, book, file, heading, block, alias, issues",
    [(1, 0, "财富书", "0001-起点", None, "p003", "起点", ""), (1, 1, "", "0002", None, None, "0002", "wrong_book"), (2, 0, "别书", "x", "标题", None, "x.md#标题", "wrong_book"), (2, 1, "财富书", "y", "p9", None, "y#p9", ""), (2, 2, "财富书", "", None, None, "", "malformed_format")],
)


def _checked(d):
    return W.without_fabricated(d.where("side = 'a'").select("k", "t"), d.where("side = 'i'").select("k", "t"), "k", "t")


fixture(
    "jn29_fabricated_links", "side string, k long, t string",
    [("a", 1, "真 [[书/0001-起点#^p1|甲]] 假 [[书/b|乙]] [[c]] 序号 [[02 - 复利]] 尾 [[深入/起点]]"), ("i", 1, "[[书/0001-起点]] file_name: \"复利\""), ("a", 2, "无来源 [[x]]"), ("i", 2, "没有链接"), ("a", 3, "[[第一章]] [[第二章|别名]]"), ("i", 3, "目录 '第一章'(12)")],
    _checked, "k, t", [(1, "真 [[书/0001-起点#^p1|甲]] 假 乙 c 序号 [[02 - 复利]] 尾 [[深入/起点]]"), (2, "无来源 [[x]]"), (3, "[[第一章]] 别名")],
)
fixture(
    "tx46_merge_plan", "path string, existing array<string>, tags array<string>, links array<struct<target:string,text:string>>, removed array<string>",
    [("n.md", ["投资"], ["投资", "复利"], [("复利", "复利效应"), ("风险", "风险")], ["风险"]), ("m.md", [], ["a"], [], [])],
    lambda d: W.merge_plan(d, "path").select("path", joined("new_tags").alias("tags"), joined(F.transform("links", lambda x: x["replacement"])).alias("links")), "path, tags, links", [("n.md", "复利", "[[复利|复利效应]]"), ("m.md", "a", "")],
)
fixture(
    "tk8_annotations", "side string, q long, k string, score double", [("e", 1, "n1", 0.5), ("e", 1, "n2", 0.25), ("n", 1, "f.md", 0.0), ("n", 1, "g.md", 0.0), ("n", 2, "h.md", 0.0)],
    lambda d: W.with_annotations(d.where("side = 'e'").select("q", "k", "score"), d.where("side = 'n'"), "q", "k"), "q, entry, score, annotation",
    [(1, "n1", 0.5, False), (1, "n2", 0.25, False), (1, "annotation-0", 0.65, True), (1, "annotation-1", 0.65, True), (2, "annotation-0", 0.026, True)],
)

# Trees, chunks, sessions ---------------------------------------------------------------------------------------

fixture("ma7_level_weight", "id string, depth int, kids boolean", [("root", 0, True), ("ch1", 1, True), ("ch2", 1, False), ("ch1-1", 2, False), ("gone", None, None), ("deep", 3, True)], lambda d: d.select("id", S.book_level_weight(F.col("depth"), F.col("kids")).cast("double").alias("w")), "id, w", [("root", 1.0), ("ch1", 0.9), ("ch2", 0.7), ("ch1-1", 0.7), ("gone", 0.5), ("deep", 0.9)])


def _chunked(d):
    return N.chunks(d, "node", "o", "b").select("node", "chunk_seq", "chunk_id", "blocks", F.length("text").alias("size"))


fixture(
    "wn9_chunk_fold", "node string, o long, b string, text string",
    [("n1", 0, "p000", "A" * 150), ("n1", 1, "p001", "B" * 150), ("n1", 2, "p002", "C" * 20), ("n2", 0, "p000", "A" * 400), ("n3", 0, "p000", "短"), ("n4", 0, "p000", "甲" * 10), ("n4", 1, "p001", "A" * 500 + "。" + "B" * 400), ("n4", 2, "p002", "乙")]
    + [("n5", i, f"p{i:03d}", "丙" * 60) for i in range(6)],
    _chunked, "node, chunk_seq, chunk_id, blocks, size",
    [("n1", 0, "n1_p000", "p000,p001", 301), ("n1", 1, "n1_p001", "p001,p002", 171), ("n2", 0, "n2_p000", "p000", 400), ("n2", 1, "n2_p000", "p000", 400), ("n3", 0, "n3_p000", "p000", 1),
     ("n4", 0, "n4_p000", "p000", 10), ("n4", 1, "n4_p001", "p001", 501), ("n4", 2, "n4_p001_1", "p001", 400), ("n4", 3, "n4_p002", "p002", 1),
     ("n5", 0, "n5_p000", "p000,p001,p002,p003,p004", 304), ("n5", 1, "n5_p004", "p004,p005", 121)],
)
fixture(
    "wn11_page_budget", "doc long, page long, tokens long", [(1, i, 10) for i in range(3)] + [(2, i, 40) for i in range(5)] + [(3, 0, 200), (3, 1, 10)],
    lambda d: N.page_groups(d, "doc", "page", "tokens", 100), "doc, page_group, first_page, end_page", [(1, 0, 0, 3), (2, 0, 0, 2), (2, 1, 1, 3), (2, 2, 2, 4), (2, 3, 3, 5), (3, 0, 0, 0), (3, 1, 0, 1), (3, 2, 0, 2)],
)
_TALK = [(1, 0, "user", "x" * 100), (1, 1, "assistant", "y" * 100), (1, 2, "user", "z" * 100), (1, 3, "assistant", "y" * 100), (1, 4, "user", "end"), (2, 0, "user", "only"), (3, 0, "assistant", "a"), (3, 1, "user", "b")]
fixture("wn16_boundary", "s long, n long, role string, text string", _TALK, lambda d: M.consolidation_boundary(d, "s", "n", 100), "s, boundary, removed", [(1, 2, 100), (2, None, None), (3, 1, 1)])
fixture(
    "wn18_tool_messages", "s long, n long, role string, text string", [(1, i, "tool", f"{i}" * (200 if i < 2 else 3)) for i in range(5)] + [(2, i, "tool", "x") for i in range(4)],
    lambda d: M.compressed(d, "s", "n", "tool"), "s, n, role, text", [(1, 0, "tool", "[已压缩] " + "0" * 150 + "..."), (1, 1, "tool", "[已压缩] " + "1" * 150 + "..."), (1, 2, "tool", "[已压缩] 222"), (1, 3, "tool", "333"), (1, 4, "tool", "444")] + [(2, i, "tool", "x") for i in range(4)],
)
fixture("wn21_callouts", "k long, line long, text string", [(1, 0, "> [!quote]+ 🟡 高亮"), (1, 1, "> 第一行"), (1, 2, "> 第二行"), (1, 3, "正文"), (1, 4, "> [!note]"), (1, 5, "> x"), (2, 0, "> 无头")], lambda d: N.callouts(d, "k"), "k, first, kind, text", [(1, 0, "quote", "第一行 第二行"), (1, 4, "note", "x")])
fixture("wn12_size_batches", "k long, o long, size long", [(1, 0, 5), (1, 1, 6), (1, 2, 3), (1, 3, 20), (1, 4, 1)], lambda d: G.size_batches(d, "k", "o", "size", 10), "k, o, batch", [(1, 0, 0), (1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 3)])
fixture("wn22_line_groups", "k long, o long, y double", [(1, 0, 10.0), (1, 1, 12.0), (1, 2, 20.0), (1, 3, 23.0), (1, 4, 24.0)], lambda d: G.grouped_lines(d, "k", "o", "y"), "k, o, line_no", [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2)])
fixture("wn8_thinned", "k long, o long, level long, tokens long", [(1, 0, 1, 5), (1, 1, 2, 2), (1, 2, 2, 1), (1, 3, 1, 50), (1, 4, 2, 3)], lambda d: G.thinned(d, "k", "o", "level", "tokens", 10), "k, o, into", [(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 3), (1, 4, 4)])
fixture("wn26_inside_part", "k long, o long, kind string", [(1, 0, "special"), (1, 1, "part"), (1, 2, "chapter"), (1, 3, "special"), (1, 4, "chapter")], lambda d: G.inside_part(d, "k", "o", "kind"), "k, o, kind, inside", [(1, 0, "special", False), (1, 1, "part", True), (1, 2, "chapter", True), (1, 3, "special", False), (1, 4, "chapter", False)])
fixture("wn5_headings_outside_fences", "k long, line long, text string", [(1, 0, "# 一"), (1, 1, "```"), (1, 2, "# code"), (1, 3, "```"), (1, 4, "## 二"), (1, 5, "####### x")], lambda d: N.headings(d, "k"), "k, line, level, title", [(1, 0, 1, "一"), (1, 4, 2, "二")])
fixture("fp24_short_reply", "s long, n long, role string, text string", [(1, 0, "user", "什么是复利？"), (1, 1, "assistant", "答" * 201), (1, 2, "user", "继续"), (2, 0, "user", "好"), (3, 0, "user", "问"), (3, 1, "assistant", "短"), (3, 2, "user", "继续")], lambda d: M.inherited_depth(d, "s", "n").select("s", "n", "continues"), "s, n, continues", [(1, 0, False), (1, 1, False), (1, 2, True), (2, 0, False), (3, 0, False), (3, 1, False), (3, 2, False)])
fixture("ar4_preface", "book long, start long, title string", [(1, 3, "一"), (1, 9, "二"), (2, 1, "a")], lambda d: O.with_preface(d, "book", "start", "title"), "book, start, title", [(1, 3, "一"), (1, 9, "二"), (2, 1, "a"), (1, 1, "Preface")])

# Quality, shelves, compilation ---------------------------------------------------------------------------------

_ANSWERS = [
    ("a", "cat1", "## 复利\n- 建议从长期看 [[书/a#^p1]] " + "字" * 500, 2, ["复利", "长期"], [], None), ("b", "cat1", "短", 0, ["复利"], [], None), ("c", "cat2", "复利 是 错的" + "字" * 30, 1, ["复利", "没有"], ["错"], None),
    ("d", "cat2", "", 0, [], [], "timeout"), ("e", "cat2", "复利 LEAK " + "字" * 200, 2, ["复利"], [], None),
]
_KIND = "id string, category string, response string, depth int, expected array<string>, forbidden array<string>, error string"


def _scored(d):
    return E.answer_scores(d, ["LEAK"], {"SAF": F.when(F.col("id") == "b", 3)})


fixture("ag35_answer_dimensions", _KIND, _ANSWERS, lambda d: _scored(d).select("id", *E.MOST, "total", "grade"), "id, ACC, REL, COM, REF, SAF, STY, total, grade", [
    ("a", 30.0, 20.0, 15.0, 15.0, 10.0, 10.0, 100.0, "良好"), ("b", 0.0, 0.0, 0.0, 15.0, 3.0, 5.0, 23.0, "严重"), ("c", 0.0, 15.0, 5.0, 15.0, 10.0, 5.0, 50.0, "不及格"), ("d", 30.0, 20.0, 0.0, 15.0, 10.0, 5.0, 80.0, "良好"), ("e", 30.0, 20.0, 5.0, 0.0, 5.0, 5.0, 65.0, "及格")])
fixture("ag36_dataset_summary", _KIND, _ANSWERS, lambda d: E.dataset_summary(_scored(d)), "cases, passed, errors, mean, ACC, REL, COM, REF, SAF, STY, failed, pass_rate", [(5, 2, 1, 60, 15.0, 13.8, 6.3, 11.3, 7.0, 6.3, 2, 40)])
fixture("ag36_categories", _KIND, _ANSWERS, lambda d: E.category_summary(_scored(d)), "category, cases, passed, mean", [("cat1", 2, 1, 62), ("cat2", 3, 1, 58)])
_METRICS = [("q1", "b1", 1.0, 1), ("q2", "b1", 0.5, 1), ("q3", "b2", 0.0, 0)]
fixture("ag34_mean_metrics", "q string, book string, mrr double, hit5 int", _METRICS, lambda d: Q.mean_metrics(d, ["mrr", "hit5"]), "queries, mrr, hit5", [(3, 0.5, 0.6667)])
fixture("ag34_mean_by_book", "q string, book string, mrr double, hit5 int", _METRICS, lambda d: Q.mean_metrics(d, ["mrr", "hit5"], "book"), "book, queries, mrr, hit5", [("b1", 2, 0.75, 1.0), ("b2", 1, 0.0, 0.0)])
fixture("jn32_golden_queries", "side string, q string, book string", [("g", "q1", "b1"), ("g", "q2", "b9"), ("g", "q3", "b1"), ("c", "", "b1")], lambda d: (p := Q.answerable(d.where("side = 'g'"), d.where("side = 'c'"), "book"))[0].agg(F.count("*").alias("kept")).crossJoin(p[1]), "kept, skipped", [(2, 1)])
_SHELF = "side string, book_id string, title string, book_type int, notes int, reviews int"
_BOOKS = [("r", "1", "旧书", 0, 5, 1), ("r", "2", "新书", 0, 3, 0), ("r", "3", "文章", 3, 9, 9), ("r", "4", "", 0, 9, 9), ("r", "5", "改动", 0, 7, 0), ("r", "6", "失败", 0, 2, 2), ("s", "1", "旧书", 0, 5, 1), ("s", "5", "改动", 0, 6, 0), ("s", "8", "离架", 0, 1, 1), ("f", "6", "超时", 0, 0, 0)]


def _synced(d, what: str, **options):
    cols = ["book_id", "title", "book_type", "notes", "reviews"]
    state = d.where("side = 's'").select(*cols, F.lit(1).cast("long").alias("last_sync_time"))
    failed = d.where("side = 'f'").select("book_id", F.col("title").alias("error"))
    return getattr(B.synced_shelf(d.where("side = 'r'").select(*cols), state, failed, F.lit(2).cast("long"), **options), what)


fixture("rt23_sync_log", _SHELF, _BOOKS, lambda d: _synced(d, "log"), "total_books, synced_books, skipped_books, added, updated, success, error_message", [(4, 2, 1, 1, 1, False, "超时")])
fixture("rt23_sync_forced", _SHELF, _BOOKS, lambda d: _synced(d, "log", force=True, least_notes=5), "total_books, synced_books, skipped_books, added, updated, success, error_message", [(2, 2, 0, 0, 2, True, None)])
fixture("rt23_sync_state", _SHELF, _BOOKS, lambda d: _synced(d, "state").select("book_id", "notes", "last_sync_time"), "book_id, notes, last_sync_time", [("1", 5, 1), ("8", 1, 1), ("2", 3, 2), ("5", 7, 2)])
fixture("fp8_shelf_filters", _SHELF, _BOOKS, lambda d: _synced(d, "to_sync", articles=True, least_notes=5).select("book_id", "is_new"), "book_id, is_new", [("3", True), ("5", False)])
fixture("jn18_mapping_stats", "side string, book_id string, notes int, reviews int, progress double, reading_time long, last_sync_time long", [("m", "1", 0, 0, 0.0, 0, 0), ("m", "2", 0, 0, 0.0, 0, 0), ("s", "1", 4, 2, None, 66600, 1700000000000)], lambda d: B.mapping_with_stats(d.where("side = 'm'").select("book_id"), d.where("side = 's'")), "book_id, note_count, review_count, progress, reading_time, last_read_date", [("1", 4, 2, 0.0, "18小时30分钟", "2023-11-14"), ("2", None, None, None, None, None)])
fixture("ag17_overall_quality", "book string, q string", [("a", "good"), ("a", "degraded"), ("b", "poor"), ("b", "degraded"), ("c", "good")], lambda d: B.overall_quality(d, "book", "q"), "book, quality, layers", [("a", "degraded", 2), ("b", "poor", 2), ("c", "good", 1)])
fixture("ag28_reading_summary", "n long, entry string", [(0, "读《甲》和《乙》"), (1, "又读《甲》《丙》"), (2, "《丁》《戊》《己》《庚》")], lambda d: B.reading_summary(d, "n", "entry"), "books, recent", [(7, "丙、丁、戊、己、庚")])
_VAULT = "side string, path string, target string, topic string"
_LINKS = [("b", "a/x.md", "风险", ""), ("b", "a/x.md", "复利", ""), ("n", "a/x.md", "复利", ""), ("e", "a/x.md", "风险", "新建:投资"), ("e", "a/x.md", "时间", "投资"), ("e", "b/2024-01-02.md", "复利", "投资"), ("e", "b/2024-01-03.md", "复利", "日记")]


def _compiled(d, what: str):
    e = d.where("side = 'e'").select("path", "topic", F.array("topic").alias("tags"), F.array(F.struct("target", F.col("target").alias("text"))).alias("links"))
    files = e.select("path").distinct().withColumn("existing", F.lit(None).cast("array<string>"))
    links = lambda s: d.where(F.col("side") == s).select("path", "target")
    return getattr(B.compiled_vault(files, e, links("b"), links("n")), what)


fixture("ag23_topic_groups", _VAULT, _LINKS, lambda d: _compiled(d, "topics"), "topic, notes, sources", [("投资", 3, 2), ("日记", 1, 1)])
fixture("rt21_backlinks", _VAULT, _LINKS, lambda d: _compiled(d, "backlinks"), "target, sources", [("时间", 1), ("复利", 2)])
fixture("rt21_merge_plans", _VAULT, _LINKS, lambda d: _compiled(d, "plans").select("path", joined("new_tags").alias("tags"), joined(F.transform("links", lambda x: x["replacement"])).alias("links")), "path, tags, links", [("a/x.md", "新建:投资", ""), ("a/x.md", "投资", "[[时间|时间]]"), ("b/2024-01-02.md", "投资", "[[复利|复利]]"), ("b/2024-01-03.md", "日记", "[[复利|复利]]")])
fixture("sc12_directory_kinds", _VAULT, _LINKS, lambda d: _compiled(d, "directories"), "directory, files, kind, needs_reorg", [("a", 1, "mixed", False), ("b", 2, "timeline", False)])
fixture("tk11_shelf_order", "id long, status string, title string", [(1, "ready", "b"), (2, "processing", "z"), (3, "ready", "a"), (4, "error", "c")], lambda d: B.shelf_order(d, "status", [F.col("title")]).select("id", "place"), "id, place", [(2, 0), (3, 1), (1, 2), (4, 3)])
fixture("st6_distinct_paths", "path string, mtime long", [("a/x.md", 5), ("b/y.md", 9), ("a/x.md", 5)], lambda d: d.groupBy("path").agg(F.max("mtime").alias("mtime")), "path, mtime", [("a/x.md", 5), ("b/y.md", 9)])
fixture("jn12_first_of", "id string, o long, v string", [("p1", 0, "a"), ("p1", 1, "b"), ("p2", 2, "c")], lambda d: C.first_of(d, "id", [F.col("o")]), "id, o, v", [("p1", 0, "a"), ("p2", 2, "c")])

texts("tx11_note_name", X.file_name, [("# A &amp; B: C?", "A & B C"), ("字" * 120, "字" * 100)])
texts("tx11_dashed_name", X.dashed_name, [("a/b: c", "a-b--c"), ("x  y", "x-y")])
texts("tx11_bounded_name", X.bounded_name, [("a/b:  c", "ab c"), ("", "untitled"), ("字" * 100, "字" * 80), ("x" + "字" * 100, "x" + "字" * 79), ("?", "untitled")])
texts("tx36_mended_bold", X.mended_bold, [("**我**们**要**学**习**", "**我们要学习**"), ("**重点内容** 其他 **a** **b** **c**", "**重点内容** 其他 **a** **b** **c**"), ("# **a** **b** **c**", "# **a** **b** **c**"), ("一行\n**我**和**你**和**他**", "一行\n**我和你和他**")])
texts("tx35_implicit_heading", X.implicit_heading, [("<p>◆ 模仿的心态</p>", "模仿的心态"), ("<p><b>加粗标题</b></p>", "加粗标题"), ('<p><span class="bold-x">标题</span></p>', "标题"), ('<p><a id="c1"></a>第一节</p>', "第一节"), ("<p>普通段落</p>", None), ("<p><b>半</b>段落</p>", None), ("<div><b>x</b></div>", None), ("<p><b>" + "长" * 61 + "</b></p>", None)])
texts("tx35_contents_entries", lambda c: X.implicit_heading(c, diamonds=False), [("<p>◆ 目录条目</p>", None), ("<p><strong>题</strong></p>", "题")])
texts("tx42_heading_lines", lambda c: F.concat_ws(",", X.looks_like_heading(c, F.lit("x")).cast("string"), X.looks_like_item(c).cast("string")), [("Chapter One", "true,false"), ("第三章 复利", "true,false"), ("THE END 2", "true,false"), ("a plain sentence here", "false,false"), ("1. 第一", "true,true"), ("- item", "false,true"), ("(a) item", "false,true"), ("Ends with stop.", "false,false")])
texts("js2_clean_json", X.clean_json, [("{'a': None, 'b': [True, False,],}", '{"a": null, "b": [true, false]}'), ("[1, 2, ]", "[1, 2]")])
texts("js3_broken_fields", lambda c: (lambda m: F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.lit("="), m[k])), "|"))(X.broken_json_fields(c)), [('{"thinking": "He said", "Answer": "Yes", "physicalIndex": 12, "title": "标题"', "answer=yes|physical_index=12|thinking=he said|title=标题"), ("{'toc_detected': 'no'", "toc_detected=no"), ("none", None)])
texts("fp23_diagram_intent", lambda c: I.wants_diagram(c).cast("string"), [("画一张流程图", "true"), ("画个关系图吧", "true"), ("帮我做思维导图", "true"), ("什么是复利", "false"), ("make an infographic", "true")])
texts("fp20_asked_concept", I.asked_concept, [("书里有没有提到复利效应？", "复利效应"), ("是否讨论了风险", "风险")])
fixture("fp21_existence_match", "id long, concept string, score double, content string", [(0, "复利的效应", 0.6, "关于效应的讨论"), (1, "复利", 0.4, "复利"), (2, "书", 0.9, "一本书"), (3, "风险", 0.9, "没有相关")], lambda d: d.select("id", I.strong_match(F.col("concept"), F.col("score"), F.col("content")).alias("found")), "id, found", [(0, True), (1, False), (2, True), (3, False)])
fixture("fp18_correction_rules", "id long, s string", [(0, "你说得不对"), (1, "不，再看看"), (2, "再搜索一下"), (3, "明明就有"), (4, "不对"), (5, "什么是复利"), (6, "引错章节了")], lambda d: d.select("id", I.is_correction(F.col("s")).alias("yes"), I.correction_reason(F.col("s")).alias("reason")), "id, yes, reason", [(0, True, "否定词"), (1, True, "开头否定"), (2, True, "重新检索"), (3, True, "坚持存在"), (4, False, "否定词"), (5, False, None), (6, True, "引用质疑")])
fixture("fp19_negative_claims", "id long, a string, q string", [(0, "书中未提及此概念", "复利"), (1, "书里没有提到", ""), (2, "书里讲了", "复利")], lambda d: d.select("id", I.claims_absence(F.col("a"), F.col("q")).alias("yes")), "id, yes", [(0, True), (1, False), (2, False)])
fixture("fp22_syntopical_words", "id long, q string", [(0, "对比两本书"), (1, "复利是什么"), (2, "它们的异同")], lambda d: d.select("id", I.compares_books(F.col("q")).alias("yes")), "id, yes", [(0, True), (1, False), (2, True)])
fixture("fp30_small_talk", "id long, q string, c boolean, k boolean", [(0, "你好！", False, False), (1, "继续", True, False), (2, "继续", False, False), (3, "不对", False, True), (4, "什么是复利效应", False, False)], lambda d: d.select("id", I.is_small_talk(F.col("q"), F.col("c"), F.col("k")).alias("yes")), "id, yes", [(0, True), (1, False), (2, True), (3, False), (4, False)])
fixture(
    "fp26_routed_intents", "k long, s string", [(1, "搜索复利"), (1, "对比一下"), (2, "你好"), (3, "搜索并对比")],
    lambda d: (r := O.routed_intents(d, [("搜索", "search", ["search_book"], 3), ("对比", "compare", ["search_book", "read_section"], 8)], "k", "s", ("chat", ["none"], 1))).select("k", joined("intents").alias("intents"), joined("tools").alias("tools"), "iterations"),
    "k, intents, tools, iterations", [(1, "search|compare", "search_book|read_section", 8), (2, "chat", "none", 1), (3, "search|compare", "search_book|read_section", 8)],
)
fixture("jn38_index_changes", "side string, id string, status string, progress long, message string", [("n", "a", "ready", 100, ""), ("n", "b", "processing", 54, "x"), ("n", "c", "Ready", 100, None), ("n", "d", "processing", 55, "x"), ("b", "b", "processing", 50, "x"), ("b", "c", "indexing", 98, ""), ("b", "d", "processing", 50, "x")], lambda d: O.index_changes(d.where("side = 'n'"), d.where("side = 'b'"), "id"), "id, new, changed, completed", [("a", True, False, False), ("b", False, False, False), ("c", False, True, True), ("d", False, True, False)])
fixture("st13_index_lists", "side string, id string, o long, status string", [("f", "a", 0, "ready"), ("f", "b", 1, "ready"), ("c", "b", 0, "processing"), ("c", "temp_1", 1, "new"), ("c", "z", 2, "indexing"), ("c", "gone", 3, "ready")], lambda d: O.merged_index_lists(d.where("side = 'f'"), d.where("side = 'c'"), "id", "o", "b").select("id", "side", "status"), "id, side, status", [("a", "f", "ready"), ("b", "c", "processing"), ("temp_1", "c", "new"), ("z", "c", "indexing")])
fixture("st11_toggled_archive", "side string, id string, archived boolean", [("c", "a", True), ("c", "b", None), ("c", "c", True), ("w", "a", None), ("w", "b", None), ("w", "z", None)], lambda d: O.toggled_archive(d.where("side = 'c'"), d.where("side = 'w'"), "id"), "id, archived, toggled", [("a", False, True), ("b", True, True), ("c", True, False), ("z", True, True)])
fixture("jn11_enriched_tree", "side string, id string, title string, start long, \"end\" long, summary string, text string".replace('"', "`"), [("t", "0001", "一", 1, 2, "旧", None), ("t", "0002", "二", 3, 4, "有", "x"), ("n", "0001", "", 5, None, "新", "正文"), ("n", "0002", "", None, None, "", None)], lambda d: O.enriched_tree(d.where("side = 't'").drop("side"), d.where("side = 'n'"), "id"), "id, title, start, end, summary, text", [("0001", "一", 5, 2, "新", "正文"), ("0002", "二", 3, 4, "有", "x")])
_RAW = [("b", '[{"chapterUid": 1, "title": "第一章"}]', '[{"bookmarkId": "m1", "markText": "甲", "chapterUid": 1, "chapterName": "旧名"}, {"bookmarkId": "m2", "markText": "乙", "chapterUid": 2, "chapterName": "二"}, {"bookmarkId": "m3", "markText": "丙", "chapterUid": 3}]', '[{"reviewId": "r1", "review": {"content": "好", "type": 4}}, {"reviewId": "r2", "review": {"reviewId": "x2", "content": "c", "htmlContent": "<p>富</p>", "chapterUid": 1, "chapterName": "一"}}, {"reviewId": "r3"}]')]
fixture("jn37_highlights", "book string, chapters string, highlights string, reviews string", _RAW, lambda d: O.normalised_notebook(d, "book")[0].select("bookmark_id", "chapter_uid", "chapter_title"), "bookmark_id, chapter_uid, chapter_title", [("m1", 1, "第一章"), ("m2", 2, "二"), ("m3", 3, "")])
fixture("jn37_reviews", "book string, chapters string, highlights string, reviews string", _RAW, lambda d: O.normalised_notebook(d, "book")[1].drop("book"), "review_id, content, md_content, chapter_uid, chapter_title, create_time, type", [("r1", "好", "好", 0, "", 0, 4), ("x2", "c", "富", 1, "一", 0, 1), ("r3", "", "", 0, "", 0, 1)])
fixture("wn27_rolled_up", "b long, line long, level long, n long", [(1, 0, 1, 10), (1, 5, 2, 20), (1, 7, 3, 5), (1, 9, 2, 1), (1, 12, 1, 2)], lambda d: N.rolled_up(d, "b", "n").select("line", "parent", "end", "total"), "line, parent, end, total", [(0, None, 9, 31), (5, 0, 7, 25), (7, 5, 7, 5), (9, 0, 9, 1), (12, None, 12, 2)])
fixture("wn25_merged_fragments", "k long, line long, text string", [(1, 0, "这句话没有 ^p1"), (1, 1, "说完。 ^p2"), (1, 2, "# 标题 ^p3"), (1, 3, "完整。 ^p4"), (1, 4, "末尾没有 ^p5"), (1, 5, "![图](x) ^p6")], lambda d: N.merged_fragments(d, "k"), "k, line, text, block, parts", [(1, 0, "这句话没有说完。", "p2", 2), (1, 2, "# 标题", "p3", 1), (1, 3, "完整。", "p4", 1), (1, 4, "末尾没有", "p5", 1), (1, 5, "![图](x)", "p6", 1)])
fixture("rt26_consolidated", "s long, n long, role string, text string", [(1, i, "user" if i % 2 == 0 else "assistant", "x" * 100) for i in range(20)] + [(2, 0, "user", "x" * 50)], lambda d: M.consolidated(d, "s", "n", 400, 0.5), "s, since", [(1, 16), (2, 0)])
_NOTE = "---\ntitle: x\n---\n正文 [[链接]] %%注%% ^p1\n> [!note] 标\n> 内容\n尾\n---\n末\n"
texts("tx14_indexed_text", X.indexed_text, [(_NOTE, "正文 [[链接]] %%注%% ^p1\n尾\n---\n末"), ("plain", "plain")])
texts("tx14_card_source", X.card_source, [(_NOTE, "正文   \n尾\n---\n末"), ("a ^b1", "a")])
texts("tx14_reading_source", X.reading_source, [(_NOTE, "正文  %%注%% ^p1\n尾\n\n末")])
fixture("tx5_message_tokens", "id long, c string, j string", [(0, "你好吗", None), (1, None, '[{"name":"x"}]'), (2, "ab", '["c"]'), (3, "", None)], lambda d: d.select("id", X.message_tokens(F.col("c"), F.col("j")).alias("n")), "id, n", [(0, 2), (1, 7), (2, 4), (3, 0)])
fixture(
    "wn25_chapter_levels", "b long, o long, title string, n long", [(1, 0, "封面", 5), (1, 1, "前言", 900), (1, 2, "第一部 起源", 10), (1, 3, "第一章 甲", 900), (1, 4, "第2节", 100), (1, 5, "附录", 90), (1, 6, "杂谈", 900), (1, 7, "后记", 90), (1, 8, "第二章 乙", 900), (1, 9, "短", 9)],
    lambda d: G.chapter_levels(d, "b", "o", "title", "n").select("o", "level"), "o, level", [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (5, 2), (6, 1), (7, 0), (8, 0), (9, 0)],
)
fixture(
    "rt13_search_phase", "id long, r long, top double, most double, c double, b string, n long, f boolean", [(0, 1, 9.0, 10.0, 1.0, "p1", 300, False), (1, 5, 8.0, 10.0, 0.9, "p1", 60, False), (2, 5, 8.0, 10.0, 0.9, "p1", 60, True), (3, 5, 3.0, 10.0, 0.1, None, 0, False), (4, 5, 1.0, 10.0, 1.0, "p", 300, False), (5, 5, 8.0, 10.0, 0.9, "p1", 10, False)],
    lambda d: d.select("id", U.search_phase(*[F.col(x) for x in ("r", "top", "most", "c", "b", "n", "f")]).alias("phase")), "id, phase", [(0, "none"), (1, "stop"), (2, "hybrid"), (3, "hybrid"), (4, "keep"), (5, "hybrid")],
)
fixture("st8_searched_blocks", "id long, a array<string>, b array<string>", [(0, ["p1", "p2"], ["p2", "p3"]), (1, [], ["p9"]), (2, ["p1"], [])], lambda d: d.select("id", joined(F.array_union("a", "b"), ",").alias("blocks")), "id, blocks", [(0, "p1,p2,p3"), (1, "p9"), (2, "p1")])


@pytest.mark.parametrize("name, schema, rows, f, columns, expected", RULES, ids=[r[0] for r in RULES])
def test_rule(spark, name, schema, rows, f, columns, expected):
    out = f(spark.createDataFrame(rows, schema))
    assert sorted(out.columns) == sorted(columns)
    plain = lambda v: round(float(v), 5) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in out.collect()), key=str)
    assert [tuple(float(v) if isinstance(w, float) else v for v, w in zip(g, e)) for g, e in zip(got, sorted(map(tuple, expected), key=str))] == sorted((tuple(map(plain, e)) for e in expected), key=str) and len(got) == len(expected)
