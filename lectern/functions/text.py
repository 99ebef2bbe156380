"""Text functions: tokenisers, token estimates, normalisers, extractors. All are JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "㐀-䶿一-鿿豈-﫿"
WIDE = CJK + "　-〿＀-￯"
# Words that carry no query meaning.
STOP_WORDS = [
    "的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一",
    "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有",
    "看", "好", "自己", "这", "他", "她", "它", "们", "那", "些", "个", "么",
    "什么", "如何", "怎么", "为", "与", "及", "等", "被", "从", "把", "让",
]


def _nonempty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def _ngrams(run: Column, n: int) -> Column:
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def padded(number: Column, width: int) -> Column:
    """A number with leading zeros up to ``width`` digits; more digits stay."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), "0")


def cjk_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0))


def plain_words(text: Column) -> Column:
    """Lower-cased ASCII words; every other character separates."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9_]+"), "")


def lexical_tokens(text: Column) -> Column:
    """Index tokens, repeats kept: of a CJK run the run itself (two characters and more), its characters and its
    bigrams; of the rest the plain words."""
    text = F.coalesce(text, F.lit(""))
    of_run = lambda r: F.concat(F.when(F.length(r) >= 2, F.array(r)).otherwise(F.array().cast("array<string>")), _ngrams(r, 1), _ngrams(r, 2))
    mixed = F.concat(F.flatten(F.transform(cjk_runs(text), of_run)), plain_words(text))
    return F.when(text.rlike(f"[{CJK}]"), mixed).otherwise(plain_words(text))


def vault_tokens(text: Column) -> Column:
    """Distinct keyword tokens: words with CJK runs and the runs' bigrams, no single characters."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.lower(text), f"[^a-z0-9_{CJK}]+"), "")
    mixed = F.concat(words, F.flatten(F.transform(cjk_runs(text), lambda r: _ngrams(r, 2))))
    return F.array_distinct(F.when(text.rlike(f"[{CJK}]"), mixed).otherwise(plain_words(text)))


def query_tokens(text: Column) -> Column:
    """Distinct lexical tokens without stop words."""
    return F.array_except(F.array_distinct(lexical_tokens(text)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def token_estimate(text: Column) -> Column:
    """One token a CJK or full-width character, a quarter for any other, rounded up."""
    wide = F.length(text) - F.length(F.regexp_replace(text, f"[{WIDE}]", ""))
    return F.ceil(wide + 0.25 * (F.length(text) - wide)).cast("long")


def chat_token_estimate(total_chars: Column) -> Column:
    return F.round(total_chars / 2).cast("long")


def bare(text: Column) -> Column:
    """For comparison: lower case, without white space and punctuation."""
    return F.regexp_replace(F.lower(text), r"[\s\p{P}]+", "")


# The punctuation that titles and authors are compared without.
_PUNCTUATION = r"""[，。！？：；""''【】《》、·—…\-\.,!?;:'"()\[\]{}<>/\\@#$%^&*+=~`|]"""
_ROUND = r"（[^）]*）|\([^)]*\)"
_LENTICULAR = r"【[^】]*】"


def _plain_name(text: Column, brackets: str) -> Column:
    for pattern in (brackets, _PUNCTUATION, r"\s+"):
        text = F.regexp_replace(text, pattern, "")
    return F.lower(text)


def normal_title(text: Column) -> Column:
    """A title without bracketed parts, punctuation and spaces, in lower case. Square brackets lose only their marks."""
    return _plain_name(text, f"{_ROUND}|{_LENTICULAR}")


def normal_author(text: Column) -> Column:
    """An author without countries in square brackets, bracketed parts, punctuation and spaces, in lower case."""
    return _plain_name(text, rf"\[[^\]]*\]|{_ROUND}|{_LENTICULAR}")


def truncated_for(text: Column, model: Column) -> Column:
    """What a model can embed of a text: 400 characters for the bge family, else 8,000."""
    return F.left(text, F.when(F.contains(F.lower(F.coalesce(model, F.lit(""))), F.lit("bge")), 400).otherwise(8000))


def first_sentence(text: Column) -> Column:
    """struct(sentence, rest): up to the first sentence end; null and the whole text where there is none."""
    found = F.regexp_extract(text, r"(?s)^(.*?[。！？!?])", 1)
    some = found != ""
    return F.struct(F.when(some, found).alias("sentence"), F.when(some, F.substring(text, F.length(found) + 1, F.length(text))).otherwise(text).alias("rest"))


def head_and_tail_exact(text: Column, most: int) -> Column:
    """As head_and_tail, where the mark between counts as well."""
    head = int(most * 0.6)
    tail = most - head - 5
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(" ... "), F.right(text, F.lit(tail))))


def topic_of(message: Column) -> Column:
    """What a question is about: without its opening words and punctuation."""
    bare = F.regexp_replace(message, r"(?i)^(什么是|如何理解|请问|帮我|解释一下|讲讲|详细说说)", "")
    return head_and_tail_exact(F.btrim(F.regexp_replace(bare, r"[？?。.!！，,]", "")), 150)


def spoken_links(text: Column) -> Column:
    """[[target|alias]] as the alias, [[path/target]] as the last part of the path."""
    with_alias = F.regexp_replace(text, r"\[\[[^\]|]+\|\s*([^\]|]*?)\s*(\|[^\]]*)?\]\]", "$1")
    return F.regexp_replace(with_alias, r"\[\[\s*(?:[^\]|]*/)?([^\]|/]*?)\s*\]\]", "$1")


def clean_title(text: Column) -> Column:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^[#*\-\s]+|[*\s]+$", ""), r"\s+", " "))


def simple_title(text: Column) -> Column:
    """What stands before the first kind of separator that occurs, in this order of kinds."""
    cut = [F.when(F.contains(text, F.lit(s)), F.trim(F.substring_index(text, s, 1))) for s in ("：", ":", "—", "-", "｜", "|")]
    return F.coalesce(*cut, text)


def file_name(text: Column, most: int = 100) -> Column:
    """A note's file name: the clean title without characters that paths or links read, at most ``most`` characters."""
    return F.left(F.regexp_replace(clean_title(text), r'[<>:"/\\|?*#]', ""), F.lit(most))


def dashed_name(text: Column, by: str = "-") -> Column:
    """A file name with a dash for each character that paths read and for each run of white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r'[/\\:*?"<>|]', by), r"\s+", by))


def bounded_name(text: Column, most_bytes: int = 240) -> Column:
    """A file name without control characters and those that paths read, of at most ``most_bytes`` in UTF-8, whole
    characters; untitled if nothing is left."""
    plain = F.btrim(F.regexp_replace(F.regexp_replace(text, r'[\x00-\x1f\\/:*?"<>|]', ""), r"\s+", " "))
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(plain, "UTF-8"), 1, most_bytes).cast("string")), "\ufffd+$", "")
    return F.coalesce(F.nullif(F.when(F.octet_length(plain) <= most_bytes, plain).otherwise(cut), F.lit("")), F.lit("untitled"))


def mended_bold(text: Column) -> Column:
    """Lines that a converter cut into bold pieces become bold as a whole: three and more pieces, each of at most two
    characters, over 0.15 of the line. Headings, code marks, quotes and list items stay."""
    piece = r"\*\*([^*]+?)\*\*"

    def line(x: Column) -> Column:
        inner = F.regexp_extract_all(x, F.lit(piece), F.lit(1))
        size = F.aggregate(inner, F.lit(0), lambda s, y: s + F.length(y))
        broken = (F.size(inner) >= 3) & ~F.exists(inner, lambda y: F.length(y) > 2) & (size / F.length(F.replace(x, F.lit("**"), F.lit(""))) > 0.15)
        special = x.rlike(r"^#{1,6}\s|^```|^>\s|^\s*[-*+]\s")
        return F.when(~special & broken, F.concat(F.lit("**"), F.regexp_replace(x, piece, "$1"), F.lit("**"))).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def implicit_heading(html: Column, diamonds: bool = True) -> Column:
    """The heading that an HTML paragraph stands for, or null: a text after ◆ (unless these are contents entries), one
    bold child that is the whole paragraph, up to 60 characters, or a text up to 30 with an anchor of its own."""
    inner = F.regexp_extract(html, r"(?is)^\s*<p\b[^>]*>(.*)</p>\s*$", 1)
    text = F.btrim(F.regexp_replace(inner, r"<[^>]+>", ""))
    bold = inner.rlike(r"(?is)^\s*<(b|strong)\b[^>]*>(?:(?!</?\1\b).)*</\1>\s*$") | inner.rlike(r"""(?is)^\s*<span\b[^>]*class\s*=\s*["'](?:[^"']*\s)?bold[^>]*>(?:(?!</?span\b).)*</span>\s*$""")
    mark = text.rlike(r"^◆\s+")
    return F.when(inner == "", None).when(mark, F.regexp_replace(text, r"^◆\s+", "") if diamonds else None).when(bold & F.length(text).between(1, 60), text).when(
        F.length(text).between(1, 30) & inner.rlike(r"""(?i)<a\b[^>]*\bid\s*=\s*["'][^"']+"""), text
    )


def looks_like_heading(line: Column, before: Column) -> Column:
    """Whether a line of plain text reads as a heading, by its form, or short after an empty line."""
    t = F.btrim(line, F.lit(" \t\r\n"))
    form = t.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$") | t.rlike(r"^[A-Z\s\d]{5,}$") | t.rlike(r"^(?i:Chapter|Section|Part|第[一二三四五六七八九十\d]+章|\d+\.)")
    return (F.length(t).between(4, 99) & ~t.rlike("[.，。；：]$") & form) | ((F.length(t) < 50) & (before == ""))


def looks_like_item(line: Column) -> Column:
    return line.rlike(r"^\s*[-•·\d][.)\s]") | line.rlike(r"^\s*\(\w\)")


def clean_json(text: Column) -> Column:
    """A model's JSON with Python's constants, trailing commas and single quotes put right, wherever they stand."""
    for pattern, to in (("None", "null"), ("True", "true"), ("False", "false"), (r",\s*]", "]"), (r",\s*\}", "}"), ("'", '"')):
        text = F.regexp_replace(text, pattern, to)
    return text


# The fields a broken answer is searched for.
TEXT_FIELDS = ["toc_detected", "answer", "start_begin", "completed", "page_index_given", "page_index_given_in_toc", "reasoning", "thinking", "structure", "appear_start"]
NUMBER_FIELDS = ["confidence", "page", "physical_index"]


def broken_json_fields(text: Column) -> Column:
    """A map of the known fields of JSON that does not parse, by name in snake case; either spelling is found, texts in
    lower case, the title as it is; null if there is none."""
    both = lambda f: f"(?:{f}|{''.join(x if i == 0 else x.title() for i, x in enumerate(f.split('_')))})"
    strings = {f: F.lower(F.trim(F.regexp_extract(text, rf"""(?i)["']{both(f)}["']\s*:\s*["']([^"']*?)["']""", 1))) for f in TEXT_FIELDS}
    numbers = {f: F.regexp_extract(text, rf"""(?i)["']{both(f)}["']\s*:\s*([\d.]+)""", 1) for f in NUMBER_FIELDS}
    title = {"title": F.regexp_extract(text, r"""(?i)["']title["']\s*:\s*["']([^"']+)["']""", 1)}
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in {**strings, **numbers, **title}.items()])
    found = F.filter(pairs, lambda x: x["v"] != "")
    return F.when(F.size(found) > 0, F.map_from_entries(found))


def strip_markdown(text: Column) -> Column:
    """Reading text: no fences, emphasis, headings, links (their words stay), block ids and spare white space."""
    for pattern, to in (
        (r"(?s)```.*?```", " "), (r"`([^`]*)`", "$1"), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[\[([^\]|]*)\|([^\]]*)\]\]", "$2"), (r"\[\[([^\]]*)\]\]", "$1"),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*>\s?", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"\*\*|__|~~|==", ""), (r"\s\^[A-Za-z0-9-]+", ""), (r"[ \t]+", " "),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


_FRONT, _CALLOUT = r"^---[\s\S]*?---\n", r"> \[!.*?\][^\n]*\n(> .*\n)*"


def _without(text: Column, *patterns: tuple[str, str]) -> Column:
    for pattern, to in patterns:
        text = F.regexp_replace(text, pattern, to)
    return F.btrim(text, F.lit(" \t\r\n"))


def indexed_text(text: Column) -> Column:
    """A note for chunking: without front matter and callouts."""
    return _without(text, (_FRONT, ""), (_CALLOUT, ""))


def card_source(text: Column) -> Column:
    """A note for cards: without front matter, links, callouts, comments and block ids."""
    return _without(text, (_FRONT, ""), (r"\[\[.*?\]\]", ""), (_CALLOUT, ""), (r"%%.*?%%", ""), (r"\^[a-zA-Z0-9_-]+", ""))


def reading_source(text: Column) -> Column:
    """A note for reading: without front matter, links, callouts and rules."""
    return _without(text, (_FRONT, ""), (r"\[\[.*?\]\]", ""), (_CALLOUT, ""), (r"\n---+\n", "\n\n"))


def message_tokens(content: Column, tool_calls: Column) -> Column:
    """Half the characters of a message and of its tool calls as JSON, rounded."""
    return chat_token_estimate(F.coalesce(F.length(content), F.lit(0)) + F.coalesce(F.length(tool_calls), F.lit(0)))


def strip_controls(text: Column) -> Column:
    out = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.when(F.trim(out) == "", F.lit(" ")).otherwise(out)


def wiki_links(text: Column) -> Column:
    """Targets of [[target|alias]] and [[target#part]] links."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), F.lit(1))


def block_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\^([A-Za-z0-9][A-Za-z0-9_-]*)"), F.lit(1))


def chapter_ids(text: Column) -> Column:
    """Chapter numbers that a message cites, once each: those of [[book/24 - title]] links, of quotes ``> — 24``, then of
    ``— 24 -``; from 1 to 9999, padded to four digits unless they have more."""
    patterns = (r"\[\[(?:[^\]]*?/)?(\d+)\s*[-–—]\s*[^\]]*?\]\]", r">\s*[—–-]\s*(\d+)(?:\s*[-–—][^\n]*)?", r"[—–-]\s*(\d+)\s*[-–—]")
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])
    able = F.filter(found, lambda x: x.try_cast("bigint").between(1, 9999))
    return F.array_distinct(F.transform(able, lambda x: F.when(F.length(x) >= 4, x).otherwise(F.lpad(x, 4, "0"))))


def head_and_tail(text: Column, most: int) -> Column:
    """A long text as its first 60 and last 40 hundredths of ``most`` characters."""
    head, tail = int(most * 0.6), most - int(most * 0.6)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(" ... "), F.right(text, F.lit(tail))))


def chunk_kind(text: Column) -> Column:
    t = F.ltrim(text)
    return F.when(t.startswith("#"), "heading").when(t.startswith(">"), "quote").when(t.rlike(r"^([-*+]|\d+\.)\s"), "list").otherwise("body")


def language(text: Column) -> Column:
    return F.when(text.rlike(f"[{CJK}]"), "zh").otherwise("en")


def is_truncated(title: Column) -> Column:
    return F.trim(title).endswith("...") | F.trim(title).endswith("…")


def too_long_title(title: Column) -> Column:
    return F.length(title) > F.when(language(title) == "zh", 50).otherwise(100)


def html_text(html: Column) -> Column:
    """A page's words: scripts, styles and tags away, the common entities resolved."""
    for pattern, to in ((r"(?is)<(script|style)[^>]*>.*?</\1>", " "), (r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr)>", "\n"), (r"<[^>]+>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), (r"[ \t]+", " ")):
        html = F.regexp_replace(html, pattern, to)
    return F.btrim(html, F.lit(" \t\r\n"))


def json_in_text(text: Column) -> Column:
    """The JSON a model's answer holds: thinking away, the fenced block or else the outermost braces, with
    Python's constants and trailing commas put right."""
    t = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.regexp_extract(F.when(fenced != "", fenced).otherwise(t), r"(?s)([\[{].*[\]}])", 1)
    for pattern, to in ((r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r",\s*([\]}])", "$1")):
        body = F.regexp_replace(body, pattern, to)
    return F.nullif(body, F.lit(""))


def duration_text(seconds: Column) -> Column:
    """18小时30分钟; without hours the minutes alone."""
    h, m = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("小时"), m.cast("string"), F.lit("分钟"))).otherwise(F.concat(m.cast("string"), F.lit("分钟")))


def content_id(content: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(content, 256), 1, digits)
