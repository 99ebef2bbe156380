"""Predicates over what a reader asks: corrections, claims of absence, existence, comparison, small talk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide results; kept as they have to be.
CORRECTIONS = {
    "否定词": ["不对", "错了", "搞错", "不是的", "是错的"],
    "开头否定": [r"^\s*不[，。\s,]"],
    "重新检索": ["再搜索", "再搜一", "再搜下", "重新搜", "再找", "重新看", "重新查", "重新找", "还是再"],
    "坚持存在": ["这里就", "明明", "确定有", "是有的", "是存在的", "有这", "有这个", "有这概念"],
    "引用质疑": ["引错", "引用错", "引不"],
    "章节质疑": ["章节错", "章节引用错", "不是这"],
}
ABSENCE = "未出现|未提及|没有提到|书里没有|并未提及"
COMPARISONS = ["对比", "比较", "异同", "其他书", "联系起来", "另一本", "跨书", "主题阅读", "共识", "分歧", "相同", "差异", "看法不同", "观点不同", "有什么不同", "有何不同"]
GREETING = r"(?i)^(你好|hi|hello|谢谢|thank you|早上好|中午好|下午好|晚上好|再见|bye)\s*[。！？?!]*$"


def correction_reason(text: Column) -> Column:
    """The first rule's reason; null where none applies or there is no text."""
    return F.coalesce(*[F.when(text.rlike("|".join(words)), F.lit(reason)) for reason, words in CORRECTIONS.items()])


def is_correction(text: Column) -> Column:
    """Texts of under three characters are never corrections."""
    return F.coalesce((F.length(F.trim(text)) >= 3) & correction_reason(text).isNotNull(), F.lit(False))


def claims_absence(answer: Column, query: Column) -> Column:
    return F.coalesce((answer != "") & (query != "") & answer.rlike(ABSENCE), F.lit(False))


def compares_books(query: Column) -> Column:
    return reduce(lambda a, w: a | F.contains(F.lower(query), F.lit(w)), COMPARISONS, F.lit(False))


def is_small_talk(query: Column, continues: Column, correction: Column) -> Column:
    """A greeting, or at most five characters that neither go on with the talk nor correct it."""
    q = F.trim(query)
    return q.rlike(GREETING) | ((F.length(q) <= 5) & ~continues & ~correction)


def asked_concept(query: Column) -> Column:
    """The concept of a question whether a book mentions something, without the words around it."""
    for pattern, to in ((r"^.*?(?:有没有|是否)(?:提到|讲到|说到|涉及|讨论)?\s*", ""), (r"[？?。！!《》]", ""), (r"\s*(?:的|内容|相关|有关)$", ""), (r"^[的了着过吗呢吧啊]+\s*|\s*[的了着过吗呢吧啊]+$", "")):
        query = F.regexp_replace(query, pattern, to)
    return F.trim(query)


# Words that ask for a drawing, that ask whether a book holds something, and particles.
DIAGRAM = "思维导图|脑图|流程图|概念图|画.{0,6}图|可视化展示|可视化|导图|示意图|infographic|图表|知识图谱"
PARTICLES = "[的了着过吗呢吧啊\\s]"


def wants_diagram(text):
    return text.rlike(DIAGRAM)


def strong_match(concept, score, content, least: float = 0.5):
    """Whether a hit shows that a book holds a concept: its score, and any pair of the concept's characters (the concept
    itself if it has fewer than two) in its content."""
    from lectern.functions.similarity import bigrams

    bare = F.regexp_replace(concept, PARTICLES, "")
    held = F.when(F.length(bare) < 2, F.contains(content, bare)).otherwise(F.exists(bigrams(bare), lambda g: F.contains(content, g)))
    return (score >= least) & held
