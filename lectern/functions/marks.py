"""Text with positions: markdown stripped with a map back, fuzzy matches, links put in and repaired.

These carry state along a text, which built-in functions cannot; each is a plain function and an Arrow-batched
column beside it.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = re.compile(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]|\[([^\]]*)\]\([^)]*\)|(\*\*|__|~~|==|`|\*)|(\s\^[A-Za-z0-9-]+)")


def stripped_with_map(text: str) -> tuple[str, list[int]]:
    """(text without inline marks, place of each kept character in the original)."""
    out, places, at = [], [], 0
    for m in _MARK.finditer(text):
        out.append(text[at : m.start()])
        places.extend(range(at, m.start()))
        for g in (1, 2):
            if m.group(g) is not None:
                out.append(m.group(g))
                places.extend(range(m.start(g), m.end(g)))
        at = m.end()
    out.append(text[at:])
    places.extend(range(at, len(text)))
    return "".join(out), places


# The characters that a comparison passes over.
_PASSED = set("，。！？、；：\"\"''（）《》【】「」『』…—·-,.!?:;'\"()[]{}<>/\\@#$%^&*_+=|~`")
# Full-width letters and digits stand for the plain ones.
_FOLDED = {chr(c): chr(c - 0xFEE0) for a, z in ("ＡＺ", "ａｚ", "０９") for c in range(ord(a), ord(z) + 1)}


def _bare_with_map(text: str, places: list[int]) -> tuple[str, list[int]]:
    """The text without white space and punctuation, folded and lower-cased, and where its characters stand."""
    keep = [(_FOLDED.get(c, c).lower(), p) for c, p in zip(text, places) if not c.isspace() and c not in _PASSED]
    return "".join(c[0] for c, _ in keep), [p for _, p in keep]


def _all(text: str, part: str, most: int) -> list[int]:
    out, at = [], text.find(part)
    while at >= 0 and len(out) < most:
        out.append(at)
        at = text.find(part, at + 1)
    return out


def fuzzy_matches(text: str, part: str, most: int = 5) -> list[tuple[int, int, str]]:
    """(begin, end, how) of a part in a text: exact places, else those without marks, else those without space and
    punctuation; overlapping places count."""
    if not text or not part:
        return []
    found = _all(text, part, most)
    if found:
        return [(a, a + len(part), "exact") for a in found]
    plain, places = stripped_with_map(text)
    if found := _all(plain, part, most):
        return [(places[a], places[a + len(part) - 1] + 1, "stripped") for a in found]
    bare, places = _bare_with_map(plain, places)
    own = _bare_with_map(part, list(range(len(part))))[0]
    return [(places[a], places[a + len(own) - 1] + 1, "bare") for a in _all(bare, own, most)] if own else []


def already_marked(text: str, begin: int, window: int = 60) -> bool:
    return "<mark" in text[max(0, begin - window) : begin]


def insert_links(text: str, titles: list[str]) -> str:
    """The first free occurrence of each title becomes a [[link]]: bounded by other than word characters, not in a
    link or code; longer titles first."""
    for title in sorted({t for t in titles if t}, key=lambda t: (-len(t), t)):
        guard = [m.span() for m in re.finditer(r"\[\[[^\]]*\]\]|\[[^\]]*\]\([^)]*\)|`[^`]*`", text)]
        for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(title)}(?![A-Za-z0-9_])", text):
            if not any(a <= m.start() < b for a, b in guard):
                text = f"{text[: m.start()]}[[{title}]]{text[m.end() :]}"
                break
    return text


def balanced_links(text: str) -> bool:
    """Whether every [[ is closed on its line before another opens."""
    for line in text.split("\n"):
        open_ = False
        for m in re.finditer(r"\[\[|\]\]", line):
            if (m[0] == "[[") == open_:
                return False
            open_ = not open_
        if open_:
            return False
    return True


def block_context(text: str, block: str, most: int = 500) -> str | None:
    """Whole lines around the line that holds ^block, about ``most`` characters to either side."""
    lines = text.split("\n")
    at = next((i for i, x in enumerate(lines) if re.search(rf"\^{re.escape(block)}(?![\w-])", x)), None)
    if at is None:
        return None
    a = z = at
    size = 0
    while a > 0 and size + len(lines[a - 1]) <= most:
        a -= 1
        size += len(lines[a])
    size = 0
    while z + 1 < len(lines) and size + len(lines[z + 1]) <= most:
        z += 1
        size += len(lines[z])
    return "\n".join(lines[a : z + 1])


def first_array(text: str) -> str | None:
    """The first balanced JSON array in a text."""
    start = text.find("[")
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "[]":
                depth += 1 if c == "[" else -1
                if depth == 0:
                    return text[start : i + 1]
        start = text.find("[", start + 1)
    return None


def cards(text: str, most_answer: int = 100, most_context: int = 300) -> list[dict]:
    """Cards of a model's answer: objects with an answer, numbered over the valid ones."""
    try:
        rows = json.loads(first_array(text) or "[]")
    except ValueError:
        return []
    out = []
    for r in rows:
        if isinstance(r, dict) and str(r.get("answer") or "").strip():
            tags = r.get("tags") if isinstance(r.get("tags"), list) else []
            out.append({"id": f"card_{len(out) + 1:03d}", "type": str(r.get("type") or "概念"), "answer": str(r["answer"]).strip()[:most_answer], "context": str(r.get("context") or "")[:most_context], "tags": [str(x) for x in tags]})
    return out


def front_matter(text: str) -> dict[str, str]:
    """Keys of the front matter; lists, inline or by lines, are joined by commas."""
    m = re.match(r"---\r?\n(.*?)\r?\n---", text or "", re.S)
    out: dict[str, str] = {}
    key = None
    for line in (m[1].splitlines() if m else []):
        item = re.match(r"\s*-\s+(.*)$", line)
        pair = re.match(r"([\w-]+):\s*(.*)$", line)
        if item and key:
            out[key] = ",".join(x for x in (out[key], item[1].strip().strip("\"'")) if x)
        elif pair:
            key, value = pair[1], pair[2].strip()
            out[key] = ",".join(x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()) if value.startswith("[") and value.endswith("]") else value.strip("\"'")
    return out


def reading_segments(text: str, target: int = 300) -> list[str]:
    """Parts for reading aloud: paragraphs, long ones by sentences gathered up to the target."""
    out = []
    for p in (x.strip() for x in re.split(r"\n\s*\n", text or "")):
        if not p:
            continue
        if len(p) <= target:
            out.append(p)
            continue
        held = ""
        for s in re.findall(r"[^。！？.!?]+[。！？.!?]*\s*", p):
            if held and len((held + s).strip()) > target:
                out.append(held.strip())
                held = ""
            held += s
        if held.strip():
            out.append(held.strip())
    return out


def column(f, returns: str):
    """An Arrow-batched column function of f over strings; null stays null."""

    @F.pandas_udf(returns)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(v))

    return run


def match_column(text: Column, part: Column, most: int = 5) -> Column:
    @F.pandas_udf("array<struct<begin:long,end:long,how:string>>")
    def run(t: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([[{"begin": a, "end": z, "how": h} for a, z, h in fuzzy_matches(x or "", y or "", most)] for x, y in zip(t, p)])

    return run(text, part)


def split_blocks(text: Column) -> Column:
    """struct(block, text) of paragraphs that end in a ^block id."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(.*?)\s\^([A-Za-z0-9-]+)(?=\s|$)"), F.lit(1))
    ids = F.regexp_extract_all(text, F.lit(r"\s\^([A-Za-z0-9-]+)(?=\s|$)"), F.lit(1))
    return F.zip_with(ids, parts, lambda i, p: F.struct(i.alias("block"), F.btrim(p, F.lit(" \n\t")).alias("text")))


def page_marks(text: Column) -> Column:
    """struct(first, last) of <start_index_N> marks."""
    n = F.regexp_extract_all(text, F.lit(r"<start_index_(\d+)>"), F.lit(1))
    return F.struct(F.get(n, F.lit(0)).cast("int").alias("first"), F.get(n, F.size(n) - 1).cast("int").alias("last"))


def physical_index(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def dotted_leaders(text: Column) -> Column:
    """Dotted leaders of a table of contents become a colon."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def labelled_facts(text: Column) -> Column:
    """struct(dimension, fact) of lines ``[dimension] a；b``."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\[[^\]]+\]"))
    each = lambda x: F.transform(F.filter(F.split(F.regexp_extract(x, r"^\s*\[[^\]]+\]\s*(.*)$", 1), "[；;]"), lambda f: F.trim(f) != ""), lambda f: F.struct(F.regexp_extract(x, r"\[([^\]]+)\]", 1).alias("dimension"), F.trim(f).alias("fact")))
    return F.flatten(F.transform(lines, each))


def title_kind(title: Column) -> Column:
    return (
        F.when(title.rlike(r"^(第[一二三四五六七八九十百零\d]+[部篇卷]|(?i:part|book|volume)\s)"), "part")
        .when(title.rlike(r"^(第[一二三四五六七八九十百零\d]+[章回]|(?i:chapter)\s)"), "chapter")
        .when(title.rlike(r"^(第[一二三四五六七八九十百零\d]+节|\d+\.\d+)"), "section")
        .when(title.rlike(r"^(?i:前言|序言?|目录|附录|后记|致谢|preface|foreword|contents|appendix|index|acknowledg)"), "special")
        .otherwise("plain")
    )


def moved_links(text: Column, old: str, new: str) -> Column:
    """[[old]], [[old#part]] and [[old|alias]] now point to new."""
    return F.regexp_replace(text, r"\[\[\Q" + old + r"\E(?=[\]|#])", "[[" + new.replace("\\", "\\\\").replace("$", "\\$"))
