"""Text structure: lines, fences, headings, section trees, chunks, page groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.functions.text import padded
from lectern.operators.ordered import placed


def lines(docs: DataFrame, key: str) -> DataFrame:
    """(key, line, text): a text's lines from 0."""
    return docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def with_fences(rows: DataFrame, key: str) -> DataFrame:
    """With ``fenced``: within a ``` block, its marks included."""
    is_mark = F.col("text").rlike(r"^\s*```")
    before = F.sum(is_mark.cast("int")).over(Window.partitionBy(key).orderBy("line"))
    return rows.withColumn("fenced", (before % 2 == 1) | is_mark)


def headings(rows: DataFrame, key: str) -> DataFrame:
    """(key, line, level, title) of heading lines outside fences."""
    h = with_fences(rows, key).where(~F.col("fenced") & F.col("text").rlike(r"^#{1,6}\s+\S"))
    return h.select(key, "line", F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1)).cast("long").alias("level"), F.trim(F.regexp_replace("text", r"^#{1,6}\s+", "")).alias("title"))


def section_ranges(heads: DataFrame, key: str, total: DataFrame) -> DataFrame:
    """(.., end): a section's lines end where the next heading stands, the last one's with the text (total: key, lines)."""
    return heads.withColumn("_next", F.lead("line").over(Window.partitionBy(key).orderBy("line"))).join(total, key).withColumn("end", F.coalesce("_next", "lines")).drop("_next", "lines")


def parents(heads: DataFrame, key: str) -> DataFrame:
    """With ``parent``: the line of the nearest earlier heading of a smaller level (null for roots). One running
    window a level, no self join."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.last(F.when(F.col("level") < n, F.col("line")), ignorenulls=True).over(w) for n in range(1, 7)]
    return heads.withColumn("parent", F.element_at(F.array(*above), F.col("level").cast("int")))


def subtree_end(heads: DataFrame, key: str) -> DataFrame:
    """With ``until``: the line of the next heading that is not below this one (null: to the end)."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    after = [F.first(F.when(F.col("level") <= n, F.col("line")), ignorenulls=True).over(w) for n in range(1, 7)]
    return heads.withColumn("until", F.element_at(F.array(*after), F.col("level").cast("int")))


def numbered(rows: DataFrame, by: str, order: list, width: int = 4) -> DataFrame:
    """With ``node_id``: the place in order from 0, padded, in each group."""
    return placed(rows, [by], order, "_place").withColumn("node_id", padded(F.col("_place"), width)).drop("_place")


def callouts(rows: DataFrame, key: str) -> DataFrame:
    """(key, first, kind, text): runs of quoted lines that begin with a [!kind] header; bodies joined by spaces."""
    q = rows.where(F.col("text").startswith(">")).withColumn("_head", F.col("text").rlike(r"^>\s*\[![\w-]+\]"))
    w = Window.partitionBy(key).orderBy("line")
    q = q.withColumn("_gap", F.coalesce(F.col("line") - F.lag("line").over(w) > 1, F.lit(True)))
    q = q.withColumn("_run", F.sum((F.col("_head") | F.col("_gap")).cast("int")).over(w))
    body = F.trim(F.regexp_replace("text", r"^>\s?", ""))
    g = q.groupBy(key, "_run").agg(F.min("line").alias("first"), F.max(F.when(F.col("_head"), F.regexp_extract("text", r"\[!([\w-]+)\]", 1))).alias("kind"), F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("line", body.alias("t"))))).alias("_t"))
    return g.where("kind is not null").select(key, "first", "kind", F.array_join(F.filter(F.transform("_t", lambda x: x["t"]), lambda x: x != ""), " ").alias("text"))


def split_long(text: str, most: int) -> list[str]:
    """Trimmed parts: cut after the last sentence end in the upper half of what may stay, else after the last clause
    end there, else hard; a cut may take the character at ``most`` as well."""
    out = []
    while len(text) > most:
        low = most // 2 + 1
        places = (max(text.rfind(c, low, most + 1) for c in marks) for marks in ("。？！", "，；、,;"))
        cut = next((p + 1 for p in places if p >= 0), most)
        out.append(text[:cut].strip())
        text = text[cut:].strip()
    return [*out, text] if text else out


def chunk_paragraphs(paragraphs: list[tuple[str, str]], least: int = 300, most: int = 800, overlap: int = 80) -> list[tuple[str, list[str], str]]:
    """Chunks (id in the node, block ids, text) of a node's paragraphs (block id, text).

    Paragraphs are gathered until they have ``least`` characters. The next chunk then begins with the last of them, as
    many whole ones as fit in ``overlap``, one at least; it is given at the end even if nothing follows. A paragraph
    over ``most`` ends what is gathered and gives a chunk for each of its parts."""
    out: list[tuple[str, list[str], str]] = []
    held: list[tuple[str, str]] = []
    size = 0

    def give() -> None:
        if held:
            out.append((held[0][0] or f"auto{len(out)}", [b for b, _ in held], " ".join(t for _, t in held)))

    for block, text in paragraphs:
        if len(text) > most:
            give()
            held, size = [], 0
            out += [(f"{block}_{i}" if i else block, [block], part) for i, part in enumerate(split_long(text, most))]
            continue
        held.append((block, text))
        size += len(text)
        if size >= least:
            give()
            keep, room = 1, overlap - len(held[-1][1])
            while keep < len(held) and len(held[-keep - 1][1]) <= room:
                room -= len(held[-keep - 1][1])
                keep += 1
            held = held[-keep:]
            size = len(" ".join(t for _, t in held))
    give()
    return out


def chunks(paragraphs: DataFrame, node: str, order: str, block: str, least: int = 300, most: int = 800, overlap: int = 80) -> DataFrame:
    """(node, chunk_seq, chunk_id, blocks, text): each node's chunks. A node's paragraphs are one array, so the
    fold runs row by row over batches without a Python group for each node."""
    per = paragraphs.groupBy(node).agg(F.sort_array(F.collect_list(F.struct(order, F.col(block).alias("b"), F.coalesce("text", F.lit("")).alias("t")))).alias("p"))
    per = per.select(node, F.transform("p", lambda x: x["b"]).alias("b"), F.transform("p", lambda x: x["t"]).alias("t"))
    schema = T.StructType([per.schema[node], T.StructField("chunk_seq", T.LongType()), T.StructField("chunk_id", T.StringType()), T.StructField("blocks", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = []
            for key, ids, texts in zip(d[node], d["b"], d["t"]):
                for n, (name, blocks, text) in enumerate(chunk_paragraphs(list(zip(ids, texts)), least, most, overlap)):
                    rows.append((key, n, f"{key}_{name}", ",".join(blocks), text))
            yield pd.DataFrame(rows, columns=schema.names)

    return per.mapInPandas(run, schema)


def group_pages(sizes: list[int], most: int, overlap: int = 1) -> list[tuple[int, int]]:
    """(first, end) of page groups, each beginning with the last pages of the one before. All pages are one group if
    they fit; else a group closes before it passes the mean of ``most`` and of an even share."""
    total = sum(sizes)
    if total <= most:
        return [(0, len(sizes))]
    budget = math.ceil((total / math.ceil(total / most) + most) / 2)
    out, first, used = [], 0, 0
    for i, n in enumerate(sizes):
        if used + n > budget:
            out.append((first, i))
            first = max(i - overlap, 0)
            used = sum(sizes[first:i])
        used += n
    return [*out, (first, len(sizes))]


def page_groups(pages: DataFrame, doc: str, page: str, tokens: str, budget: int, overlap: int = 1) -> DataFrame:
    """(doc, page_group, first_page, end_page)."""
    per = pages.groupBy(doc).agg(F.transform(F.sort_array(F.collect_list(F.struct(page, tokens))), lambda x: x[tokens]).alias("n"))
    schema = T.StructType([per.schema[doc], *[T.StructField(c, T.LongType()) for c in ("page_group", "first_page", "end_page")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame([(k, g, a, z) for k, n in zip(d[doc], d["n"]) for g, (a, z) in enumerate(group_pages([int(x) for x in n], budget, overlap))], columns=schema.names)

    return per.mapInPandas(run, schema)


def rolled_up(heads: DataFrame, by: str, tokens: str) -> DataFrame:
    """Heads(by, line, level, tokens) with ``parent``, ``end`` (the last direct child's line, its own without one) and
    ``total`` (its tokens and those of its direct children)."""
    tree = parents(heads, by)
    kids = tree.where("parent is not null").groupBy(by, "parent").agg(F.max("line").alias("_end"), F.sum(tokens).alias("_more")).withColumnRenamed("parent", "line")
    j = tree.join(kids, [by, "line"], "left")
    return j.withColumn("end", F.coalesce("_end", "line")).withColumn("total", F.col(tokens) + F.coalesce("_more", F.lit(0))).drop("_end", "_more")


_SENTENCE_END = r"[。？！.?!、”’'\")）》」\d]$"


def merged_fragments(lines_: DataFrame, key: str) -> DataFrame:
    """(key, line, text, block, parts) of paragraph lines ``text ^block``: a paragraph that ends in no sentence end goes
    on in the paragraph right after it, whose block id stays. Headings and images are never joined."""
    d = lines_.withColumn("block", F.regexp_extract(F.trim("text"), r" \^([a-zA-Z0-9_-]+)$", 1)).where("block <> ''")
    d = d.withColumn("_t", F.trim(F.regexp_replace(F.trim("text"), r" \^[a-zA-Z0-9_-]+$", ""))).withColumn("_special", F.col("_t").rlike(r"^(#|!\[)"))
    w = Window.partitionBy(key).orderBy("line")
    last = F.lag(F.struct("line", "_t", "_special")).over(w)
    goes_on = last.isNotNull() & ~F.col("_special") & ~last["_special"] & ~last["_t"].rlike(_SENTENCE_END)
    d = d.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    g = d.groupBy(key, "_run").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "_t", "block"))).alias("p"))
    return g.select(key, "line", F.array_join(F.transform("p", lambda x: x["_t"]), "").alias("text"), F.element_at("p", -1)["block"].alias("block"), F.size("p").cast("long").alias("parts"))
