"""Links of answers: parsed, judged, repaired, checked against what was read, merged into notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.nesting import nearest, written

LINK = r"\[\[([^\]]+)\]\]"


def parsed_links(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, link, raw, alias, book, file, heading, block) of each [[book/file#part|alias]] in order. A link
    without a slash has no book, and its file is the whole target."""
    rows = answers.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(LINK), F.lit(1))).alias("place", "link"))
    parts = F.split("link", r"\|", -1)
    raw = F.trim(parts[0])
    d = rows.withColumn("raw", raw).withColumn("_n", F.size(F.split("raw", "/", -1)))
    book = F.when(F.col("_n") < 2, "").otherwise(F.substring_index("raw", "/", 1))
    path = F.when(F.col("_n") < 2, F.col("raw")).otherwise(F.substring(F.col("raw"), F.length(book) + 2, F.length("raw")))
    part = F.when(F.col("_n") >= 2, F.nullif(F.regexp_extract(path, "#([^#]+)$", 1), F.lit("")))
    file = F.when(part.isNotNull(), F.left(path, F.length(path) - F.length(part) - 1)).otherwise(path)
    block = F.nullif(F.regexp_extract(part, r"\^([a-zA-Z0-9_-]+)", 1), F.lit(""))
    return d.select(
        key, F.col("place").cast("long").alias("place"), "link", "raw", F.when(F.size(parts) > 1, F.trim(parts[1])).otherwise(F.substring_index("raw", "/", -1)).alias("alias"), book.alias("book"),
        F.when(F.col("_n") < 2, file).otherwise(F.regexp_replace(file, r"\.md$", "")).alias("file"), F.when(block.isNull(), part).alias("heading"), block.alias("block"),
    )


def link_issues(expected: Column) -> Column:
    """The issues of a parsed link, in order: wrong_book, malformed_format, missing_caret; none where no book is expected."""
    book, raw = F.col("book"), F.col("raw")
    found = F.array(
        F.when((book == "") | (book != expected), "wrong_book"),
        F.when(F.col("file") == "", "malformed_format"),
        F.when(F.contains(raw, F.lit("#")) & ~F.contains(raw, F.lit("#^")) & F.coalesce(F.col("heading"), F.lit("")).eqNullSafe(""), "missing_caret"),
    )
    return F.when(expected == "", F.array().cast("array<string>")).otherwise(F.array_compact(found))


def with_book_prefix(text: Column, book: Column) -> Column:
    """[[file]] becomes [[book/file]]; links with a slash stay, and all where there is no book."""
    at = F.regexp_replace(book, r"([\\$])", r"\\$1")
    return F.when(F.coalesce(book, F.lit("")) == "", text).otherwise(F.regexp_replace(text, F.lit(r"\[\[([^/\]]+)\]\]"), F.concat(F.lit("[["), at, F.lit("/$1]]"))))


def without_empty_blocks(text: Column) -> Column:
    """[[path#^|alias]] becomes [[path|alias]], [[path#^]] becomes [[path]]."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\[([^#\]]*)#\^\|([^\]]+)\]\]", "[[$1|$2]]"), r"\[\[([^#\]]*)#\^\]\]", "[[$1]]")


def file_key(name: Column) -> Column:
    """A file's name for comparison: without .md, leading zeros of its number and outer spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), r"^0+(\d)", "$1"))


def file_alias(name: Column) -> Column:
    """What a file is about: its name without .md and its leading number."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), r"^\d+\s*[-–]\s*", ""))


def _first(k: DataFrame, *by: str) -> DataFrame:
    """Of known blocks the first a group, as struct(_o, _k)."""
    return k.groupBy(*by).agg(F.min(F.struct("_o", "_k")).alias("_x"))


def _begun(texts: DataFrame, text: str, others: DataFrame, other: Column) -> DataFrame:
    """texts with ``_p``: each beginning of a text that is as long as any of the others is."""
    lengths = others.agg(F.collect_set(F.length(other)).alias("_n"))  # one row, of different lengths alone
    return texts.crossJoin(F.broadcast(lengths)).withColumn("_n", F.explode(F.filter("_n", lambda n: n <= F.length(text)))).withColumn("_p", F.left(text, "_n"))


def repaired_blocks(wanted: DataFrame, known: DataFrame, by: str, key: str, block: str, order: str) -> DataFrame:
    """(key, block): for each wanted block id the known one of its group that is equal, else the first that begins it or
    is begun by it (a leading p apart), else the first of those with the nearest number; none where nothing fits.

    Each way is a join on equal texts, on equal beginnings or a walk over sorted numbers, of a group's different ids."""
    bare = lambda c: F.regexp_replace(c, "^p", "")
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint")
    w = wanted.select(F.col(by).alias("_a"), key, F.col(block).alias("_w")).where("_a is not null and _w is not null")
    k = known.select(F.col(by).alias("_a"), F.col(block).alias("_k"), F.col(order).alias("_o")).where("_a is not null and _k is not null")
    k = written(k.groupBy("_a", "_k").agg(F.min("_o").alias("_o")).withColumn("_b", bare("_k")), "known-blocks")
    ids = written(w.select("_a", "_w").distinct().withColumn("_b", bare("_w")), "wanted-blocks")
    equal = ids.join(_first(k.withColumn("_w", F.col("_k")), "_a", "_w"), ["_a", "_w"])
    begins = ids.withColumn("_p", F.col("_b")).join(_first(_begun(k.select("_a", "_k", "_o"), "_k", ids, F.col("_b")), "_a", "_p"), ["_a", "_p"])
    begun = _begun(ids, "_b", k, F.col("_b")).join(_first(k.withColumn("_p", F.col("_b")), "_a", "_p"), ["_a", "_p"])
    numbers = _first(k.withColumn("_m", number("_k")).where("_m is not null"), "_a", "_m")
    asks = ids.withColumn("_m", number("_w")).where("_m is not null")
    both = numbers.select("_a", "_m", F.lit(0).alias("_side"), F.col("_m").alias("_at")).unionByName(asks.select("_a", "_m", F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_at")).distinct())
    sides = [nearest(both, "_a", ["_m", "_side"], "_side", "_at", "_near", after).where("_side = 1 and _near is not null").select("_a", "_m", "_near") for after in (False, True)]
    near = sides[0].unionByName(sides[1]).join(numbers.withColumnRenamed("_m", "_near"), ["_a", "_near"]).withColumn("_far", F.abs(F.col("_near") - F.col("_m")))
    near = asks.join(near, ["_a", "_m"])
    none = F.lit(0).cast("bigint")
    ways = [d.select("_a", "_w", F.struct(F.lit(c).alias("_c"), far.alias("_far"), "_x").alias("_y")) for d, c, far in ((equal, 0, none), (begins, 1, none), (begun, 1, none), (near, 2, F.col("_far")))]
    best = reduce(DataFrame.unionByName, ways).groupBy("_a", "_w").agg(F.min("_y").alias("_y"))
    return w.join(best, ["_a", "_w"]).groupBy(key).agg(F.min("_y").alias("_y")).select(key, F.col("_y._x._k").alias(block))


def _names(text: Column) -> Column:
    """What an input text names: the targets of its links and their last parts, file_name: "x", and 'x'(12)."""
    path = F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: F.substring_index(F.substring_index(x, "#", 1), "|", 1))
    last = F.transform(path, lambda x: F.substring_index(x, "/", -1))
    return F.concat(path, last, F.regexp_extract_all(text, F.lit(r'file_name:\s*"([^"]+)"'), F.lit(1)), F.regexp_extract_all(text, F.lit(r"'([^']+)'\(\d+\)"), F.lit(1)))


def without_fabricated(answers: DataFrame, inputs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): links whose target no input of the answer names become plain words: the alias, else the target. A
    target is named if it or its last part equals a name, ends with one or is the end of one, or equals one without its
    number. An answer whose inputs name nothing stays as it is."""
    named = inputs.select(key, F.explode(_names(F.col(text))).alias("_n")).groupBy(key).agg(F.collect_set("_n").alias("_known"))  # what one answer was given
    d = answers.select(key, text).join(named, key, "left").withColumn("_links", F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), F.lit(1))))
    bare = lambda c: F.regexp_replace(c, r"^\d+\s*[-–]\s*", "")

    def fabricated(x: Column) -> Column:
        path = F.substring_index(F.substring_index(x, "#", 1), "|", 1)
        file = F.substring_index(path, "/", -1)
        return ~F.exists("_known", lambda n: (n == path) | F.endswith(n, file) | F.endswith(file, n) | (bare(n) == bare(file)))

    bad = F.when(F.col("_known").isNull(), F.array().cast("array<string>")).otherwise(F.filter("_links", fabricated))
    return d.select(key, F.aggregate(bad, F.col(text), lambda t, x: F.replace(t, F.concat(F.lit("[["), x, F.lit("]]")), F.substring_index(x, "|", -1))).alias(text))


def merge_plan(notes: DataFrame, key: str) -> DataFrame:
    """(key, new_tags, links): of notes(existing, tags, links, removed) the tags that are not there yet, and the links
    struct(target, text) whose target was not removed before, as struct(text, replacement)."""
    links = F.transform(F.filter("links", lambda x: ~F.array_contains("removed", x["target"])), lambda x: F.struct(x["text"].alias("text"), F.concat(F.lit("[["), x["target"], F.lit("|"), x["text"], F.lit("]]")).alias("replacement")))
    return notes.select(key, F.filter("tags", lambda x: ~F.array_contains("existing", x)).alias("new_tags"), links.alias("links"))


def with_annotations(entries: DataFrame, notes: DataFrame, query: str, key: str, factor: float = 1.3, least: float = 0.02) -> DataFrame:
    """Entries(query, key, score) and, beside them, each query's annotations at ``factor`` times its best score."""
    top = entries.groupBy(query).agg(F.max("score").alias("_top"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(key)) - 1
    more = notes.select(query, key).join(top, query, "left").select(
        query, F.concat(F.lit("annotation-"), place.cast("string")).alias("entry"), F.round(F.coalesce("_top", F.lit(least)) * factor, 6).alias("score"), F.lit(True).alias("annotation")
    )
    return entries.select(query, F.col(key).cast("string").alias("entry"), "score", F.lit(False).alias("annotation")).unionByName(more)
