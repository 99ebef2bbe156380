"""EPUB books as chapters. Archives are read through Spark; each is taken apart in the task that holds it."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, chapter int, title string, href string, text string, error string"
_BREAKS = re.compile(r"(?is)<br\s*/?>|</(?:p|div|h[1-6]|li|tr|blockquote)>")
_HIDDEN = re.compile(r"(?is)<(script|style|head)\b.*?</\1>")
_HEADING = re.compile(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>")
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def plain(html: str) -> str:
    """A page's text, a line a block."""
    text = re.sub(r"<[^>]+>", "", _BREAKS.sub("\n", _HIDDEN.sub("", html)))
    for entity, char in _ENTITIES.items():
        text = text.replace(entity, char)
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _labels(z: zipfile.ZipFile, folder: str, hrefs: list[str]) -> dict[str, str]:
    """The first label of each file in the book's contents, an NCX or a navigation page."""
    out: dict[str, str] = {}
    for href in hrefs:
        at = posixpath.join(folder, href)
        if at not in z.namelist():
            continue
        here = posixpath.dirname(at)
        for e in ElementTree.fromstring(z.read(at)).iter():
            if _local(e) == "navPoint":
                label = " ".join("".join(x.itertext()) for x in e if _local(x) == "navLabel").strip()
                target = next((x.get("src") for x in e if _local(x) == "content"), "")
            elif _local(e) == "a" and e.get("href"):
                label, target = "".join(e.itertext()).strip(), e.get("href")
            else:
                continue
            out.setdefault(posixpath.normpath(posixpath.join(here, unquote(target.split("#")[0]))), label)
    return out


def chapters_of(content: bytes) -> list[tuple[int, str, str, str]]:
    """(number, title, href, text) of a book's pages in reading order: pages without text are left out, a title is that
    of the contents, else the first heading, else Chapter and the number."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in root.iter() if _local(e) == "rootfile")
        book, folder = ElementTree.fromstring(z.read(package)), posixpath.dirname(package)
        items = {e.get("id"): e for e in book.iter() if _local(e) == "item"}
        nav = [e.get("href") for e in items.values() if e.get("media-type") == "application/x-dtbncx+xml" or "nav" in (e.get("properties") or "").split()]
        labels = _labels(z, folder, nav)
        out: list[tuple[int, str, str, str]] = []
        for ref in (e.get("idref") for e in book.iter() if _local(e) == "itemref"):
            href = unquote(items[ref].get("href")) if ref in items else ""
            at = posixpath.normpath(posixpath.join(folder, href))
            if not href or at not in z.namelist() or items[ref].get("href") in nav:
                continue
            page = z.read(at).decode("utf-8", "replace")
            text = plain(page)
            if text:
                head = _HEADING.search(page)
                out.append((len(out), labels.get(at) or (plain(head[1]) if head else "") or f"Chapter {len(out) + 1}", at, text))
        return out


def epub_chapters(spark: SparkSession, path: str) -> DataFrame:
    """(path, chapter, title, href, text, error) of all EPUB files under path; what is no book is one row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for at, content in zip(d["path"], d["content"]):
                try:
                    rows = [(at, *c, None) for c in chapters_of(content)]
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
                    rows = [(at, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "chapter", "title", "href", "text", "error"]).astype({"chapter": "Int32"})

    return files.mapInPandas(run, SCHEMA)


def epub_texts(chapters: DataFrame) -> DataFrame:
    """(book_id, text): chapters as the Markdown texts that index_books reads, a heading a chapter."""
    body = F.concat(F.lit("# "), "title", F.lit("\n"), "text")
    rows = chapters.where("error is null").groupBy(F.col("path").alias("book_id")).agg(F.array_sort(F.collect_list(F.struct("chapter", body.alias("t")))).alias("c"))
    return rows.select("book_id", F.array_join(F.transform("c", lambda x: x["t"]), "\n").alias("text"))
