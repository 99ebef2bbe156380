"""The few calls of the library, and EPUB books read through Spark."""

import zipfile

from lectern import api
from lectern.sources import epub

CONTAINER = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'
OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b%20c.xhtml" media-type="application/xhtml+xml"/>
<item id="e" href="empty.xhtml" media-type="application/xhtml+xml"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="b"/><itemref idref="e"/><itemref idref="a"/><itemref idref="gone"/></spine></package>"""
NCX = '<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>第二章</text></navLabel><content src="a.xhtml#x"/></navPoint></navMap></ncx>'


def make_epub(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/book.opf", OPF)
        z.writestr("OEBPS/toc.ncx", NCX)
        z.writestr("OEBPS/a.xhtml", "<html><head><title>x</title></head><body><p>复利 &amp; 时间</p><p>two</p></body></html>")
        z.writestr("OEBPS/b c.xhtml", "<html><body><h1>Money <i>first</i></h1><p>one<br/>line</p><script>no</script></body></html>")
        z.writestr("OEBPS/empty.xhtml", "<html><body><img src='x'/></body></html>")


def test_epub(spark, tmp_path):
    make_epub(tmp_path / "book.epub")
    (tmp_path / "broken.epub").write_bytes(b"no archive")
    rows = sorted(epub.epub_chapters(spark, str(tmp_path)).collect(), key=lambda r: (r["error"] is not None, r["chapter"]))
    assert [(r["chapter"], r["title"], r["href"], r["text"]) for r in rows[:2]] == [(0, "Money first", "OEBPS/b c.xhtml", "Money first\none\nline"), (1, "第二章", "OEBPS/a.xhtml", "复利 & 时间\ntwo")]
    assert len(rows) == 3 and rows[2]["error"].startswith("BadZipFile") and rows[2]["text"] is None


def test_index_and_search(spark, tmp_path):
    make_epub(tmp_path / "book.epub")
    api.index_documents(epub.epub_texts(epub.epub_chapters(spark, str(tmp_path / "book.epub"))), f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, "复利"), (2, "money")], "query long, text string")
    got = {r["query"]: (r["title"], r["rank"]) for r in api.search(spark, f"{tmp_path}/index", asked).collect()}
    assert got == {1: ("第二章", 1), 2: ("Money first", 1)}


def test_index_notes(spark, tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    (root / "a.md").write_text("one")
    (root / "b.md").write_text("two")
    derive = lambda d: d.select("path", "hash", "content")
    first = {r["path"]: r["change"] for r in api.index_notes(spark, str(root), f"{tmp_path}/index", derive).collect()}
    assert first == {"a.md": "new", "b.md": "new"}
    (root / "a.md").write_text("one more")
    (root / "b.md").unlink()
    second = {r["path"]: r["change"] for r in api.index_notes(spark, str(root), f"{tmp_path}/index", derive).collect()}
    assert second == {"a.md": "changed", "b.md": "deleted"}
    assert [r["content"] for r in spark.read.parquet(f"{tmp_path}/index/current").collect()] == ["one more"]
