import zipfile

from corpuskit.operators.crawl import Crawl, CrawlOptions, corpus_transport, robots_allowed, robots_table, scrape_many
from corpuskit.sources.docx import read_documents
from corpuskit.sources.sinks import CSV, write_csv, write_markdown

S = "https://s.example"


def site(spark, pages):
    return corpus_transport(spark.createDataFrame([(f"{S}/{k}", "".join(f"<a href='{x}'>l</a>" for x in v)) for k, v in pages.items()], "url string, html string"))


def test_search(spark):
    fetch = site(spark, {"": ["/a", "/b", "https://other.example/x"], "a": ["/c", "/"], "b": ["/c", "/missing"], "c": ["/d"], "d": []})
    pages, left = Crawl(spark, fetch, CrawlOptions(max_depth=2)).search(f"{S}/")
    assert sorted((r.url, r.depth) for r in pages.collect()) == [(f"{S}/", 0), (f"{S}/a", 1), (f"{S}/b", 1), (f"{S}/c", 2)]
    crawl = Crawl(spark, fetch, CrawlOptions(max_pages=2))
    pages, left = crawl.search(f"{S}/")
    assert [r.url for r in pages.orderBy("visit_ord").collect()] == [f"{S}/", f"{S}/a"] and f"{S}/b" in [r.url for r in left.collect()]
    assert crawl.search(f"{S}/")[0].count() == 0
    crawl.reset()
    assert crawl.search(f"{S}/")[0].count() == 2


def test_lists_and_robots(spark):
    fetch = site(spark, {"a": [], "b": [], "c": []})
    urls = [f"{S}/c", f"{S}/missing", f"{S}/a", f"{S}/c", f"{S}/b"]
    assert [r.url for r in scrape_many(spark, urls, fetch, CrawlOptions(max_pages=2)).orderBy("ord").collect()] == [f"{S}/c", f"{S}/a"]
    rules = spark.createDataFrame([(S, "*", "/b", False), (S, "*", "/b/ok", True), (S, "bot", "/", False), ("https://t", "*", "", False)], "domain string, agent string, path string, allow boolean")
    asked = spark.createDataFrame([(f"{S}/a",), (f"{S}/b",), (f"{S}/b/ok/1",), ("https://t/b",), ("https://u/b",)], "url string")
    assert {r.url for r in robots_allowed(asked, rules).collect()} == {f"{S}/a", f"{S}/b/ok/1", "https://t/b", "https://u/b"}
    assert {r.url for r in robots_allowed(asked, rules, "Bot/2.0 (of no one)").collect()} == {"https://t/b", "https://u/b"}
    files = spark.createDataFrame([(S, "# all\nUser-agent: *\nDisallow: /b # not b\nAllow: /b/ok\nDisallow:\n\nUser-agent: bot\nUser-agent: Other\nCrawl-delay: 3\nDisallow: /"), ("https://v", None)], "domain string, text string")
    assert {r.url for r in robots_allowed(asked, robots_table(files)).collect()} == {f"{S}/a", f"{S}/b/ok/1", "https://t/b", "https://u/b"}
    assert {r.url for r in robots_allowed(asked, robots_table(files), "OTHER").collect()} == {"https://t/b", "https://u/b"}


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("u", None, 'a "q", b\nc ', ["i1", "i2"], 200), ("v", "t", "", ["i2", "i3"], 200)], "url string, title string, text string, images array<string>, status_code int")
    out = write_csv(pages, str(tmp_path), "x")
    rows = spark.read.options(**CSV).option("multiLine", True).csv(out["text"]).collect()
    assert {(r.url, r.title or "", r.text or "") for r in rows} == {("u", "", 'a "q", b\nc '), ("v", "t", "")}
    assert sorted(r[0] for r in spark.read.options(**CSV).csv(out["images"]).collect()) == ["i1", "i2", "i3"]


def test_documents(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, props="", run="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"
    body = p("Title", '<w:pStyle w:val="Heading1"/>') + p("Bold &amp; all", run="<w:b/>") + p("one", "<w:numPr/>") + p("two", "<w:numPr/>") + p("end")
    with zipfile.ZipFile(tmp_path / "a.b.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    got = read_documents(spark, str(tmp_path)).collect()[0]
    assert got.html == "<html><body><h1>Title</h1><p><strong>Bold &amp; all</strong></p><ul><li>one</li><li>two</li></ul><p>end</p></body></html>"
    assert got.markdown == "# Title\n\n**Bold & all**\n\n* one\n* two\n\nend" and got.file_name == "a.b.md"
    paths = [r.path for r in write_markdown(read_documents(spark, str(tmp_path)), str(tmp_path / "out")).collect()]
    assert open(paths[0], encoding="utf-8").read() == got.markdown
