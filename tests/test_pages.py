import pytest
from pyspark.sql import functions as F

from corpuskit.functions import urls
from corpuskit.functions.dom import PageOptions, extract, select, to_markdown, tree

U = "https://pier.example"


def test_basic_page():
    got = extract("<html><head><title> Harbour  log </title></head><body><h1>Head</h1><p>One &amp; two.<p>Three<script>x</script><a href=/page1>a</a><img src=i.png></body>", U)
    assert got["title"] == "Harbour  log" and got["text"] == "Harbour  log Head One & two. Three a" and got["links"] == [f"{U}/page1"] and got["images"] == []


def test_links():
    page = "".join(f"<a href='{h}'>x</a>" for h in ("/page1", "https://pier.example/page2#top", "page3;v=1?q=2", "mailto:a@b", "tel:1", "javascript:x", "#", " /page1 "))
    assert extract(page, U)["links"] == [f"{U}/page1", f"{U}/page2", f"{U}/page3?q=2"]
    page = "<a href=/blog/a>1</a><a href=/products/b>2</a><a href=/about>3</a><a href=/x>4</a>"
    assert extract(page, U, PageOptions(allowed_url_patterns=("/blog/", "/products/")))["links"] == [f"{U}/blog/a", f"{U}/products/b"]


def test_images():
    page = "<img src=a.jpg><img src=/b.GIF?x=1><img src='https://x.org/c.png#f'><img src=d.svg><img src=nodot><img src='data:image/png;base64,AA'>"
    assert extract(page, U, PageOptions(content_types=("images",)))["images"] == ["data:image/png;base64,AA", f"{U}/a.jpg", f"{U}/b.GIF?x=1", "https://x.org/c.png#f"]
    assert len(extract(page, U, PageOptions(content_types=("images",), img_allow=("jpg", "png")))["images"]) == 3


def test_zones_and_pruning():
    page = "<nav>menu<a href=/n>n</a></nav><div class='main-content x'>main <a href=/c>c</a></div><div class=sidebar><a href=/s>s</a></div><footer>foot</footer>"
    got = extract(page, U, PageOptions(content_selector=".main-content"))
    # outside the zone nothing is cut
    assert got["text"] == "main c" and got["links"] == [f"{U}/c", f"{U}/n", f"{U}/s"]
    assert extract(page, U)["links"] == [f"{U}/c", f"{U}/s"]
    assert extract(page, U, PageOptions(content_types=("images",)))["links"] == [f"{U}/c", f"{U}/n", f"{U}/s"] and extract(page, U, PageOptions(content_types=("images",)))["text"] == ""
    only = PageOptions(content_selector=".main-content", extract_links_from_content_only=True)
    assert extract(page, U, only)["links"] == [f"{U}/c"]
    assert extract(page, U, PageOptions(content_selector=".main-content", extract_links_from_content_only=True, link_selectors=(".sidebar",)))["links"] == [f"{U}/c", f"{U}/s"]
    kept = extract("<nav class=important>keep</nav><nav>drop</nav><p>text</p>", U, PageOptions(exclude_selectors=("nav", "footer"), keep_selectors=("nav.important",)))
    assert kept["text"] == "keep text"
    assert extract("<p>x</p>", U, PageOptions(content_selector="#none"))["text"] == "x"


def test_selectors():
    root = tree("<div id=a class='x y'><p class=x>1<span>2</span></p></div><p>3</p>")
    assert [len(select(root, s)) for s in ("p", "p.x", ".x", "#a", "div p", "div span, p", "#a .x span", "[id=a]", "*")] == [2, 1, 2, 1, 1, 3, 1, 1, 4]
    with pytest.raises(ValueError):
        select(root, "p > a")


def test_markdown():
    assert to_markdown("<h2>T</h2><p>a <b>b</b> <em>c</em> <a href=u>l</a><img src=i></p><ul><li>x<li>y</ul><ol><li>z</ol><blockquote>q</blockquote>").split("\n\n")[:2] == ["## T", "a **b** *c* [l](u)"]
    assert "1. z" in to_markdown("<ol><li>z</ol>") and "> q" in to_markdown("<blockquote>q</blockquote>") and "![t](i)" in to_markdown("<img src=i alt=t>", ())


def test_deep_pages():
    n = 20_000
    assert to_markdown("<b>" * n + "x") == "**" * n + "x" + "**" * n and to_markdown("<div>" * n + "y" + "</z>" * n) == "y"
    assert extract("<div>" * n + "<a href=/p>y</a>" + "</z>" * n, U)["links"] == [f"{U}/p"]


def test_url_columns(spark):
    rows = [("https://quay.pier.example:8443/page?x#y", "/a;b?c#d"), ("http://h/p.JPG?x", "https://z/q;r")]
    df = spark.createDataFrame(rows, "u string, h string")
    got = df.select(urls.domain(F.col("u")).alias("d"), urls.canonical_link(F.col("u"), F.col("h")).alias("c"), urls.rooted_link(F.col("u"), F.col("h")).alias("r"), urls.extension(F.col("u")).alias("e")).collect()
    assert [r.d for r in got] == ["https://quay.pier.example:8443", "http://h"]
    assert [r.c for r in got] == [r.r for r in got] == ["https://quay.pier.example:8443/a?c", "https://z/q"]
    assert got[1].e == "jpg"


def test_page_title_equals_its_sql(spark, tmp_path):
    import duckdb

    from corpuskit.plans import catalog

    pages = [None, "", "<p>no title</p>", "<title></title>", "<title>open", "<title", "<TITLE lang='x'\n> a\u3000b\u00a0</Title >c</tItle>", "<title>one</title><title>two</title>", "<!-- <title>c</title> --><title>d</title>"]
    pages += [f"<head><title>{t}</title></head>" for t in ("R&amp;D &amp;&amp", "&amp", "&amp;lt; &lt;b&gt; &quot;q&quot; &lt", "&eacute;&#39;&nbsp;x&copy", "a<b>c</b>", "\n line\t", "\u2003 wide \u205f", "&amp;amp;", "x</titl>y", "\U0001f600 \u0131\u0130")]
    pages += ["<titles>s</title>", "<title>" * 20_000 + "x", "<title " * 20_000]
    spark.createDataFrame([(i, U, p) for i, p in enumerate(pages)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        want = dict(db.execute(catalog.ORACLES["page_title"]).fetchall())
    assert {r.page_id: r.title for r in catalog.QUERIES["page_title"](spark, str(tmp_path)).collect()} == want
    # the tree's title decodes references without a semicolon as well, as browsers do
    assert extract("<title> R&ampD &amp </title>", U)["title"] == "R&D &"
