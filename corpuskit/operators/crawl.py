"""Crawling as joins: URL lists, robots rules, politeness, and breadth-first search with budgets.

A transport turns a frontier of URLs into pages. Offline, that is a join with a table of pages; a live
one fetches in Arrow batches, one HTTP session for each task. Frontiers, visited URLs and pages stay
DataFrames; a level of the search is one round of anti-joins, and its lineage is cut by checkpoint()
or a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskit.functions.dom import PageOptions, page_fields
from corpuskit.functions.urls import domain
from corpuskit.storage import written

AGENT = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0 Safari/537.36"


@dataclass(frozen=True)
class CrawlOptions:
    """How to crawl; None lifts a bound."""

    delay: float = 1.0
    max_depth: int | None = 3
    respect_robots_txt: bool = True
    user_agent: str = AGENT
    timeout: float = 10
    max_pages: int | None = 100
    verify_ssl: bool = True
    page: PageOptions = field(default_factory=PageOptions)


Transport = Callable[[DataFrame], DataFrame]


def corpus_transport(pages: DataFrame, url: str = "url", html: str = "html") -> Transport:
    """Pages from a table. URLs that it lacks are failed fetches and give no row."""
    source = pages.select(F.col(url).alias("__url"), F.col(html).alias("html")).filter("html IS NOT NULL").dropDuplicates(["__url"])

    def fetch(frontier: DataFrame) -> DataFrame:
        return frontier.join(source, frontier["url"] == source["__url"]).drop("__url").withColumn("status_code", F.lit(200))

    return fetch


def http_transport(options: CrawlOptions) -> Transport:
    """Pages over HTTP, waiting between requests to one host, whose URLs go to one task. Failures give no row."""

    def fetch(frontier: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{c}` {t}" for c, t in frontier.dtypes) + ", html string, status_code int"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import random
            import time

            import requests

            session, last = requests.Session(), {}
            session.headers["User-Agent"] = options.user_agent
            session.verify = options.verify_ssl
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    host = row["url"].split("/")[2] if "//" in row["url"] else ""
                    wait = last.get(host, 0) + random.uniform(0.8, 1.5) * options.delay - time.monotonic()
                    time.sleep(max(0, wait)) if host in last else None
                    last[host] = time.monotonic()
                    try:
                        got = session.get(row["url"], timeout=options.timeout)
                        got.raise_for_status()
                    except requests.RequestException:
                        continue
                    rows.append(row | {"html": got.text, "status_code": got.status_code})
                yield pa.RecordBatch.from_pylist(rows, batch.schema.append(pa.field("html", pa.string())).append(pa.field("status_code", pa.int32())))

        return frontier.repartition(domain(F.col("url"))).mapInArrow(run, schema)

    return fetch


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """Rows of urls that their site's rules allow.

    rules: (domain, agent, path, allow), a row for each line, in no order. Lines count whose agent is
    part of the product token of `agent` (what stands before its first slash), or those for * where a site has none for it; the longest path that the URL's path begins with
    decides, allow before disallow of the same length. Sites without rules allow everything. The rules
    are joined by domain, and Spark broadcasts them where they are small.
    """
    lines = rules.groupBy(F.col("domain").alias("__domain")).agg(F.collect_list(F.struct("agent", "path", "allow")).alias("__lines"))
    path = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    product = F.lit(agent.split("/")[0].lower())
    own = F.filter("__lines", lambda x: (x["agent"] != "*") & (F.length(x["agent"]) > 0) & F.contains(product, F.lower(x["agent"])))
    used = F.when(F.size(own) > 0, own).otherwise(F.filter("__lines", lambda x: x["agent"] == "*"))
    hits = F.filter(used, lambda x: (F.length(x["path"]) > 0) & path.startswith(x["path"]))
    best = F.array_max(F.transform(hits, lambda x: F.struct(F.length(x["path"]).alias("n"), x["allow"].alias("allow"))))
    joined = urls.join(lines, domain(F.col(url)) == F.col("__domain"), "left")
    return joined.filter(F.coalesce(best["allow"], F.lit(True))).select(*urls.columns)


def robots_rules(text: str) -> list[tuple[str, str, bool]]:
    """(agent, path, allow) of a robots.txt: groups begin with one or more agents; comments, other fields and empty disallows count for nothing."""
    rules, agents, ruled = [], [], False
    for line in text.splitlines():
        name, _, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            agents, ruled = ([] if ruled else agents) + [value], False
        elif name in ("allow", "disallow"):
            ruled = True
            rules += [(a, value, name == "allow") for a in agents if value]
    return rules


def robots_table(files: DataFrame, domain: str = "domain", text: str = "text") -> DataFrame:
    """The rules of robots.txt files (domain, text), as robots_allowed takes them."""

    @F.arrow_udf("array<struct<agent: string, path: string, allow: boolean>>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [[dict(zip(("agent", "path", "allow"), r, strict=True)) for r in robots_rules(t or "")] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("agent", pa.string()), ("path", pa.string()), ("allow", pa.bool_())])))

    return files.select(F.col(domain).alias("domain"), F.explode(run(F.col(text))).alias("r")).select("domain", "r.*")


def politeness_gaps(requests: DataFrame, host: str, ts: str, *tie: str) -> DataFrame:
    """requests with the microseconds since the host's request before."""
    w = Window.partitionBy(host).orderBy(ts, *tie)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return requests.withColumn("gap_us", micros(F.col(ts)) - micros(F.lag(ts).over(w)))


def scrape(fetched: DataFrame, options: PageOptions = PageOptions()) -> DataFrame:
    """Rows of fetched pages (url, html, status_code, ...) with title, text, images and links; html goes."""
    kept = [c for c in fetched.columns if c != "html"]
    return fetched.select(*kept, page_fields(F.col("html"), F.col("url"), options).alias("__page")).select(*kept, "__page.*")


def scrape_many(spark: SparkSession, urls: list[str], transport: Transport, options: CrawlOptions = CrawlOptions(), robots: DataFrame | None = None) -> DataFrame:
    """The pages of a list of URLs, first mention first, up to max_pages that could be fetched."""
    first = {u: i for i, u in reversed(list(enumerate(urls)))}
    frontier = spark.createDataFrame([(u, i) for u, i in first.items()], "url string, ord bigint")
    if robots is not None and options.respect_robots_txt:
        frontier = robots_allowed(frontier, robots, options.user_agent)
    got = transport(frontier).orderBy("ord")
    got = got if options.max_pages is None else got.limit(options.max_pages)
    return scrape(got, options.page).withColumn("depth", F.lit(0))


class Crawl:
    """A breadth-first search that keeps its visited URLs, so that budgets hold across searches.

    Only fetched pages count as visited; a failure does not use up the budget and may be tried again
    at another depth. Links of the last level and off-site links stay in the frontier that is returned.
    """

    def __init__(self, spark: SparkSession, transport: Transport, options: CrawlOptions = CrawlOptions(), robots: DataFrame | None = None):
        self.spark, self.transport, self.options, self.robots = spark, transport, options, robots
        self.reset()

    def reset(self) -> None:
        self.visited, self.count = self.spark.createDataFrame([], "url string"), 0

    def search(self, start: str, same_domain_only: bool = True) -> tuple[DataFrame, DataFrame]:
        """(pages, what is left of the frontier): pages with depth and the place in visiting order."""
        o, spark = self.options, self.spark
        frontier = spark.createDataFrame([(start, 0, 0)], "url string, depth int, ord bigint")
        results, left, depth = [], [], 0
        while True:
            if o.max_pages is not None and self.count >= o.max_pages:
                left.append(frontier)
                break
            ready = frontier.join(self.visited, "url", "left_anti")
            if o.max_depth is not None and depth > o.max_depth:
                ready = ready.limit(0)
            if same_domain_only:
                ready = ready.filter(domain(F.col("url")) == domain(F.lit(start)))
            ready = ready.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy("ord"))).filter("__n = 1").drop("__n")
            if self.robots is not None and o.respect_robots_txt:
                ready = robots_allowed(ready, self.robots, o.user_agent)
            got = self.transport(ready)
            if o.max_pages is not None:
                got = got.orderBy("ord").limit(o.max_pages - self.count)  # a budget of pages bounds the rows
            level = written(scrape(got, o.page), "level")
            n = level.count()
            if o.max_pages is not None and self.count + n >= o.max_pages:
                last = level.agg(F.max("ord")).first()[0]
                left.append(frontier.filter(F.col("ord") > F.lit(last)))
            if not n:
                break
            base, self.count = self.count, self.count + n
            results.append(level.withColumn("visit_ord", rank_in_order(level, "ord") + base))
            self.visited = self.visited.unionByName(level.select("url"))
            if o.max_depth is not None and depth >= o.max_depth:
                break
            links = level.select("ord", F.posexplode("links").alias("__at", "url"))
            links = links.groupBy("url").agg(F.min(F.struct("ord", "__at")).alias("__first")).join(self.visited, "url", "left_anti")
            # places in order: the parent's, then the link's own
            frontier = links.select("url", F.lit(depth + 1).alias("depth"), rank_in_order(links, "__first").alias("ord"))
            frontier = written(frontier, "frontier")
            if frontier.isEmpty():
                break
            depth += 1
        pages = _union(spark, results, "url string, depth int, ord bigint, status_code int, title string, text string, images array<string>, links array<string>, visit_ord bigint")
        return pages.drop("ord"), _union(spark, left, "url string, depth int, ord bigint")


def rank_in_order(df: DataFrame, column: str) -> Column:
    """0, 1, 2, ... in the order of a column. A crawl's level is bounded by its page budget."""
    return (F.row_number().over(Window.orderBy(column)) - 1).cast("bigint")


def _union(spark: SparkSession, frames: list[DataFrame], schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for f in frames:
        out = out.unionByName(f.select(*out.columns))
    return out


def bfs_depths(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth: the fewest edges (src, dst) from any start (node). Level by level, new nodes by an anti-join."""
    frontier = written(starts.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    found, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found
