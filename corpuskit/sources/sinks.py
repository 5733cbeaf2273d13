"""What a crawl leaves behind: three CSV tables, and Markdown files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Without these, quotes, empty strings and outer white space don't survive; rows end in a line feed.
CSV = {"header": "true", "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8"}


def text_view(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def pages_view(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.coalesce("title", F.lit("")).alias("title"), "status_code")


def first_seen(items: DataFrame, item: str, *order: str) -> DataFrame:
    """The first row of each item in an order. The smallest row combines before the shuffle, so items with very many rows do no harm."""
    rest = [c for c in items.columns if c != item and c not in order]
    first = items.groupBy(item).agg(F.min(F.struct(*order, *rest)).alias("__first"))
    return first.select(item, *(F.col(f"__first.{c}").alias(c) for c in (*order, *rest))).select(*items.columns)


def images_view(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("images").alias("image_url")).distinct()


def write_csv(pages: DataFrame, directory: str, stamp: str) -> dict[str, str]:
    """Write text_, pages_ and images_<stamp> under a directory; the paths by name."""
    out = {}
    for name, view in (("text", text_view), ("pages", pages_view), ("images", images_view)):
        out[name] = f"{directory}/{name}_{stamp}"
        view(pages).write.options(**CSV).mode("append").csv(out[name])
    return out


def write_markdown(documents: DataFrame, directory: str, name: str = "file_name", content: str = "markdown") -> DataFrame:
    """One UTF-8 file for each row, overwritten if there; returns the absolute paths. The directory must be one that all executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(directory, exist_ok=True)
        for batch in batches:
            paths = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.abspath(os.path.join(directory, os.path.basename(file)))
                with open(path, "w", encoding="utf-8") as out:
                    out.write(text or "")
                paths.append(path)
            yield pa.RecordBatch.from_pydict({"path": paths})

    return documents.select(name, content).mapInArrow(run, "path string")
