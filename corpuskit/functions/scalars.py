"""Rounding, names, stamps and progress texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(c: Column) -> Column:
    """Two decimals, halves up, the same on every engine that has floor."""
    return F.floor(c * 100 + 0.5) / 100


def seconds(ns: Column) -> Column:
    return ns / F.lit(1e9)


def megabytes(size: Column) -> Column:
    return size / F.lit(1048576.0)


def percentage(part: Column, whole: Column) -> Column:
    """Part of the whole in percent, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole * 100)


def markdown_name(path: Column) -> Column:
    """The base name with its last extension replaced by .md."""
    return F.concat(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), F.lit(".md"))


def file_stamp(ts: Column) -> Column:
    """First 8 hex digits of the md5 of a time to the second."""
    return F.substring(F.md5(F.date_format(ts, "yyyyMMdd_HHmmss").cast("binary")), 1, 8)


def progress_bar(percent: Column, width: int = 40) -> Column:
    full = F.least(F.lit(width), F.floor(percent / 100 * width)).cast("int")
    return F.rpad(F.repeat(F.lit("█"), full), width, "░")
