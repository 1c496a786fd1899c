"""Column functions over source text: hashes, lines, excerpts (IDX-1, IDX-2, TXT-1, TRI-2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCERPT_CHARS = 6000
CUT_MARK = "\n… (truncated)"


def content_hash(content: Column) -> Column:
    return F.sha1(content.cast("binary"))


def line_count(content: Column) -> Column:
    """Lines split at line feeds: an empty file has one, a last line feed adds one."""
    return F.size(F.split(content, "\n", -1))


def source_lines(content: Column) -> Column:
    return F.split(content, "\r?\n", -1)


def numbered(lines: Column, first: Column) -> Column:
    """Lines with their numbers, padded to five places, from ``first`` (1-based)."""
    return F.array_join(F.transform(lines, lambda line, i: F.concat(F.lpad((i + first).cast("string"), 5, " "), F.lit("| "), line)), "\n")


def slice_source(content: Column, start: Column, end: Column) -> Column:
    """TXT-1. Lines start..end (0-based, inclusive, clamped), numbered from 1, cut at 6000 characters."""
    return slice_lines(source_lines(content), start, end)


def slice_lines(lines: Column, start: Column, end: Column) -> Column:
    """``slice_source`` of a text that is split already."""
    first = F.greatest(start, F.lit(0))
    text = numbered(F.slice(lines, first + 1, F.greatest(end - first + 1, F.lit(0))), first + 1)
    return F.when(F.length(text) > EXCERPT_CHARS, F.concat(F.substring(text, 1, EXCERPT_CHARS), F.lit(CUT_MARK))).otherwise(text)


def truncated(text: Column, n: int) -> Column:
    """White space collapsed first, then cut with one ellipsis beyond n characters."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def normalize_path(path: Column) -> Column:
    """ARC-1. Backslashes to slashes, empty and ``.`` parts dropped, ``..`` takes one off (not above the root)."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), lambda p: ~p.isin("", "."))
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(folded, "/")
