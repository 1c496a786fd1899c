"""Index tables: enclosing symbols, incremental upkeep, statistics (IDX-6 to IDX-9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Lines of a bucket, in which spans and points of a file meet.
BUCKET = 64


def _bucket(line: Column) -> Column:
    return F.call_function("div", line.cast("long"), F.lit(BUCKET).cast("long"))


def by_bucket(spans: DataFrame) -> DataFrame:
    """``spans(file, start_line, end_line)`` once for each bucket that they meet: ``bucket``, the part in it
    (``from_line``, ``to_line``) and whether that is the ``whole`` bucket. Spans that end before they start
    hold nothing and go."""
    met = spans.filter("start_line <= end_line").withColumn("bucket", F.explode(F.sequence(_bucket(F.col("start_line")), _bucket(F.col("end_line")))))
    low, high = F.col("bucket") * BUCKET, F.col("bucket") * BUCKET + (BUCKET - 1)
    return met.withColumns({"from_line": F.greatest("start_line", low), "to_line": F.least("end_line", high), "whole": (F.col("start_line") <= low) & (F.col("end_line") >= high)})


def meet_spans(points: DataFrame, symbols: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``points(file, line)`` with the spans that may be their smallest: ``_size``, ``_seq``, ``_sym``.

    Of the spans that share their part of a bucket only the smallest can be the smallest of a point there,
    so a bucket keeps one row for each part: a point meets few rows however many symbols its file has
    and however deep they are nested, and a large file is spread over its buckets."""
    best = F.struct((F.col("end_line") - F.col("start_line")).alias("size"), F.col("sym_seq").alias("seq"))
    parts = by_bucket(symbols.select("file", "start_line", "end_line", "sym_seq", F.struct(*keep).alias("_s"))).repartition("file", "bucket")
    parts = parts.groupBy("file", "bucket", "from_line", "to_line").agg(F.min(best).alias("_b"), F.min_by("_s", best).alias("_s"))
    parts = parts.select(F.col("file").alias("_file"), F.col("bucket").alias("_part"), "from_line", "to_line", F.col("_b.size").alias("_size"), F.col("_b.seq").alias("_seq"), F.col("_s").alias("_sym"))
    placed = points.withColumn("_bucket", _bucket(F.col("line")))
    return placed.join(parts, (F.col("file") == F.col("_file")) & (F.col("_bucket") == F.col("_part")) & F.col("line").between(F.col("from_line"), F.col("to_line")), "left")


def enclosing_symbol(points: DataFrame, symbols: DataFrame, key: list[str], keep: tuple[str, ...] = ("id", "name")) -> DataFrame:
    """IDX-6. ``points(file, line, *key)`` -> key and ``sym_<column>`` of the smallest span that holds
    the 0-based line; equal spans go to the smaller sym_seq, points outside all get nulls. A key
    belongs to one file and line.

    Both sides are shuffled once, by file and bucket of lines, and grouped where they lie."""
    held = meet_spans(points.select("file", "line", *[k for k in key if k not in ("file", "line")]), symbols, keep)
    best = held.groupBy("file", "_bucket", *[k for k in key if k != "file"]).agg(F.min_by("_sym", F.struct("_size", "_seq")).alias("_sym"))
    return best.select(*key, *[F.col(f"_sym.{c}").alias(f"sym_{c}") for c in keep])


def first_inside(spans: DataFrame, points: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """For each span (``key``, file, start_line, end_line) the ``value`` of its first point by ``order``;
    spans without one don't appear. ``points(file, line)``.

    A span takes one row from each bucket that it covers and looks at single lines only where it starts
    and ends."""
    first = lambda df, *by: df.groupBy(*by).agg(F.min(F.struct(*order, value)).alias("_v"))
    lines = first(points.withColumn("bucket", _bucket(F.col("line"))), "file", "bucket", "line")
    meets = lines.withColumn("whole", F.lit(False)).unionByName(first(lines.select("file", "bucket", F.col("_v.*")), "file", "bucket").select("file", "bucket", F.lit(None).cast("long").alias("line"), "_v", F.lit(True).alias("whole")))
    parts = by_bucket(spans.select(key, "file", "start_line", "end_line"))
    held = parts.join(meets, ["file", "bucket", "whole"]).filter("whole or line between from_line and to_line")
    return held.groupBy(key).agg(F.min("_v").alias("_v")).select(key, F.col(f"_v.{value}").alias(value))


def attach_from_symbol(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """IDX-9. Calls with ``from_symbol``, the id of the enclosing symbol, null at top level. A call is its
    own key, so its columns pass through the one shuffle; (file, call_seq) names a call once."""
    calls = calls.drop("from_symbol")
    return enclosing_symbol(calls, symbols, calls.columns, ("id",)).withColumnRenamed("sym_id", "from_symbol")


def index_incremental(files: DataFrame, snapshot: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """IDX-7. Files whose (file, content_hash) the snapshot has keep its rows; the others are extracted
    again; files that are gone are dropped. Only hashes are shuffled to compare."""
    key = ["file", "content_hash"]
    kept = snapshot.join(files.select(*key), key, "left_semi")
    return kept.unionByName(extract(files.join(snapshot.select(*key).distinct(), key, "left_anti")))


def index_stats(files: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """IDX-8. One row: n_files, n_symbols, n_calls."""
    one = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((files, "n_files"), (symbols, "n_symbols"), (calls, "n_calls"))]
    return one[0].crossJoin(one[1]).crossJoin(one[2])  # three one-row counts
