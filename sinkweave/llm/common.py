"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sinkweave.functions.lineage import cut, shared_dir  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Runs of ASCII letters and digits and of anything beyond ASCII, in lower-cased text: the contract's
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` told by what is in it, which Java finds some 20 times faster.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Rows of a few longs up to which a written table is broadcast (under 100 bytes each in memory); beyond, Spark shuffles.
BROADCAST_ROWS = 2_000_000


def bounded(written: DataFrame) -> DataFrame:
    """A written table of narrow rows, broadcast while it has few enough: what it meets is not shuffled."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def most_frequent(counted: DataFrame, n: int, count: str = "n") -> DataFrame:
    """The rows with the highest counts, n at most: those from a count on that a histogram of
    logarithms gives, so that no task sends the driver more than is kept. Read a written table here."""
    step = F.floor(F.log2(count) * 64)
    left, least = n, None
    for row in counted.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("k")).collect():
        left -= row["m"]
        if left < 0:
            break
        least = row["k"]
    return counted.filter(F.lit(False) if least is None else step >= least)
