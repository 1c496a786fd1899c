"""Keyed tables that streams keep current: a base, and a delta for each batch since.

A batch writes the rows of the keys that it changed and a marker for each of them, dealt into buckets
by key; it reads only the buckets of its own keys. On reading, the newest version that has a marker
for a key wins, so a key without rows in it is gone. After some batches the state is written as a new
base. The base before stays, so that the last batch can be run again; what is older is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 128
#: Deltas that are read before they are folded into a base.
FOLD_AFTER = 16
BUCKET, MARKER, VERSION = "stream_bucket", "stream_marker", "stream_version"
_HELPERS = (BUCKET, MARKER, VERSION)


def bucket_of(key: str):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def _folders(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the whole tables and of the deltas in a folder, listed once; unfinished ones don't count."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)):
        return [], []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop(path))]
    done = [n for n in names if n[:1] in "vd" and n[1:].lstrip("-").isdigit() and fs.exists(hadoop(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done if n[0] == "v"), sorted(int(n[1:]) for n in done if n[0] == "d")


def _name(path: str, kind: str, number: int) -> str:
    return f"{path}/{kind}{number:08d}"


def state(spark: SparkSession, path: str, key: str, below: int | None = None, buckets: list[int] | None = None, markers: bool = False) -> DataFrame | None:
    """The table as it was before batch ``below`` (as it is, without), of all buckets or some. With
    ``markers`` their rows are kept; None if nothing was written yet."""
    bases, deltas = _folders(spark, path)
    bases = [b for b in bases if below is None or b < below]
    base = bases[-1] if bases else None
    deltas = [d for d in deltas if (below is None or d < below) and (base is None or d > base)]
    parts = []
    for kind, number in ([("v", base)] if bases else []) + [("d", d) for d in deltas]:
        df = spark.read.parquet(_name(path, kind, number))
        if BUCKET not in df.columns:  # a table to start from, written without buckets
            df = df.withColumns({BUCKET: bucket_of(key), MARKER: F.lit(False)})
        if buckets is not None:
            df = df.filter(F.col(BUCKET).isin(buckets))
        parts.append(df.withColumn(VERSION, F.lit(number)))
    if not parts:
        return None
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    if deltas:  # the newest marker of a key is small: one row of each delta that touched it
        newest = rows.filter(MARKER).groupBy(key).agg(F.max(VERSION).alias("stream_newest"))
        rows = rows.join(newest, key, "left").filter(F.col("stream_newest").isNull() | (F.col(VERSION) == F.col("stream_newest"))).drop("stream_newest")
    return rows if markers else rows.filter(~F.col(MARKER)).drop(*_HELPERS)


def write_delta(rows: DataFrame, touched: DataFrame, path: str, key: str, number: int) -> None:
    """Batch ``number``: the rows of all keys in ``touched``, which names each key once and may have
    further columns of the table for its marker. Run again it writes the same folder again."""
    marked = rows.withColumn(MARKER, F.lit(False)).unionByName(touched.withColumn(MARKER, F.lit(True)), allowMissingColumns=True)
    marked.withColumn(BUCKET, bucket_of(key)).repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(_name(path, "d", number))


def fold(spark: SparkSession, path: str, key: str, number: int, after: int | None = None) -> None:
    """Writes the state after batch ``number`` as a base once enough deltas stand, and removes what is older
    than the base before."""
    bases, deltas = _folders(spark, path)
    base = max([b for b in bases if b < number], default=None)
    if len([d for d in deltas if base is None or d > base]) < (FOLD_AFTER if after is None else after):
        return
    whole = state(spark, path, key, number + 1)
    whole.withColumns({BUCKET: bucket_of(key), MARKER: F.lit(False)}).repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(_name(path, "v", number))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, numbers in (("v", bases), ("d", deltas)):
        for old in numbers:
            if base is not None and old < base or (kind == "d" and old == base):
                fs.delete(hadoop(_name(path, kind, old)), True)
