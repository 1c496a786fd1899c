"""Sharding by fixed virtual slots.

Records hash into thousands of virtual slots that never change; only the slot-to-shard map does.
Bytes are summed per slot (map-side first), the map is a small versioned table, and rebalancing
edits a few of its rows, so a record moves only if its slot was moved.

Equal rows are counted on the map side and dealt by their ordinals, so copies of one row, or rows
without id and text, spread over slots like any others. A version of the map has a folder of its own
and is written once.

Defined results: a null text counts no bytes, a null id hashes like any value, repeated rows stay
repeated, an empty input gives no rows (the map is still complete), columns beyond ``doc_id`` and
``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinkweave.llm.common import cut, shared_dir

N_SHARDS = 40
N_SLOTS = 4096
#: Bytes that a record costs beside its text.
OVERHEAD = 16
#: Equal rows that one task makes of their count.
COPIES = 4096
MAP_SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("vslot", T.IntegerType()),
    T.StructField("shard", T.IntegerType()),
    T.StructField("slot_start", T.LongType()),
])


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """One narrow row per document: doc_id, size, text_crc32, vslot. The text goes no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    equal = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    few = equal.filter(F.col("n") <= COPIES).withColumn("low", F.lit(0).cast("long"))
    # many copies are split before they become rows again
    many = equal.filter(F.col("n") > COPIES).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))).repartition("doc_id", "text_crc32", "low")
    ordinal = F.explode(F.sequence("low", F.least(F.col("low") + COPIES, "n") - 1)).alias("nth")
    rows = few.unionByName(many).select("doc_id", "size", "text_crc32", ordinal)
    place = F.when(F.col("nth") == 0, F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("doc_id", "text_crc32", "nth"))
    return rows.withColumn("vslot", F.pmod(place, F.lit(n_slots)).cast("int")).drop("nth")


def slot_loads(recs: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot; at most n_slots rows, summed on the map side first."""
    return recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def initial_map(n_slots: int, n_shards: int) -> list[int]:
    """Version 0: slots dealt in turn."""
    return [s % n_shards for s in range(n_slots)]


def rebalance(shard_of: list[int], loads: dict[int, int], n_shards: int) -> list[int]:
    """Edits a map until no move of a slot, and no swap of two, narrows the gap between the emptiest
    shard and another: from the fullest goes the slot whose size is nearest to half of the gap, or it
    is swapped for a smaller one. Works on the map alone (one entry per slot), never on records."""
    shard_of = list(shard_of)
    slots: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(shard_of):
        if loads.get(slot):
            bisect.insort(slots[shard], (loads[slot], slot))
    total = [sum(b for b, _ in own) for own in slots]

    def nearest(own: list[tuple[int, int]], want: float, below: float) -> tuple[int, int] | None:
        at = bisect.bisect_left(own, (want, -1))
        return min((own[k] for k in (at - 1, at) if 0 <= k < len(own) and 0 < own[k][0] < below), key=lambda x: (abs(x[0] - want), x), default=None)

    def move(item: tuple[int, int], source: int, target: int) -> None:
        slots[source].remove(item)
        bisect.insort(slots[target], item)
        total[source] -= item[0]
        total[target] += item[0]
        shard_of[item[1]] = target

    for _ in range(20 * len(shard_of)):
        low = min(range(n_shards), key=lambda k: (total[k], k))
        for high in sorted(range(n_shards), key=lambda k: (-total[k], k)):
            gap = total[high] - total[low]
            if gap <= 1:
                return shard_of
            if item := nearest(slots[high], gap / 2, gap):
                move(item, high, low)
                break
            swaps = [(x, y) for x in slots[high] if (y := nearest(slots[low], x[0] - gap / 2, x[0])) and 0 < x[0] - y[0] < gap]
            if swaps:
                x, y = min(swaps, key=lambda s: (abs(s[0][0] - s[1][0] - gap / 2), s))
                move(x, high, low)
                move(y, low, high)
                break
        else:
            break
    return shard_of


def write_map(spark: SparkSession, path: str, version: int, shard_of: list[int], rows: dict[int, int]) -> None:
    """Adds one version of the map to the table at ``path``; it is an error if it is there. ``slot_start`` is the number of records
    in the shard's earlier slots, so that positions inside a shard need no global ordering."""
    start: dict[int, int] = {}
    out = []
    for vslot, shard in enumerate(shard_of):
        out.append((vslot, shard, start.get(shard, 0)))
        start[shard] = start.get(shard, 0) + rows.get(vslot, 0)
    spark.createDataFrame(out, T.StructType(MAP_SCHEMA.fields[1:])).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(path).filter(F.col("version") == version).drop("version")


def newest_map(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """The last version of the map at ``path`` and its shard of each slot (one entry per slot)."""
    try:
        known = spark.read.schema(MAP_SCHEMA).parquet(path)
        version = known.agg(F.max("version").alias("v")).first()["v"]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    if version is None:
        return None
    return version, [r["shard"] for r in read_map(spark, path, version).select("vslot", "shard").orderBy("vslot").collect()]


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Every record with its shard. Law ``bytes``: the shards' sizes are near equal.

    The map at ``map_path`` is read, edited for the present loads (and for a changed number of shards)
    and written as its next version; without one, version 0 deals the slots in turn. ``slot`` is the
    record's gapless position inside its shard, ``vslot`` its virtual slot. The map (n_slots rows) is
    all that reaches the driver and all that is broadcast."""
    spark = docs.sparkSession
    recs = cut(records(docs, n_slots), "shard-records")
    loads = slot_loads(recs).collect()
    by_bytes, by_rows = {r["vslot"]: r["bytes"] for r in loads}, {r["vslot"]: r["rows"] for r in loads}
    path = map_path or f"{shared_dir(spark)}/sinkweave/slot-map-{uuid.uuid4().hex}"
    known = newest_map(spark, path)
    if known is None:
        known = 0, initial_map(n_slots, n_shards)
        write_map(spark, path, *known, by_rows)
    version, shard_of = known
    if len(shard_of) != n_slots:
        raise ValueError(f"the map at {path} has {len(shard_of)} slots, not {n_slots}: slots never change")
    # slots of a shard that is no more are dealt to those that are
    edited = rebalance([s % n_shards for s in shard_of], by_bytes, n_shards)
    write_map(spark, path, version + 1, edited, by_rows)
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        recs.withColumn("at", F.row_number().over(within) - 1)
        .join(F.broadcast(read_map(spark, path, version + 1)), "vslot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("slot_start") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "vslot",
        )
    )
