"""Streaming upkeep of the index and of the marks (STR-1, STR-2).

Both keep a keyed table of a base and deltas (``state.py``): what a batch reads and writes follows
the batch, and a batch that is run again after a failure gives the same delta again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinkweave.functions.text import content_hash
from sinkweave.streaming import state


def latest(spark, path: str, key: str = "file") -> DataFrame | None:
    """The table as the batches so far have left it."""
    return state.state(spark, path, key)


def _buckets(batch: DataFrame, key: str) -> list[int]:
    """The buckets of a batch's keys, BUCKETS at most."""
    return sorted(r["b"] for r in batch.select(state.bucket_of(key).alias("b")).distinct().collect())


def stream_index(versions: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger):
    """STR-1. A stream of (file, content, ts): per batch the last version of each file; files whose hash is
    known are skipped, the others are extracted and replace what the index had."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("file").agg(F.max_by("content", F.struct("ts", F.xxhash64("content"))).alias("content")).withColumn("content_hash", content_hash(F.col("content")))
        before = state.state(spark, path, "file", number, _buckets(batch, "file"), markers=True)
        if before is not None:
            newest = newest.join(before.select("file", "content_hash").distinct(), ["file", "content_hash"], "left_anti")
        state.write_delta(extract(newest), newest.select("file", "content_hash"), path, "file", number)
        state.fold(spark, path, "file", number)

    return versions.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fold_decisions(marks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (id, action, author, ts, seq), replayed in the order of (ts, seq) on marks. A delete takes
    the mark and all that came before; confirm, exclude and restore change a mark that is there;
    manual confirms it, or adds one at the place that its id names. Any split of a log into batches
    that keeps its order gives the same marks."""
    at = F.struct("ts", "seq")
    is_ = lambda *actions: F.col("action").isin(*actions)
    # what is last of all is last after the delete too, or nothing is: each id is one row of the log, in one pass
    folded = decisions.filter("id is not null").groupBy("id").agg(
        F.max(F.when(is_("delete"), at)).alias("_gone"), F.max(F.when(is_("confirm", "exclude", "restore", "manual"), F.struct(at.alias("at"), "action"))).alias("_last"),
        F.max(F.when(is_("confirm", "manual"), F.struct(at.alias("at"), "author"))).alias("_by"), F.max(F.when(is_("manual"), F.struct(at.alias("at"), "author"))).alias("_hand"))
    after = {c: F.when(F.col("_gone").isNull() | (F.col(f"{c}.at") > F.col("_gone")), F.col(c)) for c in ("_last", "_by", "_hand")}
    folded = folded.select("id", F.col("_gone").isNotNull().alias("_deleted"), *[v.alias(c) for c, v in after.items()])
    kinds = {f.name: f.dataType for f in marks.schema}
    names = [*marks.columns, *[c for c in ("symbol", "anchor", "category", "cwe", "rule_id", "note", "author", "time") if c not in kinds]]
    both = marks.select("id", F.struct(*marks.columns).alias("_m")).join(folded, "id", "full").withColumn("_m", F.when(~F.coalesce("_deleted", F.lit(False)), F.col("_m")))
    by_hand, place = F.col("_hand").isNotNull(), r"^([^:]*):(.*):([0-9]+)$"
    own = {c: F.col(f"_m.{c}") if c in kinds else F.lit(None).cast("string") for c in names}
    made = {
        "kind": F.regexp_extract("id", place, 1), "status": F.lit("confirmed"), "origin": F.lit("manual"), "file": F.regexp_extract("id", place, 2), "line": F.regexp_extract("id", place, 3).cast(kinds["line"]),
        "author": F.col("_hand.author"), "time": F.col("_hand.at.ts").cast("string")} | {c: own[c] for c in ("symbol", "anchor", "category", "cwe", "rule_id", "note")}
    told = own | {c: F.when(by_hand, made.get(c)).otherwise(own[c]) for c in names}
    action = F.col("_last.action")
    told["status"] = F.when(action.isin("confirm", "manual"), "confirmed").when(action == "exclude", "excluded").when(action == "restore", "candidate").otherwise(told["status"])
    told["author"], told["time"] = F.coalesce("_by.author", told["author"]), F.coalesce(F.col("_by.at.ts").cast("string"), told["time"])
    return both.filter(F.col("_m").isNotNull() | by_hand).select(*[F.col("id") if c == "id" else told[c].alias(c) for c in names])


def stream_decisions(decisions: DataFrame, marks_path: str, checkpoint: str, **trigger):
    """STR-2. A stream of decisions kept folded into the marks; version -1 is the table to start from."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = state.state(spark, marks_path, "id", number, _buckets(batch, "id"))
        if before is None:
            raise ValueError(f"no marks to start from in {marks_path}/v{-1:08d}")
        ids = batch.select("id").filter("id is not null").distinct()
        # a mark depends on its own decisions only
        state.write_delta(fold_decisions(before.join(ids, "id", "left_semi"), batch), ids, marks_path, "id", number)
        state.fold(spark, marks_path, "id", number)

    return decisions.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
