"""Stream state: deltas, folding, replays, and what a batch reads and writes."""

import random

import pytest

from sinkweave.streaming import jobs, state

VERSION = "file string, content string, ts long"


def run(spark, path, batches, replay=()):
    """Batches through the function that the stream calls, some of them twice."""
    taken = {}

    class Stream:
        writeStream = property(lambda self: self)
        option = trigger = lambda self, *a, **k: self
        start = lambda self: self

        def foreachBatch(self, f):
            taken["f"] = f
            return self

    jobs.stream_index(Stream(), lambda new: new.filter("content <> ''").select("file", "content_hash", "content"), path, "")
    for n, rows in enumerate(batches):
        for _ in range(2 if n in replay else 1):
            taken["f"](spark.createDataFrame(rows, VERSION), n)


def test_any_batches_replays_and_folds_end_alike(spark, tmp_path, monkeypatch):
    rnd = random.Random(2)
    batches = [[(f"f{rnd.randint(0, 11)}", rnd.choice(["a", "b", ""]), 10 * n + k) for k in range(4)] for n in range(9)]
    want = {}
    for file, content, _ in (r for b in batches for r in b):
        want[file] = content
    for name, after, replay in (("plain", 100, ()), ("folded", 3, (2, 3, 8))):
        monkeypatch.setattr(state, "FOLD_AFTER", after)
        run(spark, str(tmp_path / name), batches, replay)
        assert {r["file"]: r["content"] for r in jobs.latest(spark, str(tmp_path / name)).collect()} == {f: c for f, c in want.items() if c}
    # two bases and the deltas after the older one are all that stays
    kept = sorted(p.name for p in (tmp_path / "folded").iterdir())
    assert [n for n in kept if n[0] == "v"] == ["v00000005", "v00000008"] and [n for n in kept if n[0] == "d"] == ["d00000006", "d00000007", "d00000008"]


def test_a_batch_costs_what_it_changes(spark, tmp_path):
    path = str(tmp_path / "index")
    run(spark, path, [[(f"f{k}", "a", 1) for k in range(2000)], [("f5", "a", 2), ("f6", "b", 2)]])
    delta = spark.read.parquet(f"{path}/d00000001")
    assert sorted((r["file"], r[state.MARKER]) for r in delta.collect()) == [("f6", False), ("f6", True)]
    # the second batch reads the buckets of its two files only
    mine = {r["b"] for r in spark.createDataFrame([("f5",), ("f6",)], "file string").select(state.bucket_of("file").alias("b")).collect()}
    read = state.state(spark, path, "file", 1, sorted(mine), markers=True)
    assert {r[state.BUCKET] for r in read.select(state.BUCKET).distinct().collect()} == mine and read.count() < 200
    assert "PartitionFilters: [isnotnull" in read._jdf.queryExecution().toString() or "PartitionFilters: [stream_bucket" in read._jdf.queryExecution().toString()
    assert jobs.latest(spark, path).count() == 2000


def test_decisions_need_marks_to_start_from(spark, tmp_path):
    log = "id string, action string, author string, ts long, seq long"
    spark.createDataFrame([("sink:a:1", "confirm", "u", 1, 1)], log).write.parquet(str(tmp_path / "log"))
    with pytest.raises(Exception, match="no marks"):
        jobs.stream_decisions(spark.readStream.schema(log).parquet(str(tmp_path / "log")), str(tmp_path / "marks"), str(tmp_path / "cp")).awaitTermination()
