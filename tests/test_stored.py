"""Stored tables: JSON as other tools write it, broken records, missing folders."""

import json

from sinkweave.sources import tables


def test_records_arrays_and_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "f1", "sinkMarkId": "k", "chain": [{"file": "a.js", "symbol": "s", "line": 3, "evidence": "e"}], "verdict": "reachable", "more": 1}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "f2"}, {"id": "f3", "chain": None}], indent=1))
    (tmp_path / "c.json").write_text('{"id": "f4", "chain": [')
    (tmp_path / "d.json").write_text('{"id": "f5", "chain": "none"}')
    got = {r["id"]: r for r in tables.read_stored(spark, str(tmp_path), "findings").collect()}
    assert set(got) == {"f1", "f2", "f3"} and got["f1"]["sink_mark_id"] == "k" and got["f1"]["chain"][0]["line"] == 3 and got["f2"]["chain"] is None
    bad = {r["stored_in"].rsplit("/", 1)[1]: r["record"] for r in tables.rejected_records(spark, str(tmp_path), "findings").collect()}
    assert set(bad) == {"c.json", "d.json"} and bad["c.json"].startswith('{"id": "f4"')


def test_every_kind_goes_round_and_may_be_missing(spark, tmp_path):
    for kind in tables.STORED:
        assert tables.read_stored(spark, str(tmp_path / "none"), kind).collect() == [] == tables.rejected_records(spark, str(tmp_path / "none"), kind).collect()
        names = tables.table_schema(kind).names
        assert [n for n in names if n != n.lower()] == []
        first = spark.createDataFrame([tuple(None if n else "x" for n in range(len(names)))], tables.table_schema(kind))
        tables.write_stored(first, str(tmp_path / kind), kind)
        assert tables.read_stored(spark, str(tmp_path / kind), kind, lines=True).collect() == first.collect()
