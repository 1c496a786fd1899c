"""Points in spans by line buckets: large files, deep nesting, edges."""

import random

from pyspark.sql import functions as F

from sinkweave.operators import chains, indexing

SYMBOL = "file string, start_line int, end_line int, sym_seq int, id string, name string"


def smallest(symbols, file, line):
    held = [s for s in symbols if s[0] == file and s[1] <= line <= s[2]]
    return min(held, key=lambda s: (s[2] - s[1], s[3]))[4] if held else None


def test_equals_a_scan_of_all_spans(spark):
    rnd = random.Random(5)
    symbols = []
    for file in ("a", "b"):
        for k in range(150):
            start = rnd.randint(0, 700)
            symbols.append((file, start, start + rnd.choice([-1, 0, 3, 63, 64, 200, 700]), k, f"{file}{k}", "n"))
    points = [(file, line, n) for n, (file, line) in enumerate((f, x) for f in ("a", "b", "c", None) for x in (0, 63, 64, 127, 128, 1500, *rnd.sample(range(900), 120)))]
    got = indexing.enclosing_symbol(spark.createDataFrame(points, "file string, line int, n int"), spark.createDataFrame(symbols, SYMBOL), ["file", "n"], ("id",)).collect()
    assert {(r["file"], r["n"]): r["sym_id"] for r in got} == {(f, n): smallest(symbols, f, line) for f, line, n in points}
    marks = [(f"m{n}", file or "c", line + 1, rnd.choice(["source", "sink"]), rnd.choice(["candidate", "excluded"]), n * 7 % 11) for n, (file, line, _) in enumerate(points)]
    got = chains.symbols_with_source(spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(marks, "id string, file string, line int, kind string, status string, mark_seq int")).collect()
    want = {}
    for s in symbols:
        inside = [(m[5], m[0]) for m in marks if m[1] == s[0] and s[1] <= m[2] - 1 <= s[2] and m[3] == "source" and m[4] != "excluded"]
        if inside:
            want[s[4]] = min(inside)[1]
    assert {r["id"]: r["source_mark"] for r in got} == want


def test_a_large_file_makes_no_product(spark):
    """One file of 10,000 symbols, nested or side by side, and 100,000 calls."""
    n = spark.range(10_000)
    apart = n.select(F.lit("f").alias("file"), (F.col("id") * 10).cast("int").alias("start_line"), (F.col("id") * 10 + 8).cast("int").alias("end_line"), F.col("id").cast("int").alias("sym_seq"), F.col("id").cast("string").alias("id"))
    nested = apart.withColumns({"start_line": F.col("sym_seq"), "end_line": F.lit(19_999) - F.col("sym_seq")})
    one_line = apart.withColumns({"start_line": F.lit(3), "end_line": F.lit(3)})
    points = spark.range(100_000).select(F.lit("f").alias("file"), F.col("id").cast("int").alias("line"), "id")
    for symbols, inside in ((apart, 90_000), (nested, 20_000), (one_line, 1)):
        held = indexing.meet_spans(points, symbols, ("id",))
        assert held.count() < 20 * 100_000
        assert indexing.enclosing_symbol(points, symbols, ["file", "id"], ("id",)).filter("sym_id is not null").count() == inside
    # a file is dealt over its buckets, not to one task
    assert held.select("_bucket").distinct().count() > 1_000


def test_one_shuffle_of_points(spark):
    points = spark.range(1000).select(F.concat(F.lit("f"), F.col("id") % 7).alias("file"), F.col("id").cast("int").alias("line"), "id")
    symbols = spark.createDataFrame([("f", 0, 9, 0, "i", "n")], SYMBOL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = indexing.enclosing_symbol(points, symbols, ["file", "id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2
