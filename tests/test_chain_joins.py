"""What the joins of chains and of their sources carry."""

from pyspark.sql import functions as F

from sinkweave.operators import chains, verify


def _tables(spark):
    symbols = spark.createDataFrame([("a.js#f@0", "f", "a.js", 0, 1), ("b.js#g@0", "g", "b.js", 0, 1), ("c.js#h@0", "h", "c.js", 0, 1)], "id string, name string, file string, start_line int, end_line int")
    calls = spark.createDataFrame([("f", s, f, k, 0, 0) for k, (s, f) in enumerate([("a.js#f@0", "a.js"), ("b.js#g@0", "b.js"), ("c.js#h@0", "c.js"), (None, "d.js")])], "callee string, from_symbol string, file string, file_seq long, call_seq long, line int")
    return symbols, calls, spark.createDataFrame([], "id string, source_mark string")


def test_callers_of_a_file_are_kept_where_the_name_is_defined(spark):
    symbols, calls, sources = _tables(spark)
    got = {r["scope"]: [c["c_id"] for c in r["callers"]] for r in chains.adjacency(chains.caller_edges(calls), symbols, sources, 9).collect()}
    assert got == {"": ["a.js#f@0", "b.js#g@0", "c.js#h@0", None], "=a.js": ["a.js#f@0"]}


def test_chains_without_callers_ask_for_names_only(spark):
    symbols, calls, sources = _tables(spark)
    anchored = spark.createDataFrame([("k1", "a.js", 1, "a.js#f@0", "f", "a.js"), ("k2", "b.js", 1, "b.js#g@0", "g", "b.js")], "id string, file string, line int, sym_id string, sym_name string, sym_file string")
    got = chains.expand_chains(anchored, calls.select("callee"), symbols, sources, max_depth=0)
    assert {r["sink"]: r["reason"] for r in got.collect()} == {"k1": "reached depth limit", "k2": "no callers (possible framework entry)"}


def test_lines_that_hops_share_are_cut_once(spark):
    symbols, _, _ = _tables(spark)
    hop = "array<struct<symbol_id:string,name:string,file:string,line:int>>"
    found = spark.createDataFrame([(f"k{k}", 1, [("a.js#f@0", "f", "a.js", 2), ("gone", "x", "a.js", 9), ("gone", "x", "z.js", 9)]) for k in range(3)], f"sink string, chain_seq int, hops {hop}")
    files = spark.createDataFrame([("a.js", "\n".join(f"l{k}" for k in range(20)))], "file string, content string")
    asked = spark.sparkContext.accumulator(0)

    def seen(text):
        asked.add(1)
        return text

    counted = verify.slice_lines
    try:
        verify.slice_lines = lambda lines, start, end: F.udf(seen, "string")(counted(lines, start, end))
        got = verify.hop_sources(found, symbols, files).collect()
    finally:
        verify.slice_lines = counted
    texts = {(r["file"], r["line"]): r["source"] for r in got}
    assert len(got) == 9 and texts["a.js", 2] == "    1| l0\n    2| l1" and texts["z.js", 9] == verify.UNAVAILABLE
    assert texts["a.js", 9].split("\n")[0] == "    6| l5" and len(texts["a.js", 9].split("\n")) == 9
    assert asked.value == 2
