"""Reverse call-chain search (CHN-1 to CHN-8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinkweave.functions.lineage import cut
from sinkweave.functions.text import basename
from sinkweave.operators.indexing import enclosing_symbol, first_inside

MAX_DEPTH, MAX_CALLERS, MAX_CHAINS = 8, 8, 20
#: Values that names are hashed to, where a file tells which it may define.
NAME_HASHES = 1024
#: Names that mark an entry function.
ENTRY_NAMES = ("main", "doGet", "doPost", "doPut", "doDelete", "doHead", "ServeHTTP")


def caller_edges(calls: DataFrame) -> DataFrame:
    """CHN-1. ``calls`` with from_symbol -> one row per called name and caller (a symbol, or a file's
    top level), with the 1-based line of its first call and the place that orders callers. Calls are dealt by
    caller, as ``adjacency`` meets them."""
    caller = F.coalesce(F.col("from_symbol"), F.concat(F.lit("__top__:"), F.col("file")))
    dealt = calls.select("callee", caller.alias("caller"), F.col("from_symbol").isNotNull().alias("inside"), "file_seq", "call_seq", "line", "file").repartition("caller")
    first = dealt.groupBy("callee", "caller", "inside").agg(F.min(F.struct("file_seq", "call_seq", "line", "file")).alias("f"))
    return first.select("callee", "caller", F.when(F.col("inside"), F.col("caller")).alias("from_symbol"), (F.col("f.line") + 1).alias("line"), F.col("f.file").alias("file"), F.struct("f.file_seq", "f.call_seq").alias("at"))


def anchor_sinks(sinks: DataFrame, symbols: DataFrame) -> DataFrame:
    """CHN-2. Sink marks with their enclosing symbol (``sym_*``, null outside functions)."""
    points = sinks.select("id", "file", (F.col("line") - 1).alias("line"))
    found = enclosing_symbol(points.withColumnRenamed("id", "mark_id"), symbols, ["mark_id"], ("id", "name", "file"))
    return sinks.join(found.withColumnRenamed("mark_id", "id"), "id", "left")


def symbols_with_source(symbols: DataFrame, marks: DataFrame) -> DataFrame:
    """CHN-3. (symbol id, source mark): the first source that is not excluded inside each symbol."""
    sources = marks.filter("kind = 'source' and status <> 'excluded'").select("file", (F.col("line") - 1).cast("long").alias("line"), F.col("id").alias("source_mark"), "mark_seq")
    return first_inside(symbols, sources, "id", "source_mark", ["mark_seq"])


def terminal_reason(name: Column, had_callers: Column) -> Column:
    """CHN-5."""
    return F.when(name.isin(*ENTRY_NAMES), F.concat(F.lit("entry function "), name)).when(had_callers, "reached depth limit").otherwise("no callers (possible framework entry)")


_HOP = "struct<symbol_id:string,name:string,file:string,line:int>"
_CALLER = "struct<c_id:string,c_name:string,c_file:string,src:string,c_line:int>"


def adjacency(edges: DataFrame, symbols: DataFrame, sources: DataFrame, enough: int) -> DataFrame:
    """The first ``enough`` callers of each name, as one row: of all files (``scope`` '') and of each file
    that has some ('=' and the file). A name is asked for in files that define it, so others are left out as
    far as a file's hashes of names tell. Hot names are cut on the map side, before they are gathered."""
    short = lambda name: F.pmod(F.hash(name), F.lit(NAME_HASHES)).cast("short")
    near = symbols.groupBy("file").agg(F.collect_set(short("name")).alias("near"))
    known = symbols.select(F.col("id").alias("caller"), F.col("name").alias("c_name"), F.col("file").alias("c_file")).join(sources.select(F.col("id").alias("caller"), F.col("source_mark").alias("src")), "caller", "left")
    known = known.join(near.withColumnRenamed("file", "c_file"), "c_file").withColumnRenamed("caller", "id")
    met = edges.join(known, (F.col("caller") == F.col("id")) & F.col("from_symbol").isNotNull(), "left")
    scopes = F.when(F.array_contains("near", short("callee")), F.array(F.lit(""), F.concat(F.lit("="), "c_file"))).otherwise(F.array(F.lit("")))
    rows = met.select("callee", F.explode(scopes).alias("scope"), "at", F.col("id").alias("c_id"), "c_name", "c_file", "src", F.col("line").cast("int").alias("c_line"))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("callee", "scope").orderBy("at"))).filter(F.col("_r") <= enough)
    listed = F.sort_array(F.collect_list(F.struct("_r", F.struct("c_id", "c_name", "c_file", "src", "c_line").alias("c"))))
    return cut(first.groupBy("callee", "scope").agg(listed.alias("l")).select("callee", "scope", F.transform("l", lambda x: x["c"]).alias("callers")), "chain-callers")


def expand_chains(anchored: DataFrame, edges: DataFrame, symbols: DataFrame, sources: DataFrame, max_depth: int = MAX_DEPTH, max_callers: int = MAX_CALLERS, max_chains: int = MAX_CHAINS) -> DataFrame:
    """CHN-4. All sinks at once, one level a round. A chain's ``key`` holds the callers' places from the
    sink on; chains are found in the order of their keys, and every open one ends in a chain at least,
    so keeping the first max_chains of a sink by key after each round loses none of the first.

    Only open chains enter a round: each knows how many finished ones of its sink come before it
    (``before``; what follows from it shares that number), so finished ones are written once and left.
    A name's callers are one row, met by name; no node needs more than its first max_callers +
    max_depth + 1 (a path blocks no more), from its own file and overall. A round is one look-up
    of the names that it reaches, for the own file and for all, and one window over its rows. The last
    round only asks which names are called at all."""
    none = F.lit(None).cast("string")
    if max_depth > 0:
        callers = adjacency(edges, symbols, sources, max_callers + max_depth + 1)
        called = callers.filter("scope = ''").select(F.col("callee").alias("name"), F.lit(True).alias("has"))
    else:
        called = edges.select(F.col("callee").alias("name")).distinct().withColumn("has", F.lit(True))
    top = F.struct(none.alias("symbol_id"), basename(F.col("file")).alias("name"), F.col("file").alias("file"), F.col("line").cast("int").alias("line"))
    first = F.struct(F.col("sym_id").alias("symbol_id"), F.col("sym_name").alias("name"), F.col("sym_file").alias("file"), F.col("line").cast("int").alias("line"))
    inside = F.col("sym_id").isNotNull()
    state = cut(anchored.select(
        F.col("id").alias("sink"), F.array().cast("array<int>").alias("key"), inside.alias("open"), F.array(F.when(inside, first).otherwise(top)).cast(f"array<{_HOP}>").alias("hops"),
        none.alias("source_mark"), F.when(~inside, "top-level code").alias("reason"), F.lit(0).cast("long").alias("before")), "chain-state")
    rounds = [state]
    for depth in range(max_depth + 1):
        live = state.filter("open").select("sink", "key", "hops", "before", F.col("hops")[0]["name"].alias("name"), F.col("hops")[0]["file"].alias("node_file"))
        if depth == max_depth:
            why = terminal_reason(F.col("name"), F.coalesce("has", F.lit(False)))
            met = live.join(called, "name", "left").select("sink", "key", "hops", "before", "node_file", F.lit(True).alias("ends"), why.alias("why"), F.lit(None).cast("int").alias("i"), F.lit(None).cast(_CALLER).alias("c"))
        else:
            # of a name's list no more is needed than a path of this length can block
            whole = callers.filter("scope = ''").select(F.col("callee").alias("name"), F.slice("callers", 1, max_callers + depth + 1).alias("all_"))
            inside = callers.filter("scope <> ''").select(F.col("callee").alias("name"), F.expr("substring(scope, 2)").alias("node_file"), F.col("callers").alias("own"))
            met = live.join(inside, ["name", "node_file"], "left").join(whole, "name", "left")
            others = F.filter("all_", lambda c: c["c_file"].isNull() | (c["c_file"] != F.col("node_file")))
            met = met.withColumn("known", F.concat(F.coalesce("own", F.expr("filter(all_, x -> false)")), others)).withColumn("path", F.transform("hops", lambda h: h["symbol_id"]))
            met = met.withColumn("free", F.filter("known", lambda c: c["c_id"].isNull() | ~F.array_contains("path", c["c_id"])))
            has = F.coalesce(F.size("known") > 0, F.lit(False))
            ends = ~has | (F.size("free") == 0)
            why = F.when(~has, terminal_reason(F.col("name"), has)).otherwise("chain cycles here")
            met = met.select("sink", "key", "hops", "before", "node_file", ends.alias("ends"), why.alias("why"), F.posexplode_outer(F.when(~ends, F.slice("free", 1, max_callers))).alias("i", "c"))
        on_top = F.col("c.c_id").isNull()
        label = F.struct(
            F.col("c.c_id").alias("symbol_id"), F.when(on_top, F.concat("node_file", F.lit(" (top level)"))).otherwise(F.col("c.c_name")).alias("name"),
            F.when(on_top, F.col("node_file")).otherwise(F.col("c.c_file")).alias("file"), F.col("c.c_line").alias("line"))
        grown = met.select(
            "sink", F.when(F.col("ends"), F.col("key")).otherwise(F.concat("key", F.array(F.col("i") + 1))).alias("key"), (~F.col("ends") & ~on_top & F.col("c.src").isNull()).alias("open"),
            F.when(F.col("ends"), F.col("hops")).otherwise(F.concat(F.array(label).cast(f"array<{_HOP}>"), F.col("hops"))).alias("hops"),
            F.when(~F.col("ends") & ~on_top, F.col("c.src")).alias("source_mark"), F.when(F.col("ends"), F.col("why")).when(on_top, "module top-level call").alias("reason"), "before")
        in_order = Window.partitionBy("sink").orderBy("key")
        done_before = F.count_if(~F.col("open")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
        kept = grown.withColumn("_nth", F.row_number().over(in_order) + F.col("before")).withColumn("before", F.col("before") + done_before).filter(F.col("_nth") <= max_chains).drop("_nth")
        state = cut(kept, "chain-state")
        rounds.append(state)
        if state.filter("open").isEmpty():
            break
    done = [r.filter("not open").select("sink", "key", "hops", "source_mark", "reason") for r in rounds]
    # later chains with smaller keys may have pushed finished ones beyond the limit
    nth = F.row_number().over(Window.partitionBy("sink").orderBy("key"))
    return score_chains(reduce(DataFrame.unionByName, done).withColumn("_nth", nth).filter(F.col("_nth") <= max_chains).drop("_nth"), max_chains)


def score_chains(chains: DataFrame, max_chains: int = MAX_CHAINS) -> DataFrame:
    """CHN-6. +100 for a source, +40 for any entry reason, + what is left of 20 after the hops (0 for
    code outside functions); ``chain_seq`` from 1 by score, then in the order found."""
    score = F.when(F.col("reason") == "top-level code", 0).otherwise(F.when(F.col("source_mark").isNotNull(), 100).otherwise(0) + F.when(F.col("reason").isNotNull(), 40).otherwise(0) + F.greatest(F.lit(0), 20 - F.size("hops")))
    order = Window.partitionBy("sink").orderBy(F.desc("score"), "key")
    return chains.withColumn("score", score).withColumn("chain_seq", F.row_number().over(order)).filter(F.col("chain_seq") <= max_chains)


def best_chain(chains: DataFrame) -> DataFrame:
    """CHN-7."""
    return chains.filter("chain_seq = 1")


def chain_labels(chains: DataFrame) -> DataFrame:
    """CHN-8. ``label``, ``n_hops``, ``detail`` and the whole path of names."""
    names = F.transform("hops", lambda h: h["name"])
    ends = F.concat(names[0], F.lit(" → … → "), F.element_at(names, -1))
    detail = F.coalesce("reason", F.lit("reaches Source"))
    return chains.select("sink", "chain_seq", "score", ends.alias("label"), F.size("hops").alias("n_hops"), detail.alias("detail"), F.array_join(names, " → ").alias("path"))
