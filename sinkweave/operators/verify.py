"""Chain verification data, findings and conversations (VER-1 to VER-5, CNV-1 to CNV-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinkweave.functions.text import basename, slice_lines, source_lines

VERDICTS = ("reachable", "undetermined", "unreachable")
UNAVAILABLE = "(source unavailable)"


def hop_sources(chains: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """VER-1. One row per hop with its numbered source: its symbol's lines, else four lines around its
    own. Only the files of hops are read; a file is split once, and lines that many hops share are cut once."""
    hops = chains.select("sink", "chain_seq", F.posexplode("hops").alias("place", "h")).select("sink", "chain_seq", "place", "h.*")
    spans = symbols.select(F.col("id").alias("symbol_id"), "start_line", "end_line")
    # the hop's line counts from 1 and is used here as if it counted from 0
    start, end = F.coalesce("start_line", F.greatest(F.lit(0), F.col("line") - 4)), F.coalesce("end_line", F.col("line") + 4)
    placed = hops.join(spans, "symbol_id", "left").select("sink", "chain_seq", "place", "name", "file", "line", start.alias("start"), end.alias("end"))
    wanted = placed.select("file", "start", "end").distinct()
    split = files.join(wanted.select("file").distinct(), "file", "left_semi").select("file", source_lines(F.col("content")).alias("lines"))
    cut_out = wanted.join(split, "file").select("file", "start", "end", slice_lines(F.col("lines"), F.col("start"), F.col("end")).alias("source"))
    return placed.join(cut_out, ["file", "start", "end"], "left").select("sink", "chain_seq", "place", "name", "file", "line", F.coalesce("source", F.lit(UNAVAILABLE)).alias("source"))


def verify_prompts(chains: DataFrame, hops: DataFrame) -> DataFrame:
    """VER-2. One prompt per chain: sink, source or entry, the numbered chain, the hops' sources."""
    listed = F.array_sort(F.collect_list(F.struct("place", "name", "file", "line", "source")))
    rows = hops.groupBy("sink", "chain_seq").agg(listed.alias("hs"))
    path = F.array_join(F.transform("hs", lambda h: F.concat(h["place"] + 1, F.lit(". "), h["name"], F.lit(" ("), h["file"], F.lit(":"), h["line"], F.lit(")"))), "\n")
    code = F.array_join(F.transform("hs", lambda h: F.concat(F.lit("### "), h["name"], F.lit(" "), h["file"], F.lit("\n"), h["source"])), "\n\n")
    start = F.coalesce(F.concat(F.lit("Source: "), "source_mark"), F.concat(F.lit("Entry: "), "reason"))
    return chains.join(rows, ["sink", "chain_seq"]).select("sink", "chain_seq", F.concat_ws("\n", F.concat(F.lit("Sink: "), "sink"), start, F.lit("Chain:"), path, F.lit("Sources:"), code, F.lit("Is the chain reachable? Answer with JSON.")).alias("prompt"))


def normalize_verdict(verdict: Column) -> Column:
    """VER-3."""
    return F.when(verdict.isin(*VERDICTS), verdict).otherwise("undetermined")


def build_findings(chains: DataFrame, replies: DataFrame, sinks: DataFrame, author: str, now: str) -> DataFrame:
    """VER-4. ``replies(sink, chain_seq, reply, verdict, analysis, hops)``: the model's hops if there are
    any, else the chain's without evidence; ids are hashes of sink and chain, so reruns agree."""
    own = F.transform("hops", lambda h: F.struct(h["file"].alias("file"), h["name"].alias("symbol"), h["line"].cast("long").alias("line"), F.lit("").alias("evidence")))
    told = F.transform("said_hops", lambda h: F.struct(F.coalesce(h["file"], F.lit("")).alias("file"), F.coalesce(h["symbol"], F.lit("")).alias("symbol"), F.coalesce(h["line"].cast("long"), F.lit(0).cast("long")).alias("line"), F.coalesce(h["evidence"], F.lit("")).alias("evidence")))
    verdict = normalize_verdict(F.col("verdict"))
    rows = chains.join(replies.withColumnRenamed("hops", "said_hops"), ["sink", "chain_seq"]).join(sinks.select(F.col("id").alias("sink"), "category", F.col("file").alias("sink_file"), F.col("line").alias("sink_line")), "sink")
    title = F.concat(F.coalesce("category", F.lit("sink")), F.lit(" @ "), basename(F.col("sink_file")), F.lit(":"), "sink_line", F.lit(" · "), verdict)
    return rows.select(
        F.sha1(F.concat_ws("|", "sink", F.array_join("key", ",")).cast("binary")).alias("id"), title.alias("title"), F.col("source_mark").alias("source_mark_id"), F.col("sink").alias("sink_mark_id"),
        F.when(F.size(F.coalesce("said_hops", F.expr("cast(array() as array<struct<file:string,symbol:string,line:int,evidence:string>>)"))) > 0, told).otherwise(own).alias("chain"),
        verdict.alias("verdict"), F.coalesce(F.when(F.col("analysis") != "", F.col("analysis")), F.substring("reply", 1, 500)).alias("analysis"), F.lit(author).alias("author"), F.lit(now).alias("time"))


def list_findings(findings: DataFrame) -> DataFrame:
    """VER-5. Reachable first, then undetermined, then unreachable; with the number of hops."""
    order = F.when(F.col("verdict") == "reachable", 0).when(F.col("verdict") == "undetermined", 1).otherwise(2)
    return findings.withColumn("n_hops", F.size("chain")).orderBy(order, "id")


def delete_findings(findings: DataFrame, ids: DataFrame) -> DataFrame:
    """VER-5. By id: gone."""
    return findings.join(ids.select("id"), "id", "left_anti")


def flatten_conversations(messages: DataFrame) -> DataFrame:
    """CNV-1. Per conversation ``system`` and ``prompt``: its turns in order, replies and tool results
    labelled, joined by blank lines."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    label = lambda m: F.concat(F.when(m["role"] == "assistant", "[assistant previous reply]\n").when(m["role"] == "tool", "[tool result]\n").otherwise(""), m["content"])
    return messages.groupBy("conv_id").agg(turns.alias("t")).select(
        "conv_id", F.array_join(F.transform(F.filter("t", lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n").alias("system"),
        F.array_join(F.transform(F.filter("t", lambda m: m["role"] != "system"), label), "\n\n").alias("prompt"))


def extract_text_parts(payload: Column) -> Column:
    """CNV-2. The text parts of a reply: of ``parts``, else of ``info.parts``, else ``info.content``."""
    part = "array<struct<type:string,text:string>>"
    r = F.from_json(payload, f"parts {part}, info struct<parts:{part},content:string>")

    def text(parts: Column) -> Column:
        return F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "")

    def blank(x: Column) -> Column:
        return F.when(x != "", x)

    return F.coalesce(blank(text(r["parts"])), blank(text(r["info"]["parts"])), r["info"]["content"], F.lit(""))


def split_model_id(model: Column) -> tuple[Column, Column]:
    """CNV-3. (provider, model) at the first slash; without one the provider is empty."""
    at = F.instr(model, "/")
    return F.when(at > 0, F.substring(model, F.lit(1), at - 1)).otherwise(""), F.when(at > 0, F.substring(model, at + 1, F.length(model))).otherwise(model)
