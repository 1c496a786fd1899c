"""Source/sink rule scan and the life of its marks (TNT-2 to TNT-12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinkweave.operators.indexing import enclosing_symbol
from sinkweave.operators.rules import RULES, compile_calls, compile_patterns, java_pattern, literal_of

ANCHOR_CHARS = 40
_SPACE = r"[\s\x{A0}\x{FEFF}]+"
_HIT = ["file_seq", "file", "line", "kind", "category", "cwe", "rule_id", "anchor"]


def mark_id(kind: Column, file: Column, line: Column) -> Column:
    return F.concat_ws(":", kind, file, line.cast("string"))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}|{_SPACE}$", "")


def scan_calls(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """TNT-2. ``calls`` with language_id -> one hit per call whose callee a rule of its language names:
    that of the first such rule. The rule table is a few hundred rows and is broadcast."""
    named = compile_calls(rules).withColumnRenamed("languages", "_allowed")
    hits = calls.join(F.broadcast(named), "callee").filter(F.col("_allowed").isNull() | F.array_contains("_allowed", F.col("language_id")))
    rule = F.min_by(F.struct("kind", "category", "cwe", "rule_id"), "rule_seq").alias("r")
    return (
        hits.groupBy("file_seq", "file", "call_seq", "line", "callee").agg(rule)
        .select("file_seq", "file", (F.col("line") + 1).alias("line"), "r.*", F.concat("callee", F.lit("()")).alias("anchor"), F.struct(F.lit(0).alias("phase"), F.col("call_seq").cast("long").alias("a"), F.lit(0).alias("b")).alias("order"))
        .select(*_HIT, "order")
    )


def scan_lines(lines: DataFrame, rules=RULES) -> DataFrame:
    """TNT-3. ``lines(file_seq, file, language_id, line (0-based), text)`` -> one hit per line and
    pattern of its language. No shuffle and no higher-order functions: patterns are literals in one
    branch per language, and a regular expression is tried only on lines that hold its longest
    certain text. Hits carry a pattern's number; the table of patterns, one row each, is broadcast."""
    table = [(rule_seq * 100 + k, r[1], r[2], r[3], r[0], f"({java_pattern(p)})", r[4], literal_of(p)) for rule_seq, k, r, p in compile_patterns(rules)]
    spark, text, lang = lines.sparkSession, F.col("text"), F.col("language_id")
    known = spark.createDataFrame([t[:5] for t in table], "_n int, kind string, category string, cwe string, rule_id string")
    none = F.lit(None).cast("struct<n:int,hit:string>")

    def holds(literal: str) -> Column:
        return F.contains(text, F.lit(literal)) if literal else F.lit(True)

    def numbers(own: list[tuple]) -> Column:
        """The numbers of the patterns that a line has, with what they match, among nulls. Each pattern is a
        literal where it matches, so none is compiled again for a row."""
        return F.array(none, *[F.when(holds(t[7]) & text.rlike(t[5]), F.struct(F.lit(t[0]).alias("n"), F.regexp_extract(text, t[5], 1).alias("hit"))) for t in own])

    # a filter goes below the column of the language, so it must not depend on it
    gate = reduce(lambda x, y: x | y, [holds(x) for x in sorted({t[7] for t in table})], F.lit(False))
    # each language has its own rules and those of all languages; other lines only the latter
    hits = numbers([t for t in table if not t[6]])
    for name in sorted({x for t in table for x in (t[6] or ())}):
        hits = F.when(lang == name, numbers([t for t in table if not t[6] or name in t[6]])).otherwise(hits)
    found = lines.filter(gate).select("file_seq", "file", "line", F.explode(hits).alias("_h")).filter("_h is not null").select("file_seq", "file", "line", F.col("_h.n").alias("_n"), F.col("_h.hit").alias("_hit"))
    return found.join(F.broadcast(known), "_n").select(
        "file_seq", "file", (F.col("line") + 1).alias("line"), "kind", "category", "cwe", "rule_id", F.substring(_trim(F.col("_hit")), 1, ANCHOR_CHARS).alias("anchor"),
        F.struct(F.lit(1).alias("phase"), F.col("line").cast("long").alias("a"), F.col("_n").alias("b")).alias("order"))


def dedup_marks(hits: DataFrame) -> DataFrame:
    """TNT-4. One mark per (kind, file, line): calls before lines, then call order, then rule order."""
    best = F.min_by(F.struct("category", "cwe", "rule_id", "anchor"), "order").alias("h")
    return hits.groupBy("file_seq", "file", "kind", "line").agg(best).select("file_seq", "file", "kind", "line", "h.*")


def scan_ids(lines: DataFrame, calls: DataFrame, rule_rows: DataFrame, rules=RULES) -> DataFrame:
    """The marks of ``scan_taint`` as (id, status, origin), which no symbol changes."""
    marks = dedup_marks(scan_calls(calls, rule_rows).unionByName(scan_lines(lines, rules)))
    return marks.select(mark_id(F.col("kind"), F.col("file"), F.col("line")).alias("id"), F.lit("candidate").alias("status"), F.lit("scan").alias("origin"))


def scan_taint(lines: DataFrame, calls: DataFrame, symbols: DataFrame, rule_rows: DataFrame, rules=RULES, now: str = "") -> DataFrame:
    """TNT-5. Calls and lines scanned, deduplicated, and anchored to their enclosing symbols."""
    marks = dedup_marks(scan_calls(calls, rule_rows).unionByName(scan_lines(lines, rules)))
    # a mark is its own key, so that its columns pass through and nothing is scanned twice
    named = enclosing_symbol(marks.withColumn("line", F.col("line") - 1), symbols, marks.columns, ("name",)).withColumn("line", F.col("line") + 1)
    return named.withColumnRenamed("sym_name", "symbol").select(
        mark_id(F.col("kind"), F.col("file"), F.col("line")).alias("id"), "kind", F.lit("candidate").alias("status"), F.lit("scan").alias("origin"),
        "file", "symbol", "line", "anchor", "category", "cwe", "rule_id", F.lit("").alias("author"), F.lit(now).alias("time"))


def merge_candidates(existing: DataFrame, scanned: DataFrame) -> DataFrame:
    """TNT-6. Decided or manual marks stay, candidates stay if matched again (as they were), new ones
    come in. Ids are unique on either side, which meet in one full join, so each is read once."""
    names = [*existing.columns, *[c for c in scanned.columns if c not in existing.columns]]

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", F.struct(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names if c != "id"]).alias(name))

    old, new = packed(existing, "_old"), packed(scanned, "_new")
    stays = F.col("_old").isNull() | (F.col("_old.origin") == "manual") | (F.col("_old.status") != "candidate") | F.col("_new").isNotNull()
    both = old.join(new, "id", "full").filter(stays)
    return both.select(*[F.col("id") if c == "id" else F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c) for c in names])


def apply_manual_marks(existing: DataFrame, manual: DataFrame) -> DataFrame:
    """TNT-7. ``manual(kind, file, line, symbol, anchor, author, time)`` confirms or adds marks; symbol
    and anchor fall back to the prior mark's, its category, cwe, rule and note stay."""
    prior = existing.select("id", *[F.col(c).alias(f"_{c}") for c in ("symbol", "anchor", "category", "cwe", "rule_id", "note")])
    made = manual.withColumn("id", mark_id(F.col("kind"), F.col("file"), F.col("line"))).join(prior, "id", "left").select(
        "id", "kind", F.lit("confirmed").alias("status"), F.lit("manual").alias("origin"), "file", F.coalesce("symbol", "_symbol").alias("symbol"), "line",
        F.coalesce("anchor", "_anchor").alias("anchor"), F.col("_category").alias("category"), F.col("_cwe").alias("cwe"), F.col("_rule_id").alias("rule_id"), F.col("_note").alias("note"), "author", "time")
    return upsert_marks(existing, made)


def apply_status(existing: DataFrame, actions: DataFrame) -> DataFrame:
    """TNT-8. ``actions(id, action, author, ts, seq)``: the last of confirm, exclude and restore sets the
    status; author and time come from the last confirm. Unknown ids are ignored, origin stays."""
    at = F.struct("ts", "seq")
    folded = actions.filter(F.col("action").isin("confirm", "exclude", "restore")).groupBy("id").agg(
        F.max_by("action", at).alias("_action"),
        F.max_by(F.when(F.col("action") == "confirm", F.struct("author", "ts")), F.when(F.col("action") == "confirm", at)).alias("_by"))
    status = F.when(F.col("_action") == "confirm", "confirmed").when(F.col("_action") == "exclude", "excluded").when(F.col("_action") == "restore", "candidate").otherwise(F.col("status"))
    out = existing.join(folded, "id", "left").withColumn("status", status)
    author = F.coalesce("_by.author", "author") if "author" in existing.columns else F.col("_by.author")
    time = F.coalesce(F.col("_by.ts").cast("string"), F.col("time")) if "time" in existing.columns else F.col("_by.ts").cast("string")
    return out.withColumn("author", author).withColumn("time", time).drop("_action", "_by")


def upsert_marks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """TNT-9. By id: replaced or added."""
    return existing.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def delete_marks(existing: DataFrame, ids: DataFrame) -> DataFrame:
    """TNT-9. By id: gone."""
    return existing.join(ids.select("id"), "id", "left_anti")


def marks_by_file(marks: DataFrame) -> DataFrame:
    """TNT-10. Per file: counts, and its marks by line, then confirmed, candidate, excluded; files by path."""
    order = F.when(F.col("status") == "confirmed", 0).when(F.col("status") == "candidate", 1).otherwise(2)
    listed = F.array_sort(F.collect_list(F.struct("line", order.alias("o"), "id")))
    return marks.groupBy("file").agg(
        F.count_if(F.col("kind") == "sink").alias("n_sinks"), F.count_if(F.col("kind") == "source").alias("n_sources"),
        F.count_if(F.col("status") == "confirmed").alias("n_confirmed"), F.array_join(F.transform(listed, lambda m: m["id"]), ",").alias("marks")).orderBy("file")


def active_marks(marks: DataFrame, files: DataFrame) -> DataFrame:
    """TNT-11. Marks that are not excluded, their line clamped to the file's length."""
    held = marks.filter("status <> 'excluded'").join(files.select("file", "lines"), "file")
    return held.withColumn("line", F.least(F.greatest("line", F.lit(1)), "lines")).drop("lines")


def scan_summary(scanned: DataFrame, merged: DataFrame) -> DataFrame:
    """TNT-12. One row: marks matched, and those that are still candidates after the merge."""
    still = merged.join(scanned.select("id"), "id", "left_semi").agg(F.count_if(F.col("status") == "candidate").alias("n_candidates"))
    return scanned.agg(F.count(F.lit(1)).alias("n_matched")).crossJoin(still)  # two one-row counts
