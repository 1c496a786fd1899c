"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest k-gram hashes of its sliding windows. With k-grams of K
words and windows of W k-grams, two texts that share K + W - 1 = 13 words in a row share the
fingerprint of that span and its place in it, so no shared span of 13 words is missed. Fingerprints
of documents and benchmark items are joined; each hit names a diagonal (document place minus item
place), and the words along the diagonal are compared to find the windows that really occur.
Items of fewer than 13 words are one window: their whole word sequence, found by its hash.

Defined results: a null or wordless text has no words and no hits; items without words, and null
items, never occur; a repeated item counts once by its id (a null id is written ``null``); a
repeated document row gets the same result each time; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinkweave.llm.common import WORD, cut, fresh, let, lower_ascii

SPAN = 13
K = 7
W = SPAN - K + 1
#: Low bits of a fingerprint hold the place, the others the hash.
PLACE_BITS = 30
PLACE = (1 << PLACE_BITS) - 1
#: Marks the row of a text with its number of words.
COUNT = -1
#: Up to so many fingerprints of the benchmark are broadcast (24 bytes each); beyond, Spark shuffles.
BROADCAST_ROWS = 1_000_000
#: Up to so many bytes of items' words are broadcast.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(hashes: Column, k: int) -> Column:
    """Hash of each k words in a row, with the place of the first in the low bits."""
    return F.transform(
        F.sequence(F.lit(0), F.size(hashes) - k),
        lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]).bitwiseAND(~PLACE).bitwiseOR(i.cast("long")),
    )


def fingerprints(tokens: Column) -> Column:
    """Winnowed fingerprints of a word array; empty for fewer than 13 words."""
    winnowed = let(
        F.transform(tokens, lambda w: F.xxhash64(w)),
        lambda h: let(
            _grams(h, K),
            lambda g: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - W + 1), lambda i: F.array_min(F.slice(g, i, W)))),
        ),
    )
    return F.when(F.size(tokens) >= SPAN, winnowed).otherwise(F.array().cast("array<bigint>"))


def whole_grams(tokens: Column, length: int) -> Column:
    """Hashes of all sequences of ``length`` words; for items shorter than a window."""
    grams = let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: _grams(h, length))
    return F.when(F.size(tokens) >= length, grams).otherwise(F.array().cast("array<bigint>"))


def _exploded(df: DataFrame, tokens: Column, short: list[int], keep: list[str], counted: bool = False) -> DataFrame:
    """One row per fingerprint: n (0: winnowed, else the length of short items), fp, place; if ``counted``
    one more per text, n COUNT and place its number of words. All come from one reading of a text."""

    def marked(n: int, packed: Column) -> Column:
        return F.transform(packed, lambda p: F.struct(F.lit(n).alias("n"), p.alias("p")))

    count = marked(COUNT, F.array(F.size(tokens).cast("long")))
    every = F.concat(*[count] * counted, marked(0, fingerprints(tokens)), *[marked(m, whole_grams(tokens, m)) for m in short])
    return df.select(*keep, F.explode(every).alias("_x")).select(*keep, "_x.n", F.shiftright("_x.p", PLACE_BITS).alias("fp"), F.col("_x.p").bitwiseAND(PLACE).cast("int").alias("place"))


def _item_table(benchmark: DataFrame) -> DataFrame:
    return (
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("iw"))
        .filter(F.size("iw") > 0)
        .distinct()
        .withColumn("ik", F.xxhash64("item", "iw"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _judged(docs, benchmark).drop("_th")


def _judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``contamination`` with ``_th``, the hash of the text: an id alone names no row."""
    spark = docs.sparkSession
    items = cut(_item_table(benchmark), "bench-items")
    short = sorted(r["m"] for r in items.select(F.size("iw").alias("m")).filter(F.col("m") < SPAN).distinct().collect())  # 12 lengths at most
    # an item of m words has whole sequences of m words only
    marks = _exploded(items, F.col("iw"), short, ["ik", "iw"]).filter((F.col("n") == 0) | (F.col("n") == F.size("iw"))).drop("iw")
    marks = cut(marks.withColumnRenamed("place", "iplace"), "bench-fingerprints")
    size = items.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.array_join("iw", " "))).alias("bytes")).first()
    small = marks.count() <= BROADCAST_ROWS and (size["bytes"] or 0) + 64 * size["rows"] <= BROADCAST_BYTES

    def bounded(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), "text")
    tokens = keyed.select("_id", "_th", words(F.col("text")).alias("w"))
    # one reading of the texts: a row of each document with its number of words, and its fingerprints that items have
    found = _exploded(tokens, F.col("w"), short, ["_id", "_th"], counted=True).join(bounded(marks), ["n", "fp"], "left")
    found = found.filter(F.col("ik").isNotNull() | (F.col("n") == COUNT))
    found = cut(found.select("_id", "_th", "ik", "place", "iplace"), "bench-found")
    diagonals = (
        found.filter("ik is not null")
        .select("_id", "_th", "ik", (F.col("place") - F.col("iplace")).alias("shift"))
        .distinct()
        .groupBy("_id", "_th")
        .agg(F.collect_set(F.struct("ik", "shift")).alias("cands"))
    )
    diagonals = cut(diagonals, "bench-diagonals")
    hits = cut(_extend(keyed, diagonals, items, bounded), "bench-hits")
    base = found.filter("ik is null").select(F.col("_id").alias("doc_id"), "_th", F.col("place").cast("long").alias("n_words"))
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (base["_th"] == hits["_th"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", base["_th"], "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("ids").cast("long"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _extend(keyed: DataFrame, diagonals: DataFrame, items: DataFrame, bounded) -> DataFrame:
    """Extends every candidate diagonal: which windows of the item occur, which words they cover.

    Only documents with a candidate are read again; of those, only the words beside an item."""
    texts = (
        keyed.alias("k")
        .join(diagonals.alias("d"), F.col("k._id").eqNullSafe(F.col("d._id")) & (F.col("k._th") == F.col("d._th")))
        .select("k._id", "k._th", "text", "cands")
        .dropDuplicates(["_id", "_th"])
    )
    lengths = items.select("ik", F.size("iw").alias("m"), "iw", "item")
    pieces = (
        texts.select("_id", "_th", words(F.col("text")).alias("w"), F.explode("cands").alias("c"))
        .select("_id", "_th", F.col("c.ik").alias("ik"), F.col("c.shift").alias("shift"), "w")
        .join(bounded(lengths), "ik")
        # the document's words beside the item's: from max(shift, 0), and the item's from max(-shift, 0)
        .withColumn("d0", F.greatest("shift", F.lit(0)))
        .withColumn("i0", F.greatest(-F.col("shift"), F.lit(0)))
        .withColumn("run", F.least(F.size("w") - F.col("d0"), F.col("m") - F.col("i0")))
        .withColumn("span", F.least(F.col("m"), F.lit(SPAN)))
        .filter(F.col("run") >= F.col("span"))
        .select("_id", "_th", "item", "d0", "run", "span", F.slice("w", F.col("d0") + 1, F.col("run")).alias("dw"), F.slice("iw", F.col("i0") + 1, F.col("run")).alias("iw"))
    )
    starts = F.filter(
        F.sequence(F.lit(0), F.col("run") - F.col("span")),
        lambda i: F.slice("dw", i + 1, F.col("span")) == F.slice("iw", i + 1, F.col("span")),
    )
    return (
        pieces.select("_id", "_th", "item", "d0", "span", F.explode(starts).alias("i"))
        .select("_id", "_th", "item", F.explode(F.sequence(F.col("d0") + F.col("i"), F.col("d0") + F.col("i") + F.col("span") - 1)).alias("place"))
        .distinct()
        .groupBy("_id", "_th")
        .agg(F.count_distinct("place").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("ids"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever their names and types.
    A row goes by its id and its text, so that rows without an id, and others of the same id, are
    judged on their own; repeated rows stay or go together; an empty table gives no rows."""
    bad_id, bad_text = fresh(docs, "bad"), fresh(docs, "bad_th")
    bad = _judged(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias(bad_id), F.col("_th").alias(bad_text)).distinct()
    bad = cut(bad, "contaminated")  # its size is known now: while it is small, whole documents are not shuffled
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_text)), "left_anti")
