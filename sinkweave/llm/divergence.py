"""Source divergence audit over deduplicated count columns.

Terms are grouped by their sparse vector of counts over a language's sources. Most terms are rare and
share their vector with others, so every pair of counts is evaluated once per distinct vector and
multiplied by the number of its terms; for the report the ranked vectors are opened again into
their terms.

A term that neither source of a pair has adds the same amount for all such terms, and one that only
one of them has adds an amount that depends on its count alone. So a pair's value is the amount of
absent terms times all terms, plus corrections from each source's histogram of counts, plus
corrections from the vectors in which both occur: work follows the counts above zero.

Tokens are counted in the readers and leave them as one row per language, source and term of a task, so
a hot source is summed before it is shuffled. Vectors are as long as a language has sources.

Defined results: null text, language or source is ''; texts without terms still make their group;
repeated rows count again; a language without kept terms has value 0 for each pair and no terms; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinkweave.llm.common import cut

LEAST_DOCS, TOP_TERMS = 10, 10
#: Terms that a task holds before it sends their counts on.
HELD_TERMS = 300_000
#: Texts that are taken out of an Arrow batch at a time.
AT_ONCE = 256
#: Bytes of terms, A-Z as a-z; all others are gaps.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_TERM_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            terms = [b"", *n]  # the empty term says that the group occurs
            rows = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, schema=_COUNTS)
        seen.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(at, AT_ONCE).columns), strict=True):
                n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
                words, before = terms_of(text), len(n)
                n.update(words)
                docs.update(set(words))
                held += len(n) - before
            if held > HELD_TERMS:
                yield from sent()
                held = 0
    yield from sent()


def _share(count: Column, total: Column) -> Column:
    """1 + floor(1000000000 * (count + 2) / total) for count + 2 <= total, in longs: three digits at a time,
    so that nothing overflows below 9 * 10^15 occurrences."""
    billion, rest = F.lit(0).cast("long"), count + 2
    for _ in range(3):
        wide = rest * 1000
        billion, rest = billion * 1000 + F.call_function("div", wide, total), wide % total
    return billion + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``docs(text, lang, source)`` -> per source of a language: its divergence from each other source
    (part ``pair``) and the terms that it has above its language's share (part ``term``)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").cast("binary").alias("text"))
    counted = read.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counted.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"), F.sum("docs").alias("docs"))
    terms = cut(terms.filter((F.col("docs") >= least_docs) | (F.length("term") == 0)).select("lang", F.col("term").cast("string").alias("term"), "vector"), "divergence-terms")
    kept, present = terms.filter("term <> ''"), terms.filter("term = ''")
    vectors = kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("m"), F.min("term").alias("first_term"))
    vectors = cut(vectors.withColumn("vid", F.monotonically_increasing_id()), "divergence-vectors")

    # totals of every group and language, also of those without kept terms
    entries = vectors.select("lang", "vid", "m", "first_term", F.inline("vector"))
    sums = entries.groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("n")).alias("s"))
    groups = present.select("lang", F.explode("vector.source").alias("source")).join(sums, ["lang", "source"], "left").fillna(0, ["s"])
    wide = vectors.groupBy("lang").agg(F.sum("m").alias("v"), F.sum(F.col("m") * F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("all"))
    groups = groups.join(wide, "lang", "left").fillna(0, ["v", "all"])
    total = F.col("s") + 2 * F.col("v")
    p0 = F.when(total > 0, _share(F.lit(0).cast("long"), total))
    groups = cut(groups.select("lang", "source", "v", total.alias("total"), (F.col("all") + 2 * F.col("v")).alias("lang_total"), p0.alias("p0")), "divergence-groups")

    met = entries.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total")))
    return _pairs(met, groups).unionByName(_terms(met, vectors, kept, top_terms))


def _pairs(met: DataFrame, groups: DataFrame) -> DataFrame:
    """Both directions of each pair of a language's sources, ranked."""
    one = groups.select("lang", F.col("source").alias("a"), F.col("v"), F.col("p0").alias("a0"))
    two = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    pairs = one.join(two, "lang").filter("a <> b")  # as many rows as the result has
    absent = pairs.filter("a < b").select("lang", "a", "b", F.when(F.col("v") > 0, F.col("v") * _apart(F.col("a0"), F.col("b0"))).otherwise(0).alias("value"))
    # terms that a has: their amount against none in b instead of none in both
    steps = met.groupBy("lang", F.col("source").alias("a"), "p").agg(F.sum("m").alias("m"))
    alone = steps.join(pairs, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("m") * (_apart(F.col("p"), F.col("b0")) - _apart(F.col("a0"), F.col("b0")))).alias("value"))
    alone = alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    # terms that both have: each distinct vector once
    row = met.groupBy("vid").agg(F.first("lang").alias("lang"), F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("x"))
    left = row.select("lang", "m", "x", F.posexplode("x").alias("i", "l"))
    both = left.select("lang", "m", "l", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("r"))
    p, p0, q, q0 = F.col("l.p"), F.col("l.p0"), F.col("r.p"), F.col("r.p0")
    more = F.col("m") * (_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0))
    both = both.select("lang", F.col("l.source").alias("a"), F.col("r.source").alias("b"), more.alias("value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    value = absent.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return value.select("lang", "value", ways).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", F.row_number().over(order))


def _terms(met: DataFrame, vectors: DataFrame, kept: DataFrame, top_terms: int) -> DataFrame:
    """The first terms of each source. A vector whose first term has top_terms better terms before it
    cannot add one, so as many vectors are enough for a source."""
    whole = vectors.select("vid", F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("all"), "vector")
    q = _share(F.col("all"), F.col("lang_total"))
    above = met.join(whole, "vid").withColumn("q", q).filter("p > q").withColumn("value", _apart(F.col("p"), F.col("q")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "first_term")
    above = above.select("lang", "source", "vector", "value", "first_term").withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= top_terms)
    chosen = cut(above.select("lang", "source", "vector", "value"), "divergence-chosen")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    opened = kept.withColumnRenamed("term", "item").join(chosen, ["lang", "vector"])
    return opened.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
