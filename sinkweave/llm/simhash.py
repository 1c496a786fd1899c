"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits differ in at most 2 bits once the 16-bit block with the most
differing bits is set aside. So for each of the 4 views of 48 bits, every distinct fingerprint
emits all variants within half of that radius (1 bit, 49 variants with the view itself): two near
fingerprints meet at one variant at least. Rows are shuffled on (view, variant); collisions are
deduplicated and verified on all 64 bits.

Copies share a fingerprint and are folded before anything is emitted. Members of one variant that
also agree in the set-aside block are within 2 bits of each other and get a star of links; such
sub-groups are linked by hashing their set-aside blocks in the same way, so no pairs are listed and
large groups of near copies stay linear.

Defined results: null, empty or wordless texts have fingerprint zero and are linked like any other;
a repeated row gets the same result each time; rows without an id count as copies but cannot name a
component, and a component whose rows have no id at all has a null one; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinkweave.llm.common import LOWER, UPPER, bounded, cut, fresh
from sinkweave.llm.components import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCKS = 4
BLOCK_BITS = 16
#: Fingerprints whose variants one task emits.
PER_TASK = 10_000
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words_of(text: str | None) -> list[bytes]:
    """Words as split on ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def fingerprint_of(text: str | None) -> int:
    """The 64-bit fingerprint of one text."""
    words = words_of(text)
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounds memory on very long texts
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    return _printed(docs).select("doc_id", "fp")


def _printed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("_th"), F.pandas_udf(_fingerprint_batches, "long")("text").alias("fp"))


def _variants() -> Column:
    """(view, mask, flip) of all 4 x 49 variants, as literals: unrolled by Spark's code generation."""
    rows = []
    for view in range(BLOCKS):
        aside = ((1 << BLOCK_BITS) - 1) << (view * BLOCK_BITS)
        flips = [0] + [1 << b for b in range(64) if not aside >> b & 1]
        rows += [(view, _signed(~aside & (1 << 64) - 1), _signed(f)) for f in flips]
    return F.array(*[F.struct(F.lit(v).cast("tinyint").alias("view"), F.lit(m).cast("long").alias("mask"), F.lit(f).cast("long").alias("flip")) for v, m, f in rows])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame) -> DataFrame:
    """``fps(fp)``, distinct -> (a, b): links that connect exactly what the graph of all pairs
    within RADIUS bits connects. Every link is a verified pair; rows are linear in the fingerprints."""
    tasks = fps.count() // PER_TASK + 1
    emitted = fps.repartition(tasks).select("fp", F.explode(_variants()).alias("x")).select(
        F.col("x.view").alias("view"),
        F.col("fp").bitwiseAND(F.col("x.mask")).bitwiseXOR(F.col("x.flip")).alias("key"),
        "fp",
    )
    group = Window.partitionBy("view", "key")
    met = (
        emitted.withColumn("least", F.min("fp").over(group)).withColumn("most", F.max("fp").over(group))
        .filter("least <> most").drop("least", "most")
    )
    aside = F.expr(f"shiftright(fp, cast(view as int) * {BLOCK_BITS})").bitwiseAND((1 << BLOCK_BITS) - 1)
    mask = F.element_at(F.array(*[F.lit(_signed(~(((1 << BLOCK_BITS) - 1) << (v * BLOCK_BITS)) & (1 << 64) - 1)).cast("long") for v in range(BLOCKS)]), F.col("view") + 1)
    met = cut(met.withColumn("aside", aside.cast("int")).withColumn("centre", F.col("fp").bitwiseAND(mask) == F.col("key")), "simhash-met")
    sub = met.groupBy("view", "key", "aside").agg(F.min("fp").alias("m"), F.max(F.when(F.col("centre"), F.col("fp"))).alias("c"))
    star = met.join(sub.select("view", "key", "aside", "m"), ["view", "key", "aside"]).filter("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    several = sub.withColumn("n", F.count(F.lit(1)).over(group)).withColumn("centred", F.count("c").over(group) > 0).filter("n > 1")
    several = cut(several, "simhash-sub")
    near = _one_apart(several).unionByName(_around_centres(several)).unionByName(_between_centres(several))
    return star.unionByName(near).filter(_differ("a", "b") <= RADIUS).distinct()


#: Sub-groups of one variant are compared by the same hashing of their set-aside blocks, whose
#: distance is d. d = 1: any two members are within RADIUS. d = 2: if one of the two is the variant
#: itself, its centre. d = 3: if both are. Members of a bucket are linked to its smallest centre, so
#: rows are linear in the sub-groups, however many share a variant.
_BALL = {d: [sum(1 << b for b in bits) for bits in combinations(range(BLOCK_BITS), d)] for d in range(3)}


def _one_apart(sub: DataFrame) -> DataFrame:
    """Each sub-group with one bit cleared, bit by bit: a bucket holds the two that differ in it."""
    cleared = F.array(*[F.lit(x) for x in _BALL[1]])
    rows = sub.select("view", "key", "m", "aside", F.explode(cleared).alias("bit"))
    rows = rows.withColumn("aside", F.col("aside").bitwiseAND(F.bitwise_not("bit")))
    return rows.groupBy("view", "key", "bit", "aside").agg(F.min("m").alias("a"), F.max("m").alias("b")).filter("a <> b").select("a", "b")


def _around_centres(sub: DataFrame) -> DataFrame:
    """All within one bit of the same block are within two of each other."""
    ball = F.array(*[F.lit(x) for d in (0, 1) for x in _BALL[d]])
    rows = sub.filter("centred").select("view", "key", "m", "c", "aside", F.explode(ball).alias("x"))
    rows = rows.withColumn("aside", F.col("aside").bitwiseXOR(F.col("x"))).withColumn("hub", F.min("c").over(Window.partitionBy("view", "key", "aside")))
    both = F.array_compact(F.array("m", "c"))
    return rows.filter("hub is not null").select("hub", F.explode(both).alias("b")).filter("hub <> b").select(F.col("hub").alias("a"), "b")


def _between_centres(sub: DataFrame) -> DataFrame:
    """Of two blocks three bits apart, some block is within one bit of the one and two of the other."""
    ball = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(d < 2).alias("near")) for d in (0, 1, 2) for x in _BALL[d]])
    rows = sub.filter("c is not null").select("view", "key", "c", "aside", F.explode(ball).alias("e")).select("view", "key", "c", F.col("aside").bitwiseXOR(F.col("e.x")).alias("aside"), "e.near")
    hub = F.min(F.when(F.col("near"), F.col("c"))).over(Window.partitionBy("view", "key", "aside"))
    return rows.withColumn("hub", hub).filter("hub is not null and hub <> c").select(F.col("hub").alias("a"), F.col("c").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest reachable doc_id)."""
    prints, labels = _labelled(docs)
    return prints.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _th, fp) of every row, _th the hash of its text, and (fp, group, component_id) of every fingerprint."""
    prints = cut(_printed(docs), "simhash-fp")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comps = connected_components(links(classes.select("fp")))
    # a component's name is the smallest doc_id of its classes
    named = classes.join(comps, classes["fp"] == comps["id"]).select("fp", "first", "component")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labelled = cut(named.join(least, "component").select("fp", F.col("component").alias("group"), "component_id"), "simhash-components")
    alone = classes.join(labelled.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("group"), F.col("first").alias("component_id"))
    return prints, labelled.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, see ``one_of_each``."""
    prints, labels = _labelled(docs)
    return one_of_each(docs, prints.join(labels, "fp").select("group", "doc_id", "_th"))


def one_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """``grouped(group, doc_id, _th)``, _th the hash of the text -> the document of each group with the
    smallest id, and of that id with the smallest hash; one without an id only if the group has no
    other. Repeated rows of it are one document and fold into one row, the first by all its columns
    as JSON. An empty table gives no rows; further columns may have any names and types."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_th")).alias("best")
    drop, text = fresh(docs, "drop"), fresh(docs, "drop_th")
    chosen = grouped.groupBy("group").agg(best).select(F.col("best.doc_id").alias("id"), F.col("best._th").alias("th"))
    others = grouped.select("doc_id", "_th").distinct().join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")), "left_anti")
    # written and counted: while it is small, whole documents are not shuffled
    gone = cut(others.select(F.col("doc_id").alias(drop), F.col("_th").alias(text)), "gone")
    kept = docs.join(bounded(gone), F.col("doc_id").eqNullSafe(F.col(drop)) & (F.xxhash64("text") == F.col(text)), "left_anti")
    if grouped.groupBy("doc_id", "_th").count().filter("count > 1").isEmpty():
        return kept
    row = F.struct(*docs.columns)
    whole = F.min_by(row, F.to_json(row)).alias("row")
    return kept.groupBy("doc_id", F.xxhash64("text").alias(text)).agg(whole).select("row.*")
