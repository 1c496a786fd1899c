"""Near copies by SimHash: sets of five-word shingles of Jaccard similarity 0.8 or more.

Each distinct set gets a SimHash of 2048 bits; 13 pieces of 18 bits are its views. As in
``simhash.py``, a set emits every view with all variants within one bit, so two sets meet at a
variant if they are within two bits in a view. Bits of sets of similarity 0.8 differ with probability
acos(8 / 9) / pi = 0.1515, so they meet in one of 13 views with probability 0.9998. Pairs that meet
go on if at most NEAR_BITS of the first 128 bits and SHARP_BITS of all differ (0.9999 each), and are
then compared on the whole sets: every link is a verified pair. Sets of up to FEW shingles, whose bits
are coarse, also meet by their smallest hashes, of which two of similarity 0.8 share one for certain.

Texts with one set are one class and are folded before anything is emitted. Where many sets share
views as they are, as large groups of near copies do, these crowded sets are first linked, in each
view, to a central one and to their nearest one. Then they emit all variants with the whole SimHash,
and all pairs that meet and are not yet connected are compared, so a group that hangs together stays
linear and no pair that meets is left out.

Defined results: words are split on ASCII white space, A-Z lower-cased; a text of fewer than five
words is one shingle; null, empty and wordless texts are copies of each other; an empty table gives
no rows; other columns may have any names and types.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinkweave.llm.common import bounded, cut
from sinkweave.llm.components import connected_components
from sinkweave.llm.simhash import SEED, one_of_each, words_of

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
SIMILARITY = (4, 5)
#: 64-bit words of a fingerprint, and its views.
WORDS = 32
VIEWS, VIEW_BITS = 13, 18
#: Most differing bits of the first two words and of all.
NEAR_BITS, SHARP_BITS = 34, 374
#: Sets are crowded that share views with so many others, beside what chance brings, over all views.
CROWD = 3
#: Sets of up to so many shingles also meet by their smallest hashes.
FEW = 20
#: Members of a bucket up to which the nearest is looked for among all; in larger ones, beside in order of the first word.
LARGE = 4096
#: Rows that a task looks at together, whole buckets always.
AT_ONCE = 100_000
_RNG = np.random.default_rng(SEED)
_TIMES, _MIX = (_RNG.integers(0, 1 << 64, size=WORDS, dtype=np.uint64) | np.uint64(1) for _ in range(2))
_LANES = np.uint64(0x0101010101010101)


def shingles_of(text: str | None) -> np.ndarray:
    """The hashes of the distinct shingles of a text, in order."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    shingles = {b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))}
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64, count=len(shingles)))


def print_of(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles, WORDS words: bits set in over half the hashes, the first word's
    of the hashes themselves, the others' of the hashes mixed."""
    ones = np.zeros((WORDS, 8, 8), dtype=np.int64)
    for at in range(0, len(hashes), 4080):  # bounds memory on very long texts
        mixed = hashes[at : at + 4080, None] * _TIMES
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        mixed ^= mixed >> np.uint64(29)
        mixed[:, 0] = hashes[at : at + 4080]
        starts = np.arange(0, len(mixed), 255)
        for bit in range(8):  # eight counters to a word, of up to 255 each
            lanes = np.add.reduceat((mixed >> np.uint64(bit)) & _LANES, starts, axis=0)
            ones[:, :, bit] += lanes.view(np.uint8).reshape(-1, WORDS, 8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones.reshape(-1) > len(hashes), bitorder="little").view("<u8")


def mark_of(hashes: np.ndarray) -> tuple[int, int, list[int], list[int]]:
    """(class, size, fingerprint, smallest hashes of a small set); an empty set has class 0 and no fingerprint."""
    n = len(hashes)
    if not n:
        return 0, 0, [], []
    least, of = SIMILARITY
    few = hashes[: n - -(-least * n // of) + 1].view(np.int64).tolist() if n <= FEW else []
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)), n, print_of(hashes).view(np.int64).tolist(), few


def _mark_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([mark_of(shingles_of(t)) for t in texts], columns=["cls", "n", "words", "few"])


def _set_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([shingles_of(t).view(np.int64) for t in texts], dtype=object)


def _view(k: int) -> Column:
    word, at = divmod(k * VIEW_BITS, 64)
    piece = F.shiftrightunsigned(F.col("words")[word], at)
    if at + VIEW_BITS > 64:
        piece = piece.bitwiseOR(F.shiftleft(F.col("words")[word + 1], 64 - at))
    return piece.bitwiseAND((1 << VIEW_BITS) - 1).bitwiseOR(F.lit(k << VIEW_BITS).cast("long"))


def _views() -> Column:
    return F.array(*[_view(k) for k in range(VIEWS)])


def crowded(classes: DataFrame) -> DataFrame:
    """``classes(cls, words)`` -> (cls): those that share many views with others, more than chance brings."""
    chance = 2 * VIEWS * classes.count() // (1 << VIEW_BITS)
    views = classes.select("cls", F.explode(_views()).alias("bucket"))
    shared = views.withColumn("others", F.count(F.lit(1)).over(Window.partitionBy("bucket")) - 1)
    return shared.groupBy("cls").agg(F.sum("others").alias("others")).filter(F.col("others") > CROWD + chance).select("cls")


def emitted(classes: DataFrame, keep: list[Column], variants: bool = True) -> DataFrame:
    """``classes(cls, words, few)`` -> (bucket, flip, cls, ``keep``): all views, with the variants within
    one bit, ``flip`` the bit, and the smallest hashes of small sets."""
    kept = classes.select("cls", *keep, _views().alias("views"), "few")
    own = ["cls", *kept.columns[1:-2]]
    flips = F.array(*[F.lit(f) for f in [0] + [1 << b for b in range(VIEW_BITS if variants else 0)]])
    views = kept.select(*own, F.explode("views").alias("view")).select(*own, "view", F.explode(flips).alias("flip"))
    views = views.select(F.col("view").bitwiseXOR(F.col("flip").cast("long")).alias("bucket"), "flip", *own)
    few = kept.select(F.explode("few").alias("bucket"), F.lit(0).alias("flip"), *own)
    return views.unionByName(few).repartition("bucket").sortWithinPartitions("bucket")


def _here(bucket, flip, i, j):
    """Whether the bucket is the one of its view where rows i and j count as a pair."""
    other = flip[i] ^ flip[j]
    return np.where(other == 0, flip[i] == 0, (bucket[i] ^ other) > bucket[i])


def _by_hash(bucket):
    return (bucket < 0) | (bucket >= VIEWS << VIEW_BITS)


def _all_pairs(bucket, flip, cls, crowd, one, two) -> Iterator[tuple]:
    """All near pairs but those of two crowded sets, by the distance of their rows."""
    i, off = np.arange(len(bucket)), 0
    while len(i):
        off += 1
        i = i[i + off < len(bucket)]
        i = i[bucket[i] == bucket[i + off]]
        j = i + off
        near = _by_hash(bucket[i]) | (np.bitwise_count(one[i] ^ one[j]).astype(np.int64) + np.bitwise_count(two[i] ^ two[j]) <= NEAR_BITS)
        good = near & ((crowd[i] & crowd[j]) == 0) & _here(bucket, flip, i, j)
        yield cls[i[good]], cls[j[good]]


def _stars(bucket, cls, one) -> Iterator[tuple]:
    """Members of a bucket with a central one, the nearest to what most bits say, and with their nearest one."""
    for s, n in _buckets(bucket):
        c, w = cls[s : s + n], one[s : s + n]
        ones = np.unpackbits(w.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        centre = c[np.bitwise_count(w ^ np.packbits(2 * ones > n).view(np.uint64)[0]).argmin()]
        yield c, np.full(n, centre)
        if n > LARGE:
            order = np.argsort(w)
            yield c[order[1:]], c[order[:-1]]
            continue
        for at in range(0, n, 256):
            far = np.bitwise_count(w[at : at + 256, None] ^ w[None, :])
            far[np.arange(len(far)), np.arange(at, at + len(far))] = 99
            yield c[at : at + 256], c[far.argmin(axis=1)]


def _apart(bucket, flip, cls, group, words) -> Iterator[tuple]:
    """All pairs that are in different groups and near by the whole SimHash, each in the first view where it
    meets; of a bucket's largest group only those with others."""
    views = np.stack([_view_of(words, k) for k in range(VIEWS)])
    for s, n in _buckets(bucket):
        g = group[s : s + n]
        names, size = np.unique(g, return_counts=True)
        if len(names) == 1:
            continue
        by_hash, rest = bool(_by_hash(bucket[s])), np.flatnonzero(g != names[size.argmax()])
        first = 0 if by_hash else int(bucket[s]) >> VIEW_BITS
        rows = np.arange(n)
        for at in range(0, len(rest), step := max(1, (1 << 18) // n)):
            a, b = np.nonzero((g[rest[at : at + step], None] != g[None, :]) & _here(bucket[s : s + n], flip[s : s + n], rest[at : at + step, None], rows[None, :]))
            a, b = rest[at : at + step][a] + s, b + s
            for k in range(0 if by_hash else first):
                met = np.bitwise_count(views[k, a] ^ views[k, b]) <= 2
                a, b = a[~met], b[~met]
            for k in range(0, len(a), 1 << 16):
                x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                near = by_hash | (np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= SHARP_BITS)
                yield cls[x[near]], cls[y[near]]


def _view_of(words: np.ndarray, k: int) -> np.ndarray:
    word, at = divmod(k * VIEW_BITS, 64)
    piece = words[:, word] >> np.uint64(at)
    if at + VIEW_BITS > 64:
        piece = piece | (words[:, word + 1] << np.uint64(64 - at))
    return piece & np.uint64((1 << VIEW_BITS) - 1)


def _buckets(bucket) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of two or more rows."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[starts, len(bucket)])
    yield from zip(starts[size > 1].tolist(), size[size > 1].tolist())


def _column(c: pa.ChunkedArray) -> np.ndarray:
    c = c.combine_chunks()
    if pa.types.is_list(c.type):
        return c.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
    return c.to_numpy().astype(np.int64, copy=False)


def _task(kind: str):
    """Pairs of whole buckets, whose rows stand together."""

    def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        c = {name: _column(t[name]) for name in t.column_names}
        if kind == "all":
            found = _all_pairs(c["bucket"], c["flip"], c["cls"], c["crowd"], c["one"].view(np.uint64), c["two"].view(np.uint64))
        elif kind == "stars":
            found = _stars(c["bucket"], c["cls"], c["one"].view(np.uint64))
        else:
            found = _apart(c["bucket"], c["flip"], c["cls"], c["component"], c["words"])
        for a, b in found:
            ok = a != b
            if ok.any():
                yield pa.record_batch([np.minimum(a, b)[ok], np.maximum(a, b)[ok]], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not len(batch):
                continue
            last = batch.column(0)[-1].as_py()
            if rows >= AT_ONCE and last != held[-1].column(0)[-1].as_py():
                # what stands before the last bucket is whole
                ends = int(np.searchsorted(batch.column(0).to_numpy(), last))
                yield from pairs([*held, batch.slice(0, ends)])
                held, rows, batch = [], 0, batch.slice(ends)
            held.append(batch)
            rows += len(batch)
        if rows:
            yield from pairs(held)

    return run


def _paired(rows: DataFrame, kind: str) -> DataFrame:
    return rows.mapInArrow(_task(kind), "a long, b long").distinct()


def close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` to compare on whole sets: by their sizes and the whole SimHash."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("words").alias(f"w{c}"))
    least, of = SIMILARITY
    far = sum((F.bit_count(F.col("wa")[k].bitwiseXOR(F.col("wb")[k])) for k in range(WORDS)), F.lit(0))
    good = (of * F.least("na", "nb") >= least * F.greatest("na", "nb")) & ((far <= SHARP_BITS) | (F.greatest("na", "nb") <= FEW))
    return cut(cut(pairs, "resemblance-near").join(side("a"), "a").join(side("b"), "b").filter(good).select("a", "b"), "resemblance-pairs")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)``, a written table, whose whole sets are similar."""
    asked = cut(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "_th"), "cls"), "resemblance-asked")
    texts = docs.select(F.xxhash64("text").alias("_th"), "text").join(bounded(asked), "_th").groupBy("cls").agg(F.min("text").alias("text"))
    sets = cut(texts.select("cls", F.pandas_udf(_set_batches, "array<long>")("text").alias("s")), "resemblance-sets")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("s")), "a").join(sets.select(F.col("cls").alias("b"), F.col("s").alias("t")), "b")
    shared = F.size(F.array_intersect("s", "t"))
    least, of = SIMILARITY
    return cut(both.filter(of * shared >= least * (F.size("s") + F.size("t") - shared)).select("a", "b"), "resemblance-links")


def components(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``marks(_th, cls, n, words, few)`` of the rows of ``docs`` -> (cls, component), of classes with a link."""
    classes = cut(marks.filter("n > 0").groupBy("cls").agg(F.min(F.struct("_th", "n", "words", "few")).alias("m")).select("cls", "m.*"), "resemblance-classes")
    crowd = cut(crowded(classes), "resemblance-crowd")
    marked = cut(classes.join(crowd.withColumn("crowd", F.lit(1)), "cls", "left").withColumn("crowd", F.coalesce("crowd", F.lit(0))), "resemblance-marked")
    pairs = _paired(emitted(marked, [F.col("crowd"), F.col("words")[0].alias("one"), F.col("words")[1].alias("two")]), "all")
    several = not crowd.isEmpty()
    if several:
        stars = emitted(marked.filter("crowd = 1"), [F.col("words")[0].alias("one")], variants=False)
        pairs = pairs.unionByName(_paired(stars, "stars")).distinct()
    pairs = close(pairs, classes)
    links = verified(pairs, docs, classes)
    found = cut(connected_components(links).withColumnRenamed("id", "cls"), "resemblance-components")
    if not several:
        return found
    named = cut(classes.join(crowd, "cls").join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "resemblance-named")
    # near by the whole SimHash already
    apart = cut(_paired(emitted(named, [F.col("component"), F.col("words")]), "apart").join(pairs, ["a", "b"], "left_anti"), "resemblance-apart")
    links = links.unionByName(verified(apart, docs, classes))
    return cut(connected_components(links).withColumnRenamed("id", "cls"), "resemblance-components")


def grouped(docs: DataFrame) -> DataFrame:
    """(group, doc_id, _th) of every row, _th the hash of its text."""
    marks = cut(docs.select("doc_id", F.xxhash64("text").alias("_th"), F.pandas_udf(_mark_batches, "cls long, n int, words array<long>, few array<long>")("text").alias("k")).select("doc_id", "_th", "k.*"), "resemblance-marks")
    found = components(docs, marks)
    return marks.select("doc_id", "_th", "cls").join(found, "cls", "left").select(F.coalesce("component", "cls").alias("group"), "doc_id", "_th")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, see ``simhash.one_of_each``."""
    return one_of_each(docs, grouped(docs))
