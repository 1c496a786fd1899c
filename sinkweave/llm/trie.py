"""Conversation prefix trie: which first turns conversations share, and what a prefix cache would save.

Sequences are hash-partitioned by the digest of their first turn; inside applyInPandas each part becomes
pointer dictionaries (a node's children by turn digest), summed in an iterative postorder. A first turn
whose subtrie is too large for one task is split by the next turn, again and again, until each
part fits; the nodes at which it was split are few and are summed from their children afterwards.

Equal sequences are folded first, so that thousands of copies walk the trie once with their number as
weight, and turns travel as digests, never as texts. Sequences are compared by 256-bit digests of
their turns and 128 further bits over the digests and their places. Positions are counted in parts of
1,024 turn numbers, and joins on a conversation use parts of it too, so one very long conversation
is spread over tasks; alone in its part it needs no trie, only sums along its turns.

A member list is hashed by streaming over blocks of ids that were joined before they moved.

Defined results: rows without a conversation id are no conversation's turns; null role or text is ''; a
null turn number comes first, equal numbers follow the digest of role and text; repeated rows are turns of
their own; a table without conversations gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinkweave.llm.common import cut

#: Turns that one trie may hold, turns that a task's tries hold together, places of a part of a conversation.
MOST_TURNS, TASK_TURNS, PART = 200_000, 50_000, 1024
#: Conversation ids that are joined into one text before they are hashed.
ID_BLOCK = 256
#: The rule by which conversations are rebuilt: heads of up to 8 turns, shared by ids up to the next multiple of 5.
HEADS, KIN = 9, 5
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "top boolean, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("long"))


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conversations(conv_id, turn, role, text)`` -> the sequences after each conversation c got the first
    crc32(c) % 9 turns of conversation c - c % 5 in place of its own: ``turns(conv_id, depth, digest,
    size)``, depth from 1, and ``convs(conv_id)``, also those left without turns."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(said("role")).cast("string"), F.concat(said("role"), said("text"))), 256))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(said("text")).cast("long").alias("size"))
    first = F.lit(-(2**63)).cast("long")
    rows = rows.withColumn("part", F.coalesce(_div(F.col("turn"), PART), first))
    # where each part starts, and by how much the turns after the head move
    parts = cut(rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")), "trie-parts")
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("head", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    kin = F.col("conv_id") - F.col("conv_id") % KIN
    lent = convs.select(F.col("conv_id").alias("kin"), F.col("n").alias("kin_n"))
    convs = cut(convs.withColumn("kin", kin).join(lent, "kin", "left").select("conv_id", "kin", "head", F.least("head", F.coalesce("kin_n", F.lit(0))).alias("got")), "trie-convs")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select("conv_id", "part", before.alias("before")).join(convs, "conv_id")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "digest")) + F.col("before")
    rows = cut(rows.join(placed, ["conv_id", "part"]).select("conv_id", "head", "got", place.alias("place"), "digest", "size"), "trie-places")
    own = rows.filter("place > head").select("conv_id", (F.col("place") - F.col("head") + F.col("got")).alias("depth"), "digest", "size")
    heads = rows.filter((F.col("place") < HEADS) & (F.col("conv_id") % KIN == 0)).select(F.col("conv_id").alias("kin"), F.col("place").alias("depth"), "digest", "size")
    heads = heads.join(convs.select("kin", "conv_id", "head"), "kin").filter("depth <= head").select("conv_id", "depth", "digest", "size")
    return cut(own.unionByName(heads), "trie-turns"), convs.select("conv_id")


def _hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ids, sorted by sequence and id, to one row for each sequence."""
    schema = pa.schema([("group", pa.binary()), ("length", pa.int64()), ("seq", pa.int64()), ("weight", pa.int64()), ("sha", pa.string())])
    key, now, weight, seq, done = None, None, 0, 0, []

    def sent() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(done, schema)
        done.clear()
        return batch

    for batch in batches:
        for row in batch.to_pylist():
            found = (row["group"], row["length"], row["x"], row["y"])
            if found != key:
                if now:
                    done.append({"group": key[0], "length": key[1], "seq": seq, "weight": weight, "sha": now.hexdigest()})
                key, now, weight, seq = found, hashlib.sha256(), 0, row["least"]
            elif weight:
                now.update(b",")
            now.update(row["ids"].encode())
            weight += row["n"]
        yield sent()
    if now:
        done.append({"group": key[0], "length": key[1], "seq": seq, "weight": weight, "sha": now.hexdigest()})
    yield sent()


def _sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence: its first turn's digest, its length, its smallest member,
    the number of its members and the hash of their ids."""
    x, y = F.bit_xor(F.xxhash64("digest", "depth")), F.bit_xor(F.xxhash64(F.lit(7), "depth", "digest"))
    each = turns.groupBy("conv_id").agg(F.min_by("digest", "depth").alias("group"), F.count(F.lit(1)).alias("length"), x.alias("x"), y.alias("y"))
    each = convs.join(each, "conv_id", "left").fillna(0, ["length", "x", "y"]).withColumn("group", F.coalesce("group", F.lit(b"")))
    key = ["group", "length", "x", "y"]
    blocks = each.groupBy(*key, _div(F.col("conv_id"), ID_BLOCK).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select(*key, "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.col("ids")[0].alias("least"), F.size("ids").cast("long").alias("n"))
    return blocks.repartition(*key).sortWithinPartitions(*key, "block").mapInArrow(_hash_members, "group binary, length long, seq long, weight long, sha string")


def tries(pdf: pd.DataFrame) -> pd.DataFrame:
    """All tries of one part, from rows sorted by sequence and depth; a row at its trie's first depth
    names the trie and the split node above it."""
    pdf = pdf.sort_values(["seq", "depth"], kind="stable")
    tops: dict[bytes, int] = {}
    children, above, conv, weight, size, depth_of, sha, up = [], [], [], [], [], [], [], []
    at = -1
    for group, parent, seq, w, length, depth, digest, n, ends in pdf[["group", "parent", "seq", "weight", "length", "depth", "digest", "size", "sha"]].itertuples(index=False, name=None):
        held, key, over = (tops, bytes(group), -1) if group is not None else (children[at], bytes(digest), at)
        at = held.get(key, -1)
        if at < 0:
            at = held[key] = len(children)
            for column, value in ((children, {}), (above, over), (conv, seq), (weight, 0), (size, n), (depth_of, depth), (sha, None), (up, parent)):
                column.append(value)
        weight[at] += w
        conv[at] = min(conv[at], seq)
        if depth == length:
            sha[at] = ends
    n_leaves, saved = [0] * len(children), [(w - 1) * n for w, n in zip(weight, size, strict=True)]
    waiting, order = list(tops.values()), []
    while waiting:  # parents before children; backwards it is a postorder
        at = waiting.pop()
        order.append(at)
        waiting.extend(children[at].values())
    for at in reversed(order):
        n_leaves[at] = n_leaves[at] or 1
        if above[at] >= 0:
            n_leaves[above[at]] += n_leaves[at]
            saved[above[at]] += saved[at]
    parents = pd.array([conv[a] if a >= 0 else None for a in above], dtype="Int64")
    return pd.DataFrame({
        "top": np.array(above) < 0, "parent": up, "depth": depth_of, "conv_id": conv, "parent_conv_id": parents, "n_convs": weight,
        "n_children": [len(c) for c in children], "n_leaves": n_leaves, "saved_tokens": saved, "ends_sha256": [s or _EMPTY for s in sha],
    })


def _alone(rows: DataFrame) -> DataFrame:
    """Nodes of sequences that are longer than a trie may be and have their part to themselves: one below another."""
    part = _div(F.col("depth"), PART)
    cost = (F.col("weight") - 1) * F.col("size")
    sums = rows.groupBy("seq", part.alias("part")).agg(F.sum(cost).alias("s"))
    later = F.coalesce(F.sum("s").over(Window.partitionBy("seq").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("part", part).join(sums.select("seq", "part", later.alias("later")), ["seq", "part"])
    within = F.sum(cost).over(Window.partitionBy("seq", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    top = F.col("group").isNotNull()
    return rows.select(
        top.alias("top"), "parent", "depth", F.col("seq").alias("conv_id"), F.when(~top, F.col("seq")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        F.when(F.col("depth") < F.col("length"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), (F.col("later") + within).alias("saved_tokens"), F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, convs: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """``turns(conv_id, depth, digest, size)``, depth from 1 without gaps, and ``convs(conv_id)``, distinct -> one
    row for each distinct sequence of first turns, the empty one included."""
    spark = turns.sparkSession
    root = F.lit(b"")
    seqs = cut(_sequences(turns, convs), "trie-sequences")
    # parts of the trie, split by the next turn while they are too large
    open_ = seqs.filter("length > 0").select("group", root.alias("parent"), "seq", "weight", "length", "sha", F.lit(1).cast("long").alias("base"), F.lit(False).alias("alone"))
    ready, splits = [], []
    while True:
        base = len(splits) + 1
        large = open_.groupBy("group", "parent").agg(F.sum(F.col("length") - F.col("base") + 1).alias("rows"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("n_convs"), F.min("seq").alias("conv_id"), F.max(F.when(F.col("length") == base, F.col("sha"))).alias("sha"))
        large = cut(large.filter(F.col("rows") > most_turns), "trie-large")
        ready.append(open_.join(large.filter("n > 1").select("group"), "group", "left_anti").join(large.select("group", F.lit(True).alias("_alone")), "group", "left").withColumn("alone", F.coalesce("_alone", F.lit(False))).drop("_alone"))
        large = large.filter("n > 1")
        if large.isEmpty():
            break
        at = turns.filter(F.col("depth") == base).select(F.col("conv_id"), "size")
        splits.append(cut(large.join(at, "conv_id").select("group", "parent", F.lit(base).cast("long").alias("depth"), "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("size")).alias("own"), F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256")), "trie-splits"))
        at = turns.filter(F.col("depth") == base + 1).select(F.col("conv_id").alias("seq"), "digest")
        split = open_.join(large.select("group"), "group", "left_semi").filter(F.col("length") > base).join(at, "seq")
        open_ = cut(split.select(F.unhex(F.sha2(F.concat("group", "digest"), 256)).alias("group"), F.col("group").alias("parent"), "seq", "weight", "length", "sha", F.lit(base + 1).cast("long").alias("base"), "alone"), "trie-open")
    dealt = ready[0]
    for more in ready[1:]:
        dealt = dealt.unionByName(more)
    whole = dealt.withColumn("part", F.explode(F.sequence(_div(F.col("base"), PART), _div(F.col("length"), PART))))
    top, last = F.col("depth") == F.col("base"), F.col("depth") == F.col("length")
    rows = turns.withColumnRenamed("conv_id", "seq").withColumn("part", _div(F.col("depth"), PART)).join(whole, ["seq", "part"]).filter("depth >= base")
    kept = [F.when(top, F.col("group")).alias("group"), F.when(top, F.col("parent")).alias("parent"), "seq", "weight", "length", "depth", "digest", "size", F.when(last, F.col("sha")).alias("sha")]
    n_turns = seqs.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    task = F.pmod(F.xxhash64("group"), F.lit(n_turns // TASK_TURNS + 1)).cast("int").alias("task")
    found = rows.filter("not alone").select(task, *kept).groupBy("task").applyInPandas(tries, _NODE)
    if len(splits) or not dealt.filter("alone").isEmpty():
        found = found.unionByName(_alone(rows.filter("alone").select(*kept)))
    found = cut(found, "trie-nodes")
    below = [c for c in found.columns if c not in ("top", "parent")]
    out = found.filter("not top").select(below)
    # split nodes from the deepest on, each from its children; then the root
    tops = found.filter("top")
    for level in reversed(splits):
        sums = tops.groupBy(F.col("parent").alias("group")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        mine = cut(level.join(sums, "group").select("group", "parent", "depth", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"), "ends_sha256"), "trie-level")
        named = tops.drop("parent_conv_id").join(mine.select(F.col("group").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
        out = out.unionByName(named.select(below))
        rest = tops.join(mine.select(F.col("group").alias("parent")), "parent", "left_anti")
        tops = rest.unionByName(mine.drop("group").withColumn("top", F.lit(True)))
    total = seqs.agg(F.sum("weight").alias("n_convs"), F.min("seq").alias("conv_id"), F.max(F.when(F.col("length") == 0, F.col("sha"))).alias("sha")).first()
    if total["conv_id"] is None:
        return spark.createDataFrame([], out.schema)
    sums = tops.agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    whole = sums.select(
        F.lit(0).cast("long").alias("depth"), F.lit(total["conv_id"]).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total["n_convs"]).cast("long").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.lit(total["sha"] or _EMPTY).alias("ends_sha256"))
    return out.unionByName(tops.withColumn("parent_conv_id", F.lit(total["conv_id"]).cast("long")).select(below)).unionByName(whole)
