"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row: its places are terms, its integer components weights. Candidates are packed
into blocks of postings (per term the rows that hold it, with their weights). For each query block and
candidate block, each term of the queries scatters its weighted postings into dense score arrays;
partition selection keeps the k best rows of the block for each query, and a window merges the blocks.

Blocks of both sides meet under (candidate part, query part), so neither side is broadcast and a task
holds a few blocks of each, whatever the sizes. Query sets may grow with the table: the work is the
product of both by contract, the memory is not.

Defined results: vectors that are null or hold null or non-finite components (also once they are
scaled) take no part; empty vectors do, with score 0; where one vector is longer, what the other lacks
counts as 0. Repeated ids are separate rows: each repeated query is answered for itself, only its own
row is left out. Candidates without an id are found too, after all ids in ties; rows without an id
are no queries. Scores beyond a long count as the last long. An empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinkweave.llm.common import cut

SCALE, K = 1024, 10
#: Components of a candidate block; queries of a query part; scores that one pass over the terms fills.
BLOCK_COMPONENTS, QUERY_ROWS, SCORES_AT_ONCE = 1 << 18, 4096, 1 << 21
MOST = np.iinfo(np.int64).max

_BLOCK = "block string, ids binary, named binary, starts binary, weights binary, queries array<struct<place:int, id:bigint, weights:binary>>"
_PACKED = pa.schema([
    ("block", pa.string()), ("ids", pa.binary()), ("named", pa.binary()), ("starts", pa.binary()), ("weights", pa.binary()),
    ("queries", pa.list_(pa.struct([("place", pa.int32()), ("id", pa.int64()), ("weights", pa.binary())]))),
])
_FOUND = "q_block string, q_place int, query_id long, vec_id long, score long"


def _packed(name: str, ids: list, asked: list, rows: list[np.ndarray]) -> pa.RecordBatch:
    """One block, by id: of equal scores the first place wins."""
    order = sorted(range(len(ids)), key=lambda r: (ids[r] is None, ids[r] or 0))
    ids, asked, rows = ([x[r] for r in order] for x in (ids, asked, rows))
    starts = np.cumsum([0, *map(len, rows)], dtype=np.int64)
    queries = [{"place": r, "id": ids[r], "weights": rows[r].tobytes()} for r in range(len(ids)) if asked[r]]
    known = np.array([i or 0 for i in ids], dtype=np.int64)
    block = {"block": name, "ids": known.tobytes(), "named": np.array([i is not None for i in ids]).tobytes(), "starts": starts.tobytes(), "weights": np.concatenate(rows).tobytes(), "queries": queries}
    return pa.RecordBatch.from_pylist([block], _PACKED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, asked, vector of doubles, number of the task) to blocks of integer-valued weights."""
    ids, asked, rows, held, made, task = [], [], [], 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors, task = batch.column(2), batch.column(3)[0].as_py()
        ends = vectors.offsets.to_numpy()
        with np.errstate(over="ignore"):
            flat = np.floor(vectors.values.to_numpy(zero_copy_only=False) * SCALE)
        for r, (i, a) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            row = flat[ends[r] : ends[r + 1]]
            if np.isfinite(row).all():
                ids.append(i)
                asked.append(a)
                rows.append(row)
                held += len(row) + 1
                if held >= BLOCK_COMPONENTS:
                    yield _packed(f"{task}-{made}", ids, asked, rows)
                    ids, asked, rows, held, made = [], [], [], 0, made + 1
    if ids:
        yield _packed(f"{task}-{made}", ids, asked, rows)


class Postings:
    """The rows of a block by term: for each place the rows that hold a weight there, and the weights."""

    def __init__(self, starts: np.ndarray, weights: np.ndarray):
        lengths = np.diff(starts)
        self.n_rows, self.n_terms = len(lengths), int(lengths.max(initial=0))
        row = np.repeat(np.arange(self.n_rows), lengths)
        term = np.arange(len(weights)) - np.repeat(starts[:-1], lengths)
        held = np.flatnonzero(weights)
        held = held[np.argsort(term[held], kind="stable")]
        self.rows, self.weights = row[held], weights[held]
        self.ends = np.searchsorted(term[held], np.arange(self.n_terms + 1))

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """Inner products of all queries with all rows: 64-bit integers where they are wide enough,
        Python's own, held to a long at the end, elsewhere."""
        asked = np.zeros((self.n_terms, len(queries)))
        for k, q in enumerate(queries):
            asked[: len(q), k] = q[: self.n_terms]
        most, of_query = int(np.abs(self.weights).max(initial=0)), int(np.abs(asked).max(initial=0))
        narrow = most * of_query * self.n_terms <= MOST and max(most, of_query) <= MOST
        whole = (lambda a: a.astype(np.int64)) if narrow else (lambda a: np.array([int(x) for x in a], dtype=object))
        out = np.zeros((len(queries), self.n_rows), dtype=np.int64 if narrow else object)
        for term in range(self.n_terms):
            asking, at = np.flatnonzero(asked[term]), slice(self.ends[term], self.ends[term + 1])
            if not len(asking) or at.start == at.stop:
                continue
            more = np.multiply.outer(whole(asked[term, asking]), whole(self.weights[at]))
            if more.shape == out.shape:
                out += more
            else:
                out[np.ix_(asking, self.rows[at])] += more
        return out if narrow else np.array([[max(-MOST, min(MOST, x)) for x in row] for row in out], dtype=np.int64).reshape(out.shape)


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by place, best first: a partition finds the lowest that stays."""
    at = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    return at[np.lexsort((at, -scores[at]))]


def _searcher(k: int):
    def run(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        own_block, own_place, of_id = queries["q_block"].to_numpy(), queries["q_place"].to_numpy(), queries["query_id"].to_numpy()
        weights = [np.frombuffer(w) for w in queries["weights"]]
        for b in blocks.itertuples(index=False):
            ids, named = np.frombuffer(b.ids, np.int64), np.frombuffer(b.named, bool)
            postings = Postings(np.frombuffer(b.starts, np.int64), np.frombuffer(b.weights))
            step, asking, best, won = max(1, SCORES_AT_ONCE // len(ids)), [], [], []
            for at in range(0, len(weights), step):
                for q, row in enumerate(postings.scores(weights[at : at + step]), at):
                    own = own_block[q] == b.block
                    places = select(row, k + own)
                    places = places[places != own_place[q]] if own else places
                    asking.append(np.full(len(places[:k]), q))
                    best.append(places[:k])
                    won.append(row[places[:k]])
            if asking:
                q, at = np.concatenate(asking), np.concatenate(best)
                vec_id = pd.arrays.IntegerArray(ids[at].copy(), ~named[at])
                found.append(pd.DataFrame({"q_block": own_block[q], "q_place": own_place[q], "query_id": of_id[q], "vec_id": vec_id, "score": np.concatenate(won)}))
        return pd.concat(found) if found else pd.DataFrame(columns=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def search(vectors: DataFrame, asked: Column, k: int = K) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> the k best other rows of every row for which ``asked`` holds:
    query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    is_query = F.coalesce(asked & F.col("vec_id").isNotNull(), F.lit(False))
    read = vectors.filter(whole).select(F.col("vec_id").cast("long"), is_query.alias("asked"), F.col("embedding").cast("array<double>").alias("v"), F.spark_partition_id())
    blocks = cut(read.mapInArrow(_blocks, _BLOCK), "topk-blocks")
    size = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(F.size("queries")), F.lit(0)).alias("queries")).first()
    c_parts, q_parts = max(1, size["blocks"]), max(1, -(-size["queries"] // QUERY_ROWS))
    key, each = ["c_part", "q_part"], lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # as many partitions as pairs of parts, up to some for each core
    n = min(c_parts * q_parts, max(64, 8 * spark.sparkContext.defaultParallelism))
    left = blocks.select(F.pmod(F.xxhash64("block"), F.lit(c_parts)).cast("int").alias("c_part"), each(q_parts).alias("q_part"), "block", "ids", "named", "starts", "weights")
    query = blocks.select("block", F.explode("queries").alias("q")).select(F.pmod(F.xxhash64("block", "q.place"), F.lit(q_parts)).cast("int").alias("q_part"), F.col("block").alias("q_block"), F.col("q.place").alias("q_place"), F.col("q.id").alias("query_id"), "q.weights")
    right = query.select(each(c_parts).alias("c_part"), "*")
    found = left.repartition(n, *key).groupBy(*key).cogroup(right.repartition(n, *key).groupBy(*key)).applyInPandas(_searcher(k), _FOUND)
    order = Window.partitionBy("q_block", "q_place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
