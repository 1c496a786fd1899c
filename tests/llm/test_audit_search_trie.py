"""op11 to op13: the given tables and odd fixtures against the oracle SQL, small parts against whole ones."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sinkweave.llm import divergence, registry, topk, trie
from tests.conftest import DATA

NAMES = ("documents", "embeddings", "conversations")


def both(spark, folder, name):
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = registry.queries()[name](spark, str(folder))
    found = c.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    return sorted((tuple(r[k] for k in columns) for r in df.collect()), key=repr), sorted(found.fetchall(), key=repr)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing further columns."""
    folder, rnd = tmp_path_factory.mktemp("odd"), random.Random(7)
    words = ["alpha", "Beta", "ÇA", "straße", "x" * 5000, "naïve", "中文字", "d1g2"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))), rnd.choice(["en", None, ""]), rnd.choice(["a", "b", None, "é"])) for i in range(120)]
    docs += [docs[5]] * 12 + [(None, None, None, None), (7, "", "xx", "lonely"), (8, "one two " * 30000, "xx", "other"), (9, "12 . ?", "yy", "s")]
    ids, texts, langs, sources = zip(*docs, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": langs, "source": sources, "n": pa.array([1] * len(ids)), "vector": pa.array(["v"] * len(ids)), "term": pa.array([None] * len(ids), pa.string())}), folder / "documents.parquet")
    rows = [(i, [float(rnd.randint(-2, 2)) / 1024 for _ in range(5)]) for i in range(320)]
    rows += [(100, rows[100][1])] * 2 + [(400, None), (500, [1.0, None]), (600, [float("nan")]), (700, [float("inf")]), (800, []), (900, [0.1] * 9), (None, [0.5] * 5), (None, [0.5] * 5), (-100, [0.0, -3.5])]
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "block": pa.array([3] * len(rows)), "task": pa.array(["t"] * len(rows))}), folder / "embeddings.parquet")
    turns = []
    for conv in [*range(40), *range(-7, 0), 1000, 1003, 5001]:
        for turn in range(rnd.randint(1, 12)):
            turns.append((conv, turn if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["hello", "", None, "größe", "bye"])))
    turns += [(conv, turn, "user", f"same {turn}") for conv in range(2000, 2040) for turn in range(12)]
    turns += turns[:9] + [(None, 0, "user", "nobody"), (None, None, None, None), (3001, 5, "user", "w" * 200000)]
    conv, turn, role, text = zip(*turns, strict=True)
    pq.write_table(pa.table({"conv_id": pa.array(conv, pa.int64()), "turn": pa.array(turn, pa.int64()), "role": role, "text": text, "depth": pa.array([1] * len(conv)), "seq": pa.array(["s"] * len(conv)), "part": pa.array([0] * len(conv))}), folder / "conversations.parquet")
    return folder


@pytest.mark.parametrize("name", ["op11_divergence", "op12_topk", "op13_prefix_trie"])
def test_given_tables(spark, name):
    got, want = both(spark, DATA, name)
    assert got == want and got


@pytest.mark.parametrize("name", ["op11_divergence", "op12_topk", "op13_prefix_trie"])
def test_odd_rows(spark, odd, name):
    got, want = both(spark, odd, name)
    assert got == want and got


def test_empty_tables(spark, odd):
    read = lambda t: spark.read.parquet(f"{odd}/{t}.parquet").limit(0)
    assert divergence.audit(read("documents")).collect() == []
    assert topk.search(read("embeddings"), F.expr("vec_id > 0")).collect() == []
    assert trie.prefix_trie(*trie.rebuild(read("conversations"))).collect() == []


def test_small_parts_make_the_same_trie(spark, odd, monkeypatch):
    turns, convs = trie.rebuild(spark.read.parquet(f"{odd}/conversations.parquet"))
    want = sorted(map(repr, trie.prefix_trie(turns, convs).collect()))
    monkeypatch.setattr(trie, "PART", 2)
    monkeypatch.setattr(trie, "TASK_TURNS", 20)
    for most in (3, 12):  # nearly each first turn is split again and again; single sequences stay alone
        assert sorted(map(repr, trie.prefix_trie(turns, convs, most).collect())) == want


def test_few_held_terms_count_the_same(spark, odd, monkeypatch):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    n, df = {}, {}
    for row in docs.collect():
        words = divergence.terms_of((row["text"] or "").encode())
        for w in words:
            n[row["lang"] or "", row["source"] or "", w] = n.get((row["lang"] or "", row["source"] or "", w), 0) + 1
        for w in set(words):
            df[row["lang"] or "", row["source"] or "", w] = df.get((row["lang"] or "", row["source"] or "", w), 0) + 1
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    monkeypatch.setattr(divergence, "AT_ONCE", 2)
    lists = docs.fillna("", ["lang", "source", "text"]).selectExpr("lang", "source", "cast(text as binary) t").toArrow().to_batches()
    got = {}
    for batch in divergence._count(iter(lists)):
        for r in batch.to_pylist():
            if r["term"]:
                key = r["lang"], r["source"], r["term"]
                got[key] = tuple(a + b for a, b in zip(got.get(key, (0, 0)), (r["n"], r["docs"]), strict=True))
    assert got == {k: (n[k], df[k]) for k in n}


def test_scores_are_exact_beyond_a_long():
    rows = [np.array([1e12, 3.0, 0.0]), np.array([0.0, -2.0]), np.array([]), np.array([2.0**62, 1.0, 5.0])]
    starts, queries = np.cumsum([0, *map(len, rows)]), [np.array([1e12, 1.0]), np.array([2.0, 4.0, 1.0, 9.0])]
    want = [[sum(int(a) * int(b) for a, b in zip(q, r)) for r in rows] for q in queries]
    assert topk.Postings(starts, np.concatenate(rows)).scores(queries).tolist() == [[max(-topk.MOST, min(topk.MOST, x)) for x in row] for row in want]
    rnd = np.random.default_rng(3)
    for _ in range(200):
        row, k = rnd.integers(-3, 3, rnd.integers(0, 30)), int(rnd.integers(1, 12))
        assert topk.select(row, k).tolist() == sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]
