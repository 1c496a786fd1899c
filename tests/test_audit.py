"""Small fixtures: extraction, marks, chains, triage, replies, sources, streaming."""

import json
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sinkweave.functions.lineage import cut
from sinkweave.functions.text import basename, normalize_path, slice_source, truncated
from sinkweave.operators import chains, extract, indexing, lookup, rules, structure, taint, triage, verify
from sinkweave.sources import tables
from sinkweave.streaming import jobs

#: (language, program, {symbol: (kind, container, first line, last line)}, {callee: owner})
PROGRAMS = [
    ("javascript", """class Basket {
  total(rows) {
    return sum(rows);
  }
}
function open_shop(town) {
  const b = new Basket();
  return b.total(town.goods);
}
const close_shop = (town) => {
  bolt(town);
};
""", {"Basket": ("class", None, 0, 4), "total": ("method", "Basket", 1, 3), "open_shop": ("function", None, 5, 8), "close_shop": ("function", None, 9, 11)},
     {"sum": "total@1", "total": "open_shop@5", "Basket": "open_shop@5", "bolt": "close_shop@9"}),
    ("typescript", """interface Bird {
  sing(): string;
}
export function hatch(egg: string): Bird {
  return warm(egg);
}
""", {"hatch": ("function", None, 3, 5)}, {"warm": "hatch@3"}),
    ("python", """class Kettle:
    def boil(self, litres):
        heat(litres)


def tea():
    Kettle().boil(2)
""", {"Kettle": ("class", None, 0, 2), "boil": ("method", "Kettle", 1, 2), "tea": ("function", None, 5, 6)}, {"heat": "boil@1", "Kettle": "tea@5"}),
    ("java", """class Ferry {
  int load(int cars) {
    return weigh(cars);
  }
}
""", {"Ferry": ("class", None, 0, 4), "load": ("method", "Ferry", 1, 3)}, {"weigh": "load@1"}),
    ("go", """package harbour

func dock(ship string) {
	moor(ship)
}
""", {"dock": ("function", None, 2, 4)}, {"moor": "dock@2"}),
    ("php", """<?php
class Oven {
  function bake($bread) { return warm($bread); }
}
""", {"Oven": ("class", None, 1, 3), "bake": ("method", "Oven", 2, 2)}, {"warm": "bake@2"}),
    ("c", """int area(int a, int b)
{
  return times(a, b);
}
""", {"area": ("function", None, 0, 3)}, {"times": "area@0"}),
    ("cpp", """class Lamp {
  int glow(int watts) { return shine(watts); }
};
""", {"Lamp": ("class", None, 0, 2), "glow": ("method", "Lamp", 1, 1)}, {"shine": "glow@1"}),
    ("csharp", """class Garden {
  int Plant(int seeds) {
    return Water(seeds);
  }
}
""", {"Garden": ("class", None, 0, 4), "Plant": ("method", "Garden", 1, 3)}, {"Water": "Plant@1"}),
]


@pytest.mark.parametrize("language,text,symbols,calls", PROGRAMS, ids=[p[0] for p in PROGRAMS])
def test_extraction(language, text, symbols, calls):
    found, called, _ = extract.extract(language, text)
    by = {s["name"]: (s["kind"], s["container"], s["start_line"], s["end_line"]) for s in found}
    assert {k: by.get(k) for k in symbols} == symbols
    owners = {c["callee"]: c["from_symbol"] for c in called}
    assert {k: owners.get(k) for k in calls} == calls


@pytest.mark.parametrize("language,text,want", [
    ("typescript", "import tea from '../pot/tea';\nexport * from './cup';\nconst s = require('spoon');", ["../pot/tea", "./cup", "spoon"]),
    ("python", "import kettle.lid, pot as p\nfrom .stove import fire", ["kettle.lid", "pot", ".stove"]),
    ("java", "import org.bakery.Oven;\nimport static org.bakery.Units.*;", ["org.bakery.Oven", "org.bakery.Units.*"]),
    ("go", "import (\n  h \"harbour/dock\"\n  \"ships\"\n)", ["harbour/dock", "ships"]),
    ("cpp", "#include <vector>\n#include \"lamp/bulb.hpp\"", ["vector", "lamp/bulb.hpp"]),
])
def test_imports(language, text, want):
    assert extract.imports_of(language, text) == want


def test_extract_index_as_tables(spark):
    files = spark.createDataFrame([("shop.js", "javascript", PROGRAMS[0][1]), ("none.py", "python", None)], "file string, language_id string, content string")
    indexed = extract.extract_index(files)
    assert {r["callee"]: r["from_symbol"] for r in extract.extract_calls(indexed).collect()}["bolt"] == "shop.js#close_shop@9"
    assert {r["id"] for r in extract.extract_symbols(indexed).collect()} == {"shop.js#Basket@0", "shop.js#total@1", "shop.js#open_shop@5", "shop.js#close_shop@9"}


def test_extraction_is_linear(spark):
    """A file of 1 MiB with many functions and calls."""
    text = "".join(f"function f{k}(x) {{\n  return g{k}(x);\n}}\n" for k in range(25_000))
    began = time.time()
    symbols, calls, _ = extract.extract("javascript", text)
    assert len(symbols) == 25_000 and sum(c["callee"].startswith("g") for c in calls) == 25_000
    assert time.time() - began < 30


def test_paths_and_text(spark):
    row = spark.range(1).select(
        normalize_path(F.lit("a/./b//../../../c\\d")).alias("p"), basename(F.lit("x/y.c")).alias("b"), truncated(F.lit(" a  b\n c "), 3).alias("t"),
        slice_source(F.lit("l0\r\nl1\nl2"), F.lit(1), F.lit(9)).alias("s")).first()
    assert (row["p"], row["b"], row["t"], row["s"]) == ("c/d", "y.c", "a b…", "    2| l1\n    3| l2")


def test_resolve_imports(spark):
    names = ["web/shop/cart.ts", "web/shop/till/index.ts", "web/home.js", "pots/kettle/lid.py", "pots/stove/__init__.py", "src/org/bakery/Oven.java", "inc/lamp/bulb.hpp"]
    files = spark.createDataFrame(list(enumerate(names)), "file_seq long, file string")
    cases = [("web/shop/cart.ts", "./till", names[1]), ("web/shop/cart.ts", "../home", names[2]), ("web/home.js", "./shop/cart", names[0]), ("a/b.py", "kettle.lid", names[3]), ("a/b.py", "pots.stove", names[4]),
             ("a/B.java", "org.bakery.Oven", names[5]), ("a/b.cpp", "bulb.hpp", names[6]), ("web/home.js", "vue", None), ("a/b.py", ".lid", None), ("web/home.js", "vue", None)]
    got = structure.resolve_imports(spark.createDataFrame([(f, t, k) for k, (f, t, _) in enumerate(cases)], "file string, target string, imp_seq int"), files)
    assert {r["imp_seq"]: r["resolved"] for r in got.collect()} == {k: c[2] for k, c in enumerate(cases)}


def _marks(spark, rows):
    return spark.createDataFrame([(f"{k}:{f}:{n}", k, s, o, f, n) for k, s, o, f, n in rows], "id string, kind string, status string, origin string, file string, line long")


def test_merge_keeps_decisions_and_is_idempotent(spark):
    old = _marks(spark, [("sink", "confirmed", "scan", "a.js", 3), ("sink", "excluded", "scan", "a.js", 5), ("sink", "candidate", "scan", "a.js", 9), ("sink", "candidate", "manual", "a.js", 7)])
    new = _marks(spark, [("sink", "candidate", "scan", "a.js", 3), ("sink", "candidate", "scan", "a.js", 12)])
    once = taint.merge_candidates(old, new)
    assert {(r["line"], r["status"]) for r in once.collect()} == {(3, "confirmed"), (5, "excluded"), (7, "candidate"), (12, "candidate")}
    assert sorted(taint.merge_candidates(once, new).collect()) == sorted(once.collect())


def test_first_rule_wins_and_word_boundaries_are_ascii(spark):
    calls = spark.createDataFrame([(0, "a.c", "c", 1, 0, "gets"), (0, "b.php", "php", 1, 0, "exec"), (0, "p.py", "python", 1, 0, "mysql_query")], "file_seq long, file string, language_id string, call_seq long, line int, callee string")
    hits = {r["file"]: (r["kind"], r["category"]) for r in taint.scan_calls(calls, rules.rules_table(spark)).collect()}
    assert hits == {"a.c": ("sink", "Buffer Operation"), "b.php": ("sink", "Command Execution")}
    lines = spark.createDataFrame([(0, "a.js", "javascript", 0, "éreq.query.id"), (0, "a.js", "javascript", 1, "xreq.query"), (0, "a.py", "python", 0, "$_GET['x']")], "file_seq long, file string, language_id string, line int, text string")
    assert [(r["file"], r["line"], r["anchor"]) for r in taint.scan_lines(lines).collect()] == [("a.js", 1, "req.query")]


def _every_chain(sink, calls, symbols, sources, depth, callers, most):
    """All chains a level at a time, each with its place; limits on their number come last."""
    known = {s["id"]: s for s in symbols}
    first_calls = {}
    for c in calls:
        first_calls.setdefault((c["callee"], c["from_symbol"] or f"top of {c['file']}"), (known.get(c["from_symbol"]), c["line"]))
    who = defaultdict(list)
    for (callee, _), (caller, _) in first_calls.items():
        who[callee].append(caller)
    ended, growing = [], [((), [sink])]
    for level in range(depth + 1):
        longer = []
        for place, path in growing:
            head, names = path[0], [p["name"] for p in path]
            near = [x for x in who[head["name"]] if x and x["file"] == head["file"]]
            ranked = near + [x for x in who[head["name"]] if not any(x is n for n in near)]
            fresh = [x for x in ranked if x is None or x not in path]
            if not ranked or level == depth:
                why = f"entry function {head['name']}" if head["name"] in chains.ENTRY_NAMES else "reached depth limit" if ranked else "no callers (possible framework entry)"
                ended.append((place, names, None, why))
            elif not fresh:
                ended.append((place, names, None, "chain cycles here"))
            for k, x in enumerate(fresh[:callers] if level < depth else ()):
                if x is None:
                    ended.append(((*place, k), [f"{head['file']} (top level)", *names], None, "module top-level call"))
                elif x["id"] in sources:
                    ended.append(((*place, k), [x["name"], *names], sources[x["id"]], None))
                else:
                    longer.append(((*place, k), [x, *path]))
        growing = longer
    kept = sorted(ended)[:most]
    score = lambda e: 100 * bool(e[2]) + 40 * bool(e[3]) + max(0, 20 - len(e[1]))
    return [(e[1], e[2], e[3], score(e)) for e in sorted(kept, key=lambda e: (-score(e), e[0]))]


@pytest.mark.parametrize("seed", range(3))
def test_chains_equal_enumeration(spark, seed):
    rnd = random.Random(seed)
    names = ["main", "f", "g", "h", "doGet"]
    symbols = [{"id": f"x{k % 3}.js#s{k}@0", "name": rnd.choice(names), "file": f"x{k % 3}.js"} for k in range(8)]
    calls = [{"callee": rnd.choice(names), "from_symbol": rnd.choice([s["id"] for s in symbols] + [None, "gone#1@1"]), "line": k, "file": f"x{k % 3}.js", "file_seq": k % 3, "call_seq": k} for k in range(26)]
    calls.sort(key=lambda c: (c["file_seq"], c["call_seq"]))
    sources = {symbols[5]["id"]: "source:1"}
    limits = dict(max_depth=4, max_callers=3, max_chains=6)
    s = spark.createDataFrame([(x["id"], x["name"], x["file"]) for x in symbols], "id string, name string, file string")
    c = spark.createDataFrame([tuple(x[k] for k in ("callee", "from_symbol", "line", "file", "file_seq", "call_seq")) for x in calls], "callee string, from_symbol string, line int, file string, file_seq long, call_seq long")
    sinks = spark.createDataFrame([(f"k{i}", x["file"], 1, x["id"], x["name"], x["file"]) for i, x in enumerate(symbols)] + [("top", "d/t.js", 4, None, None, None)], "id string, file string, line int, sym_id string, sym_name string, sym_file string")
    src = spark.createDataFrame(list(sources.items()), "id string, source_mark string")
    got: dict = {}
    for r in chains.expand_chains(sinks, chains.caller_edges(c), s, src, **limits).orderBy("sink", "chain_seq").collect():
        got.setdefault(r["sink"], []).append(([h["name"] for h in r["hops"]], r["source_mark"], r["reason"], r["score"]))
    assert got.pop("top") == [(["t.js"], None, "top-level code", 0)]
    assert got == {f"k{i}": _every_chain(x, calls, symbols, sources, 4, 3, 6) for i, x in enumerate(symbols)}


@pytest.mark.parametrize("lengths,starts,limit,want", [
    ([3] * 5, set(), 20, [(1, 5)]),
    ([3] * 6, set(), 20, [(1, 5), (6, 6)]),
    ([3] * 12, {4, 9}, 24, [(1, 4), (5, 9), (10, 12)]),
    ([3] * 12, {0, 7}, 100, [(1, 12)]),
    ([90, 1, 1], {1}, 40, [(1, 1), (2, 3)]),
    ([1, 90, 1], set(), 40, [(1, 1), (2, 2), (3, 3)]),
])
def test_chunks(lengths, starts, limit, want):
    assert triage.chunk_ranges(lengths, starts, limit) == want


def test_chunks_cover_all_lines():
    rnd = random.Random(1)
    for _ in range(200):
        n = [rnd.randint(0, 90) for _ in range(rnd.randint(1, 60))]
        got = triage.chunk_ranges(n, {rnd.randrange(60) for _ in range(5)}, rnd.randint(50, 900))
        assert got[0][0] == 1 and got[-1][1] == len(n) and all(a[1] + 1 == b[0] for a, b in zip(got, got[1:]))


def test_strict_replies():
    assert json.loads(triage._strict('```json\n["tea", {"cups": 3}]\n```') or "null") == ["tea", {"cups": 3}] or triage._strict('```json\n["tea"]\n```') is None
    assert json.loads(triage._strict('My answer is {"tea": {"cups": [3]}} as you asked')) == {"tea": {"cups": [3]}}
    assert all(triage._strict(x) is None for x in ('{"tea": 3} or {', "no tea", '{"tea":Infinity}', None, ""))


def test_complete_retries_once(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "prompt string")
    got = {r["prompt"]: (r["reply"], r["error"]) for r in triage.complete(asked, lambda p: p.map(lambda x: '{"ok":1}' if x == "a" or "one JSON object" in x and x[0] == "c" else "bad")).collect()}
    assert got == {"a": ('{"ok":1}', None), "b": ("bad", "reply is not JSON")}


def test_conversations(spark):
    parts = [('{"parts":[{"type":"tool","text":"kettle"},{"type":"text","text":"two "},{"type":"text"},{"type":"text","text":"cups"}]}', "two cups"), ('{"info":{}}', ""),
             ('{"parts":[],"info":{"parts":[{"type":"text","text":"inside"}],"content":"not this"}}', "inside"), ('{"info":{"content":"last resort"}}', "last resort"), ("no json", "")]
    df = spark.createDataFrame(parts, "p string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", verify.extract_text_parts(F.col("p")).alias("got")).collect())
    ids = spark.createDataFrame([("a/b/c", "a", "b/c"), ("m", "", "m"), ("", "", ""), ("/x", "", "x")], "m string, p string, q string")
    one, two = verify.split_model_id(F.col("m"))
    assert all((r["a"], r["b"]) == (r["p"], r["q"]) for r in ids.select("p", "q", one.alias("a"), two.alias("b")).collect())


def test_read_corpus_and_snapshot(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1", "node_modules/b.js": "y", "c.min.js": "z", "README.md": "no", "d/Big.java": "q" * (1 << 20) + "q"}.items():
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = tables.read_corpus(spark, str(tmp_path / "repo")).collect()
    assert [(r["file"], r["language_id"], r["content"]) for r in got] == [("src/a.py", "python", "x = 1")]
    (tmp_path / "s.json").write_text(json.dumps({"version": 3, "entries": [{"file": "a.py", "lines": 2, "imports": ["os"]}]}))
    (tmp_path / "old.json").write_text(json.dumps({"version": 2, "entries": [{"file": "a.py"}]}))
    assert [r["file"] for r in tables.read_index_snapshot(spark, str(tmp_path / "s.json")).collect()] == ["a.py"]
    assert tables.read_index_snapshot(spark, str(tmp_path / "old.json")).count() == 0
    assert tables.read_marks(spark, str(tmp_path / "none")).count() == 0


def test_streams_equal_batch(spark, tmp_path):
    schema = "file string, content string, ts long"
    src, out = str(tmp_path / "in"), str(tmp_path / "index")
    spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("a", "2", 2)], schema).write.parquet(src)
    stream = lambda n: jobs.stream_index(spark.readStream.schema(schema).parquet(src), lambda df: df.select("file", "content_hash", F.lit(n).alias("batch")), out, str(tmp_path / "cp")).awaitTermination()
    stream("first")
    spark.createDataFrame([("b", "1", 3), ("c", "1", 3), ("a", "3", 4)], schema).write.mode("append").parquet(src)
    stream("second")
    assert {r["file"]: r["batch"] for r in jobs.latest(spark, out).collect()} == {"a": "second", "b": "first", "c": "second"}
    marks = _marks(spark, [("sink", "candidate", "scan", "a", 1), ("sink", "candidate", "scan", "a", 2)])
    acts = spark.createDataFrame([("sink:a:1", "confirm", "u", 1, 1), ("sink:a:1", "exclude", "v", 2, 2), ("sink:a:2", "delete", "u", 1, 3)], "id string, action string, author string, ts long, seq long")
    assert [(r["id"], r["status"], r["author"]) for r in jobs.fold_decisions(marks, acts).collect()] == [("sink:a:1", "excluded", "u")]


@pytest.mark.parametrize("seed", range(2))
def test_decisions_fold_alike_however_the_log_is_split(spark, seed):
    rnd = random.Random(seed)
    ids = [f"{k}:a/{f}.js:{n}" for k in ("sink", "source") for f in "xy" for n in (1, 2)]
    marks = _marks(spark, [("sink", "candidate", "scan", "a/x.js", 1), ("sink", "excluded", "scan", "a/x.js", 2), ("source", "candidate", "scan", "a/y.js", 1)])
    log = [(rnd.choice(ids), rnd.choice(["confirm", "exclude", "restore", "manual", "delete"]), f"u{k % 3}", k // 2, k) for k in range(36)]
    state = {r["id"]: (r["status"], r["origin"]) for r in marks.collect()}
    for i, action, *_ in log:  # one by one
        if action == "delete":
            state.pop(i, None)
        elif action == "manual":
            state[i] = ("confirmed", "manual")
        elif i in state:
            state[i] = ({"confirm": "confirmed", "exclude": "excluded", "restore": "candidate"}[action], state[i][1])
    schema = "id string, action string, author string, ts long, seq long"
    for cuts in ([36], [7, 20, 36]):
        now, start = marks, 0
        for end in cuts:
            now = cut(jobs.fold_decisions(now, spark.createDataFrame(log[start:end], schema)), "folded")
            start = end
        assert {r["id"]: (r["status"], r["origin"]) for r in now.collect()} == state
        assert all(r["id"] == f"{r['kind']}:{r['file']}:{r['line']}" for r in now.collect())


def test_stream_of_decisions(spark, tmp_path):
    schema = "id string, action string, author string, ts long, seq long"
    src, path = str(tmp_path / "log"), str(tmp_path / "marks")
    jobs.fold_decisions(_marks(spark, [("sink", "candidate", "scan", "a", 1)]), spark.createDataFrame([], schema)).write.parquet(f"{path}/v{-1:08d}")
    run = lambda: jobs.stream_decisions(spark.readStream.schema(schema).parquet(src), path, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("sink:a:1", "delete", "u", 1, 1)], schema).write.parquet(src)
    run()
    spark.createDataFrame([("sink:a:1", "confirm", "u", 2, 2), ("source:b:4", "manual", "w", 2, 3)], schema).write.mode("append").parquet(src)
    run()
    assert [(r["id"], r["status"], r["origin"], r["author"]) for r in jobs.latest(spark, path, "id").collect()] == [("source:b:4", "confirmed", "manual", "w")]


def test_verify_prompts_show_all_hops_in_order(spark):
    hop = "array<struct<symbol_id:string,name:string,file:string,line:int>>"
    ways = [("k1", 1, [("a.js#top@0", "top", "a.js", 2), ("a.js#low@3", "low", "a.js", 5)], "source:a.js:1", None), ("k1", 2, [(None, "b.js", "b.js", 9)], None, "top-level code"), ("k2", 1, [("gone", "x", "c.js", 1)], None, "reached depth limit")]
    found = spark.createDataFrame(ways, f"sink string, chain_seq int, hops {hop}, source_mark string, reason string")
    symbols = spark.createDataFrame([("a.js#top@0", 0, 1), ("a.js#low@3", 3, 4)], "id string, start_line int, end_line int")
    files = spark.createDataFrame([("a.js", "l0\nl1\nl2\nl3\nl4\nl5"), ("b.js", "\n".join(f"m{k}" for k in range(20)))], "file string, content string")
    got = {(r["sink"], r["chain_seq"]): r["prompt"].split("\n") for r in verify.verify_prompts(found, verify.hop_sources(found, symbols, files)).collect()}
    number = lambda first, texts: [f"{first + k:5d}| {t}" for k, t in enumerate(texts)]
    assert got["k1", 1] == ["Sink: k1", "Source: source:a.js:1", "Chain:", "1. top (a.js:2)", "2. low (a.js:5)", "Sources:", "### top a.js", *number(1, ["l0", "l1"]), "", "### low a.js", *number(4, ["l3", "l4"]), "Is the chain reachable? Answer with JSON."]
    assert got["k1", 2] == ["Sink: k1", "Entry: top-level code", "Chain:", "1. b.js (b.js:9)", "Sources:", "### b.js b.js", *number(6, [f"m{k}" for k in range(5, 14)]), "Is the chain reachable? Answer with JSON."]
    assert got["k2", 1][5:7] == ["### x c.js", verify.UNAVAILABLE]


def test_lookup_ranks_same_file_first(spark):
    s = spark.createDataFrame([("a/x.js#f@0", "f", "a/x.js", 0, 0), ("a/b/y.js#f@0", "f", "a/b/y.js", 1, 0), ("z.js#f@0", "f", "z.js", 2, 0)], "id string, name string, file string, file_seq long, sym_seq int")
    asked = spark.createDataFrame([(1, "f", "a/b/y.js"), (2, "f", None), (3, "f", "q.js")], "req int, name string, prefer_file string")
    got = {(r["req"], r["place"]): r["id"][0:5] for r in lookup.symbols_by_name(asked, s).collect()}
    assert (got[1, 1], got[2, 1], got[3, 3]) == ("a/b/y", "a/x.j", "z.js#")
    stats = indexing.index_stats(s, s, s).first()
    assert tuple(stats) == (3, 3, 3)
