"""Look-ups and the scan's summary against brute force, and what their plans move."""

import random
import re

from sinkweave.operators import lookup, rules, taint


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_are_counted_not_sorted_for(spark):
    rnd = random.Random(3)
    files = ["a/x", "a/b/y", "a/b/z", "c/x", "r", "q"]
    defs = [(f"{n}{k}", rnd.choice("fg"), files[n], n, k) for n in range(6) for k in range(rnd.randint(0, 5))]
    asked = [(k, rnd.choice("fgh"), rnd.choice([*files, "a/b/none", "none", None])) for k in range(40)]
    s = spark.createDataFrame(defs, "id string, name string, file string, file_seq long, sym_seq int")
    found = lookup.symbols_by_name(spark.createDataFrame(asked, "req int, name string, prefer_file string"), s)
    want = []
    for req, name, prefer in asked:
        above = "" if prefer is None else prefer[: prefer.rfind("/") + 1]
        rank = lambda d, p=prefer, a=above: 0 if p is None or d[2] == p else 1 if d[2].startswith(a) else 2
        want += [(req, d[0], n + 1) for n, d in enumerate(sorted((d for d in defs if d[1] == name), key=lambda d: (rank(d), d[3], d[4])))]
    assert sorted((r["req"], r["id"], r["place"]) for r in found.collect()) == sorted(want)
    plan = _plan(found)
    assert plan.index("Join") < plan.index("Window")  # ranked before requests and definitions meet


def test_runs_of_a_file_move_as_one_row(spark):
    files = spark.createDataFrame([(0, "a", "needle here"), (1, "b", "need the eedle")], "file_seq int, file string, content string")
    read = lookup.files_to_read(spark.createDataFrame([("needle",), ("zzzz",)], "query string"), files, lookup.text_postings(files))
    assert sorted(map(tuple, read.collect())) == [("needle", "a"), ("needle", "b")]
    assert not re.search(r"Join Inner, \([^\n]*file#\d+ = file#\d+\) AND \(gram#|Join Inner, \([^\n]*gram#\d+ = gram#\d+\) AND \(file#", _plan(read))


def test_marks_are_counted_without_symbols(spark):
    calls = spark.createDataFrame([(0, "a.c", "c", 1, 0, "gets"), (0, "a.c", "c", 2, 0, "gets"), (0, "p.py", "python", 1, 3, "eval")], "file_seq long, file string, language_id string, call_seq long, line int, callee string")
    lines = spark.createDataFrame([(0, "a.js", "javascript", 1, "xreq.query"), (0, "a.js", "javascript", 2, " req.query.id")], "file_seq long, file string, language_id string, line int, text string")
    symbols = spark.createDataFrame([("a.c#f@0", "f", "a.c", 0, 0, 9), ("a.c#g@0", "g", "a.c", 1, 0, 5)], "id string, name string, file string, sym_seq int, start_line int, end_line int")
    whole = taint.scan_taint(lines, calls, symbols, rules.rules_table(spark)).select("id", "status", "origin").collect()
    assert whole and sorted(taint.scan_ids(lines, calls, rules.rules_table(spark)).collect()) == sorted(whole)
    old = spark.createDataFrame([(whole[0]["id"], "confirmed", "scan"), ("sink:gone:1", "candidate", "manual")], "id string, status string, origin string")
    ids = taint.scan_ids(lines, calls, rules.rules_table(spark))
    assert tuple(taint.scan_summary(ids, taint.merge_candidates(old, ids)).first()) == (len(whole), len(whole) - 1)
