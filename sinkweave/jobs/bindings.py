"""Test bindings: portable SQL views that turn the driver's tables into the library's inputs.

Names in braces are tables or other bindings; the same text runs in Spark and, without the braces,
in the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BINDINGS = {
    "b_files": """
SELECT CAST(s_suppkey AS BIGINT) AS file_seq,
  CASE WHEN s_suppkey % 10 < 6 THEN 'src/' ELSE '' END || 'm' || s_nationkey || '/p' || (s_suppkey % 3) || '/f' || s_suppkey ||
  CASE s_suppkey % 10 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' WHEN 2 THEN '.tsx' WHEN 3 THEN '.py' WHEN 4 THEN '.java'
    WHEN 5 THEN '.go' WHEN 6 THEN '.php' WHEN 7 THEN '.c' WHEN 8 THEN '.cpp' ELSE '.cs' END AS file
FROM {supplier}""",
    "b_symbols": """
SELECT f.file_seq, f.file, p.sym_seq, p.name, p.kind, f.file || '#' || p.name || '@' || (p.sym_seq * 10) AS id,
  p.sym_seq * 10 AS start_line, p.sym_seq * 10 + CASE WHEN p.kind = 'class' THEN 28 ELSE 8 END AS end_line
FROM (SELECT p_partkey % n.k AS fk, CAST(floor(p_partkey / n.k) AS INT) AS sym_seq,
        CASE WHEN p_partkey % 7 = 0 THEN 'hot_' || (p_partkey % 21) ELSE 'fn_' || (p_partkey - p_partkey % 2) END AS name,
        CASE WHEN p_size % 10 = 0 THEN 'class' ELSE 'function' END AS kind
      FROM {part} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n) p
JOIN {b_files} f ON f.file_seq = p.fk""",
    "b_calls": """
SELECT f.file_seq, f.file, CAST(l.l_orderkey % 200 AS INT) AS line,
  CASE WHEN l.l_partkey % 7 = 0 THEN 'hot_' || (l.l_partkey % 21) ELSE 'fn_' || (l.l_partkey - l.l_partkey % 2) END AS callee,
  row_number() OVER (PARTITION BY l.l_suppkey ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice, l.l_shipdate) AS call_seq
FROM {lineitem} l JOIN {b_files} f ON f.file_seq = l.l_suppkey""",
    "b_lines": """
SELECT f.file_seq, f.file, row_number() OVER (PARTITION BY l.l_suppkey ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice, l.l_shipdate) - 1 AS line,
  CASE l.l_linenumber WHEN 1 THEN '  const q = req.query.id;' WHEN 2 THEN '  el.innerHTML = q' || l.l_partkey || ';'
    WHEN 3 THEN '  token = os.environ["T"]' WHEN 4 THEN '  $c = $_GET["c"];' WHEN 5 THEN '  exec.Command("sh")'
    ELSE '  fn_' || l.l_partkey || '(x);' END AS text
FROM {lineitem} l JOIN {b_files} f ON f.file_seq = l.l_suppkey""",
    "b_imports": """
SELECT f.file_seq, f.file, o.o_orderkey AS imp_seq,
  CASE o.o_orderkey % 4 WHEN 0 THEN '../../../' || regexp_replace(t.file, '[.][a-z]+$', '')
    WHEN 1 THEN 'f' || t.file_seq || '.c' WHEN 2 THEN 'p' || (t.file_seq % 3) || '.f' || t.file_seq ELSE 'ext' || t.file_seq END AS target
FROM {orders} o CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n
JOIN {b_files} f ON f.file_seq = o.o_orderkey % n.k
JOIN {b_files} t ON t.file_seq = o.o_custkey % n.k""",
    "b_marks": """
SELECT kind || ':' || file || ':' || line AS id, kind, file, line, status, origin, category, event_id
FROM (SELECT CASE WHEN e.event_id % 2 = 0 THEN 'source' ELSE 'sink' END AS kind, f.file,
        CAST(floor(e.event_id / 3) AS BIGINT) % 200 + 1 AS line, e.event_id,
        CASE e.event_type WHEN 'click' THEN 'confirmed' WHEN 'error' THEN 'excluded' ELSE 'candidate' END AS status,
        CASE WHEN e.event_type = 'purchase' THEN 'manual' ELSE 'scan' END AS origin, 'cat' || (e.user_id % 5) AS category,
        row_number() OVER (PARTITION BY e.event_id % 2, f.file, CAST(floor(e.event_id / 3) AS BIGINT) % 200 ORDER BY e.event_id) AS rn
      FROM {events} e CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n JOIN {b_files} f ON f.file_seq = e.event_id % n.k) x
WHERE rn = 1""",
    "b_decisions": """
SELECT e.event_id AS seq, e.ts, CASE WHEN e.event_id % 2 = 0 THEN 'source' ELSE 'sink' END || ':' || f.file || ':' || (CAST(floor(e.event_id / 3) AS BIGINT) % 200 + 1) AS id,
  CASE e.event_type WHEN 'click' THEN 'confirm' WHEN 'error' THEN 'exclude' WHEN 'view' THEN 'restore' WHEN 'purchase' THEN 'manual' ELSE 'delete' END AS action,
  'u' || (e.user_id % 7) AS author
FROM {events} e CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n JOIN {b_files} f ON f.file_seq = e.event_id % n.k""",
    "b_paths": """
SELECT page_id AS file_seq, regexp_replace(regexp_extract(url, '^https?://([^?#]+)', 1), '/+$', '') AS file,
  length(html) - length(replace(html, chr(10), '')) + 1 AS lines
FROM {pages}""",
    "b_docs": "SELECT doc_id AS file_seq, source || '/' || lang || '/d' || doc_id || '.py' AS file, text AS content FROM {documents}",
    "b_analyses": """
SELECT source || '/' || lang || '/d' || doc_id || '.py' AS path, CASE WHEN doc_id % 5 = 0 THEN sha1(text || 'x') ELSE sha1(text) END AS content_hash
FROM {documents} WHERE doc_id % 3 <> 0""",
    "b_replies": """
SELECT doc_id, line_count, CASE doc_id % 4 WHEN 0 THEN j WHEN 1 THEN repeat(chr(96), 3) || 'json' || chr(10) || j || chr(10) || repeat(chr(96), 3)
    WHEN 2 THEN 'Here is the result: ' || j || ' That is all.' ELSE 'not json ' || doc_id END AS reply
FROM (SELECT d.doc_id, d.n_chars % 100 + 1 AS line_count,
        '{{"summary":"s' || d.doc_id || '","functions":[{{"name":"f","line":' || (d.n_chars % 50)
        || ',"description":"d"}},{{"name":"g","line":3}}],"issues":[{{"title":"t","cwe":"","severity":"'
        || CASE WHEN l.toxic = 1 THEN 'high' WHEN l.quality = 1 THEN 'low' ELSE 'critical' END
        || '","confidence":"medium","startLine":' || (d.n_chars % 300) || ',"endLine":2,"reason":"r"}}],"attention":[]}}' AS j
      FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id) x""",
    "b_messages": "SELECT conv_id, turn, role, text AS content FROM {conversations}",
    "b_parts": """
SELECT conv_id, turn, CASE conv_id % 3
  WHEN 0 THEN '{{"parts":[{{"type":"reasoning","text":"skip"}},{{"type":"text","text":"' || role || ' "}},{{"type":"text","text":"' || turn || '"}}]}}'
  WHEN 1 THEN '{{"info":{{"parts":[{{"type":"text","text":"' || role || '"}}]}}}}'
  ELSE '{{"info":{{"content":"' || role || '"}},"parts":[]}}' END AS payload
FROM {conversations}""",
}
_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")
#: A count that every row is crossed with.
_COUNT = re.compile(r"\s*CROSS JOIN \((SELECT count\(\*\)) AS k (FROM \{\w+\})\) n\b")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir, or a binding over its tables."""
    if name not in BINDINGS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = counts_inline(BINDINGS[name])
    return spark.sql(sql, **{n: bind(spark, sf_dir, n) for n in sorted(set(_NAME.findall(sql)))})


def counts_inline(sql: str) -> str:
    """The text as Spark runs it: a count is a scalar subquery where it is used, not a table of one row. Of three
    tables, two meet by the third's count; once a later join asks for a column of those two that is not null,
    Spark joins them by that alone, as a nested loop over all pairs."""
    for count, source in _COUNT.findall(sql):
        sql = re.sub(r"\bn\.k\b", lambda m, c=count, s=source: f"({c} {s})", sql)
    return _COUNT.sub("", sql)


def with_bindings(sql: str, **more: str) -> str:
    """Oracle SQL with the bindings that it names put before it; ``more`` adds expressions of its own."""
    known = BINDINGS | more
    order: list[str] = []

    def visit(text: str, inside: tuple[str, ...] = ()) -> None:
        for n in sorted(set(re.findall(r"\w+", text)) & known.keys() - set(inside)):
            if n not in order:
                visit(known[n], (*inside, n))
                if n not in order:
                    order.append(n)

    visit(sql)
    plain = {n: _NAME.sub(r"\1", known[n]).replace("{{", "{").replace("}}", "}") for n in order}
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in plain.items()) + "\n" + sql if order else sql
