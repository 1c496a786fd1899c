"""Queries over extraction: programs in three languages, written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinkweave.jobs.bindings import BINDINGS, bind, with_bindings
from sinkweave.operators import extract, rules

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Blocks of 8 lines; ¤ stands for the name of the row.
BLOCKS = {
    ("javascript", "function"): r"""function ¤(a, b = pick(1, 2)) {
  const t_¤ = (x) => wrap(`n ${¤_in(a)} ${`m ${deep(x)}`}`, /[(]/);
  // ghost(1) "
  return chain.first(a)
    .second("(", b);
}
¤_out(1); other(2,
  3);""",
    ("javascript", "class"): r"""class ¤ extends Base {
  field = () => make(0);
  async run(x) {
    return new Worker(x).go();
  }
}
exports.set_¤ = function (v) { this.v = keep(v); };
""",
    ("python", "function"): r'''@route("/¤")
def ¤(a, b=pick(1, 2)):
    """ghost(1)
    import nothing"""
    return chain.first(a)(
        f"{¤_in(b):>{width(2)}} {{no(1)}}")
other(2,
    3)''',
    ("python", "class"): r"""class ¤(Base):
    size = make(0)
    async def run(self, x):
        return (await Worker(x)).go()

    def end(self): pass

last_¤ = keep(1)""",
    ("java", "function"): r"""public class ¤ extends Base<Item> {
  private int v = pick(1, 2);
  @Named("x")
  public List<Map<String, Item>> find(final String a, int[] b) throws Gone {
    return chain.first(a)
      .second("(", new Worker(b) { public void run() { deep(1); } });
  }
}""",
    ("java", "class"): r"""interface ¤ {
  int size(long x);
  enum Kind { ONE(1), TWO(2); }
}
/* ghost(1)
*/
class ¤_impl { ¤_impl() { super(); init(0); } }
""",
}
#: What those lines hold: name, kind, container, first line, last line, signature.
SYMBOLS = {
    ("javascript", "function"): [("¤", "function", None, 0, 5, "(a, b = pick(1, 2))"), ("t_¤", "function", None, 1, 1, None)],
    ("javascript", "class"): [("¤", "class", None, 0, 5, None), ("run", "method", "¤", 2, 4, "(x)"), ("set_¤", "function", None, 6, 6, None)],
    ("python", "function"): [("¤", "function", None, 1, 5, "(a, b=pick(1, 2))")],
    ("python", "class"): [("¤", "class", None, 0, 5, None), ("run", "method", "¤", 2, 3, "(self, x)"), ("end", "method", "¤", 5, 5, "(self)")],
    ("java", "function"): [("¤", "class", None, 0, 7, None), ("find", "method", "¤", 2, 6, "(final String a, int[] b)"), ("run", "method", "¤", 5, 5, "()")],
    ("java", "class"): [("¤", "class", None, 0, 3, None), ("size", "method", "¤", 1, 1, "(long x)"), ("Kind", "class", None, 2, 2, None), ("¤_impl", "class", None, 6, 6, None)],
}
#: Callee, line, name and line of the symbol around, text.
CALLS = {
    ("javascript", "function"): [
        ("pick", 0, "¤", 0, "pick(1, 2)"), ("wrap", 1, "t_¤", 1, "wrap(`n ${¤_in(a)} ${`m ${deep(x)}`}`, /[(]/)"), ("¤_in", 1, "t_¤", 1, "¤_in(a)"), ("deep", 1, "t_¤", 1, "deep(x)"),
        ("second", 3, "¤", 0, 'chain.first(a) .second("(", b)'), ("first", 3, "¤", 0, "chain.first(a)"), ("¤_out", 6, None, None, "¤_out(1)"), ("other", 6, None, None, "other(2, 3)"),
    ],
    ("javascript", "class"): [("make", 1, "¤", 0, "make(0)"), ("go", 3, "run", 2, "new Worker(x).go()"), ("Worker", 3, "run", 2, "new Worker(x)"), ("keep", 6, "set_¤", 6, "keep(v)")],
    ("python", "function"): [
        ("route", 0, None, None, 'route("/¤")'), ("pick", 1, "¤", 1, "pick(1, 2)"), ("a", 4, "¤", 1, 'chain.first(a)( f"{¤_in(b):>{width(2)}} {{no(1)}}")'), ("first", 4, "¤", 1, "chain.first(a)"),
        ("¤_in", 5, "¤", 1, "¤_in(b)"), ("width", 5, "¤", 1, "width(2)"), ("other", 6, None, None, "other(2, 3)"),
    ],
    ("python", "class"): [("make", 1, "¤", 0, "make(0)"), ("go", 3, "run", 2, "(await Worker(x)).go()"), ("Worker", 3, "run", 2, "Worker(x)"), ("keep", 7, None, None, "keep(1)")],
    ("java", "function"): [
        ("pick", 1, "¤", 0, "pick(1, 2)"), ("second", 4, "find", 2, 'chain.first(a) .second("(", new Worker(b) { public void run() { deep(1); } })'), ("first", 4, "find", 2, "chain.first(a)"),
        ("Worker", 5, "run", 5, "new Worker(b) { public void run() { deep(1); } }"), ("deep", 5, "run", 5, "deep(1)"),
    ],
    ("java", "class"): [("init", 6, "¤_impl", 6, "init(0)")],
}


def _value(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(table: dict) -> str:
    return ", ".join(f"({_value(lang)}, {_value(kind)}, {k}, {', '.join(map(_value, row))})" for (lang, kind), rows in table.items() for k, row in enumerate(rows))


# Spark would take the hole's signs for a variable of its own if they stood together
_HOLE = "$' || '{"
_TEXT = " ".join(f"WHEN f.lang = '{lang}' AND s.kind = '{kind}' THEN {_value(text).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39)).replace('{', '{{').replace('}', '}}').replace('${', _HOLE)}" for (lang, kind), text in BLOCKS.items())
BINDINGS["b_programs"] = "SELECT file_seq, file, CASE file_seq % 10 WHEN 0 THEN 'javascript' WHEN 3 THEN 'python' ELSE 'java' END AS lang FROM {b_files} WHERE file_seq % 10 IN (0, 3, 4)"
# a line for each import that the language can write, then the blocks
BINDINGS["b_program_parts"] = f"""
SELECT f.file, f.lang, 0 AS section, i.imp_seq AS seq, i.target AS name, 'import' AS kind,
  CASE f.lang WHEN 'javascript' THEN 'import x from "' || i.target || '"; // import y from "z"' WHEN 'python' THEN 'from ' || i.target || ' import x' ELSE 'import ' || i.target || ';' END AS text
FROM {{b_programs}} f JOIN {{b_imports}} i ON i.file = f.file AND (f.lang = 'javascript' OR i.imp_seq % 4 > 1)
UNION ALL SELECT f.file, f.lang, 1, CAST(s.sym_seq AS BIGINT), s.name, s.kind, replace(CASE {_TEXT} END, '¤', s.name)
FROM {{b_programs}} f JOIN {{b_symbols}} s ON s.file = f.file"""


def register(name: str, sql: str, **more: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE[name] = with_bindings(sql, **more)
        return f

    return keep


def _indexed(spark, sf_dir):
    parts = bind(spark, sf_dir, "b_program_parts")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "seq", "text"))), lambda p: p["text"]), "\n")
    return extract.extract_index(rules.detect_language(parts.groupBy("file").agg(text.alias("content"))))


PLACED = """
SELECT p.file, p.lang, p.kind, p.name, p.seq, (SELECT count(*) FROM b_program_parts i WHERE i.file = p.file AND i.section = 0) + 8 * (row_number() OVER (PARTITION BY p.file ORDER BY p.seq) - 1) AS base
FROM b_program_parts p WHERE p.section = 1"""


@register("extract_symbols", f"""
SELECT p.file, CAST(row_number() OVER (PARTITION BY p.file ORDER BY p.seq, x.k) - 1 AS INTEGER) AS sym_seq, replace(x.name, '¤', p.name) AS name, x.kind, replace(x.container, '¤', p.name) AS container,
  CAST(base + x.a AS INTEGER) AS start_line, CAST(base + x.b AS INTEGER) AS end_line, replace(x.signature, '¤', p.name) AS signature, p.file || '#' || replace(x.name, '¤', p.name) || '@' || CAST(base + x.a AS INTEGER) AS id
FROM placed p JOIN (VALUES {_values(SYMBOLS)}) x(lang, block, k, name, kind, container, a, b, signature) ON x.lang = p.lang AND x.block = p.kind""", placed=PLACED)
def extract_symbols(spark, sf_dir):
    """Definitions of whole programs: nested, assigned, with defaults that hold brackets."""
    return extract.extract_symbols(_indexed(spark, sf_dir))


@register("extract_program_calls", f"""
SELECT p.file, CAST(row_number() OVER (PARTITION BY p.file ORDER BY p.seq, x.k) - 1 AS INTEGER) AS call_seq, replace(x.callee, '¤', p.name) AS callee, CAST(base + x.a AS INTEGER) AS line,
  p.file || '#' || replace(x.own, '¤', p.name) || '@' || CAST(base + x.own_at AS INTEGER) AS from_symbol, replace(x.text, '¤', p.name) AS text
FROM placed p JOIN (VALUES {_values(CALLS)}) x(lang, block, k, callee, a, own, own_at, text) ON x.lang = p.lang AND x.block = p.kind""", placed=PLACED)
def extract_program_calls(spark, sf_dir):
    """Calls of whole programs: chains over lines, template holes, anonymous bodies, comments that look like calls."""
    return extract.extract_calls(_indexed(spark, sf_dir))


@register("extract_imports", """
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS INTEGER) AS imp_seq, name AS target
FROM (SELECT file, name, min(seq) AS seq FROM b_program_parts WHERE section = 0 GROUP BY file, name)""")
def extract_imports(spark, sf_dir):
    return extract.extract_imports(_indexed(spark, sf_dir))
