"""Queries over imports, modules, directories and call chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinkweave.functions.text import normalize_path as normalized
from sinkweave.jobs import queries_index
from sinkweave.jobs.bindings import bind, with_bindings
from sinkweave.operators import chains, indexing, structure

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, **more: str):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = with_bindings(sql, **more)
        return f

    return keep


FILES = "SELECT f.file_seq, f.file, coalesce(n.lines, 0) AS lines FROM b_files f LEFT JOIN (SELECT file, count(*) AS lines FROM b_lines GROUP BY file) n USING (file)"
RESOLVED = r"""
SELECT i.file, i.imp_seq, i.target, CASE WHEN starts_with(i.target, '.') THEN r.file WHEN regexp_matches(i.target, '\.(h|hpp|hh|c|cpp|php)$') THEN coalesce(n.file, x.file) ELSE d.file END AS resolved
FROM b_imports i
LEFT JOIN b_files r ON starts_with(i.target, '.') AND regexp_replace(r.file, '\.[^./]+$', '') = regexp_replace(i.target, '^(\.\./)+', '')
LEFT JOIN b_files n ON n.file = regexp_replace(i.file, '[^/]*$', '') || i.target
LEFT JOIN sfx x ON x.suffix = i.target
LEFT JOIN sfx0 d ON d.suffix = replace(i.target, '.', '/')"""
SUFFIX = "SELECT suffix, arg_min(file, file_seq) AS file FROM (SELECT file, file_seq, array_to_string(p[unnest(range(1, len(p) + 1)):], '/') AS suffix FROM (SELECT file, file_seq, string_split({path}, '/') AS p FROM b_files)) GROUP BY suffix"
CALL_EDGES = """
SELECT c.file AS src, d.file AS dst, sum(c.n) AS weight
FROM (SELECT file, callee, count(*) AS n FROM b_calls GROUP BY ALL) c JOIN (SELECT DISTINCT name, file FROM b_symbols WHERE kind <> 'class') d ON d.name = c.callee AND d.file <> c.file
WHERE (SELECT count(*) FROM b_symbols s WHERE s.name = c.callee AND s.kind <> 'class' AND s.file <> c.file) BETWEEN 1 AND 3 GROUP BY ALL"""
FILE_EDGES = "SELECT src, dst, sum(weight) AS weight FROM (SELECT file AS src, resolved AS dst, 1 AS weight FROM rslv WHERE resolved IS NOT NULL UNION ALL SELECT * FROM call_edges) WHERE src <> dst GROUP BY ALL"
ASSIGNED = """
SELECT file, CASE WHEN len(p) = 1 THEN '(root)' WHEN len(p) > 2 AND p[1] IN (
  SELECT top FROM (SELECT string_split(file, '/')[1] AS top, count(*) AS n, max(len(string_split(file, '/'))) AS deep FROM {files} WHERE contains(file, '/') GROUP BY 1) WHERE 2 * n > (SELECT count(*) FROM {files}) AND deep > 2)
  THEN p[1] || '/' || p[2] ELSE p[1] END AS module FROM (SELECT file, string_split(file, '/') AS p FROM {files})"""
FOLDED = "SELECT file, CASE WHEN module IN (SELECT module FROM assigned GROUP BY module ORDER BY count(*) DESC, module LIMIT 24) THEN module ELSE '(other)' END AS module FROM assigned"
SAMPLES = """
SELECT * FROM (SELECT a.module, f.file, row_number() OVER (PARTITION BY a.module ORDER BY coalesce(s.n, 0) DESC, f.file_seq) AS place FROM folded a JOIN files f ON f.file = a.file
  LEFT JOIN (SELECT file, count(*) AS n FROM b_symbols GROUP BY file) s ON s.file = a.file) WHERE place <= 5"""
MODULES = "SELECT a.module, count(*) AS file_count, sum(f.lines) AS loc FROM folded a JOIN files f ON f.file = a.file GROUP BY a.module"
MODULE_EDGES = 'SELECT a.module AS "from", b.module AS "to", sum(e.weight) AS weight FROM file_edges e JOIN folded a ON a.file = e.src JOIN folded b ON b.file = e.dst WHERE a.module <> b.module GROUP BY ALL'
DIRS = """
SELECT array_to_string(p[1:i], '/') AS dir, CAST(i AS INTEGER) AS depth, CASE WHEN i > 0 THEN array_to_string(p[1:i - 1], '/') END AS parent, count(*) AS file_count, sum(lines) AS loc
FROM (SELECT p, lines, unnest(range(0, len(p))) AS i FROM (SELECT string_split(file, '/') AS p, lines FROM b_paths)) GROUP BY ALL"""
TREE = """
SELECT dir, depth, parent, file_count, loc, place, hidden, elided FROM (
  SELECT d.*, row_number() OVER (PARTITION BY parent ORDER BY file_count DESC, dir) AS place, greatest(count(*) OVER (PARTITION BY parent) - 30, 0) AS hidden, d.dir IN (SELECT parent FROM dirs WHERE depth = 4) AND depth = 3 AS elided
  FROM dirs d WHERE depth BETWEEN 1 AND 3) WHERE place <= 30"""
SHOWN = "SELECT * FROM tree t WHERE depth = 1 OR (depth = 2 AND parent IN (SELECT dir FROM tree WHERE depth = 1)) OR (depth = 3 AND parent IN (SELECT dir FROM tree WHERE depth = 2 AND parent IN (SELECT dir FROM tree WHERE depth = 1)))"
BASE = dict(files=FILES, sfx=SUFFIX.format(path="file"), sfx0=SUFFIX.format(path=r"regexp_replace(file, '\.[^./]+$', '')"), rslv=RESOLVED, call_edges=CALL_EDGES, file_edges=FILE_EDGES,
            assigned=ASSIGNED.format(files="b_files"), folded=FOLDED, samples=SAMPLES, modules=MODULES, module_edges=MODULE_EDGES, dirs=DIRS, tree=TREE, shown=SHOWN)


def files(spark, sf_dir):
    lines = bind(spark, sf_dir, "b_lines").groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
    return bind(spark, sf_dir, "b_files").join(lines, "file", "left").fillna(0, ["lines"])


@register("normalize_path", r"SELECT file, imp_seq, regexp_replace(regexp_replace(target, '^(\.\./)+', ''), '/\./', '/') AS path FROM b_imports")
def normalize_path(spark, sf_dir):
    return bind(spark, sf_dir, "b_imports").select("file", "imp_seq", normalized(F.col("target")).alias("path"))


@register("resolve_imports", "SELECT * FROM rslv", **BASE)
def resolve_imports(spark, sf_dir):
    return structure.resolve_imports(bind(spark, sf_dir, "b_imports").select("file", "imp_seq", "target"), bind(spark, sf_dir, "b_files"))


@register("call_edges", "SELECT * FROM call_edges", **BASE)
def call_edges(spark, sf_dir):
    return structure.call_edges(bind(spark, sf_dir, "b_calls"), bind(spark, sf_dir, "b_symbols"))


@register("file_edges", "SELECT * FROM file_edges", **BASE)
def file_edges(spark, sf_dir):
    return structure.file_edges(resolve_imports(spark, sf_dir), call_edges(spark, sf_dir))


@register("assign_modules", "SELECT * FROM assigned", **BASE)
def assign_modules(spark, sf_dir):
    return structure.assign_modules(bind(spark, sf_dir, "b_files"))


@register("assign_modules_pages", "SELECT * FROM assigned", assigned=ASSIGNED.format(files="b_paths"))
def assign_modules_pages(spark, sf_dir):
    return structure.assign_modules(bind(spark, sf_dir, "b_paths"))


@register("fold_small_modules", "SELECT * FROM folded", **BASE)
def fold_small_modules(spark, sf_dir):
    return structure.fold_small_modules(assign_modules(spark, sf_dir))


def modules(spark, sf_dir):
    return structure.module_stats(fold_small_modules(spark, sf_dir), files(spark, sf_dir), bind(spark, sf_dir, "b_symbols"))


@register("module_stats", "SELECT m.*, (SELECT string_agg(file, ', ' ORDER BY place) FROM samples s WHERE s.module = m.module) AS samples FROM modules m", **BASE)
def module_stats(spark, sf_dir):
    return modules(spark, sf_dir).withColumn("samples", F.array_join("sample_files", ", ")).drop("sample_files")


@register("module_edges", "SELECT * FROM module_edges", **BASE)
def module_edges(spark, sf_dir):
    return structure.module_edges(file_edges(spark, sf_dir), fold_small_modules(spark, sf_dir))


@register("dir_rollup", "SELECT * FROM dirs", **BASE)
def dir_rollup(spark, sf_dir):
    return structure.dir_rollup(bind(spark, sf_dir, "b_paths"))


@register("dir_tree_top", "SELECT * FROM shown", **BASE)
def dir_tree_top(spark, sf_dir):
    return structure.dir_tree_top(dir_rollup(spark, sf_dir))


@register("annotate_tree", """
SELECT d.dir, d.file_count, d.loc, CASE WHEN m.module <> '(other)' THEN 'about ' || m.module END AS description,
  (SELECT string_agg("to", ', ' ORDER BY weight DESC, "to") FROM (SELECT *, row_number() OVER (PARTITION BY "from" ORDER BY weight DESC, "to") AS k FROM module_edges) e WHERE e."from" = d.dir AND k <= 4) AS depends_on
FROM (SELECT dir, file_count, loc FROM shown UNION ALL SELECT dir, file_count, loc FROM dirs WHERE depth = 0) d LEFT JOIN modules m ON m.module = CASE WHEN d.dir = '' THEN '(root)' ELSE d.dir END""",
    **(BASE | {"dirs": DIRS.replace("b_paths", "files")}))
def annotate_tree(spark, sf_dir):
    dirs = structure.dir_rollup(files(spark, sf_dir))
    told = modules(spark, sf_dir).withColumn("description", F.when(F.col("module") != structure.OTHER, F.concat(F.lit("about "), F.col("module"))))
    return structure.annotate_tree(structure.dir_tree_top(dirs), dirs, told, module_edges(spark, sf_dir))


@register("module_digest", """
SELECT m.module, 'Module ' || m.module || ' (' || m.file_count || ' files, ' || m.loc || ' LOC)' || chr(10) || '  representative files: ' || (SELECT string_agg(file, ', ' ORDER BY place) FROM samples s WHERE s.module = m.module)
  || coalesce(chr(10) || '  main symbols: ' || n.names, '') || coalesce(chr(10) || t.notes, '') AS digest
FROM modules m
LEFT JOIN (SELECT module, string_agg(name, ', ' ORDER BY k) AS names FROM (SELECT s.module, y.name, row_number() OVER (PARTITION BY s.module ORDER BY s.place, y.sym_seq) AS k FROM samples s JOIN b_symbols y ON y.file = s.file) WHERE k <= 12 GROUP BY module) n ON n.module = m.module
LEFT JOIN (SELECT module, string_agg('  existing file summary: sum ' || file, chr(10) ORDER BY k) AS notes FROM (SELECT s.module, s.file, row_number() OVER (PARTITION BY s.module ORDER BY s.place) AS k FROM samples s JOIN b_files f ON f.file = s.file AND f.file_seq % 3 <> 0) WHERE k <= 2 GROUP BY module) t ON t.module = m.module
WHERE m.module <> '(other)'""", **BASE)
def module_digest(spark, sf_dir):
    stored = bind(spark, sf_dir, "b_files").filter("file_seq % 3 <> 0").select(F.col("file").alias("path"), F.concat(F.lit("sum "), "file").alias("summary"))
    return structure.module_digest(modules(spark, sf_dir), bind(spark, sf_dir, "b_symbols"), stored)


@register("merge_annotations", "SELECT module, CASE WHEN file_count % 2 = 0 THEN 'second ' || module ELSE 'first ' || module END AS description FROM modules", **BASE)
def merge_annotations(spark, sf_dir):
    own = modules(spark, sf_dir).select("module", "file_count")
    said = F.collect_list(F.struct(F.col("module").alias("name"), F.concat(F.lit("first "), "module").alias("description")))
    later = F.collect_list(F.struct(F.col("module").alias("name"), F.when(F.col("file_count") % 2 == 0, F.concat(F.lit("second "), "module")).otherwise("").alias("description")))
    replies = own.agg(F.to_json(F.struct(F.concat(said, later).alias("modules"))).alias("reply"))
    return structure.merge_annotations(own.select("module"), replies)


@register("report_modules", "SELECT m.module, m.file_count, m.loc, (SELECT string_agg(file, ', ' ORDER BY place) FROM samples s WHERE s.module = m.module AND place <= 3) AS samples FROM modules m", **BASE)
def report_modules(spark, sf_dir):
    return structure.report_tables(modules(spark, sf_dir), module_edges(spark, sf_dir))[0]


@register("report_edges", 'SELECT * FROM module_edges ORDER BY weight DESC, "from", "to" LIMIT 40', **BASE)
def report_edges(spark, sf_dir):
    return structure.report_tables(modules(spark, sf_dir), module_edges(spark, sf_dir))[1]


# ---- chains

ENCLOSED = queries_index.ENCLOSED
EDGES = """
SELECT callee, coalesce(from_symbol, '__top__:' || file) AS caller, arg_min(line + 1, (file_seq, call_seq)) AS line, arg_min(file, (file_seq, call_seq)) AS file FROM enclosed GROUP BY 1, 2"""
SINKS = "SELECT id, file, line FROM b_marks WHERE kind = 'sink' AND status <> 'excluded'"


def _calls(spark, sf_dir):
    return indexing.attach_from_symbol(bind(spark, sf_dir, "b_calls"), bind(spark, sf_dir, "b_symbols"))


def _marks(spark, sf_dir):
    return bind(spark, sf_dir, "b_marks").withColumn("mark_seq", F.col("event_id"))


@register("caller_edges", "SELECT * FROM edges", enclosed=ENCLOSED, edges=EDGES)
def caller_edges(spark, sf_dir):
    return chains.caller_edges(_calls(spark, sf_dir)).select("callee", "caller", "line", "file")


def _anchored(spark, sf_dir):
    return chains.anchor_sinks(_marks(spark, sf_dir).filter("kind = 'sink' and status <> 'excluded'").select("id", "file", "line"), bind(spark, sf_dir, "b_symbols"))


@register("anchor_sinks", "SELECT k.id, arg_min(s.id, (s.end_line - s.start_line, s.sym_seq)) AS sym_id FROM sinks k LEFT JOIN b_symbols s ON s.file = k.file AND k.line - 1 BETWEEN s.start_line AND s.end_line GROUP BY k.id", sinks=SINKS)
def anchor_sinks(spark, sf_dir):
    return _anchored(spark, sf_dir).select("id", "sym_id")


@register("symbols_with_source", "SELECT s.id, arg_min(m.id, m.event_id) AS source_mark FROM b_symbols s JOIN b_marks m ON m.file = s.file AND m.line - 1 BETWEEN s.start_line AND s.end_line WHERE m.kind = 'source' AND m.status <> 'excluded' GROUP BY s.id")
def symbols_with_source(spark, sf_dir):
    return chains.symbols_with_source(bind(spark, sf_dir, "b_symbols"), _marks(spark, sf_dir))


def _chains(spark, sf_dir, **limits):
    return chains.expand_chains(_anchored(spark, sf_dir), chains.caller_edges(_calls(spark, sf_dir)), bind(spark, sf_dir, "b_symbols"), symbols_with_source(spark, sf_dir), **limits)


def terminal(spark, sf_dir):
    """Chains of depth 0: of the calls only the names that they call matter."""
    symbols = bind(spark, sf_dir, "b_symbols")
    return chains.expand_chains(_anchored(spark, sf_dir), bind(spark, sf_dir, "b_calls").select("callee"), symbols, symbols_with_source(spark, sf_dir), max_depth=0)


@register("expand_chains")
def expand_chains(spark, sf_dir):
    return chains.chain_labels(_chains(spark, sf_dir))


# depth 0: every sink ends where it stands, which SQL can say without iteration
@register("terminal_chains", """
SELECT x.id AS sink, CASE WHEN x.s.id IS NULL THEN 'top-level code' WHEN x.s.name IN (ENTRY_NAMES) THEN 'entry function ' || x.s.name
  WHEN x.s.name IN (SELECT callee FROM b_calls) THEN 'reached depth limit' ELSE 'no callers (possible framework entry)' END AS reason, CASE WHEN x.s.id IS NULL THEN 0 ELSE 59 END AS score
FROM (SELECT k.id, arg_min(s, (s.end_line - s.start_line, s.sym_seq)) AS s FROM sinks k LEFT JOIN b_symbols s ON s.file = k.file AND k.line - 1 BETWEEN s.start_line AND s.end_line GROUP BY k.id) x""".replace("ENTRY_NAMES", ", ".join(f"'{n}'" for n in chains.ENTRY_NAMES)), sinks=SINKS)
def terminal_chains(spark, sf_dir):
    return terminal(spark, sf_dir).select("sink", "reason", "score")


# depth 3: every walk of three callers, a level at a time, by a recursive query
CALLERS = """
SELECT e.callee, e.caller, e.line, s.id AS c_id, s.name AS c_name, s.file AS c_file, w.source_mark AS src, e.at
FROM (SELECT callee, coalesce(from_symbol, '__top__:' || file) AS caller, max(from_symbol) AS from_symbol, arg_min(line + 1, (file_seq, call_seq)) AS line, min((file_seq, call_seq)) AS at FROM enclosed GROUP BY 1, 2) e
LEFT JOIN b_symbols s ON s.id = e.from_symbol
LEFT JOIN (SELECT s.id, arg_min(m.id, m.event_id) AS source_mark FROM b_symbols s JOIN b_marks m ON m.file = s.file AND m.line - 1 BETWEEN s.start_line AND s.end_line WHERE m.kind = 'source' AND m.status <> 'excluded' GROUP BY s.id) w ON w.id = s.id"""
STARTS = """
SELECT k.id, k.file, CAST(k.line AS INTEGER) AS line, arg_min(s, (s.end_line - s.start_line, s.sym_seq)) AS s
FROM sinks k LEFT JOIN b_symbols s ON s.file = k.file AND k.line - 1 BETWEEN s.start_line AND s.end_line GROUP BY k.id, k.file, k.line"""
WALK = """
SELECT id AS sink, CAST([] AS INTEGER[]) AS key, s.id IS NOT NULL AS open, 0 AS depth, s.name AS name, s.file AS node_file,
  [{'symbol_id': s.id, 'name': coalesce(s.name, regexp_extract(file, '[^/]*$')), 'file': file, 'line': line}] AS hops, [s.id] AS path, CAST(NULL AS VARCHAR) AS source_mark, CASE WHEN s.id IS NULL THEN 'top-level code' END AS reason
FROM starts
UNION ALL
SELECT sink, CASE WHEN ends THEN key ELSE key || [CAST(place AS INTEGER)] END, NOT ends AND c_id IS NOT NULL AND src IS NULL, depth + 1, CASE WHEN c_id IS NULL THEN NULL ELSE c_name END, c_file,
  CASE WHEN ends THEN hops ELSE [{'symbol_id': c_id, 'name': coalesce(c_name, node_file || ' (top level)'), 'file': coalesce(c_file, node_file), 'line': CAST(c_line AS INTEGER)}] || hops END,
  CASE WHEN ends THEN path ELSE [c_id] || path END, CASE WHEN NOT ends THEN src END,
  CASE WHEN NOT ends THEN CASE WHEN c_id IS NULL THEN 'module top-level call' END WHEN has AND depth < 3 THEN 'chain cycles here'
    WHEN name IN (ENTRY_NAMES) THEN 'entry function ' || name WHEN has THEN 'reached depth limit' ELSE 'no callers (possible framework entry)' END
FROM (
  SELECT *, NOT has OR depth >= 3 OR n_free = 0 AS ends FROM (
    SELECT w.*, c.c_id, c.c_name, c.c_file, c.src, c.line AS c_line, cyclic, bool_or(c.caller IS NOT NULL) OVER (PARTITION BY w.sink, w.key) AS has, count(*) FILTER (WHERE NOT cyclic) OVER (PARTITION BY w.sink, w.key) AS n_free,
      row_number() OVER (PARTITION BY w.sink, w.key, cyclic ORDER BY CASE WHEN c.c_file = w.node_file THEN 0 ELSE 1 END, c.at, c.caller) AS place
    FROM (SELECT w.*, c, c.caller IS NULL OR (c.c_id IS NOT NULL AND list_contains(w.path, c.c_id)) AS cyclic FROM walk w LEFT JOIN callers c ON c.callee = w.name WHERE w.open) w))
WHERE (ends AND place = 1 AND (cyclic OR n_free > 0) AND (n_free = 0 OR NOT cyclic)) OR (NOT ends AND NOT cyclic AND place <= 8)""".replace("ENTRY_NAMES", ", ".join(f"'{n}'" for n in chains.ENTRY_NAMES))
SCORED = """
SELECT *, row_number() OVER (PARTITION BY sink ORDER BY score DESC, key) AS chain_seq FROM (
  SELECT *, CASE WHEN reason = 'top-level code' THEN 0 ELSE CASE WHEN source_mark IS NOT NULL THEN 100 ELSE 0 END + CASE WHEN reason IS NOT NULL THEN 40 ELSE 0 END + greatest(0, 20 - len(hops)) END AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY key) AS nth FROM walk WHERE NOT open) WHERE nth <= 20)"""
DEEP = dict(sinks=SINKS, enclosed=ENCLOSED, callers=CALLERS, starts=STARTS, walk=WALK, scored=SCORED)
LABELS = "SELECT sink, CAST(chain_seq AS INTEGER) AS chain_seq, score, hops[1].name || ' → … → ' || hops[-1].name AS label, CAST(len(hops) AS INTEGER) AS n_hops, coalesce(reason, 'reaches Source') AS detail, array_to_string([h.name FOR h IN hops], ' → ') AS path FROM scored"


def deep_chains(spark, sf_dir):
    return _chains(spark, sf_dir, max_depth=3)


def recursive(*names: str, oracle: dict[str, str] = ORACLE) -> None:
    """Marks oracles that walk as recursive, with what each level reads computed once."""
    for n in names:
        oracle[n] = oracle[n].replace("WITH ", "WITH RECURSIVE ", 1).replace("\ncallers AS (", "\ncallers AS MATERIALIZED (")


@register("expand_chains_3", LABELS, **DEEP)
def expand_chains_3(spark, sf_dir):
    return chains.chain_labels(deep_chains(spark, sf_dir))


@register("best_chain_3", f"{LABELS} WHERE chain_seq = 1", **DEEP)
def best_chain_3(spark, sf_dir):
    return chains.chain_labels(chains.best_chain(deep_chains(spark, sf_dir)))


recursive("expand_chains_3", "best_chain_3")


@register("best_chain")
def best_chain(spark, sf_dir):
    return chains.chain_labels(chains.best_chain(_chains(spark, sf_dir)))
