"""Queries over triage, verification and conversations."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from sinkweave.functions.lineage import cut, shared_dir
from sinkweave.jobs import queries_index, queries_structure
from sinkweave.jobs.bindings import bind, with_bindings
from sinkweave.operators import rules, triage, verify
from sinkweave.sources import tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, **more: str):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = with_bindings(sql, **more)
        return f

    return keep


def _symbols(spark, sf_dir):
    return bind(spark, sf_dir, "b_symbols").withColumns({"container": F.lit(None).cast("string"), "signature": F.lit("()")})


CHUNK = 2000
CUM = "SELECT file, CAST(line AS INTEGER) AS line, sum(length(text) + 1) OVER (PARTITION BY file ORDER BY line) AS upto, count(*) OVER (PARTITION BY file) AS n FROM b_lines"
#: Per line, the first line that no longer fits if a chunk starts there; per line, the last symbol start up to it.
OVER = f"SELECT s.file, s.line, CAST(coalesce(min(t.line), max(s.n)) AS INTEGER) AS beyond, max(s.n) AS n FROM cum s LEFT JOIN cum p ON p.file = s.file AND p.line = s.line - 1 LEFT JOIN cum t ON t.file = s.file AND t.line >= s.line AND t.upto - coalesce(p.upto, 0) > {CHUNK} GROUP BY s.file, s.line"
LAST = "SELECT c.file, c.line, CAST(max(s.start_line) AS INTEGER) AS start_line FROM cum c JOIN b_symbols s ON s.file = c.file AND s.start_line <= c.line GROUP BY c.file, c.line"
CUTS = """
SELECT DISTINCT file, 0 AS first, 0 AS beyond FROM cum
UNION ALL SELECT x.file, CASE WHEN l.start_line > x.first THEN l.start_line ELSE x.b END, x.b
FROM (SELECT c.file, c.first, CAST(greatest(c.beyond + 1, o.beyond) AS INTEGER) AS b, o.n FROM cuts c JOIN over_lines o ON o.file = c.file AND o.line = c.first) x LEFT JOIN last_start l ON l.file = x.file AND l.line = x.b WHERE x.b < x.n"""


@register("split_chunks", """
SELECT c.file, CAST(row_number() OVER (PARTITION BY c.file ORDER BY c.first) - 1 AS INTEGER) AS chunk, c.first + 1 AS start, CAST(coalesce(lead(c.first) OVER (PARTITION BY c.file ORDER BY c.first), n.n) AS INTEGER) AS "end"
FROM cuts c JOIN (SELECT file, count(*) AS n FROM b_lines GROUP BY file) n ON n.file = c.file""", cum=CUM, over_lines=OVER, last_start=LAST, cuts=CUTS)
def split_chunks(spark, sf_dir):
    return triage.split_chunks(queries_index.content(spark, sf_dir), bind(spark, sf_dir, "b_symbols"), CHUNK)


ORACLE["split_chunks"] = ORACLE["split_chunks"].replace("WITH ", "WITH RECURSIVE ", 1)


# the same chunks, with what each lists and asks
CHUNKED = """
SELECT c.file, CAST(row_number() OVER (PARTITION BY c.file ORDER BY c.first) - 1 AS INTEGER) AS chunk, count(*) OVER (PARTITION BY c.file) AS n, c.first + 1 AS start, CAST(coalesce(lead(c.first) OVER (PARTITION BY c.file ORDER BY c.first), m.n) AS INTEGER) AS "end"
FROM cuts c JOIN (SELECT file, count(*) AS n FROM b_lines GROUP BY file) m ON m.file = c.file"""
CHUNK_LISTS = """
SELECT c.*, coalesce((SELECT string_agg('- ' || s.kind || ' ' || s.name || '()  lines ' || (s.start_line + 1) || '-' || (s.end_line + 1), chr(10) ORDER BY s.sym_seq) FROM b_symbols s WHERE s.file = c.file AND s.start_line + 1 BETWEEN c.start AND c."end"), '(no static symbol information)') AS symbols
FROM chunked c"""
CHUNKS = dict(cum=CUM, over_lines=OVER, last_start=LAST, cuts=CUTS, chunked=CHUNKED, chunk_lists=CHUNK_LISTS, numbered=queries_index.NUMBERED)


def _small_chunks(spark, sf_dir):
    files = queries_index.content(spark, sf_dir)
    return triage.symbol_list_text(triage.split_chunks(files, _symbols(spark, sf_dir), CHUNK), _symbols(spark, sf_dir)), files


@register("symbol_list_chunks", 'SELECT file, chunk, start, "end", symbols FROM chunk_lists', **CHUNKS)
def symbol_list_chunks(spark, sf_dir):
    """Symbols of every chunk of files in many chunks."""
    return _small_chunks(spark, sf_dir)[0].select("file", "chunk", "start", "end", "symbols")


@register("triage_prompts_chunks", f"""
SELECT c.file, c.chunk, c.start, c."end", 'File: ' || c.file || chr(10) || 'Language: ' || {queries_index.LANG.replace('file,', 'c.file,')} || chr(10) || CASE WHEN c.n > 1 THEN 'Chunk ' || (c.chunk + 1) || ' of ' || c.n || ', lines ' || c.start || '-' || c."end" || chr(10) ELSE '' END
  || 'Symbols:' || chr(10) || c.symbols || chr(10) || 'Code:' || chr(10) || (SELECT string_agg(t, chr(10) ORDER BY line) FROM numbered n WHERE n.file = c.file AND n.line + 1 BETWEEN c.start AND c."end") AS prompt
FROM chunk_lists c""", **CHUNKS)
def triage_prompts_chunks(spark, sf_dir):
    """Prompts of every chunk, with the note that says which one it is."""
    chunks, files = _small_chunks(spark, sf_dir)
    return triage.build_triage_prompts(chunks, rules.detect_language(files))


for _name in ("symbol_list_chunks", "triage_prompts_chunks"):
    ORACLE[_name] = ORACLE[_name].replace("WITH ", "WITH RECURSIVE ", 1)


# every line is about 20 characters, so a limit above the file's size makes one chunk of each file
WHOLE = "SELECT file, 0 AS chunk, 1 AS first, CAST(count(*) AS INTEGER) AS last FROM b_lines GROUP BY file"
LISTED = """
SELECT w.file, coalesce((SELECT string_agg('- ' || s.kind || ' ' || s.name || '()  lines ' || (s.start_line + 1) || '-' || (s.end_line + 1), chr(10) ORDER BY s.sym_seq) FROM b_symbols s WHERE s.file = w.file AND s.start_line + 1 <= w.last), '(no static symbol information)') AS symbols FROM whole w"""


def _chunks(spark, sf_dir):
    files = queries_index.content(spark, sf_dir)
    return triage.symbol_list_text(triage.split_chunks(files, _symbols(spark, sf_dir), 10_000_000), _symbols(spark, sf_dir)), files


@register("symbol_list_text", "SELECT * FROM listed", whole=WHOLE, listed=LISTED)
def symbol_list_text(spark, sf_dir):
    return _chunks(spark, sf_dir)[0].select("file", "symbols")


@register("build_triage_prompts", f"""
SELECT l.file, 'File: ' || l.file || chr(10) || 'Language: ' || {queries_index.LANG.replace('file,', 'l.file,')} || chr(10) || 'Symbols:' || chr(10) || l.symbols || chr(10) || 'Code:' || chr(10) || n.text AS prompt
FROM listed l JOIN (SELECT file, string_agg(t, chr(10) ORDER BY line) AS text FROM numbered GROUP BY file) n ON n.file = l.file""", whole=WHOLE, listed=LISTED, numbered=queries_index.NUMBERED)
def build_triage_prompts(spark, sf_dir):
    chunks, files = _chunks(spark, sf_dir)
    return triage.build_triage_prompts(chunks, rules.detect_language(files)).select("file", "prompt")


def stub_model(prompts):
    """A model for the query: by the prompt's length it answers, answers at the second ask, or fails."""
    def answer(prompt: str) -> str:
        if "\nYour reply was:" in prompt:
            return '{"again":1}'
        if len(prompt) % 3 == 2:
            raise ValueError("no answer")
        return f'{{"n":{len(prompt)}}}' if len(prompt) % 3 == 0 else "not yet"

    return prompts.map(answer)


@register("complete", """
SELECT conv_id, turn, CASE length(content) % 3 WHEN 0 THEN '{"n":' || length(content) || '}' WHEN 1 THEN '{"again":1}' END AS reply, CASE WHEN length(content) % 3 = 2 THEN 'no answer' END AS error FROM b_messages""")
def complete(spark, sf_dir):
    """Every message as a prompt, answered through a log that starts empty."""
    prompts = bind(spark, sf_dir, "b_messages").select("conv_id", "turn", F.col("content").alias("prompt"))
    return triage.complete_logged(prompts, stub_model, f"{shared_dir(spark)}/sinkweave/answers-{uuid.uuid4().hex}").drop("prompt")


PARSED = "SELECT d.doc_id, d.n_chars, d.n_chars % 100 + 1 AS line_count, l.toxic, l.quality FROM documents d JOIN labels l USING (doc_id)"


def _parsed(spark, sf_dir):
    return triage.parse_json_reply(bind(spark, sf_dir, "b_replies"))


@register("parse_json_reply", "SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 's' || doc_id END AS summary, CASE WHEN doc_id % 4 < 3 THEN 2 ELSE NULL END AS n_functions FROM prs", prs=PARSED)
def parse_json_reply(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", "parsed.summary", F.when(F.col("json").isNotNull(), F.size("parsed.functions")).alias("n_functions"))


ANALYSED = """
SELECT doc_id, line_count, CASE WHEN doc_id % 4 < 3 THEN greatest(1, least(n_chars % 50, line_count)) END AS f_line, CASE WHEN doc_id % 4 < 3 THEN greatest(1, least(n_chars % 300, line_count)) END AS i_start,
  CASE WHEN doc_id % 4 < 3 THEN greatest(greatest(1, least(n_chars % 300, line_count)), least(2, line_count)) END AS i_end, CASE WHEN doc_id % 4 < 3 THEN CASE WHEN toxic = 1 THEN 'high' WHEN quality = 1 THEN 'low' ELSE 'medium' END END AS severity FROM prs"""


def _analysed(spark, sf_dir):
    return triage.normalize_analysis(_parsed(spark, sf_dir))


@register("normalize_analysis", "SELECT doc_id, f_line, i_start, i_end, severity FROM analysed", prs=PARSED, analysed=ANALYSED)
def normalize_analysis(spark, sf_dir):
    one = lambda c: F.get(c, 0)
    return _analysed(spark, sf_dir).select("doc_id", one("functions")["line"].alias("f_line"), one("issues")["start_line"].alias("i_start"), one("issues")["end_line"].alias("i_end"), one("issues")["severity"].alias("severity"))


@register("merge_chunks", """
SELECT file, CAST(sum(n) AS INTEGER) AS n_issues, count(*) > 1 OR max(s) IS NULL AS to_combine, CASE WHEN count(*) = 1 AND max(s) IS NOT NULL THEN max(s) ELSE string_agg('Chunk ' || (chunk + 1) || ': ' || coalesce(s, '(none)'), chr(10) ORDER BY chunk) END AS summary
FROM (SELECT doc_id // 5 AS file, doc_id % 5 AS chunk, CASE WHEN doc_id % 4 < 3 THEN 1 ELSE 0 END AS n, CASE WHEN doc_id % 4 < 3 THEN 's' || doc_id END AS s FROM prs) GROUP BY file""", prs=PARSED)
def merge_chunks(spark, sf_dir):
    rows = _analysed(spark, sf_dir).withColumn("file", F.floor(F.col("doc_id") / 5)).withColumn("chunk", F.col("doc_id") % 5)
    return triage.merge_chunks(rows).select("file", F.size("issues").alias("n_issues"), "to_combine", "summary")


@register("staleness", "SELECT d.file, CASE WHEN a.path IS NULL THEN 'none' WHEN a.content_hash = sha1(d.content) THEN 'fresh' ELSE 'stale' END AS state FROM b_docs d LEFT JOIN b_analyses a ON a.path = d.file")
def staleness(spark, sf_dir):
    return triage.staleness(bind(spark, sf_dir, "b_docs"), bind(spark, sf_dir, "b_analyses"))


@register("analysis_overview", """
SELECT doc_id, CASE WHEN severity IS NULL THEN 0 ELSE 1 END AS n_issues, CASE WHEN severity IS NULL THEN 0 ELSE 1 END AS n_functions, 0 AS n_attention, coalesce('t L' || i_start || ' ' || severity || '/medium', '') AS lines FROM analysed""", prs=PARSED, analysed=ANALYSED)
def analysis_overview(spark, sf_dir):
    return triage.analysis_overview(_analysed(spark, sf_dir), "doc_id")


# ---- verification: chains of depth 0, whose hops are the sinks themselves


def _chains(spark, sf_dir):
    return queries_structure.terminal(spark, sf_dir)


HOPS = """
SELECT k.id AS sink, k.file, CAST(k.line AS INTEGER) AS line, arg_min(s.name, (s.end_line - s.start_line, s.sym_seq)) AS name, coalesce(arg_min(s.start_line, (s.end_line - s.start_line, s.sym_seq)), greatest(0, k.line - 4)) AS a, coalesce(arg_min(s.end_line, (s.end_line - s.start_line, s.sym_seq)), k.line + 4) AS b
FROM sinks k LEFT JOIN b_symbols s ON s.file = k.file AND k.line - 1 BETWEEN s.start_line AND s.end_line GROUP BY k.id, k.file, k.line"""
SOURCED = """
SELECT h.sink, h.file, h.line, coalesce(h.name, regexp_extract(h.file, '[^/]*$')) AS name, coalesce(string_agg(n.t, chr(10) ORDER BY n.line), '') AS source
FROM hps h LEFT JOIN numbered n ON n.file = h.file AND n.line BETWEEN h.a AND h.b GROUP BY h.sink, h.file, h.line, h.name"""
VER = dict(sinks=queries_structure.SINKS, hps=HOPS, numbered=queries_index.NUMBERED, sourced=SOURCED)


@register("hop_sources", "SELECT * FROM sourced", **VER)
def hop_sources(spark, sf_dir):
    return verify.hop_sources(_chains(spark, sf_dir), bind(spark, sf_dir, "b_symbols"), queries_index.content(spark, sf_dir)).select("sink", "file", "line", "name", "source")


@register("verify_prompts")
def verify_prompts(spark, sf_dir):
    """Of the whole chains, with all their hops."""
    found = cut(queries_structure._chains(spark, sf_dir), "verified-chains")
    return verify.verify_prompts(found, verify.hop_sources(found, bind(spark, sf_dir, "b_symbols"), queries_index.content(spark, sf_dir)))


LISTED_HOPS = """
SELECT sink, chain_seq, source_mark, reason, CAST(i - 1 AS INTEGER) AS place, hops[i].name AS name, hops[i].file AS file, hops[i].line AS line, hops[i].symbol_id AS symbol_id
FROM (SELECT sink, chain_seq, source_mark, reason, hops, unnest(range(1, len(hops) + 1)) AS i FROM scored)"""
HOP_TEXTS = """
SELECT p.file, p.symbol_id, p.line, coalesce(string_agg(n.t, chr(10) ORDER BY n.line), '') AS source
FROM (SELECT DISTINCT h.file, h.symbol_id, h.line, coalesce(s.start_line, greatest(0, h.line - 4)) AS a, coalesce(s.end_line, h.line + 4) AS b FROM listed_hops h LEFT JOIN b_symbols s ON s.id = h.symbol_id) p
LEFT JOIN numbered n ON n.file = p.file AND n.line BETWEEN p.a AND p.b GROUP BY p.file, p.symbol_id, p.line"""
DEEP_HOPS = "SELECT h.*, t.source FROM listed_hops h JOIN hop_texts t ON t.file = h.file AND t.symbol_id IS NOT DISTINCT FROM h.symbol_id AND t.line = h.line"
DEEP = queries_structure.DEEP | dict(listed_hops=LISTED_HOPS, numbered=queries_index.NUMBERED, hop_texts=HOP_TEXTS, deep_hops=DEEP_HOPS)


def _deep(spark, sf_dir):
    found = cut(queries_structure.deep_chains(spark, sf_dir), "verified-chains")
    return found, verify.hop_sources(found, bind(spark, sf_dir, "b_symbols"), queries_index.content(spark, sf_dir))


@register("hop_sources_3", "SELECT sink, CAST(chain_seq AS INTEGER) AS chain_seq, place, name, file, line, source FROM deep_hops", **DEEP)
def hop_sources_3(spark, sf_dir):
    return _deep(spark, sf_dir)[1]


@register("verify_prompts_3", """
SELECT sink, CAST(chain_seq AS INTEGER) AS chain_seq, 'Sink: ' || sink || chr(10) || coalesce('Source: ' || max(source_mark), 'Entry: ' || max(reason)) || chr(10) || 'Chain:' || chr(10) || string_agg((place + 1) || '. ' || name || ' (' || file || ':' || line || ')', chr(10) ORDER BY place)
  || chr(10) || 'Sources:' || chr(10) || string_agg('### ' || name || ' ' || file || chr(10) || source, chr(10) || chr(10) ORDER BY place) || chr(10) || 'Is the chain reachable? Answer with JSON.' AS prompt
FROM deep_hops GROUP BY sink, chain_seq""", **DEEP)
def verify_prompts_3(spark, sf_dir):
    """Prompts of chains with up to three callers."""
    return verify.verify_prompts(*_deep(spark, sf_dir))


queries_structure.recursive("hop_sources_3", "verify_prompts_3", oracle=ORACLE)


SAID_3 = "CASE chain_seq % 3 WHEN 0 THEN 'reachable' WHEN 1 THEN 'unreachable' ELSE 'maybe' END"


@register("list_findings_3", f"""
SELECT sha1(c.sink || '|' || array_to_string(c.key, ',')) AS id, m.category || ' @ ' || regexp_extract(m.file, '[^/]*$') || ':' || m.line || ' · ' || CASE {SAID_3} WHEN 'maybe' THEN 'undetermined' ELSE {SAID_3} END AS title, c.source_mark AS source_mark_id, c.sink AS sink_mark_id,
  CASE {SAID_3} WHEN 'maybe' THEN 'undetermined' ELSE {SAID_3} END AS verdict, 'reply ' || c.chain_seq AS analysis, CASE WHEN c.chain_seq % 4 = 0 THEN 2 ELSE CAST(len(c.hops) AS INTEGER) END AS n_hops,
  CASE WHEN c.chain_seq % 4 = 0 THEN 'm.js:7 s e; :0  ' ELSE array_to_string([h.file || ':' || h.line || ' ' || h.name || ' ' FOR h IN c.hops], '; ') END AS chain
FROM scored c JOIN b_marks m ON m.id = c.sink""", **DEEP)
def list_findings_3(spark, sf_dir):
    """Findings of chains of up to three callers, every fourth with hops of the model's own."""
    sinks = bind(spark, sf_dir, "b_marks").filter("kind = 'sink' and status <> 'excluded'")
    found = cut(queries_structure.deep_chains(spark, sf_dir), "judged-chains")
    own = "array(named_struct('file', 'm.js', 'symbol', 's', 'line', 7, 'evidence', 'e'), named_struct('file', cast(null as string), 'symbol', cast(null as string), 'line', cast(null as int), 'evidence', cast(null as string)))"
    replies = found.select("sink", "chain_seq", F.concat(F.lit("reply "), "chain_seq").alias("reply"), F.expr(SAID_3).alias("verdict"), F.lit("").alias("analysis"), F.expr(f"CASE WHEN chain_seq % 4 = 0 THEN {own} END").alias("hops"))
    listed = verify.list_findings(verify.build_findings(found, replies, sinks, "me", "t0"))
    shown = F.array_join(F.transform("chain", lambda h: F.concat(h["file"], F.lit(":"), h["line"], F.lit(" "), h["symbol"], F.lit(" "), h["evidence"])), "; ")
    return listed.select("id", "title", "source_mark_id", "sink_mark_id", "verdict", "analysis", "n_hops", shown.alias("chain"))


queries_structure.recursive("list_findings_3", oracle=ORACLE)


SAID = "CASE WHEN line % 3 = 0 THEN 'reachable' WHEN line % 3 = 1 THEN 'unreachable' ELSE 'maybe' END"


def _findings(spark, sf_dir):
    sinks = bind(spark, sf_dir, "b_marks").filter("kind = 'sink' and status <> 'excluded'")
    replies = sinks.select(F.col("id").alias("sink"), F.lit(1).alias("chain_seq"), F.lit("full reply").alias("reply"), F.expr(SAID).alias("verdict"), F.when(F.col("line") % 2 == 0, "why").otherwise("").alias("analysis"),
                           F.lit(None).cast("array<struct<file:string,symbol:string,line:int,evidence:string>>").alias("hops"))
    return verify.build_findings(_chains(spark, sf_dir), replies, sinks, "me", "t0")


FOUND = f"""
SELECT sha1(m.id || '|') AS id, m.category || ' @ ' || regexp_extract(m.file, '[^/]*$') || ':' || m.line || ' · ' || CASE {SAID} WHEN 'maybe' THEN 'undetermined' ELSE {SAID} END AS title, m.id AS sink_mark_id,
  CASE {SAID} WHEN 'maybe' THEN 'undetermined' ELSE {SAID} END AS verdict, CASE WHEN m.line % 2 = 0 THEN 'why' ELSE 'full reply' END AS analysis FROM b_marks m WHERE kind = 'sink' AND status <> 'excluded'"""


@register("build_findings", "SELECT * FROM fnd", fnd=FOUND)
def build_findings(spark, sf_dir):
    return _findings(spark, sf_dir).select("id", "title", "sink_mark_id", "verdict", "analysis")


@register("normalize_verdict", "SELECT verdict, count(*) AS n FROM fnd GROUP BY verdict", fnd=FOUND)
def normalize_verdict(spark, sf_dir):
    marks = bind(spark, sf_dir, "b_marks").filter("kind = 'sink' and status <> 'excluded'")
    return marks.groupBy(verify.normalize_verdict(F.expr(SAID)).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@register("list_findings", "SELECT id, verdict, 1 AS n_hops FROM fnd", fnd=FOUND)
def list_findings(spark, sf_dir):
    return verify.list_findings(_findings(spark, sf_dir)).select("id", "verdict", "n_hops")


@register("delete_findings", "SELECT id, title FROM fnd WHERE verdict <> 'unreachable'", fnd=FOUND)
def delete_findings(spark, sf_dir):
    found = _findings(spark, sf_dir)
    return verify.delete_findings(found, found.filter("verdict = 'unreachable'")).select("id", "title")


def _stored(spark, df, kind):
    """A table through JSON and back, beside a broken line; and what was rejected."""
    path = f"{shared_dir(spark)}/sinkweave/stored-{uuid.uuid4().hex}"
    tables.write_stored(df, path, kind)
    spark.createDataFrame([('{"id":',)], "value string").write.mode("append").text(path)
    return tables.read_stored(spark, path, kind, lines=True), tables.rejected_records(spark, path, kind, lines=True)


def _analyses(spark, sf_dir):
    return _analysed(spark, sf_dir).filter("json is not null").withColumns({"path": F.col("doc_id").cast("string"), "author": F.lit("me")})


def _architecture(spark, sf_dir):
    whole = lambda df, name, *columns: df.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    modules = queries_structure.modules(spark, sf_dir).select(F.col("module").alias("name"), "file_count", "loc", F.lit(None).cast("string").alias("description"), "sample_files")
    edges = queries_structure.module_edges(spark, sf_dir).select("from", "to", F.col("weight").cast("long").alias("weight"))
    return whole(modules, "modules", *modules.columns).crossJoin(whole(edges, "edges", *edges.columns))  # 25 modules at most: one row each


@register("stored_marks", "SELECT id, kind, status, origin, file, CAST(line AS INTEGER) AS line, category FROM b_marks")
def stored_marks(spark, sf_dir):
    return _stored(spark, bind(spark, sf_dir, "b_marks"), "marks")[0].select("id", "kind", "status", "origin", "file", "line", "category")


@register("stored_findings", "SELECT * FROM fnd", fnd=FOUND)
def stored_findings(spark, sf_dir):
    return _stored(spark, _findings(spark, sf_dir), "findings")[0].select("id", "title", "sink_mark_id", "verdict", "analysis")


@register("stored_analyses", "SELECT CAST(doc_id AS VARCHAR) AS path, 's' || doc_id AS summary, 'f@' || f_line AS functions, 't@' || i_start || '-' || i_end || ' ' || severity AS issues FROM analysed WHERE severity IS NOT NULL", prs=PARSED, analysed=ANALYSED)
def stored_analyses(spark, sf_dir):
    read = _stored(spark, _analyses(spark, sf_dir), "analyses")[0]
    function, issue = F.col("functions")[0], F.col("issues")[0]
    return read.select("path", "summary", F.concat(function["name"], F.lit("@"), function["line"]).alias("functions"), F.concat(issue["title"], F.lit("@"), issue["start_line"], F.lit("-"), issue["end_line"], F.lit(" "), issue["severity"]).alias("issues"))


@register("stored_architecture", 'SELECT "from", "to", CAST(weight AS BIGINT) AS weight FROM module_edges', **queries_structure.BASE)
def stored_architecture(spark, sf_dir):
    return _stored(spark, _architecture(spark, sf_dir), "architecture")[0].select(F.inline("edges"))


@register("rejected_records", "SELECT kind, '{\"id\":' AS record, 1 AS n FROM (SELECT unnest(['marks', 'findings', 'analyses', 'architecture']) AS kind) WHERE EXISTS (SELECT 1 FROM documents)")
def rejected_records(spark, sf_dir):
    """Every kind of table beside a broken line: the line is kept and counted."""
    made = {"marks": bind(spark, sf_dir, "b_marks"), "findings": _findings(spark, sf_dir), "analyses": _analyses(spark, sf_dir), "architecture": _architecture(spark, sf_dir)}
    out = [_stored(spark, df, kind)[1].groupBy(F.lit(kind).alias("kind"), "record").agg(F.count(F.lit(1)).cast("int").alias("n")) for kind, df in made.items()]
    return reduce(lambda a, b: a.unionByName(b), out)


@register("flatten_conversations", """
SELECT conv_id, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'system'), '') AS system,
  coalesce(string_agg(CASE role WHEN 'assistant' THEN '[assistant previous reply]' || chr(10) WHEN 'tool' THEN '[tool result]' || chr(10) ELSE '' END || content, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS prompt
FROM b_messages GROUP BY conv_id""")
def flatten_conversations(spark, sf_dir):
    return verify.flatten_conversations(bind(spark, sf_dir, "b_messages"))


@register("extract_text_parts", "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN role || ' ' || turn ELSE role END AS text FROM conversations")
def extract_text_parts(spark, sf_dir):
    return bind(spark, sf_dir, "b_parts").select("conv_id", "turn", verify.extract_text_parts(F.col("payload")).alias("text"))


@register("split_model_id", "SELECT file, CASE WHEN contains(file, '/') THEN regexp_extract(file, '^[^/]*') ELSE '' END AS provider, regexp_replace(file, '^[^/]*/', '') AS model FROM b_files")
def split_model_id(spark, sf_dir):
    provider, model = verify.split_model_id(F.col("file"))
    return bind(spark, sf_dir, "b_files").select("file", provider.alias("provider"), model.alias("model"))
