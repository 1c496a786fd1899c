"""Languages and source/sink rules as data, and their compilation (SRC-2, TNT-1).

Users may pass tables of their own with the same columns."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File extensions by language.
LANGUAGES = {
    "javascript": (".js", ".jsx", ".mjs", ".cjs"), "typescript": (".ts", ".mts", ".cts"), "tsx": (".tsx",), "python": (".py",), "java": (".java",),
    "go": (".go",), "php": (".php",), "c": (".c", ".h"), "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh"), "csharp": (".cs",),
}
_JS = ("javascript", "typescript", "tsx")
#: Fixed values: (id, kind, category, cwe, languages, call names, line patterns), in the order in which they win.
RULES = (
    ("js.sink.eval", "sink", "Code Execution", "CWE-95", _JS, ("eval", "Function"), ()),
    ("js.sink.exec", "sink", "Command Execution", "CWE-78", _JS, ("exec", "execSync", "spawn", "spawnSync", "execFile"), ()),
    ("js.sink.sql", "sink", "SQL Execution", "CWE-89", _JS, ("query", "execute", "raw"), ()),
    ("js.sink.xss", "sink", "XSS", "CWE-79", _JS, (), (r"\.innerHTML\s*=", r"\.outerHTML\s*=", "dangerouslySetInnerHTML", r"document\.write\s*\(")),
    ("js.sink.redirect", "sink", "Open Redirect", "CWE-601", _JS, (), (r"res\.redirect\s*\(",)),
    ("js.source.http", "source", "HTTP Input", None, _JS, (), (r"\breq(uest)?\.(query|body|params|headers|cookies)\b", r"\bctx\.(query|request|params)\b")),
    ("js.source.env", "source", "Environment/CLI", None, _JS, (), (r"process\.env\b", r"process\.argv\b")),
    ("js.source.dom", "source", "DOM Input", None, _JS, (), (r"location\.(search|hash|href)", r"document\.cookie", r"window\.name")),
    ("py.sink.exec", "sink", "Code Execution", "CWE-95", ("python",), ("eval", "exec", "compile"), ()),
    ("py.sink.cmd", "sink", "Command Execution", "CWE-78", ("python",), ("system", "popen", "run", "call", "check_output", "check_call", "Popen"), ()),
    ("py.sink.sql", "sink", "SQL Execution", "CWE-89", ("python",), ("execute", "executemany", "executescript"), ()),
    ("py.sink.deser", "sink", "Unsafe Deserialization", "CWE-502", ("python",), ("loads", "load"), (r"pickle\.loads?\b", r"yaml\.load\b")),
    ("py.source.http", "source", "HTTP Input", None, ("python",), (), (r"request\.(args|form|values|json|data|cookies|files|headers|GET|POST)\b",)),
    ("py.source.io", "source", "Environment/CLI/Input", None, ("python",), (), (r"os\.environ\b", r"sys\.argv\b", r"\binput\s*\(")),
    ("java.sink.sql", "sink", "SQL Execution", "CWE-89", ("java",), ("executeQuery", "executeUpdate", "execute", "addBatch", "createQuery", "createNativeQuery", "createSQLQuery"), ()),
    ("java.sink.cmd", "sink", "Command Execution", "CWE-78", ("java",), ("exec",), (r"Runtime\.getRuntime\(\)", r"new\s+ProcessBuilder")),
    ("java.sink.deser", "sink", "Unsafe Deserialization", "CWE-502", ("java",), ("readObject",), ()),
    ("java.sink.reflect", "sink", "Reflection/Class Loading", "CWE-470", ("java",), ("forName", "loadClass"), ()),
    ("java.sink.xxe", "sink", "XXE", "CWE-611", ("java",), ("newDocumentBuilder", "newSAXParser", "newInstance"), ("DocumentBuilderFactory", "SAXParserFactory", "XMLReader")),
    ("java.source.http", "source", "HTTP Input", None, ("java",), ("getParameter", "getParameterValues", "getHeader", "getQueryString", "getCookies", "getInputStream"), ("@RequestParam", "@PathVariable", "@RequestBody", "@RequestHeader")),
    ("java.source.env", "source", "Environment Variable", None, ("java",), (), (r"System\.getenv\b", r"System\.getProperty\b")),
    ("go.sink.sql", "sink", "SQL Execution", "CWE-89", ("go",), ("Query", "QueryRow", "QueryContext", "Exec", "ExecContext", "Prepare"), ()),
    ("go.sink.cmd", "sink", "Command Execution", "CWE-78", ("go",), ("Command", "CommandContext"), (r"exec\.Command",)),
    ("go.source.http", "source", "HTTP Input", None, ("go",), (), (r"r\.URL\.Query\(\)", r"r\.Form(Value)?\b", r"r\.PostForm", r"r\.Header\.Get", r"mux\.Vars\(", r"\bc\.(Query|Param|PostForm)\(")),
    ("go.source.env", "source", "Environment/CLI", None, ("go",), (), (r"os\.Getenv\b", r"os\.Args\b")),
    ("php.sink.cmd", "sink", "Command Execution", "CWE-78", ("php",), ("system", "exec", "shell_exec", "passthru", "popen", "proc_open"), (r"`.*\$.*`",)),
    ("php.sink.code", "sink", "Code Execution", "CWE-95", ("php",), ("eval", "assert", "create_function", "call_user_func", "call_user_func_array"), ()),
    ("php.sink.sql", "sink", "SQL Execution", "CWE-89", ("php",), ("query", "mysqli_query", "mysql_query", "pg_query", "exec"), ()),
    ("php.sink.deser", "sink", "Unsafe Deserialization", "CWE-502", ("php",), ("unserialize",), ()),
    ("php.sink.file", "sink", "File/Include", "CWE-98", ("php",), ("include", "require", "include_once", "require_once", "file_get_contents", "fopen", "readfile"), ()),
    ("php.source.super", "source", "HTTP Input", None, ("php",), (), (r"\$_(GET|POST|REQUEST|COOKIE|FILES|SERVER)\b", r"php://input", r"getenv\s*\(")),
    ("c.sink.cmd", "sink", "Command Execution", "CWE-78", ("c", "cpp"), ("system", "popen", "execl", "execlp", "execle", "execv", "execvp", "execvpe"), ()),
    ("c.sink.buf", "sink", "Buffer Operation", "CWE-120", ("c", "cpp"), ("strcpy", "strcat", "sprintf", "vsprintf", "gets", "memcpy"), ()),
    ("c.sink.fmt", "sink", "Format String", "CWE-134", ("c", "cpp"), ("printf", "fprintf", "snprintf", "syslog"), ()),
    ("c.source.input", "source", "External Input", None, ("c", "cpp"), ("getenv", "gets", "fgets", "scanf", "fscanf", "read", "recv", "recvfrom"), (r"\bargv\b",)),
    ("cs.sink.sql", "sink", "SQL Execution", "CWE-89", ("csharp",), ("ExecuteReader", "ExecuteNonQuery", "ExecuteScalar", "ExecuteQuery", "Query", "Execute"), (r"new\s+SqlCommand",)),
    ("cs.sink.cmd", "sink", "Command Execution", "CWE-78", ("csharp",), ("Start",), (r"Process\.Start", r"new\s+ProcessStartInfo")),
    ("cs.sink.deser", "sink", "Unsafe Deserialization", "CWE-502", ("csharp",), ("Deserialize",), ("BinaryFormatter", "LosFormatter", "JavaScriptSerializer")),
    ("cs.source.http", "source", "HTTP Input", None, ("csharp",), (), (r"Request\.(QueryString|Form|Params|Cookies|Headers)\b", r"Request\[", r"\[FromBody\]", r"\[FromQuery\]", r"\[FromRoute\]")),
    ("cs.source.env", "source", "Environment/CLI", None, ("csharp",), (), (r"Environment\.GetEnvironmentVariable", r"Console\.ReadLine")),
)
RULE_SCHEMA = "rule_seq int, id string, kind string, category string, cwe string, languages array<string>, call_names array<string>, text_patterns array<string>"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [(k, r[0], r[1], r[2], r[3], list(r[4]) if r[4] else None, list(r[5]), list(r[6])) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def languages_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, lang) for lang, exts in LANGUAGES.items() for e in exts], "ext string, language_id string")


def detect_language(files: DataFrame) -> DataFrame:
    """SRC-2. The last extension, lower-cased, names the language; files of other kinds are dropped."""
    ext = F.lower(F.regexp_extract("file", r"(\.[^./\\]+)$", 1))
    pairs = [F.lit(x) for lang, exts in LANGUAGES.items() for e in exts for x in (e, lang)]
    return files.withColumn("language_id", F.element_at(F.create_map(*pairs), ext)).filter("language_id is not null")


def java_pattern(pattern: str) -> str:
    """The pattern with ASCII word boundaries and white space that includes the no-break space, as
    the rules mean them; Java's own differ on letters beyond ASCII."""
    out = re.sub(r"\\b(?=[A-Za-z0-9_([])", lambda m: "(?<![A-Za-z0-9_])", pattern)
    return re.sub(r"\\b", lambda m: "(?![A-Za-z0-9_])", out).replace(r"\s", r"[\s\x{A0}\x{FEFF}]")


def compiles(pattern: str) -> bool:
    """Whether the engine that will run the pattern takes it: Java's, or Python's before Spark has started."""
    context = SparkContext._active_spark_context
    if context is None:
        try:
            re.compile(pattern)
        except re.error:
            return False
        return True
    try:
        context._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


def literal_of(pattern: str) -> str:
    """The longest text that every match of the pattern holds; empty where none is certain."""
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, OverflowError):
        return ""
    if parsed.state.flags & re.IGNORECASE:
        return ""
    runs = [""]

    def read(tokens) -> None:
        for op, value in tokens:
            if op is re._constants.LITERAL:
                runs[-1] += chr(value)
            elif op is re._constants.SUBPATTERN and not value[1]:
                runs.append("")
                read(value[3])
                runs.append("")
            elif op is re._constants.MAX_REPEAT and value[0] > 0:
                runs.append("")
                read(value[2])
                runs.append("")
            else:
                runs.append("")

    read(parsed)
    return max(runs, key=len)


def compile_calls(rules: DataFrame) -> DataFrame:
    """TNT-1, calls: one row per (call name, rule), in rule order."""
    return rules.select("rule_seq", F.col("id").alias("rule_id"), "kind", "category", "cwe", "languages", F.explode("call_names").alias("callee"))


def compile_patterns(rules) -> list[tuple]:
    """TNT-1, lines: (order, rule, pattern) of the patterns that compile; the others are skipped."""
    out = []
    for rule_seq, r in enumerate(rules):
        out += [(rule_seq, k, r, p) for k, p in enumerate(r[6]) if compiles(p)]
    return out
