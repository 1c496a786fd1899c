"""Reading and writing code corpora and audit tables (SRC-1, SRC-3, SRC-4, SNK-1, SNK-2)."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sinkweave.functions.lineage import cut
from sinkweave.operators.rules import LANGUAGES, detect_language

MAX_BYTES = 1 << 20
#: The snapshot's version and the fields of its entries and of marks.
SNAPSHOT_VERSION = 3
ENTRY = (
    "file string, contentHash string, languageId string, lines int, symbols array<struct<id:string,name:string,kind:string,container:string,file:string,startLine:int,endLine:int,signature:string>>, "
    "calls array<struct<callee:string,line:int,file:string,fromSymbol:string,text:string>>, imports array<string>"
)
MARK = "id string, kind string, status string, origin string, file string, symbol string, line int, anchor string, category string, cwe string, rule_id string, note string, author string, time string"
#: Path patterns that are left out.
EXCLUDED = ("**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/out/**", "**/target/**", "**/vendor/**", "**/.audit/**", "**/*.min.js")


def glob_pattern(glob: str) -> str:
    """A glob as an anchored regular expression over slash-separated paths."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + ("\\" + glob[k] if glob[k] in ".+()[]{}^$|\\" else glob[k]), k + 1
    return f"^{out}$"


def read_corpus(spark: SparkSession, root: str, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """SRC-1. (file_seq, file, language_id, content): files of known kinds up to 1 MiB. Path and length
    are tested before contents are read."""
    globs = "{" + ",".join(f"*{e}" for exts in LANGUAGES.values() for e in exts) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", globs).load(root).filter(F.col("length") <= MAX_BYTES)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    inside = F.substring(path, F.instr(path, base.split("://")[-1].lstrip("/")) + len(base.split("://")[-1].lstrip("/")), F.length(path))
    files = raw.withColumn("file", inside)
    for glob in exclude:
        files = files.filter(~F.col("file").rlike(glob_pattern(glob)))
    return detect_language(files.select(F.xxhash64("file").alias("file_seq"), "file", F.decode("content", "UTF-8").alias("content")))


def _read(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """JSON with a fixed schema; a path that isn't there is an empty table, broken files are skipped."""
    try:
        return spark.read.schema(schema).options(multiLine=True, mode="DROPMALFORMED", **options).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_index_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3. The entries of a snapshot of the known version, else none."""
    read = _read(spark, path, f"version int, entries array<struct<{_nested(ENTRY)}>>")
    return read.filter(F.col("version") == SNAPSHOT_VERSION).select(F.explode("entries").alias("e")).select("e.*")


def _nested(ddl: str) -> str:
    return ddl.replace(" string", ":string").replace(" int", ":int").replace(" array<", ":array<").replace(", ", ",")


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4."""
    return _read(spark, path, MARK)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-4. Findings, analyses or architecture tables, by their schema."""
    return _read(spark, path, schema)


#: Fields of stored records, as they are named in JSON.
STORED = {
    "marks": "id string, kind string, status string, origin string, file string, symbol string, line int, anchor string, category string, cwe string, ruleId string, note string, author string, time string",
    "findings": "id string, title string, sourceMarkId string, sinkMarkId string, chain array<struct<file:string,symbol:string,line:bigint,evidence:string>>, verdict string, analysis string, author string, time string",
    "analyses": (
        "path string, contentHash string, analyzedAt string, author string, model string, summary string, functions array<struct<name:string,line:bigint,description:string>>, "
        "issues array<struct<title:string,cwe:string,severity:string,confidence:string,startLine:bigint,endLine:bigint,reason:string,advice:string>>, attention array<struct<startLine:bigint,endLine:bigint,note:string>>"
    ),
    "architecture": (
        "generatedAt string, model string, overview string, modules array<struct<name:string,fileCount:bigint,loc:bigint,description:string,sampleFiles:array<string>>>, "
        "edges array<struct<from:string,to:string,weight:bigint>>, tree string"
    ),
}
_REJECTED = "rejected_record"


def stored_schema(kind: str) -> StructType:
    return StructType.fromDDL(STORED[kind])


def table_schema(kind: str) -> StructType:
    """The same fields as tables name them: file_count for fileCount."""
    return StructType.fromDDL(re.sub(r"([a-z])([A-Z])", lambda m: f"{m[1]}_{m[2].lower()}", STORED[kind]))


def _stored(spark: SparkSession, path: str, kind: str, lines: bool) -> DataFrame | None:
    schema = StructType([*stored_schema(kind).fields, StructField(_REJECTED, StringType())])
    try:
        read = spark.read.schema(schema).options(multiLine=not lines, mode="PERMISSIVE", columnNameOfCorruptRecord=_REJECTED).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    # all fields are parsed once and written: of fewer columns Spark would parse less and reject less
    return cut(read.select("*", F.col("_metadata.file_path").alias("stored_in")), "stored")


def read_stored(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """SRC-4. Marks, findings, analyses or architecture from JSON: a record or an array a file, or with
    ``lines`` a record a line. A path that isn't there is an empty table; records that are broken or
    don't fit the fields are left out here and kept by ``rejected_records``."""
    read = _stored(spark, path, kind, lines)
    schema = table_schema(kind)
    if read is None:
        return spark.createDataFrame([], schema)
    return read.filter(F.col(_REJECTED).isNull()).select(*[F.col(old.name).cast(new.dataType).alias(new.name) for old, new in zip(stored_schema(kind), schema, strict=True)])


def rejected_records(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """What ``read_stored`` leaves out: the file, the record as it stands there, and its first field if that
    could be read."""
    read = _stored(spark, path, kind, lines)
    if read is None:
        return spark.createDataFrame([], "stored_in string, record string, first_field string")
    return read.filter(F.col(_REJECTED).isNotNull()).select("stored_in", F.col(_REJECTED).alias("record"), F.col(stored_schema(kind)[0].name).cast("string").alias("first_field"))


def write_stored(df: DataFrame, path: str, kind: str) -> None:
    """SNK-2 as JSON, a record a line, in the fields that ``read_stored`` reads; fields that the table lacks
    are left out, further columns too."""
    had = [(old, new) for old, new in zip(stored_schema(kind), table_schema(kind), strict=True) if new.name in df.columns]
    df.select(*[F.col(new.name).cast(old.dataType).alias(old.name) for old, new in had]).write.json(path)


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """SNK-1. files, symbols, calls and imports as Parquet in a new folder, by language where known."""
    for name, df in tables.items():
        writer = df.sortWithinPartitions("file").write
        (writer.partitionBy("language_id") if "language_id" in df.columns else writer).parquet(f"{path}/{name}")


def write_audit(df: DataFrame, path: str) -> None:
    """SNK-2. One logical table; analyses carry ``key``, the hash of their path with forward slashes."""
    if "path" in df.columns:
        df = df.withColumn("key", F.sha1(F.replace("path", F.lit("\\"), F.lit("/")).cast("binary")))
    df.write.parquet(path)
