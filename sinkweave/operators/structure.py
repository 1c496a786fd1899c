"""Import resolution, file and module graphs, directory tables (ARC-2 to ARC-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinkweave.functions.text import normalize_path

#: Extensions in the order in which they are tried.
EXTENSIONS = "js jsx mjs cjs ts mts cts tsx py java go php c h cpp cc cxx hpp hh cs".split()
ROOT, OTHER = "(root)", "(other)"
MAX_MODULES, SAMPLE_FILES = 24, 5


def _dir(file: Column) -> Column:
    return F.regexp_replace(F.when(F.contains(file, F.lit("/")), file).otherwise("/"), r"/[^/]*$", "")


def _no_extension(file: Column) -> Column:
    return F.regexp_replace(file, r"\.[^./]+$", "")


def _suffixes(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def base_index(files: DataFrame) -> DataFrame:
    """(base, file): which file each extension-less base means, by the fixed order of tries. Made from
    the files' side, so an import looks up one row instead of trying 42 names."""
    f, ext = F.col("file"), F.regexp_extract("file", r"\.([^./]+)$", 1)
    place = F.array_position(F.array(*map(F.lit, EXTENSIONS)), ext).cast("int") - 1  # -1: none of them
    own = F.struct(f.alias("base"), F.lit(0).alias("pos"))
    bare = F.when(place >= 0, F.struct(_no_extension(f).alias("base"), (1 + 3 * place).alias("pos")))
    index = F.when((place >= 0) & F.regexp_like(f, F.lit(r"(^|/)index\.[^./]+$")), F.struct(F.regexp_replace(f, r"/?index\.[^./]+$", "").alias("base"), (2 + 3 * place).alias("pos")))
    package = F.when(F.regexp_like(f, F.lit(r"(^|/)__init__\.py$")), F.struct(F.regexp_replace(f, r"/?__init__\.py$", "").alias("base"), F.lit(3).alias("pos")))
    tries = files.select("file", F.explode(F.filter(F.array(own, bare, index, package), lambda x: x.isNotNull())).alias("x"))
    return tries.groupBy("x.base").agg(F.min_by("file", "x.pos").alias("found"))


def suffix_index(files: DataFrame, dotted: bool = False) -> DataFrame:
    """(suffix, file): the first file that ends with each path suffix; dotted: without extension, or as
    a package directory. Reduced to one row per suffix, so hot suffixes stay one row in the join."""
    paths = F.array(F.col("file"))
    if dotted:
        package = F.when(F.regexp_like("file", F.lit(r"(^|/)__init__\.py$")), F.regexp_replace("file", r"/?__init__\.py$", ""))
        paths = F.filter(F.array(_no_extension(F.col("file")), package), lambda p: p.isNotNull() & (p != ""))
    rows = files.select("file", "file_seq", F.explode(paths).alias("p")).select("file", "file_seq", F.explode(_suffixes(F.col("p"))).alias("suffix"))
    return rows.groupBy("suffix").agg(F.min_by("file", "file_seq").alias("found"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """ARC-5. ``imports(file, target, imp_seq)`` with ``resolved``, null for what lies outside: targets
    that start with a dot by ARC-2, file names by ARC-2 then ARC-3, others by ARC-4."""
    relative = F.startswith("target", F.lit("."))
    header = F.regexp_like("target", F.lit(r"\.(h|hpp|hh|c|cpp|php)$"))
    bases = base_index(files)
    beside = normalize_path(F.concat(_dir(F.col("file")), F.lit("/"), F.col("target")))
    direct = imports.filter(relative).withColumn("base", beside).join(bases, "base", "left").withColumn("resolved", F.col("found"))
    named = (
        imports.filter(~relative & header).withColumn("base", beside).join(bases, "base", "left").withColumnRenamed("found", "near")
        .withColumn("suffix", normalize_path(F.col("target"))).join(suffix_index(files), "suffix", "left").withColumn("resolved", F.coalesce("near", "found"))
    )
    path = F.regexp_replace(F.translate("target", ".\\", "//"), r"/\*$", "")
    dotted = imports.filter(~relative & ~header).withColumn("suffix", path).join(suffix_index(files, True), "suffix", "left").withColumn("resolved", F.col("found"))
    keep = [*imports.columns, "resolved"]
    return direct.select(*keep).unionByName(named.select(*keep)).unionByName(dotted.select(*keep))


def call_edges(calls: DataFrame, symbols: DataFrame, most: int = 3) -> DataFrame:
    """ARC-6. (src, dst, weight): calls of names with 1 to 3 definitions in other files, classes aside.
    Hot names are gone before definitions are joined."""
    defs = symbols.filter("kind <> 'class'").groupBy("name", "file").agg(F.count(F.lit(1)).alias("own"))
    # a name that has more definitions outside each of its files can qualify nowhere, and goes before calls are joined
    total = defs.groupBy("name").agg(F.sum("own").alias("total"), F.max("own").alias("most_own")).filter(F.col("total") - F.col("most_own") <= most).drop("most_own")
    made = calls.groupBy(F.col("callee").alias("name"), F.col("file").alias("src")).agg(F.count(F.lit(1)).alias("n"))
    own = defs.select("name", F.col("file").alias("src"), "own")
    few = made.join(total, "name").join(own, ["name", "src"], "left").filter((F.col("total") - F.coalesce("own", F.lit(0))).between(1, most))
    return few.select("name", "src", "n").join(defs.select("name", F.col("file").alias("dst")), "name").filter("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("weight"))


def file_edges(resolved: DataFrame, by_calls: DataFrame) -> DataFrame:
    """ARC-7. Import and call edges summed; no file leads to itself."""
    by_imports = resolved.filter("resolved is not null").select(F.col("file").alias("src"), F.col("resolved").alias("dst"), F.lit(1).cast("long").alias("weight"))
    return by_imports.unionByName(by_calls).filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def assign_modules(files: DataFrame) -> DataFrame:
    """ARC-8. (file, module): the top directory; one that holds over half of all files and has
    directories of its own is split by them."""
    parts = F.split("file", "/", -1)
    tops = files.withColumn("depth", F.size(parts)).withColumn("top", F.when(F.size(parts) > 1, parts[0]).otherwise(ROOT))
    counts = tops.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("depth") > 2, 1).otherwise(0)).alias("deep"))
    total = tops.agg(F.count(F.lit(1)).alias("all"))
    split = counts.crossJoin(total).filter((F.col("top") != ROOT) & (2 * F.col("n") > F.col("all")) & (F.col("deep") == 1)).select("top", F.lit(True).alias("split"))
    # more than half: one row at most
    return tops.join(F.broadcast(split), "top", "left").select("file", F.when(F.col("split") & (F.col("depth") > 2), F.concat_ws("/", parts[0], parts[1])).otherwise(F.col("top")).alias("module"))


def fold_small_modules(assigned: DataFrame, most: int = MAX_MODULES) -> DataFrame:
    """ARC-9. The modules with most files stay (ties by name), the others become ``(other)``."""
    top = assigned.groupBy("module").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "module").limit(most).select("module", F.lit(True).alias("kept"))
    return assigned.join(F.broadcast(top), "module", "left").select("file", F.when(F.col("kept"), F.col("module")).otherwise(OTHER).alias("module"))


def module_stats(assigned: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """ARC-10. Per module: file_count, loc, and its five files with most symbols (ties by file_seq)."""
    counts = symbols.groupBy("file").agg(F.count(F.lit(1)).alias("n_symbols"))
    all_ = assigned.join(files.select("file", "file_seq", "lines"), "file").join(counts, "file", "left")
    stats = all_.groupBy("module").agg(F.count(F.lit(1)).alias("file_count"), F.sum("lines").alias("loc"))
    order = Window.partitionBy("module").orderBy(F.desc(F.coalesce("n_symbols", F.lit(0))), "file_seq")
    first = all_.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE_FILES)
    samples = first.groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "file"))), lambda x: x["file"]).alias("sample_files"))
    return stats.join(samples, "module").orderBy(F.desc("file_count"), "module")


def module_edges(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """ARC-11. File edges between modules, summed; heaviest first."""
    a, b = (assigned.select(F.col("file").alias(c), F.col("module").alias(m)) for c, m in (("src", "from"), ("dst", "to")))
    return edges.join(a, "src").join(b, "dst").filter(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "from", "to")


def dir_rollup(files: DataFrame) -> DataFrame:
    """ARC-12. (dir, depth, parent, file_count, loc) for every directory; '' is the root. Summed per
    file's own directory first, so hot prefixes combine on the map side."""
    parts = F.split("file", "/", -1)
    own = files.select(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("d"), "lines").groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("loc"))
    prefixes = own.select("n", "loc", F.explode(F.transform(F.sequence(F.lit(0), F.size("d")), lambda i: F.slice(F.col("d"), F.lit(1), i))).alias("p"))
    out = prefixes.groupBy("p").agg(F.sum("n").alias("file_count"), F.sum("loc").alias("loc"))
    parent = F.when(F.size("p") > 0, F.array_join(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), "/"))
    return out.select(F.array_join("p", "/").alias("dir"), F.size("p").alias("depth"), parent.alias("parent"), "file_count", "loc")


def dir_tree_top(dirs: DataFrame, max_depth: int = 3, shown: int = 30) -> DataFrame:
    """ARC-13. Down to max_depth: per parent the directories with most files (ties by name), how many
    are hidden, and whether there is more below the last depth."""
    w = Window.partitionBy("parent")
    top = dirs.filter((F.col("depth") >= 1) & (F.col("depth") <= max_depth)).withColumn("place", F.row_number().over(w.orderBy(F.desc("file_count"), "dir"))).withColumn("hidden", F.greatest(F.count(F.lit(1)).over(w) - shown, F.lit(0)))
    below = dirs.filter(F.col("depth") == max_depth + 1).select(F.col("parent").alias("dir"), F.lit(True).alias("elided")).distinct()
    first = top.filter(F.col("place") <= shown)
    for _ in range(max_depth - 1):  # a directory is shown only if its parent is
        up = first.select(F.col("dir").alias("parent")).unionByName(dirs.filter("depth = 0").select(F.col("dir").alias("parent")))
        first = first.join(up, "parent", "left_semi")
    return first.join(below, "dir", "left").withColumn("elided", F.coalesce("elided", F.lit(False))).select("dir", "depth", "parent", "file_count", "loc", "place", "hidden", "elided")


def annotate_tree(tree: DataFrame, dirs: DataFrame, modules: DataFrame, edges: DataFrame) -> DataFrame:
    """ARC-14. The shown directories and the root with their module's description and first four
    dependencies; ``modules(module, description)``, at most 25 rows and their edges."""
    root = dirs.filter("depth = 0").select("dir", "file_count", "loc")
    rows = tree.select("dir", "file_count", "loc").unionByName(root).withColumn("module", F.when(F.col("dir") == "", ROOT).otherwise(F.col("dir")))
    deps = edges.groupBy("from").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "to"))), 1, 4).alias("d"))
    deps = deps.select(F.col("from").alias("dir"), F.array_join(F.transform("d", lambda x: x["to"]), ", ").alias("depends_on"))
    return rows.join(modules.select("module", "description"), "module", "left").join(deps, "dir", "left").select("dir", "file_count", "loc", "description", "depends_on")


def module_digest(modules: DataFrame, symbols: DataFrame, analyses: DataFrame) -> DataFrame:
    """ARC-15. Per module but ``(other)``: a text of its counts, sample files, first 12 symbols and up to
    two stored summaries; ``analyses(path, summary)``."""
    files = modules.filter(F.col("module") != OTHER).select("module", F.posexplode("sample_files").alias("place", "file"))
    order = Window.partitionBy("module").orderBy("place", "sym_seq")
    names = files.join(symbols.select("file", "name", "sym_seq"), "file").withColumn("k", F.row_number().over(order)).filter("k <= 12")
    names = names.groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ", ").alias("names"))
    notes = files.join(analyses.filter("summary <> ''").select(F.col("path").alias("file"), "summary"), "file").withColumn("k", F.row_number().over(Window.partitionBy("module").orderBy("place", "summary"))).filter("k <= 2")
    notes = notes.groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "summary"))), lambda x: F.concat(F.lit("  existing file summary: "), x["summary"])), "\n").alias("notes"))
    head = F.concat(F.lit("Module "), F.col("module"), F.lit(" ("), F.col("file_count"), F.lit(" files, "), F.col("loc"), F.lit(" LOC)"))
    return modules.filter(F.col("module") != OTHER).join(names, "module", "left").join(notes, "module", "left").select("module", F.concat_ws(
        "\n", head, F.concat(F.lit("  representative files: "), F.array_join("sample_files", ", ")), F.concat(F.lit("  main symbols: "), F.col("names")), F.col("notes")).alias("digest"))


def merge_annotations(modules: DataFrame, replies: DataFrame) -> DataFrame:
    """ARC-16. ``replies(reply)``, JSON with modules of name and description: by exact name, the last one
    that is not blank wins."""
    parsed = replies.select(F.from_json("reply", "modules array<struct<name:string,description:string>>").alias("r")).select(F.posexplode("r.modules").alias("pos", "m"))
    said = parsed.filter("m.name <> '' and m.description <> ''").groupBy(F.col("m.name").alias("module")).agg(F.max_by("m.description", "pos").alias("_said"))
    return modules.drop("description").join(said, "module", "left").withColumnRenamed("_said", "description")


def report_tables(modules: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ARC-17. Modules with three sample files; the 40 heaviest edges."""
    return (
        modules.select("module", "file_count", "loc", F.array_join(F.slice("sample_files", 1, 3), ", ").alias("samples")),
        edges.orderBy(F.desc("weight"), "from", "to").limit(40),
    )
