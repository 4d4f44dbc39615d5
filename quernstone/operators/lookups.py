"""Lookups and joins over the store's tables, each for a whole frame of wanted keys at once.

Tables and the columns used here: projects (project_id, name, root_paths, last_indexed), files (file_id, project_id, path,
file_hash), symbols (id, file_id, usr, name, qualified_name, kind, line), calls (call_id, caller_id, callee_id, callee_name,
file_id, line), includes (file_id, included, target_id, is_system), bases (derived_id, base_id, base_name), sources (source_id,
file_id, symbol_id, pattern_id, config_key, line), usages (the same with usage_id and kind), patterns (pattern_id, name, is_active).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import escaped, find_by_name

# --- points


def with_path(rows: DataFrame, files: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(files.select("file_id", "path"), "file_id", how)


def symbols_by_id(symbols: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The symbols of wanted (id) with their file's path."""
    return with_path(symbols.join(wanted.select("id").distinct(), "id", "left_semi"), files)


def ids_of(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (usr) with id, null where no symbol has it."""
    return wanted.select("usr").distinct().join(symbols.select("usr", "id"), "usr", "left")


def files_like(files: DataFrame, text: str | None = None, project_id=None) -> DataFrame:
    """Files of a project (all without one) whose path holds text, by path."""
    found = files if project_id is None else files.where(F.col("project_id") == F.lit(project_id))
    return (found if text is None else found.where(F.col("path").ilike(f"%{escaped(text)}%"))).orderBy("path", "file_id")


def files_at(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files of wanted, which names them by file_id or by path (with or without project_id)."""
    keys = [c for c in ("project_id", "file_id", "path") if c in wanted.columns]
    return files.join(wanted.select(*keys).distinct(), keys, "left_semi")


def hashes(files: DataFrame) -> DataFrame:
    """file_id, path, file_hash of every file."""
    return files.select("file_id", "path", "file_hash")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def files_by_name(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (want) with file_id: the file at exactly this path, else the smallest of those with the same base name."""
    exact = files.groupBy(F.col("path").alias("want")).agg(F.min("file_id").alias("f1"))
    named = files.groupBy(base_name(F.col("path")).alias("base")).agg(F.min("file_id").alias("f2"))
    asked = wanted.select("want").distinct().withColumn("base", base_name(F.col("want")))
    return asked.join(exact, "want", "left").join(named, "base", "left").select("want", F.coalesce("f1", "f2").alias("file_id"))


# --- projects, patterns, results


def projects(table: DataFrame) -> DataFrame:
    """Projects by name, with roots: root_paths as an array, whether it holds a JSON array or one path."""
    listed = F.from_json("root_paths", "array<string>", {"mode": "PERMISSIVE"})
    one = F.when(F.col("root_paths").isNotNull(), F.array("root_paths"))
    return table.withColumn("roots", F.when(F.trim("root_paths").startswith("["), listed).otherwise(one)).orderBy("name")


def resolve_project(table: DataFrame, project_id=None) -> int:
    """The id given, or that of the only project; ValueError where there is none or a choice."""
    if project_id is not None:
        return project_id
    found = [r["project_id"] for r in table.select("project_id").orderBy("project_id").limit(2).collect()]
    if len(found) != 1:
        raise ValueError("no project is indexed" if not found else "several projects are indexed: name one")
    return found[0]


def active(patterns: DataFrame) -> DataFrame:
    return patterns.where("is_active")


def dataflow_paths(paths: DataFrame, source: str | None = None, sink: str | None = None, limit: int | None = 50) -> DataFrame:
    """Stored paths whose source and sink variables hold the given texts, by source and sink."""
    found = paths
    for column, text in (("source_var", source), ("sink_var", sink)):
        if text:
            found = found.where(F.col(column).ilike(f"%{escaped(text)}%"))
    found = found.orderBy("source_var", "sink_var", "path_id")
    return found.limit(limit) if limit else found


def call_args(args: DataFrame, wanted: DataFrame) -> DataFrame:
    """The arguments (call_id, arg_index, text) of wanted calls, in order."""
    return args.join(wanted.select("call_id").distinct(), "call_id", "left_semi").orderBy("call_id", "arg_index")


# --- joins


def callers(calls: DataFrame, symbols: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Calls of wanted (id) with caller and path; calls without a known caller or file fall out."""
    ends = symbols.select(F.col("id").alias("caller_id"), F.col("qualified_name").alias("caller"))
    asked = wanted.select(F.col("id").alias("callee_id")).distinct()
    return with_path(calls.join(asked, "callee_id", "left_semi").join(ends, "caller_id"), files).orderBy("line", "call_id")


def callees(calls: DataFrame, symbols: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Calls by wanted (id) with callee (its qualified name, else the name in the call) and the callee's path; unresolved calls stay."""
    ends = symbols.select(F.col("id").alias("callee_id"), F.col("qualified_name").alias("known"), F.col("file_id").alias("callee_file"))
    asked = wanted.select(F.col("id").alias("caller_id")).distinct()
    paths = files.select(F.col("file_id").alias("callee_file"), F.col("path").alias("callee_path"))
    return calls.join(asked, "caller_id", "left_semi").join(ends, "callee_id", "left").join(paths, "callee_file", "left").withColumn("callee", F.coalesce("known", "callee_name")).drop("known", "callee_file").orderBy("line", "call_id")


def base_classes(bases: DataFrame, symbols: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bases of wanted (id) classes with the base's qualified name and path, null where it isn't known."""
    ends = with_path(symbols.select("id", "file_id", "qualified_name"), files, "left").select(F.col("id").alias("base_id"), F.col("qualified_name").alias("base"), F.col("path").alias("base_path"))
    return bases.join(wanted.select(F.col("id").alias("derived_id")).distinct(), "derived_id", "left_semi").join(ends, "base_id", "left").orderBy("base_name", "derived_id")


def derived_classes(bases: DataFrame, symbols: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Classes that derive from wanted (id), with their qualified name and path."""
    ends = with_path(symbols.select("id", "file_id", "qualified_name"), files).select(F.col("id").alias("derived_id"), F.col("qualified_name").alias("derived"), F.col("path").alias("derived_path"))
    return bases.join(wanted.select(F.col("id").alias("base_id")).distinct(), "base_id", "left_semi").join(ends, "derived_id").orderBy("derived", "derived_id")


def _placed(rows: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    names = symbols.select(F.col("id").alias("symbol_id"), F.col("qualified_name").alias("symbol"))
    return with_path(rows, files).join(names, "symbol_id", "left")


def config_sources(sources: DataFrame, files: DataFrame, symbols: DataFrame, patterns: DataFrame, key: str | None = None) -> DataFrame:
    """Sources (of a key) with path, symbol and pattern name, by path and line; symbol and pattern may be missing."""
    found = sources if key is None else sources.where(F.col("config_key") == key)
    named = patterns.select("pattern_id", F.col("name").alias("pattern"))
    return _placed(found, files, symbols).join(named, "pattern_id", "left").orderBy("path", "line", "source_id")


def config_usages(usages: DataFrame, files: DataFrame, symbols: DataFrame, key: str | None = None) -> DataFrame:
    """Usages (of a key) with path and symbol, by path and line; the symbol may be missing."""
    found = usages if key is None else usages.where(F.col("config_key") == key)
    return _placed(found, files, symbols).orderBy("path", "line", "usage_id")


def query_config(sources: DataFrame, usages: DataFrame, files: DataFrame, symbols: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    """What is known of a key: role (source or usage), path, line, symbol, and how (pattern name or kind of usage)."""
    cols = ["path", "line", "symbol"]
    known = config_sources(sources, files, symbols, patterns, key).select(F.lit("source").alias("role"), *cols, F.col("pattern").alias("how"))
    return known.unionByName(config_usages(usages, files, symbols, key).select(F.lit("usage").alias("role"), *cols, F.col("kind").alias("how")))


def call_edges(calls: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst of resolved calls in known files: the call graph's edges."""
    return calls.where("callee_id IS NOT NULL").join(files.select("file_id"), "file_id", "left_semi").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))


def include_edges(includes: DataFrame, files: DataFrame, system: bool = False) -> DataFrame:
    """src, dst of resolved includes between known files, without those of system headers unless wanted."""
    found = includes.where("target_id IS NOT NULL" + ("" if system else " AND NOT is_system"))
    return found.join(files.select("file_id"), "file_id", "left_semi").select(F.col("file_id").alias("src"), F.col("target_id").alias("dst"))


def resolved(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (file_id, usr, ..) with id: that of the same file's symbol with this usr, else the smallest of any file, else null."""
    own = symbols.groupBy("file_id", "usr").agg(F.min("id").alias("own"))
    any_ = symbols.groupBy("usr").agg(F.min("id").alias("any"))
    return refs.join(own, ["file_id", "usr"], "left").join(any_, "usr", "left").withColumn("id", F.coalesce("own", "any")).drop("own", "any")


def bound_arguments(args: DataFrame, params: DataFrame) -> DataFrame:
    """call_id, callee, idx, param, argument: arguments (call_id, callee, args array) on the parameters (function, idx, name) they bind."""
    each = args.select("call_id", "callee", F.posexplode("args").alias("idx", "argument"))
    named = params.select(F.col("function").alias("callee"), "idx", F.col("name").alias("param"))
    return each.join(named, ["callee", "idx"])


def last_definition_of(fields: DataFrame, types: DataFrame) -> DataFrame:
    """fields (field, type) with values: those of the last definition (ord) of the enum that the type names."""
    last = types.groupBy("enum").agg(F.max_by("values", "ord").alias("values"))
    return fields.withColumn("enum", F.regexp_replace("type", r"^(const\s+)?enum\s+", "")).join(last, "enum", "left")


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, values: each key's distinct values in the order of their first row."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("_first"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value]).alias("values"))


def breakdown(rows: DataFrame, kind: str) -> DataFrame:
    """kind, n, by kind."""
    return rows.groupBy(kind).agg(F.count("*").alias("n")).orderBy(kind)


def groups_of(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows whose group has least or more of them (assignments of one function through one pointer, say)."""
    return rows.join(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n"), keys, "left_semi")
