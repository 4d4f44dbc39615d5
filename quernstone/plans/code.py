"""The engine over C sources: parse once, then answer by frames. Queries run on the sources that come with the engine."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backward, catalog, graph, intervals, pointsto, relations, resolve, taint
from ..sources import cfront, files, incremental


class Code:
    """Entity frames of a set of files (as ``files.collect`` gives them) and the questions about them."""

    def __init__(self, rows: DataFrame, parsed: DataFrame | None = None):
        self.files = rows
        self.parsed = graph.checkpointed(files.parse(rows)) if parsed is None else parsed

    @classmethod
    def index(cls, spark: SparkSession, roots: list[str]) -> Code:
        return cls(files.collect(spark, roots))

    @classmethod
    def update(cls, spark: SparkSession, roots: list[str], store: str) -> Code:
        """The sources below roots by way of a parse cache in the folder store: files whose length and time are as they were there are neither read nor parsed again."""
        held = incremental.refresh(spark, roots, store)
        return cls(held.select("file_id", "root", "path", "file_hash", "line_count"), held.drop("root", "file_hash", "line_count", "part"))

    def __getattr__(self, kind: str) -> DataFrame:
        if kind in cfront.ENTITIES:
            return files.entity(self.parsed, kind)
        raise AttributeError(kind)

    def save(self, path: str) -> None:
        """All entity tables as Parquet below path."""
        self.files.drop("content").write.mode("overwrite").parquet(f"{path}/files")
        for kind in cfront.ENTITIES:
            files.entity(self.parsed, kind).write.mode("overwrite").parquet(f"{path}/{kind}")

    @cached_property
    def functions(self) -> DataFrame:
        """One row a function, its definition before declarations."""
        s = self.symbols.where(F.col("kind").isin("FUNCTION", "METHOD"))
        return catalog.first_by(s, ["qualified_name"], [F.desc("is_definition"), F.col("path"), F.col("line_start")])

    @cached_property
    def targets(self) -> DataFrame:
        """Calls with call (what names each) and target: the functions that they may enter, through pointers, tables, members and callbacks too."""
        calls = self.calls.withColumn("call", F.sha2(F.to_json(F.struct("path", "function", "callee", "args", "line")), 256)).dropDuplicates(["call"])
        fn = F.col("function").alias("fn")
        own = self.locals.select(fn, "name").unionByName(self.params.select(fn, "name"))
        found = pointsto.call_targets(calls.select(fn, "call", "callee", "args"), self.assignments.select(fn, "lhs", "rhs"), self.tables, self.params.select(fn, "idx", "name"), own, self.functions)
        return graph.checkpointed(calls.join(found, "call"))

    def call_graph(self) -> DataFrame:
        return self.targets.select(F.col("function").alias("src"), F.col("target").alias("dst")).distinct()

    @cached_property
    def facts(self) -> backward.Facts:
        """What the rules of the backward trace are made of."""
        fn, plain = F.col("function").alias("fn"), lambda c: F.transform(c, taint.plain)
        a = self.assignments.select(fn, taint.plain(F.col("lhs")).alias("lhs"), "rhs", plain("rhs_vars").alias("rhs_vars"), F.regexp_extract("rhs_call", r"(\w+)$", 1).alias("rhs_call"), "line", "transform")
        passed = self.targets.select(fn, "target", "line", F.posexplode(F.arrays_zip(F.col("args").alias("text"), plain(F.transform("arg_vars", lambda v: F.array_join(v, " "))).alias("vars"))).alias("idx", "a"))
        args = passed.select("fn", "target", "line", "idx", F.col("a.text").alias("text"), F.filter(F.split("a.vars", " "), lambda v: v != "").alias("vars"))
        return backward.Facts(
            a, args, self.params.select(fn, "idx", "name"), self.returns.select(fn, plain("vars").alias("vars"), "line"), self.union_vars.select(fn, "name"),
            relations.copies(self.calls.select(fn, "callee", "args")), self.locals.select(fn, "name"),
        )

    def include_graph(self) -> DataFrame:
        """src, dst, tier: files and the files that their includes resolve to."""
        wanted = self.includes.where("NOT is_system").select(F.col("path").alias("src"), F.col("included").alias("want"))
        found = resolve.resolve(wanted, self.files.select("file_id", "path"))
        return found.join(self.files.select("file_id", F.col("path").alias("dst")), "file_id", "left").select("src", "want", "dst", "tier")

    def enclosing(self, points: DataFrame) -> DataFrame:
        """points (file_id, line, ..) with the innermost function around them."""
        spans = self.functions.select("file_id", F.col("name").alias("span_id"), F.col("line_start").alias("begin"), F.col("line_end").alias("end"))
        return intervals.innermost(points.withColumnRenamed("line", "at"), spans, "file_id").withColumnRenamed("at", "line").withColumnRenamed("span_id", "function")

    def trace(self, sources: list[str] | None = None, sinks: list[str | dict] | None = None, depth: int = 6, macro_sinks: bool = True, most: int | None = None) -> DataFrame:
        """Dataflow paths from configuration fields to hardware writes, of at most depth variables each, by ``backward.trace``; macros that write count as sinks unless sinks are given.

        label is the sink with the arguments of the call that the path came by; most keeps the first paths in order of file and line.
        """
        wanted = list(sinks or taint.SINKS)
        if macro_sinks and not sinks:
            wanted += [rf"\b{r['macro']}\s*\(" for r in self.macros.where("writes").select("macro").distinct().orderBy("macro").collect()]
        found = taint.sinks(self.assignments, self.calls, wanted)
        found = found.withColumn("sink_id", F.concat_ws(":", "path", F.lpad(F.col("line").cast("string"), 10, "0"), "fn", "sink"))
        chains = backward.trace(found.select("sink_id", "sink", "fn", "line", "var", "pos"), self.facts, sources or taint.SOURCES, depth, most)
        of = found.select("sink_id", "sink", F.col("fn").alias("function"), "path", "line").distinct()
        return chains.join(of, "sink_id").select("source", "source_fn", "sink", "label", "function", "path", "line", backward.told(F.col("nodes")).alias("steps"), "nodes", "hops")

    def reverse_trace(self, sink: str, sources: list[str] | None = None, depth: int = 6) -> DataFrame:
        """sink, paths: the chains, as texts in order, that lead to each sink that matches the regex, and to no other."""
        found = self.trace(sources, [sink], depth)
        return taint.by_sink(found.select("sink", taint.chain(F.col("steps"), F.col("sink")).alias("path")))

    def specs(self) -> DataFrame:
        return taint.specs(self.fields, self.enum_values, self.ranges, self.trace())

    def defaults(self, least: int = 3) -> DataFrame:
        """field, value, function: first values set by functions that assign least or more fields of one pointer."""
        a = self.assignments.where(F.col("lhs").rlike(r"^\w+(->|\.)\w+$") & (F.col("operator") == "=")).withColumn("pointer", taint.base(F.col("lhs"))).withColumn("field", F.regexp_extract("lhs", r"(\w+)$", 1))
        bulk = a.groupBy("path", "function", "pointer").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
        return catalog.first_by(a.join(bulk, ["path", "function", "pointer"], "left_semi"), ["field"], [F.col("path"), F.col("line")]).select("field", F.col("rhs").alias("value"), "function")

    def dependencies(self, least: int = 3) -> DataFrame:
        """kind, source, target, value, function, path, line: how fields depend on each other.

        DIRECT_OVERRIDE: a condition on source sets target; CASCADE: a case of a switch over source does;
        AGGREGATION: either of these where source sets least or more fields, and flags shared by so many;
        MUTUAL_EXCLUSION: a called function sets two or more known fields; SELF_OVERRIDE: a field set under a condition on itself.
        """
        field = lambda c: F.regexp_extract(c, r"(\w+)$", 1)
        known = self.fields.select("field").distinct()
        cols = lambda kind, source, target, value: [F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"), value.alias("value"), "function", "path", "line"]
        guarded = self.guarded.withColumn("target", field(F.col("field"))).join(known.withColumnRenamed("field", "target"), "target", "left_semi")
        each = guarded.withColumn("source", F.explode("condition_fields")).withColumn("source", field(F.col("source")))
        direct = each.where("source <> target").select(*cols("DIRECT_OVERRIDE", F.col("source"), F.col("target"), F.col("value")))
        own = each.where("source = target").select(*cols("SELF_OVERRIDE", F.col("source"), F.col("target"), F.col("value")))
        cascade = self.cascades.select(*cols("CASCADE", field(F.col("source")), field(F.col("target")), F.col("value")))
        sets = direct.unionByName(cascade).distinct()
        many = sets.groupBy("source").agg(F.countDistinct("target").alias("n")).where(F.col("n") >= least).drop("n")
        aggregated = sets.join(many, "source", "left_semi").withColumn("kind", F.lit("AGGREGATION"))
        flags = self.cli.select("flag", field(F.col("field")).alias("target"), "function", "path", "line")
        shared = flags.groupBy("flag").agg(F.countDistinct("target").alias("n")).where(F.col("n") >= least).drop("n")
        by_flag = flags.join(shared, "flag", "left_semi").select(*cols("AGGREGATION", F.col("flag"), F.col("target"), F.lit("")))
        setters = self.assignments.where(F.col("operator") == "=").withColumn("target", field(F.col("lhs"))).where(F.col("lhs").rlike(r"->|\.")).join(known.withColumnRenamed("field", "target"), "target", "left_semi")
        two = setters.groupBy("function").agg(F.countDistinct("target").alias("n")).where("n >= 2").drop("n")
        caller = self.call_graph().groupBy(F.col("dst").alias("function")).agg(F.min("src").alias("caller"))
        exclusive = catalog.first_by(setters.join(two, "function", "left_semi").join(caller, "function"), ["function", "target"], [F.col("path"), F.col("line")]).select(*cols("MUTUAL_EXCLUSION", F.col("caller"), F.col("target"), F.col("rhs")))
        return sets.unionByName(aggregated).unionByName(by_flag).unionByName(exclusive).unionByName(own.distinct())

    def overrides(self) -> DataFrame:
        """gating, gated, function, line: fields that a condition on another field sets."""
        return self.gates.select("gating", "gated", "function", "path", "line").distinct()


def _query(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return files.entity(files.parse(files.corpus_frame(spark)), kind).drop("file_id")

    return run


def _code(spark: SparkSession) -> Code:
    return Code(files.corpus_frame(spark))


QUERIES = {f"extract_{k}": _query(k) for k in cfront.ENTITIES} | {
    "code_call_graph": lambda spark, d: _code(spark).call_graph(),
    "code_include_graph": lambda spark, d: _code(spark).include_graph(),
    "code_enclosing": lambda spark, d: (lambda c: c.enclosing(c.calls.select("file_id", "line", "callee")).drop("file_id"))(_code(spark)),
    "taint_trace": lambda spark, d: _code(spark).trace(),
    "config_specs": lambda spark, d: _code(spark).specs(),
    "config_defaults": lambda spark, d: _code(spark).defaults(),
    "config_dependencies": lambda spark, d: _code(spark).dependencies(),
    "config_overrides": lambda spark, d: _code(spark).overrides(),
}
