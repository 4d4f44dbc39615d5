"""Exports of configuration fields and dependencies: CSV, JSON, menus; and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import condition, kconfig_symbol, kconfig_type


def to_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows in order with a header; arrays joined by |."""
    flat = df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def kconfig(specs: DataFrame, depends: DataFrame | None = None, defaults: DataFrame | None = None) -> DataFrame:
    """struct, text: a menu for each struct. specs: struct, field, type, enum_values, low, high; depends: field, condition; defaults: field, value."""
    rows = specs
    rows = rows.join(depends.groupBy("field").agg(F.array_sort(F.collect_set(condition(F.col("condition")))).alias("conditions")), "field", "left") if depends is not None else rows.withColumn("conditions", F.lit(None).cast("array<string>"))
    rows = rows.join(defaults.select("field", F.col("value").alias("given")), "field", "left") if defaults is not None else rows.withColumn("given", F.lit(None).cast("string"))
    line = lambda head, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"\n    {head} "), c)).otherwise("")
    bounds = F.when(F.col("low").rlike(r"^-?\d+$") & F.col("high").rlike(r"^-?\d+$"), F.concat_ws(" ", "low", "high"))
    block = F.concat(
        F.lit("config "), kconfig_symbol(F.concat_ws("_", "struct", "field")), F.lit("\n    "), kconfig_type(F.col("type")),
        line("default", F.col("given")), line("range", bounds), F.concat(*[line("depends on", F.array_join("conditions", " && "))]), line("# values:", F.array_join("enum_values", ", ")),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("field", "block"))), lambda b: b["block"])
    return rows.withColumn("block", block).groupBy("struct").agg(F.concat(F.lit('menu "'), F.first("struct"), F.lit('"\n'), F.array_join(listed, "\n\n"), F.lit("\nendmenu")).alias("text"))


def yaml_scalar(c: Column) -> Column:
    """A text as a YAML scalar: plain where it can be read no other way, else in single quotes."""
    plain = c.rlike(r"^[A-Za-z_][A-Za-z0-9_.()/>*\[\]=+ -]*$") & ~c.rlike(r" $| #|: ") & ~F.lower(c).isin("true", "false", "null", "yes", "no", "on", "off", "y", "n")
    return F.when(plain, c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))


def _pair(key: str, c: Column, indent: str = "  ") -> Column:
    return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{indent}{key}: "), yaml_scalar(c), F.lit("\n"))).otherwise("")


def _list(key: str, c: Column, indent: str = "  ") -> Column:
    items = F.array_join(F.transform(c, lambda x: F.concat(F.lit(f"{indent}- "), yaml_scalar(x), F.lit("\n"))), "")
    return F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{indent}{key}:\n"), items)).otherwise("")


#: Parts of a field's entry that are lists, in order.
LISTS = ("sinks", "transforms", "gated_by", "gates", "co_depends")


def config_language(specs: DataFrame) -> DataFrame:
    """struct, field, text: each field's entry of the configuration language, as YAML below config_fields; parts that are empty are left out.

    specs: struct, field, type, enum, enum_values, low, high, description, and any of LISTS. Entries one after another, below the
    line "config_fields:", are the whole; ``whole_language`` writes them so.
    """
    low, high = F.col("low"), F.col("high")
    some = lambda c: c.isNotNull() & (c != "")
    name = F.when(some(F.col("struct")), F.concat("struct", F.lit("."), "field")).otherwise(F.col("field"))
    enum = F.when(some(F.col("enum")), F.concat(F.lit("  enum:\n"), _pair("type", F.col("enum"), "    "), _list("values", F.col("enum_values"), "    "))).otherwise("")
    bounds = F.when(some(low) | some(high), F.concat(F.lit("  range:\n"), _pair("min", low, "    "), _pair("max", high, "    "))).otherwise("")
    text = F.concat(F.lit("- name: "), yaml_scalar(name), F.lit("\n"), _pair("type", F.col("type")), enum, bounds, *[_list(c, F.col(c)) for c in LISTS if c in specs.columns], _pair("description", F.col("description")))
    return specs.select("struct", "field", text.alias("text"))


def whole_language(entries: DataFrame, path: str) -> None:
    """The entries in order of struct and field as one YAML text in a folder of parts: the parts by name, one after another, are the file."""
    head = entries.sparkSession.createDataFrame([("config_fields:",)], "value string")
    body = entries.orderBy("struct", "field").select(F.expr("substring(text, 1, length(text) - 1)").alias("value"))
    head.coalesce(1).unionByName(body).write.mode("overwrite").text(path)


def report(stats: DataFrame, keys: DataFrame, called: DataFrame, most: int = 15) -> str:
    """A short markdown report; what it shows is bounded."""
    out = ["# Report", "", "## Counts", *[f"- {r['name']}: {r['n']}" for r in stats.orderBy("name").collect()]]
    out += ["", "## Keys", *[f"- {r[0]}: {r['n']}" for r in keys.orderBy(F.desc("n"), keys.columns[0]).limit(most).collect()]]
    return "\n".join([*out, "", "## Most called", *[f"- {r['id']}: {r['n']}" for r in called.orderBy(F.desc("n"), "id").limit(most).collect()], ""])
