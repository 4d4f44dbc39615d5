"""Scalar text functions of the engine, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kconfig_symbol(name: Column) -> Column:
    """Upper case, everything but letters and digits an underscore."""
    return F.upper(F.regexp_replace(name, "[^A-Za-z0-9]", "_"))


def kconfig_type(c_type: Column) -> Column:
    low = F.lower(c_type)
    return F.when(low.rlike(r"\bbool"), "bool").when(low.rlike(r"char\s*\*|string"), "string").when(low.rlike("float|double"), "string").otherwise("int")


def kconfig_default(c_type: Column, value: Column) -> Column:
    """A value as its type has it in a menu: y or n, a quoted string, else as it is."""
    kind = kconfig_type(c_type)
    yes = F.lower(value).isin("true", "1", "yes", "y")
    return F.when(kind == "bool", F.when(yes, "y").otherwise("n")).when(kind == "string", F.concat(F.lit('"'), F.regexp_replace(value, '^"|"$', ""), F.lit('"'))).otherwise(value)


def snippet(text: Column, most: int = 200) -> Column:
    """One line of at most this many characters, as reports show code."""
    return F.substring(F.regexp_replace(text, r"[\r\n]+", " "), 1, most)


def condition(text: Column) -> Column:
    """A C condition as a menu condition: -> and . become underscores, comparison signs get spaces, two-character ones kept whole."""
    names = F.regexp_replace(text, r"->|\.", "_")
    return F.trim(F.regexp_replace(F.regexp_replace(names, r"\s*(<=|>=|==|!=|<|>)\s*", " $1 "), " == ", " = "))
