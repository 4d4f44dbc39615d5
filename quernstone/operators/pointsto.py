"""Closures over names of functions: what aliases stand for, and which functions a pointer may hold.

Both are fixpoints without a length bound; what a round finds is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed

#: Rounds after which what was found so far is written as one table again.
COMPACT = 4


def closed_aliases(found: DataFrame) -> DataFrame:
    """fn, name, origin: aliases (fn, name, origin; one a name) followed to the end of their chain; a cycle, and what leads into it, stands for its least name.

    Pointer jumping: each round a name takes over where its origin has come to, so n names take log2 n rounds. Along the way it
    keeps the least name passed. All names of a chain after its first are origins, so after one step more than a function has
    aliases that are origins too, a chain has ended, or stands on a cycle, and what that place has passed is the whole cycle.
    """
    at = checkpointed(found.select("fn", "name", F.col("origin").alias("to"), F.col("origin").alias("low")))
    within = at.select("fn", "name").join(at.select("fn", F.col("to").alias("name")), ["fn", "name"], "left_semi")
    longest, steps = within.groupBy("fn").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] + 1, 1
    there = lambda: at.select("fn", F.col("name").alias("to"), F.col("to").alias("next"), F.col("low").alias("lower"))
    while steps < longest:
        at = checkpointed(at.join(there(), ["fn", "to"], "left").select("fn", "name", F.coalesce("next", "to").alias("to"), F.least("low", "lower").alias("low")))
        steps *= 2
    return at.join(there(), ["fn", "to"], "left").select("fn", "name", F.coalesce("lower", "to").alias("origin")).where("name <> origin")


def points_to(bases: DataFrame, copies: DataFrame, calls: DataFrame, args: DataFrame, params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loc, target): the functions that each place may hold, and (call, target): those that each call may enter.

    bases: loc, target; copies: src, dst (places); calls: call, loc (what is called); args: call, idx, loc; params: target, idx, loc.
    A call that enters a function binds its arguments to the parameters, which may lead to further calls. Rounds work on what
    is new: new targets pass along all copies, all targets along new copies, and only new targets enter calls.
    """
    held = new = checkpointed(bases.select("loc", "target").distinct())
    links, fresh = checkpointed(copies.select("src", "dst").distinct()), None
    calls, args, params = (checkpointed(x.distinct()) for x in (calls.select("call", "loc"), args.select("call", "idx", F.col("loc").alias("src")), params.select("target", "idx", F.col("loc").alias("dst"))))
    along = lambda places, by: places.join(by.withColumnRenamed("src", "loc"), "loc").select(F.col("dst").alias("loc"), "target")
    n = 0
    while True:
        n += 1
        moved = along(new, links)
        entered = new.join(calls, "loc").select("call", "target")
        bound = checkpointed(entered.join(args, "call").join(params, ["target", "idx"]).select("src", "dst").distinct().join(links, ["src", "dst"], "left_anti"))
        moved = moved.unionByName(along(held, fresh)) if fresh is not None else moved
        new = checkpointed(moved.distinct().join(held, ["loc", "target"], "left_anti"))
        fresh = bound
        if new.isEmpty() and bound.isEmpty():
            return held, held.join(calls, "loc").select("call", "target").distinct()
        held, links = held.unionByName(new), links.unionByName(bound)
        if n % COMPACT == 0:
            held, links = checkpointed(held), checkpointed(links)


def place(fn: Column, text: Column, own: Column) -> Column:
    """The place that an expression names: .member, fn:name where own says that the name is the function's, else :name; null for what is none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]", ""), r"^[\s(*&]+|[\s)]+$", "")
    member = F.regexp_extract(bare, r"(?:->|\.)(\w+)$", 1)
    return F.when(member != "", F.concat(F.lit("."), member)).when(bare.rlike(r"^[A-Za-z_][\w:]*$"), F.concat(F.when(own, fn).otherwise(F.lit("")), F.lit(":"), bare))


def name_in(text: Column) -> Column:
    """The plain name in an expression that place() would look up among the function's own."""
    return F.regexp_extract(F.regexp_replace(text, r"\[[^\]]*\]", ""), r"^[\s(*&]*([A-Za-z_]\w*)[\s)]*$", 1)


def call_targets(calls: DataFrame, assigns: DataFrame, tables: DataFrame, params: DataFrame, own: DataFrame, functions: DataFrame) -> DataFrame:
    """call, target: the functions that each call (call, fn, callee, args) may enter, directly or by pointers, tables, members and registered callbacks.

    assigns: fn, lhs, rhs; tables: array_name, member, callee; params: fn, idx, name; own: fn, name of locals and parameters; functions: name.
    A member is one place whatever it belongs to, and its own name counts as a target, as virtual calls go by name.
    """
    own = own.select("fn", F.col("name").alias("_n"), F.lit(True).alias("_own")).distinct()

    def placed(df, text, as_):
        return df.withColumn("_n", name_in(F.col(text))).join(own, ["fn", "_n"], "left").withColumn(as_, place(F.col("fn"), F.col(text), F.coalesce("_own", F.lit(False)))).drop("_n", "_own")

    names = functions.select("name").distinct()
    bases = names.select(F.concat(F.lit(":"), "name").alias("loc"), F.col("name").alias("target")).unionByName(names.select(F.concat(F.lit("."), "name").alias("loc"), F.col("name").alias("target")))
    entries = tables.select(F.explode(F.array(F.concat(F.lit(":"), "array_name"), F.concat(F.lit("."), "member"))).alias("loc"), F.col("callee").alias("target")).where("length(loc) > 1").join(names.withColumnRenamed("name", "target"), "target", "left_semi")
    copies = placed(placed(assigns.select("fn", "lhs", "rhs"), "lhs", "dst"), "rhs", "src").where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    called = placed(calls.select("fn", "call", "callee"), "callee", "loc").where("loc IS NOT NULL").select("call", "loc")
    given = placed(calls.select("fn", "call", F.posexplode("args").alias("idx", "text")), "text", "loc").where("loc IS NOT NULL").select("call", "idx", "loc")
    taken = params.select(F.col("fn").alias("target"), "idx", F.concat("fn", F.lit(":"), "name").alias("loc"))
    return points_to(bases.unionByName(entries.select("loc", "target")), copies, called, given, taken)[1]
