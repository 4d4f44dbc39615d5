"""Graph operators over (src, dst) edge frames: degrees, hops, closures, paths, trees, chains, cycles.

Traversals keep only a frontier and the set of nodes found; each round is one join on the edges and one
anti-join, checkpointed so that lineage doesn't grow. Path operators carry the path as an array and are
always bounded by a length, as their number is exponential.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import find_by_name


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the folder of spark.checkpoint.dir; where that is unset, only a local master gets a folder of its own."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quernstone-"))
    return df.checkpoint()


def simple(edges: DataFrame) -> DataFrame:
    """Parallel edges collapsed."""
    return edges.select("src", "dst").distinct()


def degrees(edges: DataFrame, end: str, nodes: DataFrame | None = None) -> DataFrame:
    """id, n: distinct edges at that end; with nodes (id), those without one count 0."""
    found = simple(edges).groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n"))
    return found if nodes is None else nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def top_degrees(edges: DataFrame, end: str, n: int = 15, nodes: DataFrame | None = None) -> DataFrame:
    return degrees(edges, end, nodes).orderBy(F.desc("n"), "id").limit(n)


def node_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def counts(edges: DataFrame) -> DataFrame:
    return node_ids(edges).agg(F.count("*").alias("node_count")).crossJoin(simple(edges).agg(F.count("*").alias("edge_count")))


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(edges: DataFrame, starts: DataFrame, depth: int = -1) -> DataFrame:
    """start, id, hops (fewest): nodes that each start (column id) reaches in 1 to depth hops; without bound if depth < 0.

    A bounded search includes a start that lies on a cycle of that length; an unbounded one leaves starts out.
    """
    step = checkpointed(simple(edges))
    seen = starts.select(F.col("id").alias("start"), "id").distinct().join(step.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("start", "id", F.lit(0).alias("hops"))
    front, found, hop = seen, None, 0
    while depth < 0 or hop < depth:
        hop += 1
        nxt = front.alias("f").join(step.alias("e"), F.col("f.id") == F.col("e.src")).select("f.start", F.col("e.dst").alias("id")).distinct()
        if depth < 0:
            nxt = nxt.where("start <> id")
        if found is not None:
            nxt = nxt.join(found, ["start", "id"], "left_anti")
        front = checkpointed(nxt.withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        found = front if found is None else found.unionByName(front)
    return found if found is not None else seen.limit(0)


def can_reach(edges: DataFrame, src, dst) -> bool:
    """Whether dst lies below src; breadth first, stopped when found."""
    step, front, seen = checkpointed(simple(edges)), None, None
    front = step.where(F.col("src") == F.lit(src)).select(F.col("dst").alias("id")).distinct()
    while True:
        front = checkpointed(front if seen is None else front.join(seen, "id", "left_anti"))
        if front.isEmpty():
            return False
        if not front.where(F.col("id") == F.lit(dst)).isEmpty():
            return True
        seen = front if seen is None else seen.unionByName(front)
        front = front.join(step, front["id"] == step["src"]).select(F.col("dst").alias("id")).distinct()


def within(edges: DataFrame, targets: DataFrame, length: int) -> DataFrame:
    """id, left: nodes that reach one of the targets (id) in at most length edges, and the fewest they need."""
    near = reach(reversed_(edges), targets, length).groupBy("id").agg(F.min("hops").alias("left"))
    return checkpointed(near.join(targets.select("id").distinct(), "id", "left_anti").unionByName(targets.select("id", F.lit(0).alias("left")).distinct()))


def paths(edges: DataFrame, starts: DataFrame, length: int, fan_out: int | None = None, order: Column | None = None, simple_only: bool = True) -> DataFrame:
    """path (array): all paths of 1 to length edges from the starts (id); simple ones only, or with repeats.

    fan_out keeps each node's first edges in order (by dst unless given).
    """
    step = simple(edges)
    if fan_out:
        step = step.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(order if order is not None else F.col("dst")))).where(F.col("k") <= fan_out).drop("k")
    step = checkpointed(step)
    front = starts.select(F.array("id").alias("path")).distinct()
    found = None
    for _ in range(length):
        nxt = front.join(step, F.element_at("path", -1) == F.col("src"))
        if simple_only:
            nxt = nxt.where(~F.array_contains("path", F.col("dst")))
        front = checkpointed(nxt.select(F.concat("path", F.array("dst")).alias("path")))
        found = front if found is None else found.unionByName(front)
    return found


def paths_between(edges: DataFrame, starts: DataFrame, targets: DataFrame, cutoff: int = 15, most: int | None = 20) -> DataFrame:
    """path: simple paths of 1 to cutoff edges from the starts (id) to the targets (id), the most shortest, ties by path.

    Best first: a partial path can't become shorter than its edges and the fewest that its end still needs. Those that can be of the
    least length are followed to the end, the others wait, and the length grows only while fewer than most paths are found. So
    no more partial paths are made than there are of the length of the last path returned, and none that can't reach a target within cutoff.
    """
    step = checkpointed(simple(edges).join(within(edges, targets, cutoff).select(F.col("id").alias("dst"), "left"), "dst"))
    goal = checkpointed(targets.select(F.col("id").alias("goal"), F.lit(True).alias("there")).distinct())
    waiting = checkpointed(starts.select(F.array("id").alias("path")).distinct().withColumn("least", F.lit(1)))
    found, n = None, 0
    while most is None or n < most:
        length = waiting.agg(F.min("least")).first()[0]
        if length is None:
            break
        front, parked = waiting.where(F.col("least") <= length), [waiting.where(F.col("least") > length)]
        while True:
            nxt = front.join(step, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
            grown = nxt.select(F.concat("path", F.array("dst")).alias("path"), (F.size("path") + F.col("left")).alias("least")).where(F.col("least") <= cutoff)
            grown = checkpointed(grown.join(goal, F.element_at("path", -1) == F.col("goal"), "left").select("path", "least", F.coalesce("there", F.lit(False)).alias("there")))
            if grown.isEmpty():
                break
            # a path that has arrived may go on to a further target, by one edge more at least
            done, on = grown.where("there").select("path"), grown.select("path", F.when(F.col("there"), F.col("least") + 1).otherwise(F.col("least")).alias("least")).where(F.col("least") <= cutoff)
            found = done if found is None else found.unionByName(done)
            parked.append(on.where(F.col("least") > length))
            front = on.where(F.col("least") <= length)
        waiting = parked[0]
        for more in parked[1:]:
            waiting = waiting.unionByName(more)
        waiting = checkpointed(waiting)
        n = found.count() if most is not None and found is not None else n
    if found is None:
        found = waiting.select("path").limit(0)
    return found.orderBy(F.size("path"), "path").limit(most) if most else found


def all_paths(edges: DataFrame, src, dst, cutoff: int = 15, most: int | None = 20) -> DataFrame:
    """Simple paths from src to dst of at most cutoff edges; the most shortest, ties by path."""
    one = lambda x: edges.sparkSession.createDataFrame([(x,)], f"id {edges.schema['src'].dataType.simpleString()}")
    return paths_between(edges.where(F.col("src") != F.lit(dst)), one(src), one(dst), cutoff, most)


def trace_path(edges: DataFrame, symbols: DataFrame, src: str, dst: str, cutoff: int = 15, most: int | None = 10) -> DataFrame:
    """path: simple paths from any symbol that src names to any that dst names (exact names before others, five each)."""
    starts, targets = (find_by_name(symbols, name).select("id") for name in (src, dst))
    return paths_between(edges, starts, targets, cutoff, most)


def who(edges: DataFrame, symbols: DataFrame, text: str, direction: str = "callers", depth: int = 1) -> DataFrame:
    """start, id, hops: callers or callees of the first symbol that a name means."""
    start = find_by_name(symbols, text, 1).select("id")
    return reach(reversed_(edges) if direction == "callers" else edges, start, depth)


def trace_config(usages: DataFrame, edges: DataFrame, key: str, depth: int = 6, most: int | None = 30) -> tuple[DataFrame, DataFrame]:
    """Of a configuration key: id and role (direct: a function that uses it, affected: one that such a function calls within depth), and call chains from the direct ones."""
    direct = checkpointed(usages.where((F.col("config_key") == key) & F.col("symbol_id").isNotNull()).select(F.col("symbol_id").alias("id")).distinct())
    below = reach(edges, direct, depth).select("id").distinct().join(direct, "id", "left_anti")
    roles = direct.withColumn("role", F.lit("direct")).unionByName(below.withColumn("role", F.lit("affected")))
    return roles, chains(edges, direct, depth, most=most)


def shortest_paths(edges: DataFrame, src) -> DataFrame:
    """id, path: a shortest path from src to each node below it; of several the smallest."""
    step = checkpointed(simple(edges))
    front = step.sparkSession.createDataFrame([(src,)], f"id {edges.schema['src'].dataType.simpleString()}").select("id", F.array("id").alias("path"))
    found = front
    while True:
        nxt = front.alias("f").join(step.alias("e"), F.col("f.id") == F.col("e.src")).groupBy(F.col("e.dst").alias("id")).agg(F.min(F.concat("f.path", F.array("e.dst"))).alias("path"))
        front = checkpointed(nxt.join(found, "id", "left_anti"))
        if front.isEmpty():
            return found.where(F.size("path") > 1)
        found = found.unionByName(front)


def tree(edges: DataFrame, root, depth: int = 4, breadth: int = 8) -> DataFrame:
    """node, parent, depth, path: the call or include tree below root. A node that repeats on its path is a leaf; each node shows its first breadth children."""
    step = simple(edges).withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("k") <= breadth)
    step = checkpointed(step)
    front = edges.sparkSession.createDataFrame([(root,)], f"id {edges.schema['src'].dataType.simpleString()}").select(F.array("id").alias("path"), F.lit(False).alias("repeats"))
    found = front
    for _ in range(depth):
        nxt = front.where("NOT repeats").join(step, F.element_at("path", -1) == F.col("src"))
        front = checkpointed(nxt.select(F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("repeats")))
        found = found.unionByName(front)
    n = F.size("path")
    return found.select(F.element_at("path", -1).alias("node"), F.when(n > 1, F.element_at("path", -2)).alias("parent"), (n - 1).alias("depth"), "path", "repeats")


def chains(edges: DataFrame, starts: DataFrame, depth: int = 6, fan_out: int = 5, most: int | None = 30) -> DataFrame:
    """path: walks (cycles unroll) that end at a leaf or after depth edges, first fan_out edges of each node."""
    step = simple(edges)
    grown = paths(step, starts, depth, fan_out, simple_only=False).unionByName(starts.select(F.array("id").alias("path")))
    leaf = grown.join(step.select("src").distinct(), F.element_at("path", -1) == F.col("src"), "left_anti")
    full = grown.where(F.size("path") == depth + 1).join(step.select("src").distinct(), F.element_at("path", -1) == F.col("src"), "left_semi")
    done = leaf.unionByName(full).distinct()
    return done.orderBy("path").limit(most) if most else done


#: Lesser neighbours of one node that a task may sort; where a node has more, the least of all is joined instead, as such a join can be split.
HUB = 1_000_000


def weak_components(edges: DataFrame) -> DataFrame:
    """id, piece (its least node): nodes of edges, directions left aside.

    Alternating stars over pairs of a node and a lesser one: the greater neighbours of a node go to the least that it knows, then it
    and its lesser neighbours do. Done when a round moves no pair; a path takes about log n rounds.
    """
    pairs = checkpointed(edges.where("src <> dst").select(F.greatest("src", "dst").alias("id"), F.least("src", "dst").alias("near")).distinct())
    while True:
        least = pairs.groupBy(F.col("id").alias("near")).agg(F.min("near").alias("least"))
        up = pairs.join(least, "near", "left").select("id", F.coalesce("least", "near").alias("near"), F.col("least").isNotNull().alias("moved"))
        if pairs.groupBy("id").count().where(F.col("count") > HUB).isEmpty():
            told = up.withColumn("least", F.min("near").over(Window.partitionBy("id")))
        else:
            told = up.join(up.groupBy("id").agg(F.min("near").alias("least")), "id")
        own = F.struct("id", F.col("least").alias("near"), (F.col("moved") | (F.col("near") > F.col("least"))).alias("moved"))
        other = F.struct(F.col("near").alias("id"), F.col("least").alias("near"), F.lit(True).alias("moved"))
        down = told.select(F.explode(F.array(own, other)).alias("pair")).select("pair.*").where("id > near")
        pairs = checkpointed(down.groupBy("id", "near").agg(F.max("moved").alias("moved")))
        if pairs.where("moved").isEmpty():
            return pairs.select("id", F.col("near").alias("piece")).unionByName(pairs.select(F.col("near").alias("id"), F.col("near").alias("piece")).distinct())
        pairs = pairs.drop("moved")


#: Edges of a weakly connected piece up to which one task finds its strong components, together with other pieces of as many edges.
PIECE = 50_000


def _owners(first: list[int], to: list[int]) -> list[int]:
    """A node of the strong component of each node, whose edges are to[first[node]:first[node + 1]]; depth first (Tarjan), no recursion."""
    n = len(first) - 1
    seen, low, owner, at, stack, turn = [0] * n, [0] * n, [-1] * n, first[:n], [], 0
    for root in range(n):
        path = [] if seen[root] else [root]
        while path:
            u = path[-1]
            if not seen[u]:
                turn += 1
                seen[u] = low[u] = turn
                stack.append(u)
            if at[u] < first[u + 1]:
                v = to[at[u]]
                at[u] += 1
                if not seen[v]:
                    path.append(v)
                elif owner[v] < 0:
                    low[u] = min(low[u], seen[v])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[u])
            while low[u] == seen[u] and owner[u] < 0:
                owner[stack.pop()] = u
    return owner


def _solved(edges):
    """id, component of a group of whole pieces, as pandas."""
    import numpy as np
    import pandas as pd

    code, ids = pd.factorize(pd.concat([edges["src"], edges["dst"]], ignore_index=True), sort=True)
    src, dst = np.split(code, 2)
    order = np.argsort(src, kind="stable")
    owner = np.array(_owners(np.searchsorted(src[order], np.arange(len(ids) + 1)).tolist(), dst[order].tolist()))
    _, least, own, n = np.unique(owner, return_index=True, return_inverse=True, return_counts=True)
    kept = n[own] > 1
    return pd.DataFrame({"id": np.asarray(ids)[kept], "component": np.asarray(ids)[least[own[kept]]]})


def _trimmed(left: DataFrame, passes: int | None = None) -> tuple[DataFrame, int]:
    """Edges without those of nodes that have none in or none out, and their number; until none goes, or so many passes."""
    n = left.count()
    while n and (passes is None or passes > 0):
        into, out = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = checkpointed(left.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
        before, n, passes = n, left.count(), passes and passes - 1
        if n == before:
            break
    return left, n


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component (its least id): nodes of strongly connected components of two nodes or more.

    Weakly connected pieces of at most PIECE edges are dealt to tasks, which find their components; larger ones take rounds over all tasks:
    Every node gets a random label and takes the least label that reaches it and the least that it reaches. Nodes of one component
    agree in both. Where the two are one label, its node and all that have it are a component; edges between
    nodes that differ are cut, nodes without an edge in or out are trimmed, and what is left, by now in smaller pieces, begins anew.
    """
    left, n = _trimmed(checkpointed(simple(edges).where("src <> dst")), 1)
    found, turn = node_ids(left).limit(0).select("id", F.col("id").alias("component")), 0
    while n:
        at = checkpointed(left.join(weak_components(left).withColumnRenamed("id", "src"), "src").select("src", "dst", "piece"))
        large = checkpointed(at.groupBy("piece").count().where(F.col("count") > PIECE).select("piece"))
        cut = not large.isEmpty()
        small = at.join(large, "piece", "left_anti") if cut else at
        groups = small.select("src", "dst", F.pmod(F.xxhash64("piece"), F.lit(-(-n // PIECE))).alias("group")).groupBy("group")
        found = found.unionByName(checkpointed(groups.applyInPandas(_solved, found.schema)))
        if not cut:
            break
        before = at.join(large, "piece", "left_semi").select("src", "dst")
        left, n = _trimmed(before)
        if not n or n < before.count():
            continue
        turn += 1
        label = F.xxhash64("id", F.lit(turn))
        at = checkpointed(node_ids(left).select("id", label.alias("from"), label.alias("to"), F.lit(True).alias("new")))
        while not at.where("new").isEmpty():
            new = at.where("new")
            on = left.join(new, left["src"] == new["id"]).select(F.col("dst").alias("id"), F.col("from").alias("f"), F.lit(None).cast("long").alias("t"))
            back = left.join(new, left["dst"] == new["id"]).select(F.col("src").alias("id"), F.lit(None).cast("long").alias("f"), F.col("to").alias("t"))
            told = on.unionByName(back).groupBy("id").agg(F.min("f").alias("f"), F.min("t").alias("t"))
            less = F.coalesce(F.col("f") < F.col("from"), F.lit(False)) | F.coalesce(F.col("t") < F.col("to"), F.lit(False))
            at = checkpointed(at.join(told, "id", "left").select("id", F.least("from", "f").alias("from"), F.least("to", "t").alias("to"), less.alias("new")))
        labelled = at.where(F.col("from") == F.col("to"))
        least = labelled.groupBy(F.col("from")).agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(labelled.join(least, "from").select("id", "component"))
        end = lambda e: at.where(F.col("from") != F.col("to")).select(F.col("id").alias(e), F.struct("from", "to").alias(f"c_{e}"))  # noqa: B023,E731
        left, n = _trimmed(checkpointed(left.join(end("src"), "src").join(end("dst"), "dst").where("c_src = c_dst").select("src", "dst")))
    return found


def cycles(edges: DataFrame, length: int | None = None) -> DataFrame:
    """path: elementary cycles, each once, from its smallest node on (which isn't repeated at the end); of at most length edges where that is given.

    Without a length, only edges within strongly connected components are searched, from all nodes at once that a greater one leads back to;
    a component's number of nodes bounds the rounds. Their number is exponential by nature; a length bounds it.
    """
    step = checkpointed(simple(edges))
    if length is None:
        own = checkpointed(strong_components(step))
        end = lambda e: own.select(F.col("id").alias(e), F.col("component").alias(f"c_{e}"))
        inner = step.join(end("src"), "src").join(end("dst"), "dst").where("c_src = c_dst").select("src", "dst")
        step = checkpointed(inner.where("src <> dst").unionByName(step.where("src = dst")))
    found = step.where("src = dst").select(F.array("src").alias("path"))
    ends = step.where("src > dst").select(F.col("dst").alias("src")).distinct()
    front = step.where("src < dst").join(ends, "src", "left_semi").select(F.array("src").alias("path"), F.col("dst").alias("next"))
    n = 1
    while length is None or n < length:
        n += 1
        nxt = checkpointed(front.join(step, F.col("next") == F.col("src")).where("dst >= path[0]").select(F.concat("path", F.array("next")).alias("path"), F.col("dst").alias("next")))
        if nxt.isEmpty():
            break
        found = found.unionByName(nxt.where("next = path[0]").select("path"))
        front = nxt.where(~F.array_contains("path", F.col("next")))
    return found


def decorated(found: DataFrame, nodes: DataFrame, on: str = "id", name: str = "name") -> DataFrame:
    """found with the nodes' name; an unknown id reads <id:N>."""
    named = nodes.select(F.col("id").alias(on), F.col(name).alias("label"))
    return found.join(named, on, "left").withColumn("label", F.coalesce("label", F.concat(F.lit("<id:"), F.col(on).cast("string"), F.lit(">"))))
