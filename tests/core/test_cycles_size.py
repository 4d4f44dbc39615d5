"""Strong components and cycles: the number of rounds, the paths that are kept, pieces above and below their limits."""

import random

import pytest
from quernstone.operators import graph


def components(edges):
    """{node: least node of its strong component}, of two nodes or more, by reachability."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            new = after.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        reach[a] = seen
    own = {a: {b for b in reach[a] if a in reach[b]} | {a} for a in reach}
    return {a: min(of) for a, of in own.items() if len(of) > 1}


def test_rounds_and_paths_of_long_rings(spark, monkeypatch):
    calls, most, paths, cut = [], 16, [], graph.checkpointed

    def counted(df):
        made = cut(df)
        calls.append(1)
        assert len(calls) <= most
        if "path" in made.columns:
            paths.append(made.count())
        return made

    monkeypatch.setattr(graph, "checkpointed", counted)
    n, rings = 24, 4  # each ring leads to the next
    edges = [(r * n + i, r * n + (i + 1) % n) for r in range(rings) for i in range(n)] + [(r * n + 7, r * n + n + 3) for r in range(rings - 1)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert {tuple(r) for r in graph.strong_components(frame).collect()} == set(components(edges).items())
    most += len(calls) + n + 3
    assert sorted(tuple(r.path) for r in graph.cycles(frame).collect()) == [tuple(range(r * n, r * n + n)) for r in range(rings)]
    assert max(paths) <= rings


@pytest.mark.parametrize("piece, hub", [(50_000, 1_000_000), (6, 2)])
def test_components_of_pieces_of_all_sizes(spark, monkeypatch, piece, hub):
    monkeypatch.setattr(graph, "PIECE", piece)
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(3)
    edges = [(0, 1), (1, 0), (1, 1), (1000, 1000)]
    for k in range(2, 12):  # pieces of 2 to 11 nodes, sparse and dense, with copies of edges
        edges += [(k * 20 + rng.randrange(k), k * 20 + rng.randrange(k)) for _ in range(rng.choice([k, 2 * k]))]
    edges += [(500, 500 + i) for i in range(1, 9)] + [(520 + i, 600) for i in range(9)] + [(600, 520)]
    want = components(edges)
    for kind, of in (("long", int), ("string", lambda x: f"n{x:04}")):
        frame = spark.createDataFrame([(of(a), of(b)) for a, b in edges], f"src {kind}, dst {kind}")
        got = graph.strong_components(frame).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == {(of(a), of(b)) for a, b in want.items()}
