"""Strongly connected components by chain contraction and colouring, against Tarjan's algorithm."""

import random
import sys
import time

import pytest

from streamlake.operators import lint
from streamlake.operators.graph import strongly_connected


def tarjan(edges):
    sys.setrecursionlimit(100_000)
    graph = {}
    for a, b in edges:
        graph.setdefault(a, []).append(b)
        graph.setdefault(b, [])
    index, low, on, stack, out, counter = {}, {}, set(), [], {}, [0]

    def visit(v):
        index[v] = low[v] = counter[0]
        counter[0] += 1
        stack.append(v)
        on.add(v)
        for w in graph[v]:
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in on:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            members = []
            while True:
                w = stack.pop()
                on.discard(w)
                members.append(w)
                if w == v:
                    break
            for w in members:
                out[w] = (min(members), len(members) > 1 or w in graph[w])

    for v in graph:
        if v not in index:
            visit(v)
    return out


def run(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string")
    return {r.node: (r.component, r.cyclic) for r in strongly_connected(df, "a", "b").collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs_equal_tarjan(spark, seed):
    rng = random.Random(seed)
    names = [f"r{i:03d}" for i in range(60)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(70)}
    # a long chain closed into a cycle, and a chain hanging off it
    edges |= {(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)} | {("c040", "c000"), ("c010", "t0"), ("t0", "t1")}
    assert run(spark, sorted(edges)) == tarjan(sorted(edges))


def test_two_cycle_and_loops(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "c"), ("d", "e")]
    assert run(spark, edges) == tarjan(edges)


def test_a_long_cycle_without_pairs(spark):
    n = 10_000
    edges = [(f"role{i:05d}", f"role{(i + 1) % n:05d}") for i in range(n)] + [("outside", "role00000")]
    roles = spark.createDataFrame([(a, [b]) for a, b in edges], "name string, includes array<string>")
    started = time.time()
    found = lint.cyclic_roles(roles).collect()
    assert sorted(r.subject for r in found) == [f"role{i:05d}" for i in range(n)]
    assert time.time() - started < 300
