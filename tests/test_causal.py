"""Causal search and Bayesian networks against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import causal
from statistics import NormalDist


def linear(seed: int, p: int, n: int = 600, share: float = 0.35):
    r = np.random.default_rng(seed)
    a = np.triu((r.random((p, p)) < share) * r.uniform(0.5, 1.0, (p, p)) * r.choice([-1, 1], (p, p)), 1)
    x = np.zeros((n, p))
    for k in range(p):
        x[:, k] = x @ a[:, k] + r.normal(size=n)
    return x[:, r.permutation(p)]


def plain_pc(x, alpha, deepest):
    """Loops over pairs and sets, then the rules, one round for all edges at a time."""
    n, p = x.shape
    r = np.corrcoef(x.T)
    limit = NormalDist().inv_cdf(1 - alpha / 2)
    edges, sets = {(a, b) for a in range(p) for b in range(a + 1, p)}, {}
    for level in range(deepest + 1):
        near = {v: sorted({a + b - v for a, b in edges if v in (a, b)}) for v in range(p)}
        for a, b in sorted(edges):
            for own, other in ((near[a], b), (near[b], a)):
                for s in itertools.combinations([v for v in own if v != other], level):
                    at = [a, b, *s]
                    q = np.linalg.inv(r[np.ix_(at, at)])
                    if math.sqrt(n - len(s) - 3) * abs(math.atanh(-q[0, 1] / math.sqrt(q[0, 0] * q[1, 1]))) < limit and (a, b) not in sets:
                        sets[a, b] = set(s)
        edges -= set(sets)
    adjacent = edges | {(b, a) for a, b in edges}
    asked = set()
    for c in range(p):
        for a, b in itertools.combinations([v for v in range(p) if (v, c) in adjacent], 2):
            if (a, b) not in adjacent and c not in sets[a, b]:
                asked |= {(a, c), (b, c)}
    to = {e for e in asked if e[::-1] not in asked}
    while True:
        loose = {e for e in adjacent if e not in to and e[::-1] not in to}
        asked = set()
        for a, b in loose:
            one = any((z, a) in to and z != b and (z, b) not in adjacent for z in range(p))
            two = any((a, m) in to and (m, b) in to for m in range(p))
            sides = [c for c in range(p) if (a, c) in loose and (c, b) in to]
            three = any((c, d) not in adjacent for c, d in itertools.combinations(sides, 2))
            if one or two or three:
                asked.add((a, b))
        more = {e for e in asked if e[::-1] not in asked or e[0] < e[1]}
        if not more:
            return {(a, b, True) for a, b in to} | {(a, b, False) for a, b in loose if a < b}
        to |= more


def test_pc_equals_a_plain_version_on_50_graphs(spark):
    """All graphs at once, as one matrix in which those of different graphs have nothing to do with each other."""
    data = [linear(seed, 3 + seed % 5) for seed in range(50)]
    at = np.concatenate([[0], np.cumsum([x.shape[1] for x in data])])
    r = np.zeros((at[-1], at[-1]))
    for x, lo, hi in zip(data, at, at[1:]):
        r[lo:hi, lo:hi] = np.corrcoef(x.T)
    pairs, gone = causal.skeleton(spark, r, 600, 0.01, 2)
    got = {tuple(e) for e in causal.oriented(pairs, gone).collect()}
    for seed, (x, lo, hi) in enumerate(zip(data, at, at[1:])):
        assert {(a - lo, b - lo, d) for a, b, d in got if lo <= a < hi} == plain_pc(x, 0.01, 2), seed


def test_pc_from_rows(spark):
    x = linear(3, 6)
    names = [f"v{k}" for k in range(6)]
    df = spark.createDataFrame([tuple(map(float, v)) for v in x] + [(None,) * 6, (math.nan,) * 6], ", ".join(f"{c} double" for c in names)).repartition(3)
    count, matrix = causal.correlations(df, names)
    assert count == len(x) and np.allclose(matrix, np.corrcoef(x.T), atol=1e-9)
    assert {(names.index(a), names.index(b), d) for a, b, d in causal.pc(df, names, 0.01, 2).collect()} == plain_pc(x, 0.01, 2)


def test_collider_and_chain_are_told_apart(spark):
    r = np.random.default_rng(0)
    a, b = r.normal(size=(2, 3000))
    rows = [tuple(map(float, v)) for v in np.stack([a, b, a + b + 0.3 * r.normal(size=3000), np.full(3000, 2.0)], axis=1)]
    out = {tuple(e) for e in causal.pc(spark.createDataFrame(rows, "a double, b double, c double, still double"), ["a", "b", "c", "still"]).collect()}
    assert out == {("a", "c", True), ("b", "c", True)}
    chain = np.cumsum(r.normal(size=(3000, 3)), axis=1)
    out = {tuple(e) for e in causal.pc(spark.createDataFrame([tuple(map(float, v)) for v in chain], "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert out == {("a", "b", False), ("b", "c", False)}
    assert causal.pc(spark.createDataFrame([], "a double, b double"), ["a", "b"]).count() == 0


def enumerated(net, target, evidence):
    out = np.zeros(net.states[target])
    for states in itertools.product(*map(range, net.states)):
        if all(states[v] == s for v, s in evidence.items() if v != target):
            out[states[target]] += math.prod(net.tables[v][tuple(states[u] for u in (*net.parents[v], v))] for v in range(len(states)))
    return out / out.sum()


@pytest.mark.parametrize("seed", range(12))
def test_posteriors_equal_enumeration(seed):
    r = np.random.default_rng(seed)
    p = 5
    states = [int(r.integers(2, 4)) for _ in range(p)]
    parents = {v: tuple(sorted(r.choice(v, min(v, int(r.integers(0, 3))), replace=False).tolist())) for v in range(p)}
    tables = {v: r.dirichlet(np.ones(states[v]), [states[u] for u in parents[v]]) for v in range(p)}
    net = causal.Network([f"v{k}" for k in range(p)], states, parents, tables)
    for target in range(p):
        for known in ((), (0,), (1, 4), (0, 2, 3)):
            evidence = {v: int(r.integers(states[v])) for v in known}
            assert np.allclose(net.posterior(target, evidence), enumerated(net, target, evidence))


def test_network_is_learned_and_asked(spark):
    r = np.random.default_rng(4)
    a, b = r.random(4000) < 0.3, r.random(4000) < 0.4
    c = np.where(a | b, r.random(4000) < 0.9, r.random(4000) < 0.05)
    d = np.where(c, r.random(4000) < 0.8, r.random(4000) < 0.1)
    rows = [tuple(map(int, v)) for v in zip(a, b, c, d)] + [(None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int").repartition(3)
    cells = causal.cells(df, {m: F.col(m) for m in "abcd"})
    assert cells.agg(F.sum("n")).first()[0] == 4000
    net = causal.learned(cells, dict.fromkeys("abcd", 2))
    pairs = {frozenset((net.metrics[x], net.metrics[y])) for y, s in net.parents.items() for x in s}
    assert {frozenset("ac"), frozenset("bc"), frozenset("cd")} <= pairs and frozenset("ad") not in pairs
    counts = causal._counted(cells, [(0, 1, 2), (3,)], [2] * 4)
    assert counts[0, 1, 2][1, 0, 1] == sum(x == (1, 0, 1) for x in zip(a, b, c)) and counts[3,].tolist() == [int((~d).sum()), int(d.sum())]
    asked = spark.createDataFrame([(1, None, None, None, 1), (2, None, 0, None, 1), (3, None, 0, None, 1)], "id int, a int, b int, c int, d int")
    got = {(x["id"], x["cause"]): x["probability"] for x in causal.bayesian_causes(net, asked, roots=["a", "b"]).collect()}
    for i, evidence in ((1, {3: 1}), (2, {1: 0, 3: 1})):
        for k, m in enumerate("ab"):
            assert abs(got[i, m] - enumerated(net, k, {v: s for v, s in evidence.items() if v != k})[1]) < 1e-9
    assert got[2, "a"] == got[3, "a"] > got[1, "a"] > a.mean()
    barred = causal.learned(cells, dict.fromkeys("abcd", 2), forbidden={(x, "d") for x in "abc"})
    assert not barred.parents[3]
    assert causal.edges_of(spark, net).count() == sum(map(len, net.parents.values()))
