"""RCA-17: causal search among metrics (PC) and a Bayesian network, from statistics that one or few passes over the rows give.

Metrics are the columns of a wide table, those of one domain: their number bounds what the driver and every task hold (matrices of
metrics by metrics, families of at most MOST_PARENTS parents). Rows are never collected: the search for a skeleton is spread
over pairs of metrics, and orientation rules are rounds of joins on the edge table.

Defined results: rows with a null or NaN in any metric don't count; a constant metric is independent of all others; with too few rows
for a test (n <= size of the set + 3) a pair counts as independent; an empty table gives no edges.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

MOST_PARENTS = 3


def _whole(df: DataFrame, metrics: list[str]) -> DataFrame:
    keep = F.lit(True)
    for m in metrics:
        keep = keep & F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double"))
    return df.filter(keep).select(*[F.col(m).cast("double").alias(m) for m in metrics])


def correlations(df: DataFrame, metrics: list[str]) -> tuple[int, np.ndarray]:
    """How many rows count, and the correlation matrix: means in one pass, centred products in another."""
    rows = _whole(df, metrics)
    first = rows.agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics]).first()
    n, p = first["n"], len(metrics)
    if not n:
        return 0, np.eye(p)
    means = np.array([first[m] for m in metrics])

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((p, p))
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy() for k in range(p)]) - means[:, None]
            total += x @ x.T
        yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((p, p))
    for i, j, v in parts.collect():  # metrics by metrics
        total[i, j] = v
    spread = np.sqrt(np.diag(total))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(np.outer(spread, spread) > 1e-12 * max(1.0, n), total / np.outer(spread, spread), 0.0)
    np.fill_diagonal(r, 1.0)
    return n, np.clip(r, -1.0, 1.0)


def independent(r: np.ndarray, n: int, a: int, b: int, given: tuple[int, ...], limit: float) -> bool:
    """Fisher's test of a partial correlation; limit: of |z|."""
    free = n - len(given) - 3
    if free <= 0:
        return True
    inverse = np.linalg.pinv(r[np.ix_((a, b, *given), (a, b, *given))])
    partial = -inverse[0, 1] / math.sqrt(max(1e-300, inverse[0, 0] * inverse[1, 1]))
    return math.sqrt(free) * abs(math.atanh(max(-0.9999999, min(0.9999999, partial)))) < limit


def skeleton(spark, r: np.ndarray, n: int, alpha: float = 0.01, deepest: int = 3) -> tuple[DataFrame, DataFrame]:
    """a, b (a < b): pairs that no set of up to `deepest` neighbours separates; and a, b, given of the others.

    Level by level, the neighbours of a level fixed before it begins, so the order of pairs makes no difference. A pair's
    sets are tried in order, those of a's neighbours first; a pair is one row, and pairs are spread over tasks.
    """
    p, limit, matrix = len(r), NormalDist().inv_cdf(1 - alpha / 2), r
    pairs = spark.range(p * p).select((F.col("id") / p).cast("int").alias("a"), (F.col("id") % p).cast("int").alias("b")).filter("a < b")
    gone = None
    for level in range(deepest + 1):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("near"))  # metrics
        work = pairs.join(near.withColumnRenamed("near", "of_a"), "a").join(near.select(F.col("a").alias("b"), F.col("near").alias("of_b")), "b").select("a", "b", "of_a", "of_b")

        def run(batches: Iterator[pa.RecordBatch], level=level):
            for batch in batches:
                out = []
                for a, b, of_a, of_b in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    sets = [s for own, other in ((of_a, b), (of_b, a)) for s in itertools.combinations([x for x in own if x != other], level)]
                    out.append(next((list(s) for s in dict.fromkeys(sets) if independent(matrix, n, a, b, s, limit)), None))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["a", "b", "given"])

        tested = stored(work.mapInArrow(run, "a int, b int, given array<int>"), f"level{level}")
        apart = tested.filter("given is not null")
        gone = apart if gone is None else gone.unionByName(apart)
        pairs = tested.filter("given is null").select("a", "b")
        if both.groupBy("a").count().filter(F.col("count") > level + 1).isEmpty():
            break  # no metric has neighbours enough for a larger set
    return pairs, gone


def oriented(pairs: DataFrame, gone: DataFrame, most: int = 1000) -> DataFrame:
    """a, b, directed: colliders from the separating sets, then Meek's rules 1 to 3 until nothing changes; a < b if not directed.

    Rules are joins over the whole edge table, and all that a round asks for happens at once. An edge asked for both ways stays as it is among
    colliders, and goes from the smaller metric in a later round.
    """
    flip = lambda df: df.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = stored(pairs.unionByName(flip(pairs)), "adjacent")
    x, y = both.select(F.col("a").alias("x"), F.col("b").alias("c")), both.select(F.col("a").alias("y"), F.col("b").alias("c"))
    open_ = x.join(y, "c").filter("x < y").join(both.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti")
    hit = open_.join(gone.select(F.col("a").alias("x"), F.col("b").alias("y"), "given"), ["x", "y"]).filter(~F.array_contains("given", F.col("c")))
    asked = hit.select(F.col("x").alias("a"), F.col("c").alias("b")).unionByName(hit.select(F.col("y").alias("a"), F.col("c").alias("b"))).distinct()
    directed = stored(asked.join(flip(asked), ["a", "b"], "left_anti"), "directed")
    for _ in range(most):
        known = directed.unionByName(flip(directed))
        loose = both.join(known, ["a", "b"], "left_anti")  # in both directions
        to = lambda a, b, of=directed: of.select(F.col("a").alias(a), F.col("b").alias(b))
        one = to("z", "a").join(loose, "a").filter("z <> b").join(both.select(F.col("a").alias("z"), "b"), ["z", "b"], "left_anti").select("a", "b")
        two = to("a", "m").join(to("m", "b"), "m").select("a", "b").join(loose, ["a", "b"], "left_semi")
        sides = loose.join(loose.select("a", F.col("b").alias("c")), "a").join(to("c", "b"), ["c", "b"]).select("a", "b", "c")
        three = sides.join(sides.withColumnRenamed("c", "d"), ["a", "b"]).filter("c < d").join(both.select(F.col("a").alias("c"), F.col("b").alias("d")), ["c", "d"], "left_anti").select("a", "b")
        asked = stored(one.unionByName(two).unionByName(three).distinct(), "asked")
        if asked.isEmpty():
            break
        more = asked.join(flip(asked), ["a", "b"], "left_anti").unionByName(asked.join(flip(asked), ["a", "b"], "left_semi").filter("a < b"))
        directed = stored(directed.unionByName(more), "directed")
    loose = pairs.join(directed.unionByName(flip(directed)), ["a", "b"], "left_anti")
    return directed.withColumn("directed", F.lit(True)).unionByName(loose.withColumn("directed", F.lit(False)))


def pc(df: DataFrame, metrics: list[str], alpha: float = 0.01, deepest: int = 3) -> DataFrame:
    """src, dst, directed: the causal graph of some columns; an edge that isn't directed stands once, its metrics in their order."""
    n, r = correlations(df, metrics)
    pairs, gone = skeleton(df.sparkSession, r, n, alpha, deepest)
    name = lambda c: F.get(F.array(*[F.lit(m) for m in metrics]), F.col(c))
    return oriented(pairs, gone).select(name("a").alias("src"), name("b").alias("dst"), "directed")


# --- Bayesian network ----------------------------------------------------------------------------------------------

def cells(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Different rows of states (columns of ints from 0), and how often each occurs."""
    states = df.select(*[c.cast("int").alias(m) for m, c in metrics.items()]).dropna()
    return stored(states.groupBy(*metrics).agg(F.count("*").alias("n")), "cells")


class Network:
    """Metrics, their numbers of states, parents, and tables of probabilities with the parents' axes first."""

    def __init__(self, metrics: list[str], states: list[int], parents: dict[int, tuple[int, ...]], tables: dict[int, np.ndarray]):
        self.metrics, self.states, self.parents, self.tables = metrics, states, parents, tables

    def posterior(self, target: int, evidence: dict[int, int]) -> np.ndarray:
        """P(target | evidence), by eliminating the other metrics, the one with the smallest factor first."""
        factors = []
        for m, table in self.tables.items():
            axes = [*self.parents[m], m]
            table = table[tuple(evidence[v] if v in evidence and v != target else slice(None) for v in axes)]
            factors.append(([v for v in axes if v not in evidence or v == target], table))
        hidden = [v for v in range(len(self.metrics)) if v != target and v not in evidence]
        while hidden:
            width = lambda v: len({u for axes, _ in factors if v in axes for u in axes})
            v = min(hidden, key=lambda v: (width(v), v))
            hidden.remove(v)
            own = [f for f in factors if v in f[0]]
            factors = [f for f in factors if v not in f[0]]
            axes = sorted({u for a, _ in own for u in a} - {v})
            factors.append((axes, _product(own, axes)))
        out = _product(factors, [target])
        return out / out.sum()


def _product(factors: list[tuple], axes: list[int]) -> np.ndarray:
    """The product of factors, summed over all axes but some."""
    at = {v: k for k, v in enumerate(sorted({v for a, _ in factors for v in a}))}
    return np.einsum(*[z for a, t in factors for z in (t, [at[v] for v in a])], [at[v] for v in axes])


def _counted(table: DataFrame, families: list[tuple], states: list[int]) -> dict[tuple, np.ndarray]:
    """How often each state of each family (parents, then the child) occurs; one pass over the cells for all families."""
    size = [int(np.prod([states[v] for v in f])) for f in families]
    at = np.concatenate([[0], np.cumsum(size)])

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(at[-1], np.int64)
        for batch in batches:
            x, n = [batch.column(k).to_numpy() for k in range(len(states))], batch.column(len(states)).to_numpy()
            for k, f in enumerate(families):
                code = np.zeros(len(n), np.int64)
                for v in f:
                    code = code * states[v] + x[v]
                total[at[k] : at[k + 1]] += np.bincount(code, n, size[k]).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "n"])

    total = np.zeros(at[-1], np.int64)
    for i, n in table.mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():  # states of families
        total[i] = n
    return {f: total[at[k] : at[k + 1]].reshape([states[v] for v in f]) for k, f in enumerate(families)}


def _score(counts: np.ndarray) -> float:
    """The family's Bayesian information criterion."""
    n, whole = counts.sum(axis=-1, keepdims=True), counts.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        likely = np.where(counts > 0, counts * np.log(counts / n), 0.0).sum()
    return float(likely - 0.5 * math.log(max(2, whole)) * (counts.shape[-1] - 1) * np.prod(counts.shape[:-1]))


def _reaches(parents: dict[int, tuple], a: int, b: int) -> bool:
    """Whether b is a or an ancestor of a."""
    todo, seen = [a], set()
    while todo:
        v = todo.pop()
        if v == b:
            return True
        if v not in seen:
            seen.add(v)
            todo += parents[v]
    return False


def learned(table: DataFrame, states: dict[str, int], forbidden: set[tuple[str, str]] = frozenset(), rounds: int = 200) -> Network:
    """A network by hill climbing: the edge added, taken away or turned that gains most, until none gains; ties by metric order.

    table: cells. Each round asks one pass for the families it hasn't counted yet. forbidden: (src, dst) edges that must not be.
    """
    metrics, sizes = list(states), list(states.values())
    p, scores = len(metrics), {}
    counts: dict[tuple, np.ndarray] = {}
    parents: dict[int, tuple[int, ...]] = {v: () for v in range(p)}
    barred = {(metrics.index(a), metrics.index(b)) for a, b in forbidden}
    plus = lambda s, v: tuple(sorted((*s, v)))
    minus = lambda s, v: tuple(x for x in s if x != v)

    for _ in range(rounds):
        moves = []  # (changed families, what to do)
        for a, b in itertools.permutations(range(p), 2):
            if a in parents[b]:
                moves.append((((b, minus(parents[b], a)),), ("cut", a, b)))
                if len(parents[a]) < MOST_PARENTS and (b, a) not in barred and not _reaches(parents | {b: minus(parents[b], a)}, b, a):
                    moves.append((((b, minus(parents[b], a)), (a, plus(parents[a], b))), ("turn", a, b)))
            elif len(parents[b]) < MOST_PARENTS and (a, b) not in barred and not _reaches(parents, a, b):
                moves.append((((b, plus(parents[b], a)),), ("add", a, b)))
        needed = {f for m, _ in moves for f in m} | set(parents.items())
        new = sorted(f for f in needed if f not in scores)
        if new:
            found = _counted(table, [(*s, v) for v, s in new], sizes)
            for v, s in new:
                counts[(v, s)] = found[(*s, v)]
                scores[(v, s)] = _score(found[(*s, v)])
        gain = lambda m: sum(scores[f] - scores[(f[0], parents[f[0]])] for f in m[0])
        best = max(moves, key=lambda m: round(gain(m), 9), default=None)
        if best is None or gain(best) <= 1e-9:
            break
        for v, s in best[0]:
            parents[v] = s
    tables = {v: (counts[(v, s)] + 1.0) / (counts[(v, s)] + 1.0).sum(axis=-1, keepdims=True) for v, s in parents.items()}
    return Network(metrics, sizes, parents, tables)


def edges_of(spark, network: Network) -> DataFrame:
    """src, dst."""
    return spark.createDataFrame([(network.metrics[a], network.metrics[b]) for b, s in network.parents.items() for a in s], "src string, dst string")


def bayesian_causes(network: Network, evidence: DataFrame, state: int = 1, roots: list[str] | None = None) -> DataFrame:
    """All columns of evidence with cause and probability: for each row and root, how likely the root is in a state, given the others' states.

    evidence: a column for each metric, null where unknown; a root's own state isn't used. roots: metrics without parents unless given.
    Each different row of states is worked out once.
    """
    own = [v for v in range(len(network.metrics)) if (network.metrics[v] in roots if roots is not None else not network.parents[v])]
    columns = [F.col(m).cast("int").alias(m) for m in network.metrics]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(len(network.metrics)))))
            chances = [network.posterior(v, {u: s for u, s in enumerate(r) if s is not None and u != v})[state] for r in rows for v in own]
            names = [network.metrics[v] for _ in rows for v in own]
            took = pa.array(np.repeat(np.arange(len(rows)), len(own)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(took) for k in range(len(network.metrics))), pa.array(names, pa.string()), pa.array(chances, pa.float64())], names=[*network.metrics, "cause", "probability"])

    schema = ", ".join([*(f"`{m}` int" for m in network.metrics), "cause string, probability double"])
    known = evidence.select(*columns).distinct().mapInArrow(run, schema)
    same = F.lit(True)
    for m in network.metrics:
        same = same & F.col(f"e.{m}").cast("int").eqNullSafe(F.col(f"k.{m}"))
    return evidence.alias("e").join(known.alias("k"), same).select("e.*", "k.cause", "k.probability")
