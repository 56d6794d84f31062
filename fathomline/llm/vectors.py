"""Near-duplicate vectors by product quantisation (operator 3).

Equal vectors count as one class, told apart by two hashes of their components. A bounded sample of the classes trains, for each
length of vector in it, coarse centres and, on residuals, codes for each subspace; every class is put in the list of its
nearest centre with its code and the length of its quantisation error. Vectors of other lengths never meet; a length that the
sample lacks has one list.

Two vectors whose cosine is high enough lie within a known distance r, so lists whose border is farther than r from a
vector hold none of its links; of the others it probes those with the nearest borders, `probes` of them: a number that grows with
the lists. A pair is found if either of its vectors probes the list of the other. In a list, table look-ups give each
pair's distance to the code; as the error is known, none within r is missed. What is left is compared exactly, in
double precision. The tests measure the recall, with over 1,000 lists too.

Lists are cut into blocks, visitors into slices, so that no task gets more than BLOCK of either; a task returns counts and
a spanning forest of the links it found, not pairs. Vectors travel as bytes in their own precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; repeated rows
count as copies that link with each other, and a vec_id with several vectors has a row for each; null vec_id is never a
component's smallest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graphs import components

COSINE = 0.95
#: Classes that train the centres; classes a list should hold; code parts and codes a part; turns of the training.
TRAIN_ROWS, LIST_ROWS, PARTS, CODES, TURNS = 20_000, 256, 8, 256, 8
#: Bytes of centres that a task may hold: beyond it, lists grow instead of their number.
CENTRE_BYTES = 64 << 20
BLOCK = 2048
#: Lists that a vector probes: this many at least, and the root of their number times ROOT.
PROBES, ROOT = 12, 1.0


def probes(lists: int) -> int:
    return max(PROBES, int(np.ceil(ROOT * np.sqrt(lists))))


def means(x: np.ndarray, k: int, turns: int = TURNS) -> np.ndarray:
    """k-means centres, from k rows spread evenly over x."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(turns):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 1024] @ c.T, axis=1) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0, int)


def train(x: np.ndarray, lists: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centres, and codes for each part of the residuals, of unit vectors x."""
    centres = means(x, max(1, min(lists, len(x))))
    rest = x - centres[nearest(x, centres)]
    return centres, [means(r, min(CODES, len(r))) for r in np.array_split(rest, min(PARTS, x.shape[1]), axis=1)]


def untrained(dim: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """One list with one code."""
    return np.zeros((1, dim)), [np.zeros((1, x.shape[1])) for x in np.array_split(np.zeros((1, dim)), min(PARTS, dim), axis=1)]


def units(data: list[bytes], kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _read(kind: type):
    """Each row's vector as bytes with two hashes, or null if it takes no part."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            given = batch.column(1)
            values = given.flatten()
            gaps = np.asarray(values.is_null())
            x = values.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            size = np.asarray(given.value_lengths().fill_null(0))
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(gaps | ~np.isfinite(x))])
            some = np.concatenate([[0], np.cumsum(x != 0)])
            fine = (size > 0) & (bad[ends] == bad[ends - size]) & (some[ends] > some[ends - size])
            data = [x[e - n : e].tobytes() if ok else None for e, n, ok in zip(ends, size, fine)]
            sums = [hashlib.blake2b(d, digest_size=16).digest() if d else bytes(16) for d in data]
            both = np.frombuffer(b"".join(sums), np.int64).reshape(-1, 2)
            yield pa.record_batch({"vec_id": batch.column(0), "k1": pa.array(both[:, 0], mask=~fine), "k2": pa.array(both[:, 1], mask=~fine), "dim": pa.array(size.astype(np.int32)), "data": pa.array(data, pa.binary())})

    return run


def _encode(shared, kind: type, r: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart: dict[int, np.ndarray] = {}
        for batch in rows:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own_rows = np.flatnonzero(dims == dim)
                centres, books = shared.value.get(dim) or untrained(dim)
                if dim not in apart and len(centres) <= 1024:
                    apart[dim] = np.maximum(np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(2), 0)), 1e-12)
                most = probes(len(centres))
                for lo in range(0, len(own_rows), 500):
                    b = batch.take(pa.array(own_rows[lo : lo + 500]))
                    x = units(b.column("data").to_pylist(), kind)
                    own = nearest(x, centres)
                    rest = x - centres[own]
                    code, error, at = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x)), 0
                    for p, book in enumerate(books):
                        part = rest[:, at : at + book.shape[1]]
                        code[:, p] = nearest(part, book)
                        error += ((part - book[code[:, p]]) ** 2).sum(1)
                        at += book.shape[1]
                    far = np.maximum(((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)), 0)
                    gap = apart[dim][own] if dim in apart else np.maximum(np.sqrt(np.maximum(((centres[own] ** 2).sum(1)[:, None] - 2 * centres[own] @ centres.T + (centres**2).sum(1)), 0)), 1e-12)
                    border = (far - far[np.arange(len(x)), own][:, None]) / (2 * gap)
                    border[np.arange(len(x)), own] = np.inf
                    if len(centres) > most:
                        last = np.partition(border, most - 1, axis=1)[:, most - 1 : most]
                        border = np.where(border <= last, border, np.inf)
                    visit = border <= r + 1e-9
                    yield pa.record_batch({
                        "id": b.column("id"), "n": b.column("n"), "dim": b.column("dim"), "data": b.column("data"), "list": pa.array(own.astype(np.int32)), "error": pa.array(np.sqrt(error)),
                        "code": pa.array([c.tobytes() for c in code], pa.binary()), "visits": pa.array([np.flatnonzero(v).astype(np.int32) for v in visit], pa.list_(pa.int32())),
                    })

    return run


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number reachable, after the links i - j came to those that gave root."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root != root[root]).any():
            root = root[root]


def _search(shared, kind: type, r: float, cosine: float):
    def run(key, table):
        dim, here = key[0].as_py(), key[1].as_py()
        centres, books = shared.value.get(dim) or untrained(dim)
        ids, n, member = table["id"].to_numpy(), table["n"].to_numpy(), table["member"].to_numpy(zero_copy_only=False)
        home, own = table["home"].to_numpy(zero_copy_only=False), table["own"].to_numpy().astype(np.int64)
        x = units(table["data"].to_pylist(), kind)
        m = np.flatnonzero(member)
        visits = table["visits"].combine_chunks()
        lists = len(centres)
        visited = np.sort(np.repeat(np.arange(len(ids)), np.asarray(visits.value_lengths().fill_null(0))) * lists + visits.flatten().to_numpy())
        code = np.frombuffer(b"".join(table["code"].take(pa.array(m)).to_pylist()), np.uint8).reshape(len(m), len(books))
        reach = (r + 1e-9 + table["error"].to_numpy()[m]) ** 2 + 1e-7
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        guests = np.flatnonzero(~member)
        for lo in range(0, len(guests), 64):
            q = guests[lo : lo + 64]
            rest, far, at = x[q] - centres[here], np.zeros((len(q), len(m))), 0
            for p, book in enumerate(books):
                part = rest[:, at : at + book.shape[1]]
                look_up = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
                far += look_up[:, code[:, p]]
                at += book.shape[1]
            i, j = np.nonzero(far <= reach)
            i, j = q[i], m[j]
            ok = (~home[i] | (ids[i] < ids[j])) & (ids[i] != ids[j])  # each pair of a list once
            i, j = i[ok], j[ok]
            ok = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[ok], j[ok]
            if len(i):
                # A guest from a list of smaller number leaves the pair to the member, if that one visits the guest's list.
                want = j * lists + own[i]
                if len(visited):
                    at = np.minimum(np.searchsorted(visited, want), len(visited) - 1)
                    ok = home[i] | (own[i] > here) | (visited[at] != want)
                    i, j = i[ok], j[ok]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                root = _join(root, i, j)
        have = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[have]), "links": pa.array(links[have]), "with": pa.array(ids[root[have]])})

    return run


def trained(classes: DataFrame, count: int, kind: type) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """Centres and codes for each length of vector in a sample of about TRAIN_ROWS classes."""
    share = min(1.0, TRAIN_ROWS / max(1, count))
    draw = F.pmod(F.xxhash64("k1", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))
    sampled = classes.filter(draw).select("k1", "k2", "dim", "data").toArrow().sort_by([("k1", "ascending"), ("k2", "ascending")])
    dims, out = np.asarray(sampled["dim"]), {}
    for dim in np.unique(dims).tolist():
        x = units(sampled["data"].take(pa.array(np.flatnonzero(dims == dim))).to_pylist(), kind)
        out[dim] = train(x, min(max(1, CENTRE_BYTES // (8 * dim)), -(-int(len(x) / share) // LIST_ROWS)))
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    name, number = vectors.schema["embedding"].dataType, vectors.schema["vec_id"].dataType.simpleString()
    wide = "float" if name.elementType.simpleString() == "float" else "double"
    kind = np.float32 if wide == "float" else np.float64
    given = vectors.select("vec_id", F.col("embedding").cast(f"array<{wide}>").alias("embedding"))
    rows = stored(given.mapInArrow(_read(kind), f"vec_id {number}, k1 long, k2 long, dim int, data binary"), "rows")
    one = rows.filter("k1 is not null").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("vec_id").alias("vec_id"), F.min("dim").alias("dim"), F.min("data").alias("data"))
    classes = stored(one.withColumn("id", F.monotonically_increasing_id()), "classes")
    r = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    shared = spark.sparkContext.broadcast(trained(classes, classes.count(), kind))
    coded = classes.select("id", "n", "dim", "data").mapInArrow(_encode(shared, kind, r), "id long, n long, dim int, data binary, list int, error double, code binary, visits array<int>")
    coded = stored(coded, "coded")

    place = ["dim", "list"]
    guests = coded.select("id", "n", "dim", "data", F.explode(F.concat("visits", F.array("list"))).alias("at"), F.col("list").alias("own")).withColumnRenamed("at", "list")
    sizes = coded.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(guests.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).alias("slices")), place)
    sizes = stored(sizes, "sizes")
    salt = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    placed = coded.join(sizes, place).select(
        *place, salt("blocks").alias("block"), all_of("slices").alias("slice"), "id", "n", "data", "error", "code", "visits",
        F.col("list").alias("own"), F.lit(True).alias("member"), F.lit(False).alias("home"))
    asking = guests.join(sizes, place).select(
        *place, all_of("blocks").alias("block"), salt("slices").alias("slice"), "id", "n", "data", F.lit(0.0).alias("error"), F.lit(None).cast("binary").alias("code"),
        F.array().cast("array<int>").alias("visits"), "own", F.lit(False).alias("member"), (F.col("own") == F.col("list")).alias("home"))
    found = placed.unionByName(asking).groupBy(*place, "block", "slice").applyInArrow(_search(shared, kind, r, cosine), "id long, links long, with long")
    found = stored(found, "found")

    roots = components(found.select(F.col("id").alias("a"), F.col("with").alias("b")), "vectors")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = classes.select("id", "k1", "k2", "n", "vec_id").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    joined = stored(joined.withColumn("root", F.coalesce("root", "id")), "joined")
    smallest = stored(joined.groupBy("root").agg(F.min("vec_id").alias("component_id")), "smallest")
    known = joined.join(smallest, "root").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    # Rows that take no part go apart: they have no key, and would all meet in one task.
    with_ = rows.filter("k1 is not null").select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
    without = rows.filter("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return with_.unionByName(without)
