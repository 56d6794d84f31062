"""Near-duplicate documents by MinHash with tensored banding (operator 10).

A document's set holds its distinct shingles. Two collections of SIDE minhash groups, ROWS minhashes each, are computed
for it; every pair of a group of the first and a group of the second makes one table key, so SIDE * SIDE tables cost
2 * SIDE * ROWS minhashes. Two sets of similarity s meet in some table with probability (1 - (1 - s**ROWS)**SIDE)**2,
over 0.999 at 0.8. One bit of every minhash is kept as a sketch: two sets that differ in more bits than a link of the least
similarity does but for a chance of 1 in 100,000 are not compared.

Equal sets count as one class before anything is compared, so copies make no pairs. Groups that no other class shares
are left out before tables are formed. In a bucket every class is held against one hub, not against all others;
links are confirmed on full sets. Buckets that hold more than one component after that are searched again, exactly:
classes outside a bucket's largest component meet the others by their rarest shingles. All confirmed links then
give components.

Defined results: a null or empty text, or one without words, has an empty set and its own component; doc_id null
is a component of its own; in `classes` repeated rows share their id and so their fate, and a doc_id with two texts has a row
for each; `keep` decides by row: of each group one row stays, that of the smallest doc_id (null last), and all rows without
words; other columns are ignored by `classes`, and kept by `keep`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, PLACE, U64, Rolling, mix, placed, seeds, small_batches, steps, stored, texts_of, trimmed, words_of
from .graphs import components, tops

SHINGLE, SIDE, ROWS = 4, 20, 5
PERCENT = 80

_ROLL = Rolling(1010)
_STEP = U64(0x9E3779B97F4A7C15)
_HASHES = seeds(2 * SIDE * ROWS, 4242)
SKETCH = -(-len(_HASHES) // 64)


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the number of each."""
    raw = LOWER[raw]
    start, end, text = words_of(raw, at)
    w = mix(_ROLL.ranges(_ROLL.prefix(raw), start, end) + (end - start).astype(U64))
    n = np.bincount(text, minlength=len(at) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    g = np.full(len(w), U64(k))  # of the run of k words, or of the whole text if it has fewer, from each word on
    size = np.minimum(np.maximum(n, 0), k)
    g = (g if not len(w) else size[text].astype(U64)) * _STEP
    for j in range(k):
        m = len(w) - j
        if m > 0:
            g[:m] = np.where(j < size[text[:m]], mix(g[:m] * _STEP + w[j:]), g[:m])
    sets, count = [], np.zeros(len(n), np.int64)
    for i in np.flatnonzero(n):
        own = np.unique(g[first[i] : first[i + 1] - min(k, n[i]) + 1])
        sets.append(own)
        count[i] = len(own)
    return np.concatenate(sets) if sets else np.zeros(0, U64), count


def _signatures(k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            raw, at = texts_of(batch.column(1))
            for lo, hi in steps(at):
                sets, count = shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k)
                have = np.flatnonzero(count)
                begin = np.concatenate([[0], np.cumsum(count[have])])[:-1]
                groups = np.zeros((hi - lo, 2 * SIDE), U64)
                bits = np.zeros((hi - lo, SKETCH), U64)
                key = np.zeros((hi - lo, 2), U64)
                if len(have):
                    for j, salt in enumerate((U64(0x5851F42D4C957F2D), U64(0x2545F4914F6CDD1D))):
                        key[have, j] = mix(np.add.reduceat(mix(sets ^ salt), begin) + count[have].astype(U64))
                    for j, h in enumerate(_HASHES):
                        low = mix(np.minimum.reduceat(sets * h, begin))  # the sets are mixed already
                        groups[have, j // ROWS] = groups[have, j // ROWS] * _STEP + low
                        bits[have, j // 64] |= (low & U64(1)) << U64(j % 64)
                yield pa.record_batch({
                    "doc_id": batch.column(0).slice(lo, hi - lo), "place": batch.column(2).slice(lo, hi - lo), "k1": pa.array(key[:, 0].view(np.int64)), "k2": pa.array(key[:, 1].view(np.int64)), "n_shingles": pa.array(count),
                    "groups": pa.FixedSizeListArray.from_arrays(pa.array(mix(groups).view(np.int64).ravel()), 2 * SIDE).cast(pa.list_(pa.int64())),
                    "sketch": pa.FixedSizeListArray.from_arrays(pa.array(bits.view(np.int64).ravel()), SKETCH).cast(pa.list_(pa.int64())),
                })

    return run


def _full_sets(k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            raw, at = texts_of(batch.column(1))
            for lo, hi in steps(at):
                sets, count = shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k)
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.record_batch({"set": batch.column(0).slice(lo, hi - lo), "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.view(np.int64)))})

    return run


def classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    texts = placed(docs, "doc_id", "text")
    rows, found = _grouped(texts.withColumnRenamed("__place", "place"), k, percent)
    smallest = stored(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    known = found.join(smallest, "root").select("k1", "k2", "component_id")
    # Rows without words have no key, and go apart: they would all meet in one task.
    with_ = rows.filter("n_shingles > 0").join(known, ["k1", "k2"])
    out = with_.select("doc_id", "n_shingles", "component_id").unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _grouped(texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, place, k1, k2, n_shingles), and the classes of equal sets (k1, k2, doc_id, root). texts: doc_id, text, place."""
    small_batches(texts.sparkSession)
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = stored(texts.mapInArrow(trimmed(_signatures(k)), f"doc_id {kind}, place {PLACE}, k1 long, k2 long, n_shingles long, groups array<long>, sketch array<long>"), "signatures")
    same = rows.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("place", "n_shingles", "groups", "sketch")).alias("x"))
    sets = stored(same.select(F.monotonically_increasing_id().alias("set"), "k1", "k2", "doc_id", "x.*"), "sets")

    about = F.struct(F.col("n_shingles").alias("n"), "sketch").alias("about")
    halves = sets.select("set", F.posexplode("groups").alias("i", "key"))
    # Stored, here and below: a join can split a hot key of one side only if the other isn't an aggregate made on the way.
    common = stored(halves.groupBy("i", "key").agg(F.count("*").alias("c")).filter("c > 1").select("i", "key"), "common")
    live = halves.join(common, ["i", "key"]).groupBy("set").agg(F.collect_list(F.struct("i", "key")).alias("live"))  # 2 * SIDE at most
    first, second = F.filter("live", lambda x: x.i < SIDE), F.filter("live", lambda x: x.i >= SIDE)
    keys = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x.i, x.key, y.i, y.key))))
    table = stored(live.select("set", F.explode(keys).alias("bucket")), "tables")
    hubs = stored(table.groupBy("bucket").agg(F.min("set").alias("hub"), F.count("*").alias("c")).filter("c > 1").select("bucket", "hub"), "hubs")
    bits, p = len(_HASHES), (1 - percent / 100) / 2
    most = int(bits * p + 4.5 * (bits * p * (1 - p)) ** 0.5)

    def near(a, b):
        """A link needs sizes as near, and sketches."""
        differ = sum((F.bit_count(a["sketch"][i].bitwiseXOR(b["sketch"][i])) for i in range(1, SKETCH)), F.bit_count(a["sketch"][0].bitwiseXOR(b["sketch"][0])))
        return (100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])) & (differ <= most)

    voted = stored(table.join(hubs, "bucket").filter("set <> hub").groupBy(F.col("set").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("votes")), "voted")
    of = lambda c, as_: sets.select(F.col("set").alias(c), about.alias(as_))
    pairs = stored(voted.join(of("a", "x"), "a").join(of("b", "y"), "b").filter(near(F.col("x"), F.col("y"))).select("a", "b", "votes"), "pairs")

    full: DataFrame | None = None

    def fetched(need: DataFrame, name: str) -> DataFrame:
        """The whole sets of some classes, those so far included."""
        nonlocal full
        need = need.join(full.select("set"), "set", "left_anti") if full is not None else need
        at = sets.join(need, "set").select("set", "place")
        new = stored(texts.join(at, "place").select("set", "text").mapInArrow(trimmed(_full_sets(k)), "set long, shingles array<long>"), f"full-{name}")
        full = new if full is None else full.unionByName(new)
        return full

    def confirmed(some: DataFrame, name: str) -> DataFrame:
        """Those pairs whose whole sets are similar."""
        have = fetched(some.select(F.col("a").alias("set")).union(some.select(F.col("b").alias("set"))).distinct(), name)
        both = some.join(have.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a").join(have.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")
        both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))
        return stored(both.filter(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b"), f"links-{name}")

    def labelled(df: DataFrame, col: str, roots: DataFrame, as_: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(col), F.col("root").alias(as_)), col, "left").withColumn(as_, F.coalesce(as_, col))

    def merged(roots: DataFrame, some: DataFrame, name: str) -> DataFrame:
        """Roots after links between them came to light."""
        ends = labelled(labelled(some, "a", roots, "ra"), "b", roots, "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        new = stored(components(ends, name), f"{name}-new")
        known = new.select(F.col("node").alias("root"), F.col("root").alias("to"))
        old = roots.join(known, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        return stored(old.unionByName(new.join(roots.select("node"), "node", "left_anti")), f"{name}-roots")

    # Best hub of each first, then all hubs in other components. A hub is the smallest of its bucket, so best hubs make a forest.
    best = stored(pairs.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b")), "best")
    roots = tops(confirmed(best, "best"), "first")
    rest = labelled(labelled(pairs.join(best, ["a", "b"], "left_anti"), "a", roots, "ra"), "b", roots, "rb").filter("ra <> rb").select("a", "b")
    roots = merged(roots, confirmed(stored(rest, "rest"), "rest"), "second")

    # Buckets that still hold several components: every pair that could join two of them has an end outside the largest.
    # Such classes meet the others by their rarest shingles: of two sets that share `least` shingles, each has one of the
    # shared ones among its first size - least + 1, in any order that is the same for both (here by frequency).
    member = labelled(table.join(hubs.select("bucket"), "bucket"), "set", roots, "root")
    tally = member.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    mixed = tally.groupBy("bucket").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("bucket", "main")
    mixed = stored(mixed, "mixed")
    open_ = stored(member.join(mixed, "bucket").groupBy("set").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("few")).join(sets.select("set", about), "set"), "open")
    whole = fetched(open_.select("set"), "open").join(open_.select("set"), "set").select("set", F.explode("shingles").alias("shingle"))
    often = stored(whole.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1"), "often")
    ranked = whole.join(often, "shingle", "left").groupBy("set").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "shingle"))).alias("order"))
    first = F.slice("order", 1, F.size("order") - F.ceil(F.size("order") * percent / 100).cast("int") + 1)
    heads = ranked.join(open_, "set").select("set", "root", "about", "few", F.posexplode(first).alias("at", "x")).filter("x.often > 1").select("set", "root", "about", "few", "at", "x.shingle")
    heads = stored(heads, "heads")
    one = heads.filter("few").select("shingle", *[F.col(c).alias(f"{c}1") for c in ("set", "root", "about", "at")])
    n1, n2 = F.col("about1.n"), F.col("about.n")
    least = F.ceil((n1 + n2) * percent / (100 + percent))
    more = (
        one.join(heads, "shingle")
        .filter((F.col("root1") != F.col("root")) & (F.col("at1") <= n1 - least) & (F.col("at") <= n2 - least) & (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)))
        .select(F.least("set", "set1").alias("a"), F.greatest("set", "set1").alias("b")).distinct()
    )
    roots = merged(roots, confirmed(stored(more, "more"), "more"), "third")
    return rows.select("doc_id", "place", "k1", "k2", "n_shingles"), stored(labelled(sets.select("set", "k1", "k2", "doc_id"), "set", roots, "root"), "grouped")


def keep(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns."""
    own = placed(docs, *docs.columns)
    rows, found = _grouped(own.select("doc_id", "text", F.col("__place").alias("place")), k, percent)
    rows = rows.filter("n_shingles > 0").join(found.select("k1", "k2", "root"), ["k1", "k2"]).select("root", "place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place").alias("rank"))
    first = stored(rows.groupBy("root").agg(F.min("rank").alias("first")), "first")
    gone = rows.join(first, "root").filter(F.col("place") != F.col("first.place")).select(F.col("place").alias("__place"))
    return own.join(stored(gone, "gone"), "__place", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
