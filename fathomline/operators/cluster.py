"""Grouping of events in time, of entities by shape, and of components by topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from . import blocks, linkage
from . import distance as D


def dbscan_1d(df: DataFrame, eps: int, min_samples: int, keys: list[str], ts: str = "ts") -> DataFrame:
    """CLU-15: exact density clustering of times, without a UDF; cluster_id from 0 in each partition, -1 for noise.

    A row is core if min_samples rows (itself included) lie within eps. A core starts a cluster if the core before it is
    more than eps away. A row that is not core belongs to the earliest cluster with a core within eps.
    """
    p = Window.partitionBy(*keys).orderBy(ts)
    rows = df.withColumn("_core", F.count("*").over(p.rangeBetween(-eps, eps)) >= min_samples)
    core_ts = F.when(F.col("_core"), F.col(ts))
    rows = rows.withColumn("_prev", F.max(core_ts).over(p.rangeBetween(Window.unboundedPreceding, -1)))
    start = F.col("_core") & (F.col("_prev").isNull() | (F.col(ts) - F.col("_prev") > eps))
    first = F.coalesce(F.lag(ts).over(p) < F.col(ts), F.lit(True))  # rows of equal time are alike, so one of them counts
    rows = rows.withColumn("_new", (start & first).cast("int"))
    rows = rows.withColumn("_id", F.when(F.col("_core"), F.sum("_new").over(p.rangeBetween(Window.unboundedPreceding, 0)) - 1))
    near = F.min("_id").over(p.rangeBetween(-eps, eps))
    return rows.withColumn("cluster_id", F.coalesce("_id", near, F.lit(-1)).cast("int")).drop("_core", "_prev", "_new", "_id")


def dbscan_ranges(df: DataFrame, eps: int, min_samples: int, keys: list[str] | None = None, ts: str = "ts", width: int = 2592000) -> DataFrame:
    """CLU-15: the same clusters as `dbscan_1d`, numbered from 0 in each key, with time cut in cells that share the work.

    A cell also sees the rows within twice eps of its borders, so cores and starts of clusters are known in it; clusters are numbered by
    the starts of all cells before. Then a cell sees the numbered cores within eps, for the rows that aren't core. Only rows near borders are copied,
    and only one row a cell meets in one task. A cluster may span any number of cells. Rows without a time are noise.
    """
    keys, width = list(keys or []), max(width, 4 * eps, 1)
    home = F.floor(F.col(ts) / width)
    cells = lambda reach: F.sequence(F.floor((F.col(ts) - reach) / width), F.floor((F.col(ts) + reach) / width))
    p = Window.partitionBy(*keys, "_cell").orderBy(ts)
    rows = df.filter(F.col(ts).isNotNull()).withColumn("_home", home).withColumn("_cell", F.explode(cells(2 * eps)))
    rows = rows.withColumn("_core", F.count("*").over(p.rangeBetween(-eps, eps)) >= min_samples)
    before = F.max(F.when(F.col("_core"), F.col(ts))).over(p.rangeBetween(-eps, -1))
    first = F.coalesce(F.lag(ts).over(p) < F.col(ts), F.lit(True))
    rows = rows.withColumn("_new", (F.col("_core") & before.isNull() & first).cast("int")).filter("_cell = _home").drop("_home")
    rows = stored(rows, "cores")
    counts = rows.groupBy(*keys, "_cell").agg(F.sum("_new").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a cell
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_at"), offset.alias("_offset"))
    same = F.col("_cell") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.join(offsets, same).drop("_at", *[f"_k{i}" for i in range(len(keys))])
    number = F.col("_offset") + F.sum("_new").over(p.rangeBetween(Window.unboundedPreceding, 0)) - 1
    rows = rows.withColumn("_id", F.when(F.col("_core"), number)).drop("_core", "_new", "_offset").withColumn("_own", F.lit(True))
    copies = rows.filter("_id is not null").withColumn("_to", F.explode(cells(eps))).filter("_to <> _cell").withColumn("_cell", F.col("_to")).drop("_to").withColumn("_own", F.lit(False))
    near = F.min("_id").over(p.rangeBetween(-eps, eps))
    out = rows.unionByName(copies).withColumn("_near", near).filter("_own").withColumn("cluster_id", F.coalesce("_id", "_near", F.lit(-1).cast("long")))
    return out.drop("_cell", "_id", "_own", "_near").unionByName(df.filter(F.col(ts).isNull()).withColumn("cluster_id", F.lit(-1).cast("long")))


def equal_width(df: DataFrame, width: int, keys: list[str], ts: str = "ts") -> DataFrame:
    """CLU-16."""
    return df.withColumn("cluster_id", F.floor((F.col(ts) - F.min(ts).over(Window.partitionBy(*keys))) / width))


def single_cluster(df: DataFrame) -> DataFrame:
    """CLU-18."""
    return df.withColumn("cluster_id", F.lit(1))


def topology_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """CLU-17: node and the smallest node it is connected with; nodes off the graph are alone."""
    ids = nodes.select("entity").union(edges.select("src")).union(edges.select("dst")).distinct()
    return smallest_linked(ids.select(F.col("entity").alias("id")), edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("id").alias("entity"), F.col("label").alias("component"))


def smallest_linked(ids: DataFrame, links: DataFrame) -> DataFrame:
    """id, label: the smallest id reachable over links (a, b).

    A round takes the least label among a node's links for the node and for the node that its label names, then each label's own
    label. So long chains shrink by a factor each round, and rounds grow with the logarithm of their length.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    label = ids.select("id", F.col("id").alias("label"))
    while True:  # labels only fall
        known = label.select(F.col("id").alias("b"), F.col("label").alias("low"))
        low = both.join(known, "b").groupBy(F.col("a").alias("id")).agg(F.min("low").alias("low"))
        hooked = label.join(low, "id")
        asked = low.unionByName(hooked.select(F.col("label").alias("id"), "low")).groupBy("id").agg(F.min("low").alias("low"))
        lower = label.join(asked, "id", "left").select("id", F.least("label", F.coalesce("low", "label")).alias("label"), F.col("label").alias("old"))
        up = lower.select(F.col("id").alias("label"), F.col("label").alias("top"))
        new = stored(lower.join(up, "label", "left").select("id", F.least("label", F.coalesce("top", "label")).alias("label"), "old"), "labels")
        label = new.select("id", "label")
        if new.filter("label <> old").isEmpty():
            return label


def _cut(df: DataFrame) -> DataFrame:
    """Lineage cut by a table in the shared folder."""
    return stored(df, "cut")


def small_to_outliers(df: DataFrame, least: int) -> DataFrame:
    """CLU-11: clusters smaller than `least` become -1, the others are numbered from 1 by label; a null label is -1."""
    kept = df.filter("label is not null").groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("label")
    ranked = kept.withColumn("_rank", F.row_number().over(Window.orderBy("label")))  # one row a label
    return df.join(ranked, "label", "left").withColumn("cluster", F.coalesce("_rank", F.lit(-1))).drop("_rank")


def medoids(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """CLU-14: of each cluster the member with the least distance sum, and all members by distance from it.

    pairs: a, b, d in both directions, without a = b.
    """
    inside = pairs.join(members.select(F.col("id").alias("a"), "cluster"), "a").join(members.select(F.col("id").alias("b"), F.col("cluster").alias("cb")), "b").filter("cluster = cb")
    centre = inside.groupBy("cluster", "a").agg(F.round(F.sum("d"), 6).alias("s")).groupBy("cluster").agg(F.min_by("a", F.struct("s", "a")).alias("center"))
    alone = members.groupBy("cluster").agg(F.min("id").alias("only"), F.count("*").alias("n")).filter("n = 1").select("cluster", F.col("only").alias("center"))
    centre = centre.unionByName(alone)
    far = members.join(centre, "cluster").join(pairs.select(F.col("a").alias("center"), F.col("b").alias("id"), "d"), ["center", "id"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    return far.groupBy("cluster", "center").agg(F.array_sort(F.collect_list(F.struct(F.round("d", 6).alias("distance"), "id"))).alias("x")).select("cluster", "center", F.col("x.id").alias("members"), F.col("x.distance").alias("distances"))


def centres(df: DataFrame, name: str = "euclidean") -> DataFrame:
    """CLU-14 from vectors (id, cluster, x): cluster, center, id, d: all members with their distance from the medoid.

    As `medoids`, but distances are summed where they are computed and those from the medoids computed again, so no table holds all pairs.
    """
    rows = stored(df.select("id", "cluster", "x"), "members")
    centre = D.sums_within(rows, name, "cluster").groupBy("cluster").agg(F.min_by("a", F.struct(F.round("s", 6).alias("s"), "a")).alias("center"))
    alone = rows.groupBy("cluster").agg(F.min("id").alias("center"), F.count("*").alias("n")).filter("n = 1").select("cluster", "center")
    centre = stored(centre.unionByName(alone), "centres")
    at = centre.join(rows.select("cluster", F.col("id").alias("center"), F.col("x").alias("xa")), ["cluster", "center"])
    far = F.when(F.col("id") != F.col("center"), D.DISTANCES[name](F.col("xa"), F.col("x")))
    return rows.join(at, "cluster").select("cluster", "center", "id", F.coalesce(far, F.lit(0.0)).alias("d"))


def average_linkage(pairs: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """CLU-10: by, id, label of k average-linkage clusters, labels from 1 by the clusters' smallest ids; pairs: by, a, b, d.

    In a round all pairs of clusters that are each other's nearest merge, which gives the same tree as merging one pair at a time: merging
    others never brings a cluster nearer. Distances are rows of sums and counts, so no task holds a matrix. The lowest merges of the
    tree, all but k - 1, are taken. Ties go by ids.
    """
    keys = list(by or [])
    a, b = F.least("a", "b"), F.greatest("a", "b")
    table = pairs.filter("a <> b").select(*keys, a.alias("a"), b.alias("b"), F.col("d").alias("s")).groupBy(*keys, "a", "b").agg(F.max("s").alias("s")).withColumn("n", F.lit(1).cast("long"))
    if not keys:
        table, keys = table.withColumn("_all", F.lit(0)), ["_all"]
    table = stored(table.select(*keys, "a", "b", "s", "n"), "distances")
    ids = stored(table.select(*keys, F.col("a").alias("id")).union(table.select(*keys, F.col("b").alias("id"))).distinct(), "ids")
    needed = ids.groupBy(*keys).agg((F.count("*") - max(1, k)).alias("needed"))
    merges, left, step = [], table, 0
    while True:
        apart = F.round(F.col("s") / F.col("n"), 12).alias("d")
        ends = left.select(*keys, "a", "b", apart, F.explode(F.array("a", "b")).alias("id"))
        nearest = ends.groupBy(*keys, "id").agg(F.min(F.struct("d", "a", "b")).alias("x"))
        mutual = nearest.groupBy(*keys, "x").agg(F.count("*").alias("both")).filter("both = 2")
        merges.append(stored(mutual.select(*keys, "x.a", "x.b", F.col("x.d").alias("height"), F.lit(step).alias("step")).coalesce(1), "merges"))  # fewer rows than ids
        into = merges[-1].select(*keys, F.col("b").alias("_b"), F.col("a").alias("_a"))
        for end in ("a", "b"):
            left = left.join(into.withColumnRenamed("_b", end), [*keys, end], "left").withColumn(end, F.coalesce("_a", end)).drop("_a")
        left = left.filter("a <> b").select(*keys, a.alias("a"), b.alias("b"), "s", "n").groupBy(*keys, "a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        left, step = stored(left, "distances"), step + 1
        if left.isEmpty():
            break
    return _cut_trees(ids, _rows(merges), needed, keys).select(*(by or []), "id", "label")


def _cut_trees(ids: DataFrame, merges: DataFrame, needed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, label after the lowest merges of each tree; merges: keys, a, b, height, step; needed: keys and how many."""
    order = Window.partitionBy(*keys).orderBy("height", "step", "a", "b")  # a row for each merge
    taken = merges.join(needed, keys).withColumn("_place", F.row_number().over(order)).filter("_place <= needed")
    up = stored(ids.join(taken.select(*keys, F.col("b").alias("id"), F.col("a").alias("up")), [*keys, "id"], "left").select(*keys, "id", F.coalesce("up", "id").alias("up")), "up")
    while True:  # each id's way up doubles
        higher = stored(up.join(up.select(*keys, F.col("id").alias("up"), F.col("up").alias("top")), [*keys, "up"]).select(*keys, "id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
        up = higher.select(*keys, "id", "up")
        if higher.filter("moved").isEmpty():
            break
    names = up.select(*keys, "up").distinct().withColumn("label", F.row_number().over(Window.partitionBy(*keys).orderBy("up")))  # k rows a key
    return up.join(names, [*keys, "up"]).select(*keys, "id", "label")


def linkage_of(df: DataFrame, k: int, key: str, name: str = "euclidean", side: int = linkage.SIDE) -> DataFrame:
    """CLU-10 from vectors (key, id, x): key, id, label as `average_linkage` gives them for the pairs of each key, without a table of pairs.

    Keys in which an id is repeated, or a vector is null, not finite or of another length than the others, go by their pairs; so do distances that arrays may lack.
    """
    rows = df.select(key, "id", "x").dropna(subset=[key, "id"])
    odd = F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    of = rows.groupBy(key).agg(F.count("*").alias("_n"), F.countDistinct("id").alias("_ids"), F.max(odd).alias("_odd"), F.min(F.size("x")).alias("_low"), F.max(F.size("x")).alias("_high"))
    of = stored(of.filter("_n > 1").select(key, "_n", (F.lit(name in linkage.PLAIN) & (F.col("_n") == F.col("_ids")) & ~F.col("_odd") & (F.col("_low") == F.col("_high")) & (F.col("_low") > 0)).alias("_even")), "keys")
    out = []
    if not of.filter("_even").isEmpty():
        place = F.row_number().over(Window.partitionBy(key).orderBy("id")).cast("long") - 1
        ranked = stored(rows.join(of.filter("_even"), key).select(key, "id", "x", "_n", place.alias("place")), "ranked")
        tree = linkage.merges(ranked.withColumnRenamed(key, "_key"), name, side).withColumnRenamed("_key", key)
        needed = of.filter("_even").select(key, (F.col("_n") - max(1, k)).alias("needed"))
        cut = _cut_trees(ranked.select(key, F.col("place").alias("id")), tree, needed, [key])
        out.append(cut.withColumnRenamed("id", "place").join(ranked.select(key, "place", "id"), [key, "place"]).select(key, "id", "label"))
    if not of.filter("not _even").isEmpty():
        out.append(average_linkage(D.within(rows.join(of.filter("not _even").select(key), key), name, key), k, [key]))
    return _rows(out) if out else rows.select(key, "id", F.lit(0).alias("label")).limit(0)


def _rows(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def dbscan_distances(pairs: DataFrame, ids: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """CLU-12: density clusters from a distance table (both directions); label is the smallest core id, null for noise."""
    near = pairs.filter(F.col("d") <= eps).select("a", "b")
    core = _cut(ids.join(near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")), "id", "left").filter(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("id"))
    link = near.join(core.select(F.col("id").alias("a")), "a").join(core.select(F.col("id").alias("b")), "b")
    label = smallest_linked(core, link)
    border = near.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("border"))
    return ids.select("id").join(label, "id", "left").join(border, "id", "left").select("id", F.coalesce("label", "border").alias("label"))


def dbscan_vectors(df: DataFrame, ids: DataFrame, eps: float, min_samples: int, key: str, name: str = "euclidean") -> DataFrame:
    """CLU-12 from vectors (key, id, x), those of one key paired: the labels of `dbscan_distances`, without a table of all near pairs.

    Neighbours are counted where distances are computed. They are computed once more when cores are known, and of the links between the cores
    of a cell a spanning forest is enough. A row that isn't core has fewer than min_samples links, which are all kept.
    """
    if name not in D.BLOCKS:
        return dbscan_distances(D.within(df, name, key), ids, eps, min_samples)
    rows = _cut(df.select(key, "id", "x"))
    cells = lambda of, give: blocks.cells(of, of, [key], D.BLOCKS[name], D.DISTANCES[name], give=give, most=eps)
    near = cells(rows, "counts").groupBy(F.col("a").alias("id")).agg(F.sum("d").alias("n"))
    core = _cut(ids.join(near, "id", "left").filter(F.coalesce("n", F.lit(0.0)) + 1 >= min_samples).select("id"))
    known = core.distinct().withColumn("core", F.lit(True))
    links = _cut(cells(rows.join(known, "id", "left").withColumn("core", F.coalesce("core", F.lit(False))), "links").select("a", "b"))
    label = smallest_linked(core, links.join(core.select(F.col("id").alias("a")).distinct(), "a", "left_semi"))
    border = links.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("border"))
    return ids.select("id").join(label, "id", "left").join(border, "id", "left").select("id", F.coalesce("label", "border").alias("label"))


def latent(df: DataFrame, k: int) -> DataFrame:
    """CLU-22: id and the first k principal components of x (a stand-in for learned encoders, without parity)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select("id", array_to_vector("x").alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(v).transform(v).select("id", vector_to_array("p").alias("x"))


#: EXT-03: ways of clustering a distance table (a, b, d in both directions) or vectors (key, id, x), and their ids, by name.
APPROACHES = {
    "average_linkage": lambda pairs, ids, k=6, **_: average_linkage(pairs, k),
    "dbscan": lambda pairs, ids, eps=1.0, min_samples=3, **_: dbscan_distances(pairs, ids, eps, min_samples),
    "dbscan_vectors": lambda rows, ids, eps=1.0, min_samples=3, key="label", **_: dbscan_vectors(rows, ids, eps, min_samples, key),
}


def register_approach(name: str, fn) -> None:
    APPROACHES[name] = fn


def clusters_by(name: str, pairs: DataFrame, ids: DataFrame, **settings) -> DataFrame:
    return APPROACHES[name](pairs, ids, **settings)
