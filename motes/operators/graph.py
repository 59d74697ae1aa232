"""Connected components, channel signatures, and the clusterings built on them."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from motes.functions.scalars import normalized_combination
from motes.operators.spatial import k_nearest
from motes.session import checkpoint, dealt, forget, saved, shuffled


#: Edges a task contracts at a time, and the most that are left to a single task.
PIECE = 1_000_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) and the smallest node each one reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    parent = np.arange(len(nodes))
    while len(u):
        hi, lo = np.maximum(parent[u], parent[v]), np.minimum(parent[u], parent[v])
        open_ = hi != lo
        # each root hangs itself under the smallest one next to it, then paths are made short
        np.minimum.at(parent, hi[open_], lo[open_])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        u, v = u[open_], v[open_]
    return nodes, nodes[parent]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (hi, lo) of every task replaced by stars around the smallest node of each of its components."""
    def contract(batches):
        import pyarrow as pa
        held, count = [], 0

        def stars():
            hi, lo = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (0, 1))
            node, root = _roots(hi, lo)
            leaf = node != root
            return pa.RecordBatch.from_arrays([pa.array(node[leaf]), pa.array(root[leaf])], names=["hi", "lo"])
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= PIECE:
                yield stars()
                held, count = [], 0
        if count:
            yield stars()
    return edges.select("hi", "lo").mapInArrow(contract, "hi long, lo long")


def _rounds(e: DataFrame) -> DataFrame:
    """Large-star and small-star steps on distinct edges (hi, lo) until every edge leads to a root.

    Minima are plain tables, so both sides of each join are, and AQE can split the edges of a hub.
    """
    state = _fingerprint(e)
    while True:
        # small star: a node and its smaller neighbours point at the smallest of them
        low = saved(e.groupBy("hi").agg(F.min("lo").alias("m")))
        j = e.join(low, "hi")
        e = saved(j.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where(F.col("hi") != F.col("lo"))
                  .union(low.select("hi", F.col("m").alias("lo"))).distinct())
        # large star: larger neighbours of a node point at the smallest node it sees
        low = saved(e.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m")))
        e = saved(e.join(low, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct())
        now = _fingerprint(e)
        if now == state:
            return e
        state = now


def _long_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes with an edge (hi, lo) of longs; all but the roots, and these too."""
    e = edges.where(F.col("hi") != F.col("lo")).select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
    # Ranges of both ends keep neighbours together and deal out the edges of a hub.
    for ends in (("lo", "hi"), ("hi", "lo")):
        e = saved(_contracted(e.repartitionByRange(*ends).sortWithinPartitions(*ends)))
        if e.count() <= PIECE:
            break
    if e.count() > PIECE:
        e = _rounds(saved(e.distinct()))
    else:
        e = saved(_contracted(e.coalesce(1)))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node`` -> ``component`` (the smallest node in reach).

    ``edges`` has columns ``a`` and ``b`` of one orderable type, structs included (they are
    numbered in their order first).  Every task contracts the edges it holds to stars; what is left
    is solved by one task if it fits, else by the alternating large-star and small-star steps of
    Kiveris et al. (2014).  No step gathers the edges of a hub.  Nodes without an edge form
    components of their own when ``nodes`` is given.
    """
    kind = edges.schema["a"].dataType
    if isinstance(kind, (LongType, IntegerType)):
        found = _long_components(edges.select(F.col("a").cast("long").alias("hi"), F.col("b").cast("long").alias("lo")))
        out = found.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))
    else:
        ends = saved(edges.select("a", "b").where(F.col("a") != F.col("b")))
        names = ends.select(F.col("a").alias("node")).union(ends.select(F.col("b").alias("node"))).distinct()
        names = saved(names.repartitionByRange("node").sortWithinPartitions("node").withColumn("id", F.monotonically_increasing_id()))
        one, two = names.select(F.col("node").alias("a"), F.col("id").alias("hi")), names.select(F.col("node").alias("b"), F.col("id").alias("lo"))
        found = _long_components(ends.join(shuffled(one), "a").join(shuffled(two), "b").select("hi", "lo"))
        root = names.select(F.col("id").alias("root"), F.col("node").alias("component"))
        out = found.select(F.col("node").alias("id"), F.col("component").alias("root")).join(shuffled(names), "id").join(shuffled(root), "root").select("node", "component")
    if nodes is None:
        return out
    return nodes.select("node").join(shuffled(out), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def channel_signatures(dets: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Component per (keys, component) with the sorted set of channels it joins.

    ``matches`` is the output of the channel-pair matching; unmatched detections
    are components of one channel.
    """
    ks = [F.col(k) for k in keys]
    node = F.struct(*ks, "channel", "id").alias("node")
    a = F.struct(*ks, F.col("channel_1").alias("channel"), F.col("left_id").alias("id")).alias("a")
    b = F.struct(*ks, F.col("channel_2").alias("channel"), F.col("right_id").alias("id")).alias("b")
    comp = connected_components(matches.select(a, b), dets.select(node))
    return comp.groupBy("component").agg(
        *[F.first(f"node.{k}").alias(k) for k in keys],
        F.array_sort(F.collect_set("node.channel")).alias("channels"), F.count("*").alias("members"))


def signature_table(signatures: DataFrame, group: list[str] = []) -> DataFrame:
    """Counts and rates per channel signature, larger signatures first.

    ``total_objects_grouped`` is the number of components in the group.
    """
    counts = signatures.groupBy(*group, "channels").agg(F.count("*").alias("count"))
    total = signatures.groupBy(*group).agg(F.count("*").alias("total_objects_grouped"))
    j = counts.join(total, group) if group else counts.join(F.broadcast(total), F.lit(True))
    return (j.withColumn("rate", F.col("count") / F.col("total_objects_grouped"))
            .withColumn("combination", normalized_combination(F.col("channels")))
            .orderBy(*group, F.desc(F.size("channels")), "channels"))


def knn_edges(points: DataFrame, keys: list[str], coords: list[str], k: int = 15) -> DataFrame:
    """Directed k-nearest-neighbour edges without self-loops: keys, src, dst, distance."""
    n = k_nearest(points, points, keys, k=k, skip_self=True, coords=coords)
    return n.select(*keys, F.col("id").alias("src"), F.col("ref_id").alias("dst"), "distance")


def _alike(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the distinct links (lo, hi) with the smallest node ``like`` of the same neighbours, and one row
    per ``like`` with its number of nodes ``n`` and their degree ``deg``.

    Sets of neighbours are told apart by their size, ends and two 64-bit hashes, so none is gathered.
    """
    both = links.select(F.col("lo").alias("node"), F.col("hi").alias("to")).union(links.select("hi", "lo"))
    same = ["deg", "_first", "_last", "_x", "_y"]
    sets = saved(both.groupBy("node").agg(
        F.count("*").alias("deg"), F.min("to").alias("_first"), F.max("to").alias("_last"),
        F.bit_xor(F.xxhash64("to")).alias("_x"), F.bit_xor(F.xxhash64("to", F.lit(1))).alias("_y")))
    kinds = saved(sets.groupBy(*same).agg(F.min("node").alias("like"), F.count("*").alias("n")))
    nodes = saved(sets.join(shuffled(kinds), same).select("node", "like"))
    forget(sets)
    return nodes, kinds.select("like", "n", "deg")


def power_vector(links: DataFrame, iterations: int = 20) -> tuple[DataFrame, DataFrame]:
    """Power iteration from the degrees, as in Lin and Cohen (2010), on the distinct links (lo, hi) of equal weight.

    Nodes with the same neighbours keep the same value, so they are one row (``like``, ``n``, ``value``)
    from the start; the second table holds every ``node`` with its ``like``.  A round is one join over the links
    between such rows, and nothing is kept in memory between rounds.
    """
    nodes, kinds = _alike(links)
    if kinds.count() < nodes.count():
        # all nodes alike are linked with a node or none is, so links between their first ones tell everything
        for end in ("lo", "hi"):
            links = links.join(shuffled(kinds.select(F.col("like").alias(end))), end)
        links = saved(links.select("lo", "hi"))
    links = links.union(links.select("hi", "lo")).toDF("like", "to")
    ends = kinds.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("deg")).alias("deg")).first()
    if not ends["n"]:
        return kinds.select("like", "n", F.lit(0.0).alias("value")), nodes
    at = state = saved(kinds.select("like", "n", "deg", (F.col("deg") / float(ends["deg"])).alias("value")))
    tol, last = max(1e-5 / ends["n"], 1e-8), None
    for _ in range(iterations):
        told = links.join(shuffled(at.select(F.col("like").alias("to"), (F.col("n") * F.col("value")).alias("_v"))), "to")
        new = told.groupBy("like").agg(F.sum("_v").alias("_v"))
        both = saved(at.join(shuffled(new), "like").withColumn("_v", F.col("_v") / F.col("deg")))
        forget(state)
        state = both
        norm = both.agg(F.sum(F.col("n") * F.col("_v"))).first()[0]
        change = both.agg(F.sum(F.col("n") * F.abs(F.col("_v") / norm - F.col("value")))).first()[0]
        at = both.select("like", "n", "deg", (F.col("_v") / norm).alias("value"))
        if last is not None and abs(change - last) <= tol:
            break
        last = change
    return at.select("like", "n", "value"), nodes


class PowerIterationClustering:
    """Power iteration clustering (Lin and Cohen, 2010) as joins over written tables, in place of Spark's own of this
    name, whose graphs stay in memory."""

    def __init__(self, k: int, maxIter: int):
        self.k, self.maxIter = k, maxIter

    def assignClusters(self, links: DataFrame) -> DataFrame:
        """``id`` and ``cluster`` of the nodes of distinct links (lo, hi)."""
        at, nodes = power_vector(links, self.maxIter)
        # of mean 1 over the nodes, so the tolerance of k-means does not depend on their number
        total = at.agg(F.sum("n")).first()[0] or 0
        points = VectorAssembler(inputCols=["value"], outputCol="_f").transform(
            at.withColumns({"n": F.col("n").cast("double"), "value": F.col("value") * float(total)}))
        model = KMeans(k=self.k, seed=0, featuresCol="_f", predictionCol="cluster", weightCol="n").fit(points)
        labels = saved(model.transform(points).select("like", "cluster"))
        return nodes.join(shuffled(labels), "like").select(F.col("node").alias("id"), "cluster")


def communities(edges: DataFrame, k: int, iterations: int = 20) -> DataFrame:
    """Community labels of a neighbour graph by power iteration: ``id``, ``community``."""
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    ends = edges.select(lo.alias("lo"), hi.alias("hi")).where(F.col("lo") != F.col("hi"))
    # pairs are dealt by one end and stay beside each other: of equally near sites the smallest is chosen, so a crowd shares its lower end
    links = saved(dealt(ends, edges.count(), "hi").distinct().sortWithinPartitions("hi", "lo"))
    labels = PowerIterationClustering(k=k, maxIter=iterations).assignClusters(links)
    return labels.withColumnRenamed("cluster", "community")


def modularity(edges: DataFrame, labels: DataFrame, label: str = "community") -> DataFrame:
    """Newman modularity of a labelling on the undirected simple graph (one row)."""
    u = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    ls = labels.select(F.col("id").alias("src"), F.col(label).alias("_ls"))
    ld = labels.select(F.col("id").alias("dst"), F.col(label).alias("_ld"))
    j = u.join(shuffled(ls), "src").join(shuffled(ld), "dst")
    per_end = j.select(F.explode(F.array(
        F.struct(F.col("_ls").alias("c"), F.when(F.col("_ls") == F.col("_ld"), 1).otherwise(0).alias("i")),
        F.struct(F.col("_ld").alias("c"), F.when(F.col("_ls") == F.col("_ld"), 1).otherwise(0).alias("i")),
    )).alias("e"))
    per = per_end.groupBy("e.c").agg(F.count("*").alias("deg"), F.sum("e.i").alias("inside"))
    m2 = F.sum("deg")
    return per.agg((F.sum("inside") / m2 - F.sum(F.col("deg").cast("double") * F.col("deg")) / (m2 * m2))
                   .alias("modularity"))


def density_clusters(points: DataFrame, keys: list[str], coords: list[str], eps: float,
                     min_samples: int = 5, min_cluster_size: int = 50) -> DataFrame:
    """Density clusters (DBSCAN*): ``cluster`` is the smallest core id, -1 is noise.

    A core point has ``min_samples`` points (itself included) within ``eps``.  Two
    cores are linked within ``eps``.  Cores in one cell of edge eps/sqrt(d) are all
    linked, so cells are the nodes; two cells are linked when some core of one has
    its nearest core of the other within ``eps``.  No dense spot is paired with itself.
    """
    dims = len(coords)
    edge = eps / dims ** 0.5 * 0.999999
    near = k_nearest(points, points, keys, k=min_samples, bound=eps, inclusive=True, coords=coords)
    core_ids = near.where(F.col("place") == min_samples).select(*keys, "id")
    cells = [f"_g{i}" for i in range(dims)]
    core = points.select(*keys, "id", *coords).join(core_ids, [*keys, "id"])
    core = checkpoint(core.withColumns({g: F.floor(F.col(c) / edge) for g, c in zip(cells, coords)}))
    node = F.struct(*keys, *cells)
    occupied = core.groupBy(*keys, *cells).agg(
        F.min("id").alias("_first"), *[F.min(c).alias(f"_l_{c}") for c in coords],
        *[F.max(c).alias(f"_h_{c}") for c in coords])

    reach = int(dims ** 0.5) + 1
    step = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    around = occupied
    for g in cells:
        around = around.withColumn("_s", F.explode(step)).withColumn(f"_t{g}", F.col(g) + F.col("_s")).drop("_s")
    # each unordered pair of neighbouring cells once
    around = around.where(F.struct(*[f"_t{g}" for g in cells]) > F.struct(*cells))
    other = occupied.select(*keys, *[F.col(g).alias(f"_t{g}") for g in cells],
                            *[F.col(f"_l_{c}").alias(f"_ol_{c}") for c in coords],
                            *[F.col(f"_h_{c}").alias(f"_oh_{c}") for c in coords])
    pair = around.join(other, [*keys, *[f"_t{g}" for g in cells]])

    def gap(c: str):
        d = F.greatest(F.col(f"_ol_{c}") - F.col(f"_h_{c}"), F.col(f"_l_{c}") - F.col(f"_oh_{c}"), F.lit(0.0))
        return d * d
    pair = pair.where(reduce(lambda a, b: a + b, [gap(c) for c in coords]) <= eps * eps)
    pair = pair.select(*keys, *cells, *[f"_t{g}" for g in cells])

    ask = core.join(pair, [*keys, *cells])
    targets = core.withColumnsRenamed({g: f"_t{g}" for g in cells})
    witness = k_nearest(
        ask.select(*keys, *[f"_t{g}" for g in cells], F.struct("id", *cells).alias("id"), *coords),
        targets.select(*keys, *[f"_t{g}" for g in cells], F.struct("id", *[F.col(f"_t{g}").alias(g) for g in cells])
                       .alias("id"), *coords),
        [*keys, *[f"_t{g}" for g in cells]], bound=eps, inclusive=True, coords=coords)
    links = witness.select(
        F.struct(*keys, *[F.col(f"id.{g}").alias(g) for g in cells]).alias("a"),
        F.struct(*keys, *[F.col(f"_t{g}").alias(g) for g in cells]).alias("b"))
    comp = connected_components(links, occupied.select(node.alias("node")))
    named = core.select(*keys, "id", node.alias("node")).join(comp, "node")
    size = named.groupBy("component").agg(F.count("*").alias("_n"), F.min("id").alias("_label"))
    labelled = named.join(size.where(F.col("_n") >= min_cluster_size), "component").select(
        *keys, "id", F.col("_label").alias("cluster"))
    return (points.select(*keys, "id").join(labelled, [*keys, "id"], "left")
            .withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long"))))
