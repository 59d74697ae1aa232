"""Nearest neighbours by inner product: a navigable small-world graph per shard, results merged.

Rows are dealt to shards by the hash of their id.  A shard's graph is hierarchical: nodes are ordered
by their level, so each layer is a prefix of them, and a layer is one flat array of neighbours (-1
where there is none).  Nodes are inserted in batches; a batch is searched in the graph so far, all
its members at a time, and linked by the diversity rule in both directions.

Largest inner product is turned into nearest direction by one more component, which gives all
vectors the same norm (queries have 0 there); the index is exact about this.  Equal vectors of a
shard are one node with a list of ids, so copies neither crowd a graph nor hide each other.  The
found vectors are measured again in double precision on the original values.

How wide a beam a graph needs depends on its vectors.  Each shard asks ``PROBES`` of its own nodes after
the build, compares with all its nodes, and doubles the beam until the recall asked for is reached; a
sample of that size decides on nothing but the beam.

Null vectors, and vectors that are zero or hold null or non-finite components, take no part, nor do
rows without id or of another length than most.  Rows that share an id are one (the smallest
vector).  Ties go to the smaller id; a query with fewer candidates gets them all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motes.llm.common import written

INDEX = "shard int, nodes int, dims int, width int, layers array<int>, vectors binary, owners binary, ids binary, links array<binary>"
#: Nodes of a shard that are asked to choose its beam.
PROBES = 128
#: Beam of the upper layers: wide enough to enter clusters that lie far from the entry point.
UPPER = 32


class Graph:
    """Layers of flat neighbour arrays over the rows of ``x`` (equal norms, float32)."""

    def __init__(self, x: np.ndarray, sizes: list[int], links: list[np.ndarray]):
        self.x, self.sizes, self.links = x, sizes, links  # from the top layer down

    @classmethod
    def build(cls, x: np.ndarray, degree: int, width: int, sizes: list[int]) -> Graph:
        g = cls(x, sizes, [])
        for layer, n in enumerate(sizes):
            most = degree if layer + 1 < len(sizes) else 2 * degree
            g.links.append(np.full((n, most), -1, np.int32))
            at = min(n, 2 * most)
            g._link(layer, np.arange(at), *g._all_pairs(0, at, 0, at), most)
            while at < n:
                to = min(n, at + max(16, min(1024, at // 2)))
                new = np.arange(at, to)
                near, sims = g.search(x[new], width, layer)
                own, own_sims = g._all_pairs(at, to, at, to, most)
                g._link(layer, new, np.concatenate([near, own], 1), np.concatenate([sims, own_sims], 1), most)
                at = to
        return g

    def _all_pairs(self, a: int, b: int, c: int, d: int, most: int = 1 << 30):
        """The nearest of rows c..d for rows a..b, by comparing all of them."""
        sims = self.x[a:b] @ self.x[c:d].T
        if (a, b) == (c, d):
            np.fill_diagonal(sims, -np.inf)
        k = min(most, d - c)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        sims = np.take_along_axis(sims, order, 1)
        return np.where(np.isfinite(sims), order + c, -1), sims

    def _select(self, base: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For every row of ``base`` up to ``most`` of its candidates: first those nearer to it than to
        any chosen one, then the nearest of the others."""
        order = np.argsort(-np.where(near >= 0, sims, -np.inf), axis=1, kind="stable")[:, :max(3 * most // 2, 48)]
        near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
        n, k = near.shape
        # A candidate that is listed twice counts once.
        twice = np.zeros((n, k), bool)
        by = np.argsort(near, axis=1, kind="stable")
        same = np.take_along_axis(near, by, 1)
        np.put_along_axis(twice[:, :], by[:, 1:], same[:, 1:] == same[:, :-1], 1)
        ok = (near >= 0) & ~twice & (near != base[:, None])
        v = self.x[np.maximum(near, 0)]
        between = v @ v.transpose(0, 2, 1)
        closest = np.full((n, k), -np.inf, np.float32)
        taken, count = np.zeros((n, k), bool), np.zeros(n, np.int64)
        for c in range(k):
            take = ok[:, c] & (count < most) & (sims[:, c] > closest[:, c])
            taken[:, c] = take
            count += take
            closest = np.where(take[:, None], np.maximum(closest, between[:, c, :]), closest)
        rank = np.argsort(np.where(taken, 0, np.where(ok, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(ok, rank, 1), np.take_along_axis(near, rank, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1).astype(np.int32)

    def _link(self, layer: int, new: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> None:
        links = self.links[layer]
        chosen = self._select(new, near, sims, max(1, most // 2) if len(new) < len(links) else most)
        links[new, :chosen.shape[1]] = chosen
        src, dst = np.repeat(new, chosen.shape[1]), chosen.reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        s = np.einsum("nd,nd->n", self.x[src], self.x[dst])
        order = np.lexsort((-s, dst))
        src, dst, s = src[order], dst[order], s[order]
        targets, first = np.unique(dst, return_index=True)
        place = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
        keep = place < most
        row = np.searchsorted(targets, dst[keep])
        more, more_s = np.full((len(targets), most), -1, np.int64), np.full((len(targets), most), -np.inf, np.float32)
        more[row, place[keep]], more_s[row, place[keep]] = src[keep], s[keep]
        for k in range(0, len(targets), 1024):
            t = targets[k:k + 1024]
            old = links[t].astype(np.int64)
            old_s = np.einsum("nd,nmd->nm", self.x[t], self.x[np.maximum(old, 0)])
            links[t] = self._select(t, np.concatenate([old, more[k:k + 1024]], 1), np.concatenate([old_s, more_s[k:k + 1024]], 1), most)

    def search(self, q: np.ndarray, width: int, layer: int | None = None, steps: int = 4):
        """Nodes and similarities of the ``width`` best found per query, best first; from the top layer
        to ``layer`` (the last, if none is given)."""
        last = len(self.links) - 1 if layer is None else layer
        at = np.zeros((len(q), 1), np.int64)
        sims = q @ self.x[0][:, None]
        for k in range(last + 1):
            at, sims = self._beam(q, at, sims, self.links[k], width if k == last else UPPER, steps)
        return at, sims

    def fitting_width(self, queries: np.ndarray, own: np.ndarray, k: int, width: int, recall: float) -> int:
        """The first of ``width``, 2 ``width``, ... at which the queries (without their ``own`` nodes) find that
        share of their ``k`` nearest nodes, and none finds nothing; the number of nodes at most."""
        n = len(self.x)
        k = min(k, n - 1)
        if k < 1:
            return width
        sims = queries @ self.x.T
        sims[np.arange(len(own)), own] = -np.inf
        worst = np.partition(sims, n - k, axis=1)[:, n - k]
        # The beam sums in another order, so equal similarities may differ in the last digits.
        worst = worst - 1e-5 * np.abs(worst)
        while width < n:
            at, got = self.search(queries, width)
            hits = ((at >= 0) & (at != own[:, None]) & (got >= worst[:, None])).sum(1).clip(max=k)
            if hits.mean() >= recall * k and hits.min() > 0:
                break
            width *= 2
        return min(width, max(n, 1))

    def _beam(self, q, at, sims, links, width, steps):
        n = len(q)
        pad = max(0, width - at.shape[1])
        at = np.pad(at, ((0, 0), (0, pad)), constant_values=-1)[:, :max(width, 1)]
        sims = np.pad(sims.astype(np.float32), ((0, 0), (0, pad)), constant_values=-np.inf)[:, :max(width, 1)]
        done = at < 0
        live = np.arange(n)
        while len(live):
            a, s, d = at[live], sims[live], done[live]
            best = np.argsort(d, axis=1, kind="stable")[:, :steps]
            fresh = ~np.take_along_axis(d, best, 1)
            some = fresh.any(1)
            live, a, s, d, best, fresh = live[some], a[some], s[some], d[some], best[some], fresh[some]
            if not len(live):
                break
            nodes = np.where(fresh, np.take_along_axis(a, best, 1), -1)
            np.put_along_axis(d, best, True, 1)
            near = np.where((nodes >= 0)[:, :, None], links[np.maximum(nodes, 0)], -1).reshape(len(live), -1).astype(np.int64)
            got = np.einsum("nd,nmd->nm", q[live], self.x[np.maximum(near, 0)])
            got = np.where((near >= 0) & (got > s[:, -1:]), got, -np.inf).astype(np.float32)
            ids, val, flag = np.concatenate([a, near], 1), np.concatenate([s, got], 1), np.concatenate([d, np.isneginf(got)], 1)
            # Of a node that is listed twice, the place that was there first stays.
            by = np.argsort(ids, axis=1, kind="stable")
            same = np.take_along_axis(ids, by, 1)
            dup = np.zeros(ids.shape, bool)
            np.put_along_axis(dup, by[:, 1:], same[:, 1:] == same[:, :-1], 1)
            val = np.where(dup, -np.inf, val)
            order = np.argsort(-val, axis=1, kind="stable")[:, :at.shape[1]]
            val = np.take_along_axis(val, order, 1)
            at[live] = np.where(np.isneginf(val), -1, np.take_along_axis(ids, order, 1))
            sims[live] = val
            done[live] = np.take_along_axis(flag, order, 1) | np.isneginf(val)
        return at, sims


def level_sizes(n: int, degree: int) -> list[int]:
    """Prefix lengths of the layers, the top one first: each about ``1 / degree`` of the one below."""
    out = [n]
    while out[0] > 4 * degree:
        out.insert(0, max(1, out[0] // degree))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0))
    size = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("embedding") == (size["n"] if size else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def indexed(vectors: DataFrame, shards: int, degree: int, build_width: int, k: int, width: int, recall: float) -> DataFrame:
    """A row per shard: its distinct vectors, the ids of each, the layers of neighbours and the beam that finds
    ``recall`` of the ``k`` nearest nodes."""
    most = vectors.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0

    def build(pdf):
        import pandas as pd
        x = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
        x, owner = np.unique(x, axis=0, return_inverse=True)
        owner = owner.reshape(-1)
        rng = np.random.default_rng(int(pdf.shard.iloc[0]))
        order = rng.permutation(len(x))
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        x, owner = x[order], place[owner]
        ids = pdf.vec_id.to_numpy()
        by = np.lexsort((ids, owner))
        sizes = level_sizes(len(x), degree)
        graph = Graph.build(augmented(x, most), degree, build_width, sizes)
        own = np.unique(np.linspace(0, len(x) - 1, PROBES).astype(np.int64))
        beam = graph.fitting_width(np.concatenate([x[own], np.zeros((len(own), 1))], 1).astype(np.float32), own, k, width, recall)
        return pd.DataFrame([{"shard": int(pdf.shard.iloc[0]), "nodes": len(x), "dims": x.shape[1], "width": beam, "layers": sizes, "vectors": x.tobytes(),
                              "owners": owner[by].astype("<i8").tobytes(), "ids": ids[by].astype("<i8").tobytes(),
                              "links": [a.tobytes() for a in graph.links]}])

    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")
    return written(vectors.select(shard, "vec_id", "embedding").groupBy("shard").applyInPandas(build, INDEX)).withColumn("most", F.lit(most))


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, most - np.einsum("nd,nd->n", x, x)))
    return np.concatenate([x, rest[:, None]], 1).astype(np.float32)


def loaded(row) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """The graph of an index row, its vectors, and the ids of each node as ranges of one list."""
    x = np.frombuffer(row.vectors, np.float64).reshape(row.nodes, row.dims)
    links = [np.frombuffer(b, np.int32).reshape(n, -1) for b, n in zip(row.links, row.layers)]
    owners, ids = np.frombuffer(row.owners, "<i8"), np.frombuffer(row.ids, "<i8")
    return Graph(augmented(x, row.most), list(row.layers), links), x, np.searchsorted(owners, np.arange(row.nodes + 1)), ids


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, min_shards: int = 8, shard_rows: int = 20_000, degree: int = 32,
            build_width: int = 128, width: int = 96, recall: float = 0.95, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id is divisible by ``every``.

    Shards hold about ``shard_rows`` rows (at least ``min_shards`` of them), queries go in blocks of
    about ``block``; a task searches one block in one shard, with the beam (``width`` or wider) that found
    ``recall`` of the nearest of the shard's probes.
    """
    rows = written(usable(vectors))
    n = rows.count()
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    shards = max(min_shards, -(-n // shard_rows))
    blocks = max(1, -(-asked.count() // block))
    index = indexed(rows, shards, degree, build_width, k + 1, width, recall).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = asked.select("vec_id", "embedding", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int").alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def search(index, queries):
        import pandas as pd
        out = [], [], []
        if len(index) and len(queries):
            graph, x, first, ids = loaded(index.iloc[0])
            beam = int(index.width.iloc[0])
            step = max(16, 512 * width // beam)
            q, owner = np.unique(np.stack(queries.embedding.to_numpy()), axis=0, return_inverse=True)
            asks = np.split(np.argsort(owner.reshape(-1), kind="stable"), np.cumsum(np.bincount(owner.reshape(-1)))[:-1])
            names = queries.vec_id.to_numpy()
            for at in range(0, len(q), step):
                part = q[at:at + step]
                found, _ = graph.search(np.concatenate([part, np.zeros((len(part), 1))], 1).astype(np.float32), beam)
                for row, near in enumerate(found):
                    near = near[near >= 0]
                    exact = (x[near] * part[row]).sum(axis=1)
                    # More than enough ids of the best nodes: a query's own id is one of them.
                    cand, score = [], []
                    for node in np.argsort(-exact, kind="stable"):
                        if len(cand) > k and exact[node] < score[k]:
                            break
                        own = ids[first[near[node]]:first[near[node] + 1]][:k + 1]
                        cand += own.tolist()
                        score += [exact[node]] * len(own)
                    cand, score = np.array(cand), np.array(score)
                    order = np.lexsort((cand, -score))[:k + 1]
                    for a in asks[at + row]:
                        mine = order[cand[order] != names[a]][:k]
                        out[0].append(np.full(len(mine), names[a]))
                        out[1].append(cand[mine])
                        out[2].append(score[mine])
        empty = np.zeros(0, np.int64)
        cols = [np.concatenate(c) if c else empty for c in out]
        return pd.DataFrame({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2].astype(float)})

    found = index.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInPandas(
        search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
