"""Greedy one-to-one matching inside a distance, without a global sort.

Taking pairs in ascending (distance, left id, right id) order and skipping used
objects gives the same result as repeatedly taking every pair that is the best
one for both of its ends.  The second form runs in rounds over all images at once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.operators.graph import connected_components
from motes.operators.ordering import row_numbers
from motes.operators.spatial import XY, k_nearest
from motes.session import checkpoint, saved, shuffled

#: Edges of a piece that a task solves at once.
PIECE = 500_000
#: Neighbours listed per object before the lists are rebuilt from what is left.
LIST = 6


#: Equally near points looked at around a crowded point.
TIES = 9


def _crowds(a: DataFrame, b: DataFrame, keys: list[str], limit: float | None, coords: list[str],
            a_id: str, b_id: str) -> DataFrame | None:
    """Matches around points of ``a`` that hold more copies than a neighbour list can show.

    Let all points of ``b`` nearest to such a crowd have it as their only nearest
    point in turn.  Then nothing comes before these pairs and they are equally long, so
    the crowd's copies and the copies of those points pair up by rank of their ids, all at once.
    """
    at = [*keys, *coords]

    def points(df: DataFrame) -> DataFrame:
        return df.groupBy(*at).agg(F.count("*").alias("_n"), F.min("id").alias("id"))
    pa, pb = points(a), points(b)
    big = pa.where(F.col("_n") > LIST)
    if big.isEmpty():
        return None
    n = k_nearest(big, pb, keys, k=TIES, bound=limit, inclusive=True, coords=coords)
    first = n.where("place = 1").select(*keys, "id", F.col("distance").alias("_d"))
    ties = checkpoint(n.join(first, [*keys, "id"]).where(F.col("distance") == F.col("_d")).select(
        *keys, F.col("id").alias("_a"), F.col("ref_id").alias("_b"), "distance"))
    # enough partners to be worth it, and all of them seen
    sized = ties.join(pb.select(*keys, F.col("id").alias("_b"), "_n"), [*keys, "_b"])
    worth = (sized.groupBy(*keys, "_a").agg(F.sum("_n").alias("_m"), F.count("*").alias("_t"))
             .where((F.col("_m") > LIST) & (F.col("_t") < TIES)))
    near_b = ties.join(worth, [*keys, "_a"], "left_semi").select(*keys, F.col("_b").alias("id")).distinct()
    if near_b.isEmpty():
        return None
    back = k_nearest(pb.join(near_b, [*keys, "id"], "left_semi"), pa, keys, k=2, bound=limit, inclusive=True, coords=coords)
    back = back.groupBy(*keys, F.col("id").alias("_b")).agg(
        F.min(F.when(F.col("place") == 1, F.col("ref_id"))).alias("_a"),
        F.min(F.when(F.col("place") == 1, F.col("distance"))).alias("_d1"),
        F.min(F.when(F.col("place") == 2, F.col("distance"))).alias("_d2"))
    only = back.where(F.col("_d2").isNull() | (F.col("_d2") > F.col("_d1"))).select(*keys, "_a", "_b")
    kept = ties.join(only, [*keys, "_a", "_b"]).groupBy(*keys, "_a").agg(F.count("*").alias("_t"))
    good = worth.join(kept, [*keys, "_a", "_t"], "left_semi").select(*keys, "_a")
    pairs = checkpoint(ties.join(good, [*keys, "_a"], "left_semi"))
    if pairs.isEmpty():
        return None

    def ranked(df: DataFrame, sites: DataFrame, site: str, own: DataFrame, name: str) -> DataFrame:
        spot = sites.select(*at, F.col("id").alias(site)).join(own, [*keys, site]).drop(*({site} - {"_a"}))
        here = df.select(*at, F.col("id").alias(name)).join(spot, at).drop(*coords)
        return row_numbers(here, [*keys, "_a"], name, "_rank")
    of_a = ranked(a, pa, "_a", pairs.select(*keys, "_a", "distance").distinct(), a_id)
    of_b = ranked(b, pb, "_b", pairs.select(*keys, "_a", "_b"), b_id)
    return checkpoint(of_a.join(of_b, [*keys, "_a", "_rank"]).select(*keys, "left_id", "right_id", "distance"))


def greedy_match(left: DataFrame, right: DataFrame, keys: list[str], limit: float | None,
                 coords: list[str] = XY) -> DataFrame:
    """One-to-one matches with ``distance <= limit`` (no limit: None): keys, left_id, right_id, distance.

    Neighbour lists hold the ``LIST`` nearest objects only, so a dense field costs
    no more than a sparse one; crowds of copies at one point pair up as a whole.  An object whose list is used up gets a new one made
    from the objects still free, hence the result is exact.
    """
    left = checkpoint(left.select(*keys, "id", *coords))
    right = checkpoint(right.select(*keys, "id", *coords))
    parts = []

    def free(df: DataFrame, side: str, done: DataFrame) -> DataFrame:
        return df.join(shuffled(done.select(*keys, F.col(side).alias("id"))), [*keys, "id"], "left_anti")

    def without(done: DataFrame) -> tuple[DataFrame, DataFrame]:
        return checkpoint(free(left, "left_id", done)), checkpoint(free(right, "right_id", done))

    while True:
        crowd = _crowds(left, right, keys, limit, coords, "left_id", "right_id")
        if crowd is None:
            crowd = _crowds(right, left, keys, limit, coords, "right_id", "left_id")
        if crowd is not None:
            parts.append(crowd)
            left, right = without(crowd)
            continue

        def listed(a: DataFrame, b: DataFrame, a_id: str, b_id: str, mark: str) -> DataFrame:
            n = k_nearest(a, b, keys, k=LIST, bound=limit, inclusive=True, coords=coords)
            return n.select(*keys, F.col("id").alias(a_id), F.col("ref_id").alias(b_id), "distance",
                            F.lit(True).alias(mark))
        # an edge knows in whose list it stands
        edges = checkpoint(
            listed(left, right, "left_id", "right_id", "_l").unionByName(
                listed(right, left, "right_id", "left_id", "_r"), allowMissingColumns=True)
            .groupBy(*keys, "left_id", "right_id").agg(
                F.first("distance").alias("distance"), F.bool_or("_l").alias("_l"), F.bool_or("_r").alias("_r"))
            .na.fill(False, ["_l", "_r"]).withColumn("_hit", F.lit(False)))
        found = _matched(edges, keys)
        parts.extend(found)
        new = reduce(DataFrame.unionByName, found)
        # only a free object with a full list may still have unseen partners
        if _stalled(edges, new, keys).isEmpty():
            break
        left, right = without(new)
    return reduce(DataFrame.unionByName, parts)


def _stalled(edges: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("_side"), F.col(name).alias("_id"))
    lists = side(edges.where("_l"), "left_id").union(side(edges.where("_r"), "right_id"))
    full = lists.groupBy(*keys, "_side", "_id").count().where(F.col("count") >= LIST)
    return full.join(shuffled(side(matched, "left_id").union(side(matched, "right_id"))), [*keys, "_side", "_id"], "left_anti")


def _solved(l: np.ndarray, r: np.ndarray, d: np.ndarray, own_l: np.ndarray, own_r: np.ndarray) -> list[int]:
    """Edges (l, r, d) that mutual-best rounds over fixed lists take, by a work list instead of rounds.

    ``own_l`` and ``own_r`` mark the edges in the lists of the left and of the right end.  A pair that
    is the best of both ends stays so whatever is matched before it, hence the order does not matter.
    """
    def lists(near, far, own):
        """Per node its own edges, best first."""
        mine, order = [[] for _ in range(int(near.max()) + 1)], np.lexsort((far, d))
        order = order[own[order]]
        for node, k in zip(near[order].tolist(), order.tolist()):
            mine[node].append(k)
        return mine
    a_, b_ = l.tolist(), r.tolist()
    left, right = lists(l, r, own_l), lists(r, l, own_r)
    seen_by_left, seen_by_right = [[] for _ in right], [[] for _ in left]
    for k in np.flatnonzero(own_l).tolist():
        seen_by_left[b_[k]].append(a_[k])
    for k in np.flatnonzero(own_r).tolist():
        seen_by_right[a_[k]].append(b_[k])
    at_l, at_r, gone_l, gone_r = [0] * len(left), [0] * len(right), [False] * len(left), [False] * len(right)

    def best(mine, at, gone, node, far):
        k = at[node]
        while k < len(mine[node]) and gone[far[mine[node][k]]]:
            k += 1
        at[node] = k
        return mine[node][k] if k < len(mine[node]) else -1
    taken, todo = [], list(range(len(left)))[::-1]
    while todo:
        u = todo.pop()
        if gone_l[u]:
            continue
        e = best(left, at_l, gone_r, u, b_)
        if e < 0:
            continue
        v = b_[e]
        if best(right, at_r, gone_l, v, a_) != e:
            continue
        taken.append(e)
        gone_l[u] = gone_r[v] = True
        todo += [x for x in seen_by_left[v] if not gone_l[x]]
        for y in seen_by_right[u]:
            if not gone_r[y]:
                f = best(right, at_r, gone_l, y, a_)
                if f >= 0:
                    todo.append(a_[f])
    return taken


def _pieces(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Edges with the number of their ``_piece``, and those in pieces too large for a task (or None).

    An image is one piece; if it has more than ``PIECE`` edges, each component of its graph is.
    """
    def split(df: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
        n = saved(df.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_piece", F.monotonically_increasing_id()))
        fit = df.join(shuffled(n.where(F.col("_n") <= PIECE).drop("_n")), by)
        if n.where(F.col("_n") > PIECE).isEmpty():
            return fit, None
        return fit, df.join(n.where(F.col("_n") > PIECE).select(*by), by, "left_semi")
    fit, rest = split(edges, keys)
    if rest is None:
        return fit, None
    ks = [F.col(k) for k in keys]
    a, b = (F.struct(*ks, F.lit(side).alias("side"), F.col(c).alias("id")) for side, c in ((0, "left_id"), (1, "right_id")))
    roots = connected_components(rest.select(a.alias("a"), b.alias("b"))).withColumnRenamed("component", "_root")
    whole = saved(rest.withColumn("node", a).join(shuffled(roots), "node").drop("node"))
    parts, rest = split(whole, ["_root"])
    parts = parts.withColumn("_piece", -1 - F.col("_piece"))
    return fit.unionByName(parts.drop("_root")), None if rest is None else rest.drop("_root")


def _matched(edges: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Mutual-best matches over fixed neighbour lists: pieces at once, rounds only for a piece no task holds."""
    cols = [*keys, "left_id", "right_id", "distance"]
    fit, rest = _pieces(edges, keys)
    dealt = fit.repartition("_piece").sortWithinPartitions("_piece").select(*cols, "_l", "_r", "_piece")

    def solve(batches):
        import pyarrow as pa

        def codes(col):
            x = col.to_numpy(zero_copy_only=False) if pa.types.is_integer(col.type) or pa.types.is_floating(col.type) else np.array(
                [v.encode() if isinstance(v, str) else v for v in col.to_pylist()], object)
            return np.unique(x, return_inverse=True)[1]

        def found(table):
            t = table.combine_chunks().to_batches()[0]
            piece = codes(t.column("_piece"))
            ends = []
            for name in ("left_id", "right_id"):
                c = codes(t.column(name))
                ends.append(np.unique(piece * (int(c.max()) + 1) + c, return_inverse=True)[1])
            d, own_l, own_r = (t.column(c).to_numpy(zero_copy_only=False) for c in ("distance", "_l", "_r"))
            return t.take(pa.array(_solved(*ends, d, own_l, own_r), pa.int64())).select(cols)
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= PIECE:
                # pieces stay whole: the last one waits for its other rows
                table = pa.Table.from_batches(held)
                piece = table.column("_piece").to_numpy()
                cut = int(np.searchsorted(piece, piece[-1]))
                if cut:
                    yield found(table.slice(0, cut))
                    held, count = table.slice(cut).to_batches(), count - cut
        if count:
            yield found(pa.Table.from_batches(held))
    schema = dealt.select(*cols).schema
    out = [saved(dealt.mapInArrow(solve, schema))]
    return out if rest is None else out + _rounds(checkpoint(rest), keys)


def _rounds(edges: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Mutual-best rounds over fixed neighbour lists until no pair is mutual.

    Pairs found stay in the round's table, marked ``_hit``, so a round is one job.
    """
    cols = [*keys, "left_id", "right_id", "distance"]
    found = []
    while True:
        l_best = (edges.where("_l").groupBy(*keys, "left_id").agg(F.min(F.struct("distance", "right_id")).alias("_b"))
                  .select(*keys, "left_id", "_b.right_id"))
        r_best = (edges.where("_r").groupBy(*keys, "right_id").agg(F.min(F.struct("distance", "left_id")).alias("_b"))
                  .select(*keys, "right_id", "_b.left_id", "_b.distance"))
        mutual = l_best.join(r_best, [*keys, "left_id", "right_id"])
        rest = (edges.join(mutual.select(*keys, "left_id"), [*keys, "left_id"], "left_anti")
                .join(mutual.select(*keys, "right_id"), [*keys, "right_id"], "left_anti"))
        new = mutual.withColumns({"_l": F.lit(True), "_r": F.lit(True), "_hit": F.lit(True)})
        done = checkpoint(rest.unionByName(new))
        n = done.agg(F.count_if("_hit").alias("hits"), F.count_if(~F.col("_hit")).alias("left")).first()
        found.append(done.where("_hit").select(*cols))
        edges = done.where(~F.col("_hit"))
        if not n["hits"] or not n["left"]:
            return found


def channel_pair_matches(dets: DataFrame, keys: list[str], limit: float,
                         coords: list[str] = XY) -> DataFrame:
    """Greedy matches for every unordered channel pair, all pairs in the same rounds.

    ``dets`` holds keys, channel, id and coordinates.  Each detection takes part in
    one pair per other channel; the pair is simply one more key of the matching.
    """
    names = sorted(r[0] for r in dets.select("channel").distinct().limit(1000).collect())
    if len(names) == 1000:
        raise ValueError("more channels than a channel list may hold")

    def side(first: bool) -> DataFrame:
        partners = F.array(*[F.lit(n) for n in names])
        own, other = F.col("channel"), F.col("_other")
        d = dets.withColumn("_other", F.explode(partners)).where(own < other if first else own > other)
        c1, c2 = (own, other) if first else (other, own)
        return d.select(*keys, c1.alias("channel_1"), c2.alias("channel_2"), "id", *coords)
    return greedy_match(side(True), side(False), [*keys, "channel_1", "channel_2"], limit, coords)


def pair_rates(dets: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Per channel pair: objects on each side, matches and the match rate of each side."""
    n = dets.groupBy(*keys, "channel").agg(F.count("*").alias("n"))
    one = n.withColumnsRenamed({"channel": "channel_1", "n": "n_1"})
    two = n.withColumnsRenamed({"channel": "channel_2", "n": "n_2"})
    hits = matches.groupBy(*keys, "channel_1", "channel_2").agg(F.count("*").alias("matched"))
    # one row per channel and image: pairs of channels, not of objects
    pairs = one.join(two, keys) if keys else one.join(two, F.lit(True))
    m = F.coalesce("matched", F.lit(0))
    return (pairs.where(F.col("channel_1") < F.col("channel_2"))
            .join(hits, [*keys, "channel_1", "channel_2"], "left")
            .select(*keys, "channel_1", "channel_2", "n_1", "n_2", m.alias("matched"),
                    (m / F.col("n_1")).alias("rate_1"), (m / F.col("n_2")).alias("rate_2")))


def colocalized_ids(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Every (channel, id) that takes part in a match."""
    a = matches.select(*keys, F.col("channel_1").alias("channel"), F.col("left_id").alias("id"))
    b = matches.select(*keys, F.col("channel_2").alias("channel"), F.col("right_id").alias("id"))
    return a.union(b).distinct()


def colocalized_flag(dets: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    hit = colocalized_ids(matches, keys).withColumn("colocalized", F.lit(True))
    return dets.join(shuffled(hit), [*keys, "channel", "id"], "left").na.fill(False, ["colocalized"])
