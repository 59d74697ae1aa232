"""Spatial joins between detections of the same image.

Every join is an equi-join on grid cells.  A cell that holds very many objects
is either cut into smaller cells (nearest neighbours) or salted on both sides
(joins whose result is the pairs themselves).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motes.session import checkpoint, dealt, saved, shuffled, small_side

XY = ["centroid_x", "centroid_y"]
#: Most sites a search cell may hold, most different query points of one, and the deepest grid level.
LEAF_SITES = 32
LEAF_POINTS = 4096
DEEPEST = 40
#: Rows of one join key before it is salted.
HOT_ROWS = 50_000
#: Width of a cell of the pair join in limits.
CELL_LIMITS = 4


# -- salting ---------------------------------------------------------------

def salted(left: DataFrame, right: DataFrame, keys: list[str], hot: int | None = None
           ) -> tuple[DataFrame, DataFrame, list[str]]:
    """Split hot join keys of both sides; returns the sides and the keys to join on.

    A key with ``m`` left and ``n`` right rows above the limit becomes a grid of
    ceil(m/limit) x ceil(n/limit) blocks.  Nothing is added when no key is hot.
    """
    hot = hot or HOT_ROWS

    def blocks(side: DataFrame, name: str) -> DataFrame:
        n = F.count("*")
        return (side.groupBy(*keys).agg(F.ceil(n / hot).cast("int").alias(name))
                .where(F.col(name) > 1))

    lb, rb = blocks(left, "_lb"), blocks(right, "_rb")
    if lb.isEmpty() and rb.isEmpty():
        return left, right, keys
    grid = small_side(lb.join(rb, keys, "full").na.fill(1, ["_lb", "_rb"]))

    def spread(side: DataFrame, own: str, other: str, own_salt: str, other_salt: str) -> DataFrame:
        s = side.join(grid, keys, "left").na.fill(1, ["_lb", "_rb"])
        # from the row itself, so a recomputed task salts alike
        s = s.withColumn(own_salt, F.pmod(F.xxhash64(*side.columns), F.col(own)).cast("int"))
        s = s.withColumn(other_salt, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return s.drop("_lb", "_rb")

    return (spread(left, "_lb", "_rb", "_ls", "_rs"), spread(right, "_rb", "_lb", "_rs", "_ls"),
            [*keys, "_ls", "_rs"])


# -- pairs within a distance ---------------------------------------------------

def pairs_within(left: DataFrame, right: DataFrame, keys: list[str], limit: float, *,
                 inclusive: bool = True, id: str = "id", coords: list[str] = XY) -> DataFrame:
    """All pairs of one image within ``limit``: keys, left_id, right_id, distance.

    Cells are ``CELL_LIMITS`` limits wide; a left row is in one of them, a right row in those it
    may have a partner in, 2.25 on average.
    """
    cell = ["_c0", "_c1"]
    x, y = coords
    side = limit * CELL_LIMITS

    def reached(c: str) -> Column:
        # a hair of slack, as the squared distance is rounded too
        slack = F.lit(limit * 1e-9) + F.abs(F.col(c)) * 1e-15
        return F.explode(F.sequence(F.floor((F.col(c) - limit - slack) / side), F.floor((F.col(c) + limit + slack) / side)))

    a = left.select(*keys, F.col(id).alias("left_id"), F.col(x).cast("double").alias("_ax"), F.col(y).cast("double").alias("_ay"))
    b = right.select(*keys, F.col(id).alias("right_id"), F.col(x).cast("double").alias("_bx"), F.col(y).cast("double").alias("_by"))
    rows = left.count() + right.count() * (1 + 2 / CELL_LIMITS) ** 2
    a = a.withColumn("_c0", F.floor(F.col("_ax") / side)).withColumn("_c1", F.floor(F.col("_ay") / side))
    # what is not finite is near nothing
    end = F.lit(float("inf"))
    b = b.where((F.abs("_bx") < end) & (F.abs("_by") < end)).withColumn("_c0", reached("_bx")).withColumn("_c1", reached("_by"))
    a, b, on = salted(a, b, keys + cell)
    a, b = dealt(a, rows, *on), dealt(b, rows, *on)
    d2 = ((F.col("_ax") - F.col("_bx")) * (F.col("_ax") - F.col("_bx"))
          + (F.col("_ay") - F.col("_by")) * (F.col("_ay") - F.col("_by")))
    near = d2 <= limit * limit if inclusive else d2 < limit * limit
    return shuffled(a).join(b, on).where(near).select(*keys, "left_id", "right_id", F.sqrt(d2).alias("distance"))


# -- cells that narrow --------------------------------------------------------

class _Grid:
    """Nested square cells over point coordinates: level n has cells of side / 2**n.

    Under a bound the top cells have the bound as their side and a point looks at
    the adjacent ones too; without one a single top cell spans all sites.
    """

    def __init__(self, sites: DataFrame, keys: list[str], coords: list[str], bound: float | None):
        self.keys, self.coords, self.bounded = keys, coords, bound is not None
        #: Rows that joins and windows over the cells are dealt by.
        self.rows = 0.0
        self.cells = [f"_c{i}" for i in range(len(coords))]
        self.lows, self.side = [0.0] * len(coords), float(bound or 1.0)
        if bound is None:
            ends = sites.agg(*[F.min(c).cast("double").alias(f"lo{i}") for i, c in enumerate(coords)],
                             *[F.max(c).cast("double").alias(f"hi{i}") for i, c in enumerate(coords)]).first()
            if ends["lo0"] is not None:
                self.lows = [ends[f"lo{i}"] for i in range(len(coords))]
                widest = max(ends[f"hi{i}"] - lo for i, lo in enumerate(self.lows))
                self.side = 2.0 ** math.ceil(math.log2(widest * 1.0000001)) if widest > 0 else 1.0

    def on_level(self, df: DataFrame, level: int) -> DataFrame:
        return df.withColumns({
            f"_c{i}": F.floor((F.col(c).cast("double") - F.lit(self.lows[i])) / F.lit(self.side) * F.lit(2.0 ** level))
            for i, c in enumerate(self.coords)})

    def crowd(self, sites: DataFrame, level: int) -> int:
        """Rows in the fullest cell."""
        n = self.on_level(sites, level).groupBy(*self.keys, *self.cells).count().agg(F.max("count")).first()[0]
        return n or 0

    def depth(self, sites: DataFrame, leaf: int) -> int:
        """First level found on which no cell holds more than ``leaf`` sites."""
        level, most = 0, self.crowd(sites, 0)
        while most > leaf and level < DEEPEST:
            level += max(1, math.ceil(math.log2(most / leaf) / len(self.coords)))
            most = self.crowd(sites, level)
        return level

    @property
    def open_keys(self) -> list[str]:
        return self.keys + self.cells if self.bounded else self.keys

    def points(self, df: DataFrame, id: str) -> DataFrame:
        """Points with coordinates ``_p0..`` and one row per top cell they look at."""
        p = df.select(*self.keys, id, *[F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(self.coords)])
        if self.bounded:
            near = F.array(*[F.lit(s) for s in (-1, 0, 1)])
            for i in range(len(self.coords)):
                home = F.floor((F.col(f"_p{i}") - F.lit(self.lows[i])) / F.lit(self.side))
                p = p.withColumn("_s", F.explode(near)).withColumn(f"_c{i}", home + F.col("_s")).drop("_s")
        return p

    def boxes(self, sites: DataFrame, deepest: int, n: Column) -> dict[int, DataFrame]:
        """Per level the occupied cells with their weight ``_n`` and tight bounds, finest first written once."""
        ends = range(len(self.coords))
        deep = checkpoint(self.on_level(sites, deepest).groupBy(*self.keys, *self.cells).agg(
            F.sum(n).alias("_n"), *[F.min(c).cast("double").alias(f"_lo{i}") for i, c in enumerate(self.coords)],
            *[F.max(c).cast("double").alias(f"_hi{i}") for i, c in enumerate(self.coords)]))
        out = {deepest: deep}
        for lv in range(0, deepest, 2):
            up = deep.withColumns({c: F.shiftright(c, deepest - lv) for c in self.cells})
            out[lv] = up.groupBy(*self.keys, *self.cells).agg(
                F.sum("_n").alias("_n"), *[F.min(f"_lo{i}").alias(f"_lo{i}") for i in ends],
                *[F.max(f"_hi{i}").alias(f"_hi{i}") for i in ends])
        return dict(sorted(out.items()))

    def with_reach(self, df: DataFrame) -> DataFrame:
        """Squared distances ``_near`` and ``_far`` from the point to a cell's bounds."""
        near, far = F.lit(0.0), F.lit(0.0)
        for i in range(len(self.coords)):
            p, lo, hi = F.col(f"_p{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}")
            d, e = F.greatest(lo - p, p - hi, F.lit(0.0)), F.greatest(F.abs(p - lo), F.abs(hi - p))
            near, far = near + d * d, far + e * e
        return df.withColumns({"_near": near, "_far": far})

    def with_gap(self, df: DataFrame) -> DataFrame:
        """Squared distances ``_near`` and ``_far`` between the bounds of a cell of points and one of sites."""
        near, far = F.lit(0.0), F.lit(0.0)
        for i in range(len(self.coords)):
            a, b, lo, hi = F.col(f"_qlo{i}"), F.col(f"_qhi{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}")
            d, e = F.greatest(lo - b, a - hi, F.lit(0.0)), F.greatest(hi - a, b - lo)
            near, far = near + d * d, far + e * e
        return df.withColumns({"_near": near, "_far": far})

    @property
    def asking(self) -> list[str]:
        return [f"_q{i}" for i in range(len(self.coords))]

    @property
    def ask_stats(self) -> list[str]:
        return [f"_q{e}{i}" for e in ("lo", "hi") for i in range(len(self.coords))]

    @property
    def renamed(self) -> dict[str, str]:
        """Cells and bounds of query points beside those of sites."""
        return dict(zip(self.cells, self.asking)) | {c[0] + c[2:]: c for c in self.ask_stats}

    def asked(self, on_level: DataFrame, ids: list[str]) -> DataFrame:
        """Points, or positions without ``ids``, with their coordinates and the cell they ask from."""
        return on_level.select(*self.keys, *ids, *[F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(self.coords)],
                               *[F.col(c).alias(q) for c, q in zip(self.cells, self.asking)])

    @property
    def stats(self) -> list[str]:
        return ["_n", *[f"_{e}{i}" for e in ("lo", "hi") for i in range(len(self.coords))]]

    def children(self, front: DataFrame, boxes: DataFrame, up: int, lv: int) -> DataFrame:
        """Front rows moved from level ``up`` to the occupied cells of level ``lv`` below."""
        ups = {c: f"_up{i}" for i, c in enumerate(self.cells)}
        child = boxes.withColumns({u: F.shiftright(c, lv - up) for c, u in ups.items()})
        return (front.drop(*self.stats).withColumnsRenamed(ups)
                .join(shuffled(child), [*self.keys, *ups.values()]).drop(*ups.values()))

    def squared(self) -> Column:
        return reduce(lambda a, b: a + b, [(F.col(f"_p{i}") - F.col(c)) * (F.col(f"_p{i}") - F.col(c))
                                           for i, c in enumerate(self.coords)])


# -- k nearest -------------------------------------------------------------

def _sites(sites: DataFrame, keys: list[str], coords: list[str], keep: int) -> DataFrame:
    """Copies at one point matter only through their ``keep`` smallest ids."""
    if keep == 1:
        return sites.groupBy(*keys, *coords).agg(F.min("_rid").alias("_rid"))
    w = Window.partitionBy(*keys, *coords).orderBy("_rid")
    return sites.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= keep).drop("_i")


def _cell_pairs(grid: _Grid, spots: DataFrame, sites: DataFrame, level: int, narrowed) -> DataFrame:
    """Cells of query points with the cells of sites that may hold a neighbour of one of them, on ``level``."""
    boxes = grid.boxes(sites, level, F.lit(1))
    asks = {lv: b.drop("_n").withColumnsRenamed(grid.renamed) for lv, b in grid.boxes(spots, level, F.lit(1)).items()}
    own = [*grid.keys, *grid.asking]
    top = asks[0]
    if grid.bounded:
        for c, q in zip(grid.cells, grid.asking):
            top = top.withColumn("_s", F.explode(F.array(*[F.lit(s) for s in (-1, 0, 1)]))).withColumn(c, F.col(q) + F.col("_s")).drop("_s")
    front = narrowed(grid.with_gap(shuffled(top).join(boxes[0], grid.open_keys)), own).drop("_reach")
    levels = list(boxes)
    for up, lv in zip(levels, levels[1:]):
        # the cells of sites first: then all pairs of a cell of points are made, and narrowed, in one task
        ups = {q: f"_up{q}" for q in grid.asking}
        on = [*grid.keys, *ups.values()]
        below = dealt(asks[lv].withColumns({u: F.shiftright(q, lv - up) for q, u in ups.items()}), grid.rows, *on)
        front = dealt(grid.children(front.drop(*grid.ask_stats), boxes[lv], up, lv).withColumnsRenamed(ups), grid.rows, *on)
        front = narrowed(grid.with_gap(front.join(shuffled(below), on)), [*on, *grid.asking], False).drop("_reach", *ups.values())
    return front.drop(*grid.ask_stats)


def _repeated(df: DataFrame, keys: list[str], id: str) -> bool:
    """Whether an id is missing or comes more than once."""
    return not df.groupBy(*keys, id).count().where((F.col("count") > 1) | F.col(id).isNull()).isEmpty()


def _by_position(grid: _Grid, points: DataFrame, spots: DataFrame, sites: DataFrame, level: int, narrowed, rows: float,
                 k: int, need: int, limit2: float | None, inclusive: bool, skip_self: bool, id: str) -> DataFrame:
    """The search of :func:`k_nearest` in the cells of ``level``, once for every position in ``spots``, for ids that are unique.

    A cell hands a position its ``need`` nearest sites as one list, so what is shuffled are a few short lists
    a position and no row for each site of each cell.  Points take the list of their position.
    """
    keys, at = grid.keys, [f"_p{i}" for i in range(len(grid.coords))]
    front = _cell_pairs(grid, spots, sites, level, narrowed)
    # dealt as the cells are, so all cells of a position are in one task and are narrowed there
    asks = dealt(grid.asked(grid.on_level(spots, level), []), rows, *keys, *grid.asking)
    opened = shuffled(asks).join(front, keys + grid.asking)
    front = narrowed(grid.with_reach(opened), [*keys, *grid.asking, *at], False).drop(*grid.stats, *grid.asking)
    cells = keys + grid.cells
    held = grid.on_level(sites, level).groupBy(*cells).agg(
        F.collect_list(F.struct(*[F.col(c).cast("double").alias(f"_s{i}") for i, c in enumerate(grid.coords)], "_rid")).alias("_held"))

    def squared(s: Column) -> Column:
        return reduce(lambda a, b: a + b, [(F.col(p) - s[f"_s{i}"]) * (F.col(p) - s[f"_s{i}"]) for i, p in enumerate(at)])
    near = F.transform("_held", lambda s: F.struct(squared(s).alias("_d2"), s["_rid"].alias("_rid")))
    near = F.filter(near, lambda t: F.col("_reach").isNull() | (t["_d2"] <= F.col("_reach") * 1.000000001))
    if limit2 is not None:
        near = F.filter(near, lambda t: t["_d2"] <= limit2 if inclusive else t["_d2"] < limit2)
    lists = shuffled(dealt(front, rows, *cells)).join(held, cells).select(
        *keys, *at, F.slice(F.sort_array(near), 1, need).alias("_near"))
    top = dealt(lists, rows, *keys, *at).groupBy(*keys, *at).agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("_near"))), 1, need).alias("_near"))
    p = points.select(*keys, id, *[F.col(c).cast("double").alias(a) for a, c in zip(at, grid.coords)])
    j = p.join(shuffled(top), [*keys, *at])
    found = F.filter("_near", lambda t: t["_rid"] != F.col(id)) if skip_self else F.col("_near")
    best = j.select(*keys, id, F.posexplode(F.slice(found, 1, k)).alias("_i", "_t"))
    return best.select(*keys, id, F.col("_t._rid").alias("ref_id"), F.sqrt("_t._d2").alias("distance"), (F.col("_i") + 1).alias("place"))


def k_nearest(points: DataFrame, refs: DataFrame, keys: list[str], *, k: int = 1,
              bound: float | None = None, inclusive: bool = False, skip_self: bool = False,
              id: str = "id", coords: list[str] = XY) -> DataFrame:
    """The ``k`` nearest ``refs`` of every point inside the same ``keys``.

    Returns keys, ``id``, ``ref_id``, ``distance`` and ``place`` (1 = nearest; ties
    go to the smaller ref id).  Points with no neighbour inside ``bound`` are absent.

    References and points lie in the same nested grid, whose cells are halved until none is
    crowded.  Cells of points walk down beside cells of references, and a pair of them is dropped
    once enough other references are sure to be nearer to every point of the cell.  Positions are
    opened in the finest cells only, so neither a dense spot nor an image of any number of points
    meets in one place, and no point is ever paired with a whole crowd; points at one position
    share what it finds.
    """
    need = k + 1 if skip_self else k
    leaf = max(LEAF_SITES, 4 * need)

    def present(df: DataFrame) -> DataFrame:
        return df.where(reduce(lambda p, r: p & r, [F.col(c).isNotNull() for c in coords]))
    sites = present(refs).select(*keys, *coords, F.col(id).alias("_rid"))
    spots = present(points).select(*keys, *coords)
    grid, level = _Grid(sites.select(*coords).union(spots.select(*coords)), keys, coords, bound), 0
    both = grid.on_level(sites.select(*keys, *coords, F.lit(1).alias("_s")).union(spots.select("*", F.lit(0))), 0)
    most = both.groupBy(*keys, *grid.cells).agg(F.sum("_s").alias("s"), F.count("*").alias("n")).agg(
        F.max("s"), F.max(F.col("n") - F.col("s")), F.sum(F.col("s") * (F.col("n") - F.col("s"))), F.sum(F.col("n") - F.col("s"))).first()
    if (most[0] or 0) > leaf or (most[1] or 0) > LEAF_POINTS:
        sites = _sites(sites, keys, coords, need)
        level = max(1, grid.depth(sites, leaf))
        spots = saved(spots.distinct())
        if grid.crowd(spots, level) > LEAF_POINTS:
            level = max(level, grid.depth(spots, LEAF_POINTS))
        rows = grid.rows = spots.count() * leaf

    limit2 = None if bound is None else float(bound) * float(bound)
    if level == 0:
        # pairs of a cell, for each of the cells that a point looks at
        rows = (most[2] or 0) * (3 ** len(coords) if bound is not None else 1)
        p = dealt(grid.points(points, id), rows, *grid.open_keys)
        near = dealt(grid.on_level(sites, 0) if bound is not None else sites, rows, *grid.open_keys)
        cand = shuffled(p).join(near, grid.open_keys)
    else:
        def narrowed(df: DataFrame, of: list[str], deal: bool = True) -> DataFrame:
            """Drop cells that lie beyond ``need`` sites already sure to be nearer; the last of these is within ``_reach``."""
            mine = Window.partitionBy(*of)
            if limit2 is not None:
                df = df.where(F.col("_near") <= limit2)
            if deal:
                df = dealt(df, rows, *of)
            df = df.withColumn("_got", F.sum("_n").over(mine.orderBy("_far")))
            df = df.withColumn("_reach", F.min(F.when(F.col("_got") >= need, F.col("_far"))).over(mine))
            # a hair of slack keeps exact ties through rounding
            return (df.where(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach") * 1.000000001))
                    .drop("_near", "_far", "_got"))
        if not any(_repeated(t, keys, id) for t in ([points, refs] if skip_self and refs is not points else [points])):
            return _by_position(grid, points, spots, sites, level, narrowed, rows, k, need, limit2, inclusive, skip_self, id)
        # rows that share an id share their candidates, so these are gathered by id
        rows = (most[3] or 0) * leaf
        front = _cell_pairs(grid, spots, sites, level, narrowed)
        opened = shuffled(grid.asked(grid.on_level(points, level), [id])).join(front, keys + grid.asking)
        front = narrowed(grid.with_reach(opened), [*keys, id]).drop("_reach")
        cells = keys + grid.cells
        cand = shuffled(dealt(front.drop(*grid.stats, *grid.asking), rows, *cells)).join(dealt(grid.on_level(sites, level), rows, *cells), cells)

    cand = cand.withColumn("_d2", grid.squared())
    if limit2 is not None:
        cand = cand.where(F.col("_d2") <= limit2 if inclusive else F.col("_d2") < limit2)
    if skip_self:
        cand = cand.where(F.col(id) != F.col("_rid"))
    if k == 1:
        best = cand.groupBy(*keys, id).agg(F.min(F.struct("_d2", "_rid")).alias("_b"))
        return best.select(*keys, id, F.col("_b._rid").alias("ref_id"),
                           F.sqrt("_b._d2").alias("distance"), F.lit(1).alias("place"))
    if grid.open_keys != keys or level:
        cand = dealt(cand, rows, *keys, id)
    w = Window.partitionBy(*keys, id).orderBy("_d2", "_rid")
    return (cand.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
            .select(*keys, id, F.col("_rid").alias("ref_id"), F.sqrt("_d2").alias("distance"), "place"))


def counts_within(points: DataFrame, refs: DataFrame, keys: list[str], limit: float, *,
                  id: str = "id", coords: list[str] = XY) -> DataFrame:
    """How many ``refs`` lie within ``limit`` (inclusive) of each point: keys, id, ``n``.

    Cells wholly inside the circle add their count at once; only cells on its rim
    are looked into.  No pairs are made, so a crowd costs no more than its rim.
    Points without any are absent.
    """
    sites = refs.groupBy(*keys, *coords).agg(F.count("*").alias("_copies"))
    grid = _Grid(sites, keys, coords, limit)
    level = grid.depth(sites, LEAF_SITES)
    p, limit2 = grid.points(points, id), float(limit) * float(limit)
    parts = []
    if level == 0:
        rim = p
    else:
        boxes = grid.boxes(sites, level, F.col("_copies"))
        levels = list(boxes)
        front = shuffled(p).join(boxes[0], grid.open_keys)
        for up, lv in zip([None, *levels], levels):
            if up is not None:
                front = grid.children(front, boxes[lv], up, lv)
            front = grid.with_reach(front)
            parts.append(front.where(F.col("_far") <= limit2).select(*keys, id, F.col("_n").alias("n")))
            front = front.where((F.col("_near") <= limit2) & (F.col("_far") > limit2)).drop("_near", "_far")
        rim = front.drop(*grid.stats)
    at_rim = shuffled(rim).join(grid.on_level(sites, level), keys + grid.cells).where(grid.squared() <= limit2)
    parts.append(at_rim.select(*keys, id, F.col("_copies").alias("n")))
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, id).agg(F.sum("n").alias("n"))


def nearest_reference(markers: DataFrame, refs: DataFrame, keys: list[str], limit: float,
                      inclusive: bool = False) -> DataFrame:
    """Each marker object with its single nearest reference; ``d < limit`` unless inclusive."""
    return k_nearest(markers, refs, keys, bound=limit, inclusive=inclusive).drop("place")


def nearest_any(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest ``right`` object of each ``left`` object, however far it is."""
    return k_nearest(left, right, keys).drop("place")


def closest_pair(nearest: DataFrame, keys: list[str], id: str = "id") -> DataFrame:
    """The closest pair per group of a nearest-neighbour table."""
    best = F.min(F.struct("distance", id, "ref_id")).alias("_b")
    return nearest.groupBy(*keys).agg(best).select(*keys, f"_b.{id}", "_b.ref_id", "_b.distance")


# -- boxes -------------------------------------------------------------------

BOX = ["bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"]


def box_pairs(left: DataFrame, right: DataFrame, keys: list[str], *, id: str = "id",
              carry: list[str] = []) -> DataFrame:
    """Pairs whose boxes overlap (strictly, on all four sides).

    Boxes are filed in a grid of their own size class, so even a huge box sits in
    at most four cells; a pair meets in the coarser of its two grids and is
    reported from the one cell that holds the corner where the overlap begins.
    ``carry`` columns come back prefixed ``left_`` and ``right_``.
    """
    x1, y1, x2, y2 = BOX

    def prepared(df: DataFrame, tag: str) -> DataFrame:
        longest = F.greatest(F.abs(F.col(x2) - F.col(x1)), F.abs(F.col(y2) - F.col(y1)), F.lit(1.0))
        return df.select(
            *keys, F.col(id).alias(f"{tag}_id"), *[F.col(c).alias(f"{tag}_{c}") for c in carry],
            *[F.col(b).cast("double").alias(f"_{tag}{i}") for i, b in enumerate(BOX)],
            F.ceil(F.log2(longest)).cast("int").alias("_own"))

    a, b = prepared(left, "left"), prepared(right, "right")
    # size classes are powers of two: a handful of numbers
    classes = sorted(r[0] for r in a.select("_own").union(b.select("_own")).distinct().limit(1100).collect()
                     if r[0] is not None)

    def filed(df: DataFrame, tag: str) -> DataFrame:
        up = F.filter(F.array(*[F.lit(c) for c in classes]), lambda c: c >= F.col("_own"))
        df = df.withColumn("_class", F.explode(up)).withColumn("_w", F.pow(F.lit(2.0), F.col("_class")))

        def span(lo: str, hi: str) -> Column:
            return F.sequence(F.floor(F.least(lo, hi) / F.col("_w")), F.floor(F.greatest(lo, hi) / F.col("_w")))
        return (df.withColumn("_cx", F.explode(span(f"_{tag}0", f"_{tag}2")))
                .withColumn("_cy", F.explode(span(f"_{tag}1", f"_{tag}3"))))

    if not classes:
        classes = [0]
    fa = filed(a, "left").withColumnRenamed("_own", "_lown")
    fb = filed(b, "right").withColumnRenamed("_own", "_rown").drop("_w")
    fa, fb, on = salted(fa, fb, [*keys, "_class", "_cx", "_cy"])
    l0, l1, l2, l3 = (F.col(f"_left{i}") for i in range(4))
    r0, r1, r2, r3 = (F.col(f"_right{i}") for i in range(4))
    begin_x, begin_y = F.greatest(l0, r0), F.greatest(l1, r1)
    meets = shuffled(fa).join(fb, on).where(
        (F.col("_class") == F.greatest("_lown", "_rown"))
        & (l0 < r2) & (r0 < l2) & (l1 < r3) & (r1 < l3)
        & (F.floor(begin_x / F.col("_w")) == F.col("_cx")) & (F.floor(begin_y / F.col("_w")) == F.col("_cy")))
    return meets.select(*keys, "left_id", "right_id", *[f"left_{c}" for c in carry],
                        *[f"right_{c}" for c in carry])


# -- label masks ---------------------------------------------------------------

def label_pairs(ref_pixels: DataFrame, marker_pixels: DataFrame, image: list[str]) -> DataFrame:
    """Object pairs sharing pixels: image, left_id, right_id, ``shared``.

    Both inputs hold ``image, y, x, label`` with one label per pixel, so the join
    key is unique on either side and no key can be hot.
    """
    a = ref_pixels.where(F.col("label") > 0).select(*image, "y", "x", F.col("label").alias("left_id"))
    b = marker_pixels.where(F.col("label") > 0).select(*image, "y", "x", F.col("label").alias("right_id"))
    return (a.join(b, [*image, "y", "x"]).groupBy(*image, "left_id", "right_id")
            .agg(F.count("*").alias("shared")))


def with_centroid_distance(pairs: DataFrame, left: DataFrame, right: DataFrame, keys: list[str],
                           id: str = "id", coords: list[str] = XY) -> DataFrame:
    """Add the centroid distance; pairs with an unknown object are dropped."""
    x, y = coords
    a = left.select(*keys, F.col(id).alias("left_id"), F.col(x).alias("_ax"), F.col(y).alias("_ay"))
    b = right.select(*keys, F.col(id).alias("right_id"), F.col(x).alias("_bx"), F.col(y).alias("_by"))
    j = pairs.join(a, [*keys, "left_id"]).join(b, [*keys, "right_id"])
    return j.withColumn("distance", F.hypot(F.col("_ax") - F.col("_bx"), F.col("_ay") - F.col("_by"))) \
        .drop("_ax", "_ay", "_bx", "_by")


def overlap_matches(refs: DataFrame, markers: DataFrame, keys: list[str],
                    ref_pixels: DataFrame | None = None, marker_pixels: DataFrame | None = None,
                    strict_mask: bool = False) -> DataFrame:
    """Overlapping pairs by label mask; images whose masks never touch fall back to boxes.

    ``strict_mask`` trusts the masks also where they share no pixel.
    """
    def boxed(l: DataFrame, r: DataFrame) -> DataFrame:
        return with_centroid_distance(box_pairs(l, r, keys), l, r, keys)

    cols = [*keys, "left_id", "right_id", "distance"]
    if ref_pixels is None or marker_pixels is None:
        return boxed(refs, markers).select(*cols)
    shared = label_pairs(ref_pixels, marker_pixels, keys)
    masked = with_centroid_distance(shared, refs, markers, keys).select(*cols)
    if strict_mask:
        return masked
    touched = shared.select(*keys).distinct()
    rest = refs.join(touched, keys, "left_anti")
    return masked.unionByName(boxed(rest, markers).select(*cols))


#: A marker counts as fully inside from this percentage on.
FULL_PERCENT = 99.9


def overlap_percent(primary: DataFrame, secondary: DataFrame, keys: list[str], *,
                    mode: str = "overlap_all", min_pct: float = 10.0,
                    shape: tuple[int, int] | None = None,
                    primary_pixels: DataFrame | None = None,
                    secondary_pixels: DataFrame | None = None) -> DataFrame:
    """Pairs with the shared share of the marker in percent, filtered by ``mode``.

    With pixel tables the share is counted; without, the integer-truncated boxes
    (clipped to ``shape`` = height, width) stand in as masks in closed form.
    Modes: overlap_all, overlap_full, overlap_partial, overlap_min_pct.
    """
    if primary_pixels is not None and secondary_pixels is not None:
        size = (secondary_pixels.where(F.col("label") > 0).groupBy(*keys, F.col("label").alias("right_id"))
                .agg(F.count("*").alias("_size")))
        pct = (label_pairs(primary_pixels, secondary_pixels, keys).join(size, [*keys, "right_id"])
               .withColumn("percent", F.col("shared") / F.col("_size") * 100.0))
    else:
        h, w = shape if shape else (None, None)

        def cut(df: DataFrame) -> DataFrame:
            def clip(c: str, top: int | None) -> Column:
                v = F.greatest(F.col(c).cast("long"), F.lit(0))
                return v if top is None else F.least(v, F.lit(top))
            return df.withColumns({"bbox_x1": clip("bbox_x1", w), "bbox_x2": clip("bbox_x2", w),
                                   "bbox_y1": clip("bbox_y1", h), "bbox_y2": clip("bbox_y2", h)})
        p = box_pairs(cut(primary), cut(secondary), keys, carry=["bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"])

        def side(lo: str, hi: str) -> Column:
            return (F.least(F.col(f"left_{hi}"), F.col(f"right_{hi}"))
                    - F.greatest(F.col(f"left_{lo}"), F.col(f"right_{lo}")))
        size = ((F.col("right_bbox_x2") - F.col("right_bbox_x1"))
                * (F.col("right_bbox_y2") - F.col("right_bbox_y1")))
        inter = side("bbox_x1", "bbox_x2") * side("bbox_y1", "bbox_y2")
        pct = p.withColumn("percent", F.when(size > 0, inter / size * 100.0).otherwise(0.0))
    if mode == "overlap_min_pct" and min_pct <= 0:
        raise ValueError("min_pct must be positive")
    p = F.col("percent")
    keep = {"overlap_all": p > 0.0, "overlap_full": p >= FULL_PERCENT,
            "overlap_partial": (p > 0.0) & (p < FULL_PERCENT), "overlap_min_pct": p >= min_pct}[mode]
    return with_centroid_distance(pct.where(keep).select(*keys, "left_id", "right_id", "percent"),
                                  primary, secondary, keys)


def relation_table(primary: DataFrame, pairs: DataFrame, keys: list[str], channel: str = "channel") -> DataFrame:
    """Long relations: one row per (primary object, marker channel) that has matches.

    ``pairs`` holds keys, left_id, right_id, channel, distance and optionally percent.
    The id, percentage and distance lists are ordered by marker id.  This is the
    nested view of one object's own partners; statistics work on the pairs.
    """
    pct = F.round("percent", 2) if "percent" in pairs.columns else F.lit(0.0)
    item = F.struct(F.col("right_id"), pct.alias("percent"), F.round("distance", 2).alias("distance"))
    g = pairs.groupBy(*keys, "left_id", channel).agg(
        F.count("*").alias("relation_count"), F.sort_array(F.collect_list(item)).alias("_m"))
    return (g.withColumn("marker_ids", F.col("_m.right_id")).withColumn("percent_overlaps", F.col("_m.percent"))
            .withColumn("distances", F.col("_m.distance")).drop("_m")
            .join(primary.select(*keys, F.col("id").alias("left_id"), *XY, "area"), [*keys, "left_id"]))


def nested_relations(primary: DataFrame, relations: DataFrame, keys: list[str],
                     channel: str = "channel") -> DataFrame:
    """One row per primary object with a map channel -> relation struct."""
    entry = F.struct(channel, F.struct("relation_count", "marker_ids", "percent_overlaps", "distances"))
    maps = relations.groupBy(*keys, F.col("left_id").alias("id")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("relations"))
    return primary.select(*keys, "id", *XY, "area").join(maps, [*keys, "id"], "left")


def relation_summary(primary: DataFrame, per_object: DataFrame, channels: DataFrame,
                     channel: str = "channel") -> DataFrame:
    """Per channel: objects with a relation, relations, mean per object, mean of best overlaps.

    ``per_object`` has channel, ``n`` partners and the ``best`` overlap percentage of
    each primary object with a partner (see :func:`overlaps_per_object` and :func:`counts_within`).
    """
    found = per_object.groupBy(channel).agg(
        F.count("*").alias("objects_with_relation"), F.sum("n").alias("total_relations"), F.avg("best").alias("_best"))
    n = primary.count()
    total = F.coalesce("total_relations", F.lit(0))
    return channels.join(found, channel, "left").select(
        channel, F.lit(n).cast("long").alias("total_objects"),
        F.coalesce("objects_with_relation", F.lit(0)).alias("objects_with_relation"),
        total.alias("total_relations"),
        (F.round(total / n, 3) if n else F.lit(0.0)).alias("mean_markers_per_object"),
        F.coalesce(F.round("_best", 2), F.lit(0.0)).alias("mean_max_overlap_pct"))


def overlaps_per_object(pairs: DataFrame, keys: list[str], channel: str = "channel") -> DataFrame:
    """Partners and best overlap percentage of every primary object with an overlap."""
    return pairs.groupBy(channel, *keys, "left_id").agg(
        F.count("*").alias("n"), F.max(F.round("percent", 2)).alias("best"))


def neighbours_per_object(primary: DataFrame, secondary: DataFrame, keys: list[str], limit: float,
                          channels: list[str]) -> DataFrame:
    """Partners within a distance for every primary object and channel; no overlap is measured."""
    each = primary.select(*keys, "id", *XY, F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"))
    n = counts_within(each, secondary, [*keys, "channel"], limit)
    return n.withColumnRenamed("id", "left_id").withColumn("best", F.lit(0.0))
