"""Ranks, running totals and exact quantiles that never put a group in one task.

A window over ``(marker)`` sorts a whole marker in one task.  Here every group
is cut into value pieces first.  The piece of a row depends on its value alone,
so equal values meet in one piece; a small table of piece totals gives each
piece its offset and the window only has to sort inside a piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motes.session import saved, small_side, written_side

PIECES = 64
#: Rows one piece should not exceed; larger groups are cut again inside their pieces.
PIECE_ROWS = 4_000_000


def with_pieces(df: DataFrame, keys: list[str], value: str, pieces: int = PIECES,
                edge_keys: list[str] | None = None) -> DataFrame:
    """Add ``_piece``: how many of the group's approximate quantiles lie below the value.

    The edges need not be exact, any edges give a correct (if less even) split.
    A group whose pieces would still be large is cut a second time, and so on.
    ``edge_keys`` may name fewer keys than the later window uses.
    """
    by = keys if edge_keys is None else edge_keys
    probs = [i / pieces for i in range(1, pieces)]

    def place(lo: int, hi: int) -> Column:
        """Binary search over the edges as one expression, which Spark compiles."""
        if lo == hi:
            return F.lit(lo).cast("long")
        mid = (lo + hi) // 2
        return F.when(F.col(value) > F.get("_edges", mid), place(mid + 1, hi)).otherwise(place(lo, mid))

    out, level, last = df, list(by), None
    while True:
        edges = small_side(out.groupBy(*level).agg(
            F.count(value).alias("_n"), F.percentile_approx(value, probs, 1000).alias("_edges")), 20_000)
        most = edges.agg(F.max("_n")).first()[0] or 0
        found = out.join(edges, level, "left") if level else out.join(edges, F.lit(True), "left")
        piece = place(0, pieces - 1)
        out = found.withColumn("_piece", F.col("_piece") * pieces + piece if last is not None else piece)
        out = out.drop("_edges", "_n")
        # equal values cannot be parted, so stop once cutting no longer helps
        if most / pieces <= PIECE_ROWS or (last is not None and most > last / 2):
            return out
        level, last = [*by, "_piece"], most


def piece_offsets(df: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Per (keys, _piece): total weight ``_in`` and the weight of all earlier pieces ``_before``."""
    totals = df.groupBy(*keys, "_piece").agg(F.sum(weight).alias("_in"))
    w = Window.partitionBy(*keys).orderBy("_piece")
    return totals.withColumn(
        "_before",
        F.coalesce(F.sum("_in").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )


def running_total(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Add ``out``: weight of the group's rows with a value up to and including this one.

    Expects ``_piece`` from :func:`with_pieces`.
    """
    offsets = small_side(piece_offsets(df, keys, F.col(weight)).drop("_in"))
    inside = (Window.partitionBy(*keys, "_piece").orderBy(value)
              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (df.join(offsets, [*keys, "_piece"])
            .withColumn(out, F.col("_before") + F.sum(weight).over(inside))
            .drop("_before"))


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Collapse equal values: one row per (keys, value) with ``n``.  Missing values go."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def average_ranks(df: DataFrame, keys: list[str], value: str, within: list[str] = []) -> DataFrame:
    """Tie-shared ranks of ``value`` inside ``keys``.

    Returns one row per (keys, within, value) with its count ``n``, the number of
    ties ``ties`` in the whole group and the shared rank ``rank``.
    """
    counted = with_pieces(value_counts(df, keys + within, value), keys, value)
    tie = Window.partitionBy(*keys, "_piece", value)
    ranked = running_total(counted, keys, value, "n", "_upto").withColumn("ties", F.sum("n").over(tie))
    return (ranked.withColumn("rank", F.col("_upto") - (F.col("ties") - 1) / 2)
            .drop("_upto", "_piece"))


def row_numbers(df: DataFrame, keys: list[str], order: str, out: str = "row_number",
                hot: int = 200_000) -> DataFrame:
    """``row_number()`` by ``order``, also for groups too big for one task; equal values get
    numbers of their own, in any order among themselves.

    Ordinary groups use one window.  Groups above ``hot`` rows are cut into
    pieces; without such groups the second plan is not built at all.
    """
    plain = Window.partitionBy(*keys).orderBy(order)
    big = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).drop("_n")
    if big.isEmpty():
        return df.withColumn(out, F.row_number().over(plain).cast("long"))
    big = small_side(big)
    rest = df.join(big, keys, "left_anti").withColumn(out, F.row_number().over(plain).cast("long"))
    heavy = with_pieces(df.join(big, keys, "left_semi"), keys, order).withColumn("_one", F.lit(1))
    # The total up to a value counts all rows that share it; each of them takes its place among those.
    same = Window.partitionBy(*keys, "_piece", order)
    heavy = running_total(heavy, keys, order, "_one", "_upto").withColumn(
        out, (F.col("_upto") - F.count("*").over(same) + F.row_number().over(same.orderBy(order))).cast("long"))
    return rest.unionByName(heavy.select(*rest.columns))


#: percentile_approx accuracy and the margin around a quantile that is searched exactly.
ACCURACY = 2000
MARGIN = 3.0 / ACCURACY


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    discrete: bool = False) -> DataFrame:
    """Exact quantiles per group, linearly interpolated, one output column per entry of ``probs``.

    An approximate pass brackets every quantile; a second pass counts what lies below
    and inside each bracket; only values inside a bracket are shuffled and sorted.
    A bracket that turns out to miss its rank is opened to the whole group.  With
    ``discrete`` the value at rank ``floor(n * p)`` is taken.  Groups without any value
    are absent from the result.
    """
    names, ps = list(probs), [float(p) for p in probs.values()]
    key = keys or ["_all"]
    clean = df.where(F.col(value).isNotNull())
    clean = clean.select(*keys, value) if keys else clean.select(F.lit(1).alias("_all"), value)
    sides = [x for p in ps for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    near = written_side(clean.groupBy(*key).agg(F.percentile_approx(value, sides, ACCURACY).alias("_b")))
    v = F.col(value)
    cut = clean.join(near, key)
    low = [F.get("_b", 2 * i) for i in range(len(ps))]
    high = [F.get("_b", 2 * i + 1) for i in range(len(ps))]
    # the ends as numbers of their own: with an array among its results Spark sorts all rows to aggregate them
    counted = cut.groupBy(*key).agg(
        F.count("*").alias("_n"), *[F.first(low[i]).alias(f"_l{i}") for i in range(len(ps))],
        *[F.first(high[i]).alias(f"_h{i}") for i in range(len(ps))],
        *[F.count_if(v < low[i]).alias(f"_u{i}") for i in range(len(ps))],
        *[F.count_if(v.between(low[i], high[i])).alias(f"_i{i}") for i in range(len(ps))])

    def bracket(i: int) -> Column:
        n = F.col("_n")
        pos = F.least(F.floor(n * ps[i]), n - 1).cast("double") if discrete else (n - 1) * F.lit(ps[i])
        first, last = F.floor(pos), F.ceil(pos)
        hit = (first >= F.col(f"_u{i}")) & (last < F.col(f"_u{i}") + F.col(f"_i{i}"))
        return F.struct(
            F.lit(i).alias("i"), pos.alias("pos"), F.when(hit, F.col(f"_l{i}")).alias("low"), F.when(hit, F.col(f"_h{i}")).alias("high"),
            F.when(hit, F.col(f"_u{i}")).otherwise(F.lit(0)).alias("under"),
            F.when(hit, F.col(f"_i{i}")).otherwise(n).alias("opened"))
    # rows of the fullest bracket, all of a group where one misses
    most = F.array_max(F.transform("_k", lambda k: k["opened"]))
    table = written_side(counted.select(*key, F.array(*[bracket(i) for i in range(len(ps))]).alias("_k")).withColumn("_most", most))

    # a row goes to every bracket it lies in; almost all rows lie in none
    inside = F.filter("_k", lambda k: k["low"].isNull() | v.between(k["low"], k["high"]))
    rough = F.lit(False)
    for i in range(len(ps)):
        k = F.get("_k", i)
        rough = rough | k["low"].isNull() | v.between(k["low"], k["high"])
    picked = clean.join(table, key).where(rough).select(*key, value, F.explode(inside).alias("_q"))
    values = picked.groupBy(*key, "_q", value).agg(F.count("*").alias("_c"))
    pos = F.col("_q.pos")
    crowded = (table.agg(F.max("_most")).first()[0] or 0) > PIECE_ROWS
    if crowded:
        # many rows may be few values; they are counted once
        values = saved(values)
    if crowded and values.count() > PIECE_ROWS:
        at = running_total(with_pieces(values, [*key, "_q"], value), [*key, "_q"], value, "_c", "_upto")
        at = at.withColumn("_upto", F.col("_upto") + F.col("_q.under"))
    else:
        upto = F.sum("_c").over(Window.partitionBy(*key, "_q").orderBy(value)) + F.col("_q.under")
        at = values.withColumn("_upto", upto)

    def covers(r: Column) -> Column:
        return (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_c"))
    share = F.when(covers(F.floor(pos)), 1 - (pos - F.floor(pos))).otherwise(0.0) \
        + F.when(covers(F.ceil(pos)) & (F.ceil(pos) > F.floor(pos)), pos - F.floor(pos)).otherwise(0.0)
    got = at.withColumn("_share", share).where(F.col("_share") > 0)
    out = got.groupBy(*key).agg(*[
        F.sum(F.when(F.col("_q.i") == i, v * F.col("_share"))).alias(n) for i, n in enumerate(names)])
    return out if keys else out.drop("_all")


def carried(df: DataFrame, keys: list[str], order: str, value: str, out: str, include_self: bool) -> DataFrame:
    """Add the last known ``value`` before each row (or up to it) in the group's order.

    Like ``last(value, ignoreNulls)`` over the whole group, but a group is cut into
    pieces of the order column; what a piece ends with is handed to the next ones.
    """
    cut = with_pieces(df, keys, order)
    ends = cut.groupBy(*keys, "_piece").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = small_side(ends.withColumn("_carry", F.last("_end", True).over(before)).drop("_end"))
    inside = (Window.partitionBy(*keys, "_piece").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, 0 if include_self else -1))
    return (cut.join(ends, [*keys, "_piece"])
            .withColumn(out, F.coalesce(F.last(value, True).over(inside), F.col("_carry"))).drop("_piece", "_carry"))
