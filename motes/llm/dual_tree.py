"""Vector codes by exact integer Lloyd rounds on two trees.

Vectors are cut into equal consecutive parts; each part position has a codebook.  Components are the
integers ``floor(scale * x)``, so all distances, sums and means are exact and neither the order of
rows nor their partitioning matters.

Method: the rows of a chunk are put in one tree per part position (median cuts along the widest
side), with the bounds and the sum of every node, once.  In each round the entries get trees too.
Pairs of nodes go down both trees together: an entry node whose least distance to a point node is
larger than the largest distance of another entry node there is dropped; a point node with one
entry left is assigned as a whole, by its cached sum; the points of leaves that stay uncertain are
compared in integers.  Tasks send a sum per entry and component, so what moves does not grow with
the rows.  Codebooks have a size fixed by the parameters and are all the driver holds.

Vectors that are null, empty or hold null or non-finite components take no part, nor do those of
another length than most (of equally frequent lengths the smallest counts); a length that the parts
do not divide is filled up with zeros.  Rows with equal or null ids are rows of their own (a null id
comes last where the first entries are chosen, equal ids by their vectors).  With fewer rows than
entries there are as many entries as rows.  Other columns are left out; an empty table gives no rows
and empty codebooks.  Components so large that a squared distance leaves 64 bits are refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.llm.common import ragged, written

#: Points of a leaf, and components of a chunk of rows.
LEAF, CHUNK = 16, 1 << 19
#: Labels whose totals are sent to every executor.
FEW = 100_000


class Trees:
    """A balanced tree over the points of each part: level l has 2^l nodes, cut at equal ranks."""

    def __init__(self, x: np.ndarray, leaf: int, order: np.ndarray | None = None):
        parts, n, dims = x.shape
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        self.cuts = [np.arange((1 << lv) + 1) * n >> lv for lv in range(self.depth + 1)]
        known = order is not None
        if not known:
            order = np.tile(np.arange(n), (parts, 1))
        for lv in range(0 if known else self.depth):
            cuts = self.cuts[lv]
            node = np.repeat(np.arange(1 << lv), np.diff(cuts))
            now = np.take_along_axis(x, order[:, :, None], 1)
            lo, hi = self._ends(now, cuts)
            wide = np.argmax(hi - lo, 2)
            value = np.take_along_axis(now, wide[:, node][:, :, None], 2)[:, :, 0]
            by = np.lexsort((value, np.broadcast_to(node, value.shape)), axis=1)
            order = np.take_along_axis(order, by, 1)
        now = np.take_along_axis(x, order[:, :, None], 1)
        self.order, self.lo, self.hi, self.sums = order, [], [], []
        total = np.concatenate([np.zeros((parts, 1, dims), np.int64), np.cumsum(now, 1)], 1)
        for cuts in self.cuts:
            lo, hi = self._ends(now, cuts)
            self.lo.append(lo)
            self.hi.append(hi)
            self.sums.append(np.diff(total[:, cuts], axis=1))

    @staticmethod
    def _ends(now: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of every node; those of an empty one mean nothing."""
        at = np.minimum(cuts[:-1], max(0, now.shape[1] - 1))
        return np.minimum.reduceat(now, at, 1), np.maximum.reduceat(now, at, 1)


def walk(points: Trees, x: np.ndarray, entries: Trees, books: np.ndarray, whole, single) -> None:
    """Goes down both trees.  ``whole(part, level, node, entry)`` gets point nodes that are assigned as one,
    ``single(part, point, entry, squared distance)`` the points of uncertain leaves."""
    parts = x.shape[0]
    p, e = (np.zeros(parts, np.int64) for _ in range(2))
    part = np.arange(parts)
    for step in range(max(points.depth, entries.depth) + 1):
        pl, el = min(step, points.depth), min(step, entries.depth)
        if step and step <= points.depth:
            part, p, e = np.repeat(part, 2), np.repeat(p, 2) * 2 + np.tile([0, 1], len(p)), np.repeat(e, 2)
        if step and step <= entries.depth:
            part, p, e = np.repeat(part, 2), np.repeat(p, 2), np.repeat(e, 2) * 2 + np.tile([0, 1], len(e))
        size_p, size_e = np.diff(points.cuts[pl])[p], np.diff(entries.cuts[el])[e]
        ok = (size_p > 0) & (size_e > 0)
        part, p, e = part[ok], p[ok], e[ok]
        order = np.lexsort((e, p, part))
        part, p, e = part[order], p[order], e[order]
        if not len(p):
            return
        plo, phi, elo, ehi = points.lo[pl][part, p], points.hi[pl][part, p], entries.lo[el][part, e], entries.hi[el][part, e]
        gap = np.maximum(0, np.maximum(plo - ehi, elo - phi))
        far = np.maximum(phi - elo, ehi - plo)
        least, most = (gap * gap).sum(1), (far * far).sum(1)
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (p[1:] != p[:-1])]))
        bound = np.repeat(np.minimum.reduceat(most, first), np.diff(np.append(first, len(p))))
        keep = least <= bound
        part, p, e = part[keep], p[keep], e[keep]
        first = np.concatenate([[True], (part[1:] != part[:-1]) | (p[1:] != p[:-1])])
        alone = first & np.append(first[1:], True) & (np.diff(entries.cuts[el])[e] == 1)
        if alone.any():
            whole(part[alone], pl, p[alone], entries.order[part[alone], entries.cuts[el][e[alone]]])
            part, p, e = part[~alone], p[~alone], e[~alone]
    # uncertain leaves: every point against the entries left, ties to the smaller entry
    entry = entries.order[part, entries.cuts[-1][e]]
    order = np.lexsort((entry, p, part))
    part, p, entry = part[order], p[order], entry[order]
    size = np.diff(points.cuts[-1])[p]
    edge = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (p[1:] != p[:-1])])) if len(p) else np.zeros(0, int)
    load = np.cumsum(size)
    at = 0
    while at < len(edge):  # leaves by the piece
        base = load[edge[at] - 1] if edge[at] else 0
        to = at + 1
        while to < len(edge) and load[edge[to] - 1] - base < 1 << 18:
            to += 1
        a, b = edge[at], edge[to] if to < len(edge) else len(p)
        count = np.diff(np.append(edge[at:to], b))
        leaf_part, leaf_node = part[edge[at:to]], p[edge[at:to]]
        n = np.diff(points.cuts[-1])[leaf_node]
        # a row per point of each leaf, with a stretch of candidates each
        own = np.repeat(np.arange(to - at), n)
        where = ragged(points.cuts[-1][leaf_node], n)
        point = points.order[leaf_part[own], where]
        cand = ragged(edge[at:to][own], count[own])
        row = np.repeat(np.arange(len(own)), count[own])
        diff = x[leaf_part[own][row], point[row]] - books[part[cand], entry[cand]]
        d = (diff * diff).sum(1)
        begin = np.cumsum(count[own]) - count[own]
        best = np.minimum.reduceat(d, begin)
        hit = np.flatnonzero(d == best[row])
        winner = hit[np.concatenate([[True], row[hit[1:]] != row[hit[:-1]]])]
        single(leaf_part[own], point, entry[cand[winner]], best)
        at = to


def usable(vectors: DataFrame, key: str, vector: str, label: str, parts: int, scale: int) -> DataFrame:
    """id, label and the integer components of the rows that take part."""
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    v = v.where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    most = v.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")) \
        .orderBy(F.desc("rows"), "n").first()
    n = most["n"] if most else 0
    if most and n * (2.0 * (scale * most["top"] + 1)) ** 2 >= 2.0 ** 63:
        raise ValueError("components too large: squared distances would leave 64 bits")
    fill = F.array_repeat(F.lit(0).cast("long"), -n % parts)
    return v.where(F.size("v") == n).select("vec_id", "label", F.concat(F.transform("v", lambda x: F.floor(x * scale).cast("long")), fill).alias("v"))


def chunked(rows: DataFrame, parts: int, dims: int) -> DataFrame:
    """The rows of each task in chunks of bounded size: ids, labels, integers as bytes."""
    most = max(64, CHUNK // max(1, dims))
    label = rows.schema["label"].dataType.simpleString()

    def pack(batches):
        import pyarrow as pa
        held, count = [], 0

        def out(n):
            table = pa.Table.from_batches(held).slice(0, n).combine_chunks()
            ids, labels, v = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
            x = v.flatten().to_numpy(zero_copy_only=False).astype("<i8")
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), a) for a in (ids, labels)]
                                              + [pa.array([x.tobytes()], pa.binary())], names=["ids", "labels", "x"])
        for b in batches:
            held.append(b)
            count += b.num_rows
            while count >= most:
                yield out(most)
                rest = pa.Table.from_batches(held).slice(most)
                held, count = rest.to_batches(), count - most
        if count:
            yield out(count)
    return written(rows.mapInArrow(pack, f"ids array<bigint>, labels array<{label}>, x binary"))


def unpacked(x: bytes, parts: int, dims: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, "<i8").reshape(-1, parts, dims // parts).transpose(1, 0, 2))


def with_trees(chunks: DataFrame, parts: int, dims: int) -> DataFrame:
    """The chunks with the order of the points in their trees, from which a round reads bounds and sums off."""
    def grow(batches):
        import pyarrow as pa
        for b in batches:
            made = [Trees(unpacked(x, parts, dims), LEAF).order.astype("<i4").tobytes() for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*b.schema.names, "places"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return written(chunks.mapInArrow(grow, f"{schema}, places binary"))


def grown_again(x: bytes, places: bytes, parts: int, dims: int) -> tuple[np.ndarray, Trees]:
    x = unpacked(x, parts, dims)
    return x, Trees(x, LEAF, np.frombuffer(places, "<i4").reshape(parts, -1))


def totals(grown: DataFrame, books: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the points nearest to each entry."""
    parts, k, width = books.shape
    near = grown.sparkSession.sparkContext.broadcast(books)

    def assign(batches):
        import pyarrow as pa
        books = near.value
        entries = Trees(books, 1)
        sums, counts = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for b in batches:
            for made in zip(b.column("x").to_pylist(), b.column("places").to_pylist()):
                x, tree = grown_again(*made, parts, dims)

                def whole(part, level, node, entry):
                    np.add.at(sums, part * k + entry, tree.sums[level][part, node])
                    np.add.at(counts, part * k + entry, np.diff(tree.cuts[level])[node])

                def single(part, point, entry, d):
                    np.add.at(sums, part * k + entry, x[part, point])
                    np.add.at(counts, part * k + entry, 1)
                walk(tree, x, entries, books, whole, single)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
                                          pa.array(sums[used].reshape(-1)), pa.array(np.repeat(counts[used], width))], names=["slot", "at", "total", "n"])
    rows = grown.select("x", "places").mapInArrow(assign, "slot int, at int, total long, n long") \
        .groupBy("slot", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    sums, counts = np.zeros((parts * k, width), object), np.zeros(parts * k, np.int64)
    for r in rows:  # as many as the codebooks have components
        sums[r["slot"], r["at"]], counts[r["slot"]] = int(r["total"]), r["n"]
    return sums.reshape(parts, k, width), counts.reshape(parts, k)


def coded(grown: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """vec_id, label, codes (an entry per part) and error (squared distances summed over the parts)."""
    parts, k, _ = books.shape
    near = grown.sparkSession.sparkContext.broadcast(books)
    label = grown.schema["labels"].dataType.elementType.simpleString()

    def assign(batches):
        import pyarrow as pa
        books = near.value
        entries = Trees(books, 1)
        for b in batches:
            for i in range(b.num_rows):
                x, tree = grown_again(b.column("x")[i].as_py(), b.column("places")[i].as_py(), parts, dims)
                code = np.zeros(x.shape[:2], np.int32)

                def whole(part, level, node, entry):
                    n = np.diff(tree.cuts[level])[node]
                    own = np.repeat(np.arange(len(node)), n)
                    code[part[own], tree.order[part[own], ragged(tree.cuts[level][node], n)]] = entry[own]

                def single(part, point, entry, d):
                    code[part, point] = entry
                walk(tree, x, entries, books, whole, single)
                diff = x - books[np.arange(parts)[:, None], code]
                error = (diff * diff).sum(axis=(0, 2))
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, parts, dtype=np.int32)), pa.array(code.T.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, codes, pa.array(error)],
                                                 names=["vec_id", "label", "codes", "error"])
    return grown.select("ids", "labels", "x", "places").mapInArrow(assign, f"vec_id long, label {label}, codes array<int>, error long")


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id",
               vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable rows (see :func:`coded`), written, and the codebooks [part, entry, component].

    Entries start as the parts of the rows with the smallest ids.  An entry that no part is nearest
    to stays as it is; ties go to the entry of the smaller number.
    """
    rows = written(usable(vectors, key, vector, label, parts, scale))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    dims = len(first[0]["v"]) if first else parts
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    if not first:
        kind = rows.schema["label"].dataType.simpleString()
        return rows.select("vec_id", "label").selectExpr("vec_id", f"cast(label as {kind}) as label", "array() as codes", "0L as error"), books
    grown = with_trees(chunked(rows, parts, dims), parts, dims)
    for _ in range(rounds):
        sums, counts = totals(grown, books, dims)
        for p, e in zip(*np.nonzero(counts)):
            books[p, e] = [s // int(counts[p, e]) for s in sums[p, e]]
    return written(coded(grown, books, dims)), books


def digests(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code in hex, error, the error of all rows of the label, and a checksum of the codebooks."""
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    per = codes.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    if per.limit(FEW + 1).count() <= FEW:
        per = F.broadcast(per)
    text = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codes.join(per, F.col("label").eqNullSafe(F.col("l"))).select(
        "vec_id", text.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
