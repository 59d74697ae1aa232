"""Near-duplicate documents: many universal hash minima, banding, signatures, full sets, components.

1. Every document becomes the set of its word shingles (64-bit hashes), a signature of minima under
   multiply-shift hash functions, and the 128-bit hash of the set.  Documents of equal sets are one
   class, held by its smallest doc_id; only classes go on, so groups of copies cost one row.
2. Bands of the signatures give buckets.  Every member meets the smallest of its bucket (a star, not
   all pairs); pairs whose signatures may reach the threshold are confirmed on their full sets.
3. Buckets that still hold several components are compared in blocks across components, so that no
   link that joins components is lost; those links too are confirmed on the full sets.
4. Components come from alternating large-star and small-star.

With 32 bands of 4 minima a link of similarity 0.8 is missed by the buckets with probability 5e-8,
and by the signature test (``slack`` below the threshold) with less than that.

Null and empty texts have no shingles and link with nothing; a text with fewer words than a shingle
is one shingle.  Rows of equal sets are linked, repeated rows included.  A row without doc_id links
with nothing.  No rows give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.llm.common import _Slots, in_batches, lean, texts, written
from motes.llm.components import components

# A-Z to a-z, and odd multipliers of a public 64-bit mixer (splitmix64).
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes; words are lower-cased (A-Z) and split at ASCII white space."""

    def __init__(self, size: int, limit: int = 150_000):
        self.size, self.limit = size, limit
        self._clear()

    def _clear(self):
        self.slots, self.hashes = _Slots(), np.zeros(0, np.uint64)

    def __call__(self, docs: list[str]) -> list[np.ndarray]:
        from xxhash import xxh3_64_intdigest
        if len(self.slots) > self.limit:
            self._clear()
        get = self.slots.__getitem__
        per = []
        for t in docs:
            words = t.encode().translate(LOWER).split()
            per.append(np.fromiter(map(get, words), np.int64, len(words)))
        new, self.slots.new = self.slots.new, []
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxh3_64_intdigest, new), np.uint64, len(new))])
        out = []
        for slots in per:
            w = self.hashes[slots]
            n = min(self.size, len(w))
            if not n:
                out.append(w)
                continue
            h = np.full(len(w) - n + 1, np.uint64(n), np.uint64)
            for k in range(n):
                h = mix(h + w[k:len(w) - n + 1 + k])
            out.append(np.unique(h))
        return out


def hash_functions(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signatures (uint32) of non-empty sets: the high halves of the smallest a * x + b mod 2**64."""
    x = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), len(a)), np.uint32)
    t = np.empty_like(x)
    for k in range(len(a)):
        np.multiply(x, a[k], out=t)
        np.add(t, b[k], out=t)
        out[:, k] = np.minimum.reduceat(t, starts) >> np.uint64(32)
    return out


def signatures(docs: DataFrame, size: int, count: int) -> DataFrame:
    """doc_id, n_shingles, the hash of the set (null if empty) and the signature of every row."""
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest
        shingle, (a, b) = Shingler(size), hash_functions(count)
        for ids, found in in_batches(batches):
            sets = shingle(found)
            full = [k for k, s in enumerate(sets) if len(s)]
            sig = minima([sets[k] for k in full], a, b) if full else None
            sigs: list = [None] * len(sets)
            for row, k in enumerate(full):
                sigs[k] = sig[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set", "sig"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, n_shingles long, set binary, sig binary")


def band_rows(classes: DataFrame, bands: int) -> DataFrame:
    """(bucket, node): a row per class and band."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, bands, -1)
            h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2]).copy()
            for k in range(sig.shape[2]):
                h = mix(h * MIX[0] + sig[:, :, k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), bands)),
                 pa.array(np.tile(np.arange(bands, dtype=np.int32), batch.num_rows))], ["bucket", "node", "band"])

    return classes.select("node", "sig").mapInArrow(lean(run), "bucket long, node long, band int")


def agreeing(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least that share of their minima."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= least))

    return pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(
        sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(
        lean(run), "a long, b long")


def held(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, body): the texts of the documents that are compared.  Texts travel in less room than sets."""
    return written(texts(docs).join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(
        F.col("doc_id").alias("node"), F.col("text").alias("body")))


def confirmed(pairs: DataFrame, bodies: DataFrame, size: int, threshold: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= threshold * union."""
    def run(batches):
        import pyarrow as pa
        shingle = Shingler(size)
        for batch in batches:
            keep = []
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for p, q in zip(shingle(part.column(2).to_pylist()), shingle(part.column(3).to_pylist())):
                    small, large = (p, q) if len(p) < len(q) else (q, p)
                    at = np.searchsorted(large, small)
                    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
                    keep.append(100 * both >= threshold * (len(p) + len(q) - both))
            if batch.num_rows:
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a").join(
        bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(
        lean(run), "a long, b long")


def dealt_blocks(bands: DataFrame, found: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Members of the buckets that hold several components, dealt into pairs of blocks (bucket, i, j).

    ``own`` is the block of the member.  A pair of blocks has at most about two blocks of rows.
    """
    labelled = written(bands.join(found.withColumnRenamed("component", "c"), "node", "left").select(
        "bucket", "node", "band", F.coalesce("c", "node").alias("component")))
    mixed = written(labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                                   F.count("*").alias("n")).where("lo != hi").select("bucket", "n"))
    rows = labelled.join(mixed, "bucket").join(classes.select("node", "sig"), "node")
    return rows.withColumn("blocks", F.expr(f"cast(ceil(n / {block}.0) as int)")).withColumn(
        "own", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).withColumn(
        "other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component",
        "band", "sig")


def across(bands: DataFrame, found: DataFrame, classes: DataFrame, docs: DataFrame, n_bands: int, least: float, block: int,
           size: int, threshold: int) -> DataFrame:
    """Confirmed links between different components of one bucket, enough of them to join the components.

    Signatures tell which members of a pair of blocks may have a link across components; the texts
    of those alone are brought to the pair of blocks and compared on their full sets.
    """
    def may_link(pdf):
        sig = np.frombuffer(b"".join(pdf.sig), np.uint32).reshape(len(pdf), -1)
        comp, side = pdf.component.to_numpy(), pdf.own.to_numpy()
        band, i, j = int(pdf.band.iloc[0]), int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        width, some = sig.shape[1] // n_bands, np.zeros(len(pdf), bool)
        # Low bytes agree wherever minima do, and are quick to count; hits are counted again in full.
        low = sig.astype(np.uint8)
        columns, enough = np.ascontiguousarray(low[right].T), least * sig.shape[1]
        for k in left:
            other = (comp[right] != comp[k]) & ((right > k) if i == j else True)
            if not other.any() or some[k] and some[right[other]].all():
                continue
            same = np.add.reduce((columns == low[k][:, None]).view(np.uint8), axis=0, dtype=np.uint16)
            hit = right[other & (same >= enough)]
            hit = hit[(sig[hit] == sig[k]).sum(axis=1) >= enough]
            # A pair that meets in several bands is looked at in the first of them.
            if len(hit):
                first = (sig[hit].reshape(len(hit), n_bands, width) == sig[k].reshape(n_bands, width)).all(axis=2).argmax(axis=1)
                hit = hit[first == band]
                some[hit] = True
                some[k] |= len(hit) > 0
        return pdf.loc[some, ["bucket", "i", "j", "own", "node", "component"]]

    def links(pdf):
        import pandas as pd
        pdf = pdf.sort_values("node", kind="stable", ignore_index=True)
        sets = Shingler(size)(pdf.body.tolist())
        node, side = pdf.node.to_numpy(), pdf.own.to_numpy()
        i, j = int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
        label = np.unique(pdf.component.to_numpy(), return_inverse=True)[1]
        right = np.flatnonzero(side == j)
        words, ids = np.unique(np.concatenate(sets), return_inverse=True)
        edge = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        count = np.diff(edge)
        there = np.concatenate([ids[edge[k]:edge[k + 1]] for k in right]) if len(right) else ids[:0]
        starts = np.concatenate([[0], np.cumsum(count[right])])[:-1]
        out, mark = [], np.zeros(len(words), bool)
        for k in np.flatnonzero(side == i):
            if not len(right) or (label[right] == label[k]).all():
                continue
            own = ids[edge[k]:edge[k + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[there], starts, dtype=np.int64)
            mark[own] = False
            for r in right[100 * both >= threshold * (count[right] + count[k] - both)]:
                if label[r] != label[k]:
                    out.append((min(node[k], node[r]), max(node[k], node[r])))
                    label[label == label[r]] = label[k]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    key = "bucket long, i int, j int, own int, node long, component long"
    some = written(dealt_blocks(bands, found, classes, block).groupBy("bucket", "i", "j").applyInPandas(may_link, key))
    if some.isEmpty():
        return some.select(F.col("node").alias("a"), F.col("node").alias("b"))
    return some.join(held(docs, some), "node").groupBy("bucket", "i", "j").applyInPandas(links, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80, bands: int = 32, rows: int = 4,
                    slack: float = 0.2, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id) and kept, for every row of ``docs``.

    ``threshold``: similarity in hundredths.  ``slack``: how far a signature may lie below it.
    """
    least = threshold / 100 - slack
    sigs = written(signatures(docs, size, bands * rows))
    # The smallest row of a set is found map-side, so a set that a third of all rows share is no hot key.
    classes = written(sigs.where("set is not null and doc_id is not null").groupBy("set").agg(
        F.min(F.struct("doc_id", "sig")).alias("one")).select("set", F.col("one.doc_id").alias("node"), "one.sig"))
    banded = written(band_rows(classes, bands))
    low = written(banded.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("bucket", "a"))
    shared = banded.join(low, "bucket")
    stars = written(agreeing(shared.where("a != node").select("a", F.col("node").alias("b")).distinct(), classes, least))
    nodes = stars.select(F.col("a").alias("node")).union(stars.select(F.col("b").alias("node")))
    links = written(confirmed(stars, held(docs, nodes), size, threshold))
    found = components(links)
    more = written(across(banded.join(low, "bucket", "left_semi"), found, classes, docs, bands, least, block, size, threshold))
    if not more.isEmpty():
        found = components(links.union(more))
    labels = written(classes.select("set", "node").join(found, "node", "left").select(
        "set", F.coalesce("component", "node").alias("component")))
    full = sigs.where("set is not null and doc_id is not null").select("doc_id", "n_shingles", "set").join(labels, "set")
    alone = sigs.where("set is null or doc_id is null")
    return full.select("doc_id", "n_shingles", F.col("component").alias("component_id")).union(
        alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)).alias("kept"))
