"""Repeated byte strings by run-compressed Burrows-Wheeler indexes over content-dealt shards.

A byte is removed if it is covered by a string of ``length`` bytes that also starts at another
place, in the same text or another one.  One index over a whole corpus does not fit a machine, so
the index is cut by content:

1. Every window of ``length`` bytes is filed under its smallest k-mer hash (leftmost on ties), which
   depends on the window alone.  Consecutive windows with the same smallest k-mer are one piece; a
   piece of n starts has n + length - 1 bytes.  Equal windows always meet under the same key.
2. Equal pieces under a key are one class, counted before anything is moved.  A class met twice is a
   repeat as a whole; a key with one piece holds no repeat.  Only keys with several classes, one of
   them met once, are open, and only one copy of each of their classes is fetched.
3. The open classes of many keys are joined into texts of bounded size, and each gets a run-length
   index: the suffix array by prefix doubling, the Burrows-Wheeler transform in runs, and the text
   places on both sides of every run border (the sampled run ends) with their common prefix.  Inside
   a run a match is the match one byte earlier, less one; so one stream over the text, from the
   samples, gives the matching statistics of all places, and the long ones are marked.
4. A key with more than ``hot`` classes is cut further, under longer k-mers, in the last step under
   the whole window, where counting alone decides.  No group outgrows a task.

Marks are joined back to all copies.  Matches never cross texts.  Null and empty texts have no
bytes; repeated rows repeat each other; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.llm.common import lean, reserved, written
from motes.llm.minhash import MIX

POSITION = np.uint64((1 << 24) - 1)
SEGMENT = 1_000_000
#: Bits of the length of an index; one of this length and its tables hold about 50 MB.
INDEX_BITS = 19
PIECES = "r1 long, r2 long, key long, body long, start int, n int"


def kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at every place, by doubling."""
    table = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)
    power, done, out = table[data], 0, None
    size = 1
    while True:
        if k & size:
            if out is None:
                out = power
            else:
                n = len(data) - done - size + 1
                out = (out[:n] ^ (out[:n] >> np.uint64(31))) * MIX[1] + power[done:done + n]
            done += size
        size *= 2
        if size > k:
            break
        n = max(0, len(power) - size // 2)
        step = power[:n] * MIX[0]
        step ^= step >> np.uint64(29)
        step += power[size // 2:size // 2 + n]
        step *= MIX[1]
        power = step
    return out ^ (out >> np.uint64(32))


def leftmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` hashes the place of the smallest (by its high bits, then leftmost)."""
    p = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
    size, n = 1, len(h) - width + 1
    while size * 2 <= width:
        p = np.minimum(p[:len(p) - size], p[size:])
        size *= 2
    return (np.minimum(p[:n], p[width - size:width - size + n]) & POSITION).astype(np.int64)


def cut(texts: list[bytes], length: int, k: int):
    """Pieces of the texts: (text, start, starts in the piece, key, hash of its bytes)."""
    from xxhash import xxh3_64_intdigest
    raw = b"".join(texts)
    if len(raw) < length:
        return []
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(t) for t in texts])
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    h = kmer_hashes(data, k)
    at = leftmost_minimum(h, length - k + 1)
    n = len(at)
    whole = owner[:n] == owner[length - 1:length - 1 + n]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:n] != owner[:n - 1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    ok = whole[first]
    first, count = first[ok], count[ok]
    own = owner[first]
    body = [xxh3_64_intdigest(raw[s:s + c + length - 1]) for s, c in zip(first.tolist(), count.tolist())]
    return own, first - base[own], count, h[at[first]].view(np.int64), np.array(body, np.uint64).view(np.int64)


def pieces(src: DataFrame, length: int, k: int) -> DataFrame:
    """The pieces of all texts; long texts go in segments that overlap by a window."""
    def run(batches):
        import pyarrow as pa

        def out(held):
            got = cut([h[3] for h in held], length, k)
            if not len(got):
                return
            own, start, n, key, body = got
            r1, r2, base = (np.array([h[i] for h in held], np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(r1[own]), pa.array(r2[own]), pa.array(key), pa.array(body),
                 pa.array((base[own] + start).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["r1", "r2", "key", "body", "start", "n"])

        held, size = [], 0
        for b in batches:
            for r1, r2, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                t = t.as_buffer().to_pybytes()
                for at in range(0, max(1, len(t) - length + 1), SEGMENT):
                    held.append((r1, r2, at, t[at:at + SEGMENT + length - 1]))
                    size += len(held[-1][3])
                    if size >= SEGMENT:
                        yield from out(held)
                        held, size = [], 0
        if held:
            yield from out(held)

    return src.select("r1", "r2", "body").mapInArrow(lean(run), PIECES)


def fetch(src: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of one copy of each wanted class."""
    lists = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct("key", "class", "classes", "met", "start", "n")).alias("want"))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for t, want in zip(b.column(0), b.column(1).to_pylist()):
                t = t.as_buffer()
                cols = list(zip(*[(w["key"], w["class"], w["classes"], w["met"],
                                   t.slice(w["start"], w["n"] + length - 1).to_pybytes()) for w in want]))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary())],
                                                 ["key", "class", "classes", "met", "body"])

    return src.select("r1", "r2", "body").join(lists, ["r1", "r2"]).select("body", "want").mapInArrow(
        lean(run), "key long, class long, classes long, met long, body binary")


class RunIndex:
    """Run-length Burrows-Wheeler index of texts with separators, and their matching statistics.

    ``order`` is the suffix array, ``border`` the first place of every run of the transform (but the
    first run); the suffixes on both sides of a border are the sampled run ends.
    """

    def __init__(self, texts: list[bytes]):
        m = len(texts)
        sizes = np.array([len(t) for t in texts])
        self.n = n = int(sizes.sum()) + m
        ends = np.cumsum(sizes + 1) - 1
        self.starts = ends - sizes
        symbol = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbol[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + m
        symbol[ends] = np.arange(m)
        self.symbol = symbol
        bits = int(n).bit_length()
        width = int(m + 256).bit_length()
        if 3 * width + bits > 63 or 3 * bits > 63:
            raise ValueError("too much text for one index")

        def shifted(x, d):
            return np.concatenate([x[d:], np.full(d, x[-1])]) if d < n else np.full(n, x[-1])

        key = (symbol << 2 * width) | (shifted(symbol, 1) << width) | shifted(symbol, 2)
        self.levels, depth = [], 3
        while True:
            s = np.sort((key << bits) | np.arange(n))
            order = s & ((1 << bits) - 1)
            s >>= bits
            step = np.empty(n, np.int64)
            step[0] = 0
            step[1:] = s[1:] != s[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            self.levels.append((depth, rank.astype(np.int32)))
            if step.sum() == n - 1:
                break
            key = (rank << bits) | shifted(rank, depth)
            depth *= 2
        self.order = order
        before = symbol[order - 1]
        self.border = np.flatnonzero(before[1:] != before[:-1]) + 1

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for depth, rank in reversed(self.levels):
            same = rank[np.minimum(a + out, self.n - 1)] == rank[np.minimum(b + out, self.n - 1)]
            out[same] += depth
        for _ in range(2):
            same = self.symbol[np.minimum(a + out, self.n - 1)] == self.symbol[np.minimum(b + out, self.n - 1)]
            out[same] += 1
        return out

    def matching_statistics(self) -> np.ndarray:
        """Length of the longest match of every place with another place."""
        a, b = self.order[self.border - 1], self.order[self.border]
        far = self.common_prefix(a, b)
        sampled = np.zeros(self.n, np.int64)
        np.maximum.at(sampled, a, far)
        np.maximum.at(sampled, b, far)
        place = np.arange(self.n)
        return np.maximum.accumulate(sampled + place) - place


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def indexed(strings: DataFrame, length: int) -> DataFrame:
    """Repeated starts of the classes: (key, class, start, n).  All classes of a key share one index."""
    room = (1 << INDEX_BITS) - 1

    def run(batches):
        import pyarrow as pa

        def marks(held):
            index = RunIndex([h[3] for h in held])
            long = index.matching_statistics() >= length
            out = []
            for (key, name, met, t), s in zip(held, index.starts.tolist()):
                if met == 1:
                    for lo, n in zip(*(x.tolist() for x in spans(long[s:s + len(t) - length + 1]))):
                        out.append((key, name, lo, n))
            cols = list(zip(*out)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                               pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                                              ["key", "class", "start", "n"])

        held, size, group, group_size = [], 0, [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and group[-1][0] != row[0]:
                    if size + group_size > room and held:
                        yield marks(held)
                        held, size = [], 0
                    held, size, group, group_size = held + group, size + group_size, [], 0
                group.append(row)
                group_size += len(row[3]) + 1
        if held and size + group_size > room:
            yield marks(held)
            held = []
        if held or group:
            yield marks(held + group)

    return strings.select("key", "class", "met", "body").repartition("key").sortWithinPartitions("key").mapInArrow(
        lean(run), "key long, class long, start int, n int")


def repeats(src: DataFrame, length: int, ks: list[int], hot: int) -> DataFrame:
    """(r1, r2, start, n): ranges of starts whose ``length`` bytes start anywhere else among the texts ``src``."""
    all_pieces = written(pieces(src, length, ks[0]))
    keys = written(all_pieces.groupBy("key").agg(F.count("*").alias("c"), (F.min("body") != F.max("body")).alias("multi"))
                   .where("c > 1").select("key", "multi"))
    met = written(all_pieces.join(keys, "key"))
    sure = met.where("not multi").select("r1", "r2", "start", "n")
    if len(ks) == 1:
        return sure  # the key is the hash of the whole window
    classes = written(met.where("multi").groupBy("key", "body").agg(
        F.count("*").alias("met"), F.min(F.struct("r1", "r2", "start", "n")).alias("one")))
    # Both sides of the join are plain tables, so AQE can split the classes of a crowded key.
    classes = written(classes)
    groups = written(classes.groupBy("key").agg(F.count("*").alias("classes"), F.min("met").alias("least")).where(
        "least = 1 and classes > 1").drop("least"))
    wanted = classes.join(groups, "key").select("one.*", "key", F.col("body").alias("class"), "classes", "met")
    strings = written(fetch(src, wanted, length))
    marks = indexed(strings.where(F.col("classes") <= hot), length)
    large = strings.where(F.col("classes") > hot)
    if not large.isEmpty():
        once = large.where("met = 1").select("key", "class")
        deeper = repeats(large.select(F.col("key").alias("r1"), F.col("class").alias("r2"), "body"), length, ks[1:], hot)
        marks = marks.union(deeper.select(F.col("r1").alias("key"), F.col("r2").alias("class"), "start", "n").join(
            once, ["key", "class"], "left_semi"))
    whole = classes.where("met > 1").select("key", F.col("body").alias("class"), F.lit(0).alias("from"), F.lit(None).cast("int").alias("m"))
    marks = written(marks.select("key", "class", F.col("start").alias("from"), F.col("n").alias("m")).union(whole))
    return sure.union(met.where("multi").withColumnRenamed("body", "class").join(marks, ["key", "class"]).select(
        "r1", "r2", (F.col("start") + F.col("from")).cast("int").alias("start"), F.coalesce("m", "n").alias("n")))


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as one struct, and what tells texts apart in the joins: the hash of the text and the id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.xxhash64(text).alias("r1"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("r2"), text.cast("binary").alias("body"))


def without_repeats(docs: DataFrame, length: int = 400, ks: tuple[int, ...] = (32, 369, 400), hot: int = 1000,
                    text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed spans (byte start and end) and the text left of every row.

    ``ks``: k-mer lengths, the last one ``length``.  ``text=True`` returns the columns of ``docs``
    instead, whatever their names, with the rest of each text.  In a text left, a character that is
    removed in part stays whole.
    """
    src = keyed(docs)
    found = repeats(src, length, list(ks), hot).groupBy("r1", "r2").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    columns = docs.columns

    def removed(marks, size):
        mask = np.zeros(size + 1, np.int32)
        if marks:
            start = np.array([m["start"] for m in marks])
            np.add.at(mask, start, 1)
            np.add.at(mask, start + np.array([m["n"] for m in marks]) + length - 1, -1)
        return spans(np.cumsum(mask)[:size] > 0)

    def digest(batches):
        import pyarrow as pa
        for b in batches:
            out = []
            for key, t, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                lo, n = removed(marks, len(t))
                kept = _kept(t, lo, n)
                out.append((key, len(t), len(t) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(),
                            np.stack([lo, lo + n], 1).reshape(-1).tolist(), _kept(t, *_inward(t, lo, n)).decode()))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"])

    def rest(batches):
        import pyarrow as pa
        for b in batches:
            kept = []
            for t, marks in zip(b.column(len(columns)).to_pylist(), b.column(len(columns) + 1).to_pylist()):
                lo, n = removed(marks, len(t))
                kept.append(_kept(t, *_inward(t, lo, n)).decode())
            at = columns.index("text")
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if k == at else b.column(k) for k in range(len(columns))],
                                             columns)

    joined = src.join(found, ["r1", "r2"], "left")
    if text:
        extra = [F.col(c).alias(reserved(columns, c)) for c in ("body", "marks")]
        return joined.select("own.*", *extra).mapInArrow(lean(rest), docs.schema)
    return joined.select(F.col("own.doc_id").cast("long").alias("doc_id"), "body", "marks").mapInArrow(
        lean(digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, text string")


def _kept(t: bytes, lo: np.ndarray, n: np.ndarray) -> bytes:
    edge = [0, *np.stack([lo, lo + n], 1).reshape(-1).tolist(), len(t)]
    return b"".join(t[a:b] for a, b in zip(edge[::2], edge[1::2]))


def _inward(t: bytes, lo: np.ndarray, n: np.ndarray):
    """Spans without the characters of which they hold only a part."""
    a, b = [], []
    for s, e in zip(lo.tolist(), (lo + n).tolist()):
        while s < e and t[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(t) and t[e] & 0xC0 == 0x80:
            e -= 1
        a.append(s)
        b.append(e - s)
    return np.array(a, np.int64), np.array(b, np.int64)
