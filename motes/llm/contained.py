"""Benchmark passages inside documents: a prefix-filtered set join of word shingles.

Words are lower-cased (A-Z) runs of letters, digits and bytes above 127.  A window is ``length``
consecutive words of a benchmark item; an item of fewer words is one window.  A window stands for
the set of its shingles of up to ``size`` words, and a document holds it if it has them all in place.

1. The shingles of all windows are counted over all documents (a bitmap of a fixed number of bits
   keeps shingles of no window out of the shuffle) and put in order of rarity.  For containment the
   necessary prefix of a window is a single shingle, its rarest; a window with a shingle that no
   document has is done with.
2. Documents are joined on prefix shingles alone.  The length bound and the positional bound drop a
   pair whose window would begin before the document's first word or end after its last.
3. What is left is verified word by word on the words around the shingle.

Distinct windows and distinct sets of windows are handled once, so copies of items or of documents
cost a row each.  A null text has no words; items without id or words take no part; rows of an id
with several texts count together as one item and repeated documents are rows of their own.  Empty
tables give no hits.  Columns other than key and text are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motes.llm.common import in_batches, written
from motes.llm.words import bounds, shingle_hashes, word_hashes

#: Bits of the filter every task holds (4 MB), and those of a page of it.
BITS, PAGE = 25, 15
#: Rows of a windows table that is sent to every executor.
FEW = 100_000

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)]] = True
WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+', 0)"


def _few(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast if it is proven small, else as it is, for a join AQE may split."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def windows(items: DataFrame, length: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (wid, n, win: its words between spaces), and who owns them (wid, item)."""
    w = items.select(F.col(key).cast("string").alias("item"), F.expr(WORDS.format(f"`{text}`")).alias("w"))
    w = w.where("item is not null and size(w) > 0").distinct()
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - length, F.lit(0)))
    cut = w.select("item", "w", F.explode(starts).alias("s")).select(
        "item", F.array_join(F.slice("w", F.col("s") + 1, F.lit(length)), " ").alias("win"), F.least(F.size("w"), F.lit(length)).alias("n"))
    cut = written(cut.distinct())
    distinct = written(cut.select("win", "n").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return distinct, written(cut.join(distinct, ["win", "n"]).select("wid", "item"))


def _filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the top bits of all hashes, gathered in pages of fixed size."""
    slot = F.shiftrightunsigned("hash", 64 - BITS)
    pages = hashes.select(F.shiftright(slot, PAGE).alias("page"), slot.bitwiseAND((1 << PAGE) - 1).cast("int").alias("bit")).distinct() \
        .groupBy("page").agg(F.collect_list("bit").alias("bits")).collect()  # pages are few
    out = np.zeros(1 << BITS, bool)
    for p in pages:
        out[(p.page << PAGE) + np.array(p.bits)] = True
    return np.packbits(out, bitorder="little")


def _hit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - BITS)
    return np.flatnonzero((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)


def _split(bodies: list[str]):
    """The bytes of lower-cased texts with a gap after each; words, their hashes, and the words before each text."""
    raw = b"\n".join([t.encode().lower() for t in bodies] + [b""])
    buf = np.frombuffer(raw, np.uint8)
    start, end = bounds(buf, _WORD)
    ends = np.cumsum([len(t.encode()) + 1 for t in bodies])
    return raw, start, end, word_hashes(buf, start, end), np.concatenate([[0], np.searchsorted(start, ends)])


def _places(h: np.ndarray, edge: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that lie within one text, and the words at which they begin."""
    sh = shingle_hashes(h, size)
    owner = np.repeat(np.arange(len(edge) - 1), np.diff(edge))[:len(sh)]
    at = np.flatnonzero(np.arange(len(sh)) + size <= edge[1:][owner])
    return sh[at], at


def shingles(distinct: DataFrame, size: int) -> DataFrame:
    """(hash, wid, place, size) of the shingles of each window."""
    def cut(batches):
        import pyarrow as pa
        for wids, wins in in_batches(batches):
            _, _, _, h, edge = _split(wins)
            n = np.diff(edge)
            for k in range(1, size + 1):
                sh, at = _places(h, edge, k)
                own = np.searchsorted(edge, at, "right") - 1
                mine = n[own] >= size if k == size else n[own] == k
                sh, at, own = sh[mine], at[mine], own[mine]
                yield pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), pa.array(np.array(wids, np.int64)[own]), pa.array((at - edge[own]).astype(np.int32)),
                                                  pa.array(np.full(len(at), k, np.int32))], names=["hash", "wid", "place", "size"])
    return distinct.select("wid", "win").mapInArrow(cut, "hash long, wid long, place int, size int")


def prefixes(body: DataFrame, distinct: DataFrame, size: int) -> tuple[DataFrame, list[int]]:
    """The rarest shingle of each window that may occur: (hash, place, size, wid, n, win); the sizes there are."""
    mine = written(shingles(distinct, size))
    sizes = sorted(r[0] for r in mine.select("size").distinct().collect())
    bits = body.sparkSession.sparkContext.broadcast(_filter(mine))

    def count(batches):
        import pyarrow as pa
        for _, _, bodies in in_batches_of(batches):
            _, _, _, h, edge = _split(bodies)
            for k in sizes:
                sh, _ = _places(h, edge, k)
                own, n = np.unique(sh[_hit(bits.value, sh)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["hash", "times"])
    times = body.mapInArrow(count, "hash long, times long").groupBy("hash").agg(F.sum("times").alias("times"))
    ranked = mine.join(times, "hash", "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "hash", "place", "size")).alias("r"))
    return written(ranked.where("r.times > 0").select("wid", "r.hash", "r.place", "r.size").join(distinct, "wid")), sizes


def in_batches_of(batches):
    """Slices of columns (text, key, ...) given back with the text last."""
    for cols in in_batches(batches):
        yield cols[0], cols[2] if len(cols) > 2 else None, cols[1]


def candidates(body: DataFrame, prefix: DataFrame, sizes: list[int], length: int, size: int) -> DataFrame:
    """Per document: doc_id, mark, n_words and the places (hash, at, left, around) of prefix shingles."""
    bits = body.sparkSession.sparkContext.broadcast(_filter(prefix))
    place = "array<struct<hash: long, at: long, before: int, around: string>>"

    def find(batches):
        import pyarrow as pa
        for keys, marks, bodies in in_batches_of(batches):
            raw, start, end, h, edge = _split(bodies)
            hashes, places, kinds = [], [], []
            for k in sizes:
                sh, at = _places(h, edge, k)
                hit = _hit(bits.value, sh)
                hashes.append(sh[hit])
                places.append(at[hit])
                kinds.append(np.full(len(hit), k))
            hashes, at, kind = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (hashes, places, kinds))
            own = np.searchsorted(edge, at, "right") - 1
            order = np.lexsort((at, own))
            hashes, at, kind, own = hashes[order], at[order], kind[order], own[order]
            # an item shorter than a shingle is the shingle; others reach ``length`` words around it
            wide = np.where(kind == size, length, kind)
            first, last = np.maximum(edge[own], at - wide + kind), np.minimum(edge[own + 1], at + wide)
            words = [b" ".join([raw[s:e] for s, e in zip(start[a:b].tolist(), end[a:b].tolist())]) for a, b in zip(first.tolist(), last.tolist())]
            found = pa.StructArray.from_arrays([
                pa.array(hashes.astype(np.uint64).view(np.int64)), pa.array((at - edge[own]).astype(np.int64)), pa.array((at - first).astype(np.int32)),
                pa.array(words, pa.binary()).cast(pa.string())], names=["hash", "at", "before", "around"])
            offsets = np.searchsorted(own, np.arange(len(bodies) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(marks, pa.int64()), pa.array(np.diff(edge)),
                                              pa.ListArray.from_arrays(offsets, found)], names=["doc_id", "mark", "n_words", "places"])
    return body.mapInArrow(find, f"doc_id long, mark long, n_words long, places {place}")


def contained(docs: DataFrame, items: DataFrame, length: int = 10, size: int = 5, key: str = "doc_id", text: str = "text",
              item: str = "item_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, mark, n_words), occurrences (doc_id, mark, start, n, wid) and owners (wid, item).

    ``mark`` tells apart the texts of rows that share an id.
    """
    size = min(size, length)
    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("mark"))
    distinct, owners = windows(items, length, item, text)
    prefix, sizes = prefixes(body, distinct, size)
    rows = written(candidates(body, prefix, sizes, length, size))
    at = rows.where(F.size("places") > 0).select("doc_id", "mark", "n_words", F.explode("places").alias("p")).select("doc_id", "mark", "n_words", "p.*")
    pairs = at.join(_few(prefix), "hash")
    start = F.col("at") - F.col("place")
    pairs = pairs.where((F.col("n_words") >= F.col("n")) & (start >= 0) & (start + F.col("n") <= F.col("n_words")) & (F.col("place") <= F.col("before")))
    same = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("place") + 1, F.col("n")), " ") == F.col("win")
    hits = written(pairs.where(same).select("doc_id", "mark", start.alias("start"), "n", "wid").distinct())
    return rows.select("doc_id", "mark", "n_words"), hits, owners


def contamination(docs: DataFrame, items: DataFrame, length: int = 10, size: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence), n_items, items_sha256 (of the sorted ids), contaminated."""
    rows, hits, owners = contained(docs, items, length, size)
    doc = ["doc_id", "mark"]
    order = Window.partitionBy(*doc).orderBy("start", "n", "wid").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(order), F.lit(0))))
    per = hits.withColumn("fresh", fresh).groupBy(*doc).agg(
        F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("wid")).alias("wids"))
    per = written(per.withColumn("kind", F.sha2(F.array_join("wids", ",").cast("binary"), 256)))
    kinds = per.groupBy("kind").agg(F.first("wids").alias("wids")).select("kind", F.explode("wids").alias("wid"))
    ids = kinds.join(owners, "wid").select("kind", "item").distinct().groupBy("kind").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    ids = written(ids.select("kind", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256")))
    known = per.select(F.col("doc_id").alias("k"), F.col("mark").alias("m"), "n_hit", "kind").join(_few(ids), "kind")
    j = rows.join(known, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m")), "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return j.select("doc_id", "n_words", hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"))
