"""Document fingerprints: SimHash by weighted votes, and a Hamming search over permuted block tables.

Only DataFrame functions are used.  The terms of a text are its pairs of neighbouring words (runs of
letters and digits, lower case; the last word is a term of its own), each as often as it occurs, weighted by its length: longer terms are rarer and say more.  128 hash bits of every term
vote with that weight; two votes share one sum, in the halves of a long, so 64 sums hold all votes.
A bit is set if more than half of the weight is for it.

Null and empty texts, and texts without words, have the fingerprint of zeros; they are like each
other (1.0).  Every row keeps its own result; rows that share a doc_id have the same next document,
and where several rows have the next doc_id, the smallest text counts.  A null doc_id sorts first.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motes.llm.common import texts, written

BITS = 128
#: A vote may not grow beyond 31 bits, so a term's weight is at most this; texts stay below 2**31 / 64 terms.
MOST = 63


def terms(text: Column) -> Column:
    """The words of a text in order; never empty, so a text without words keeps its row."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and the fingerprint of ``text`` as two longs, a row per row.

    ``keys`` tell the rows apart.  Where ``df`` is dealt by a key already, nothing is shuffled.
    """
    one = df.select(*keys, terms(F.col(text)).alias("w"))
    term = one.select(*keys, F.expr("inline(arrays_zip(w, slice(w, 2, size(w))))").alias("one", "two"))
    long = F.length("one") + F.coalesce(F.length("two"), F.lit(0))
    h = term.select(*keys, F.least(long, F.lit(MOST)).cast("long").alias("weight"),
                    F.xxhash64("one", "two").alias("h0"), F.xxhash64(F.lit(1), "one", "two").alias("h1"))
    lanes = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftrightunsigned(f"h{k}", i).bitwiseAND(lanes) * F.col("weight")).alias(f"s{k}_{i}")
            for k in range(2) for i in range(32)]
    votes = h.groupBy(*keys).agg(F.sum("weight").alias("total"), *sums)

    def half(k: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(32):
            low, high = F.col(f"s{k}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{k}_{i}", 32)
            for at, v in ((i, low), (i + 32, high)):
                out = out.bitwiseOR(F.when(2 * v > F.col("total"), F.lit(1 << at if at < 63 else -(1 << 63))).otherwise(F.lit(0)))
        return out

    return votes.select(*keys, half(0).alias("f0"), half(1).alias("f1"))


def text_of(f0: str = "f0", f1: str = "f1") -> Column:
    """A fingerprint as 32 hex digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(f), 16, "0") for f in (f1, f0)]))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """The share of equal bits, 0 to 1."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def distance(a, b) -> Column:
    return F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))


def within(prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(a0, a1, b0, b1, distance): the pairs of different fingerprints (f0, f1) at most ``radius`` bits apart.

    The bits are cut into ``blocks`` blocks; at most ``radius`` of them differ, so two near
    fingerprints agree in some ``blocks - radius`` of them.  Each choice of those is a permuted
    table, keyed by its blocks.  Rows of equal fingerprints must be one row (``distinct``), a pair is
    told by the first table in which it meets, and the distance is tested inside the join.
    """
    edge = [round(BITS * k / blocks) for k in range(blocks + 1)]

    def block(f0, f1, k):
        parts = []
        for half, f in ((0, f0), (64, f1)):
            lo, hi = max(edge[k], half), min(edge[k + 1], half + 64)
            if lo < hi:
                parts.append(F.shiftrightunsigned(f, lo - half).bitwiseAND(F.lit((1 << (hi - lo)) - 1)))
        return parts

    tables = list(combinations(range(blocks), blocks - radius))
    key = F.array(*[F.xxhash64(F.lit(t), *[p for k in chosen for p in block("f0", "f1", k)]) for t, chosen in enumerate(tables)])
    dealt = written(prints.select("f0", "f1").distinct()).select("f0", "f1", F.posexplode(key).alias("t", "key"))
    a = dealt.select(F.col("f0").alias("a0"), F.col("f1").alias("a1"), "t", "key")
    b = dealt.select(F.col("f0").alias("b0"), F.col("f1").alias("b1"), F.col("t").alias("u"), F.col("key").alias("other"))
    agree = [F.lit(True)] * blocks
    for k in range(blocks):
        for p, q in zip(block("a0", "a1", k), block("b0", "b1", k)):
            agree[k] = agree[k] & (p == q)
    first = F.lit(None).cast("int")
    for t, chosen in reversed(list(enumerate(tables))):
        both = agree[chosen[0]]
        for k in chosen[1:]:
            both = both & agree[k]
        first = F.when(both, F.lit(t)).otherwise(first)
    far = distance(("a0", "a1"), ("b0", "b1"))
    less = (F.col("a0") < F.col("b0")) | ((F.col("a0") == F.col("b0")) & (F.col("a1") < F.col("b1")))
    return a.join(b, (F.col("key") == F.col("other")) & (F.col("t") == F.col("u")) & less & (far <= radius)
                  & (first == F.col("t"))).select("a0", "a1", "b0", "b1", far.alias("distance"))


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id) for every distinct id: the next larger one, after the last the first.

    Ids are dealt by range and written with the number of their range; inside a range a window finds
    the next id, and a table of a row per range gives it across the borders.
    """
    ids = written(docs.select("doc_id").distinct().repartitionByRange("doc_id").select(
        "doc_id", F.spark_partition_id().alias("part")))
    inside = ids.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    firsts = ids.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("part")  # a row per range
    after = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("after"))
    return inside.join(after, "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def compared(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Fingerprints of every row, of its edited text, their likeness, and the rows near it.

    The edited text is the text with its last floor(n / 2) code points replaced by as many first
    ones (or all) of the next document by doc_id.  ``n_within`` counts the other different
    fingerprints within ``radius`` bits.
    """
    # The smallest long stands for a null id: it sorts first, like null.
    base = texts(docs).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text")
    chain = written(next_ids(base))
    need = base.select("doc_id", F.length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    ask = chain.join(need, "doc_id").select(F.col("doc_id").alias("for_id"), F.col("next_id").alias("doc_id"),
                                            F.expr("cast(n div 2 as int)").alias("half"))
    heads = base.join(ask, "doc_id").select(F.col("for_id").alias("doc_id"), F.expr("left(text, half)").alias("head"))
    heads = heads.groupBy("doc_id").agg(F.min("head").alias("head"))
    both = base.join(heads, "doc_id").select(
        "doc_id", F.xxhash64("text").alias("row"), F.length("text").cast("long").alias("n_chars"), "text",
        F.expr("concat(left(text, length(text) - cast(length(text) div 2 as int)), left(head, cast(length(text) div 2 as int)))").alias("edited"))
    rows = both.select("doc_id", "row", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")),
                                         F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x"))
    marks = fingerprints(rows.select("doc_id", "row", "n_chars", "edited_sha256", "x.which", "x.t"),
                         ["doc_id", "row", "n_chars", "edited_sha256", "which"], "t")
    own = F.col("which") == 0
    prints = written(marks.groupBy("doc_id", "row", "n_chars", "edited_sha256").agg(
        *[F.max(F.when(own if side == "f" else ~own, F.col(f"f{k}"))).alias(f"{side}{k}") for side in "fe" for k in range(2)]))
    near = within(prints, radius)
    counts = near.select(F.col("a0").alias("f0"), F.col("a1").alias("f1")).union(near.select("b0", "b1")).groupBy("f0", "f1").agg(
        F.count("*").alias("n_within"))
    firsts = prints.groupBy("doc_id").agg(F.min(F.struct("row", "f0", "f1")).alias("x")).select(
        F.col("doc_id").alias("next_id"), F.col("x.f0").alias("x0"), F.col("x.f1").alias("x1"))
    repeated = base.groupBy("doc_id", F.xxhash64("text").alias("row")).count().where("count > 1")
    out = prints.join(chain, "doc_id").join(firsts, "next_id").join(counts, ["f0", "f1"], "left").select(
        F.expr(f"nullif(doc_id, {-(1 << 63) + 1} - 1)").alias("doc_id"), "n_chars", "edited_sha256", text_of().alias("fingerprint"),
        text_of("e0", "e1").alias("edited_fingerprint"), likeness(("f0", "f1"), ("e0", "e1")).alias("near_edited"),
        likeness(("f0", "f1"), ("x0", "x1")).alias("near_next"), F.coalesce("n_within", F.lit(0)).alias("n_within"), "row",
        F.col("doc_id").alias("id"))
    # Rows that are alike in id and text are one group above; each comes back here.
    copies = repeated.select(F.col("doc_id").alias("id"), "row", F.expr("sequence(2, count)").alias("more"))
    return out.join(copies, ["id", "row"], "left").withColumn("copy", F.explode(F.concat(F.array(F.lit(1).cast("long")), F.coalesce(
        "more", F.array().cast("array<long>"))))).drop("id", "row", "more", "copy")
