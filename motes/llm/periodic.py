"""Periodic runs of words, and texts in which every run keeps its first period only.

A run is a stretch of words with smallest period q (words q apart are equal) that is at least
``max(least, times * q)`` words long and that no neighbouring word extends.

Method: a sparse diagonal table.  A word and an earlier occurrence q words before it lie on the
diagonal of lag q, and the length of a match there is one more than that of the word before; where
a diagonal is not carried on, it ends, and if the match is long enough its run is emitted.  Which
earlier occurrences count is what keeps the table sparse: a run of lag q matches over ``reach(q)``
words or more, so for lags in [low, g] only words that begin a repeated gram of g words, g at most
the smallest reach, are looked at.  And as g is no less than q, the nearest earlier occurrence of
such a gram inside the run lies at its smallest period exactly; so each word is on one diagonal a
scale, the periods found are the smallest, and scales grow by a factor of ``times - 1``.  A text of
n words costs O(n log n) at most, also when all of them are equal.  Grams are numbered exactly; a
hash only picks the words that might begin a repeated one.

Texts may be null or empty (no words, no runs), repeated rows are taken each for itself, columns
other than the key and the text are left out, and no rows give no rows.  A text is one row; tasks
read rows in slices of bounded size and shuffle nothing.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.llm.common import in_batches, numbered, ragged, texts

RUNS = "array<struct<start: long, length: long, period: long>>"
#: What stands between words.
GAP = "[\\x20\\x09-\\x0D]+"


def words_of(text) -> F.Column:
    """The words of a text as an array; of a null text, none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of equal pairs."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1] if len(a) else a


def _repeated(names: np.ndarray) -> np.ndarray:
    return (np.bincount(names) > 1)[names] if len(names) else np.zeros(0, bool)


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = 6, times: int = 4):
    """Arrays (text, start, length, period) of all runs in texts that stand one after the other in
    ``words`` (numbers of equal words), ``sizes`` words each; sorted by text, start, period."""
    if times < 3:
        raise ValueError("a run repeats its period three times at least")
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    room = ends[text] - np.arange(len(words))  # words from here to the end of the text
    out = []

    def reach(q: int) -> int:
        return max(least - q, (times - 1) * q)
    low, gram, name = 1, 0, None
    longest = int(sizes.max(initial=0))
    while low == 1 or low * times <= longest:
        g = min(reach(max(low, q)) for q in (low, least // times, least // times + 1))
        if gram == 0:
            at = np.flatnonzero(room >= g)
            mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            h = text[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for j in range(g):
                h = (h + mixed[at + j]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(31)
            s = np.sort(h)
            twice = np.unique(s[1:][s[1:] == s[:-1]])
            if not len(twice):
                break
            at = at[twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h]
            own = text[at]
            for j in range(g):
                own = _pairs(own, words[at + j])
        else:
            # grams double until they are g long; of a repeated gram every part is repeated
            at, own = np.flatnonzero(name >= 0), name[name >= 0]
            while gram < g and len(at):
                to = min(2 * gram, g)
                fits = np.flatnonzero(room[at] >= to)
                at, own = at[fits], own[fits]
                rest = name[at + to - gram]
                at, own, rest = at[rest >= 0], own[rest >= 0], rest[rest >= 0]
                own = _pairs(own, rest)
                gram = to
                again = _repeated(own)
                at, own = at[again], own[again]
                name = np.full(len(words), -1)
                name[at] = own
        gram = g
        again = _repeated(own)
        at, own = at[again], own[again]
        if not len(at):
            break
        name = np.full(len(words), -1)
        name[at] = own
        by = np.argsort(own, kind="stable")
        lag = np.zeros(len(at), np.int64)
        later = np.flatnonzero(own[by[1:]] == own[by[:-1]]) + 1
        lag[by[later]] = at[by[later]] - at[by[later - 1]]
        # a diagonal goes on while the next word has the same lag
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])]))
        q, steps = lag[first], np.diff(np.append(first, len(at)))
        length = steps + g - 1 + q
        ok = (q >= low) & (q <= g) & (length >= np.maximum(least, times * q))
        out.append((at[first[ok]] - q[ok], length[ok], q[ok]))
        low = g + 1
    start, length, period = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
    owner = text[start] if len(start) else start
    order = np.lexsort((period, start, owner))
    owner, start, length, period = (a[order] for a in (owner, start, length, period))
    return owner, start - (ends - sizes)[owner], length, period


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the key, ``n_words``, ``runs`` by start and period, and ``collapsed``: the words that no
    run holds after its first period, joined by one space."""
    schema = f"{key} long, n_words long, runs {RUNS}, collapsed string"

    def find(batches):
        import pyarrow as pa
        for keys, bodies in in_batches(batches):
            split = [t.encode().split() for t in bodies]
            sizes = np.array([len(w) for w in split], np.int64)
            owner, start, length, period = runs_of(numbered(split, int(sizes.sum())), sizes, least, times)
            before = np.cumsum(sizes) - sizes
            change = np.zeros(int(sizes.sum()) + 1, np.int64)
            np.add.at(change, before[owner] + start + period, 1)
            np.add.at(change, before[owner] + start + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            with_runs = set(owner.tolist())
            left = [b" ".join(compress(w, kept[b:b + len(w)].tolist()) if k in with_runs else w)
                    for k, (w, b) in enumerate(zip(split, before.tolist()))]
            edges = np.searchsorted(owner, np.arange(len(split) + 1)).astype(np.int32)
            runs = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(a) for a in (start, length, period)],
                                                                             names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes), runs, pa.array(left, pa.binary()).cast(pa.string())],
                                             names=[key, "n_words", "runs", "collapsed"])
    return texts(docs, key, text).mapInArrow(find, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; the texts of a tenth of the ids, picked by checksum, end in a period of their own."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), h.alias("h"),
                    F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words_of(F.col("text"))).alias("w"))
    n = F.size("w")
    d = d.withColumn("a", F.when(n > 0, F.col("g") % n))
    d = d.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return d.select("doc_id", F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each row of :func:`periodic_runs`, and checksums of all runs and of the text left."""
    top = F.array_min(F.transform("runs", lambda x: F.struct((-x["length"]).alias("k"), x["start"].alias("s"), x["period"].alias("p"))))
    lines = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","),
                                                  x["period"].cast("string"), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.s").alias("start"), (-F.col("top.k")).alias("length"),
        F.col("top.p").alias("period"), F.floor(1000 * -F.col("top.k") / F.col("top.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
