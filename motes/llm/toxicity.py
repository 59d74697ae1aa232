"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Terms (words and their beginnings) that are much more frequent in toxic than in clean example
   rows make the lexicon; a greedy cover picks the voters.  Pattern voters look at the form of a text.
2. The label model estimates, without labels, how often each voter fires for either class (EM), and
   how voters correlate inside a class; correlated voters count less.
3. A logistic regression over terms and patterns learns the model's posterior labels and scores
   every whole text.

Examples are a bounded sample of the labelled rows that may be learned from: at most ``toxic_rows``
and ``clean_rows`` different texts, the first by hash.  The lexicon holds at most ``size`` terms; all
of them are features of the classifier, and as many vote as add to the cover.
Scores depend on the text alone.  Null and empty texts have no terms; repeated rows have equal
scores.  Without examples of both classes every score is 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from motes.llm.common import _Slots, in_batches, lean, reserved, texts, written

EDGE = ".,!?;:*%$#&\"'()[]{}<>|"
SHORTEST, LONGEST = 3, 8
PATTERNS = 5


def terms_of(word: str) -> list[str]:
    """The word without punctuation at its edges, marked as a whole, and its beginnings."""
    w = word.strip(EDGE)[:64]
    if len(w) < SHORTEST:
        return []
    return ["=" + w] + [w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1)]


def patterns(text: str) -> list[bool]:
    """The pattern voters: shouting, exclamation marks, marks inside words, few words, long words."""
    n = max(1, len(text))
    words = text.count(" ") + 1
    return [text.isupper(), text.count("!") * 40 > n, (text.count("*") + text.count("$") + text.count("#")) * 40 > n,
            words < 20, n > 12 * words]


#: Most words hold no term; they share one list.
NONE: list[int] = []


class Finder:
    """The terms of a list in whole texts; each distinct word is looked up once per worker."""

    def __init__(self, terms: list[str], limit: int = 150_000):
        self.number = {t: k for k, t in enumerate(terms)}
        self.limit = limit
        self._clear()

    def _clear(self):
        self.slots, self.hit, self.found = _Slots(), np.zeros(0, bool), []

    def __call__(self, docs: list[str]) -> list[np.ndarray]:
        if len(self.slots) > self.limit:
            self._clear()
        get, per = self.slots.__getitem__, []
        for t in docs:
            words = t.lower().split()
            per.append(np.fromiter(map(get, words), np.int64, len(words)))
        new, self.slots.new = self.slots.new, []
        self.found += [[self.number[t] for t in terms_of(w) if t in self.number] or NONE for w in new]
        self.hit = np.concatenate([self.hit, np.array([bool(f) for f in self.found[len(self.hit):]], bool)])
        return [np.array(sorted({i for s in np.unique(slots[self.hit[slots]]).tolist() for i in self.found[s]}), np.int64)
                for slots in per]


def may_learn() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def examples(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> DataFrame:
    """doc_id, text, toxic of the sample; its list of ids is bounded, so it is broadcast."""
    own = labels.where(may_learn() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(5), "doc_id")
    some = [own.where(f"toxic = {t}").orderBy(order, "doc_id").limit(n) for t, n in ((1, toxic_rows), (0, clean_rows))]
    picked = F.broadcast(some[0].union(some[1]))
    return written(texts(docs).join(picked, "doc_id").dropDuplicates(["text"]))


def lexicon(sample: DataFrame, size: int) -> tuple[list[str], int, int]:
    """Terms of two toxic examples and more, at least 20 times as frequent in them, and the class sizes."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return [], toxic, clean

    def counted(batches):
        from collections import Counter

        import pyarrow as pa
        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        for _, found in in_batches(batches):
            for t in found:
                seen.update({x for w in set(t.lower().split()) for x in terms_of(w)})
                if len(seen) > 200_000:
                    yield rows()
                    seen.clear()
        yield rows()

    def by_class(which, name):
        rows = sample.where(f"toxic = {which}").select("doc_id", "text")
        return rows.mapInArrow(lean(counted), "term string, n long").groupBy("term").agg(F.sum("n").alias(name))

    often = by_class(1, "n").where("n >= 2").join(by_class(0, "m"), "term", "left").where(
        F.col("n") * clean >= 20 * toxic * F.coalesce("m", F.lit(0)))
    return sorted(r["term"] for r in often.orderBy(F.desc("n"), "term").limit(size).select("term").collect()), toxic, clean


def cover(toxic: list[np.ndarray], clean: np.ndarray, share: float, names: list[str], times: int = 4) -> list[int]:
    """Voters that cover the toxic examples up to ``times`` times each.

    ``toxic`` holds the terms of each toxic example, ``clean`` the count of clean examples by term and
    ``share`` the toxic examples to a clean one.  Each voter is the one that adds most, and at least
    two examples; the longer term wins ties.  A term that fires on nearly the same rows as a chosen one
    (its word, or a beginning of it) is not chosen again.
    """
    size, need, chosen = len(names), np.full(len(toxic), times), []
    col = np.concatenate(toxic) if toxic else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(toxic)), [len(t) for t in toxic])
    by_term = np.split(row[np.argsort(col, kind="stable")], np.cumsum(np.bincount(col, minlength=size))[:-1])
    count = np.bincount(col, minlength=size)
    # A share of the clean rows costs as much as ten times that share of the toxic ones.
    gain = count - 10.0 * clean * share
    long = np.array([len(t.lstrip("=")) for t in names])
    free = np.ones(size, bool)
    while free.any():
        best = np.where(free, gain, -np.inf)
        ties = np.flatnonzero(best == best.max())
        k = int(ties[np.argmax(long[ties])])
        if best[k] < 2:
            break
        chosen.append(k)
        rows = by_term[k]
        both = np.bincount(np.concatenate([toxic[r] for r in rows]), minlength=size)
        need[rows] -= 1
        for r in rows[need[rows] == 0]:
            gain[toxic[r]] -= 1
        free &= both < 0.7 * (count + count[k] - both)
    return chosen


def label_model(votes: np.ndarray, toward: np.ndarray, prior: float, rounds: int = 50):
    """Posterior of the toxic class for rows of votes (0 or 1).

    ``toward``: the class each voter speaks for, which only starts the estimate.  Firing rates by
    class come from EM; the weight of a voter is divided by one plus its correlations with the
    others inside the classes, so a group of copies speaks about as loud as one voter.
    """
    n = len(votes)
    least = min(0.0005, 0.25 / n)  # a voter that fires in a few rows still has a say
    base = votes.mean(0, dtype=float).clip(least, 0.99)
    rate = np.stack([np.where(toward == 1, base * 0.3, base), np.where(toward == 1, np.minimum(0.9, base * 3), base)]).clip(least, 0.999)
    weight = np.ones(votes.shape[1])
    post = np.full(n, prior)
    total, pairs = votes.sum(0, dtype=float), votes.T @ votes
    for step in range(rounds):
        log = [votes @ ((np.log(rate[c]) - np.log(1 - rate[c])) * weight).astype(votes.dtype) + np.log(1 - rate[c]) @ weight for c in (0, 1)]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - prior) / prior), -60, 60)))
        for c, p in ((0, 1 - post), (1, post)):
            rate[c] = ((p.astype(votes.dtype) @ votes + 0.5 * base) / (p.sum() + 0.5)).clip(least, 0.9995)
        if step >= 5:
            # Sums of products of what the rates leave unexplained: the counted pairs and four outer products.
            a, d, pv = rate[0], rate[1] - rate[0], (post.astype(votes.dtype) @ votes).astype(float)
            left = np.stack([total, a, pv, d], 1)
            right = np.stack([-a, n * a + post.sum() * d - total, -d, post.sum() * a + post @ post * d - pv], 1)
            spread = np.sqrt(np.maximum(0, np.diag(pairs) + (left * right).sum(1)) / n) + 1e-9
            for k in range(0, len(weight), 512):
                corr = (pairs[k:k + 512] + left[k:k + 512] @ right.T) / n / np.outer(spread[k:k + 512], spread)
                corr[np.arange(len(corr)), np.arange(k, k + len(corr))] = 0
                weight[k:k + 512] = 1 / (1 + np.clip(corr, 0, 1).sum(1))
    return post


def logistic(rows: list[np.ndarray], size: int, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of ``size`` features and bias (last) by Newton steps on soft labels; rows list their features.

    The steps are found by conjugate gradients, so no matrix over the features is made.
    """
    n = len(rows)
    row = np.concatenate([np.repeat(np.arange(n), [len(r) for r in rows]), np.arange(n)])
    col = np.concatenate([*rows, np.full(n, size)]).astype(np.int64)
    keep = np.full(size + 1, ridge)
    keep[-1] = 1e-3

    def times(w):
        return np.bincount(row, w[col], n)

    def back(u):
        return np.bincount(col, u[row], size + 1)

    def loss(w):
        z = times(w)
        return (np.logaddexp(0, z) - y * z).sum() + (keep * w * w).sum() / 2

    w = np.zeros(size + 1)
    last = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        curve = p * (1 - p) + 1e-6
        scale = back(curve) + keep
        left = back(y - p) - keep * w
        step, z = np.zeros(size + 1), left / scale
        way, now = z, left @ z
        goal = now * 1e-10
        for _ in range(200):
            if now <= goal:
                break
            bent = back(curve * times(way)) + keep * way
            far = now / (way @ bent)
            step, left = step + far * way, left - far * bent
            z = left / scale
            now, before = left @ z, now
            way = z + now / before * way
        while (new := loss(w + step)) > last and np.abs(step).max() > 1e-6:
            step /= 2
        w, last = w + step, new
        if np.abs(step).max() < 1e-6:
            break
    return w


def fitted(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int, size: int):
    """(terms, weights with patterns and bias) or None without examples of both classes."""
    sample = examples(docs, labels, toxic_rows, clean_rows)
    names, toxic, clean = lexicon(sample, size)
    if not toxic or not clean:
        return None

    def found(batches):
        import pyarrow as pa
        find = Finder(names)
        for b in batches:
            docs = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([f.tolist() for f in find(docs)], pa.list_(pa.int64())),
                                              pa.array([patterns(t) for t in docs], pa.list_(pa.bool_()))], ["toxic", "terms", "forms"])

    rows = sample.orderBy("doc_id").select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        lean(found), "toxic int, terms array<long>, forms array<boolean>").collect()  # at most toxic_rows + clean_rows
    y = np.array([r["toxic"] for r in rows])
    terms = [np.array(r["terms"], np.int64) for r in rows]
    forms = np.array([r["forms"] for r in rows], bool).reshape(len(rows), PATTERNS)
    in_clean = np.bincount(np.concatenate([t for t, c in zip(terms, y) if not c] or [np.zeros(0, np.int64)]), minlength=len(names))
    chosen = cover([t for t, c in zip(terms, y) if c], in_clean, (y == 1).sum() / max(1, (y == 0).sum()), names) if names else []
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    votes = np.zeros((len(rows), len(chosen) + 1 + PATTERNS), np.float32)
    for k, t in enumerate(terms):
        votes[k, [v for v in place[t] if v >= 0]] = 1
    votes[:, len(chosen)] = ~votes.any(1)
    votes[:, len(chosen) + 1:] = forms
    toward = np.array([1] * len(chosen) + [0] + [1] * PATTERNS)
    post = label_model(votes, toward, float(np.clip(y.mean(), 0.01, 0.99)))
    own = [np.concatenate([t, len(names) + np.flatnonzero(f)]) for t, f in zip(terms, forms)]
    return names, logistic(own, len(names) + PATTERNS, post)


def scores(docs: DataFrame, labels: DataFrame, toxic_rows: int = 3000, clean_rows: int = 5000, size: int = 20_000, score: str = "toxic_score") -> DataFrame:
    """``docs`` with its columns and ``score`` (0 to 1) of every row; the name must not be one of theirs."""
    if reserved(docs.columns, score) != score:
        raise ValueError(f"there is a column {score} already")
    model = fitted(docs, labels, toxic_rows, clean_rows, size)
    columns = docs.columns
    if model is None:
        return docs.withColumn(score, F.lit(0.0))
    names, w = model

    def run(batches):
        import pyarrow as pa
        find = Finder(names)
        at = columns.index("text")
        for b in batches:
            out = []
            for k in range(0, b.num_rows, 256):
                part = [t or "" for t in b.column(at).slice(k, 256).to_pylist()]
                for t, f in zip(part, find(part)):
                    out.append(w[-1] + w[f].sum() + w[len(names):-1][patterns(t)].sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -60, 60))))],
                                             [*columns, score])

    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    return docs.mapInArrow(lean(run), schema)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scores(own, labels, **options).select(
        "doc_id", F.coalesce(~may_learn(), F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= threshold).cast("int").alias("predicted"))
