import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from motes.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6, times=4):
    """All runs from their definition: maximal stretches of each lag, the smallest period of each."""
    out, n = {}, len(w)
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i - q, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(x for i, x in enumerate(w) if i not in drop))]
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, *sha)


def cases(seed, count, longest):
    rng = random.Random(seed)
    out = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "x y z " * 8, "a a a a a a b " * 9, ("a b c d e f g " * 5 + "h ") * 4]
    for _ in range(count):
        w = []
        while len(w) < rng.randint(1, longest):
            block = [rng.choice("abcdé") for _ in range(rng.randint(1, rng.choice((3, 8, 40))))]
            w += block * rng.choice((1, 1, 2, 4, 5, 9))
        out.append(rng.choice((" ", "  ", "\n")).join(w))
    return out


def test_runs_equal_their_definition():
    rng = random.Random(3)
    for least, times in ((6, 4), (2, 3), (20, 5)):
        lists = [t.split() if t else [] for t in cases(rng.random(), 60, 160)]
        lists += [[0] * n for n in (0, 1, 5, 6, 7, 500)] + [[0, 1] * 100 + [2] + [1, 0, 0] * 30]
        flat = [str(x) for w in lists for x in w]
        ids = np.unique(flat, return_inverse=True)[1].reshape(-1)
        owner, start, length, period = periodic.runs_of(ids, np.array([len(w) for w in lists]), least, times)
        got = [[] for _ in lists]
        for o, *r in zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist()):
            got[o].append(tuple(r))
        assert got == [brute(w, least, times) for w in lists]


def test_equal_words_take_no_square():
    _, start, length, period = periodic.runs_of(np.zeros(2_000_000, np.int64), np.array([2_000_000]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [2_000_000], [1])


def test_few_repeats_are_refused():
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(3, np.int64), np.array([3]), times=2)


def test_query_equals_brute_force(spark):
    texts = cases(11, 300, 120)
    rows = [("r", k, t, k) for k, t in enumerate(texts)] + [("again", 12, texts[12], 0), ("none", None, "a " * 9, 0)]
    df = spark.createDataFrame(rows, "runs string, doc_id long, text string, n_words int").repartition(3)
    got = periodic.digests(periodic.periodic_runs(periodic.with_planted_runs(df))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.n_runs, r.start, r.length, r.period) == (1, 0, 9, 1)
        else:
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected(r.doc_id, texts[r.doc_id]), r.doc_id
    assert len({zlib.crc32(str(k).encode()) % 10 for k in range(len(texts))}) == 10
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.digests(periodic.periodic_runs(periodic.with_planted_runs(empty))).collect() == []
