import random
import re

from motes.llm import minhash
from motes.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, threshold):
    """(n_shingles, component) by comparing every pair."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        n = min(size, len(w))
        sets.append(frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= threshold * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, len(s), least.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, sets)) if i is not None)


def copies(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    texts = ["", None, " \t\n", "one", "ONE", "one two three", "One two  three", "é x y z", "É x y z"]
    for _ in range(4):
        texts += copies(rng, rng.choices(words, k=120), 25, 8)
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    texts += ["ab " * 5000, "ab " * 4000] + texts[30:40]
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts)) + [(ids[20], texts[20])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1024, 8):
        got = minhash.near_duplicates(df, size=4, block=block).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_no_rows_null_ids_and_other_columns(spark):
    schema = "text string, set string, doc_id long, node int"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = minhash.near_duplicates(spark.createDataFrame([("a b c", None, None, 1), ("a b c", "x", 3, 2), ("a b c", "y", 7, 2)], schema))
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got.collect()) == [(-1, -1, True), (3, 3, True), (7, 3, False)]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    names = rng.sample(range(10**6), 600)
    edges = [(names[k], names[k + 1]) for k in range(199)] + [(names[200], n) for n in names[201:400]] + [(names[500], names[500])]
    edges += [(rng.choice(names[400:500]), rng.choice(names[400:500])) for _ in range(60)]
    up = {n: n for n in names}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    assert got == {n: top(n) for a, b in edges if a != b for n in (a, b)}
