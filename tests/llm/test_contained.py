import hashlib
import random
import re

from motes.llm import contained

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def expected(text, items, length):
    w = words(text)
    hit, found = set(), set()
    places = {}
    for n in range(1, length + 1):
        for s in range(len(w) - n + 1):
            places.setdefault(tuple(w[s:s + n]), []).append(s)
    for item, t in items:
        v = words(t)
        if item is None or not v:
            continue
        n = min(length, len(v))
        for window in {tuple(v[s:s + n]) for s in range(len(v) - n + 1)}:
            for s in places.get(window, ()):
                hit |= set(range(s, s + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def fixture(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(("ab", "Cd", "éf", "g1", "h")) for _ in range(n))
    items = [(k, say(rng.randint(4, 30))) for k in range(30)] + [(100, ""), (101, None), (102, "zz"), (103, "Zz, ab"), (None, "ab"), (104, "!?"), (3, "qq rr ss tt")]
    items += [(k, items[5][1]) for k in range(200, 240)]  # copies of one item
    docs = [None, "", "zz", "ZZ ab", "qq rr ss", "x qq-rr/ss\ttt y", "İx Éf"]
    for _ in range(150):
        t = [say(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            v = (items[rng.randrange(30)][1] or "").split()
            a = rng.randint(0, len(v))
            t += [rng.choice((" ", ". ", "\n")).join(v[a:a + rng.randint(5, 30)]).upper(), say(rng.randint(0, 5))]
        docs.append(" ".join(t))
    return items, docs


def test_contamination_equals_brute_force(spark):
    items, docs = fixture(7)
    rows = [(k, t, "x", 1) for k, t in enumerate(docs)] + [(8, docs[8], "x", 1), (9, "zz zz", "x", 1), (None, "a zz", "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id string, hash int").repartition(3)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    for length, size in ((10, 5), (6, 3), (3, 5)):
        got = contained.contamination(d, b, length, size).collect()
        assert len(got) == len(rows)
        want = sorted((k is None, k or 0, *expected(t, items, length)) for k, t, *_ in rows)
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert sum(r.contaminated for r in got) > 50


def test_large_windows_table_takes_the_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(contained, "FEW", 0)
    items, docs = fixture(8)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contained.contamination(d, b)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()} == {
        k: expected(t, items, 10) for k, t in enumerate(docs)}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert contained.contamination(d, b).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contained.contamination(one, b).collect()] == [(2, 0, 0, False)]
    assert contained.contamination(d, spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_words_longer_than_a_segment(spark, monkeypatch):
    from motes.llm import words as w
    monkeypatch.setattr(w, "SEGMENT", 64)
    w._powers.cache_clear()
    import numpy as np
    rng = random.Random(1)
    toks = ["".join(rng.choice("abc") for _ in range(rng.choice((1, 3, 9, 40, 200)))) for _ in range(300)]
    toks += toks[::-1]
    raw = np.frombuffer((" ".join(toks)).encode(), np.uint8)
    s, e = w.bounds(raw, contained._WORD)
    h = w.word_hashes(raw, s, e).tolist()
    w._powers.cache_clear()
    assert len(h) == len(toks) and len(set(zip(toks, h))) == len(set(toks)) == len(set(h))
