import hashlib
import math

import numpy as np
import pytest

from motes.llm import dual_tree


def brute(rows, parts, entries, rounds, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    out, per = [], {}
    for i, v, lab in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
        per[lab] = per.get(lab, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    return sorted(((i, code, d, per[lab], sha) for i, code, d, lab in out), key=key)


def rows_of(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (9, dims))
    x = np.where(rng.random((n, 1)) < 0.5, centres[rng.integers(0, 9, n)] + rng.normal(0, .02, (n, dims)), rng.normal(0, .2, (n, dims)))
    x[n // 2:n // 2 + n // 3] = x[0]  # one vector holds a third of the rows
    x = np.float32(np.round(x * 20) / 20)  # ties
    out = [(int(i), [float(c) for c in v], int(k) if k else None) for i, v, k in zip(rng.permutation(n), x, rng.integers(0, 4, n))]
    bad = [None, [], [None] * dims, [float("nan")] + [0.0] * (dims - 1), [float("inf")] * dims]
    return out + [(n + k, v, 1) for k, v in enumerate(bad)] + [out[-1], (None, out[0][1], 7), (out[1][0], out[0][1], 2)]


@pytest.mark.parametrize("n,dims,parts,entries", [(700, 32, 16, 64), (40, 16, 16, 64), (900, 12, 4, 7), (3, 4, 2, 5)])
def test_codes_equal_brute_force(spark, monkeypatch, n, dims, parts, entries):
    monkeypatch.setattr(dual_tree, "CHUNK", 64 * 4)
    rows = rows_of(n, n, dims)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, codes string, error int").repartition(2)
    got = dual_tree.digests(*dual_tree.compressed(df, parts, entries))
    want = brute([(i, [float(np.float32(c)) if c is not None else None for c in v] if v else v, lab) for i, v, lab in rows], parts, entries, 2)
    assert sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()),
                  key=lambda r: (r[0] is None, r[0] or 0, *r[1:])) == want


def test_coarse_nodes_are_assigned_whole_and_leaves_exactly():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 3, (400, 2)) for c in ((0, 0), (500, 0), (0, 500))]).astype(np.int64)[None]
    books = np.array([[[0, 0], [500, 0], [0, 500], [1, 1], [9000, 9000]]])
    code, wholes = np.full(x.shape[1], -1), []
    tree = dual_tree.Trees(x, 8)

    def whole(part, level, node, entry):
        for n, e in zip(node, entry):
            own = tree.order[0, tree.cuts[level][n]:tree.cuts[level][n + 1]]
            assert (code[own] == -1).all()
            code[own] = e
            wholes.append(len(own))

    def single(part, point, entry, d):
        assert (code[point] == -1).all()
        code[point] = entry
    dual_tree.walk(tree, x, dual_tree.Trees(books, 1), books, whole, single)
    assert (code == ((x[0][:, None] - books[0][None]) ** 2).sum(2).argmin(1)).all()
    assert sum(wholes) >= 700 and max(wholes) >= 100


def test_lengths_that_do_not_fit(spark):
    schema = "vec_id long, embedding array<double>, label string"
    df = spark.createDataFrame([(1, [0.5] * 5, "a"), (2, [0.25] * 5, "a"), (3, [0.5] * 4, "b")], schema)
    got = dual_tree.digests(*dual_tree.compressed(df)).collect()
    assert sorted((r.vec_id, r.error) for r in got) == [(1, 0), (2, 0)]
    assert dual_tree.digests(*dual_tree.compressed(df.limit(0))).collect() == []
    with pytest.raises(ValueError):
        dual_tree.compressed(spark.createDataFrame([(1, [1e30] * 16, "a")], schema))
