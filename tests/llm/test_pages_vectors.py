import numpy as np

from motes.llm import hnsw, line_blocks

LONG = "Some words that make a line long enough to be the text of an article, and then a few more. "


def page(*parts):
    return "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>" + "".join(parts) + "</body></html>"


CASES = [
    (None, ""), ("", ""), ("plain words", "plain words"),
    (page("<nav><ul><li><a href='/a'>A</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy it.</div>",
          "<article><h1>Head &amp; more</h1><p><b>One\n two<br>x.<br><p>Th&#233;n</p></article><footer>&copy; x</footer>"),
     "Head & more\nOne two x.\nThén"),
    (page("<script>var t=\"</p>\";</script><article><p>a <i>b</i>c</p><aside>s</aside><form>f</form><p>d</p>",
          "<div class='comments'><div>r1</div><p>r2</p></div><p>e</p></article><p>after</p>"), "a bc\nd\ne"),
    (page("<div><a href='#'>link words only</a></div>", f"<div><p>{LONG}</p><p>{LONG}</p><p>end</p></div>",
          "<div id='sidebar'>x</div><div>tiny</div>"), "\n".join([LONG.strip(), LONG.strip(), "end"])),
    (page("<div class='cookie-notice'>ok<article><p>still here</p></article>"), "still here"),
    ("<article><p class='ad'>Buy<p>Real<p class='share'>Tell<div>more</div>", "Real\nmore"),
    ("<article><p title='a>b'>x</p><p title=\"a>b\">y", "x\ny"), ("<article><p>cut &am", "cut &am"), ("a < b <3 c", "a < b <3 c"),
    ("<article><p>" + "w " * 50_000 + "</p></article>", ("w " * 50_000).strip()), ("<" * 2000, "<" * 2000),
]


def test_main_text(spark):
    rows = [(k, f"u{k}", h, "t") for k, (h, _) in enumerate(CASES)] + [(0, "again", CASES[3][0], "t"), (None, None, "x", None)]
    got = line_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None and r.url != "again":
            assert r.text == CASES[r.page_id][1], r.page_id
        assert r.n_chars == len(r.text)
    assert [r.text for r in got if r.url == "again"] == [CASES[3][1]]
    assert line_blocks.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_a_small_article_does_not_hide_the_text_around_it():
    text = f"<div><p>{LONG}</p><p>{LONG}</p><p>end</p></div>"
    teaser = "<article><a href='/x'>More of this</a><p>Read on</p></article>"
    body = "\n".join([LONG.strip(), LONG.strip(), "end"])
    assert line_blocks.main_text(page(text, teaser)) == body
    assert line_blocks.main_text(page(teaser, text, teaser)) == body
    whole = page(f"<main><h1>Head</h1><article><p>{LONG}</p><p>x</p>{teaser}</article></main>", teaser, "<p>after</p>")
    assert line_blocks.main_text(whole) == f"Head\n{LONG.strip()}\nx"
    two = page(f"<article><p>{LONG * 20}</p></article><article><p>{LONG}</p></article>")
    assert line_blocks.main_text(two) == f"{(LONG * 20).strip()}\n{LONG.strip()}"


def test_words_in_attributes_do_not_empty_an_article():
    body = f"{LONG.strip()}\n{LONG.strip()}"
    text = f"<p>{LONG}</p><p>{LONG}</p>"
    ad = "<div class='x ad'>Buy it.</div>"
    assert line_blocks.main_text(page(f"<article><h2 id='search-history'>Search</h2><h2 class=search>Find</h2>{text}</article>")) == f"Search\nFind\n{body}"
    assert line_blocks.main_text(page(f"<article><section id='notice-of-meeting'>{text}</section>{ad}<p>x</p></article>")) == f"{body}\nx"
    for mark in ("class='page with-sidebar'", "class='sidebar'", "data-id=share", "title='a class=ad b'", "data-role='search'"):
        assert line_blocks.main_text(page(f"<div {mark}>{text}{ad}</div>")) == body, mark
    assert line_blocks.main_text(page(f"<article>{text}<div class='comments'><article><p>r</p></article>s</div></article>")) == body
    assert line_blocks.main_text(page(f"<div class='ad'>{LONG}</div><article><p>{LONG[:70]}</p></article>")) == LONG[:70].strip()
    assert line_blocks.main_text(f"<article><p title='{'a > b ' * 20_000}'>{LONG}</p></article>") == LONG.strip()
    assert line_blocks.main_text(page(f"<article>{text}</article><article class='related'><p>{LONG}</p></article>")) == body


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.2, 2, (3000, 1))
    x[100:400] = x[7]  # copies of one vector
    rows = [(k, v.tolist(), "x") for k, v in enumerate(x)]
    bad = [(9001, None, "x"), (9002, [0.0] * 16, "x"), (9003, [float("nan")] + [1.0] * 15, "x"), (9004, [float("inf")] + [1.0] * 15, "x"),
           (9005, [None] + [1.0] * 15, "x"), (9006, [1.0] * 3, "x"), (9007, [], "x"), (None, [1.0] * 16, "x"), (20, x[20].tolist(), "x")]
    df = spark.createDataFrame(rows + [(i, v, s) for i, v, s in bad], "vec_id long, embedding array<double>, shard string")
    got = hnsw.nearest(df, min_shards=3, block=64).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 3000, 20))
    hit = 0
    for q, found in by.items():
        score = (x * x[q]).sum(axis=1)
        order = [k for k in np.lexsort((np.arange(3000), -score)) if k != q][:20]
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hit += len(set(order) & {r.vec_id for r in found})
    assert hit >= 0.95 * 20 * len(by)


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert hnsw.nearest(spark.createDataFrame([], schema)).collect() == []
    got = hnsw.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (40, [-1.0, 0.0])], schema)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 40, -1.0), (40, 1, 1, -0.5), (40, 2, 2, -0.5), (40, 3, 0, -1.0)]


def test_beam_widens_until_the_probes_are_found():
    rng = np.random.default_rng(5)
    n, d = 2500, 48
    centers = rng.normal(size=(60, d))
    for x in (rng.normal(size=(n, d)), centers[rng.integers(0, 60, n)] + .05 * rng.normal(size=(n, d))):
        g = hnsw.Graph.build(hnsw.augmented(x, (x * x).sum(1).max()), 8, 24, hnsw.level_sizes(n, 8))
        own = np.arange(0, n, 20)
        q = np.concatenate([x, np.zeros((n, 1))], 1).astype(np.float32)
        width = g.fitting_width(q[own], own, 21, 24, .95)
        other = np.arange(7, n, 25)
        found, _ = g.search(q[other], width)
        sims = x[other] @ x.T
        sims[np.arange(len(other)), other] = -np.inf
        best = np.argsort(-sims, axis=1)[:, :20]
        recall = np.array([len(set(b) & set(f)) / 20 for b, f in zip(best, found)])
        assert recall.mean() >= .9 and recall.min() > 0
    one = hnsw.Graph.build(np.ones((1, 3), np.float32), 8, 24, [1])
    assert one.fitting_width(np.ones((1, 3), np.float32), np.array([0]), 21, 24, .95) == 24
