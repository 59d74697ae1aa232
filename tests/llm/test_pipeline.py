import random

import corpus_pipeline
import numpy as np
from tests.llm.test_minhash import brute, copies
from tests.llm.test_texts import brute_repeats, brute_spans
from tests.llm.test_tokens import library

from motes.llm.common import written


def make(spark, folder):
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprstvz" for b in "aeiou" for c in "bdfgklmn"]
    passage = " ".join(rng.choices(words, k=70))
    texts = []
    for k in range(160):
        w = rng.choices(words, k=rng.randint(8, 150))
        if k % 6 == 0:
            w[rng.randrange(len(w))] = rng.choice(["rudeword", "vileterm"])
        if k % 9 == 1:
            w.insert(3, passage)
        if k % 7 == 2:
            w.insert(2, f"mail a{k}@b.example.com or +1 (555) 555-{1000 + k} é 1.2.3.{k}")
        texts.append(" ".join(w))
    texts += copies(rng, texts[1].split(), 8, 3) + [texts[2], texts[2], "", "", None]
    rows = [(7 * k + 3, t, "en", None if k % 5 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)] + [(17, texts[2], "en", "s2", len(texts[2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(bool(t and ("rudeword" in t or "vileterm" in t)))) for i, t, *_ in rows if i % 4]
    spark.createDataFrame(sorted(set(labels)), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_every_stage_against_brute_force_and_run(spark, tmp_path):
    make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, str(tmp_path)))
        after = docs.collect()
        seen.append(name)
        if name == "packing":
            break
        assert docs.columns == columns
        if name == "toxicity":
            want = [r for r in before if not (r.text and ("rudeword" in r.text or "vileterm" in r.text))]
            assert sorted(after, key=str) == sorted(want, key=str)
        elif name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before]
            kept = {i for i, _, c in brute(rows, 5, 80) if i == c}
            want = {(r.doc_id, r.text) for r in before if r.doc_id in kept}
            assert sorted(((r.doc_id, r.text) for r in after), key=str) == sorted(want, key=str) and set(after) <= set(before)
        elif name == "repeats":
            raw = {r.doc_id: (r.text or "").encode() for r in before}
            masks = dict(zip(raw, brute_repeats(list(raw.values()), corpus_pipeline.REPEAT)))
            assert any(m.any() for m in masks.values())
            for r in after:
                want = np.frombuffer(raw[r.doc_id], np.uint8)[~masks[r.doc_id]].tobytes().decode()
                assert r.text == want and r.n_chars == len(want)
        else:
            texts = {r.doc_id: r.text for r in before}
            assert sum(bool(brute_spans(t)) for t in texts.values()) > 5
            for r in after:
                assert r.n_chars == len(r.text) and not brute_spans(r.text)
                assert bool(brute_spans(texts[r.doc_id])) <= (r.text != texts[r.doc_id])
    assert seen == ["toxicity", "near_duplicates", "repeats", "personal_data", "packing"]
    ids = library("word_bpe_49k.json", [r.text for r in before], [2])
    assert sum(r.length for r in after) == sum(map(len, ids))
    assert sorted({(r.doc_id, r.doc_tokens) for r in after}) == sorted((r.doc_id, len(i)) for r, i in zip(before, ids))
    again = corpus_pipeline.run(spark, str(tmp_path))

    def pieces(rows):
        return sorted((r.doc_id, r.doc_tokens) for r in rows)

    assert sorted(set(pieces(again.collect()))) == sorted(set(pieces(after)))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_leave_columns_of_any_name_alone(spark, tmp_path):
    make(spark, str(tmp_path))
    names = ["row", "r1", "r2", "body", "marks", "toxic_score", "kept_id", "size", "own", "a", "b", "Want", "key"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.selectExpr("*", *[f"doc_id % 5 as {n}" if n == "size" else f"concat('{n}', doc_id) as {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs.columns
        docs = written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == before
        rows = docs.collect()
        assert len(rows) > 50, name
        for r in rows:
            assert all(r[n] == (r.doc_id % 5 if n == "size" else f"{n}{r.doc_id}") for n in names), name
    assert written(corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))).count() >= len(rows)
