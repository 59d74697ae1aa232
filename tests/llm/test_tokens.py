import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from motes.llm import frames, packing, words_bpe
from motes.llm.common import library_encoder, shared_folder, token_path


def odd_texts():
    rng = random.Random(2)
    texts = [None, "", " ", "  a", "a  b", "a \nb", " a b ", "a\tb", "don't  you're 12 3.4", "\n\n \n", "é x ́y", "a\0 b c", "\0 a \0",
             "<|endoftext|> hi <|endoftext|>", "a\x1cb \x1c c", "\x85 \xa0a", "😀 a😀b", "İ I ſ ΑΣ. x", "word " * 9000, "x" * 30_000]
    texts += ["".join(rng.choice(" \n\tab1.'s é\x1c\x85") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    return texts + texts[:6]


@pytest.fixture(scope="module")
def table(spark):
    texts = odd_texts()
    return texts, spark.createDataFrame([(3 * k, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, path string, part int")


def library(name, texts, end):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(token_path(name))
    tok.encode_special_tokens = True
    return [np.array(tok.encode(t or "", add_special_tokens=False).ids + end, "<u4") for t in texts]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_the_library(name, spaced):
    texts = [t or "" for t in odd_texts()]
    ids, counts = library_encoder(token_path(name), spaced)(texts)
    ends = np.cumsum(counts)
    for want, n, e in zip(library(name, texts, []), counts, ends):
        assert np.array_equal(want, ids[e - n:e])


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_a_full_memory_keeps_what_is_used(name, spaced):
    rng = random.Random(3)
    often = ["".join(rng.choice("abcdé,") for _ in range(5)) for _ in range(40)]
    texts = [" ".join(rng.choice(often) if rng.random() < .7 else "".join(rng.choice("abcdefg") for _ in range(8)) for _ in range(60)) for _ in range(300)]
    whole = library_encoder(token_path(name), spaced)(texts)
    small = library_encoder(token_path(name), spaced, 60_000)
    parts = [small(texts[k:k + 10]) for k in range(0, 300, 10)]
    assert small.held <= 2 * 60_000 and len(small.slots) < 600
    assert sum(w in small.slots or " " + w in small.slots for w in often) > 30
    assert np.array_equal(np.concatenate([p[0] for p in parts]), whole[0]) and np.array_equal(np.concatenate([p[1] for p in parts]), whole[1])


def test_packing_holds_every_id_once_and_pads_nothing(table):
    texts, df = table
    want = library("word_bpe_49k.json", texts, [2])
    rows = packing.pack(df.repartition(3), capacity=64, group=8, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, ids in enumerate(want):
        got = sorted(by_doc[3 * k], key=lambda r: r.start)
        assert [r.start for r in got] == np.cumsum([0] + [r.length for r in got])[:-1].tolist()
        assert np.array_equal(ids, [i for r in got for i in r.ids]) and {r.doc_tokens for r in got} == {len(ids)}
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    for got in by_seq.values():
        got.sort(key=lambda r: r.offset)
        assert [r.offset for r in got] == np.cumsum([0] + [r.length for r in got])[:-1].tolist()
        size = sum(r.length for r in got)
        assert size <= 64 and size & (size - 1) == 0
        assert abs(sum(r.length + r.length ** 2 / 4096 for r in got) - got[0].sequence_cost) < 1e-6


def test_assignment_takes_the_cheapest_sequence_with_room():
    to, cost, room = packing.assign([6, 5, 4, 3, 1], 2, 10, 1.0, 1.0)
    # 6 -> first; 5 -> second; 4 -> the cheaper second (30 < 42); 3 -> the first (the second has no room); 1 -> the first (54 > 50, room 1 each).
    assert to.tolist() == [0, 1, 1, 0, 1] and room.tolist() == [1, 0] and cost.tolist() == [54.0, 52.0]


def test_frames_round_trip(spark, table):
    texts, df = table
    want = library("byte_bpe_50k.json", texts, [2])
    folder = shared_folder(spark)
    files = frames.write(df.repartition(4), folder, frame_tokens=500)
    at, got = 0, {r.doc_id: r for r in frames.read_back(files).collect()}
    assert len(got) == len(texts)
    for k, ids in enumerate(want):
        r = got[3 * k]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    ask = spark.createDataFrame([(0,), (30,), (31,), (300,)], "doc_id long")
    assert {r.doc_id: r.ids for r in frames.read_documents(files, ask).collect()} == {k: want[k // 3].tolist() for k in (0, 30, 300)}


def test_reader_opens_only_the_frames_of_a_document_and_sees_damage():
    sink = io.BytesIO()
    w = frames.Writer(sink, 3)
    for k in range(5):
        w.add([2 * k, 2 * k + 1], np.array([2, 1]), np.array([k, k, 7]))
    size = w.close()
    raw = sink.getvalue()
    assert size == len(raw)
    r = frames.Reader(io.BytesIO(raw), size)
    opened, read = [], r.read
    r.read = lambda k: (opened.append(k), read(k))[1]
    assert [x.tolist() for x in r.find(5)] == [[7]] and opened == [2]
    broken = bytearray(raw)
    broken[int(r.table[0, 0]) - 1] ^= 1
    with pytest.raises(Exception):
        frames.Reader(io.BytesIO(bytes(broken)), size).read(0)


def test_null_ids_and_repeated_rows_in_frames(spark):
    df = spark.createDataFrame([(None, "a b"), (5, "c"), (5, "c"), (-2, None)], "doc_id long, text string")
    got = frames.round_trip(df).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -2, 5, 5] and [r.n_tokens for r in got] == [3, 1, 2, 2]


def test_word_bpe_equals_tiktoken(table):
    import public_tokenizers
    import tiktoken
    texts, df = table
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=words_bpe.ranks(token_path("byte_bpe_multi_50k.tiktoken")))
    got = {r.doc_id: r for r in words_bpe.round_trip(df.repartition(3), with_ids=True).collect()}
    for k, t in enumerate(texts):
        ids, r = enc.encode_ordinary(t or ""), got[3 * k]
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == (t or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).collect() == frames.round_trip(empty).collect() == words_bpe.round_trip(empty).collect() == []
