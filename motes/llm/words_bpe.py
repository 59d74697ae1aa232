"""Byte-level BPE over a global shuffle of distinct words, and decoding by the token-byte table.

1. A task explodes its texts into pre-tokens and numbers the distinct ones of a chunk.  The
   positions (which word comes where) are packed into one file per chunk in the shared folder; only
   the distinct words travel, as rows (word, chunk, number).
2. Rows are dealt and sorted by word, so every distinct word is encoded once, and its ids go back
   to each chunk that holds it.
3. Each chunk reads its positions and puts the ids in place, document by document.  Decoding looks
   every id up in the table of token bytes.

A chunk file is written under a name of its own attempt and then moved, so tasks may run again.  A
word is sent once per chunk, however often it occurs, so a hot word costs a row per chunk.  Null
and empty texts have no ids; repeated rows give repeated results; no rows give none.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from motes.llm.common import PieceEncoder, _Slots, in_batches, shared_folder, texts, token_path

CHUNK_CHARS = 24_000_000
WORDS = "word string, chunk long, local int"
IDS = "chunk long, locals binary, counts binary, ids binary"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def word_encoder(path: str, pattern: str):
    import tiktoken
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary


def pack_positions(keys: list, counts: np.ndarray, stream: np.ndarray) -> bytes:
    """Documents, their word counts and the words in order; byte planes compress better than numbers."""
    import zstandard
    nulls = np.array([k is None for k in keys], np.uint8)
    ids = np.array([0 if k is None else k for k in keys], "<i8")
    planes = np.ascontiguousarray(stream.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    head = np.array([len(keys), len(stream)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(
        head + ids.tobytes() + nulls.tobytes() + counts.astype("<i8").tobytes() + planes.tobytes())


def unpack_positions(raw: bytes):
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, m = np.frombuffer(raw, "<i8", 2).tolist()
    ids = np.frombuffer(raw, "<i8", n, 16)
    nulls = np.frombuffer(raw, np.uint8, n, 16 + 8 * n)
    counts = np.frombuffer(raw, "<i8", n, 16 + 9 * n)
    planes = np.frombuffer(raw, np.uint8, 4 * m, 16 + 17 * n).reshape(4, m)
    stream = np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    return [None if z else i for i, z in zip(ids.tolist(), nulls.tolist())], counts, stream


def opened(raw: bytes) -> np.ndarray:
    """Numbers that were squeezed as byte planes."""
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def distinct_words(docs: DataFrame, folder: str, pattern: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        import regex
        from pyarrow import fs
        from pyspark import TaskContext
        task = TaskContext.get()
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        find = regex.compile(pattern).findall
        made = 0

        def fresh():
            words = _Slots()
            number = words.__getitem__
            return words, PieceEncoder(lambda new: [[number(w) for w in find(p)] for p in new], True, 1 << 60)

        def flush():
            nonlocal made
            chunk = (task.partitionId() << 20) | made
            made += 1
            body = pack_positions(keys, np.concatenate(counts), np.concatenate(streams))
            own = f"{at}/attempt-{task.taskAttemptId()}-{made}"
            with store.open_output_stream(own) as f:
                f.write(body)
            store.move(own, f"{at}/{chunk}")
            # A chunk without words is sent too: by the empty word.
            listed = [*words, ""]
            for k in range(0, len(listed), 50_000):
                part = listed[k:k + 50_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(n, chunk)),
                                                  pa.array(np.arange(k, k + n), pa.int32())], ["word", "chunk", "local"])

        words, encode = fresh()
        keys, counts, streams, held = [], [], [], 0
        for ids, found in in_batches(batches):
            stream, lens = encode(found)
            keys += ids
            counts.append(lens)
            streams.append(stream)
            held += sum(map(len, found))
            if held >= CHUNK_CHARS:
                yield from flush()
                words, encode = fresh()
                keys, counts, streams, held = [], [], [], 0
        if keys:
            yield from flush()

    return texts(docs).mapInArrow(run, WORDS)


def encoded_words(words: DataFrame, vocab: str, pattern: str) -> DataFrame:
    """The ids of every word, encoded once, gathered by the chunk they go to."""
    def run(batches):
        import pyarrow as pa
        import zstandard
        encode, press = word_encoder(vocab, pattern), zstandard.ZstdCompressor(level=3)
        last, last_ids = None, []

        def squeezed(a: np.ndarray) -> bytes:
            return press.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())

        def dealt(rows):
            chunks, locals_, found = (np.concatenate(c) if c is not rows[2] else sum(c, []) for c in rows)
            order = np.argsort(chunks, kind="stable")
            edges = np.flatnonzero(np.diff(chunks[order])) + 1
            for part in np.split(order, edges):
                part = part[np.argsort(locals_[part])]
                ids = [found[k] for k in part]
                yield (int(chunks[part[0]]), squeezed(np.diff(locals_[part], prepend=0)), squeezed(np.array([len(i) for i in ids])),
                       squeezed(np.array([x for i in ids for x in i], np.int64)))

        def out(rows):
            cols = list(zip(*dealt(rows)))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                                              ["chunk", "locals", "counts", "ids"])

        rows, held = ([], [], []), 0
        for b in batches:
            found = []
            for w in b.column(0).to_pylist():
                if w != last:
                    last, last_ids = w, encode(w)
                found.append(last_ids)
            rows[0].append(b.column(1).to_numpy())
            rows[1].append(b.column(2).to_numpy())
            rows[2].append(found)
            held += b.num_rows
            if held >= 300_000:
                yield out(rows)
                rows, held = ([], [], []), 0
        if held:
            yield out(rows)

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, IDS)


def assembled(ids: DataFrame, folder: str, vocab: str, with_ids: bool) -> DataFrame:
    def place(pdf):
        import pandas as pd
        from pyarrow import fs

        from motes.llm.common import ragged
        store, at = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{at}/{int(pdf.chunk.iloc[0])}") as f:
            keys, counts, stream = unpack_positions(f.read())
        local = np.concatenate([np.cumsum(b.astype(np.int64)) for b in map(opened, pdf.locals)])
        n = np.concatenate([opened(b) for b in pdf.counts]).astype(np.int64)
        flat = np.concatenate([opened(b) for b in pdf.ids])
        start, lens = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
        start[local], lens[local] = np.cumsum(n) - n, n
        table = {i: b for b, i in ranks(vocab).items()}
        width = max(table) + 1 if table else 0
        token_bytes = [table.get(i, b"") for i in range(width)]
        out, pos = [], 0
        for key, c in zip(keys, counts.tolist()):
            words = stream[pos:pos + c]
            pos += c
            own = flat[ragged(start[words], lens[words])] if c else flat[:0]
            raw = b"".join(map(token_bytes.__getitem__, own.tolist()))
            row = (key, len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
            out.append((*row, own.astype(np.int64), raw.decode("utf-8", "replace")) if with_ids else row)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
        got = pd.DataFrame(out, columns=names[:4] + (["ids", "decoded"] if with_ids else []))
        return got.astype({"doc_id": "Int64"})

    return ids.groupBy("chunk").applyInPandas(place, RESULT + (", ids array<long>, decoded string" if with_ids else ""))


def round_trip(docs: DataFrame, vocab: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per document: token count, checksum of its ids and of the bytes they decode to.

    ``with_ids`` adds the ids and the decoded text themselves.
    """
    import public_tokenizers
    vocab = vocab or token_path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    folder = shared_folder(docs.sparkSession)
    ids = encoded_words(distinct_words(docs, folder, pattern), vocab, pattern)
    return assembled(ids, folder, vocab, with_ids)
