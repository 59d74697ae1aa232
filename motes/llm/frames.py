"""Token ids as files of independent zstandard frames with a trailing seek table.

A file holds, in this order:

* data frames, each a zstandard frame of its own.  Its content is the number of documents (uint32),
  their ids (int64), their token counts (uint32) and all their token ids (uint32), little-endian;
* a skippable frame (magic 0x184D2A50) with the first and last doc_id and the document count of
  every data frame (int64, int64, uint32), so a reader knows which frames a document can be in;
* the seek table (skippable frame 0x184D2A5E): compressed size, size and checksum (low half of the
  content's XXH64) of every data frame, and the nine-byte footer.

Files are written in ascending doc_id order, one per range of doc_id.  A task writes under a name
of its own attempt and moves the file when it is whole, so a task that is run again, or twice at a
time, leaves one whole file.  A null doc_id sorts first and is stored as the smallest int64.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motes.llm.common import PIECES, in_batches, library_encoder, shared_folder, texts, token_path, written

DIRECTORY, SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NO_ID = -(1 << 63)
MANIFEST = "part int, path string, docs long, tokens long, bytes long"


def frame(keys: list[int], counts: np.ndarray, ids: np.ndarray) -> bytes:
    return b"".join([struct.pack("<I", len(keys)), np.asarray(keys, "<i8").tobytes(), counts.astype("<u4").tobytes(),
                     ids.astype("<u4").tobytes()])


def unframe(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", raw)[0]
    return (np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "<u4", n, 4 + 8 * n),
            np.frombuffer(raw, "<u4", -1, 4 + 12 * n))


class Writer:
    def __init__(self, sink, level: int):
        import xxhash
        import zstandard
        self.sink, self.hash = sink, xxhash.xxh64
        self.press = zstandard.ZstdCompressor(level=level)
        self.table, self.directory, self.size = [], [], 0

    def add(self, keys: list[int], counts: np.ndarray, ids: np.ndarray) -> None:
        raw = frame(keys, counts, ids)
        packed = self.press.compress(raw)
        self.sink.write(packed)
        self.size += len(packed)
        self.table.append(struct.pack("<III", len(packed), len(raw), self.hash(raw).intdigest() & 0xFFFFFFFF))
        self.directory.append(struct.pack("<qqI", keys[0], keys[-1], len(keys)))

    def close(self) -> int:
        for magic, body in ((DIRECTORY, b"".join(self.directory)),
                            (SEEK, b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE))):
            self.sink.write(struct.pack("<II", magic, len(body)) + body)
            self.size += 8 + len(body)
        return self.size


class Reader:
    """Reads the two tables at the end of a file, then only the frames that are asked for."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        source.seek(size - 9 - 12 * n - 8)
        kind, length = struct.unpack("<II", source.read(8))
        if kind != SEEK or length != 12 * n + 9:
            raise ValueError("broken seek table")
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        source.seek(size - 17 - 12 * n - 20 * n)
        self.directory = np.frombuffer(source.read(20 * n), [("first", "<i8"), ("last", "<i8"), ("docs", "<u4")])
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])

    def __len__(self):
        return len(self.table)

    def read(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        import xxhash
        import zstandard
        self.source.seek(int(self.starts[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[k, 0])))
        if len(raw) != self.table[k, 1] or xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return unframe(raw)

    def find(self, key: int) -> list[np.ndarray]:
        """The token ids of the rows of one document; opens the frames whose range holds it."""
        out = []
        for k in np.flatnonzero((self.directory["first"] <= key) & (self.directory["last"] >= key)):
            keys, counts, ids = self.read(int(k))
            ends = np.cumsum(counts)
            out += [ids[ends[i] - counts[i]:ends[i]] for i in np.flatnonzero(keys == key)]
        return out


def open_file(path: str):
    """The file behind a URI that every executor sees, and its size."""
    from pyarrow import fs
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at), store.get_file_info(at).size


def write(docs: DataFrame, folder: str, vocab: str | None = None, end_id: int = 2, frame_tokens: int = 1 << 16,
          level: int = 3, memory: int = PIECES) -> DataFrame:
    """Writes the files and returns their list: range number, path, documents, tokens, bytes.

    ``memory``: bytes of encoded words a worker remembers.
    """
    path = vocab or token_path("byte_bpe_50k.json")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext
        task = TaskContext.get()
        part = task.partitionId()
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        own, final = f"{at}/attempt-{task.taskAttemptId()}", f"{at}/part-{part:06d}.tok"
        encode = library_encoder(path, True, memory)
        docs_n = tokens = 0
        keys, counts, held = [], [], []

        with store.open_output_stream(own) as sink:
            out = Writer(sink, level)
            for ids, found in in_batches(batches):
                flat, lens = encode(found)
                end = np.cumsum(lens)
                for key, n, e in zip(ids, lens, end):
                    keys.append(NO_ID if key is None else key)
                    counts.append(int(n) + 1)
                    held += [flat[e - n:e], np.array([end_id], np.uint32)]
                    docs_n, tokens = docs_n + 1, tokens + int(n) + 1
                    if sum(counts) >= frame_tokens or len(keys) >= 4096:
                        out.add(keys, np.array(counts), np.concatenate(held))
                        keys, counts, held = [], [], []
            if keys:
                out.add(keys, np.array(counts), np.concatenate(held))
            size = out.close()
        store.move(own, final)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([f"{folder}/part-{part:06d}.tok"]), pa.array([docs_n], pa.int64()),
             pa.array([tokens], pa.int64()), pa.array([size], pa.int64())], ["part", "path", "docs", "tokens", "bytes"])

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(run, MANIFEST)).where("docs > 0")


def read_back(files: DataFrame) -> DataFrame:
    """Per document, from the files alone: its first place among all ids, its count and checksum."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = files.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                source, size = open_file(path)
                with source:
                    r = Reader(source, size)
                    for k in range(len(r)):
                        keys, counts, ids = r.read(k)
                        ends = np.cumsum(counts, dtype=np.int64)
                        raw = memoryview(ids.tobytes())
                        crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for n, e in zip(counts.tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([None if x == NO_ID else x for x in keys.tolist()], pa.int64()),
                             pa.array(base + ends - counts, pa.int64()), pa.array(counts.astype(np.int64)),
                             pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        base += int(ends[-1]) if len(ends) else 0

    n = max(1, files.sparkSession.sparkContext.defaultParallelism)
    return placed.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Token ids of the requested documents (column doc_id); other frames are never opened."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for path, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                source, size = open_file(path)
                with source:
                    r = Reader(source, size)
                    got = [(i, t.tolist()) for i in ids for t in r.find(i)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()),
                                                      pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["doc_id", "ids"])

    def bounds(batches):
        import pyarrow as pa
        for b in batches:
            for path in b.column(0).to_pylist():
                source, size = open_file(path)
                with source:
                    d = Reader(source, size).directory
                    if len(d):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([int(d["first"][0])], pa.int64()),
                                                          pa.array([int(d["last"][-1])], pa.int64())], ["path", "lo", "hi"])

    lots = files.select("path").mapInArrow(bounds, "path string, lo long, hi long")
    ask = wanted.select("doc_id").where("doc_id is not null").distinct()
    # A file list is a row per file; requests meet the file of their range.
    hit = ask.join(F.broadcast(lots), F.col("doc_id").between(F.col("lo"), F.col("hi")))
    some = hit.groupBy("path", F.expr("pmod(hash(doc_id), 16)").alias("lot")).agg(F.collect_list("doc_id").alias("ids"))
    return some.select("path", "ids").mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """Writes ``docs`` to new files in the shared folder and reads them back.

    Null and empty texts are their end id alone; repeated rows are documents of their own, in any
    order among themselves; no rows give no files and no result.
    """
    return read_back(write(docs, shared_folder(docs.sparkSession), vocab))
