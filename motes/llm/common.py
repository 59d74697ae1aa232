"""What the training-data operators share: input columns, the shared folder, the piece-wise encoder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache, wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the whole text; a null text is the empty text.  Other columns are left out."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def reserved(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, under ``spark.checkpoint.dir``.

    The setting is read from the session; only a local session without it (a test) gets a
    temporary folder.  What is written there goes when the application ends.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="motes-shared-")
        sc.setCheckpointDir(root)
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{os.path.abspath(root)}"
    path = f"{root.rstrip('/')}/motes-{sc.applicationId}/{uuid.uuid4().hex}"
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    if _record is not None:
        _record.append(path)
    return path


_record: list[str] | None = None


@contextmanager
def recorded(paths: list[str]):
    """Adds the shared folders that are made inside to ``paths``."""
    global _record
    before, _record = _record, paths
    try:
        yield
    finally:
        _record = before


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes shared folders that nothing reads any more."""
    sc = spark.sparkContext
    while paths:
        jpath = sc._jvm.org.apache.hadoop.fs.Path(paths.pop())
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, and a lost executor costs a read."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def token_path(name: str) -> str:
    """Where the installed public vocabulary files lie; every operator takes the path as a parameter."""
    import public_tokenizers
    return public_tokenizers.path(name)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + len)."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


class _Slots(dict):
    """Numbers new keys in the order they are met."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key):
        slot = self[key] = len(self)
        self.new.append(key)
        return slot


def numbered(lists: list[list], total: int) -> np.ndarray:
    """The items of all lists as numbers, equal items with equal ones."""
    get = _Slots().__getitem__
    return np.fromiter((n for items in lists for n in map(get, items)), np.int64, total)


#: Bytes of pieces that a worker of an operator remembers.
PIECES = 256_000_000
#: Bytes of a remembered piece besides its characters and ids: dictionary entry, string header, numbers.
PIECE_BYTES = 220


class PieceEncoder:
    """Whole texts to ids; every distinct piece between single spaces is encoded once per worker.

    A space with non-space characters on both sides is always a border between pre-tokens, so the
    ids of a text are those of its pieces, one after the other.  ``spaced`` vocabularies keep the
    space at the front of the piece; the others drop white space.  Pieces that begin or end with
    white space make their text take the general split.  The memory of pieces holds ``limit`` bytes;
    beyond that the pieces used least go until half of it is free, and the counts of use are halved.
    """

    def __init__(self, encode, spaced: bool, limit: int):
        self.encode, self.spaced, self.limit = encode, spaced, limit
        self.slots, self.held = _Slots(), 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 12, np.int64)
        self.lens = np.zeros(1 << 12, np.int64)
        self.odd = np.zeros(1 << 12, bool)
        self.uses = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _evict(self):
        n = len(self.slots)
        pieces, uses, lens = list(self.slots), self.uses[:n], self.lens[:n]
        size = np.fromiter(map(len, pieces), np.int64, n) + 4 * lens + PIECE_BYTES
        order = np.argsort(-uses, kind="stable")
        kept = np.sort(order[np.cumsum(size[order]) <= self.limit // 2])
        self.slots = _Slots()
        self.slots.update(zip((pieces[k] for k in kept.tolist()), range(len(kept))))
        flat = self.flat[ragged(self.start[kept], lens[kept])]
        self.used, self.held = len(flat), int(size[kept].sum())
        self.flat = np.concatenate([flat, np.zeros(1 << 16, np.uint32)])
        uses, lens, odd = uses[kept] // 2, lens[kept], self.odd[kept]
        room = (0, len(kept) + (1 << 12))
        self.uses, self.lens, self.odd, self.start = (np.pad(a, room) for a in (uses, lens, odd, np.cumsum(lens) - lens))

    def _fill(self):
        new = self.slots.new
        if not new:
            return
        self.slots.new = []
        at, n = len(self.slots) - len(new), len(self.slots)
        found = self.encode(new)
        lens = np.fromiter(map(len, found), np.int64, len(new))
        total = self.used + int(lens.sum())
        if n > len(self.start):
            size = max(n, 2 * len(self.start))
            self.start, self.lens, self.odd, self.uses = (np.pad(a, (0, size - len(a))) for a in (self.start, self.lens, self.odd, self.uses))
        if total > len(self.flat):
            self.flat = np.resize(self.flat, max(total, 2 * len(self.flat)))
        self.flat[self.used:total] = np.fromiter((i for f in found for i in f), np.uint32, total - self.used)
        self.lens[at:n] = lens
        self.start[at:n] = self.used + np.cumsum(lens) - lens
        self.odd[at:n] = [p[1:2].isspace() or p[-1:].isspace() if p[:1] == " " else p[-1:].isspace() for p in new]
        self.used = total
        self.held += sum(map(len, new)) + 4 * int(lens.sum()) + PIECE_BYTES * len(new)

    def _split(self, text: str) -> list[str]:
        """The general split, for texts in which white space stands side by side."""
        out, parts = [], text.split(" ")
        for k, p in enumerate(parts):
            if k and (not p or p[0].isspace() or not parts[k - 1] or parts[k - 1][-1].isspace()):
                out[-1] += " " + p
            else:
                out.append(" " + p if k else p)
        return out

    def __call__(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the number of ids of each text."""
        if self.held > self.limit:
            self._evict()
        get = self.slots.__getitem__
        per = []
        for t in batch:
            if self.spaced:
                parts = t.replace(" ", "\0 ").split("\0") if "\0" not in t else [t]
            else:
                parts = t.split(" ")
            per.append(np.fromiter(map(get, parts), np.int64, len(parts)))
        self._fill()
        if self.spaced:
            for k, s in enumerate(per):
                if self.odd[s].any():
                    parts = self._split(batch[k])
                    per[k] = np.fromiter(map(get, parts), np.int64, len(parts))
            self._fill()
        counts = np.array([len(s) for s in per], np.int64)
        slots = np.concatenate(per) if per else np.zeros(0, np.int64)
        if len(slots):
            seen = np.bincount(slots)
            self.uses[:len(seen)] += seen
        lens = self.lens[slots]
        ids = self.flat[ragged(self.start[slots], lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])
        edge = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(ends[edge])


@lru_cache(maxsize=4)
def library_encoder(path: str, spaced: bool, limit: int = PIECES) -> PieceEncoder:
    """The encoder of a vocabulary file of the tokenizers library, one per worker; its pieces hold ``limit`` bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return PieceEncoder(lambda new: [e.ids for e in tok.encode_batch_fast(new, add_special_tokens=False)], spaced, limit)


def fresh_worker() -> None:
    """Frees the pieces that an earlier stage's tasks left in this reused worker."""
    if library_encoder.cache_info().currsize:
        library_encoder.cache_clear()
        gc.collect()


def lean(run):
    """The task function ``run`` of an Arrow map; its worker, which later stages reuse, hands freed memory back at both ends."""
    @wraps(run)
    def task(batches):
        fresh_worker()
        _trim()
        try:
            yield from run(batches)
        finally:
            _trim()
    return task


def _trim() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def in_batches(batches, limit: int = 4_000_000):
    """Columns of Arrow batches as Python lists, cut so that a slice holds about ``limit`` characters.

    The first column is the key, the second the text.
    """
    for b in batches:
        import pyarrow.compute as pc
        size = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False)) if b.num_rows else []
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            part = b.slice(at, to - at)
            yield [c.to_pylist() for c in part.columns]
            at = to
