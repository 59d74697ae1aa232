"""Cost-balanced packing of documents into token sequences.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n`` (projections and attention).
Pieces are taken by descending cost; each goes to the sequence of the lowest cost that still has
room for it.  What fits nowhere whole is cut to fill the rooms that are left, so sequences are full.

Every task packs the rows it reads, a group of sequences at a time, and carries the tokens that
fill no whole sequence to its next group; nothing is shuffled and no group is gathered.  The last
tokens of a task are cut into sequences whose lengths are powers of two, which need no padding.
Texts may be null or empty (such a document is its end id alone), repeated rows are packed each for
itself, a document longer than a sequence is cut, and no rows give no sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

from motes.llm.common import PIECES, in_batches, library_encoder, texts, token_path

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, sequence_cost double")


def assign(lengths: list[int], count: int, capacity: int, linear: float, quadratic: float):
    """Sequence of every piece, -1 where none has room; also the cost and room of each sequence."""
    cost, room = np.zeros(count), np.full(count, capacity)
    to = np.full(len(lengths), -1)
    each = [linear * n + quadratic * n * n for n in lengths]
    for k in sorted(range(len(lengths)), key=lambda k: (-each[k], k)):
        fits = np.where(room >= lengths[k], cost, np.inf)
        s = int(np.argmin(fits)) if count else 0
        if count and fits[s] < np.inf:
            to[k] = s
            cost[s] += each[k]
            room[s] -= lengths[k]
    return to, cost, room


def place(pieces: list[tuple[int, int]], capacity: int, linear: float, quadratic: float):
    """Pieces (document, length) in order of need -> rows (document, length, sequence) that fill
    ``total // capacity`` sequences exactly, and the pieces that are left over."""
    count = sum(n for _, n in pieces) // capacity
    to, cost, room = assign([n for _, n in pieces], count, capacity, linear, quadratic)
    rows = [(d, n, int(s)) for (d, n), s in zip(pieces, to) if s >= 0]
    rest = sorted(((n, d) for (d, n), s in zip(pieces, to) if s < 0), reverse=True)
    left = []
    gaps = [int(s) for s in np.argsort(cost, kind="stable") if room[s] > 0]
    for n, d in rest:
        while n and gaps:
            s = gaps[0]
            cut = min(n, int(room[s]))
            rows.append((d, cut, s))
            room[s] -= cut
            n -= cut
            if not room[s]:
                gaps.pop(0)
        if n:
            left.append((d, n))
    return rows, left, count


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = 4096, end_id: int = 2, linear: float = 1.0,
         quadratic: float = 1 / 4096, group: int = 128, with_ids: bool = False, memory: int = PIECES) -> DataFrame:
    """One row per piece: document, place in the document, place in its sequence, checksum, cost of the sequence.

    ``group``: sequences that are balanced at a time.  ``with_ids`` adds the piece's ids.
    ``memory``: bytes of encoded words a worker remembers.
    """
    path = vocab or token_path("word_bpe_49k.json")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        encode = library_encoder(path, False, memory)
        base = TaskContext.get().partitionId() << 40
        made = 0
        #: Each waiting document: [doc_id, its remaining ids, ids before them, all its ids].
        waiting: list[list] = []

        def emit(rows, count):
            nonlocal made
            filled = np.zeros(count, np.int64)
            cost = np.zeros(count)
            for _, n, s in rows:
                cost[s] += linear * n + quadratic * n * n
            out = []
            for k, n, s in rows:
                w = waiting[k]
                ids = w[1][:n]
                out.append((w[0], w[2], n, zlib.crc32(ids.tobytes()), w[3], base + made + s, int(filled[s]),
                            float(cost[s]), ids))
                w[1], w[2] = w[1][n:], w[2] + n
                filled[s] += n
            made += count
            cols = list(zip(*out)) if out else [[]] * 9
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_cost"]
            arrays = [pa.array(c, pa.float64() if m == "sequence_cost" else pa.int64()) for c, m in zip(cols, names)]
            if with_ids:
                arrays.append(pa.array(cols[8], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        def full():
            """Whole sequences out of single documents, then the balanced ones."""
            nonlocal waiting
            rows, s = [], 0
            for k, w in enumerate(waiting):
                for _ in range(len(w[1]) // capacity):
                    rows.append((k, capacity, s))
                    s += 1
            if rows:
                yield emit(rows, s)
            rows, _, count = place([(k, len(w[1])) for k, w in enumerate(waiting) if len(w[1])], capacity, linear,
                                   quadratic)
            if rows:
                yield emit(rows, count)
            waiting = [w for w in waiting if len(w[1])]

        held = 0
        for keys, docs in in_batches(batches):
            ids, counts = encode(docs)
            at = 0
            for key, n in zip(keys, counts):
                own = np.append(ids[at:at + n], end_id).astype("<u4")
                at += n
                waiting.append([key, own, 0, len(own)])
                held += len(own)
                if held >= group * capacity:
                    yield from full()
                    held = sum(len(w[1]) for w in waiting)
        yield from full()
        rows, s = [], 0
        size = 1 << (capacity.bit_length() - 1)
        spare = [[k, len(w[1])] for k, w in enumerate(waiting)]
        left = sum(n for _, n in spare)
        while left:
            while size > left:
                size >>= 1
            need = size
            while need:
                cut = min(need, spare[0][1])
                rows.append((spare[0][0], cut, s))
                spare[0][1] -= cut
                need -= cut
                if not spare[0][1]:
                    spare.pop(0)
            left -= size
            s += 1
        if rows:
            yield emit(rows, s)

    return texts(docs).mapInArrow(run, SCHEMA + (", ids array<long>" if with_ids else ""))
