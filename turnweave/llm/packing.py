"""Packing of token sequences by estimated training cost.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention is within a
piece). Documents are packed in groups of neighbouring rows where they are read, so
that no token crosses the network and no key can be hot. In a group of T tokens there
are as many full sequences as T holds, and for the rest one sequence for each power
of two that it is the sum of; such lengths need no padding. Documents longer than a
sequence fill whole ones first. What remains is taken in descending length: each piece
goes to the sequence of the lowest cost so far that has room for it, and only where
none has, it is cut and fills the sequence with the most room.

Each id lies in exactly one piece, offsets in a sequence are gapless from 0, and a
group's bounds (tokens, documents) bound memory; one document is held at a time beyond.

Edge cases: a null text counts as empty and is a document of its end id only; a table
without rows gives no pieces; repeated rows are documents of their own; extra columns
are not read. Group bounds, and with them sequence ids, follow the reader's partitions.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import bound_batches
from turnweave.llm.token_counts import quick_merges
from turnweave.llm.word_tokens import word_tokens

#: Bounds of a group that is packed as a whole.
GROUP_TOKENS, GROUP_DOCUMENTS = 1_500_000, 2_000
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


def pack_lengths(lengths: list[int], capacity: int = 2048, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths; capacity: a power of two."""
    total = sum(lengths)
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (total % capacity) >> b & 1]
    room, cost = np.array(rooms, np.int64), np.zeros(len(rooms))
    used = np.zeros(len(rooms), np.int64)
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(document: int, start: int, length: int, sequence: int) -> None:
        pieces.append((document, start, length, sequence, int(used[sequence])))
        used[sequence] += length
        room[sequence] -= length
        cost[sequence] += linear * length + quadratic * length * length

    waiting, full = [], 0
    for document, length in enumerate(lengths):
        whole = length // capacity
        for k in range(whole):
            put(document, k * capacity, capacity, full)
            full += 1
        if length % capacity:
            waiting.append((-(length % capacity), document, whole * capacity))
    heapq.heapify(waiting)
    while waiting:
        negative, document, start = heapq.heappop(waiting)
        length = -negative
        fits = room >= length
        if fits.any():
            put(document, start, length, int(np.where(fits, cost, np.inf).argmin()))
        else:
            sequence = int(room.argmax())
            part = int(room[sequence])
            put(document, start, part, sequence)
            heapq.heappush(waiting, (part - length, document, start + part))
    return pieces


def pack_documents(
    documents: DataFrame,
    path: str,
    end_id: int,
    *,
    capacity: int = 2048,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    group_tokens: int = GROUP_TOKENS,
    group_documents: int = GROUP_DOCUMENTS,
) -> DataFrame:
    """Pieces of every document: its text's ids, then ``end_id``.

    doc_id, start, length, ids_crc32 (of the piece's ids as little-endian unsigned
    32-bit integers), doc_tokens, sequence_id, offset.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    quick = quick_merges(path)
    kind = documents.schema["doc_id"].dataType.simpleString()
    end = np.array(end_id, "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path, quick)
        first = TaskContext.get().partitionId() << 36  # of this partition's sequences
        keys: list = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal first, size
            lengths = [len(x) // 4 for x in held]
            pieces = pack_lengths(lengths, capacity, linear, quadratic)
            crc = [zlib.crc32(memoryview(held[d])[4 * s : 4 * (s + n)]) for d, s, n, _, _ in pieces]
            of = np.array(pieces, np.int64).reshape(-1, 5)
            columns = [
                pa.array([keys[d] for d in of[:, 0]], types[0]),
                *(pa.array(x, pa.int64()) for x in (of[:, 1], of[:, 2], crc, np.array(lengths, np.int64)[of[:, 0]], first + of[:, 3], of[:, 4])),
            ]
            first += int(of[:, 3].max()) + 1
            keys.clear()
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        names, types = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], [None]
        for batch in batches:
            types[0] = batch.schema.types[0]
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = tokens.ids(value.as_py() or "") + end
                keys.append(key.as_py())
                held.append(ids)
                size += len(ids) // 4
                if size >= group_tokens or len(held) >= group_documents:
                    yield close()
        if held:
            yield close()

    bound_batches(documents)
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(packed, schema)
