"""Packing of documents into sequences of a fixed capacity by Karmarkar-Karp differencing.

Each document is encoded, ended by id 0, and cut at the capacity: full cuts are sequences of their
own, and what remains is cut into pieces of at most PIECE ids. Pieces are packed in groups of
consecutive documents: partial partitions (one sum per window) lie in a heap by imbalance; the two most
imbalanced are merged, the largest windows of one with the smallest of the other, until one is left.
Its windows are nearly equal. If one exceeds the capacity, the window count rises by one and the group
is packed again. A group closes when its pieces fill WINDOWS windows, so groups are bounded, and
packing is local to a task: no shuffle, and sequences never cross tasks. Ids of sequences are the
task's partition number and a counter, so they repeat if a lost task runs again on the same input.

Defined cases: null and empty texts are the single id 0. Repeated rows are packed each on its own. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm.bpe import encoded
from tessella.llm.common import table

CAPACITY = 1024
#: Ids in a piece of a document's remainder at most.
PIECE = 128
#: Windows of a group.
WINDOWS = 256
#: Free ids that a group leaves in each window on average, so that near-equal windows fit.
MARGIN = 4


def differencing(sizes: list[int], windows: int) -> tuple[list[list[int]], list[int]]:
    """Items of each window and the windows' sums, by multiway differencing.

    A partial partition is the vector of its windows' sums in ascending order. Merges only note how
    windows were put together; the items of each window are read off at the end, from the last merge down.
    """
    if not sizes:
        return [], []
    heap: list[tuple[int, int]] = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []

    def take() -> tuple[int, np.ndarray]:
        i = heapq.heappop(heap)[1]
        if i >= len(sizes):
            return i, sums.pop(i)
        alone = np.zeros(windows, np.int64)
        alone[-1] = sizes[i]
        return i, alone

    while len(heap) > 1:
        (i, a), (j, b) = take(), take()
        both = a + b[::-1]
        order = both.argsort(kind="stable")
        both = both[order]
        new = len(sizes) + len(merges)
        merges.append((i, j, order))
        sums[new] = both
        heapq.heappush(heap, (int(both[0] - both[-1]), new))
    last, total = take()
    place = {last: np.arange(windows)}  # final window of each window of a partial partition
    items: list[list[int]] = [[] for _ in range(windows)]
    for new in range(last, len(sizes) - 1, -1):
        i, j, order = merges[new - len(sizes)]
        at = np.empty(windows, np.int64)
        at[order] = place.pop(new)
        place[i], place[j] = at, at[::-1]
    for i, at in place.items():
        items[at[-1]].append(i)
    return items, total.tolist()


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers, each within the capacity; the window count rises until all fit."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        items, sums = differencing(sizes, windows)
        if not sums or max(sums) <= capacity:
            return [x for x in items if x]
        windows += 1


PIECES = "key {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, crc of its ids, doc_tokens, sequence_id, offset (and ids if asked)."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = PIECES.format(kind) + (", ids binary" if with_ids else "")
    end = np.zeros(1, "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        waiting: list[tuple[object, int, int, bytes]] = []  # key, start, document's ids, ids of the piece
        held = 0

        def close() -> None:
            nonlocal sequence, held
            for window in pack([len(p[3]) // 4 for p in waiting], capacity):
                offset = 0
                for i in window:
                    k, start, total, ids = waiting[i]
                    out.append((k, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, ids))
                    offset += len(ids) // 4
                sequence += 1
            waiting.clear()
            held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            fields = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if with_ids:
                fields.append(pa.array(columns[7], pa.binary()))
            out.clear()
            return pa.RecordBatch.from_arrays(fields, names=[f.split()[0] for f in schema.split(", ")])

        key_type = None
        full = WINDOWS * (capacity - MARGIN)
        for part, rows, _ in encoded(batches, path):
            key_type = part.column("key").type
            for k, ids in zip(part.column("key").to_pylist(), rows):
                ids += end
                total = len(ids) // 4
                whole = total // capacity * capacity
                for start in range(0, whole, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    out.append((k, start, capacity, zlib.crc32(piece), total, sequence, 0, piece))
                    sequence += 1
                start = whole
                while start < total:
                    # The piece that fills the group is cut where the group is full.
                    size = min(PIECE, total - start, full - held)
                    waiting.append((k, start, total, ids[4 * start : 4 * (start + size)]))
                    held += size
                    start += size
                    if held >= full:
                        close()
            if len(out) >= 5000:
                yield flush()
        if waiting:
            close()
        if out:
            yield flush()

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of CAPACITY ids.

    Null and empty texts are one piece of the end's id alone; null and repeated doc_ids and equal rows are packed each on its own;
    an empty table gives no pieces; other columns are ignored.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
