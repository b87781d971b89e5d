"""The packed form of an index: one byte for each genome and bucket, compared column by column.

A column holds the fingerprints of one block of 2**BLOCK_BITS consecutive genome ids in one bucket, EMPTY where a genome has
none, up to the last that has one. Ids are meant to be dense, as list positions are; a block of few ids is short.

Build: the sketch kernel of a task writes its genomes' fingerprints transposed (bucket by bucket, three bytes each), with one row
for each genome and the filter's bits, so that sequences are read once and no row of a single fingerprint is shuffled.
Parts of a column meet in a shuffle by ranges of buckets and are laid into bytes.

Search: queries are put into packs, each bucket of a pack in one row, joined to the columns on the bucket (broadcast
behind a count), and compared with whole columns in a kernel that adds to one vector of counts for each query and block. Vectors
of several bucket ranges are added by (query, block). What is shuffled is the queries and their counts, never a match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions import hashing
from tessella.operators import kmers
from tessella.params import SketchParams
from tessella.shared import broadcast_if_small

#: log2 of the genomes of a block, and the byte of an empty place.
BLOCK_BITS = 14
EMPTY = 255
#: Queries of a pack, about: a task holds one vector of counts for each at a time.
PACK = 256
#: Fingerprints that the build kernel holds, in eight bytes each, before it writes them transposed.
HELD = 2_000_000
#: Hashes whose filter cells are worked out at once, and words of the filter in a batch.
HASHES = 1 << 17
WORDS = 1 << 17
#: Bytes of columns that a kernel takes from a batch at once, about.
COLUMN_BYTES = 8 << 20
#: Rows of queries (a pack in a bucket, a few kB) up to which they are broadcast.
SMALL = 10_000

#: Kinds of rows of parts(): a part of a column (block, bucket), a genome (id, letters), a word of the filter (place, bits).
COLUMN, GENOME, WORD = 0, 1, 2
_PART = np.dtype([("slot", "<u2"), ("fp", "u1")])
_COUNT = np.dtype([("slot", "<u2"), ("n", "<u4")])


def _binaries(rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary for each run of fixed-size records that begins at `starts`."""
    offsets = np.r_[starts, len(rows)].astype(np.int32) * rows.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _filter_size(params: SketchParams) -> int:
    """Words of the filter that probes of k-mers can be in: a cell stands for a k-mer's leading bits, so they are at most 2**21 + 1."""
    return (4**params.k + 1023 >> params.log2_bloom + 3 >> 6) + 1


def _set_cells(words: np.ndarray, h: np.ndarray, params: SketchParams) -> None:
    """Set in 64-bit words the cells that the probes of hashes touch."""
    for a in range(0, len(h), HASHES):
        some = h[a : a + HASHES]
        first, mixed = kmers.hash64(some, hashing.UNMIX64), kmers.hash64(some, hashing.MIX64)
        cells = [(first + (np.uint64(69 * i) * mixed & np.uint64(1023))) >> np.uint64(params.log2_bloom + 3) for i in range(hashing.BLOOM_HASHES)]
        # Probes lie close together, so that most are of one cell.
        cells = np.unique(np.concatenate([cells[0], *(c[c != cells[0]] for c in cells[1:])]))
        of = (cells >> np.uint64(6)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        words[of[starts]] |= np.bitwise_or.reduceat(np.uint64(1) << (cells & np.uint64(63)), starts)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = COLUMN_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices with about so many bytes of a column, or one row; what a kernel makes of a slice is bounded."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def parts(genomes: DataFrame, params: SketchParams) -> DataFrame:
    """kind, a, b, size, weight, data of genomes(genome_id, name, seq): column parts, genomes and words of the filter.

    A genome's row has its letters (b), filled buckets (size), the sum of 2**-exponent over them (weight) and its name (data).
    """
    source = genomes.select(F.col("genome_id").cast("long").alias("id"), F.col("name").cast("string").alias("name"), F.col("seq").cast("string").alias("seq")).where("seq IS NOT NULL")
    names = ["kind", "a", "b", "size", "weight", "data"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]

    def table(kind: int, a: np.ndarray, b: np.ndarray, size=None, weight=None, data=None) -> pa.RecordBatch:
        n = len(a)
        columns = [np.full(n, kind, np.int32), a, b, size, weight, data]
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Fingerprints as numbers: place of the block among those held, bucket, slot, fingerprint. What is left for places is more
        # than sketches_of() takes sequences together.
        bits = params.log2_buckets
        most = 1 << (64 - bits - BLOCK_BITS - 8)
        held: list[np.ndarray] = []
        blocks: dict[int, int] = {}
        words = np.zeros(_filter_size(params), np.uint64)
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if size:
                keys = np.concatenate(held)
                held = []
                keys.sort()
                rows = np.empty(len(keys), _PART)
                rows["slot"], rows["fp"] = (keys >> np.uint64(8)) & np.uint64((1 << BLOCK_BITS) - 1), keys & np.uint64(255)
                keys >>= np.uint64(BLOCK_BITS + 8)
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                keys = keys[starts].astype(np.int64)
                yield table(COLUMN, np.array(list(blocks), np.int64)[keys >> bits], keys & ((1 << bits) - 1), data=_binaries(rows, starts))
            held, size = [], 0
            blocks.clear()

        for batch in by_bytes(batches, "seq"):
            ids = batch.column("id").to_numpy()
            seqs = [kmers.letters(s) for s in batch.column("seq").to_pylist()]
            filled, weights = np.zeros(len(seqs), np.int64), np.zeros(len(seqs))
            for rows, bucket, fp, h in kmers.sketches_of(seqs, params):
                filled += np.bincount(rows, minlength=len(seqs))
                # Sums of powers of two are exact in any order.
                weights += np.bincount(rows, np.ldexp(1.0, -(fp >> params.mantissa)), len(seqs))
                _set_cells(words, h.view(np.uint64), params)
                of, place = np.unique(ids[rows] >> BLOCK_BITS, return_inverse=True)
                if len(blocks) + len(of) > most:
                    yield from done()
                place = np.array([blocks.setdefault(x, len(blocks)) for x in of.tolist()], np.uint64)[place]
                slot = (ids[rows] & ((1 << BLOCK_BITS) - 1)).astype(np.uint64)
                held.append(((place << np.uint64(bits) | bucket.astype(np.uint64)) << np.uint64(BLOCK_BITS) | slot) << np.uint64(8) | fp.astype(np.uint64))
                size += len(rows)
                if size >= HELD:
                    yield from done()
            names_ = [None if x is None else x.encode() for x in batch.column("name").to_pylist()]
            yield table(GENOME, ids, np.array([len(s) for s in seqs]), filled, weights, pa.array(names_, pa.binary()))
        yield from done()
        places = np.flatnonzero(words)
        for a in range(0, len(places), WORDS):
            yield table(WORD, places[a : a + WORDS], words[places[a : a + WORDS]].view(np.int64))

    return source.mapInArrow(run, "kind int, a long, b long, size long, weight double, data binary")


def filter_words(made: DataFrame) -> DataFrame:
    """word, mask of the filter from parts()."""
    return made.where(F.col("kind") == WORD).groupBy(F.col("a").alias("word")).agg(F.expr("bit_or(b)").alias("mask"))


def packed(made: DataFrame) -> DataFrame:
    """block, bucket, fps from parts(): whole columns, in ranges of buckets."""
    rows = made.where(F.col("kind") == COLUMN).select(F.col("a").alias("block"), F.col("b").alias("bucket"), "data")
    dealt = rows.repartitionByRange("bucket", "block").sortWithinPartitions("block", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def laid() -> bytes:
            rows = np.frombuffer(b"".join(held), _PART)
            out = np.full(int(rows["slot"].max()) + 1, EMPTY, np.uint8)
            out[rows["slot"]] = rows["fp"]
            return out.tobytes()

        for batch in by_bytes(batches, "data"):
            out = []
            for block, bucket, data in zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
                if (block, bucket) != at:
                    if held:
                        out.append((*at, laid()))
                    at, held = (block, bucket), []
                held.append(data)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([(*at, laid())])

    return dealt.mapInArrow(run, "block long, bucket long, fps binary")


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["block", "bucket", "fps"])


def of_rows(sketch: DataFrame) -> DataFrame:
    """Columns of a sketch table(genome_id, bucket, fp)."""
    slot = F.col("genome_id").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    # Slot and fingerprint as the three bytes of a part.
    data = F.unhex(F.format_string("%02x%02x%02x", slot.bitwiseAND(F.lit(255)), F.shiftright(slot, 8), F.col("fp")))
    return packed(sketch.select(F.lit(COLUMN).alias("kind"), F.shiftright("genome_id", BLOCK_BITS).alias("a"), F.col("bucket").alias("b"), data.alias("data")))


def to_rows(columns: DataFrame) -> DataFrame:
    """genome_id, bucket, fp of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, bucket, fps in zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), batch.column("fps").to_pylist()):
                all_fps = np.frombuffer(fps, np.uint8)
                slots = np.flatnonzero(all_fps != EMPTY)
                columns_ = [slots + (block << BLOCK_BITS), np.full(len(slots), bucket), all_fps[slots].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns_], names=["genome_id", "bucket", "fp"])

    return columns.select("block", "bucket", "fps").mapInArrow(run, "genome_id long, bucket long, fp int")


# ---- search


def query_packs(q: DataFrame) -> DataFrame:
    """bucket, pack, ids, fps: of q(query_id, bucket, fp) the queries of a pack that have a bucket, and their fingerprints."""
    n = q.agg(F.approx_count_distinct("query_id")).first()[0]
    pack = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // PACK)))).cast("int")
    entries = F.array_sort(F.collect_list(F.struct(F.col("query_id").cast("long").alias("id"), "fp")))
    return q.groupBy("bucket", pack.alias("pack")).agg(entries.alias("e")).select("bucket", "pack", F.col("e.id").alias("ids"), F.col("e.fp").alias("fps_asked"))


def _vector(counts: np.ndarray) -> bytes:
    """A vector of counts as bytes: sparse or 16 bits or 32 bits, by its first byte, whichever is short."""
    some = np.flatnonzero(counts)
    if len(some) * _COUNT.itemsize < 2 * len(counts):
        rows = np.empty(len(some), _COUNT)
        rows["slot"], rows["n"] = some, counts[some]
        return b"s" + rows.tobytes()
    return b"h" + counts.astype("<u2").tobytes() if counts.max() < 1 << 16 else b"i" + counts.astype("<u4").tobytes()


def _add(total: np.ndarray, data: bytes) -> None:
    if data[:1] == b"s":
        rows = np.frombuffer(data, _COUNT, offset=1)
        total[rows["slot"]] += rows["n"]
    else:
        part = np.frombuffer(data, "<u2" if data[:1] == b"h" else "<u4", offset=1)
        total[: len(part)] += part


def compare(joined: DataFrame) -> DataFrame:
    """query_id, block, counts: vectors of equal fingerprints, from rows(block, pack, fps, ids, fps_asked) of packs and columns.

    Rows are sorted by (block, pack) within their partitions; a task holds the vectors of one pack and block.
    """
    width = 1 << BLOCK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        of: dict[int, int] = {}
        small: list[np.ndarray] = []  # 8-bit counts of the last rows, added up before they could overflow
        large: list[np.ndarray] = []
        rows = 0

        def gather() -> None:
            nonlocal rows
            for s, t in zip(small, large):
                t += s
                s[:] = 0
            rows = 0

        def done() -> Iterator[pa.RecordBatch]:
            gather()
            some = [i for i in of.values() if large[i].any()]
            ids = list(of)
            if some:
                data = [_vector(np.trim_zeros(large[i], "b")) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some], pa.int64()), pa.array([at[0]] * len(some), pa.int64()), pa.array(data, pa.binary())], names=["query_id", "block", "counts"])

        for batch in by_bytes(batches, "fps"):
            columns = (batch.column(c).to_pylist() for c in ("block", "pack", "fps"))
            for i, (block, pack, fps) in enumerate(zip(*columns)):
                if (block, pack) != at:
                    if at is not None:
                        yield from done()
                    at, of, small, large, rows = (block, pack), {}, [], [], 0
                column = np.frombuffer(fps, np.uint8)
                ids, asked = batch.column("ids")[i].values.to_numpy(), batch.column("fps_asked")[i].values.to_numpy()
                equal: dict[int, np.ndarray] = {}
                for id_, fp in zip(ids.tolist(), asked.tolist()):
                    k = of.setdefault(id_, len(of))
                    if k == len(small):
                        small.append(np.zeros(width, np.uint8))
                        large.append(np.zeros(width, np.uint32))
                    if fp not in equal:
                        equal[fp] = (column == fp).view(np.uint8)
                    small[k][: len(column)] += equal[fp]
                rows += 1
                if rows == 255:
                    gather()
        if at is not None:
            yield from done()

    return joined.select("block", "pack", "fps", "ids", "fps_asked").mapInArrow(run, "query_id long, block long, counts binary")


def added(vectors: DataFrame, least: int) -> DataFrame:
    """query_id, genome_id, matches of at least `least`, from vectors of several bucket ranges."""
    dealt = vectors.repartition("query_id", "block").sortWithinPartitions("query_id", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(1 << BLOCK_BITS, np.uint32)

        def done() -> Iterator[pa.RecordBatch]:
            slots = np.flatnonzero(total >= max(least, 1))
            if len(slots):
                columns = [np.full(len(slots), at[0]), slots + (at[1] << BLOCK_BITS), total[slots].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "genome_id", "matches"])
            total[:] = 0

        for batch in by_bytes(batches, "counts"):
            for query, block, counts in zip(batch.column("query_id").to_pylist(), batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                if (query, block) != at:
                    if at is not None:
                        yield from done()
                    at = query, block
                _add(total, counts)
        if at is not None:
            yield from done()

    return dealt.mapInArrow(run, "query_id long, genome_id long, matches long")


def match_counts(columns: DataFrame, q: DataFrame, least: int = 1, place: tuple[str, Column] | None = None) -> DataFrame:
    """query_id, genome_id, matches of q(query_id, bucket, fp) against columns(block, bucket, fps).

    Columns that come from several indexes or generations may overlap; their counts add up. `place` is the partition column of
    saved columns and its value for a bucket: packs that are broadcast prune the scan by it while the query runs.
    """
    packs = query_packs(q)
    keys = ["bucket"]
    if place is not None:
        packs, keys = packs.withColumn(*place), [place[0], "bucket"]
    # The filter drops nothing; by it Spark sees that the packs select.
    packs = broadcast_if_small(packs, SMALL).where(F.size("ids") > 0)
    joined = columns.join(packs, keys)
    return added(compare(joined.select("block", "bucket", "pack", "fps", "ids", "fps_asked").sortWithinPartitions("block", "pack", "bucket")), least)


def moved(columns: DataFrame, by: int) -> DataFrame:
    """Columns of genomes whose ids are larger by so many. No shuffle: a column falls into one or two blocks."""
    width = 1 << BLOCK_BITS
    blocks, shift = by >> BLOCK_BITS, by & (width - 1)
    if not shift:
        return columns.select((F.col("block") + blocks).alias("block"), "bucket", "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "fps"):
            out = []
            for block, bucket, fps in zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), batch.column("fps").to_pylist()):
                out.append((block + blocks, bucket, bytes([EMPTY]) * shift + fps[: width - shift]))
                if len(fps) > width - shift:
                    out.append((block + blocks + 1, bucket, fps[width - shift :]))
            if out:
                yield batch_of(out)

    return columns.select("block", "bucket", "fps").mapInArrow(run, "block long, bucket long, fps binary")
