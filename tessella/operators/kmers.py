"""k-mer enumeration and sketches of sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.functions import bases, hashing
from tessella.params import SketchParams

#: Rows of a batch that a kernel hands back, about.
ROWS = 1_000_000
#: Positions that the kernel handles at once; a sequence of any length is taken in pieces of this size.
PIECE = 1 << 21
#: Letters of short sequences that the sketch kernel takes together.
GROUP = 1 << 18


def sketch_kmers_by_sql(seqs: DataFrame, k: int, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """key, pos (from 0), canon: the canonical k-mers that a sketch sees.

    The first k-1 characters are taken in either case, and as all A if any of them is not a base; in the
    rest only capitals count, and other characters are A on either strand. The last k-mer is left out.
    """
    s = F.col(seq)
    lead = F.substring(s, 1, k - 1)
    lead = F.when(lead.rlike("^[ACGTacgt]*$"), F.upper(lead)).otherwise(F.lit("A" * (k - 1)))
    rest = F.substring(s, k, 1 << 30)
    strands = (
        seqs.where(F.length(s) > k)
        .select(F.col(key), F.length(s).alias("_n"), lead.alias("_lead"), rest.alias("_rest"))
        .select(
            key, "_n",
            F.concat(bases.base_digits(F.col("_lead")), bases.base_digits(F.col("_rest"))).alias("_f"),
            F.concat(bases.complement_digits(F.col("_lead")), bases.complement_digits(F.col("_rest"))).alias("_r"),
        )
    )
    at = strands.select(key, "_f", "_r", F.explode(F.sequence(F.lit(1), F.col("_n") - k)).alias("_p"))
    return at.select(
        key, (F.col("_p") - 1).alias("pos"),
        F.least(
            bases.from_base4(F.substring("_f", F.col("_p"), F.lit(k))),
            bases.from_base4(F.reverse(F.substring("_r", F.col("_p"), F.lit(k)))),
        ).alias("canon"),
    )


def exact_kmers_by_sql(segments: DataFrame, k: int, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """key, canon: the distinct canonical k-mers of sequences, the last one included, either case.

    A k-mer with a character that is not a base counts as 0. A key may have several sequences.
    """
    s = F.col(seq)
    at = segments.where(F.length(s) >= k).select(key, s.alias("_s"), F.explode(F.sequence(F.lit(1), F.length(s) - k + 1)).alias("_p"))
    part = F.substring("_s", F.col("_p"), F.lit(k))
    return at.select(key, bases.canonical_number(part).alias("canon")).distinct()


def sketch_by_sql(seqs: DataFrame, params: SketchParams, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """key, bucket, fp, khash from exploded k-mers: the least fingerprint of each bucket, first come first."""
    hashed = hashing.with_hash64(sketch_kmers_by_sql(seqs, params.k, key, seq), "canon", "h")
    marked = hashing.with_fingerprint(hashed, "h", params.log2_buckets, params.mantissa)
    best = marked.groupBy(key, "bucket").agg(F.min("fp").alias("fp"), F.min_by("h", F.struct("fp", "pos")).alias("khash"))
    return best.where(F.col("fp") < 255)


_FORWARD = np.zeros(256, np.uint64)
_FORWARD[[ord("C"), ord("G"), ord("T")]] = 1, 2, 3
_REVERSE = np.zeros(256, np.uint64)
_REVERSE[[ord("A"), ord("C"), ord("G")]] = 3, 2, 1


_BASE = np.zeros(256, bool)
_BASE[list(b"ACGT")] = True


def _windows(codes: np.ndarray, k: int, forward: bool) -> np.ndarray:
    """Packed numbers of all runs of k codes, by doubling: first code highest, or lowest."""
    out, have = None, 0
    power, width = codes, 1
    left = k
    while left:
        if left & 1:
            if out is None:
                out, have = power, width
            else:
                n = len(codes) - have - width + 1
                shift = np.uint64(2 * (width if forward else have))
                a, b = out[:n], power[have : have + n]
                out, have = ((a << shift) | b) if forward else (a | (b << shift)), have + width
        left >>= 1
        if left:
            n = len(power) - width
            shift = np.uint64(2 * width)
            a, b = power[:n], power[width : width + n]
            power, width = ((a << shift) | b) if forward else (a | (b << shift)), 2 * width
    return out


def hash64(x: np.ndarray, factor: int = hashing.MIX64) -> np.ndarray:
    half = np.uint64(32)
    for _ in range(2):
        x = ((x >> half) ^ x) * np.uint64(factor)
    return (x >> half) ^ x


def letters(text: str) -> bytes:
    """A sequence with one byte for each character; those beyond Latin-1 are bytes that are no base."""
    return text.encode("latin-1", "replace")


def _fingerprints(value: np.ndarray, params: SketchParams) -> np.ndarray:
    high = value >> np.uint64(32)
    some = high > 0
    # Numbers below 2**32 are exact as doubles, whose exponent is the place of the highest bit.
    _, place = np.frexp(np.where(some, high, value).astype(np.float64))
    place = np.maximum(place.astype(np.int64) - 1, 0) + np.where(some, 32, 0)
    exponent = np.maximum(place - 32 + params.log2_buckets, 0).astype(np.uint64)
    offset = np.maximum(place - params.mantissa, 0).astype(np.uint64)
    mantissa = (value - (np.uint64(1) << place.astype(np.uint64))) >> offset
    fp = (mantissa + (exponent << np.uint64(params.mantissa))) & np.uint64(255)
    return np.where(value == 0, np.uint64(255), fp)


def _lead(seq: bytes, k: int) -> bytes:
    """The sequence with its first k-1 characters as a sketch sees them."""
    lead = seq[: k - 1].upper()
    return (lead if not lead.translate(None, b"ACGT") else b"A" * (k - 1)) + seq[k - 1 :]


def _pieces(data: bytes, n: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Starts of pieces of at most PIECE of n positions, and the characters that their k-mers need."""
    codes = np.frombuffer(data, np.uint8)
    for start in range(0, n, PIECE):
        yield start, codes[start : min(start + PIECE, n) + k - 1]


def canonical_of(seq: bytes, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and canonical k-mers that a sketch sees, in pieces; see sketch_kmers_by_sql()."""
    for start, part in _pieces(_lead(seq, k), len(seq) - k, k):
        canon = np.minimum(_windows(_FORWARD[part], k, True), _windows(_REVERSE[part], k, False))
        yield np.arange(start, start + len(canon)), canon


def distinct_of(seq: bytes, k: int) -> Iterator[tuple[np.ndarray]]:
    """Distinct canonical k-mers in pieces, the last one included, either case; 0 for one with a character that is not a base."""
    upper = seq.upper()
    for _, part in _pieces(upper, len(seq) - k + 1, k):
        canon = np.minimum(_windows(_FORWARD[part], k, True), _windows(_REVERSE[part], k, False))
        other = np.cumsum(np.r_[0, ~_BASE[part]])
        canon[other[k:] > other[:-k]] = 0
        yield (np.unique(canon),)


def sketch_of(seq: bytes, params: SketchParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, fingerprints and hashes of one sequence, in pieces of bounded size."""
    bits = params.value_bits
    best: dict[str, np.ndarray] = {}
    for _, canon in canonical_of(seq, params.k):
        h = hash64(canon)
        bucket = (h >> np.uint64(bits)).astype(np.int64)
        fp = _fingerprints(h & np.uint64((1 << bits) - 1), params)
        if best:
            bucket, fp, h = (np.r_[best[c], x] for c, x in (("bucket", bucket), ("fp", fp), ("h", h)))
        order = np.argsort(bucket.astype(np.uint64) << np.uint64(8) | fp, kind="stable")
        bucket, fp, h = bucket[order], fp[order], h[order]
        lead_rows = np.r_[True, bucket[1:] != bucket[:-1]]
        best = {"bucket": bucket[lead_rows], "fp": fp[lead_rows], "h": h[lead_rows]}
    if not best:
        none = np.empty(0, np.int64)
        return none, none, none
    some = best["fp"] < 255
    return best["bucket"][some], best["fp"][some].astype(np.int64), best["h"][some].view(np.int64)


def _sketch_group(seqs: list[bytes], params: SketchParams) -> tuple[np.ndarray, ...]:
    """Places in `seqs`, buckets, fingerprints and hashes of some short sequences, taken as one array.

    Sequence, bucket, fingerprint and position are packed into one number each, so that a plain sort finds the first
    least fingerprint of each bucket; the sequences' number and letters are bounded by sketches_of().
    """
    k, bits = params.k, params.value_bits
    codes = np.frombuffer(b"".join(_lead(s, k) for s in seqs), np.uint8)
    canon = np.minimum(_windows(_FORWARD[codes], k, True), _windows(_REVERSE[codes], k, False))
    sizes = np.array([len(s) for s in seqs])
    starts = np.cumsum(sizes) - sizes
    counts = sizes - k  # the last k-mer is left out, as are those that cross into the next sequence
    owner = np.repeat(np.arange(len(seqs)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    h = hash64(canon[at])
    bucket = h >> np.uint64(bits)
    fp = _fingerprints(h & np.uint64((1 << bits) - 1), params)
    place = np.uint64(GROUP.bit_length())
    group = owner.astype(np.uint64) << np.uint64(params.log2_buckets) | bucket
    order = np.sort((group << np.uint64(8) | fp) << place | np.arange(len(h), dtype=np.uint64))
    group = order >> (place + np.uint64(8))
    first = order[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])] if len(order) else order
    first = (first & np.uint64((1 << int(place)) - 1)).astype(np.int64)
    first = first[fp[first] < 255]
    return owner[first], bucket[first].astype(np.int64), fp[first].astype(np.int64), h[first].view(np.int64)


def sketches_of(seqs: list[bytes], params: SketchParams) -> Iterator[tuple[np.ndarray, ...]]:
    """Places in `seqs`, buckets, fingerprints and hashes of all sequences; short ones are taken together."""
    most = 1 << max(0, min(16, 64 - 8 - GROUP.bit_length() - params.log2_buckets))
    held: list[int] = []
    size = 0

    def done() -> tuple[np.ndarray, ...]:
        places, *rest = _sketch_group([seqs[i] for i in held], params)
        return np.array(held)[places], *rest

    for i, seq in enumerate(seqs):
        if len(seq) <= params.k:  # no k-mer
            continue
        if len(seq) > GROUP // 4:
            got = sketch_of(seq, params)
            yield np.full(len(got[0]), i), *got
            continue
        if held and (size + len(seq) > GROUP or len(held) == most):
            yield done()
            held, size = [], 0
        held.append(i)
        size += len(seq)
    if held:
        yield done()


def _of_each(seqs: DataFrame, key: str, seq: str, columns: dict[str, str], kernel: Callable[[bytes], Iterable[tuple[np.ndarray, ...]]]) -> DataFrame:
    """key and the columns that a kernel makes of each sequence that is not null: no shuffle, batches of bounded size."""
    source = seqs.select(F.col(key).alias("key"), F.col(seq).cast("string").alias("seq")).where("seq IS NOT NULL")
    kind = source.schema["key"].dataType.simpleString()
    types = {"long": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("seq")
            rows, out, size = [], [], 0

            def done() -> pa.RecordBatch:
                arrays = [pa.array(np.concatenate(x).astype(np.int64), types[t]) for x, t in zip(zip(*out), columns.values())]
                return pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(rows, [len(x[0]) for x in out]))), *arrays], names=["key", *columns])

            for i in range(batch.num_rows):
                for got in kernel(letters(texts[i].as_py())):
                    rows.append(i)
                    out.append(got)
                    size += len(got[0])
                    if size > ROWS:
                        yield done()
                        rows, out, size = [], [], 0
            if size:
                yield done()

    schema = ", ".join(f"{name} {t}" for name, t in columns.items())
    return source.mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def sketch_kmers(seqs: DataFrame, k: int, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """key, pos, canon: the same rows as sketch_kmers_by_sql, in time linear in the sequence."""
    return _of_each(seqs, key, seq, {"pos": "int", "canon": "long"}, lambda s: canonical_of(s, k))


def exact_kmers(segments: DataFrame, k: int, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """key, canon: the same rows as exact_kmers_by_sql; each task makes its sequences' k-mers distinct before the shuffle."""
    return _of_each(segments, key, seq, {"canon": "long"}, lambda s: distinct_of(s, k)).distinct()


def sketch(seqs: DataFrame, params: SketchParams, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """key, bucket, fp, khash: the same rows as sketch_by_sql, without a shuffle.

    A sequence's k-mers never leave its task: the kernel works on Arrow batches and keeps the least
    fingerprint of each bucket.
    """
    source = seqs.select(F.col(key).alias("key"), F.col(seq).cast("string").alias("seq")).where("seq IS NOT NULL")
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, bucket, fp, h in sketches_of([letters(s) for s in batch.column("seq").to_pylist()], params):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(rows)), pa.array(bucket), pa.array(fp.astype(np.int32)), pa.array(h)], names=["key", "bucket", "fp", "khash"]
                )

    return source.mapInArrow(run, f"key {kind}, bucket long, fp int, khash long").withColumnRenamed("key", key)


def _lead_at(text: bytes, offset: int, prefix: bytes, k: int) -> bytes:
    """Letters from place `offset` of a sequence on, its first k - 1 as a sketch sees them; prefix: those, if the text begins behind them."""
    if not offset:
        return _lead(text, k) if len(text) >= k - 1 else text
    inside = max(0, k - 1 - offset)
    return _lead(prefix, k)[offset : offset + inside] + text[inside:] if inside else text


def sketch_of_pieces(pieces: DataFrame, params: SketchParams, key: str = "genome_id") -> DataFrame:
    """key, bucket, fp, khash: sketches of sequences that come in pieces(key, seq, start, carry, prefix, total).

    A piece gives the k-mers that end in it and the least fingerprint of each bucket with its place; the first least one of all
    pieces is the sequence's, so one genome is sketched by as many tasks as it has pieces. Their merge is pre-aggregated.
    """
    k, bits = params.k, params.value_bits
    kind = pieces.schema[key].dataType.simpleString()
    source = pieces.select(F.col(key).alias("key"), "seq", "start", "carry", "prefix", "total")
    names = ["key", "bucket", "fp", "pos", "khash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (seq, start, carry, prefix, total) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("seq", "start", "carry", "prefix", "total")))):
                offset = start - len(carry)
                text = _lead_at(letters(carry) + letters(seq), offset, letters(prefix), k)
                count = min(len(text) - k + 1, total - k - offset)  # the sequence's last k-mer is left out
                for at, part in _pieces(text, max(count, 0), k):
                    h = hash64(np.minimum(_windows(_FORWARD[part], k, True), _windows(_REVERSE[part], k, False)))
                    bucket = (h >> np.uint64(bits)).astype(np.int64)
                    fp = _fingerprints(h & np.uint64((1 << bits) - 1), params)
                    order = np.argsort(bucket.astype(np.uint64) << np.uint64(8) | fp, kind="stable")
                    first = order[np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])]
                    first = first[fp[first] < 255]
                    columns = [pa.array(bucket[first]), pa.array(fp[first].astype(np.int32)), pa.array(first + offset + at), pa.array(h[first].view(np.int64))]
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(np.full(len(first), i))), *columns], names=names)

    found = source.mapInArrow(run, f"key {kind}, bucket long, fp int, pos long, khash long")
    best = found.groupBy("key", "bucket").agg(F.min(F.struct("fp", "pos", "khash")).alias("b"))
    return best.select(F.col("key").alias(key), "bucket", "b.fp", "b.khash")


def exact_of_pieces(pieces: DataFrame, key: str = "genome_id") -> DataFrame:
    """key, seq: sequences whose exact k-mers are together those of pieces(key, seq, seg_carry): each piece behind what it carries on."""
    return pieces.select(key, F.concat("seg_carry", "seq").alias("seq"))
