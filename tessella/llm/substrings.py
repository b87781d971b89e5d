"""Substring dedup: compressed FM-indexes over shards of passages, and backward search.

A window of THRESHOLD words repeats if it also starts in a document with a smaller doc_id; words that
repeating windows cover are removed.

* Passages. Each window belongs to its minimizer, the least hash of its runs of GRAM words. Windows in a
  row with one minimizer form a passage, so equal windows of any documents meet under one minimizer.
* Preselection. Minimizers that occur in one row only cannot matter. The others set bits of a bitmap with up to 64 bits for
  each; passages whose bit is clear are dropped where they are read. With more than TABLE_KEYS minimizers a bitmap would be
  too large to broadcast, so the rows' minimizers are joined with the repeating ones instead, and each row
  learns which of its passages to send. Both ways give the same results.
* Hot minimizers. Where one occurs in very many rows, its passages are cut into single windows, which are
  sharded by their own hash; equal windows have been merged before they are shuffled.
* Shards. Distinct passages, each with the least doc_id it occurs in, are dealt to shards by minimizer. A shard's task
  builds an FM-index: the Burrows-Wheeler transform as a wavelet matrix shaped by codes of about the words' entropy, with a
  two-level directory of counts; the text is dropped. Then the passages of the documents are streamed against it. Backward search from each place gives its matching
  statistic: how many words that end there stand in an earlier document, as the least document of the suffix interval
  tells; it is followed up to LONGEST words. Intervals of THRESHOLD words or more are reported, and their unions are the
  spans that the passage's first document loses. All later documents have the whole passage from that first one.
* Removal. Occurrences look up their passages' spans and meet their document's text.

Passages carry WORD_BYTES of each word's hash and are named by 96 bits of a hash of these.

Defined cases: null and empty texts have no words; nothing is removed from them. Rows with the same doc_id
do not repeat one another, being neither smaller. A null doc_id counts as larger than all others. Extra
columns are ignored; the pipeline's stage keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm.common import U64, WordHashes, bit_table, gram_hashes, in_bits, mix, of_planes, planes, raw, slices, table, unused
from tessella.shared import checkpoint

#: Words of a window, words of a minimizer's run.
THRESHOLD = 13
GRAM = 5
#: Words up to which matching statistics are followed (a power of two).
LONGEST = 16
#: Repeating minimizers up to which a bitmap preselects (64 bits for each, but at most 16 MB), and log2 of the bits for hot ones.
TABLE_KEYS = 1 << 23
HOT_BITS = 20
#: Rows from which a minimizer is hot, and passages of a shard on average.
HOT = 2000
SHARD = 30_000
#: Passages that are streamed against an index at once, and 64-bit words of a block in the directory of counts.
STREAM = 8_192
BLOCK = 512
#: Bytes of a word's hash that passages carry: two words of otherwise equal windows are taken for one
#: another with a probability of 2**-40.
WORD_BYTES = 5
#: Bytes of a passage's name.
NAME_BYTES = 12
#: Distinct passages that a task gathers before it sends them on.
GATHER = 50_000

LAST = (1 << 63) - 1


def passages(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, text, first window and number of windows of each passage of the texts whose word hashes follow one another."""
    windows = np.maximum(sizes - THRESHOLD + 1, 0)
    n = len(words) - THRESHOLD + 1
    if n <= 0 or not windows.any():
        return np.empty(0, U64), *(np.empty(0, np.int64) for _ in range(3))
    grams = gram_hashes(words, GRAM)
    least = grams[:n].copy()
    for k in range(1, THRESHOLD - GRAM + 1):
        np.minimum(least, grams[k : k + n], out=least)
    # The windows that lie within a text.
    text = np.repeat(np.arange(len(sizes)), windows)
    first = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    least = least[(np.cumsum(sizes) - sizes)[text] + first]
    heads = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
    return mix(least[heads]), text[heads], first[heads], np.diff(np.r_[heads, len(least)])


def hashed(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the number of words of each."""
    split = [t.split() for t in texts]
    return hashes.of([w for t in split for w in t]), np.array([len(t) for t in split], np.int64)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol's code: Shannon lengths, shortened where most is saved while Kraft's sum stays within 1."""
    share = counts / counts.sum()
    out = np.maximum(np.ceil(-np.log2(share)), 1)
    for _ in range(8):
        order = np.argsort(np.where(out > 1, -share * 2.0**out, 0), kind="stable")
        fits = order[np.cumsum(2.0 ** -out[order]) <= 1 - (2.0**-out).sum()]
        fits = fits[out[fits] > 1]
        if not len(fits):
            break
        out[fits] -= 1
    return out.astype(np.uint8)


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Prefix-free codes of these lengths, such that a wavelet matrix has the symbols that end at a level behind all others."""
    out = np.zeros(len(lengths), np.uint32)
    order = np.argsort(lengths, kind="stable")
    edges = np.searchsorted(lengths[order], np.arange(int(lengths.max()) + 2))
    nodes = np.zeros(1, np.uint32)
    for level in range(1, len(edges) - 1):
        nodes = np.r_[nodes << np.uint32(1), nodes << np.uint32(1) | np.uint32(1)]
        ending = order[edges[level] : edges[level + 1]]
        inner = len(nodes) - len(ending)
        out[ending] = nodes[inner:]
        # What is left of the code's room may exceed the symbols left: further nodes stay empty.
        nodes = nodes[: min(inner, len(order) - edges[level + 1])]
    return out


class FmIndex:
    """Compressed FM-index of word sequences: a wavelet matrix over the Burrows-Wheeler transform, shaped by codes.

    Suffixes are sorted by their first LONGEST words, which is exact for patterns of up to that many. Frequent words have short
    codes, so the matrix takes about the transform's entropy, and a search walks fewer levels. Kept are the bits of the codes
    with a two-level directory of counts (a quarter on top), the places where words begin, and the document of
    each suffix in the narrowest type; text and suffixes are dropped, and what is streamed is coded as it comes.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, documents: np.ndarray | None = None) -> None:
        """words: all sequences one after another; lengths and documents: of each."""
        self.alphabet = np.unique(words)
        text, place = self.coded(words, lengths)
        n = len(text)
        rank = text.astype(np.int64)
        for k in range(LONGEST.bit_length() - 1):
            step = 1 << k
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            fresh = np.r_[0, np.cumsum(key[order[1:]] != key[order[:-1]])]
            rank = np.empty(n, np.int64)
            rank[order] = fresh
        del rank, key, fresh
        bwt = text[order - 1]  # the first suffix wraps to the last separator
        counts = np.bincount(text, minlength=len(self.alphabet) + 1)
        self.first = np.r_[0, np.cumsum(counts)].astype(np.int32)
        self.values, code = np.unique(np.zeros(len(lengths), np.int64) if documents is None else documents, return_inverse=True)
        kind = np.min_scalar_type(len(self.values))
        of_text = np.full(n, len(self.values), kind)
        of_text[place] = np.repeat(code, lengths)
        self.documents = np.r_[of_text[order], np.array([len(self.values)], kind)]
        self.values = np.r_[self.values, LAST]
        del order, of_text, text, place
        self.sizes = code_lengths(counts)
        self.codes = codes_of(self.sizes)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        for level in range(int(self.sizes.max())):
            bit = (self.codes[bwt] >> (self.sizes[bwt] - np.uint8(level + 1)).astype(np.uint32) & np.uint32(1)).astype(bool)
            packed = np.packbits(np.r_[bit, np.zeros(-len(bit) % 64 + 64, bool)], bitorder="little").view(U64)
            before = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)][:-1]
            wide = before[::BLOCK]
            near = (before - np.repeat(wide, BLOCK)[: len(before)]).astype(np.uint16)
            self.levels.append((packed, near, wide, len(bit) - int(bit.sum())))
            bwt = np.r_[bwt[~bit], bwt[bit]]
            bwt = bwt[: np.count_nonzero(self.sizes[bwt] > level + 1)]  # words that end here stand last

    def coded(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences of indexed words as a text of symbols, a separator (0) after each, and the place of each word in it."""
        place = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)
        text = np.zeros(len(words) + len(lengths), np.int32)
        text[place] = np.searchsorted(self.alphabet, words) + 1
        return text, place

    @property
    def nbytes(self) -> int:
        """Bytes of the matrix with its directory, the codes, and the places where words begin."""
        return sum(x.nbytes for level in self.levels for x in level[:3]) + self.codes.nbytes + self.sizes.nbytes + self.first.nbytes

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        packed, near, wide, _ = self.levels[level]
        block = at >> 6
        mask = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return wide[block // BLOCK] + near[block] + np.bitwise_count(packed[block] & mask)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word in front."""
        start, size, code = self.first[symbol].astype(np.int64), self.sizes[symbol], self.codes[symbol]
        out_low, out_high = np.empty(len(symbol), np.int64), np.empty(len(symbol), np.int64)
        at = np.arange(len(symbol))
        lo, hi, base = low.astype(np.int64), high.astype(np.int64), np.zeros(len(symbol), np.int64)
        for i, (_, _, _, zeros) in enumerate(self.levels):
            up = (code >> (size - np.uint8(i + 1)).astype(np.uint32) & np.uint32(1)).astype(bool)
            l1, h1, b1 = self.ones(i, lo), self.ones(i, hi), self.ones(i, base)
            lo = np.where(up, zeros + l1, lo - l1)
            hi = np.where(up, zeros + h1, hi - h1)
            base = np.where(up, zeros + b1, base - b1)
            more = size > i + 1
            if not more.all():
                done = at[~more]
                out_low[done], out_high[done] = (lo - base)[~more], (hi - base)[~more]
                at, lo, hi, base, size, code = (x[more] for x in (at, lo, hi, base, size, code))
                if not len(at):
                    break
        return start + out_low, start + out_high

    def intervals(self, text: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns of `length` words that end at the places `last` of a text of indexed words.

        All patterns occur, as the text's sequences are in the index; one that occurs once leaves early.
        """
        symbol = text[last]
        low, high = self.first[symbol].astype(np.int64), self.first[symbol + 1].astype(np.int64)
        live = np.flatnonzero(high - low > 1)
        for k in range(1, length):
            if not len(live):
                break
            low[live], high[live] = self.extend(text[last[live] - k], low[live], high[live])
            live = live[high[live] - low[live] > 1]
        return low, high

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least document of each interval; intervals of one depth."""
        if not len(low):
            return np.empty(0, np.int64)
        starts, back = np.unique(low, return_inverse=True)
        ends = np.zeros(len(starts), np.int64)
        ends[back] = high
        return self.values[np.minimum.reduceat(self.documents, np.column_stack([starts, ends]).ravel())[::2]][back]

    def statistics(self, text: np.ndarray, last: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Matching statistics of a text of indexed words: for each place `last`, how many words that end there (LONGEST at
        most) stand in a document before `own`; 0 for less than THRESHOLD. Each place has THRESHOLD words of its sequence."""
        low, high = self.intervals(text, last, THRESHOLD)
        out = np.zeros(len(last), np.int64)
        live = np.flatnonzero(high - low > 1)
        for length in range(THRESHOLD, LONGEST + 1):
            live = live[self.least(low[live], high[live]) < own[live]]
            out[live] = length
            live = live[text[last[live] - length] > 0]
            if not len(live) or length == LONGEST:
                break
            low[live], high[live] = self.extend(text[last[live] - length], low[live], high[live])
            live = live[high[live] > low[live]]
        return out


def first_documents(words: np.ndarray, lengths: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """For each window of each sequence, the least document whose sequences hold it; windows in order."""
    index = FmIndex(words, lengths, documents)
    ends = within(lengths) >= THRESHOLD - 1
    out = np.repeat(documents, lengths)[ends]
    text, place = index.coded(words, lengths)
    low, high = index.intervals(text, place[ends], THRESHOLD)
    several = high - low > 1
    out[several] = index.least(low[several], high[several])
    return out


def within(lengths: np.ndarray) -> np.ndarray:
    """The place of each word in its sequence."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def earlier_spans(words: np.ndarray, lengths: np.ndarray, documents: np.ndarray) -> list[np.ndarray]:
    """For each sequence, the spans (start, end, start, end, ...) of THRESHOLD words or more that a document before its own has.

    The sequences are indexed, then streamed against the index, STREAM of them at once; spans are the unions of the
    intervals that the matching statistics report.
    """
    index = FmIndex(words, lengths, documents)
    edges = np.r_[0, np.cumsum(lengths)]
    out: list[np.ndarray] = []
    for a in range(0, len(lengths), STREAM):
        few = lengths[a : a + STREAM]
        text, place = index.coded(words[edges[a] : edges[a + len(few)]], few)
        at = within(few)
        owner = np.repeat(np.arange(len(few)), few)
        ends = at >= THRESHOLD - 1
        length = index.statistics(text, place[ends], documents[a : a + STREAM][owner[ends]])
        hit = length > 0
        owner, stop = owner[ends][hit], at[ends][hit] + 1
        start = stop - length[hit]
        # An interval opens a span where its sequence's intervals before it end before it starts.
        new = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] > stop[:-1])][: len(owner)]
        heads = np.flatnonzero(new)
        if len(heads):
            spans = np.column_stack([np.minimum.reduceat(start, heads), stop[np.r_[heads[1:], len(stop)] - 1]])
        else:
            spans = np.empty((0, 2), np.int64)
        cuts = np.searchsorted(owner[heads], np.arange(len(few) + 1))
        out += [spans[cuts[i] : cuts[i + 1]].ravel() for i in range(len(few))]
    return out


@dataclass
class Sent:
    """Passages to be sent: text, minimizer or window hash to shard by, first and one past the last word, words, name."""

    text: np.ndarray
    by: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    words: list[bytes]
    names: list[bytes]


class Reader:
    """Passages of texts that are to be sent: by bitmaps, or by lists of the row's minimizers."""

    def __init__(self, bits: np.ndarray | None, log2_bits: int, hot: np.ndarray | None) -> None:
        self.bits, self.log2_bits, self.hot = bits, log2_bits, hot
        self.hashes = WordHashes()

    def read(self, batch: pa.RecordBatch) -> Sent:
        words, sizes = hashed(raw(batch.column("text")), self.hashes)
        keys, text, first, count = passages(words, sizes)
        if self.bits is not None:
            chosen = in_bits(self.bits, keys, self.log2_bits)
            hot = in_bits(self.hot, keys, HOT_BITS)
        else:
            lists = [batch.column(c).to_pylist() for c in ("wanted", "cut")]
            edges = np.searchsorted(text, np.arange(len(sizes) + 1))
            chosen, hot = (
                np.concatenate([np.isin(keys[a:b].view(np.int64), np.array(x or [], np.int64)) for a, b, x in zip(edges, edges[1:], of)]) for of in lists
            )
        text, first, count, keys, hot = text[chosen], first[chosen], count[chosen], keys[chosen], hot[chosen]
        # Passages of hot minimizers become single windows.
        pieces = np.where(hot, count, 1)
        step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        text, by, hot, first = (np.repeat(x, pieces) for x in (text, keys, hot, first))
        first = first + step
        stop = first + np.where(hot, 1, np.repeat(count, pieces)) + THRESHOLD - 1
        data = words.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()
        at = (np.cumsum(sizes) - sizes)[text]
        found = [data[a:b] for a, b in zip((WORD_BYTES * (at + first)).tolist(), (WORD_BYTES * (at + stop)).tolist())]
        names = [xxhash.xxh3_128_digest(d)[:NAME_BYTES] for d in found]
        for i in np.flatnonzero(hot).tolist():
            by[i] = int.from_bytes(names[i][:8], "big")
        return Sent(text, by, first, stop, found, names)


def packed(names: list[bytes], lo: list[int], hi: list[int], words: list[bytes]) -> bytes:
    """Passages of one shard: names, least and largest documents, and words as numbers in a list of the distinct ones."""
    sizes = np.array([len(w) // WORD_BYTES for w in words], np.int64)
    flat = np.zeros((int(sizes.sum()), 8), np.uint8)
    flat[:, :WORD_BYTES] = np.frombuffer(b"".join(words), np.uint8).reshape(-1, WORD_BYTES)
    known, code = np.unique(flat.view(U64)[:, 0], return_inverse=True)
    data = b"".join([
        np.array([len(names), len(known), len(flat)], "<u4").tobytes(), b"".join(names),
        *(planes(np.array(x, np.int64).view(U64), 8) for x in (lo, hi)), planes(sizes, 4), planes(np.diff(known, prepend=U64(0)), 8), planes(code, 4),
    ])
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, least and largest documents, numbers of words, and all words one after another."""
    data = zstandard.ZstdDecompressor().decompress(data)
    n, known, total = np.frombuffer(data, "<u4", 3).tolist()
    cuts = np.cumsum([12, NAME_BYTES * n, 8 * n, 8 * n, 4 * n, 8 * known, 4 * total]).tolist()
    names, lo, hi, sizes, list_, code = (data[a:b] for a, b in zip(cuts, cuts[1:]))
    documents = (of_planes(x, 8, n).view(np.int64) for x in (lo, hi))
    words = np.cumsum(of_planes(list_, 8, known), dtype=U64)[of_planes(code, 4, total).astype(np.int64)]
    return np.frombuffer(names, f"S{NAME_BYTES}"), *documents, of_planes(sizes, 4, n).astype(np.int64), words


def distinct_passages(rows: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The passages of packed rows, each once: names, least and largest documents, numbers of words, words."""
    names, lo, hi, sizes, words = (np.concatenate(x) for x in zip(*map(unpacked, rows)))
    found, first, back = np.unique(names, return_index=True, return_inverse=True)
    least, most = lo[first], hi[first]
    np.minimum.at(least, back, lo)
    np.maximum.at(most, back, hi)
    kept = np.zeros(len(names), bool)
    kept[first] = True
    order = np.argsort(first)  # in the order of their words
    named = [bytes(x).ljust(NAME_BYTES, b"\0") for x in found[order].tolist()]
    return named, least[order], most[order], sizes[kept], words[np.repeat(kept, sizes)]


def _minimizers_of_rows(batch: pa.RecordBatch, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (minimizer, row of the batch), by minimizer."""
    keys, text, _, _ = passages(*hashed(raw(batch.column("text")), hashes))
    order = np.lexsort((text, keys))
    keys, text = keys[order], text[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])][: len(keys)]
    return keys[new], text[new]


def minimizers(source: DataFrame) -> DataFrame:
    """key (minimizer) and n, the rows that have it, summed over a few texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            keys, _ = _minimizers_of_rows(batch, hashes)
            heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
            yield pa.RecordBatch.from_arrays([pa.array(keys[heads].view(np.int64)), pa.array(np.diff(np.r_[heads, len(keys)]))], names=["key", "n"])

    return source.select("text").mapInArrow(run, "key long, n long")


def with_minimizers(source: DataFrame, counted: DataFrame) -> DataFrame:
    """source with `wanted` and `cut`: the repeating and the hot ones among each row's minimizers, or null without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            keys, text = _minimizers_of_rows(batch, hashes)
            columns = [*(batch.column(c).take(pa.array(text)) for c in ("row_key", "doc")), pa.array(keys.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["row_key", "doc", "key"])

    each = source.mapInArrow(run, "row_key long, doc long, key long").join(counted, "key")
    lists = each.groupBy("row_key", "doc").agg(F.collect_set("key").alias("wanted"), F.collect_set(F.when(F.col("n") >= HOT, F.col("key"))).alias("cut"))
    return source.join(lists, ["row_key", "doc"], "left")


def spans_of_rows(source: DataFrame) -> DataFrame:
    """row_key, doc and spans (start, end, start, end, ...): the words of the row that earlier documents have."""
    spark = source.sparkSession
    counted = checkpoint(minimizers(source).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"))
    told = counted.agg(F.sum("n").alias("n"), F.count("*").alias("keys")).first()
    shards = max(1, -(-int(told["n"] or 0) // SHARD))
    if told["keys"] <= TABLE_KEYS:
        log2_bits = min(27, max(12, (64 * told["keys"]).bit_length()))
        tables = bit_table(counted, "key", log2_bits), log2_bits, bit_table(counted.where(F.col("n") >= HOT), "key", HOT_BITS)
        source = source.select("*", F.lit(None).cast("array<long>").alias("wanted"), F.lit(None).cast("array<long>").alias("cut"))
    else:
        tables = None, 0, None
        source = with_minimizers(source, counted)
    shared = spark.sparkContext.broadcast(tables)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        held: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            by_shard: dict[int, list] = {}
            for name, (lo, hi, shard, words) in held.items():
                by_shard.setdefault(shard, []).append((name, lo, hi, words))
            held.clear()
            rows = [packed(*map(list, zip(*of))) for of in by_shard.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(by_shard), pa.int32()), pa.array(rows, pa.binary())], names=["shard", "data"])

        for batch in slices(batches):
            sent = reader.read(batch)
            docs = batch.column("doc").to_numpy()[sent.text].tolist()
            for passage, doc, shard, words in zip(sent.names, docs, (sent.by % U64(shards)).tolist(), sent.words):
                if (row := held.get(passage)) is None:
                    held[passage] = [doc, doc, shard, words]
                elif doc < row[0]:
                    row[0] = doc
                elif doc > row[1]:
                    row[1] = doc
            if len(held) >= GATHER:
                yield flush()
        if held:
            yield flush()

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in slices(batches):
            sent = reader.read(batch)
            of_row = [batch.column(c).take(pa.array(sent.text)) for c in ("row_key", "doc")]
            places = (pa.array(x.astype(np.int32)) for x in (sent.first, sent.stop))
            yield pa.RecordBatch.from_arrays([*of_row, pa.array(sent.names, pa.binary()), *places], names=["row_key", "doc", "passage", "first", "stop"])

    def search(part: pa.Table) -> pa.Table:
        names, lo, hi, sizes, words = distinct_passages([d.as_py() for d in part.column("data")])
        spans = earlier_spans(words, sizes, lo)
        # Passages of one document that no earlier one has a part of answer nothing.
        useful = np.array([len(x) > 0 for x in spans]) | (lo < hi)
        return pa.table({"passage": pa.array(names, pa.binary()), "lo": pa.array(lo), "spans": pa.array(spans, pa.list_(pa.int64()))}).filter(pa.array(useful))

    firsts = source.select("row_key", "doc", "text", "wanted", "cut").mapInArrow(contents, "shard int, data binary")
    firsts = firsts.groupBy("shard").applyInArrow(search, "passage binary, lo long, spans array<long>")
    met = source.mapInArrow(occurrences, "row_key long, doc long, passage binary, first int, stop int").join(firsts, "passage")
    spans = F.when(F.col("doc") > F.col("lo"), F.array("first", "stop")).otherwise(F.transform("spans", lambda x: (x + F.col("first")).cast("int")))
    found = met.select("row_key", "doc", spans.alias("spans")).where(F.size("spans") > 0)
    return found.groupBy("row_key", "doc").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def covered(count: int, starts: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Which of a text's words these spans cover; without ends, windows of THRESHOLD words."""
    edge = np.zeros(count + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + THRESHOLD if ends is None else ends, count), -1)
    return np.cumsum(edge[:count]) > 0


def with_spans(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """The rows with the spans that earlier documents have, or null, and the name of that column."""
    row, doc, spans = (unused(docs, name) for name in ("row", "doc", "spans"))
    keyed = docs.withColumn(row, F.xxhash64(F.col(key), F.col(text))).withColumn(doc, F.coalesce(F.col(key).cast("long"), F.lit(LAST)))
    source = keyed.select(F.col(row).alias("row_key"), F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    found = spans_of_rows(source).select(F.col("row_key").alias(row), F.col("doc").alias(doc), F.col("spans").alias(spans))
    return keyed.join(found, [row, doc], "left").select(*docs.columns, spans), spans


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, spans = with_spans(docs, "doc_id", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, removed, hashes = [], [], []
            for t, found in zip(raw(batch.column("text")), batch.column(spans)):
                words = t.split()
                counts.append(len(words))
                n = 0
                if found.is_valid:
                    at = found.values.to_numpy()
                    gone = covered(len(words), at[::2], at[1::2])
                    n = int(gone.sum())
                    words = list(compress(words, ~gone))
                removed.append(n)
                hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes)], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    return rows.mapInArrow(digest, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: bytes, starts: np.ndarray, ends: np.ndarray | None = None) -> bytes:
    """The text without its covered words; what stands between kept words stays as it is."""
    spans = [m.span() for m in WORD.finditer(text)]
    gone = covered(len(spans), starts, ends)
    out, at, skipping = [], 0, False
    for (a, b), g in zip(spans, gone.tolist()):
        if g and not skipping:
            out.append(text[at:a])
        if g:
            at = b
        skipping = g
    out.append(text[at:])
    return b"".join(out)


def stage_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated passages; n_chars counts the new text. No row is dropped.

    Null and empty texts stay as they are; rows with a null doc_id count as last; rows with equal doc_id do not repeat one
    another, so equal rows all stay, alike. An empty table gives an empty one; other columns are kept as they are.
    """
    rows, spans = with_spans(docs, "doc_id", "text")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [s.values.to_numpy() if s.is_valid else None for s in batch.column(spans)]
            texts = [t if s is None else without(t, s[::2], s[1::2]) for t, s in zip(batch.column("text").cast(pa.binary()).to_pylist(), found)]
            new = pa.array(texts, pa.binary()).cast(pa.string())
            columns = [new if name == "text" else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    got = rows.mapInArrow(cut, docs.schema)
    if "n_chars" not in docs.columns:
        return got
    counted = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return got.withColumn("n_chars", counted).select(docs.columns)
