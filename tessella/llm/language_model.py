"""LM scoring: n-gram tries in Elias-Fano form, one for each shard of contexts.

The model is a trigram back-off model with absolute discounting, learned from the training rows. P(w | t u)
is (c(t u w) - D) / c(t u) where the trigram was seen, else the back-off weight of (t, u) times P(w | u), which
is (c(u w) - D) / c(u) where seen, else the back-off weight of u times P(w); P(w) is (c(w) - D1) / N, and unknown
words share D1 V / N as one class. Back-off weights are the discounted mass, so probabilities sum to at
most 1.

* Shards. Every position (t, u, w) of every text goes to the shard of its context word u, as rows of
  packed arrays; that is the only shuffle of the text's size. A shard sees all occurrences of its words
  as contexts, so all counts it needs are its own: c(u), c(u w), c(t u), c(t u w), and also whether (t, u) was
  seen as a bigram, by which it adds P(u) for tokens u that backed off to the unigram.
* Trie. The shard's training n-grams form levels: words u; their successors w and predecessors t, each as
  one ascending sequence led by the parent's place, with monotone pointers to each word's first successor; and
  trigrams, in which w is replaced by its rank among the successors of u (context-relative), which is its place less
  the pointer. Levels and pointers are Elias-Fano sequences, written to the task's folder, memory-mapped, and
  searched for all positions at once; the folder goes when the task ends.
* Quantised probabilities. Beside the levels stand 8-bit codes: of discounted counts at bigrams and trigrams, of
  counts and numbers of distinct successors at contexts, of the latter at words, whose own counts stay whole. All
  shards use one codebook of counts, made by a rule: a log-probability is the difference of two entries, off by 0.024
  for each at most and not at all for counts up to 32. It depends on its counts alone, so neither the number of
  shards nor dealing changes a score.
* Hot words. Words with a share of 1/HEAVY of the tokens (so at most HEAVY words) that outgrow a shard are
  dealt over several shards, each position twice: by w, where c(u w) and c(t u w) are whole, and by t under
  the name ~u, where c(t u) and c(t u w) are whole. The logarithm of each probability is a sum, so either
  shard adds its terms: a seen trigram is log(c(t u w) - D) by w and -log c(t u) by t, an unseen one the back-off
  weight of (t, u) by t and all else by w. c(u) is taken from the word counts; a block's sums collect the
  number of distinct successors from all slices, and the back-off weight of u is added there. So dealing
  changes where terms are added, not the model.
* Words are 64-bit hashes as contexts. As successors and predecessors within a context they have 32-bit names: words with 1/HEAVY
  of the tokens have names of their own, by their rank, and others the upper half of their hash; so two rare words
  of one context are taken for one another with a probability of 2**-32.

Defined cases: null and empty texts are the single end token. Repeated rows are counted and scored each on
its own; a row with a null doc_id is a training row. Without training rows nothing is known: base scores
use c = 0, and scores are those of unknown words under V = 1, N = 1. Extra columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm.common import LOWER, U64, WordHashes, mix, raw, slices, table
from tessella.llm.elias_fano import COUNTS, EliasFano, quantised
from tessella.shared import checkpoint

#: Discounts of n-grams and of words.
D = 0.75
D1 = 0.5
#: Words with a share of 1/HEAVY of all tokens are dealt over several shards, if they outgrow one.
HEAVY = 60_000
#: Positions of a shard on average.
SHARD = 1_500_000
#: Distinct words that a task counts before it sends the counts on.
GATHER = 400_000

#: Positions of a shard that are scored at once, about.
AT_ONCE = 500_000

#: Names of the end token, of "no word" and of the first word without a name of its own (more than HEAVY).
END = np.uint32(0xFFFFFFFF)
NONE = np.uint32(0)
OTHERS = np.uint32(1 << 16)

#: log10 of the codebook: of counts as they are, and discounted.
LOG = np.log10(COUNTS)
LOG_D = np.log10(COUNTS - D)


def held_out(key):
    """Rows that are never learned from: crc32 of doc_id as text leaves 1 modulo 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


@dataclass(frozen=True)
class Totals:
    """Counts over the training rows: tokens with ends, distinct tokens, rows; and counts of words with 1/HEAVY of the tokens."""

    tokens: int
    types: int
    rows: int
    heavy: dict[int, int]
    shards: int
    shard_size: int

    @cached_property
    def heavy_words(self) -> np.ndarray:
        return np.array(sorted(self.heavy), U64)

    @cached_property
    def hot(self) -> dict[int, int]:
        """Heavy words that outgrow a shard."""
        return {h: n for h, n in self.heavy.items() if n > self.shard_size}

    @cached_property
    def hot_words(self) -> np.ndarray:
        return np.array(sorted(self.hot), U64)

    @cached_property
    def hot_counts(self) -> np.ndarray:
        return np.array([self.hot[h] for h in sorted(self.hot)], np.float64)

    def names(self, hashes: np.ndarray) -> np.ndarray:
        """32-bit names of words, apart from END and NONE; heavy words have names of their own."""
        out = np.clip((hashes >> U64(32)).astype(np.uint32), OTHERS, END - np.uint32(1))
        heavy = self.heavy_words
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
            out = np.where(heavy[at] == hashes, at.astype(np.uint32) + np.uint32(1), out)
        return out

    def slices_of(self, count: int) -> int:
        return max(1, -(-count // self.shard_size))

    def word(self, counts: np.ndarray) -> np.ndarray:
        """log10 P(w) by count; 0 is an unknown word."""
        n = max(self.tokens, 1)
        return np.log10(np.where(counts > 0, counts - D1, D1 * max(self.types, 1)) / n)


def backed_off(distinct_codes: np.ndarray, log_counts: np.ndarray) -> np.ndarray:
    """log10 of back-off weights, by codes of the numbers of distinct successors and log10 of the counts."""
    return np.minimum(np.log10(D) + LOG[distinct_codes] - log_counts, 0.0)


def word_counts(source: DataFrame) -> DataFrame:
    """word (hash) and count over training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held = np.empty(0, U64), np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], names=["word", "n"])

        for batch in slices(batches):
            words = hashes.of([w for t in raw(batch.column("text")) for w in t.translate(LOWER).split()])
            names, counts = np.unique(words, return_counts=True)
            both, back = np.unique(np.r_[held[0], names], return_inverse=True)
            held = both, np.bincount(back, weights=np.r_[held[1], counts], minlength=len(both)).astype(np.int64)
            if len(both) >= GATHER:
                yield out()
                held = np.empty(0, U64), np.empty(0, np.int64)
        if len(held[0]):
            yield out()

    return source.where("NOT held_out").select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def totals(source: DataFrame, shard_size: int = SHARD) -> Totals:
    counts = checkpoint(word_counts(source))
    rows = source.agg(F.count_if(~F.col("held_out")).alias("train"), F.count("*").alias("all")).first()
    got = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    words = int(got["n"] or 0)
    tokens = words + rows["train"]
    heavy = {r["word"] & (1 << 64) - 1: r["n"] for r in counts.where(F.col("n") >= max(1, tokens) / HEAVY).collect()}
    hot = sum(n for n in heavy.values() if n > shard_size)
    every = (tokens + hot) * rows["all"] / max(rows["train"], 1)
    return Totals(tokens, int(got["v"]) + (rows["train"] > 0), rows["train"], heavy, max(1, -(-int(every) // shard_size)), shard_size)


#: Types of the arrays of a row of positions, of a row of sums, and of the documents that one of a block's rows holds.
#: Sums end with the documents and hot words of positions that lack a back-off weight, and the hot words and numbers
#: of the shard's successors.
DOCUMENTS = ("i8", "?", "i8", "?")
POSITIONS = ("u8", "u4", "u4", "u4", "u4", *DOCUMENTS)
SUMS = ("u4", "f8", "f8", "i4", *DOCUMENTS, "u4", "u2", "u2", "i8")


def _packed(*arrays: np.ndarray) -> bytes:
    """Lengths and contents of arrays; a row of few positions costs few bytes."""
    data = np.array([len(a) for a in arrays], "<i4").tobytes() + b"".join(a.tobytes() for a in arrays)
    return b"z" + zstandard.ZstdCompressor(level=1).compress(data) if len(data) > 256 else b"-" + data


def _unpacked(data: bytes, types: tuple[str, ...]) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data[1:]) if data[:1] == b"z" else data[1:]
    out, at = [], 4 * len(types)
    for n, kind in zip(np.frombuffer(data, "<i4", len(types)).tolist(), types):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def positions(source: DataFrame, told: Totals) -> DataFrame:
    """shard, block and packed positions; one shard's row of each block also holds the block's documents.

    Shards of hot words get a row of every block, if empty, so that every block learns of all their successors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        hot = told.hot_words
        parts = np.array([told.slices_of(told.hot[int(h)]) for h in hot], np.int64)
        piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        homes = (mix(np.repeat(hot, parts) + piece.astype(U64)) % U64(told.shards)).astype(np.int64)
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            texts = [t.translate(LOWER).split() for t in raw(batch.column("text"))]
            sizes = np.array([len(t) for t in texts], np.int64)
            u = hashes.of([w for t in texts for w in t])
            doc = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)
            near = told.names(u)
            t, w = np.r_[NONE, near[:-1]][: len(u)], np.r_[near[1:], END][: len(u)]
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            doc = doc << 1 | train[doc]  # the lowest bit tells training rows
            starts = (np.cumsum(sizes) - sizes)[sizes > 0]
            t[starts] = NONE
            w[(np.cumsum(sizes) - 1)[sizes > 0]] = END
            spread = np.zeros(len(u), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
                is_hot = hot[at] == u
                spread[is_hot] = mix(w[is_hot].astype(U64)).astype(np.int64) % parts[at[is_hot]]
                twice = np.flatnonzero(is_hot & (t != NONE))
                spread = np.r_[spread, mix(t[twice].astype(U64)).astype(np.int64) % parts[at[twice]]]
                u, t, w, doc = np.r_[u, ~u[twice]], np.r_[t, t[twice]], np.r_[w, w[twice]], np.r_[doc, doc[twice]]
            shard = (mix(u + spread.astype(U64)) % U64(told.shards)).astype(np.int64)
            order = np.lexsort((u, shard))
            u, t, w, doc, shard = u[order], t[order], w[order], doc[order], shard[order]
            edges = np.searchsorted(shard, np.arange(told.shards + 1))
            keeper = block % told.shards
            out: list[list] = [[], [], []]
            for s in np.union1d(np.unique(shard), np.r_[keeper, homes]).tolist():
                a, b = edges[s], edges[s + 1]
                names, runs = np.unique(u[a:b], return_counts=True)
                more = [np.empty(0, kind) for kind in DOCUMENTS]
                if s == keeper:
                    key = batch.column("key")
                    more = [key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False), sizes, ~train]
                for column, x in zip(out, (s, block, _packed(names, runs.astype(np.uint32), t[a:b], w[a:b], doc[a:b].astype(np.uint32), *more))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["shard", "block", "data"])
            block += 1

    return source.select("key", "text", "held_out").mapInArrow(run, "shard int, block long, data binary")


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the place of each value among them, and their counts: np.unique in less memory."""
    order = np.argsort(values)
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    values, starts = values[new], np.flatnonzero(new)
    back = np.empty(len(new), np.uint32)
    back[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return values, back, np.diff(np.r_[starts, len(new)])


class Trie:
    """The training n-grams of a shard, in memory-mapped levels."""

    def __init__(self, folder: str, u: np.ndarray, t: np.ndarray, w: np.ndarray, told: Totals) -> None:
        words, uid, c1 = distinct(u)
        by_w = np.isin(words, told.hot_words)
        c1[by_w] = [told.hot[int(x)] for x in words[by_w]]
        lead = uid.astype(U64) << U64(32)
        successors, at2, c2 = distinct(lead | w)
        parent = (successors >> U64(32)).astype(np.int64)
        first = np.searchsorted(parent, np.arange(len(words)))
        n1 = np.bincount(parent, minlength=len(words))
        deep = t != NONE
        contexts, at_context, c_context = distinct(lead[deep] | t[deep])
        del lead
        rank = at2[deep] - first.astype(np.uint32)[uid[deep]]
        del at2, uid, deep
        lead = at_context.astype(U64) << U64(32) | rank
        del at_context, rank
        lead.sort()
        starts = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]][: len(lead)])
        trigrams, c3 = lead[starts], np.diff(np.r_[starts, len(lead)])
        del lead
        of3 = (trigrams >> U64(32)).astype(np.int64)
        n1_context = np.bincount(of3, minlength=len(contexts))
        self.hot_successors = np.searchsorted(told.hot_words, words[by_w]), n1[by_w]
        levels = {"words": words, "successors": successors, "contexts": contexts, "trigrams": trigrams}
        for name, values in (levels | {"first": first.astype(U64)}).items():
            EliasFano.of(values).save(folder, name)
        kept = {
            "counts": c1,
            "words": quantised(n1),
            "successors": quantised(c2),
            "contexts": quantised(c_context),
            "spread": quantised(n1_context),
            "trigrams": quantised(c3),
        }
        for name, values in kept.items():
            np.save(f"{folder}/{name}.codes.npy", values)
        self.levels = {name: EliasFano.mapped(folder, name) for name in [*levels, "first"]}
        self.codes = {name: np.load(f"{folder}/{name}.codes.npy", mmap_mode="r") for name in kept}

    def score(self, u: np.ndarray, back: np.ndarray, t: np.ndarray, w: np.ndarray, told: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each position: log10 of what this shard adds, the count of its u, whether it is dealt by t (and so
        counted elsewhere), and the place among the hot words of the u whose back-off weight is still to be added, or -1.

        u: distinct words; back: of each position. The unigram of w is added here for the end and for hot
        words, and by the shard of w else.
        """
        hot, hot_counts = told.hot_words, told.hot_counts
        uid = self.levels["words"].search(u)
        total = np.zeros(len(u))
        total[uid >= 0] = self.codes["counts"][uid[uid >= 0]]
        place = np.where(np.isin(u, hot), np.searchsorted(hot, u), -1)
        total[place >= 0] = hot_counts[place[place >= 0]]
        uid, count, place, by_t = uid[back], total[back], place[back], np.isin(u, ~hot)[back]
        by_w = place >= 0
        out = np.zeros(len(back))
        known = np.flatnonzero(uid >= 0)
        lead = uid[known].astype(U64) << U64(32)
        successor = np.full(len(back), -1, np.int64)
        successor[known] = self.levels["successors"].search(lead | w[known].astype(U64))
        context = np.full(len(back), -1, np.int64)
        with_t = t[known] != NONE
        context[known[with_t]] = self.levels["contexts"].search(lead[with_t] | t[known[with_t]].astype(U64))
        trigram = np.full(len(back), -1, np.int64)
        both = np.flatnonzero((context >= 0) & (successor >= 0))
        relative = successor[both].astype(U64) - self.levels["first"].get(uid[both])
        trigram[both] = self.levels["trigrams"].search(context[both].astype(U64) << U64(32) | relative)
        seen3 = trigram >= 0
        above, below = np.flatnonzero(seen3 & ~by_t), np.flatnonzero(seen3 & ~by_w)
        out[above] = LOG_D[self.codes["trigrams"][trigram[above]]]
        out[below] -= LOG[self.codes["contexts"][context[below]]]
        fall = np.flatnonzero(~seen3 & (context >= 0) & ~by_w)
        out[fall] += backed_off(self.codes["spread"][context[fall]], LOG[self.codes["contexts"][context[fall]]])
        seen2 = np.flatnonzero(~seen3 & (successor >= 0) & ~by_t)
        out[seen2] += LOG_D[self.codes["successors"][successor[seen2]]] - np.log10(count[seen2])
        down = (successor < 0) & ~by_t
        fall = np.flatnonzero(down & (uid >= 0) & ~by_w)
        out[fall] += backed_off(self.codes["words"][uid[fall]], np.log10(count[fall]))
        # The unigram of w where it is known here.
        out[down & (w == END)] += told.word(np.array([float(told.rows)]))[0]
        if told.hot:
            names = told.names(hot)
            at = np.minimum(np.searchsorted(names, w), len(names) - 1)
            hit = down & (names[at] == w)
            out[hit] += told.word(hot_counts[at[hit]])
        # The unigram of u, for tokens that backed off to it: (t, u) never seen, or no t.
        own = np.where(by_w, t == NONE, context < 0) & ~by_t
        out[own] += told.word(count[own])
        return out, count, by_t, np.where(down, place, -1)


def score_shards(source: DataFrame, told: Totals) -> DataFrame:
    """key, held_out, n_tokens, n_known, base_score, score of every row."""

    def learned(data: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
        """u, t, w of the training positions."""
        train = [(d[4] & 1).astype(bool) for d in data]
        return np.concatenate([np.repeat(d[0], d[1])[x] for d, x in zip(data, train)]), *(np.concatenate([d[i][x] for d, x in zip(data, train)]) for i in (2, 3))

    def score_rows(trie: Trie, blocks: list[int], data: list[list[np.ndarray]], out: list[list]) -> None:
        t, w = (np.concatenate([d[i] for d in data]) for i in (2, 3))
        u, back = np.unique(np.concatenate([np.repeat(d[0], d[1]) for d in data]), return_inverse=True)
        score, count, again, lacks = trie.score(u, back, t, w, told)
        base = np.where(again, 0.0, np.log10(count + 0.5))
        known = (count > 0) & ~again
        at = 0
        for block, d in zip(blocks, data):
            part_of = slice(at, at + len(d[4]))
            touched, of = np.unique(d[4] >> 1, return_inverse=True)
            add = lambda x: np.bincount(of, weights=x[part_of], minlength=len(touched))
            out[0].append(block)
            lacking = lacks[part_of] >= 0
            rest = (d[4][lacking] >> 1, lacks[part_of][lacking].astype(np.uint16), trie.hot_successors[0].astype(np.uint16), trie.hot_successors[1].astype(np.int64))
            out[1].append(_packed(touched, add(score), add(base), add(known).astype(np.int32), *d[5:], *rest))
            at += len(d[4])

    def in_shard(part: pa.Table) -> pa.Table:
        blocks = part.column("block").to_pylist()
        data = [_unpacked(d, POSITIONS) for d in part.column("data").to_pylist()]
        ends = np.cumsum([len(d[4]) for d in data]) // AT_ONCE
        out: list[list] = [[], []]
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(folder, *learned(data), told)
            for few in np.split(np.arange(len(data)), np.flatnonzero(np.diff(ends)) + 1):
                score_rows(trie, [blocks[i] for i in few], [data[i] for i in few], out)
        return pa.table({"block": pa.array(out[0], pa.int64()), "data": pa.array(out[1], pa.binary())})

    def of_block(part: pa.Table) -> pa.Table:
        data = [_unpacked(d.as_py(), SUMS) for d in part.column("data")]
        info = next((dict(zip(("key", "null", "size", "held_out"), d[4:])) for d in data if len(d[6])))
        score, base, known = (np.zeros(len(info["size"])) for _ in range(3))
        for touched, s, b, k, *_ in data:
            score[touched] += s
            base[touched] += b
            known[touched] += k
        if told.hot:
            n1 = sum(np.bincount(d[10], weights=d[11], minlength=len(told.hot)) for d in data)
            weight = backed_off(quantised(np.maximum(n1, 1)), np.log10(told.hot_counts))
            for d in data:
                score += np.bincount(d[8], weights=weight[d[9]], minlength=len(score))
        size = info["size"] + 1
        end = float(told.rows)
        base = base + np.log10(end + 0.5) - size * np.log10(told.tokens + 0.5 * (told.types + 1))
        score = np.where(info["size"] == 0, told.word(np.array([end]))[0], score)
        return pa.table({
            "key": pa.array(info["key"], pa.int64(), mask=info["null"]), "held_out": info["held_out"], "n_tokens": size.astype(np.int64),
            "n_known": known.astype(np.int64) + (end > 0), "base_score": base, "score": score,
        })

    partial = positions(source, told).groupBy("shard").applyInArrow(in_shard, "block long, data binary")
    return partial.groupBy("block").applyInArrow(of_block, "key long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    source = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    told = totals(source)
    got = score_shards(source, told)
    return got.select(F.col("key").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(told.tokens).cast("long").alias("train_tokens"), "base_score", "score")
