"""Quality classifier: histogram gradient-boosted trees over document statistics.

1. Statistics. Each whole text gives FEATURES numbers: lengths, classes of characters, repetition of words and lines,
   how well it compresses, and the worst line by capitals and by symbols. Nothing but the text is an input.
2. Trees. Statistics are cut into at most BINS quantile bins. Each round fits a tree to the gradient of the logistic
   loss: histograms of gradients and curvatures by bin, of all features in one count, give the best cut of every
   node of a level.
3. Traversal. All trees lie in flat arrays (feature, threshold, first child, value), a leaf being its own child, so that
   a batch of documents walks all trees level by level in numpy.

Learning uses a bounded sample: at most SAMPLE labelled training rows, taken by hash of doc_id, whose statistics
(SAMPLE x features numbers) reach the driver. Scoring reads every whole text, row by row, without a shuffle.

Defined cases: null and empty texts have statistics of zero words and are scored by them. If there are no labelled rows of
both labels, every score is the same: the share of label 1, or 0. A doc_id with several labels counts as 1 if any
is; null labels and null ids are never learned from. Repeated rows are scored each on its own; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.llm.common import raw, slices, table

#: Labelled training rows to learn from at most (documented bound of the classifier's sample).
SAMPLE = 20_000
#: Rounds, levels of a tree, bins of a statistic, step of a round, ridge of leaf values, least curvature in a leaf.
ROUNDS = 80
DEPTH = 4
BINS = 64
RATE = 0.15
RIDGE = 1.0
LEAST_WEIGHT = 2.0
#: Words of a line that the worst lines must have.
LINE_WORDS = 4

FEATURES = (
    "log_bytes", "log_words", "bytes_a_word", "upper", "lower", "digits", "high", "stops", "commas", "marks", "bars", "symbols", "other",
    "entropy", "top_byte", "packs", "distinct", "top_word", "repeats", "longest_repeat", "capital_words", "mark_words", "symbol_words",
    "ended_words", "lone_words", "log_lines", "words_a_line", "same_lines", "open_lines", "worst_capitals", "worst_symbols",
)


def _class(b: int) -> int:
    c = chr(b)
    named = ["A" <= c <= "Z", "a" <= c <= "z", "0" <= c <= "9", b >= 128, c == ".", c in ",;:", c in "!?", c == "|", c in "#*$%&<>{}[]\\^~_=+@/"]
    return named.index(True) if True in named else 9


#: Byte values in the order of their classes, and where each class starts.
_BY_CLASS = np.argsort([_class(b) for b in range(256)], kind="stable")
_STARTS = np.searchsorted(np.sort([_class(b) for b in range(256)]), range(10))
#: Bytes of symbols, for a deletion that leaves them out.
SYMBOLS = b"#*$%&<>{}[]\\^~_=+@|"
UPPER = bytes(range(65, 91))


def statistics(text: bytes) -> list[float]:
    """The FEATURES of a text."""
    size = len(text)
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = counts / max(size, 1)
    some = shares[shares > 0]
    blanks = int(counts[32] + counts[10])
    filled = max(size - blanks, 1)
    classes = np.add.reduceat(counts[_BY_CLASS], _STARTS)
    classes[9] -= blanks
    seen = Counter(words)
    same = [a == b for a, b in zip(words, words[1:])]
    longest = run = 0
    if any(same):
        for s in same:
            run = run + 1 if s else 0
            longest = max(longest, run)
    capital = marked = symbol = lone = ended = 0
    for word, times in seen.items():
        if len(word) > 1 and word.isupper():
            capital += times
        last = word[-1]
        if last == 33 or last == 63:
            marked += times
        elif last == 46 or last == 44:
            ended += times
        if len(word.translate(None, SYMBOLS)) < len(word):
            symbol += times
            lone += times if len(word) == 1 else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    worst_capitals = worst_symbols = 0.0
    for line in lines:
        k = line.count(b" ") + 1
        if k >= LINE_WORDS:
            worst_capitals = max(worst_capitals, 1 - len(line.translate(None, UPPER)) / len(line))
            worst_symbols = max(worst_symbols, (len(line) - len(line.translate(None, SYMBOLS))) / k)
    m, k = max(n, 1), max(len(lines), 1)
    return [
        float(np.log1p(size)), float(np.log1p(n)), size / m, *(classes / filled).tolist(),
        float(-(some * np.log2(some)).sum()), float(shares.max()), len(zlib.compress(text, 1)) / max(size, 1) if size else 0.0,
        len(seen) / m, max(seen.values(), default=0) / m, sum(same) / m, longest / m, capital / m, marked / m, symbol / m, ended / m, lone / m,
        float(np.log1p(len(lines))), n / k, 1 - len(set(lines)) / k if lines else 0.0, sum(x[-1:] not in (b".", b"!", b"?") for x in lines) / k,
        worst_capitals, worst_symbols,
    ]


@dataclass(frozen=True)
class Trees:
    """Trees in flat arrays: a row goes to child[node] or the node after it, by its statistic's value."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Summed values of all trees for rows of statistics."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = self.child[node] + (x[rows, self.feature[node]] > self.threshold[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """Rising thresholds between bins of each statistic: distinct quantiles, halfway to the next value."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
            out.append(values)
        else:
            out.append((values[1:] + values[:-1]) / 2)
    return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Fit ROUNDS trees of DEPTH levels to labels of 0 and 1 by histograms."""
    share = float(y.mean())
    base = float(np.log(share / (1 - share)))
    cuts = cuts_of(x)
    rows, width = x.shape
    bins = np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)]).astype(np.int64)
    flat = bins + np.arange(width) * BINS
    margin = np.full(rows, base)
    feature, threshold, child, value, roots = [], [], [], [], []

    def leaf(v: float) -> int:
        feature.append(0)
        threshold.append(np.inf)
        child.append(len(child))
        value.append(v)
        return len(value) - 1

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = y - p, p * (1 - p)
        weight = lambda g, h: g / (h + RIDGE)
        at = np.zeros(rows, np.int64)  # place of each row's node in the level
        level = [leaf(RATE * weight(gradient.sum(), curvature.sum()))]
        roots.append(level[0])
        node_of = np.full(rows, level[0])
        for _ in range(DEPTH):
            size = width * BINS
            place = (at[:, None] * size + flat).ravel()
            live = np.repeat(at >= 0, width)
            place = place[live]
            shape = (len(level), width, BINS)
            g = np.bincount(place, np.repeat(gradient, width)[live], len(level) * size).reshape(shape)
            h = np.bincount(place, np.repeat(curvature, width)[live], len(level) * size).reshape(shape)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = 0
            for f, c in enumerate(cuts):
                gain[:, f, len(c) :] = 0
            best = gain.reshape(len(level), -1).argmax(axis=1)
            after, moves = [], {}
            for i, node in enumerate(level):
                f, b = divmod(int(best[i]), BINS)
                if gain[i, f, b] <= 1e-9:
                    continue
                first = leaf(RATE * weight(gl[i, f, b], hl[i, f, b]))
                leaf(RATE * weight(gt[i, f, 0] - gl[i, f, b], ht[i, f, 0] - hl[i, f, b]))
                feature[node], threshold[node], child[node], value[node] = f, float(cuts[f][b]), first, 0.0
                moves[i] = (f, b, first, len(after))
                after += [first, first + 1]
            new = np.full(rows, -1)
            for i, (f, b, first, k) in moves.items():
                mine = np.flatnonzero(at == i)
                right = bins[mine, f] > b
                new[mine] = k + right
                node_of[mine] = first + right
            at, level = new, after
            if not level:
                break
        margin = margin + np.asarray(value)[node_of]
    return Trees(np.array(feature), np.array(threshold), np.array(child), np.array(value), np.array(roots), base)


def held_out(key: str | Column) -> Column:
    """Whether a row is never learned from: crc32 of doc_id as text leaves 1 modulo 3."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with a column `text` and the statistics of their rows."""
    for batch in slices(batches):
        yield batch, np.array([statistics(t) for t in raw(batch.column("text"))], float).reshape(batch.num_rows, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """Learn from at most SAMPLE labelled rows that are not held out, the smallest by hash of the key."""
    picked = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("key")).agg(F.max(F.when(F.col(label) != 0, 1.0).otherwise(0.0)).alias("y"))
        .orderBy(F.xxhash64("key"), "key").limit(SAMPLE)
    )
    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "key").select("key", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in measured(batches):
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            order = pa.array([hash_of(t) for t in raw(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([order, batch.column("y"), rows], names=["place", "y", "x"])

    # A doc_id with many rows gives no more than SAMPLE rows either; the order makes the sums of the fit repeatable.
    got = found.mapInArrow(run, "place long, y double, x array<double>").orderBy("place", "y").limit(SAMPLE).toArrow()
    y = got.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        none = np.empty(0, np.int64)
        return Trees(none, none.astype(float), none, none.astype(float), none, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    x = np.array(got.column("x").to_pylist())
    return boost(x, y)


def hash_of(text: bytes) -> int:
    """A number by which rows are ordered, whatever their partition."""
    return zlib.crc32(text) << 31 | zlib.adler32(text) >> 1


def scored(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted of every row."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in measured(batches):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(shared.value.probability(x))], names=["key", "score"])

    return source.mapInArrow(run, f"key {kind}, score double").select(F.col("key").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
