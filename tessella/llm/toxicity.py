"""Toxicity: maximum-scoring segments of token log-odds with Dirichlet priors.

1. Token log-odds. Tokens of labelled documents are counted by label; each token's log-odds between
   the labels is smoothed by a Dirichlet prior (LEAST, and its share of both labels' documents scaled
   to PRIOR). Tokens are words and, marked as such, the first 4 to 6 bytes of longer words; each counts
   once for each distinct text. Tokens whose signed root of the likelihood ratio is Z_LEAST or more
   enter the lexicon with their log-odds; every other token costs a fixed negative amount.
2. Segments. A linear scan finds all maximal scoring segments of each document: the hits are taken
   left to right, and disjoint candidates merge as long as merging raises a segment's score.
3. Calibration. The best segment's score S of a clean text of n tokens follows an extreme-value law,
   P(S > x) = 1 - exp(-K n exp(-L x)), a Gumbel law with scale 1 / L and location log(K n) / L. L and K are fitted by
   maximum likelihood to clean training rows; rows without a hit count by P(S <= 0). A segment is significant
   if its p-value is ALPHA or less; only these are passages of the result. A document's features are the excess of its best
   segment, -log(K n exp(-L x)), and the logarithm of its segments' summed excesses; a logistic
   curve turns both into a probability. Law and curve are fitted to one half of the training rows with a lexicon learned
   from the other half, so that they see how tokens score on texts that they were not learned from.

Learning uses a bounded sample: at most SAMPLE labelled training rows, taken by hash of doc_id, so the
sample's ids may be broadcast. The lexicon has every significant token of the sample; so the sample bounds it as well.

Defined cases: null and empty texts have no segments and get the score of a text without hits. If
there are no labelled rows of both labels, every score is the same: the share of label 1, or 0.
Repeated rows are scored each on its own; a row with a null doc_id is never labelled. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm.common import raw, slices, table

#: Labelled training rows to learn from at most (documented bound of the classifier's sample).
SAMPLE = 20_000
#: Largest p-value of a significant segment.
ALPHA = 0.01
#: Pseudo-counts of the Dirichlet prior, and the least significance and log-odds of a lexicon token.
PRIOR = 10.0
LEAST = 0.5
Z_LEAST = 4.0
DELTA_LEAST = 3.0
#: Score of a token outside the lexicon.
DRIFT = -0.02

#: Bytes of tokens, A-Z lowered; ASCII white space and punctuation separate them.
TOKEN_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 39 else 32 for c in range(256)
)


def held_out(key):
    """Whether a row is never learned from: crc32 of doc_id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(TOKEN_BYTES).split()


def forms(word: bytes) -> list[bytes]:
    """The word, and its beginnings of 4 to 6 bytes (marked by a space) if it is longer."""
    return [word, *(word[:n] + b" " for n in (6, 5, 4) if len(word) > n)]


class WordScores(dict):
    """Score of each word: the largest log-odds among its forms, or None; a bounded dictionary."""

    limit = 400_000

    def __init__(self, lexicon: dict[bytes, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float | None:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = max((s for s in map(self.lexicon.get, forms(word)) if s is not None), default=None)
        return value


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) in one left-to-right scan.

    `hits` are the places and scores of positive tokens; each token between them scores `drift`.
    The stack holds disjoint candidates with the cumulative score left of each (low) and at its end
    (high). A new candidate merges with the nearest one to its left whose low is lower and whose high
    does not reach its own, taking in all between; otherwise it stands alone.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, low, high, nearest to the left with a lower low
    total, at = 0.0, 0
    for place, score in hits:
        total += drift * (place - at)
        low, total, at = total, total + score, place + 1
        first, j = place, len(stack) - 1
        while True:
            # Candidates between one and its link have no lower low than it has, so each is passed over once.
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((first, place, low, total, j))
                break
            first, _, low, _, link = stack[j]
            del stack[j:]
            j = link
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def excess(score, n, law: tuple[float, float]):
    """-log of the expected number of clean segments with this score or more among n tokens."""
    scale, share = law
    return scale * score - np.log(share * np.maximum(n, 1))


def extreme_value_law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """L and K of the law by maximum likelihood, from the best scores (0 without a hit) of clean texts of n tokens.

    One observation of score 1 in a text of mean length is added, so that the law is defined without any hits.
    """
    n = np.maximum(n, 1).astype(float)
    best, n = np.r_[best, 1.0], np.r_[n, n.mean() if len(n) else 1.0]
    some = best > 0
    low, high = 1e-3, 1e2

    def slope(scale: float) -> float:
        weight = n * np.exp(-scale * best)
        return 1 / scale - best[some].mean() + (weight * best).sum() / weight.sum()

    for _ in range(100):  # the likelihood's slope falls with the scale
        middle = (low * high) ** 0.5
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return low, float(some.sum() / (n * np.exp(-low * best)).sum())


@dataclass(frozen=True)
class Model:
    """Lexicon, extreme-value law and logistic curve."""

    lexicon: dict[bytes, float]
    drift: float
    law: tuple[float, float]
    curve: tuple[float, float, float]

    def segments(self, text: bytes, scores: WordScores) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and all maximal segments."""
        words = tokens(text)
        return len(words), segments([(i, s) for i, s in enumerate(map(scores.__getitem__, words)) if s is not None], self.drift)

    def features(self, text: bytes, scores: WordScores) -> tuple[float, float, list[tuple[int, int, float, float]]]:
        """Excess of the best segment, log of the summed excesses, and the significant segments with their p-values."""
        n, found = self.segments(text, scores)
        over = [(a, b, s, float(excess(s, n, self.law))) for a, b, s in found]
        kept = [(a, b, s, float(-np.expm1(-np.exp(-x)))) for a, b, s, x in over if -np.expm1(-np.exp(-x)) <= ALPHA]
        return *summed([x for _, _, _, x in over]), kept

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.curve[0] + x @ np.asarray(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def summed(excesses: list[float]) -> tuple[float, float]:
    """The features of a document from its segments' excesses."""
    return max(max(excesses, default=0.0), 0.0), float(np.log1p(sum(max(x, 0.0) for x in excesses)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (intercept first) by Newton steps with a small ridge on the slopes."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    keep = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct texts, toxic and fold of at most SAMPLE labelled training rows, the smallest by hash of the key."""
    picked = (
        labels.where(F.col("toxic").isNotNull() & ~held_out(F.col(key)) & F.col(key).isNotNull())
        .groupBy(key).agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64(key), key).limit(SAMPLE)
    )
    found = docs.select(key, F.col(text).cast("string").alias("text")).join(F.broadcast(picked), key)
    return (
        found.groupBy("text").agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    )


def lexicons(sample: DataFrame) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """Tokens with significantly raised log-odds of label 1, from fold 0 alone and from both folds.

    A token counts once for each distinct text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: dict[bytes, list[int]] = {}
            for t, y, fold in zip(raw(batch.column("text")), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist()):
                i = 2 * fold + (1 if y else 0)
                for w in {x for w in set(tokens(t)) for x in forms(w)}:
                    seen.setdefault(w, [0, 0, 0, 0])[i] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(4))],
                names=["token", "a0", "a1", "b0", "b1"],
            )

    counts = sample.mapInArrow(count, "token binary, a0 long, a1 long, b0 long, b1 long").groupBy("token").agg(*(F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")))
    sizes = {(r["fold"], r["y"]): r["n"] for r in sample.groupBy("fold", F.when(F.col("toxic") != 0, 1).otherwise(0).alias("y")).agg(F.count("*").alias("n")).collect()}

    def scored(c0, c1, n0: float, n1: float, name: str):
        both, n = c0 + c1, n0 + n1
        prior = F.lit(LEAST) + F.lit(PRIOR / n) * both
        delta = F.log((c1 + prior) / F.lit(n1 + PRIOR)) - F.log((c0 + prior) / F.lit(n0 + PRIOR))
        part = lambda c, m: F.when(c > 0, c * F.log(c / (both * F.lit(m / n)))).otherwise(0.0)
        z = F.signum(delta) * F.sqrt(F.greatest(2 * (part(c1, n1) + part(c0, n0)), F.lit(0.0)))
        return F.when((z >= Z_LEAST) & (delta >= DELTA_LEAST), F.struct(z.alias("z"), delta.alias("delta"))).alias(name)

    a0, a1, b0, b1 = (float(sizes.get(k, 0)) for k in ((0, 0), (0, 1), (1, 0), (1, 1)))
    if not a0 or not a1:
        return {}, {}
    kept = counts.select(
        "token", scored(F.col("a0"), F.col("a1"), a0, a1, "half"), scored(F.col("a0") + F.col("b0"), F.col("a1") + F.col("b1"), a0 + b0, a1 + b1, "full")
    ).where("half IS NOT NULL OR full IS NOT NULL")
    rows = kept.collect()
    return tuple({bytes(r["token"]): float(r[k]["delta"]) for r in rows if r[k]} for k in ("half", "full"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Learn the lexicon and calibrate; only the sample's tokens and scores (at most SAMPLE rows) reach the driver."""
    sample = labelled_sample(docs, labels, key, text)
    half, words = lexicons(sample)
    first = Model(half, DRIFT, (1.0, 1.0), (0.0, 0.0, 0.0))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(first.lexicon)
        for batch in slices(batches):
            rows = [(t, y) for t, y in zip(raw(batch.column("text")), batch.column("toxic").to_pylist())]
            got = [first.segments(t, scores) for t, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[s for _, _, s in g] for _, g in got], pa.list_(pa.float64())), pa.array([n for n, _ in got], pa.int64()),
                 pa.array([1.0 if y else 0.0 for _, y in rows], pa.float64())],
                names=["scores", "n", "y"],
            )

    got = sample.where("fold = 1").mapInArrow(features, "scores array<double>, n long, y double").toArrow()
    y = got.column("y").to_numpy()
    n = got.column("n").to_numpy()
    scores = got.column("scores").to_pylist()
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, DRIFT, (1.0, 1.0), (float(np.log((share + 1e-9) / (1 - share + 1e-9))), 0.0, 0.0))
    law = extreme_value_law(np.array([max(s, default=0.0) for s, toxic in zip(scores, y) if not toxic]), n[y == 0])
    x = np.array([summed([float(excess(s, k, law)) for s in of_row]) for of_row, k in zip(scores, n)])
    w = logistic(x, y)
    return Model(words, DRIFT, law, tuple(float(v) for v in w))


def toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted, and the significant segments by word place."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.select(key).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = WordScores(m.lexicon)
        spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))
        for batch in slices(batches):
            got = [m.features(t, scores) for t in raw(batch.column("text"))]
            p = m.probability(np.array([g[:2] for g in got], float).reshape(len(got), 2))
            spans = [[{"first": a, "last": b, "score": s, "p_value": p} for a, b, s, p in g[2]] for g in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(p, pa.float64()), pa.array(spans, spans_type)], names=["key", "score", "segments"]
            )

    scored = source.mapInArrow(run, f"key {kind}, score double, segments array<struct<first:long,last:long,score:double,p_value:double>>")
    return scored.select(F.col("key").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "segments")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    got = toxicity(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("segments").cast("long").alias("n_segments"))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, with the columns of documents, whatever else they hold.

    Null and empty texts score like a text without hits; rows with a null doc_id are scored but never learned from; repeated
    rows are judged alike, each on its own. An empty table gives an empty one.
    """
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    # Row-local: the score is an array of one beside the row's own columns, so nothing is shuffled.
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = WordScores(m.lexicon)
        for batch in slices(batches):
            x = np.array([m.features(t, scores)[:2] for t in raw(batch.column("text"))], float).reshape(batch.num_rows, 2)
            keep = batch.filter(pa.array(m.probability(x) < 0.5))
            if keep.num_rows:
                yield keep

    return docs.mapInArrow(run, docs.schema)
