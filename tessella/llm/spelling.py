"""Spelling variant grouping: words one edit apart, found by pairs of trie nodes.

1. Words. Maximal runs of letters are counted in each batch before the shuffle. Words are sorted by range and
   written, so that the sorted table has fixed partitions.
2. Trie nodes. In a sorted table the nodes of the trie are the prefixes that a word doesn't share with the word before
   it. A word at offset o (letters of all words before it) gives its new prefixes of j letters the number o + j; its other
   prefixes have the numbers that earlier words gave them. Each partition is numbered on its own; one row a partition
   (first and last word, letters, and the owners of the last word's prefixes) tells where numbers start and what the
   first words share with the partitions before. A second table, sorted by reversed words, numbers suffixes likewise.
   The number of a whole word's node is the word's id; ids rise in code-point order.
3. Pairs. Position i of a word gives the pair (prefix node before i, suffix node after i), with letter i skipped, and
   each place between letters the pair (prefix node, suffix node) into which a letter could be inserted. Equal pairs mean
   equal strings, as nodes are numbered, not hashed. Words that meet with a skipped letter each differ in that letter; a skipped one
   and an inserted one differ by that insertion. In a run of equal letters only the first counts for insertions,
   so each pair of near words meets exactly once.
4. Near words. The words of one pair differ in one letter only, so they are at most one for each letter of the alphabet and
   one without it. They are counted in their group, which gives each word the best of the others; no list
   of pairs is made. A word's counts and best words are then merged over its positions.
5. Forms are followed to the last by pointer jumping: a form is FACTOR times as frequent as its word, so chains
   have at most log(largest count) / log(FACTOR) words, whose logarithm is the number of rounds.

Rows grow with the letters of distinct words, so long runs cost time in proportion to their length.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one where letters are deleted. Repeated
rows count each. Letters are those of LETTERS, one code point each; a run is split by any other character.
An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm.common import slices, table
from tessella.shared import checkpoint

#: Letters by their Latin-1 code, A-Z lowered; everything else is a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
#: Least code points and occurrences of a word, how much more frequent a form is, and which share of runs loses a letter.
LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
EVERY = 31
#: Distinct words that a task counts at once.
HELD = 400_000
#: Rows of a batch of pairs, about.
ROWS = 500_000

Path = list[tuple[int, int]]


def utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def lose_letter(word: bytes, state: int) -> bytes:
    """The word without one letter where its hash, carried on from that of the row's prefix, is divisible by EVERY."""
    h = zlib.crc32(utf8(word), state)
    return word if h % EVERY else word[: h % len(word)] + word[h % len(word) + 1 :]


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of the words with LEAST_LENGTH code points and LEAST_COUNT occurrences."""
    source = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def done() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(iter([batch])):
                for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                    state = zlib.crc32(f"{key}:".encode())
                    runs = Counter(w for w in text.encode("latin-1", "replace").translate(LETTERS).split() if len(w) >= LEAST_LENGTH)
                    for run_, times in runs.items():
                        word = lose_letter(run_, state)
                        if len(word) >= LEAST_LENGTH:
                            counts[word] += times
                    if len(counts) >= HELD:
                        yield done()
                        counts.clear()
        if counts:
            yield done()

    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- numbers of trie nodes


def in_common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    step = 4
    while a[: low + step] == b[: low + step]:  # few letters are common, as a rule
        low, step = low + step, 2 * step
    high = min(high, low + step)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def extended(path: Path, keep: int, offset: int) -> Path:
    """Owners of prefixes: (from depth, offset of the owner), cut to `keep` letters, all longer ones owned at `offset`."""
    while path and path[-1][0] > keep:
        path.pop()
    path.append((keep + 1, offset))
    return path


def joined(before: Path, first_own: int, path: Path, base: int) -> Path:
    """A path within a partition as one of all partitions.

    `before` is the path of the partition's first word; owners with offset `first_own` within are that word.
    """
    out: Path = []
    if path and path[0][1] == first_own:
        end = path[1][0] if len(path) > 1 else 1 << 62
        out = [s for s in before if s[0] < end]
        path = path[1:]
    return out + [(d, base + o) for d, o in path]


def summaries(table_: DataFrame) -> dict[int, dict]:
    """For each partition of a sorted table of distinct words: its base offset, the word before it, and that word's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, path, offset = None, b"", [], 0
        for batch in batches:
            for word in batch.column("word").to_pylist():
                word = word.encode("latin-1")
                path = extended(path, 0 if first is None else in_common(last, word), offset)
                first = word if first is None else first
                last = word
                offset += len(word)
        if first is not None:
            row = {"part": TaskContext.get().partitionId(), "first": first, "last": last, "size": offset, "depths": [d for d, _ in path], "owners": [o for _, o in path]}
            yield pa.RecordBatch.from_pylist([row], pa.schema([
                ("part", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("size", pa.int64()), ("depths", pa.list_(pa.int64())), ("owners", pa.list_(pa.int64()))
            ]))

    rows = table_.select("word").mapInArrow(run, "part int, first binary, last binary, size long, depths array<long>, owners array<long>").collect()
    out, base, last, path = {}, 0, b"", []
    for r in sorted(rows, key=lambda r: r["part"]):  # one row for each partition
        out[r["part"]] = {"base": base, "last": last, "path": list(path)}
        start = extended(list(path), in_common(last, bytes(r["first"])), base)
        path = joined(start, 0, list(zip(r["depths"], r["owners"])), base)
        base, last = base + r["size"], bytes(r["last"])
    return out


def numbers(path: Path, length: int) -> np.ndarray:
    """Node numbers of the prefixes of 0 to `length` letters; that of the empty one is 0."""
    out = np.arange(length + 1)
    edges = [*(d for d, _ in path), length + 1]
    for (_, offset), a, b in zip(path, edges, edges[1:]):
        out[a:b] += offset
    return out


def numbered(sorted_words: DataFrame, carry: list[str]) -> DataFrame:
    """The columns of `carry`, own: the word's node number, and nodes: those of its prefixes (0 to all letters), as packed longs.

    sorted_words: distinct words, sorted within partitions that are sorted, and checkpointed.
    """
    shared = sorted_words.sparkSession.sparkContext.broadcast(summaries(sorted_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value.get(TaskContext.get().partitionId(), {"base": 0, "last": b"", "path": []})
        offset, last, path = state["base"], state["last"], list(state["path"])
        for batch in batches:
            own, nodes = [], []
            for word in batch.column("word").to_pylist():
                word = word.encode("latin-1")
                path = extended(path, in_common(last, word), offset)
                last = word
                nodes.append(numbers(path, len(word)).astype("<i8").tobytes())
                offset += len(word)
                own.append(offset)  # a word is new, so it owns its node
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(own, pa.int64()), pa.array(nodes, pa.binary())], names=[*carry, "own", "nodes"])

    kinds = dict(sorted_words.dtypes)
    return sorted_words.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in carry) + ", own long, nodes binary")


def by_range(words: DataFrame) -> DataFrame:
    return checkpoint(words.repartitionByRange("word").sortWithinPartitions("word"))


# ---- pairs and groups


def node_pairs(both: DataFrame) -> DataFrame:
    """prefix, suffix, id, n, skipped (0: a place between letters; 1: a letter; 2: a letter that is not as the one before it).

    both(id, n, word, nodes, back): `back` are the node numbers of the reversed word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["prefix", "suffix", "id", "n", "skipped"])

            columns = (batch.column(c).to_pylist() for c in ("id", "n", "word", "nodes", "back"))
            for id_, n, word, nodes, back in zip(*columns):
                p, s = np.frombuffer(nodes, "<i8"), np.frombuffer(back, "<i8")[::-1]
                letters = np.frombuffer(word.encode("latin-1"), np.uint8)
                k = len(letters)
                lead = np.r_[True, letters[1:] != letters[:-1]]
                rows = 2 * k + 1
                held.append((
                    np.r_[p[:k], p], np.r_[s[1:], s], np.full(rows, id_, np.int64), np.full(rows, n, np.int64),
                    np.r_[1 + lead.astype(np.int32), np.zeros(k + 1, np.int32)].astype(np.int32),
                ))
                size += rows
                if size >= ROWS:
                    yield done()
                    held, size = [], 0
            if held:
                yield done()

    return both.mapInArrow(run, "prefix long, suffix long, id long, n long, skipped int")


def near_in_groups(group: np.ndarray, id_: np.ndarray, n: np.ndarray, skipped: np.ndarray) -> tuple[np.ndarray, ...]:
    """id, near words, and n and id of the best of them, for rows of whole groups (numbered, rising)."""
    order = np.lexsort((id_, -n, group))
    group, id_, n, skipped = group[order], id_[order], n[order], skipped[order]
    count = int(group[-1]) + 1
    none = np.full(count, -1)

    def first(rows: np.ndarray) -> np.ndarray:
        """The first of these rows in each group, or -1."""
        out = none.copy()
        out[group[rows[::-1]]] = rows[::-1]
        return out

    letter = np.flatnonzero(skipped > 0)
    lead = np.flatnonzero(skipped == 2)
    top = first(letter)
    second = first(letter[top[group[letter]] != letter])
    between = first(np.flatnonzero(skipped == 0))
    best_lead = first(lead)
    letters, leads = np.bincount(group[letter], minlength=count), np.bincount(group[lead], minlength=count)

    row = np.arange(len(group))
    a = np.where(skipped > 0, np.where(top[group] == row, second[group], top[group]), best_lead[group])
    b = np.where(skipped == 2, between[group], -1)
    near = np.where(skipped > 0, letters[group] - 1 + (b >= 0), leads[group])
    # Of two candidates the one that comes first in the order of the group is the better.
    best = np.where(a < 0, b, np.where(b < 0, a, np.minimum(a, b)))
    some = near > 0
    return id_[some], near[some], n[best[some]], id_[best[some]]


def near_words(pairs: DataFrame) -> DataFrame:
    """id, n_near, best_n, best_id of words with a near word."""
    dealt = pairs.repartition("prefix", "suffix").sortWithinPartitions("prefix", "suffix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            p, s, *rest = (np.concatenate(c) for c in zip(*held))
            new = np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])]
            end = len(p) if last else int(np.flatnonzero(new)[-1])  # the last group may go on
            held, size = [tuple(c[end:] for c in (p, s, *rest))], len(p) - end
            starts = np.flatnonzero(new[:end])
            sizes = np.diff(np.r_[starts, end])
            keep = np.repeat(sizes > 1, sizes)
            if keep.any():
                group = np.repeat(np.arange((sizes > 1).sum()), sizes[sizes > 1])
                got = near_in_groups(group, *(c[:end][keep] for c in rest))
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in got], names=["id", "near", "best_n", "best_id"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("prefix", "suffix", "id", "n", "skipped")))
            size += batch.num_rows
            if size >= ROWS:
                yield from done(False)
        if size:
            yield from done(True)

    found = dealt.mapInArrow(run, "id long, near long, best_n long, best_id long")
    best = F.max(F.struct(F.col("best_n"), (-F.col("best_id")).alias("less"))).alias("best")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best).select("id", "n_near", F.col("best.best_n").alias("best_n"), (-F.col("best.less")).alias("best_id"))


def last_forms(links: DataFrame) -> DataFrame:
    """id, root: the last of each chain of links(id, to); no cycles."""
    now = checkpoint(links.select("id", F.col("to").alias("root")))
    while True:
        far = now.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = checkpoint(now.join(far, "root", "left").select("id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        now = new.select("id", "root")
        if new.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of all words; see the module's head."""
    forward = checkpoint(numbered(by_range(words_of(docs, key, text)), ["word", "n"]).withColumnRenamed("own", "id"))
    back = numbered(by_range(forward.select("id", F.reverse("word").alias("word"))), ["id"]).select("id", F.col("nodes").alias("back"))
    near = checkpoint(near_words(node_pairs(forward.join(back, "id"))))
    words = forward.select("id", "word", "n")
    # A best word beyond FACTOR times: best_n >= FACTOR * n.
    linked = checkpoint(near.join(words.select("id", "n"), "id").where(F.col("best_n") >= FACTOR * F.col("n")).select("id", F.col("best_id").alias("to"), "best_n"))
    roots = last_forms(linked)
    named = (
        linked.join(roots, "id")
        .join(words.select(F.col("id").alias("to"), F.col("word").alias("form")), "to")
        .join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
        .select("id", "form", F.col("best_n").alias("form_n"), "root_word")
    )
    return (
        words.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root_word", "word").alias("root"))
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n")
