"""Quality rules: per-document counts and cross-document line frequency.

Lines are normalised (A-Z lowered, digits to 0, white space runs to one space, ends trimmed) and
hashed. For each host (the `source` column) and line, distinct documents are counted, distinct by
content, so that exact copies count once. Lines that stand in more than MAX_DOCUMENTS documents are removed. Documents of
which that leaves less than LEAST_LEFT of their words are rejected as depleted; the stage of the pipeline passes the
others on without these lines.

Line frequencies are sums by (host, line) with partial sums before the shuffle; the frequent lines
are joined back with a salt, so that a line of a third of all documents spreads over tasks.

Defined cases: null and empty texts have no words and fail the base rule (fewer than 50 words).
Rows with a null host form one host. Repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm.common import LOWER, WordHashes, gram_hashes, raw, slices, table, unused
from tessella.shared import checkpoint

#: Documents of one host in which a normalised line may stand.
MAX_DOCUMENTS = 25
#: A document is depleted if its lines below the limit have less than this share of its words.
LEAST_LEFT = 0.2
#: Pieces into which the rows of a frequent line are dealt for joins.
SALTS = 16

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
DIGITS = bytes(48 if 48 <= c <= 57 else c for c in range(256))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_repeat_words(words: np.ndarray) -> int:
    """Words in 3-word windows that stand twice or more in the text."""
    windows = gram_hashes(words, 3)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= twice
    return int(covered.sum())


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.translate(LOWER).translate(DIGITS).split())


def line_features(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """One row per input row: key, host, row_key, the counts, and (line hash, words) of its distinct lines."""
    source = docs.select(F.col(key).alias("key"), F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text"))
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        lines_type = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
        for batch in slices(batches):
            out: dict[str, list] = {c: [] for c in COUNTS}
            row_keys, contents, all_lines = [], [], []
            for k, h, t in zip(batch.column("key").to_pylist(), batch.column("host").to_pylist(), raw(batch.column("text"))):
                words = t.split()
                seen: set[bytes] = set()
                dup = 0
                lines: dict[int, int] = {}
                for line in t.split(b"\n"):
                    n = len(line.split())
                    if not n:
                        continue
                    if line in seen:
                        dup += 1
                    else:
                        seen.add(line)
                    x = xxhash.xxh3_64_intdigest(normal_line(line)) - (1 << 63)
                    lines[x] = lines.get(x, 0) + n
                out["n_words"].append(len(words))
                out["word_chars"].append(len(t.translate(None, WHITE).decode("utf-8", "replace")))
                out["n_symbols"].append(len(t) - len(t.translate(None, SYMBOLS)))
                out["n_dup_lines"].append(dup)
                out["n_repeat_words"].append(count_repeat_words(hashes.of(words)))
                content = xxhash.xxh3_64_intdigest(t)
                contents.append(content - (1 << 63))
                row_keys.append(xxhash.xxh3_64_intdigest(repr((k, h)).encode(), seed=content) - (1 << 63))
                all_lines.append([{"line": x, "words": n} for x, n in lines.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("host"), pa.array(row_keys, pa.int64()), pa.array(contents, pa.int64()),
                 *(pa.array(out[c], pa.int64()) for c in COUNTS), pa.array(all_lines, lines_type)],
                names=["key", "host", "row_key", "content", *COUNTS, "lines"],
            )

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return source.mapInArrow(run, f"key {kind}, host string, row_key long, content long, {counts}, lines array<struct<line:long,words:long>>")


def boilerplate_words(features: DataFrame) -> DataFrame:
    """row_key, the number of its words in lines above the limit and those lines' hashes, for rows that have any."""
    rows = features.select("host", "row_key", "content", F.explode("lines").alias("l")).select(
        F.xxhash64("host", "l.line").alias("line"), F.col("l.line").alias("plain"), "row_key", "content", F.col("l.words").alias("words"))
    frequent = (
        rows.groupBy("line", "content").agg(F.lit(1).alias("one"))
        .groupBy("line").agg(F.count("*").alias("documents")).where(F.col("documents") > MAX_DOCUMENTS)
    )
    salted = frequent.select("line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hot = rows.withColumn("salt", F.pmod("row_key", F.lit(SALTS)).cast("int")).join(salted, ["line", "salt"])
    # Repeated rows share row_key; each line counts once for them.
    once = hot.groupBy("row_key", "line").agg(F.first("words").alias("words"), F.first("plain").alias("plain"))
    return once.groupBy("row_key").agg(F.sum("words").alias("removed_words"), F.collect_list("plain").alias("removed_lines"))


def judged(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """The columns of quality_rules and removed_lines: hashes of the row's boilerplate lines, or null."""
    features = checkpoint(line_features(docs, key, text, host))
    out = features.drop("lines", "host", "content").join(boilerplate_words(features), "row_key", "left")
    removed = F.coalesce("removed_words", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        F.col("key").alias(key), *COUNTS, failed.alias("base_failed"), removed.alias("removed_words"),
        (~failed & (F.col("n_words") - removed >= LEAST_LEFT * F.col("n_words"))).alias("kept"), "removed_lines",
    )


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, the counts, base_failed, removed_words (in boilerplate lines), kept."""
    return judged(docs, key, text, host).drop("removed_lines")


def without_lines(docs: DataFrame, lines: str) -> DataFrame:
    """docs without the column `lines`, each text without the lines whose hashes that column lists, n_chars of what is left."""
    schema = docs.drop(lines).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(lines)
            columns = {c: batch.column(c) for c in names}
            if listed.null_count < batch.num_rows:
                texts = columns["text"].cast(pa.binary()).to_pylist()
                for i, hashes in enumerate(listed.to_pylist()):
                    if hashes:
                        gone = set(hashes)
                        kept = [x for x in texts[i].split(b"\n") if xxhash.xxh3_64_intdigest(normal_line(x)) - (1 << 63) not in gone]
                        texts[i] = b"\n".join(kept)
                columns["text"] = pa.array(texts, pa.binary()).cast(columns["text"].type)
                if "n_chars" in columns:
                    sizes = pc.if_else(listed.is_valid(), pc.utf8_length(columns["text"]).cast(columns["n_chars"].type), columns["n_chars"])
                    columns["n_chars"] = sizes
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines, with the columns of documents.

    Rows are judged each on its own, whatever their doc_id, null or not; a row is named by two hashes of what it is judged by.
    Null and empty texts go. Equal rows stay or go together. An empty table gives an empty one; other columns are kept as
    they are, whatever their names.
    """
    row, lines = unused(docs, "row"), unused(docs, "lines")
    name = F.struct(F.xxhash64("doc_id", "text", "source").alias("a"), F.xxhash64(F.lit(1), "source", "text", "doc_id").alias("b"))
    rows = docs.withColumn(row, name)
    found = judged(rows.select(F.col(row).alias("key"), "text", "source"), "key", "text", "source").where("kept")
    kept = found.select(F.col("key").alias(row), F.col("removed_lines").alias(lines)).dropDuplicates([row])
    return without_lines(rows.join(kept, row).select(*docs.columns, lines), lines)
