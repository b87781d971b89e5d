"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint keeps every distinct 64-bit hash of a five-word shingle that lies below a fixed
fraction of the hash range. Such sketches of any two documents are samples by the same rule, so
their intersections estimate containment even between very unequal lengths, and the sketch of a
union is the union of the sketches. Short texts, with fewer than LEAST hashes below the threshold, keep
their LEAST smallest hashes (all, if there are not so many), which merge exactly as well.

Everything is built-in Spark SQL on arrays of one row; texts are shuffled once, by range of the key,
to bring each document beside its successor.

Defined cases: null and empty texts have an empty fingerprint; fewer than five words make one shingle
of all of them. Two equal fingerprints have likeness 1 (two empty ones as well); an empty and a
non-empty one have likeness 0. Rows that share a key follow one another by descending hash of the text (then
by text); rows with a null key come last. A single document succeeds itself. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessella.llm.common import table

#: Words of a shingle, and the fraction of hashes that a fingerprint keeps.
WORDS = 5
FRACTION = 1 / 8
#: Hashes that a fingerprint has at least, if the text has as many shingles.
LEAST = 16
#: Hashes are signed here: those below this bound are the least FRACTION of the range.
BOUND = int(-(2**63) + FRACTION * 2**64)


def word_hashes(text: Column) -> Column:
    """Hashes of the text's lower-cased words (runs of other than ASCII white space)."""
    return F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def with_sketch(df: DataFrame, text: str, name: str, words: int = WORDS, bound: int = BOUND) -> DataFrame:
    """Add the sketch of a text column: sorted distinct shingle hashes below the bound, LEAST of them at least.

    Each step is a column of its own, so that Catalyst evaluates it once.
    """
    n = F.size("_h")
    at = lambda i, k: F.get("_h", i + k)
    every = F.transform(F.sequence(F.lit(0), F.greatest(n - words, F.lit(0))), lambda i: F.xxhash64(*[at(i, k) for k in range(words)]))
    none = F.array().cast("array<bigint>")
    return (
        df.withColumn("_h", word_hashes(F.col(text)))
        .withColumn("_every", F.when(n >= words, every).when(n > 0, F.array(F.xxhash64("_h"))).otherwise(none))
        .withColumn("_low", F.filter("_every", lambda h: h < bound))
        .withColumn("_low", F.sort_array(F.array_distinct("_low")))
        .withColumn(name, F.when(F.size("_low") >= LEAST, F.col("_low")).otherwise(F.slice(F.sort_array(F.array_distinct("_every")), 1, LEAST)))
        .drop("_h", "_every", "_low")
    )


def merge(a: Column, b: Column, bound: int = BOUND) -> Column:
    """Sketch of the union of two documents' shingles, from their sketches alone."""
    both = F.sort_array(F.array_union(a, b))
    return F.slice(both, 1, F.greatest(F.size(F.filter(both, lambda h: h < bound)), F.lit(LEAST)))


def limit(s: Column, bound: int = BOUND) -> Column:
    """The largest hash up to which a sketch is complete; sketches are sorted, so their last element is their largest."""
    return F.when(F.size(s) < LEAST, F.lit(2**63 - 1)).otherwise(F.greatest(F.element_at(s, -1), F.lit(bound - 1)))


def _once(value: Column, use) -> Column:
    """use(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def likeness(a: Column, b: Column) -> Column:
    """containment and resemblance of two sketches, within the range in which both are complete.

    The range's end, the sketches up to it and their sizes are evaluated once for each row, not for each hash.
    """

    def of_sizes(z: Column) -> Column:
        n, m, shared = z["n"], z["m"], z["shared"]
        of = lambda whole: F.when(a == b, 1.0).when((n == 0) | (m == 0), 0.0).otherwise(shared / whole)
        return F.struct(of(F.least(n, m)).alias("containment"), of(n + m - shared).alias("resemblance"))

    def within(top: Column) -> Column:
        upto = lambda s: F.filter(s, lambda h: h <= top)
        return _once(
            F.struct(upto(a).alias("x"), upto(b).alias("y")),
            lambda s: _once(F.struct(F.size(s["x"]).alias("n"), F.size(s["y"]).alias("m"), F.size(F.array_intersect(s["x"], s["y"])).alias("shared")), of_sizes),
        )

    return _once(F.least(limit(a), limit(b)), within)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document that the other one contains."""
    return likeness(a, b)["containment"]


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the two documents' shingles."""
    return likeness(a, b)["resemblance"]


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and sketch (array of hashes) of each row."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    return with_sketch(rows, "_text", "sketch").select(key, "sketch")


def beside_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, sketch of each document, and next_text, next_sketch of the one after it by descending key.

    The successor of the last document is the first. Rows with one key follow one another by descending hash of the
    text. Documents are dealt into blocks of consecutive keys, cut at approximate quantiles (a list of fixed length),
    and shuffled once, by block; a key of several quantiles, and the rows without a key, have blocks of their own, cut
    by the hash. Each block also gets a guest: the first document of the block below it, which succeeds the block's last one.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    blocks = 4 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = rows.agg(
        F.percentile_approx("key", [i / blocks for i in range(1, blocks)], 10 * blocks).alias("c"), F.count("*").alias("n"), F.count("key").alias("known")
    ).first()
    cuts = sorted(told["c"] or [])
    edges = sorted(set(cuts))
    pieces = [cuts.count(e) for e in edges]
    nulls = max(1, -(-(told["n"] - told["known"]) * blocks // max(told["n"], 1)))
    # Blocks are numbered upwards in key order: those of null keys, then for each edge the keys below it and the edge itself.
    of_hash = lambda k: F.floor((F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), 33) * k) / F.lit(2.0**31)).cast("int")
    block = F.lit(nulls)
    if edges:
        # The number of edges below the key, found in two steps of about the square root of their number.
        step = max(1, int(len(edges) ** 0.5))
        array = lambda x: F.array(*map(F.lit, x))
        coarse = F.size(F.filter(array(edges[step - 1 :: step]), lambda c: c < F.col("key"))) * step
        rows = rows.withColumn("below", (coarse + F.size(F.filter(F.slice(array(edges), coarse + 1, step), lambda c: c < F.col("key")))).cast("int"))
        firsts = [nulls + i + sum(pieces[:i]) for i in range(len(edges) + 1)]
        at_edge = F.get(array([*edges, None]), F.col("below")) == F.col("key")
        hot = F.get(array([*pieces, 1]), F.col("below"))
        block = F.get(array(firsts), F.col("below")) + F.when(at_edge, 1 + of_hash(hot)).otherwise(0)
    rows = rows.withColumn("block", F.when(F.col("key").isNull(), of_hash(F.lit(nulls))).otherwise(block).cast("int")).select("key", "text", "h", "block")
    order = F.struct(F.col("key").isNotNull(), "key", "h")
    heads = sorted((r["block"], r["head"]) for r in rows.groupBy("block").agg(F.max(order).alias("head")).collect())
    # One row for each block: which block the head visits. The highest block's head visits the lowest.
    visits = [(head[1], head[2], heads[(i + 1) % len(heads)][0]) for i, (_, head) in enumerate(heads)]
    to = docs.sparkSession.createDataFrame(visits, f"to_key {rows.schema['key'].dataType.simpleString()}, to_h long, to_block int")
    guests = rows.join(F.broadcast(to), F.col("key").eqNullSafe(F.col("to_key")) & (F.col("h") == F.col("to_h"))).select("key", "text", "h", F.col("to_block").alias("block"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    sketched = with_sketch(both.repartition("block"), "text", "sketch")
    walk = Window.partitionBy("block").orderBy("guest", F.desc_nulls_last("key"), F.desc("h"), F.desc("text"))
    after = sketched.select("*", F.lead("text").over(walk).alias("t"), F.lead("sketch").over(walk).alias("s")).where("NOT guest")
    return after.select("key", "text", "sketch", F.coalesce("t", "text").alias("next_text"), F.coalesce("s", "sketch").alias("next_sketch"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = beside_next(table(spark, sf_dir, "documents"), "doc_id", "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n - half), F.substring("next_text", 1, half))
    both = with_sketch(pairs.withColumn("edited", edited), "edited", "edited_sketch")
    both = both.withColumn("to_edited", likeness(F.col("sketch"), F.col("edited_sketch"))).withColumn("to_next", likeness(F.col("sketch"), F.col("next_sketch")))
    return both.select(
        F.col("key").alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.col("to_edited.containment").alias("near_edited"), F.col("to_next.containment").alias("near_next"),
        F.col("to_edited.resemblance").alias("jaccard_edited"), F.col("to_next.resemblance").alias("jaccard_next"),
    )
