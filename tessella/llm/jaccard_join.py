"""N-gram Jaccard join: rare-first prefix filtering, each candidate pair verified once.

Documents are sets of hashed five-word shingles; two link at a Jaccard similarity of 0.8 or more.

* Classes. Documents with the same set form a class, named by a 128-bit hash of the set; everything
  below works on one set for each class.
* Rare first. Shingles are ordered by the exact number of classes that hold them, then by hash. To count, each
  task sends the shingles of a slice of its texts, sorted and packed, to ranges of the hash. A range's task counts the
  classes of each of its shingles and reports those in two classes or more to the slices that have them; a shingle of one class alone can
  link nothing and only takes a place at the front. Shingles go by as many bits here as keep most apart: two that
  meet by chance are counted as one by all, which costs work and loses nothing.
* Hot shingles. A shingle that stands in a large share of all sets would fill a range. Tasks report what is
  frequent in their own texts; what adds up to HOT sets (or 2**-HOT_BITS of all shingles, so the list is
  bounded) is last in the order and is not sent. Only sets that hold little else need hot shingles.
* Prefix, length and positional filters. Sets that link share a shingle among the first
  n - ceil(0.8 n) + 1 of each; at their first shared one the sizes and places must leave room for
  the overlap needed.
* Suffix filter. Beside each prefix shingle stand the numbers of the later shared shingles (but hot ones) in each
  of four hash ranges. What two sets hold before their first shared shingle differs, and so do the suffixes by the
  differences of these numbers at least; more than the overlap allows is no link.
* Links by leaders. Only links between different components matter to the result. Every prefix shingle
  names as leader the set that shares its prefix shingles with most others, and each set is verified against the one leader it
  shares most shingles with. Further rounds do the same among the sets outside of their shingles' largest
  components. So a group of thousands of near copies takes a number of pairs in proportion to its size.
* Remaining pairs. Then all pairs of sets that share a prefix shingle, lie in different components
  and pass the filters are verified, once each. Shingles keep the sets of their largest component on one side
  only, so that no pairs arise within it. With that, no link between components is missed.

Defined cases: documents without words (null, empty) have an empty set, link with nothing and are
their own component. Fewer than five words make one shingle. Repeated rows are in one class and each
gets a row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.llm.common import LOWER, U64, WordHashes, bit_table, in_bits, of_planes, planes, raw, shingle_set, slices, table, unused, with_keys
from tessella.llm.graph import components
from tessella.shared import checkpoint, checkpoint_counted

WORDS = 5
#: Rounds of links to leaders before the remaining pairs are taken.
ROUNDS = 2
#: Shingles of a range on average.
PART = 2_500_000
#: Bits of a shingle's name beyond the logarithm of their number: one in 2**SPARE_BITS meets another by chance.
SPARE_BITS = 14
#: Sets from which a shingle is hot; the list of hot shingles has at most 2**HOT_BITS entries.
HOT = 1000
HOT_BITS = 20
#: Sets of a slice of texts from which a task reports a shingle as frequent.
FREQUENT = 16
#: Classes that a task remembers, so as to send the shingles of copies once.
REMEMBER = 200_000
#: log2 of the bits of the bitmap of sets that several rows have (1 MB).
COPY_BITS = 23
#: Hash ranges of the suffix filter.
RANGES = 4
#: Rank of hot shingles in the order.
LAST = (1 << 31) - 1


def set_of(text: bytes, hashes: WordHashes) -> np.ndarray:
    return shingle_set(hashes.of(text.translate(LOWER).split()), WORDS)


def class_of(shingles: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def prefix_length(n):
    """Of a set of n shingles."""
    return n - (80 * n + 99) // 100 + 1


def summaries(source: DataFrame, kind: str) -> DataFrame:
    """Rows with key, class, n of each row, and rows with gram, n of shingles that are frequent in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            sets = [set_of(t, hashes) for t in raw(batch.column("text"))]
            grams = np.concatenate(sets) >> U64(16)
            bucket = (grams >> U64(28)).astype(np.int64)
            often, counts = np.unique(grams[np.bincount(bucket, minlength=1)[bucket] >= FREQUENT], return_counts=True)
            often, counts = often[counts >= FREQUENT], counts[counts >= FREQUENT]
            rows, more = batch.num_rows, len(often)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column("key"), pa.nulls(more, batch.column("key").type)]),
                    pa.array([class_of(s) if len(s) else None for s in sets] + [None] * more, pa.binary()),
                    pa.array(np.r_[[len(s) for s in sets], counts].astype(np.int64)),
                    pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(often.view(np.int64))]),
                ],
                names=["key", "class", "n", "gram"],
            )

    return source.mapInArrow(run, f"key {kind}, class binary, n long, gram long")


def packed(owner: np.ndarray, grams: np.ndarray, more: np.ndarray | None = None) -> bytes:
    """Sorted shingles, the number of the set that each is of within its slice, and a small number more of each if given."""
    columns = [planes(owner, 4), planes(np.diff(grams, prepend=U64(0)), 8), *([] if more is None else [planes(more, 4)])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(grams)], "<u4").tobytes(), *columns]))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    k = int(np.frombuffer(data, "<u4", 1)[0])
    owner, steps, more = (data[a:b] for a, b in ((4, 4 + 4 * k), (4 + 4 * k, 4 + 12 * k), (4 + 12 * k, None)))
    small = lambda x: of_planes(x, 4, k).astype(np.int32)
    return small(owner), np.cumsum(of_planes(steps, 8, k), dtype=U64), small(more) if more else np.empty(0, np.int32)


def sent_grams(source: DataFrame, parts: int, bits: int, hot: np.ndarray, copied: np.ndarray) -> DataFrame:
    """Rows for each slice of texts, named by `slice`.

    With `data` and `tags`: the packed shingles (their first bits) of a range `part`, and numbers and first 8 bytes of the names of
    those sets that other tasks may send as well (by the bitmap `copied` of such names). With `names`, `sizes`, `hots`: the slice's sets, how many shingles and how many
    hot ones they have; there `data` holds the hot shingles of the sets whose prefix has some.
    """
    shared, several = (source.sparkSession.sparkContext.broadcast(x) for x in (hot, copied))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in slices(batches):
            classes, sets = [], []
            for t in raw(batch.column("text")):
                s = set_of(t, hashes)
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                if len(seen) >= REMEMBER:
                    seen.clear()
                seen.add(c)
                classes.append(c)
                sets.append(s)
            if not sets:
                continue
            names = b"".join(classes)
            slice_ = xxhash.xxh3_64_intdigest(names) - (1 << 63)
            sizes = np.array([len(s) for s in sets], np.int64)
            grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
            is_hot = np.isin(grams >> U64(16), shared.value)
            hots = np.bincount(owner[is_hot], minlength=len(sets))
            grams >>= U64(64 - bits)
            order = np.argsort(grams)
            grams, owner, is_hot = grams[order], owner[order], is_hot[order]
            needed = is_hot & (sizes - hots < prefix_length(sizes))[owner]
            out: list[tuple] = [(slice_ % parts, slice_, packed(owner[needed], grams[needed]), None, names, sizes.tolist(), hots.tolist())]
            grams, owner = grams[~is_hot], owner[~is_hot]
            tags = np.frombuffer(names, "<u8")[::2]
            tagged = in_bits(several.value, tags.byteswap(), COPY_BITS)
            edges = np.searchsorted((grams >> U64(bits - 32)) * U64(parts) >> U64(32), np.arange(parts + 1).astype(U64))
            for part in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[part], edges[part + 1]
                of = owner[a:b]
                told = np.unique(of[tagged[of]])
                out.append((part, slice_, packed(of, grams[a:b]), np.array([len(told)], "<u4").tobytes() + told.astype("<u4").tobytes() + tags[told].tobytes(), None, None, None))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            for a in range(0, len(out), 16):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out[a : a + 16]), kinds)], names=["part", "slice", "data", "tags", "names", "sizes", "hots"])

    return source.select("text").mapInArrow(run, "part int, slice long, data binary, tags binary, names binary, sizes array<int>, hots array<int>")


def counted_grams(sent: DataFrame) -> DataFrame:
    """slice and packed shingles that two classes or more hold, with the number of these; the rows of the slices' sets as they are."""

    def count(part: pa.Table) -> pa.Table:
        columns = ["slice", "data", "names", "sizes", "hots"]
        tables = part.filter(part.column("names").is_valid()).select(columns)
        part = part.filter(part.column("names").is_null()).sort_by("slice")
        if not part.num_rows:
            return tables
        rows = [unpacked(d.as_py()) for d in part.column("data")]
        heads = [d.as_py() for d in part.column("tags")]
        sizes = [int(np.frombuffer(h, "<u4", 1)[0]) for h in heads]
        starts = np.cumsum([0, *(int(r[0].max()) + 1 for r in rows)])
        tags = np.concatenate([np.frombuffer(h, "<u8", m, 4 + 4 * m) for h, m in zip(heads, sizes)])
        tagged = np.concatenate([np.frombuffer(h, "<u4", m, 4) + a for a, h, m in zip(starts, heads, sizes)]).astype(np.int64)
        owner = np.concatenate([r[0] + np.int32(a) for a, r in zip(starts, rows)])
        grams = np.concatenate([r[1] for r in rows])
        del rows
        # A class that several tasks sent counts once: its row in the first slice stands for it, in every range.
        _, first = np.unique(tags, return_index=True)
        stays = np.ones(starts[-1], bool)
        stays[np.delete(tagged, first)] = False
        if not stays.all():
            keep = stays[owner]
            grams, owner = grams[keep], owner[keep]
            del keep
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        del order
        begin = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][: len(grams)])
        df = np.diff(np.r_[begin, len(grams)]).astype(np.int32)
        df = np.repeat(df, df)
        several = df > 1
        grams, owner, df = grams[several], owner[several], df[several]
        out: list[list] = [[], []]
        of_slice = np.searchsorted(starts, owner, side="right") - 1
        order = np.argsort(of_slice, kind="stable")
        edges = np.searchsorted(of_slice[order], np.arange(len(heads) + 1))
        names = part.column("slice").to_pylist()
        for i in range(len(heads)):
            at = order[edges[i] : edges[i + 1]]
            if len(at):
                out[0].append(names[i])
                out[1].append(packed(owner[at] - np.int32(starts[i]), grams[at], df[at]))
        n = len(out[0])
        lists = pa.nulls(n, pa.list_(pa.int32()))
        return pa.concat_tables([tables, pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.nulls(n, pa.binary()), lists, lists], names=columns).cast(tables.schema)])

    return sent.groupBy("part").applyInArrow(count, "slice long, data binary, names binary, sizes array<int>, hots array<int>")


def prefixes(counted: DataFrame, bits: int) -> DataFrame:
    """gram, class, n, pos and suffix counts r0.. of the prefix of each set, as far as its shingles are shared; a slice at once."""

    def of_slice(rows: pa.Table) -> pa.Table:
        table = rows.filter(rows.column("names").is_valid())
        names = table.column("names")[0].as_py()
        n, hot = (np.array(table.column(c)[0].as_py(), np.int64) for c in ("sizes", "hots"))
        owner, grams, _ = unpacked(table.column("data")[0].as_py())
        found = [(owner, grams, np.full(len(grams), LAST, np.int32)), *(unpacked(d.as_py()) for d in rows.filter(rows.column("names").is_null()).column("data"))]
        owner, grams, dfs = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((grams, dfs, owner))
        grams, owner, cold = grams[order].astype(np.int64), owner[order], dfs[order] < LAST
        begin = np.searchsorted(owner, np.arange(len(n) + 1))
        known = np.bincount(owner[cold], minlength=len(n))
        pos = (n - hot - known - begin[:-1])[owner] + np.arange(len(owner))
        keep = np.flatnonzero(pos < prefix_length(n)[owner])
        who = owner[keep]
        later = []
        for i in range(RANGES):
            upto = np.r_[0, np.cumsum(cold & (grams >> (bits - 2) == i))]
            later.append(upto[begin[1:]][who] - upto[keep + 1])
        classes = pa.array([names[16 * i : 16 * i + 16] for i in who.tolist()], pa.binary())
        return pa.table([pa.array(grams[keep]), classes, *(pa.array(x, pa.int32()) for x in (n[who], pos[keep], *later))], names=["gram", "class", "n", "pos", *SUFFIX])

    return counted.groupBy("slice").applyInArrow(of_slice, f"gram long, class binary, n int, pos int, {', '.join(f'{c} int' for c in SUFFIX)}")


SUFFIX = tuple(f"r{i}" for i in range(RANGES))


def fits(x: str, y: str) -> Column:
    """Length, positional and suffix filters for the sets of two rows at a shared shingle.

    Sets of n and m shingles that link differ in (n + m) / 9 of them at most.
    """
    n, pos, m, at = (F.col(f"{side}.{c}").cast("long") for side in (x, y) for c in ("n", "pos"))
    differ = pos + at
    for c in SUFFIX:
        differ = differ + F.abs(F.col(f"{x}.{c}") - F.col(f"{y}.{c}"))
    return (100 * F.least(n, m) >= 80 * F.greatest(n, m)) & (180 * F.least(n - pos, m - at) >= 80 * (n + m)) & (9 * differ <= n + m)


def sets_of(source: DataFrame, keys: DataFrame) -> DataFrame:
    """class and sorted set of the rows whose key is in `keys`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            sets = [s for t in raw(batch.column("text")) if len(s := set_of(t, hashes))]
            if sets:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_of(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["class", "set"]
                )

    return with_keys(source, keys, "key").select("text").mapInArrow(run, "class binary, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b) that link, by their sets."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    total = F.size("sa") + F.size("sb")
    return both.where(180 * F.size(F.array_intersect("sa", "sb")).cast("long") >= 80 * total.cast("long")).select("a", "b")


def beside_main(live: DataFrame) -> DataFrame:
    """The rows of shingles that several components share, with `main`, the component of most of the shingle's sets."""
    counts = live.groupBy("gram", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("gram").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    return live.join(main.select("gram", "main"), "gram")


def to_leaders(live: DataFrame) -> DataFrame:
    """a, b: each set and, of its shingles' leaders in other components that pass the filters, the most frequent."""
    row = F.struct("node", "n", "pos", "label", *SUFFIX)
    leaders = live.groupBy("gram").agg(F.max_by(row, F.struct("shared", "node")).alias("l")).select("gram", "l.*")
    x, y = live.alias("x"), leaders.alias("y")
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") != F.col("y.label")) & fits("x", "y"))
    counts = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("n"))
    return counts.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))


def between_components(live: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of sets in different components that share a shingle and pass the filters."""
    mixed = live if "main" in live.columns else beside_main(live)
    x, y = mixed.where("label <> main").alias("x"), mixed.alias("y")
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") != F.col("y.label")) & fits("x", "y"))
    a, b = F.col("x.node"), F.col("y.node")
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def relabelled(live: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return live.drop("main")
    named = labels.select("node", F.col("label").alias("named"))
    return live.drop("label", "main").join(named, "node", "left").withColumn("label", F.coalesce("named", "node")).drop("named")


def links_of(source: DataFrame, classes: DataFrame, prefix: DataFrame) -> DataFrame | None:
    """class, rep, label of the classes that link with others, or None without any."""
    first = checkpoint(prefix)
    shared = first.join(first.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1"), "gram")
    named = shared.groupBy("class").agg(F.sum("sets").alias("shared")).join(classes.select("class", "rep"), "class")
    named, count = checkpoint_counted(named.withColumn("node", F.monotonically_increasing_id()))
    if not count:
        return None
    live = checkpoint(shared.join(named, "class").select("gram", "node", "shared", "n", "pos", *SUFFIX)).withColumn("label", F.col("node"))
    found = sets_of(source, named.select(F.col("rep").alias("key")))
    sets = checkpoint(found.join(named.select("class", "node"), "class").dropDuplicates(["class"]).select("node", "set"))
    labels, asked, count = None, sets, 0
    for turn in range(ROUNDS + 1):
        if turn == 1 or count:
            # Shingles whose sets are all in one component have nothing left to link, in this round and in later ones.
            live, count = checkpoint_counted(beside_main(relabelled(live, labels)))
            if not count:
                break
        if turn == ROUNDS:
            pairs = between_components(live)
        else:
            pairs = to_leaders(live.where("label <> main") if turn else live)
        if turn:
            # After the first round few sets have pairs left; the others are not moved again.
            pairs, count = checkpoint_counted(pairs)
            if not count:
                continue
            asked = with_keys(sets, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), "node")
        new, count = checkpoint_counted(verified(pairs, asked))
        if count:
            labels = components(new, labels)
    return None if labels is None else labels.join(named, "node").select("class", "rep", "label")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (least key reachable by links) for each row."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    told = checkpoint(summaries(source, kind))
    rows = told.where("gram IS NULL").select("key", "class", "n")
    classes = checkpoint(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("key").alias("rep"), F.max("n").alias("n")))
    total = int(rows.agg(F.sum("n")).first()[0] or 0)
    frequent = told.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT, total >> HOT_BITS))
    hot = np.sort(frequent.select("gram").toArrow().column("gram").to_numpy()).astype(U64)
    bits = min(62, max(32, total.bit_length() + SPARE_BITS))
    # Only sets of several rows may come from several tasks; they are told by the first 8 bytes of their names.
    rows_of = rows.where("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("rows")).where("rows > 1")
    copied = bit_table(rows_of.select(F.conv(F.hex(F.substring("class", 1, 8)), 16, -10).cast("long").alias("tag")), "tag", COPY_BITS)
    labels = links_of(source, classes, prefixes(counted_grams(sent_grams(source, max(1, -(-total // PART)), bits, hot, copied)), bits))
    of_class = classes.select("class", F.col("rep").alias("component"))
    if labels is not None:
        least = labels.groupBy("label").agg(F.min("rep").alias("joint"))
        named = labels.join(least, "label").select("class", "joint")
        of_class = of_class.join(named, "class", "left").select("class", F.least("component", "joint").alias("component"))
    return rows.join(of_class, "class", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id")
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def stage_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least doc_id, with the columns of documents.

    Rows are judged each on its own: of texts with one doc_id in one group, one stays, and of rows with equal doc_id and
    text one stays. Rows with a null doc_id always stay, and do not stand for a group that has others; texts without
    words always stay. An empty table gives an empty one; other columns, whatever their names, are kept as they are.
    """
    text = F.xxhash64(F.col("text").cast("string"))
    named = docs.where("doc_id IS NOT NULL")
    rows = named.select(F.struct(F.col("doc_id").alias("id"), text.alias("text")).alias("row"), "text")
    kept = jaccard_components(rows, "row").where("row = component_id").select("row").distinct()
    row = unused(docs, "row")
    found = named.withColumn(row, F.struct(F.col("doc_id").alias("id"), text.alias("text")))
    one = found.join(kept.withColumnRenamed("row", row), row, "left_semi").dropDuplicates([row])
    return one.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
