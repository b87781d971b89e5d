"""Sequence sources: lists of files, FASTA files, two-line records. Plain, gzip and zlib, told by their first bytes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessella.shared import broadcast_if_small, checkpoint

#: The first bytes of gzip, and of zlib streams of the usual levels.
GZIP = b"\x1f\x8b"
ZLIB = (b"\x78\x01", b"\x78\x9c", b"\x78\xda")
#: The least length of a listed path, and first characters of sequences for exact search.
LEAST_PATH = 4
EXACT_FIRST = tuple("ACGTN")
#: Listed paths of one folder from which the folder is listed instead of asking for each path.
MANY = 16
#: Paths that are their own qualified names: a scheme, an authority (but for local files), and no empty, "." or ".." part.
QUALIFIED = re.compile(r"(?:file:|[a-z][a-z0-9+.-]*://[^/]+)(?:/(?!\.{1,2}(?:/|$))[^/]+)+")
#: Characters of sequences that a task hands back at once, about.
CHARACTERS = 1 << 24


def inflate(data: bytes) -> bytes:
    """The content of a plain, gzip (of any number of members) or zlib file."""
    if data[:2] != GZIP and data[:2] not in ZLIB:
        return data
    out = []
    while data:
        d = zlib.decompressobj(wbits=47)
        out.append(d.decompress(data))
        data = d.unused_data if d.eof else b""
        if data[:2] != GZIP and data[:2] not in ZLIB:
            break
    return b"".join(out)


def _file(spark: SparkSession, path: str):
    """The file system of a path, and the path as this file system names it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(p)


def qualified(spark: SparkSession, path: str) -> str:
    """The one name of a file, however its path is written: relative, with or without a scheme."""
    return _file(spark, path)[1].toString()


def existing(spark: SparkSession, paths: Iterable[str]) -> dict[str, str]:
    """The paths that exist, by the path as it is written, with their qualified names.

    Folders that many of the paths are in are listed once; else each path is asked for.
    """
    named = {p: _file(spark, p) for p in dict.fromkeys(paths)}
    folders = Counter(str(q.getParent()) for _, q in named.values())
    inside: dict[str, set[str]] = {}
    out = {}
    for path, (system, q) in named.items():
        folder = q.getParent()
        if folder is not None and folders[str(folder)] >= MANY:
            if str(folder) not in inside:
                inside[str(folder)] = {s.getPath().toString() for s in system.listStatus(folder)} if system.exists(folder) else set()
            there = q.toString() in inside[str(folder)]
        else:
            there = system.exists(q)
        if there:
            out[path] = q.toString()
    return out


def scan_of(spark: SparkSession, names: Iterable[str]) -> DataFrame | None:
    """path, length, content of files that exist, by qualified name; None without any."""
    plain = [re.sub(r"([\[\]{}*?\\])", r"\\\1", n) for n in sorted(set(names))]  # paths, not patterns
    return spark.read.format("binaryFile").load(plain).select("path", "length", "content") if plain else None


def scanned(spark: SparkSession, paths: Iterable[str]) -> tuple[dict[str, str], DataFrame | None]:
    """The paths that exist, as existing() has them, and scan_of() their files.

    Spark looks the paths up while it plans the scan, many at once; only if one is missing is each asked for by the driver.
    """
    short = ((p, re.sub("^file:/+", "file:/", p)) for p in dict.fromkeys(paths))
    asked = {p: q if QUALIFIED.fullmatch(q) else qualified(spark, p) for p, q in short}
    try:
        return asked, scan_of(spark, asked.values())
    except AnalysisException:
        there = existing(spark, asked)
        return there, scan_of(spark, there.values())


def told(header: str) -> str:
    """A header from bytes that were read as Latin-1."""
    return header.encode("latin-1").decode("utf-8", "replace")


def _of_files(spark: SparkSession, files: DataFrame | None, schema: str, make: Callable[[str], Iterable[tuple[dict, int]]], encoding: str = "latin-1") -> DataFrame:
    """path (qualified) and the rows that `make` yields, each with its size, from the content of each file of a scan; a file is read once.

    Content is read as Latin-1, so that each byte of a sequence is one character.
    """
    kind = f"path string, {schema}"
    if files is None:
        return spark.createDataFrame([], kind)
    arrow = pa.schema([pa.field(c.split()[0], {"string": pa.string(), "long": pa.int64()}[c.split()[1]]) for c in kind.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, held, size = batch.column("path")[i].as_py(), [], 0
                for row, n in make(inflate(batch.column("content")[i].as_py()).decode(encoding, "replace")):
                    held.append(row | {"path": path})
                    size += n + 64
                    if size >= CHARACTERS:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    return files.select("path", "content").mapInArrow(run, kind)


def read_whole(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, content of whole files; missing files are skipped. Paths are as they were given, each once for each time it was."""
    asked = [paths] if isinstance(paths, str) else list(paths)
    there, scan = scanned(spark, asked)
    files = _of_files(spark, scan, "content string", lambda content: [({"content": content}, len(content))], "utf-8")
    given = spark.createDataFrame([(p, there[p]) for p in asked if p in there], "given string, path string")
    return given.join(files, "path").select(F.col("given").alias("path"), "content")


def _lines_of_list(spark: SparkSession, list_path: str) -> list[tuple[int, str]]:
    # A list of files is what a driver plans a scan from, so it is read there.
    lines = [line for r in read_whole(spark, list_path).select("content").collect() for line in r[0].split("\n")]
    return list(enumerate(x for x in lines if len(x) >= LEAST_PATH))


def listed(spark: SparkSession, list_path: str) -> DataFrame:
    """id (0-based among the accepted lines), path of the lines of a list with more than 3 characters."""
    return spark.createDataFrame(_lines_of_list(spark, list_path), "id int, path string")


def joined_lines(content: str) -> str:
    """All lines that do not begin with > of a FASTA file, joined into one sequence."""
    return "".join(line for line in content.split("\n") if not line.startswith(">"))


def _of_list(spark: SparkSession, list_path: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """known(id, path, file) of the listed files that exist, the scan of these, and missing(id, path)."""
    rows = _lines_of_list(spark, list_path)
    there, scan = scanned(spark, (p for _, p in rows))
    known = spark.createDataFrame([(i, p, there[p]) for i, p in rows if p in there], "id long, name string, path string")
    missing = spark.createDataFrame([(i, p) for i, p in rows if p not in there], "id int, path string")
    return known, scan, missing


def genomes_of_list(spark: SparkSession, list_path: str, k: int) -> tuple[DataFrame, DataFrame]:
    """genomes(genome_id, name, seq) of the files of a list, and missing(id, path).

    A file is one sequence; sequences shorter than k are left out. Ids are places among accepted lines, so a file that is
    listed twice has two ids.
    """
    known, files, missing = _of_list(spark, list_path)
    seqs = _of_files(spark, files, "seq string", lambda content: [({"seq": joined_lines(content)}, len(content))])
    return known.join(seqs, "path").select(F.col("id").alias("genome_id"), "name", "seq").where(F.length("seq") >= k), missing


def genome_of_file(spark: SparkSession, path: str, k: int) -> DataFrame:
    """genomes with the one sequence of a file; none if the file is missing."""
    _, files = scanned(spark, [path])
    seqs = _of_files(spark, files, "seq string", lambda content: [({"seq": joined_lines(content)}, len(content))])
    return seqs.select(F.lit(0).cast("long").alias("genome_id"), F.lit(path).alias("name"), "seq").where(F.length("seq") >= k)


def _is_plain(spark: SparkSession, path: str) -> bool:
    """Whether a file is neither gzip nor zlib, by its first two bytes."""
    system, q = _file(spark, path)
    stream = system.open(q)
    try:
        first = [stream.read() for _ in range(2)]
    finally:
        stream.close()
    return -1 in first or (bytes(first) != GZIP and bytes(first) not in ZLIB)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """number (from 0), line of a plain file of any size, read in splits.

    A split's lines are numbered in order; the numbers of lines in the splits before it, one row for each, are added.
    """
    lines = spark.read.option("lineSep", "\n").text(qualified(spark, path)).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("at", (before - F.col("first")).alias("shift"))
    return lines.join(starts, "at").select((F.col("id") + F.col("shift")).alias("number"), F.col("value").alias("line"))


def _pairs(content: str) -> Iterator[tuple[dict, int]]:
    lines = content.split("\n")
    for i in range(0, len(lines), 2):
        seq = lines[i + 1] if i + 1 < len(lines) else ""
        yield {"query_id": i // 2, "header": told(lines[i]), "seq": seq}, len(lines[i]) + len(seq)


def records(spark: SparkSession, path: str, k: int, exact: bool = False) -> DataFrame:
    """queries(query_id, header, seq) of a file of two-line records; headers as they are. A missing file has none.

    A plain file is read in splits and its lines are paired by number, so it may be of any size; a compressed one is
    read by one task. Sequences shorter than k are left out, and for exact search those that do not begin with A, C, G, T or N.
    """
    files = existing(spark, [path])
    if files and _is_plain(spark, path):
        of = numbered_lines(spark, path).groupBy(F.floor(F.col("number") / 2).alias("query_id"))
        at = lambda i: F.max(F.when(F.col("number") % 2 == i, F.col("line")))
        bytewise = F.decode(F.coalesce(at(1), F.lit("")).cast("binary"), "ISO-8859-1")
        rows = of.agg(F.make_valid_utf8(at(0)).alias("header"), bytewise.alias("seq"))
    else:
        rows = _of_files(spark, scan_of(spark, files.values()), "query_id long, header string, seq string", _pairs).select("query_id", "header", "seq")
    rows = rows.where(F.length("seq") >= k)
    return rows.where(F.substring("seq", 1, 1).isin(*EXACT_FIRST)) if exact else rows


def file_queries(spark: SparkSession, list_path: str, k: int, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """queries(query_id, header, seq), one for each file of a list, and missing(id, path).

    Approximate: the header is the path, and files shorter than k are left out. Exact: the header is the first
    line, and only lines of k characters or more that begin with A, C, G, T or N are joined.
    """
    known, files, missing = _of_list(spark, list_path)

    def exact_query(content: str) -> Iterable[tuple[dict, int]]:
        first, *rest = content.split("\n")
        return [({"header": told(first), "seq": "".join(x for x in rest if len(x) >= k and x.startswith(EXACT_FIRST))}, len(content))]

    make = exact_query if exact else lambda content: [({"header": None, "seq": joined_lines(content)}, len(content))]
    rows = known.join(_of_files(spark, files, "header string, seq string", make), "path")
    out = rows.select(F.col("id").alias("query_id"), F.coalesce("header", "name").alias("header"), "seq")
    return (out if exact else out.where(F.length("seq") >= k)), missing


def segments(content: str, k: int) -> Iterator[str]:
    """Sequences of a FASTA file for exact search.

    At a header line the sequence so far ends if it has k characters; a shorter one runs on into the next.
    """
    held: list[str] = []
    size = 0
    for line in content.split("\n"):
        if not line.startswith(">"):
            held.append(line)
            size += len(line)
        elif size >= k:
            yield "".join(held)
            held, size = [], 0
    if size >= k:
        yield "".join(held)


def segments_of_files(spark: SparkSession, names: DataFrame, k: int) -> DataFrame:
    """genome_id, seq of the files that names(genome_id, name) lists; missing files are skipped."""
    rows = [(r["genome_id"], r["name"]) for r in names.distinct().collect()]
    there, files = scanned(spark, (n for _, n in rows))
    known = spark.createDataFrame([(i, there[n]) for i, n in rows if n in there], "genome_id long, path string")
    parts = _of_files(spark, files, "seq string", lambda content: (({"seq": s}, len(s)) for s in segments(content, k)))
    return known.join(parts, "path").select("genome_id", "seq")


def segments_of_list(spark: SparkSession, list_path: str, k: int) -> DataFrame:
    """segments(genome_id, seq) of the files of a list."""
    known, _, _ = _of_list(spark, list_path)
    return segments_of_files(spark, known.select(F.col("id").alias("genome_id"), "name"), k)


# ---- genomes over many tasks

#: Letters of a piece at most.
PIECE = 4 << 20
#: Bytes from which a plain file is read in splits.
LARGE = 64 << 20


def split_lines(spark: SparkSession, paths: Iterable[str], k: int) -> DataFrame:
    """path, at, no, fresh, n, head, tail, seq: the letters of plain FASTA files of any size, read in splits.

    A piece (number `no` of the split at byte `at`) ends at a header line or after about PIECE letters; `fresh` if a header line
    stands before it. head and tail are its first and last k - 1 letters. A split without letters has a piece of none, if it
    has a header.
    """
    text = spark.read.option("lineSep", "\n").text(list(paths))
    lines = text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    schema = "path string, at long, no int, fresh boolean, n long, head string, tail string, seq string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, no, fresh, held, size = None, 0, False, [], 0

        def done() -> pa.RecordBatch:
            seq = "".join(held)
            row = [*split, no, fresh, len(seq), seq[: k - 1], seq[len(seq) - min(len(seq), k - 1) :], seq]
            types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            for value, path, at in zip(*(batch.column(c).to_pylist() for c in ("value", "path", "at"))):
                if (path, at) != split:
                    if held or fresh:
                        yield done()
                    split, no, fresh, held, size = (path, at), 0, False, [], 0
                value = value.decode("latin-1")
                if value.startswith(">"):
                    if held:
                        yield done()
                        no, held, size = no + 1, [], 0
                    fresh = True
                elif value:
                    held.append(value)
                    size += len(value)
                    if size >= PIECE:
                        yield done()
                        no, fresh, held, size = no + 1, False, [], 0
        if held or fresh:
            yield done()

    return lines.mapInArrow(run, schema)


def pieces_of_files(spark: SparkSession, paths: Iterable[str], k: int) -> DataFrame:
    """path, seq, start, carry, prefix, total, seg_carry: pieces of plain FASTA files that can be taken apart on their own.

    start: letters of the file before the piece; carry: the k - 1 letters before it (fewer at the beginning); prefix: the file's
    first k - 1 letters, if they end before the piece; total: all letters. seg_carry: as carry, but only of the same sequence for exact
    search, see segments(). What is carried is worked out from the pieces' ends alone; letters are read twice and never
    shuffled, as long as the list of pieces is small enough to be broadcast.
    """
    paths = list(paths)
    kind = "path string, at long, no int, start long, carry string, prefix string, seg_carry string"
    made = split_lines(spark, paths, k)
    ends = checkpoint(made.select("path", "at", "no", "fresh", "n", "head", "tail"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = None
        keep = k - 1
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["path"] != path:
                    path, start, carry, prefix, held, held_size = r["path"], 0, "", "", "", 0
                if r["fresh"] and held_size >= k:
                    held, held_size = "", 0
                rows.append((path, r["at"], r["no"], start, carry, prefix, held))
                prefix += r["head"][: keep - len(prefix)]
                carry, held = (carry + r["tail"])[-keep:], (held + r["tail"])[-keep:]
                start, held_size = start + r["n"], held_size + r["n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                names=["path", "at", "no", "start", "carry", "prefix", "seg_carry"],
            )

    placed = ends.repartition("path").sortWithinPartitions("path", "at", "no").mapInArrow(run, kind)
    totals = ends.groupBy("path").agg(F.sum("n").alias("total"))
    known = broadcast_if_small(placed.join(totals, "path"))
    return made.select("path", "at", "no", "seq").join(known, ["path", "at", "no"]).select("path", "seq", "start", "carry", "prefix", "total", "seg_carry")


def large_and_other(spark: SparkSession, files: DataFrame | None) -> tuple[list[str], DataFrame | None]:
    """Of a scan the names of the plain files of LARGE bytes or more, and the scan of the others.

    Lengths are told by the scan; only large files are opened by the driver, for their first bytes.
    """
    if files is None:
        return [], None
    long = sorted(r["path"] for r in files.where(F.col("length") >= LARGE).select("path").collect())
    if not long:
        return [], files
    large = [name for name in long if _is_plain(spark, name)]
    packed = scan_of(spark, set(long) - set(large))
    other = files.where(F.col("length") < LARGE)
    return large, other if packed is None else other.unionByName(packed)


def genome_pieces_of_list(spark: SparkSession, list_path: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """whole(genome_id, name, seq), pieces(genome_id, name, seq, start, carry, prefix, total, seg_carry) and missing(id, path) of a list.

    Large plain files come in pieces, the others whole, as from genomes_of_list(); files shorter than k are in neither.
    """
    known, files, missing = _of_list(spark, list_path)
    large, other = large_and_other(spark, files)
    seqs = _of_files(spark, other, "seq string", lambda content: [({"seq": joined_lines(content)}, len(content))])
    whole = known.join(seqs, "path").select(F.col("id").alias("genome_id"), "name", "seq").where(F.length("seq") >= k)
    if not large:
        kind = "genome_id long, name string, seq string, start long, carry string, prefix string, total long, seg_carry string"
        return whole, spark.createDataFrame([], kind), missing
    pieces = pieces_of_files(spark, large, k).where(F.col("total") >= k)
    # Spark's reader tells paths with escaped characters.
    named = known.join(spark.createDataFrame([(p,) for p in large], "path string"), "path").select(F.col("id").alias("genome_id"), "name", F.col("path").alias("file"))
    same = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^file:/+", "file:/")
    joined = pieces.withColumn("file", same(F.col("path"))).join(named.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/")), "file")
    return whole, joined.select("genome_id", "name", "seq", "start", "carry", "prefix", "total", "seg_carry"), missing
