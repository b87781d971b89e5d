"""A saved index that grows: generations of files under versions that are committed whole.

    path/{columns, genomes, bloom}/generation=<name>    written once, never changed
    path/versions/<number>.json                         parameters, next id, and the generations of a version

A version appears by one rename to a name that must be free, so it is there whole or not at all: what a failed append has written
is in no version, and of two appends at once one fails. Readers keep the version they opened, as its generations stay until
vacuum(). Columns of one block that several generations hold are added up by a search; compact() lays them together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.operators import bloom as blooms
from tessella.operators import columns as packing
from tessella.operators.index import RANGE, Index, build, in_range
from tessella.params import SketchParams


TABLES = ("columns", "genomes", "bloom")


class VersionTaken(RuntimeError):
    """Another writer has committed a version meanwhile; nothing was changed."""


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes paths of it."""
    jvm = spark.sparkContext._jvm
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((path, *parts)))
    return at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, rising."""
    system, at = _files(spark, path)
    if not system.exists(at("versions")):
        return []
    names = [s.getPath().getName() for s in system.listStatus(at("versions"))]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, version: int | None) -> dict:
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no index at {path}")
    version = known[-1] if version is None else version
    system, at = _files(spark, path)
    stream = system.open(at("versions", f"{version:010}.json"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) | {"version": version}


def _commit(spark: SparkSession, path: str, manifest: dict, version: int) -> int:
    """Make `manifest` that version, or raise VersionTaken."""
    system, at = _files(spark, path)
    system.mkdirs(at("versions"))
    draft, final = at("versions", f".{uuid.uuid4().hex}"), at("versions", f"{version:010}.json")
    stream = system.create(draft, False)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, final, options)  # fails if the name is taken
    except Exception as error:
        system.delete(draft, False)
        if system.exists(final):
            raise VersionTaken(f"version {version} of {path} exists") from error
        raise
    return version


def create(spark: SparkSession, path: str, params: SketchParams, ranges: int = 256) -> int:
    """An index without genomes, as version 0."""
    return _commit(spark, path, {"params": asdict(params), "ranges": ranges, "next_id": 0, "generations": []}, 0)


def _params(manifest: dict, threshold: float | None = None) -> SketchParams:
    return SketchParams(**manifest["params"] | ({} if threshold is None else {"threshold": threshold}))


def _write(path: str, name: str, columns: DataFrame, genomes: DataFrame, words: DataFrame, params: SketchParams, ranges: int) -> None:
    at = lambda table: f"{path}/{table}/generation={name}"
    placed = columns.select("block", "bucket", "fps").withColumn(RANGE, in_range(params, ranges)).sortWithinPartitions(RANGE, "block", "bucket")
    placed.write.partitionBy(RANGE).option("compression", "zstd").parquet(at("columns"))
    genomes.write.parquet(at("genomes"))
    words.write.parquet(at("bloom"))


def append(spark: SparkSession, path: str, genomes: DataFrame, numbered: bool = False) -> int:
    """Add genomes(genome_id, name, seq) and return the new version.

    Their ids are taken from 0 and put behind those stored; if `numbered` they stay, and must be so large already.
    """
    last = _manifest(spark, path, None)
    first = last["next_id"]
    if numbered:
        least = genomes.agg(F.min("genome_id")).first()[0]
        if least is not None and least < first:
            raise ValueError(f"ids must be {first} or more")
    else:
        genomes = genomes.withColumn("genome_id", F.col("genome_id") + F.lit(first))
    params = _params(last)
    built = build(genomes, params)
    top = built.genomes.agg(F.max("genome_id")).first()[0]
    name = uuid.uuid4().hex
    _write(path, name, built.columns, built.genomes, built.words, params, last["ranges"])
    new = {k: last[k] for k in ("params", "ranges")} | {"next_id": first if top is None else top + 1, "generations": [*last["generations"], name]}
    return _commit(spark, path, new, last["version"] + 1)


def open_version(spark: SparkSession, path: str, version: int | None = None, threshold: float | None = None) -> Index:
    """The index of a version, the last one by default."""
    manifest = _manifest(spark, path, version)
    params = _params(manifest, threshold)
    schemas = {
        "columns": f"block long, bucket long, fps binary, {RANGE} int", "genomes": "genome_id long, name string, n_chars long, sketch_size long, genome_size long",
        "bloom": "word long, mask long",
    }

    def read(name: str) -> DataFrame:
        if not manifest["generations"]:
            return spark.createDataFrame([], schemas[name])
        folders = [f"{path}/{name}/generation={g}" for g in manifest["generations"]]
        return spark.read.option("basePath", f"{path}/{name}").schema(f"{schemas[name]}, generation string").parquet(*folders).drop("generation")

    columns, words = read("columns"), read("bloom").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"))
    return Index(params, packing.to_rows(columns), read("genomes"), blooms.cells_of(words), manifest["ranges"], columns, words)


def _laid_together(columns: DataFrame) -> DataFrame:
    """One column for each block and bucket. Columns are dealt by range of buckets, so a hot bucket is no larger than its blocks."""
    dealt = columns.select("block", "bucket", "fps").repartitionByRange("bucket", "block").sortWithinPartitions("block", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.empty(0, np.uint8)
        for batch in batches:
            out = []
            for block, bucket, fps in zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), batch.column("fps").to_pylist()):
                fps = np.frombuffer(fps, np.uint8)
                if (block, bucket) == at:
                    both = np.full(max(len(held), len(fps)), packing.EMPTY, np.uint8)
                    both[: len(held)] = held
                    both[: len(fps)] = np.minimum(both[: len(fps)], fps)
                    held = both
                    continue
                if at is not None:
                    out.append((*at, held.tobytes()))
                at, held = (block, bucket), fps
            if out:
                yield packing.batch_of(out)
        if at is not None:
            yield packing.batch_of([(*at, held.tobytes())])

    return dealt.mapInArrow(run, "block long, bucket long, fps binary")


def compact(spark: SparkSession, path: str) -> int:
    """Write all generations of the last version as one, and return the new version."""
    last = _manifest(spark, path, None)
    now = open_version(spark, path, last["version"])
    name = uuid.uuid4().hex
    _write(path, name, _laid_together(now.columns), now.genomes, now.words, now.params, last["ranges"])
    return _commit(spark, path, {k: last[k] for k in ("params", "ranges", "next_id")} | {"generations": [name]}, last["version"] + 1)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete all but the last `keep` versions, and the generations that these don't hold; no writer may be at work."""
    system, at = _files(spark, path)
    known = versions(spark, path)
    kept = known[-keep:]
    used = {name for v in kept for name in _manifest(spark, path, v)["generations"]}
    for v in known[: -len(kept)]:
        system.delete(at("versions", f"{v:010}.json"), False)
    gone = set()
    for table in TABLES:
        for status in system.listStatus(at(table)) if system.exists(at(table)) else []:
            name = status.getPath().getName().partition("=")[2]
            if name not in used:
                system.delete(status.getPath(), True)
                gone.add(name)
    return sorted(gone)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a whole index."""
    system, at = _files(spark, path)
    system.delete(at(), True)

