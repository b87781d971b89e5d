"""Command line: build or load an index, query it, write results."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import Observation, SparkSession

from tessella.operators import exact as exacts
from tessella.operators import index as indexes
from tessella.operators import search
from tessella.params import SketchParams
from tessella.shared import checkpoint
from tessella.sources import fasta, sinks

log = logging.getLogger("tessella")


# The letters of the options and their defaults.
def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella", add_help=False, description="Sequence search by sketches")
    p.add_argument("--help", action="help")
    p.add_argument("-i", dest="load", help="load an index")
    p.add_argument("-l", dest="files", help="index the files of a list")
    p.add_argument("-a", dest="records", help="query a file of two-line records")
    p.add_argument("-A", dest="query_files", help="query the files of a list, one query for each")
    p.add_argument("-o", dest="output", default="out.txt", help="output folder")
    p.add_argument("-d", dest="dump", help="save the index")
    p.add_argument("-h", dest="log2_buckets", type=int, default=17)
    p.add_argument("-k", dest="k", type=int, default=31)
    p.add_argument("-s", dest="threshold", type=float, default=200)
    p.add_argument("-t", dest="threads", type=int, default=8, help="local threads, where no master is set")
    p.add_argument("-f", dest="mantissa", type=int, default=3)
    p.add_argument("-b", dest="log2_bloom", type=int, default=33)
    p.add_argument("-e", dest="exact", action="store_true", help="verify hits exactly")
    return p


def tell_missing(spark: SparkSession, path: str | None) -> None:
    """A missing input is told and counts as empty."""
    if path and not fasta.existing(spark, [path]):
        log.warning("missing file: %s", path)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    began = time.time()
    if args.load:
        index = indexes.load(spark, args.load)
    else:
        params = SketchParams(args.k, args.log2_buckets, args.mantissa, args.log2_bloom, args.threshold)
        tell_missing(spark, args.files)
        whole, pieces, missing = fasta.genome_pieces_of_list(spark, args.files, params.k)
        for r in missing.toLocalIterator():
            log.warning("missing file: %s", r["path"])
        seen = Observation()
        index = indexes.build(whole, params, seen)
        counts = seen.get
        log.info("%s genomes read whole, %s of them shorter than k, %s letters, %s k-mers", *(f"{counts[c] or 0:,}" for c in ("genomes", "short", "letters", "kmers")))
        if not pieces.isEmpty():
            index = indexes.together(index, indexes.build_of_pieces(pieces, params))
    if args.dump:
        indexes.save(index, args.dump, rows=False)
        index = indexes.load(spark, args.dump)
    log.info("index ready after %s s", f"{time.time() - began:,.0f}")
    k = index.params.k
    tell_missing(spark, args.records or args.query_files)
    if args.records:
        queries = fasta.records(spark, args.records, k, args.exact)
        kind = search.RECORDS_EXACT if args.exact else search.RECORDS
    elif args.query_files:
        queries, missing = fasta.file_queries(spark, args.query_files, k, args.exact)
        for r in missing.toLocalIterator():
            log.warning("missing file: %s", r["path"])
        kind = search.FILES_EXACT if args.exact else search.FILES
    else:
        log.warning("no query given")
        return
    hits = checkpoint(search.search(index, queries, **kind))
    if args.exact:
        named = index.genomes.select("genome_id", "name")
        parts = fasta.segments_of_files(spark, hits.join(named, "genome_id").select("genome_id", "name"), k)
        checked = exacts.exact_counts(hits, queries.select("query_id", "seq"), parts, k)
        full = checked.join(queries.select("query_id", "header"), "query_id").join(named, "genome_id")
        sinks.write_lines(sinks.exact_lines(full), args.output)
    else:
        sinks.write_lines(sinks.approximate_lines(queries, hits, empty=bool(args.records)), args.output)
    log.info("done after %s s", f"{time.time() - began:,.0f}")


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO)
    argv = sys.argv[1:] if argv is None else argv
    args = parser().parse_args(argv)
    if not argv or not (args.load or args.files):
        parser().print_help()
        return 0
    builder = SparkSession.builder.appName("tessella")
    spark = SparkSession.getActiveSession() or builder.config("spark.master", f"local[{args.threads}]").getOrCreate()
    run(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
