"""Text forms of results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType


def hit_text(genome: str = "genome_id") -> Column:
    """genome, matches, whole intersection and jaccard of one hit, as text."""
    return F.concat(
        F.concat_ws("\t", F.col(genome).cast("string"), F.col("matches").cast("string"), F.floor("intersection").cast("string"), F.format_string("%.6f", "jaccard")),
        F.lit(";"),
    )


def approximate_lines(queries: DataFrame, hits: DataFrame, empty: bool, genome: str = "genome_id") -> DataFrame:
    """query_id, line: "header:hit;hit;" with hits by rank. `empty`: also queries without a hit."""
    joined = hits.select("query_id", F.struct("rank", hit_text(genome).alias("t")).alias("h")).groupBy("query_id").agg(F.sort_array(F.collect_list("h")).alias("h"))
    rows = queries.select("query_id", "header").join(joined, "query_id", "left" if empty else "inner")
    text = F.concat_ws("", F.transform(F.coalesce("h", F.array().cast("array<struct<rank:int,t:string>>")), lambda x: x["t"]))
    return rows.select("query_id", F.concat("header", F.lit(":"), text).alias("line"))


@F.pandas_udf(StringType())
def six_digits(x: pd.Series) -> pd.Series:
    """A number with six significant digits, as C++ streams write it."""
    return x.map(lambda v: f"{v:g}")


def exact_lines(hits: DataFrame) -> DataFrame:
    """line: real jaccard, estimated jaccard, intersection, estimated intersection, header, file, by tabs."""
    number = lambda c: six_digits(F.col(c).cast("double"))
    return hits.select(F.concat_ws("\t", number("real_jaccard"), number("jaccard"), number("inter"), number("intersection"), "header", "name").alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)
