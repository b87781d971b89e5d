"""The corpus pipeline: documents to packed sequences in five stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet to the session's shared folder and reread as the next stage's docs. All but the last
return the columns of documents.

1. quality: documents that fail the quality rules or are depleted of lines of their own go.
2. toxicity: documents predicted toxic go.
3. near duplicates: the document with the least doc_id of each group of near duplicates stays.
4. substrings: passages that an earlier document has are cut out of the texts.
5. packing: what is left becomes pieces in sequences of 1024 ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import table
from tessella.llm.jaccard_join import stage_jaccard
from tessella.llm.packing import stage_packing
from tessella.llm.quality import stage_quality
from tessella.llm.substrings import stage_substrings
from tessella.llm.toxicity import stage_toxicity
from tessella.shared import shared_folder

STAGES = [
    ("quality", stage_quality),
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_jaccard),
    ("substrings", stage_substrings),
    ("packing", stage_packing),
]

#: SQL can't express tokenizing, learned scores or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
