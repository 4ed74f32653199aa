"""A corpus from raw documents to packed token rows: five stages, each over all rows that its predecessor kept."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hostlake.llm.common import shared_folder, table  # noqa: E402
from hostlake.llm.decontaminate import drop_leaks  # noqa: E402
from hostlake.llm.mixing import to_weights  # noqa: E402
from hostlake.llm.near_dedup import keep_one_of_each  # noqa: E402
from hostlake.llm.packing import to_token_rows  # noqa: E402
from hostlake.llm.quality import keep_good  # noqa: E402

STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", to_weights),
    ("token-ID output", to_token_rows),
]

ORACLE_SQL = None  # the classifier and the tokenizer have no SQL form: tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder and the next stage's input."""
    docs, at = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{at}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
