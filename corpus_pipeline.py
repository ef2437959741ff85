"""The corpus pipeline: quality, near-duplicates, contamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and is written as Parquet in the shared folder and read again as the next one's
documents. All but the last return the columns of documents; the last adds the
place of each document in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm._common import stage, table
from panelwright.llm.classifier import keep_good
from panelwright.llm.decontamination import drop_contaminated
from panelwright.llm.mixing import mixed
from panelwright.llm.secrets import redact
from panelwright.llm.simhash import keep_one

STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", keep_one),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact),
    ("source_mixing", mixed),
]

#: The classifier is fitted and fingerprints are hashed outside SQL; the stages
#: are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, of in STAGES:
        docs = stage(of(spark, docs, sf_dir), name)
    return docs
