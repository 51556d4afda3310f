"""The corpus pipeline: documents to a clean, deduplicated mixture.

STAGES lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All stages but the last return the columns of documents.

- language: documents whose language cannot be told go;
- line_dedup: lines that an earlier document has go, and with them
  documents without any line left;
- near_duplicates: the smallest doc_id of each group of near duplicates stays;
- decontamination: documents contaminated by the benchmark go;
- mixture: how often, and with how many words, the mix takes each document.

Empty tables give empty results; rows with NULL text or without letters
leave at the first stage; other columns of documents are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from custodia.llm.decontaminate import decontaminate
from custodia.llm.jaccard_join import one_per_component
from custodia.llm.language_id import identified_only
from custodia.llm.line_dedup import dedup_lines
from custodia.llm.mixing import mix_sources
from custodia.llm.tables import removed_after, table
from custodia.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified_only(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: Models and learned states decide what stays; tests hold the stages
#: against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared checkpoint
    folder and read again; what it has stored on the way is then removed."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with removed_after(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
