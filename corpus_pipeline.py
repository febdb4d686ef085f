"""Five stages that turn documents into a mixed training corpus; each uses one operator of corpusgraph.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.decontam import contaminated
from corpusgraph.llm.langid import fit, identify, training_sample
from corpusgraph.llm.partenum import jaccard_components
from corpusgraph.llm.pfair import mixed
from corpusgraph.llm.secret_scan import redacted
from corpusgraph.llm.staging import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects; the models are learnt from the documents with a lang."""
    return identify(docs, fit(training_sample(docs))).where("not rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group linked by five-word shingles of Jaccard 0.8 or more."""
    kept = jaccard_components(docs, percent=80, width=5, links=False).where("doc_id <=> component_id").select("doc_id")
    kept = kept.distinct().withColumnRenamed("doc_id", "kept_id")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    held = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets' spans replaced."""
    return redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mixture of sources; reading by (slot, position_in_block) is the mix."""
    return mixed(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("secret_scan", without_secrets),
    ("mixing", mixture),
]

#: Trained models, connected components and a schedule: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        out.write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
