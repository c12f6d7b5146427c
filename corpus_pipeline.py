"""A training corpus from ``documents``: classify, deduplicate, decontaminate, scan, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one works on;
all but the last return the columns of ``documents``.  Documents that the classifier scores
under 0.7, all but one of each near-duplicate group, and documents that cover a benchmark
item go; secrets are replaced inside the texts that hold them; mixing then repeats or
leaves out documents by their source's target weight, as its method does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm.decontaminate import drop_contaminated
from fathom.llm.graph import cut
from fathom.llm.mixing import mix_sources
from fathom.llm.near_dedup import keep_one_of_each
from fathom.llm.quality import fit_quality, score_quality
from fathom.llm.secrets import redact_secrets

KEEP_SCORE = 0.7


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).where(f"score >= {KEEP_SCORE}").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", scan_secrets),
    ("mixing sources", mix),
]

#: A trained classifier, MinHash and string tiling have no SQL form; tests hold the rows
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
