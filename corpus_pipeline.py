"""From raw documents to a token store: the stages in order, each on what the one before kept.

Defined cases: null text is empty in every stage; rows are told apart by ``doc_id`` and
text, so rows that repeat or have no ``doc_id`` are judged each; columns beside
those of the documents are kept up to the last stage; without labels of both
classes the classifier scores all alike (0.5 without any, which rejects all);
without a benchmark nothing is contaminated; an empty table gives an empty store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwise.llm import decontaminate, mixing, quality, similar, token_store
from spanwise.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the labels of rejected ones go with them."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group linked at a five-word shingle similarity of 0.8 or more."""
    return similar.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix emits them; every document at least once."""
    return mixing.mixed(docs, most_repeats=2.0)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, stored content-addressed, read back and verified."""
    return token_store.encode_and_verify(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", store_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each result written and read again."""
    from spanwise.llm.shared import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{k}")
    return docs
