"""The corpus pipeline: toxic texts go, one text of each near-duplicate group stays, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the
columns of documents. Stages keep null ids, null and empty texts and very long texts (each operator's docstring says how
they count), and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm.common import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts that score 0.7 or more. Labels only train; clean and empty texts stay."""
    from roadspark.llm.toxicity import fit, reject_toxic

    return reject_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component at five words and 0.8: the least id, null ids last; rows without words all stay."""
    from roadspark.llm.ngram_join import drop_near_copies

    return drop_near_copies(docs, words=5, similarity=0.8)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with every secret replaced by a mark, and n_chars to match."""
    from roadspark.llm.secrets import mask_secrets

    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences of 2048 tokens."""
    import public_tokenizers

    from roadspark.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("secret_scans", secret_scans), ("packing", packing)]

#: SQL can express neither the trained scores nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
