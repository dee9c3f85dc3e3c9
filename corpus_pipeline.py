"""A training-corpus pipeline over the documents table: five stages, each written as Parquet and read again.

Defined results: documents with a null or empty text have no letters and go in the first stage; of equal and of similar
texts the rows that the operators name stay; repeated rows count once; columns of any name are carried up to the last
stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, gru_langid, mixing, simhash
from tidemark.llm.common import prefix_for, shared_folder
from tidemark.llm.queries import tokenizer_path


#: Least score of a kept document: the network gives its language more than all others together.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those whose language the network scores below LEAST_SCORE; without a fitted network all with letters stay."""
    lang, score = (prefix_for(docs) + c for c in ("lang_pred", "score"))
    judged = gru_langid.predicted_languages(docs, keep=tuple(docs.columns))
    unfitted = (F.col(lang) == gru_langid.UNDETERMINED) & (F.col(score) == 0)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return judged.where(letters & (unfitted | (F.col(score) >= LEAST_SCORE))).drop(lang, score)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every document of the mixture."""
    return bpe.encoded(docs, tokenizer_path(), with_ids=True)


STAGES = [("language ID", language_id), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies), ("mixing", mixture), ("BPE", tokens)]

#: The recurrent network and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "corpus-pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
