"""A training-data pipeline: documents to token files, in five stages of the operators in ``lightloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Defined results: documents without letters (null and empty texts among them) have no language and go in the first stage, as do
those of a doubtful one; rows that share a doc_id are one document in near-dedup, of which one row stays; of equal texts the
smallest doc_id stays; a null doc_id is kept by near-dedup and comes first in the token files; a null source is a source of its
own in the mix; a benchmark without words removes nothing; an empty table gives no rows; extra columns of documents go along
up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lightloom.llm.common import short_batches, stored, table
from lightloom.llm.decontaminate import remove_contaminated
from lightloom.llm.language import fit, keep_identified
from lightloom.llm.minhash import keep_one_of_each
from lightloom.llm.mixing import mix_documents
from lightloom.llm.tokens import token_report


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not found, or is doubtful, go; the model learns from the labelled documents."""
    short_batches(spark)
    return keep_identified(docs, fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, a similarity of 0.8)."""
    short_batches(spark)
    return keep_one_of_each(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    short_batches(spark)
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"), how="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document that is taken twice is two rows."""
    return mix_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32."""
    short_batches(spark)
    return token_report(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token files", write_token_ids),
]

#: SQL has no language model, MinHash or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
