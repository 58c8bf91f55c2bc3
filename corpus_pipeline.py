"""A corpus pipeline of five stages: quality, near-duplicates, secrets, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import bpe, mixing, quality, secret_scan, simhash
from ridgeline.llm._shared import settle, table
from ridgeline.llm.queries import TOKENIZER


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of five-word shingles and a similarity of 0.8 or more: that of the
    smallest id. Rows without an id stay; of an id with several texts each is judged by itself; repeated rows stay once."""
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets."""
    return secret_scan.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens have tempered shares of sources, languages and length bands."""
    taken = mixing.mix(docs, source=F.col("source"), lang=F.col("lang"), tokens=mixing.word_tokens(F.col("text")))
    return taken.select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the token ids of every document."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality classifier", good_quality), ("SimHash near-dedup", one_of_each), ("secret scans", without_secrets), ("mixing sources", mixed), ("byte-level BPE", tokens)]
#: SQL has no SimHash, no trained classifier and no BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
