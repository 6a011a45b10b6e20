"""Corpus pipeline: quality filter, exact dedup, near dedup, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs.  All but the last return the columns of documents, with the documents' own values, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, exact_dedup, mixing, near_dup, quality
from quillon.llm.common import read, tokenizer_file, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labels of its training fold, scores below its threshold.

    Null, empty and very long texts are scored by their rates like all others; equal texts are kept or dropped together;
    labels of ids that docs lacks teach nothing; without labels of both classes everything stays.
    """
    model = quality.learn(docs, read(spark, sf_dir, "labels").where(quality.fold() != 0))
    return quality.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (white space aside) one stays: the longest in code points, then the smallest doc_id, null last.

    Null and empty texts are equal; of rows alike in id and text one stays; long texts are compared by their recipes.
    """
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by word shingles one stays: the smallest doc_id (null last), then the smallest hash of its text.

    Rows without words are linked with nothing and stay; rows that share an id but not the text are told apart; of rows
    alike in both one stays.
    """
    return near_dup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A null source is a source of its own; texts without words are taken no times; rows that share an id and a size class are
    taken or left together.
    """
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of every text, with digests of the ids and of what they decode to.

    Null and empty texts have no ids; every repeated row has its own row.
    """
    import public_tokenizers

    made = bpe.encode_docs(docs.select("doc_id", "source", "text"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)
    return made.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix", mix_sources), ("encode", encode)]

#: A fitted classifier, shingle components and a tokenizer have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
