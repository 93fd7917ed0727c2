"""Corpus pipeline: quality rules, near duplicates, personal data, source mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm import bpe, jaccard, mixing, pii, quality
from newslens.llm.common import stash, table

#: Pieces that a BPE worker remembers, at most: the stages before it leave their executors little memory.
REMEMBERED = 50_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and blank texts are too short and go; rows without an id or of an id that occurs twice are judged by their own
    texts; equal rows are judged alike; an empty table stays empty; columns beyond those of documents are left out.
    """
    judged = quality.quality_rules(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).select(*COLUMNS, "kept")
    # written first: a filter pushed below would repeat the verdict's whole expression for each of its parts
    return stash(judged).where("kept").drop("kept")


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8), the one of least id.

    Rows without an id or without words stay; of equal rows one stays; unlike rows of one id are documents of their
    own; an empty table stays empty.
    """
    return jaccard.one_of_each(docs).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars counted anew.

    Null texts stay null, with a null n_chars; every row is judged by itself; an empty table stays empty.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of the mix.

    Null sources are one source; rows without words, null texts too, never come; equal rows are taken alike; an empty
    table stays empty.
    """
    return mixing.mixture(docs).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids with their number and digests.

    Null and empty texts have no ids; every row is encoded by itself; an empty table stays empty.
    """
    return bpe.encode_documents(docs, ids=True, text=False, remembered=REMEMBERED).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", duplicate_stage),
    ("personal data", pii_stage),
    ("source mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Hashes, fitted weights and token ids are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table; each stage's result is written and read again.

    A folder whose documents are all rejected, or that has none, gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
