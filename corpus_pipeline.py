"""The corpus pipeline: five stages from raw documents to token ids.

Every stage but the last returns the columns of ``documents``; each works on all that the
one before it kept.  ``run`` writes what a stage returns to the checkpoint folder before the
next one reads it.

Defined results: a null or empty text has no letter and goes at the first stage; rows with a null
id are never near copies and stay; rows that repeat another (id and text) go at the second stage, but for one;
ties in the mix fall as ``mixing`` says; a null language is filled in, a null source is a source of its own; other
columns are carried along; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, langid, minhash, mixing, secrets
from tessera.llm._common import cut, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose declared language their text contradicts, go; a null language is filled in."""
    return langid.identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.dedup(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the text they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokenize),
]
#: The stages learn, hash and tokenise in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
