"""The corpus pipeline: five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of ``documents``.

1. toxicity: documents that the classifier rejects go.
2. jaccard: of each class of near copies, the document of least id stays.
3. pii: mentions are replaced by surrogates.
4. mixing: every document stays; those of domains below their target weight are repeated by their rate.
5. sentencepiece: texts become piece ids, with the text that they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leontia.llm import jaccard, mixing, pii, sentencepiece, toxicity
from leontia.llm.common import cut, table
from leontia.llm.queries import pii_key

#: Target weights of the domains, and the tokens aimed at as a multiple of those that come in.
MIX_WEIGHTS, MIX_BUDGET = {"high": 0.8, "low": 0.2, "toxic": 0.0}, 1.25


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_pii(docs, pii_key(spark), None)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rates = mixing.mix_rates(docs, table(spark, sf_dir, "labels"), MIX_WEIGHTS, MIX_BUDGET, least=1.0)
    return mixing.repeat_by_rate(docs, rates)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity_stage), ("jaccard", jaccard_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("sentencepiece", sentencepiece_stage)]

#: The classifier, the recursion and the encoder cannot be put in SQL; tests/llm/test_pipeline.py checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
