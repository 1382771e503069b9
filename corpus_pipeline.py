"""A corpus from raw documents to token ids, in five stages of the operators in cellframe.llm.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as
the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm import bpe, jaccard, mixing, pii, quality
from cellframe.llm.shared import aside, table, written

#: Near copies share this part, in hundredths, of their distinct runs of five words.
NEAR = jaccard.Rule(words=5, part=80)
#: Part of the tokens that the mixture takes; no document is taken twice.
BUDGET_SHARE = 0.8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on those of ``docs`` that have labels, accepts.

    Null and empty texts are scored like others; repeated rows with a label count each for itself;
    without labels all go on. Own columns of the names that the operator gives stay as they are.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows, back = aside(docs, ("score", "predicted"))
    return back(quality.score(rows, model).filter("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id (null first), of equal
    ones the first. Documents without words all stay; null texts are such."""
    return jaccard.keep_one(docs, NEAR)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced. A null text stays null, an empty one empty."""
    return pii.replace(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its share of the budget; the one that crosses it is whole.

    Null language, source and text count as empty; repeated rows are documents of their own. Own
    columns of the names that the operator gives stay as they are.
    """
    rows, back = aside(docs, (*mixing.LEVELS, "n_tokens", "copies", "prefix_tokens", "taken"))
    return back(mixing.mix(rows, budget_share=BUDGET_SHARE, epochs=1).filter("taken"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; none for null and empty texts."""
    out = bpe.encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=None)
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("surrogates", surrogates),
    ("mixture", mixture),
    ("encoding", encoding),
]
#: SQL can't express the classifier, the surrogates or the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
