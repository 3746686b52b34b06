"""A corpus pipeline over `documents`: five stages, each on all that the one before it kept.

1. quality: documents that the weakly supervised classifier rejects go.
2. near_duplicates: of documents whose five-word shingles reach a Jaccard similarity of 0.8, directly
   or over others, the one of the smallest doc_id stays.
3. pii: spans of personal data are replaced by their kind; n_chars follows the text.
4. mixing: sources are mixed at the temperature at which the smallest is repeated at most twice and
   the largest once; no document goes, repeated ones are repeated rows.
5. sentencepiece: every row's text becomes piece ids, with a check of the round trip.

All but the last return the columns of `documents`. Extra columns of the input are dropped.

Rows are decided on one by one, also where ids repeat or are null: of rows alike in id and text one stays, of
rows that share an id but not their text each is a document. Texts are read whole, whatever their length. Null
and empty texts have no quality but the prior, no shingles, spans or tokens; they stay in each stage that is not
asked to judge them (quality keeps them if the prior reaches its threshold) and get no ids. Ties go to the smaller id.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common, jaccard, mixing, pieces, pii, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    return quality.with_scores(docs, quality.fit(docs.select("doc_id", "text"))).filter("keep").select(COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs.select(COLUMNS), k=5, num=80, den=100)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, cover=True, max_repeat=2.0, carry=("text", "lang", "n_chars")).select(COLUMNS)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(pieces.model_path(), "rb") as f:
        model = f.read()
    return pieces.tokenized(docs, model)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: The stages train models and encode; SQL can't express them. The tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))  # else each stage would run all those before it again and again
    return STAGES[-1][1](spark, docs, sf_dir)
