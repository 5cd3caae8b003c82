"""A training corpus in five stages: language, near-duplicates, personal data, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``; all but the last
return the columns of ``documents``, and any further ones. An empty table goes
through all stages and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from outletlens.llm import common, langid, minhash, mixing, packing, pii

#: A document stays if its text has a letter, is like the language it was given and its score reaches this.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled documents and drop those in no language; null texts and texts without a letter go, repeated rows go or stay together."""
    with common.stage(spark):
        return langid.accepted(docs, langid.train(docs), LEAST_SCORE, only_known=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each near-duplicate component; null and wordless texts stay."""
    with common.stage(spark):
        return minhash.without_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span of personal data by its kind; null and empty texts stay as they are, every row stays."""
    with common.stage(spark):
        return pii.cleaned(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take whole documents as often as the mix says, in the order of their training positions; texts without a word are never taken, a null source is one."""
    with common.stage(spark):
        return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of ids; a null or empty text is its end id alone."""
    import public_tokenizers

    with common.stage(spark):
        return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]

#: SQL has no tokenizer and no trained classifier; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = common.scratch_path(spark, name, tracked=False)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
