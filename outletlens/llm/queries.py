"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outletlens.llm import centroids, chat, common, covertree, html, langid, media, minhash, mixing, packing, pii, sharding, token_store, trie


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into windows of 4096 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every 50th vector with all others."""
    return covertree.top_k(_table(spark, sf_dir, "embeddings"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as an ISO media file and read its features from the stored bytes."""
    return media.features(media.stored(_table(spark, sf_dir, "documents")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.digest(pii.detect(_table(spark, sf_dir, "documents")))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all texts as id shards with a perfect hash index, then read every document back by its key."""
    root = common.scratch_path(spark, "ids")
    manifest = token_store.write(_table(spark, sf_dir, "documents"), root, _path("byte_bpe_50k.json"))
    return token_store.read_back(spark, manifest, root)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on labelled documents outside the held-out fifth, then predict every document's language."""
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs, foreign=False))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format each two neighbouring conversations as a preference pair; spans as "start-end" joined by commas."""
    pairs = chat.preferences(chat.neighbours(_table(spark, sf_dir, "conversations")))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return pairs.withColumns({c: joined(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents by source weights and order them by training position."""
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "n_copies", "position")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, laid out."""
    return html.pages_text(_table(spark, sf_dir, "pages"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors after ten rounds."""
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffle all documents into eight shards on disk, then read every record's place from them."""
    root = common.scratch_path(spark, "shards")
    schema = sharding.write(_table(spark, sf_dir, "documents"), root)
    return sharding.digest(sharding.read(spark, root, schema))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


OPERATORS = (
    op1_packing, op2_exact_top_k, op3_media_columns, op4_pii, op5_token_output, op6_minhash_near_dedup, op7_language_id, op8_chat_formatting, op9_mixing, op10_html_extraction,
    op11_centroid_clustering, op12_sharding, op13_prefix_trie,
)
QUERIES = {f.__name__: f for f in OPERATORS}
