"""The queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, langid, mtree, packing, records, shards, simhash, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = records.write_records(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return records.read_records(index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classify(table(spark, sf_dir, "documents"), words=4, radius=4).drop("keep")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def pack_pieces(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=1, longest=2048)


def pack_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(pack_pieces(table(spark, sf_dir, "documents")))


#: Rules of the URL filter's query.
URL_RULES = [
    urls.Rule(urls.BLOCK, "com", "/en/"),
    urls.Rule(urls.ALLOW, "example.com", "/en/7"),
    urls.Rule(urls.ALLOW, "net", "/de/"),
    urls.Rule(urls.BLOCK, "example.net", "/de/8"),
    urls.Rule(urls.BLOCK, "org", "/es/"),
]
#: Shards and slots of the placement query; a prime over 100 slots a shard keeps shares within 1 %.
SHARDS, SLOTS = 32, 4099


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages.select("page_id", "url"), urls.page_links(pages), URL_RULES).select("row.page_id", "host", "path", "rule", "verdict")


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", shards.shard_names(SHARDS), SLOTS)
    return placed.select("row.doc_id", "slot", "shard")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), k=10)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), "start_word", "n_words")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.classify(docs, langid.train(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_filter": urls.oracle(URL_RULES),
        "op7_shard": shards.oracle("documents", "doc_id", SHARDS, SLOTS),
        "op8_top_k": TOP_K_SQL,
        "op9_decontaminate": decontam.oracle(),
    }
