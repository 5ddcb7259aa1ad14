"""The thin queries of the training-data operators, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.llm import bpe, chat, divergence, exact_dedup, language_id, media, mixing, ngram_join, packing, resampling, toxicity, url_filter, warc
from boxwise.sources.tables import table


#: Names of hosts that a curated list labels as unwanted; they label the URLs that the trees learn from.
SEED_HOSTS = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track")
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.as_responses(table(spark, sf_dir, "pages")))
    return records.withColumnRenamed("id", "page_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    seeded = url_filter.host_of(F.col("url")).rlike(rf"(^|\.)({'|'.join(SEED_HOSTS)})\.")
    model = url_filter.train(pages.select("url", seeded.cast("int").alias("label")))
    return url_filter.judge(pages, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = chat.as_transcripts(table(spark, sf_dir, "conversations"))
    model = chat.train(transcripts, "conv_id", "turn", "text", "role")
    return chat.parse(transcripts.drop("role"), model)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, store = media.text_pages(table(spark, sf_dir, "documents"))
    items = media.interleave(pages, store, with_text=False).where("kind = 'media'")
    return items.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position"
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), with_text=False)
    return scored.drop("restored")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), with_ids=False, with_text=False).drop("ids", "decoded")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_warc_derivatives, op2_url_filter, op3_chat, op4_ngram_join, op5_exact_dedup, op6_media, op7_toxicity, op8_packing, op9_mixing, op10_language_id,
    op11_bpe, op12_divergence, op13_resampling,
)
QUERIES = {f.__name__: f for f in _ALL}
