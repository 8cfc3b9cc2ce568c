"""The registered queries of this subpackage. Each is thin: it binds an operator to the tables and names its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import bpe, decontaminate, html_text, media, mixing, near_dedup, periodic, preferences, repair, suffix_dedup, topk, toxicity, url_filter
from stowage.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_sources(docs, size=mixing.word_count(F.col("text")), quality=mixing.text_quality(F.col("text")))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_audio(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    stored = stored.select("doc_id", n_bytes.alias("n_bytes"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return media.audio_features(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensors", "segments")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_format_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_preferences(preferences.contrast_pairs(table(spark, sf_dir, "conversations")))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def byte_bpe() -> list[tuple[bytes, int]]:
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = bpe.encode(docs, byte_bpe(), public_tokenizers.PATTERN, decoded_col="decoded").drop("text")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_model(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = repair.damaged(table(spark, sf_dir, "conversations"))
    out = repair.repair_conversations(turns, present=F.col("present"))
    return out.select(*[c for c in out.columns if c != "repaired"], F.sha2(repair.rendered(F.col("repaired")).cast("binary"), 256).alias("repaired_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("text", F.when(h % 10 == 0, periodic.looped(F.col("text"), F.floor(h / 10))).otherwise(F.col("text")))
    out = periodic.find_runs(docs, exponent=4, least=6).withColumn("best", periodic.longest(F.col("runs")))
    milli = F.expr("1000 * best.length div best.period")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), digest(periodic.listed(F.col("runs"))).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    out = decontaminate.scan(docs.select("doc_id", "text"), bench.select("item_id", "text"))
    items = F.array_join(F.col("items").cast("array<string>"), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mix_sources, op2_media_columns, op3_minhash_near_dedup, op4_html_text, op5_suffix_dedup, op6_url_filter, op7_format_preferences, op8_exact_topk, op9_byte_bpe, op10_toxicity, op11_repair_conversations, op12_periodic_runs, op13_decontaminate)}
