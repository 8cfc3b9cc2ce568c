"""A training corpus from raw documents, in five stages; each reads the Parquet table that the one before has written.

All stages but the last return the columns of documents, for every row that they keep.

Defined results: a null text has the score of no word, is no near copy, repeats nothing, stays null and has no ids; rows
with a null id stay, as no copy of another; rows that repeat an id are judged by their own texts, and a stage that drops
a document drops all rows of its id; without labels no document is rejected; an empty table gives an empty result; other
columns of documents don't pass.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import bpe, mixing, near_dedup, suffix_dedup, toxicity
from stowage.llm.common import new_folder, table
from stowage.llm.queries import byte_bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of this stage's documents."""
    model = toxicity.fit_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).filter(F.col("score") < 0.5).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id. Near are texts whose sets of five-word shingles have a similarity of 0.8 or more."""
    gone = near_dedup.near_dedup(docs, percent=80).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that an earlier document has go, in whole characters; a null text stays null."""
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS), characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS), size=mixing.word_count(F.col("text")), quality=mixing.text_quality(F.col("text")))
    times = F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    return mixed.filter("mix_copies > 0").select(*COLUMNS, times.alias("epoch")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row, with the digest of the bytes that they decode to."""
    rows = bpe.encode(docs.select("doc_id", "source", "text"), byte_bpe(), public_tokenizers.PATTERN, decoded_col="decoded", lasting=False).drop("text")
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_repeats), ("mixing", mix), ("byte_bpe", tokenize)]
#: The first stage learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
