"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, html_text, langid, mixing, nearest, negatives, ngram_join, secrets, sharding, spelling, toxicity
from .common import crc_mod, read

#: Target weights of the mixture; a source that is not named gets the smallest. The repository has none from production: these are stand-ins.
MIXTURE = {**{f"src{k}": 4 for k in range(4)}, **{f"src{k}": 2 for k in range(4, 10)}, **{f"src{k}": 1 for k in range(10, 20)}}
SHARDS = [f"shard-{k:03d}" for k in range(128)]


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    """The production vocabulary; it belongs to the machine, not to this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary_path())


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = chat.turn_rows(read(spark, sf_dir, "conversations")).unionByName(chat.turn_rows(more))
    return chat.read_back(chat.format_turns(turns))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=85)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"), html_text.train())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), MIXTURE)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(read(spark, sf_dir, "documents"), crc_mod("doc_id", 4) != 2)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, label, F.col("vec_id") % 50 == 0)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words_of(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_html_text": op2_html_text,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bpe": op6_bpe,
    "op7_sharding": op7_sharding,
    "op8_langid": op8_langid,
    "op9_chat": op9_chat,
    "op10_nearest": op10_nearest,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_secrets": op12_secrets,
    "op13_spelling": op13_spelling,
}
SQL: dict[str, str] = {
    "op1_ngram_join": ngram_join.SQL,
    "op3_mixing": mixing.sql(MIXTURE),
    "op5_exact_dedup": exact_dedup.SQL,
    "op7_sharding": sharding.sql(SHARDS),
    "op9_chat": chat.SQL,
    "op10_nearest": nearest.SQL,
    "op11_hard_negatives": negatives.SQL,
    "op13_spelling": spelling.SQL,
}
