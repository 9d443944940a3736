"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is stored and read again as the next one's docs; all
but the last keep the columns of documents. Nulls, repeated rows and empty tables are as in the stages' operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from tessel.llm.common import BROADCAST_ROWS, crc_mod, keep_ids, stored
from tessel.llm.queries import MIXTURE, vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5; it learns as in op4, from the documents it is given. Null texts count as empty, and rows that repeat are judged alike."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 5) != 0)
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (null counts as empty), the one with the largest id, and one row of it; an id only goes with the text it was kept for. A null id stays if no row of its text has another."""
    found = exact_dedup.exact_dedup(docs).where("kept")
    found = stored(found.groupBy(_id().alias("kept_id"), F.col("text_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("n")).select("kept_id", _digest(F.col("sha")).alias("kept_digest"), "n"), "kept")
    ids = found.select("kept_id", "kept_digest")
    rows = docs.select(*COLUMNS)
    same = (_id() == F.col("kept_id")) & (_digest(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)) == F.col("kept_digest"))
    rows = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, same, "left_semi")
    return rows.dropDuplicates(["doc_id", "text"]) if found.where("n > 1").limit(1).count() else rows


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _digest(sha: Column) -> Column:
    """The first 60 bits of a hex digest; with the id they tell the texts of one id apart."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links (five words, 0.8) hold together, the document with the smallest id.

    Rows whose id is null or that of another row too go by a number made of id and text, larger than any id: a row with
    an id of its own stays before them.
    """
    rows = docs.select(*COLUMNS)
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("again_id"))
    again = stored(again, "again")
    n = again.count()
    number = F.col("doc_id").cast("long")
    if n:
        rows = rows.join(F.broadcast(again) if n <= BROADCAST_ROWS else again, F.col("doc_id").eqNullSafe(F.col("again_id")), "left").withColumn("own", F.col("again_id").isNull() & F.col("doc_id").isNotNull()).drop("again_id")
        number = F.when(F.col("own"), number).otherwise(F.lit(3 << 61) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61)))
    rows = rows.withColumn("number", number)
    found = ngram_join.near_duplicates(rows, k=5, percent=80, id_col="number")
    ids = stored(found.where("component_id = doc_id").select(F.col("doc_id").alias("number")), "kept")
    return keep_ids(rows, ids, "number").select(*COLUMNS)


def _places(docs: DataFrame) -> DataFrame:
    """``doc_id, slot, place`` in the mixture to MIXTURE: a function of the ids and sources alone, so that any stage that has the same rows derives the same; of rows that repeat an id, the first place."""
    at = F.struct("slot", "place")
    return mixing.mix(docs, MIXTURE).groupBy("doc_id").agg(F.min(at).alias("at")).select(F.col("doc_id").alias("at_id"), "at.slot", "at.place")


def _placed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.join(_places(docs), F.col("doc_id").eqNullSafe(F.col("at_id")), "left").drop("at_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: partitions are runs of it, and rows lie in order inside them; rows that share an id, or have none, share its first place."""
    rows = _placed(docs.select(*COLUMNS), docs)
    return rows.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place", "doc_id").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each whole text, as in op6, and ``slot, place``: the mixture is the rows in their order, which files don't keep."""
    return _placed(bpe.round_trip(docs, vocabulary_path()), docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the classifier, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
