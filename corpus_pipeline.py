"""A corpus pipeline of the training-data operators; each stage's rows are written and reread as the next one's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.llm._store import small_batches, written
from rangeweave.llm.mixing import weighed
from rangeweave.llm.pieces import with_pieces
from rangeweave.llm.probminhash import classes
from rangeweave.llm.quality_rules import rejecting
from rangeweave.llm.substrings import without_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    small_batches(spark)
    return rejecting(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays; of rows with its doc_id, that of the least hash.  Rows without a doc_id stay."""
    small_batches(spark)
    kept = written(classes(docs).filter("doc_id = class_id").select(F.col("doc_id").alias("rw_kept")).distinct(), "kept")
    row = F.xxhash64(*docs.columns)
    named = docs.select(F.struct(*docs.columns).alias("rw_row"), F.col("doc_id").cast("long").alias("rw_kept"), row.alias("rw_hash")).join(kept, "rw_kept", "left_semi")
    # hashes alone are compared first, so that texts are not shuffled but for ids that several rows share
    least = written(named.groupBy("rw_kept").agg(F.min("rw_hash").alias("rw_least"), F.count(F.lit(1)).alias("rw_n")).filter("rw_n > 1").drop("rw_n"), "least")
    if not least.isEmpty():
        single = named.join(least, "rw_kept", "left_anti").select("rw_row")
        several = named.join(least, "rw_kept").filter("rw_hash = rw_least").dropDuplicates(["rw_kept"]).select("rw_row")
        named = single.unionByName(several)
    return named.select("rw_row.*").unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut from the text; documents of which nothing stays go."""
    small_batches(spark)
    cut = without_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns).filter(F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the wanted shares of sources, languages and topics; further columns may have any name."""
    rows = docs.select(F.struct(*docs.columns).alias("rw_row"), "doc_id", "text", "source", "lang")
    return weighed(rows).filter("mix_kept").select("rw_row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces."""
    import public_tokenizers

    small_batches(spark)
    return with_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True, keep_words=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", mixed),
    ("sentencepiece", encoded),
]

#: Tokenizing and hashed sampling are not SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
