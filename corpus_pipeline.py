"""From raw documents to packed training sequences, in five stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all that the one before
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, langid, packing, queries, shingle_dedup, suffix_dedup, workspace

#: A text stays if one language holds at least this share of its letters.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a main language; the model learns from those with a lang.

    A null or empty text has no letter and goes. No document has a lang: all go.
    """
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    named = langid.predict(docs, model, lang_pred="__pred", score="__share")
    return named.filter((F.col("__pred") != langid.UNDETERMINED) & (F.col("__share") >= LEAST_SCORE)).select(docs.columns)


def _order() -> Column:
    """Which row of a group stays, the least first: the smallest doc_id, rows without one last, by a hash of their text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.lit(0), "text").alias("h"), F.xxhash64("text", F.lit(1)).alias("g"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts: with its smallest doc_id, or without one if no row of it has any."""
    keyed = docs.withColumn("__key", _order())
    found, _ = workspace.cut(exact_dedup.exact_duplicates(keyed, "__key").filter("kept").groupBy("doc_id").agg(F.count("*").alias("rows")).withColumnRenamed("doc_id", "__key"), "kept")
    stay = keyed.join(found.select("__key"), "__key", "left_semi")
    return (stay if found.filter("rows > 1").isEmpty() else stay.dropDuplicates(["__key"])).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of texts whose 5-word shingles have a similarity of 0.8 or more: as exact() does."""
    rows, _ = workspace.cut(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    with workspace.scratch(spark):
        found = shingle_dedup.near_components(rows, "__row")
        members = rows.select(F.struct(_order(), "__row").alias("o"), "__row").join(found, F.col("__row") == F.col("node"))
        members, _ = workspace.cut(members.select("__row", "o", "component"), "members")
        first = members.groupBy("component").agg(F.min("o").alias("first"))
        gone = workspace.keep(members.join(first, "component").filter("o <> first").select("__row"), "gone")
    return rows.join(gone, "__row", "left_anti").select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated strings of 200 bytes out of the texts; n_chars follows. No document goes."""
    return suffix_dedup.remove_repeats(docs, texts=True).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which training sequence."""
    return packing.pack(queries.word_lengths(docs))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("suffix_array_dedup", repeats), ("best_fit_packing", packed)]

#: The fingerprints' hash, the language model and the packing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with workspace.scratch(spark):
            docs, before, path = stage(spark, docs, sf_dir), path, workspace.new_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            workspace.drop(spark, before)
    return docs
