"""The training-data pipeline: five stages over ``documents``.

Each stage works on all rows its predecessor kept and is written before the
next one reads it; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import public_tokenizers

from dinerank.llm import decontamination, near_dedup, packing, secrets, toxicity
from dinerank.llm.common import listed, table
from dinerank.session import Scratch

#: A document is rejected from this toxicity score on: higher than the threshold
#: of the query, because a filter should keep clean documents.
REJECT_TOXIC = 0.5

#: The stages use a classifier, fingerprints and a tokenizer: no SQL form.
ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., which clash with no name a stage makes, and their names by the old ones."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below REJECT_TOXIC; the network learns from the labelled ones.

    A null or empty text has the score of a text without words, and every row
    is judged by itself: repeated rows go or stay together. Long texts are
    scored window by window; the worst window counts. A score of exactly
    REJECT_TOXIC is rejected. An empty table stays empty.
    """
    own, c = _plain(docs)
    net = toxicity.learned(docs, table(spark, sf_dir, "labels"), F.lit(True))
    scored = toxicity.score_texts(own, net, REJECT_TOXIC, c["text"], keep=own.columns)
    return scored.where("predicted = 0").select(*own.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the texts linked, the one
    with the least id (null ids last, then by the text's hash), and one row of it.

    Texts decide, not ids: rows of one id with different texts are documents of
    their own, repeated rows and equal texts with a null id are copies. Rows
    whose text is null or has no word are in no group and all stay. Long texts
    are compared as wholes. An empty table stays empty.
    """
    job = Scratch(spark)
    plain, c = _plain(docs)
    plain = plain.withColumnsRenamed({c["text"]: "text", c["doc_id"]: "doc_id"})
    kept = plain.columns
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = plain.where(worded).withColumn("_h", F.xxhash64("text"))
    # One row per text. Only texts met twice are ranked, and each task hands on its first row of a text. Only those are
    # written: the texts met once, most of the table, are read again from the stage's input wherever they are needed.
    twice = job.cut(own.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"))
    marked = listed(own, twice, ["_h"], "_listed")
    rank = F.row_number().over(Window.partitionBy("_h", "text").orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64(*kept)))
    first = job.cut(marked.where("_listed").withColumn("_r", rank).where("_r = 1").drop("_r"))
    one = marked.where(~F.col("_listed")).unionByName(first).drop("_listed")
    groups = near_dedup.near_duplicates(one, near_dedup.NearParams(percent=80, bands=48, rows=5), id_col="_h")
    groups = job.cut(groups.select("_h", "component_id").distinct())
    linked = groups.join(one.select("_h", "doc_id"), "_h")
    least = linked.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("_least"))
    gone = job.cut(groups.select("_h").join(least.select(F.col("_least._h").alias("_h")), "_h", "left_anti"))
    marked = listed(one, gone, ["_h"], "_listed")
    left = marked.where(~F.col("_listed")).unionByName(marked.where("_listed").join(gone, "_h", "left_anti").select(*marked.columns))
    out = left.select(*kept).unionByName(plain.where(~worded))
    return out.toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    A null or empty text leaks nothing and stays; every row is judged by
    itself, whatever its id; long texts are searched as wholes. An empty
    benchmark, or an empty table, changes nothing.
    """
    own, c = _plain(docs)
    found = decontamination.leaks(own, table(spark, sf_dir, "benchmark"), text_col=c["text"], out="leaks")
    return found.where(F.size("leaks") == 0).select(*own.columns).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark; n_chars follows the text.

    Null texts stay null, empty ones empty, a null n_chars stays null; rows of
    one id and repeated rows are each redacted. Overlapping finds become one
    mark. An empty table stays empty.
    """
    return secrets.redacted(docs).withColumn(
        "n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens.

    A null or empty text is one piece, its end token; longer texts than a
    sequence are cut; every row, repeated or without an id, is packed. An empty
    table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    job = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = job.table_path(name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
