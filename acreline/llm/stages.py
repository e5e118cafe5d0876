"""Pipeline stages: (spark, docs, sf_dir) -> DataFrame, on all that the stage before kept.

Columns are taken by position, so extra ones, also such whose names differ by letter case
only or that a stage uses itself (`id`, `key`, `kept`), pass through untouched. Null texts
count as empty, null ids as the least id. Rows that repeat in full: the second stage keeps
one of them, all other stages treat each as a row of its own. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreline.llm.op3_minhash import NO_ID, row_classes
from acreline.llm.op8_suffix import remove_repeated_bytes
from acreline.llm.op9_toxicity import keep_clean, learn
from acreline.llm.op10_packing import pack_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose score stays under their language's threshold."""
    return keep_clean(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _by_position(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """docs with columns c0, c1, ...; those names, the id's and the text's."""
    marks = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*marks), marks, marks[docs.columns.index("doc_id")], marks[docs.columns.index("text")]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the least id. Rows are told apart by id and text.

    Of rows with the same id and text the one whose other columns hash least stays.
    """
    rows = row_classes(docs).withColumn("id", F.coalesce("doc_id", F.lit(NO_ID).cast("long")))
    heads = rows.groupBy("class").agg(F.min(F.struct("id", "key")).alias("head")).select(F.col("head.id").alias("__id"), F.col("head.key").alias("__key"))
    placed, marks, doc_id, text = _by_position(docs)
    row_id = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID).cast("long"))
    row_key = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    kept = placed.withColumns({"__id": row_id, "__key": row_key}).join(heads, ["__id", "__key"], "left_semi")
    if rows.groupBy("id", "key").count().filter("count > 1").limit(1).count():
        one = F.min_by(F.struct(*marks), F.xxhash64(*marks)).alias("row")
        kept = kept.groupBy("__id", "__key").agg(one).select("row.*")
    return kept.select(*marks).toDF(*docs.columns)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what else stands in the corpus; rows stay, also those left without text."""
    placed, marks, doc_id, text = _by_position(docs)
    rest = F.struct(*[m for m in marks if m != text])
    base = placed.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), rest.alias("rest"))
    cut = remove_repeated_bytes(base, keep_text=True, carry=F.col("rest"))
    new = {text: F.col("kept")} | ({marks[docs.columns.index("n_chars")]: F.char_length("kept").cast("long")} if "n_chars" in docs.columns else {})
    return cut.select(*[new.get(m, F.col(f"carry.{m}")).alias(m) for m in marks]).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
