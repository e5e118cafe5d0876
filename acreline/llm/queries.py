"""The numbered queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from acreline.llm.op1_sentencepiece import encode_documents
from acreline.llm.op2_substring import remove_repeated_words
from acreline.llm.op3_minhash import near_duplicate_classes
from acreline.llm.op4_html import extract_pages
from acreline.llm.op5_ann import search
from acreline.llm.op6_winnowing import compare_with_next
from acreline.llm.op7_licenses import scan_documents
from acreline.llm.op8_suffix import remove_repeated_bytes
from acreline.llm.op9_toxicity import toxicity
from acreline.llm.op10_packing import pack_documents
from acreline.llm import op11_neardup as neardup
from acreline.llm import op12_fim as fim
from acreline.llm import op13_vectors as vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(_table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(_table(spark, sf_dir, "documents"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_table(spark, sf_dir, "documents"))


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_substring, op3_minhash, op4_html, op5_ann, op6_winnowing, op7_licenses, op8_suffix, op9_toxicity, op10_packing, op11_neardup, op12_fim, op13_vectors)}
#: Near duplicates compare all pairs in SQL: for small tables.
ORACLES: dict[str, str] = {"op11_neardup": neardup.SQL, "op12_fim": fim.SQL, "op13_vectors": vector_codes.SQL}
