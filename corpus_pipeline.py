"""A corpus from documents to tokens, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.llm import decontam, langid_mix, secrets, sentencepiece_bpe, simhash
from augur.llm.common import crc_mod
from augur.sources.shared import new_path, own_tables, remove, written


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells its rows apart: doc_id, or where ids
    repeat or are null a number given to each row of a written copy."""
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        return docs, "doc_id"
    row = secrets.fresh("_row", docs.columns)
    return written(docs.withColumn(row, F.monotonically_increasing_id())), row


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts among them) and those that no
    learned language explains better than an even spread of trigrams would. Rows are judged
    by themselves; nulls in ``lang`` and rows under a null id teach as the operator says."""
    model = langid_mix.fit(docs.where(crc_mod("doc_id", 3) != 1))
    return langid_mix.keep_known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of linked fingerprints, that with the smallest id; where
    ids repeat or are null, the first row. Null and empty texts are one group with others of
    fingerprint zero; an empty table stays empty; further columns are carried."""
    keyed, key = with_key(docs)
    heads = simhash.near_groups(keyed, doc_id=key).where("doc_id = component_id").select(F.col("doc_id").alias(key))
    return keyed.join(heads, key, "left_semi").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with a benchmark item, all rows of equal text alike. Null and
    empty texts have no overlap and stay; long ones are read whole; rows with
    repeated or null ids are told apart, and further columns are carried."""
    keyed, key = with_key(docs)
    hit = decontam.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=key)
    return keyed.join(hit.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; all documents stay, and texts without secrets,
    nulls included, stay as they are. ``n_chars`` follows the text where it changed."""
    found = secrets.fresh("_secrets", docs.columns)
    out = secrets.redact(secrets.scan(docs, out=found), spans=found)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; null and empty texts have no
    ids; rows are encoded by themselves, repeated ones again; further columns are dropped."""
    return sentencepiece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language identification", language),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scan", secret_removal),
    ("tokens", tokens),
]

#: Language models and tokens cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = new_path(spark, "pipeline")
        # What the stage made is no longer needed once its result is written.
        with own_tables(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
