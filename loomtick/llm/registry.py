"""The queries of this package, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtick.llm import bpe, decontam, lines, neardup, pii, quality, repeats, secrets, tokenfiles, warc

MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_links")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    ranks = p.path(MULTI_RANKS)
    return bpe.digests(bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, p.PATTERN), ranks, p.PATTERN)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return tokenfiles.token_files(_table(spark, sf_dir, "documents"), p.path(TOKENIZER), END_ID)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.col("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_suffix_array_dedup, op2_pii, op3_decontamination, op4_jaccard_join, op5_bpe, op6_warc, op7_token_files, op8_secrets, op9_quality, op10_line_dedup)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontam.ORACLE_SQL, "op4_jaccard_join": neardup.ORACLE_SQL, "op6_warc": warc.ORACLE_SQL, "op9_quality": quality.ORACLE_SQL, "op10_line_dedup": lines.ORACLE_SQL}
