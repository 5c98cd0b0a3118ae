"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, html, langid, lm, minhash, mixing, quality, sharding, suffix_array

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _over_documents(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_array": _over_documents(suffix_array.digests),
        "op3_langid": _over_documents(langid.identify),
        "op4_html": lambda spark, sf_dir: html.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")),
        "op5_lm": _over_documents(lm.score),
        "op7_minhash": _over_documents(minhash.near_dedup),
        "op8_bpe": _over_documents(lambda d: bpe.encode_digests(d, WORD_BPE)),
        "op2_mixing": _over_documents(lambda d: mixing.mix(d).drop("source")),
        "op6_quality": _over_documents(quality.quality_report),
        "op9_sharding": _over_documents(sharding.assign),
        "op10_exact_dedup": _over_documents(exact_dedup.exact_dedup),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_quality": quality.ORACLE, "op7_minhash": minhash.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE}
