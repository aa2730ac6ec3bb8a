"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from marketframe.llm import bpe, collocations, decontamination, infilling, language, licenses, mixing, neighbours, pii, setjoin, sharding, tokenfile, toxicity
from marketframe.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": lambda spark, d: decontamination.digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op2_bpe": lambda spark, d: bpe.digest(table(spark, d, "documents")),
        "op3_pii": lambda spark, d: pii.digest(table(spark, d, "documents")),
        "op4_neighbours": lambda spark, d: neighbours.digest(table(spark, d, "embeddings")),
        "op5_jaccard_join": lambda spark, d: setjoin.digest(table(spark, d, "documents")),
        "op6_token_files": lambda spark, d: tokenfile.digest(table(spark, d, "documents")),
        "op7_sharding": lambda spark, d: sharding.digest(table(spark, d, "documents")),
        "op8_language": lambda spark, d: language.digest(table(spark, d, "documents")),
        "op9_licenses": lambda spark, d: licenses.digest(table(spark, d, "documents")),
        "op10_toxicity": lambda spark, d: toxicity.digest(table(spark, d, "documents"), table(spark, d, "labels")),
        "op11_mixing": lambda spark, d: mixing.digest(table(spark, d, "documents")),
        "op12_infilling": lambda spark, d: infilling.digest(table(spark, d, "documents")),
        "op13_collocations": lambda spark, d: collocations.digest(table(spark, d, "documents")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.ORACLE,
        "op5_jaccard_join": setjoin.ORACLE,
        "op12_infilling": infilling.ORACLE,
        "op13_collocations": collocations.ORACLE,
    }
