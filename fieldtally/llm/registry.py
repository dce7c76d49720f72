"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from fieldtally.llm import centroids, codes, decontaminate, language, licenses, personal, pieces, quality, shards, simhash, topk, urls, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_language": language.op2_language,
        "op3_vectors": vectors.op3_vectors,
        "op4_quality": quality.op4_quality,
        "op5_simhash": simhash.op5_simhash,
        "op6_pieces": pieces.op6_pieces,
        "op7_personal": personal.op7_personal,
        "op8_urls": urls.op8_urls,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_hilbert": shards.op10_hilbert,
        "op11_topk": topk.op11_topk,
        "op12_codes": codes.op12_codes,
        "op13_centroids": centroids.op13_centroids,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    statements = {
        "op3_vectors": vectors.OP3_SQL,
        "op8_urls": urls.OP8_SQL,
        "op9_decontaminate": decontaminate.OP9_SQL,
        "op10_hilbert": shards.OP10_SQL,
        "op11_topk": topk.OP11_SQL,
        "op12_codes": codes.OP12_SQL,
        "op13_centroids": centroids.OP13_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in statements.items() if sql}
