"""Registered queries of the subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (embed_dedup, langid, lattice_lm, minhash, mixing, pii, quality, ranked_search, recompression,
               sentencepiece_bpe, suffix_dedup, token_files, vector_codes)


def _over(tables: str, fn: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(*[spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables.split()])
    run.__name__ = fn.__name__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": _over("documents", langid.op1),
    "op2_lattice_lm": _over("documents", lattice_lm.op2),
    "op3_minhash": _over("documents", minhash.op3),
    "op4_sentencepiece": _over("documents", sentencepiece_bpe.op4),
    "op5_suffix_dedup": _over("documents", suffix_dedup.op5),
    "op6_embedding_dedup": _over("embeddings", embed_dedup.op6),
    "op7_mixing": _over("documents", mixing.op7),
    "op8_pii": _over("documents", pii.op8),
    "op9_recompression": _over("documents", recompression.op9),
    "op10_quality": _over("documents", quality.op10),
    "op11_token_files": _over("documents", token_files.op11),
    "op12_ranked_search": _over("documents benchmark", ranked_search.op12),
    "op13_vector_codes": _over("embeddings", vector_codes.op13),
}

SQL: dict[str, str] = {
    "op3_minhash": minhash.SQL,
    "op5_suffix_dedup": suffix_dedup.SQL,
    "op6_embedding_dedup": embed_dedup.SQL,
    "op7_mixing": mixing.SQL,
    "op9_recompression": recompression.SQL,
    "op12_ranked_search": ranked_search.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
