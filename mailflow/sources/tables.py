"""Readers for stored tables.

Every reader selects an explicit column list so Catalyst prunes the parquet
scan, and every table keeps its documented schema. ``read_table`` is the one
entry point for a deployment whose tables are stored as parquet folders
(optionally partitioned by received date).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")

MODEL_SCHEMAS: dict[str, T.StructType] = {
    "emails": schemas.EMAILS,
    "anexos_email": schemas.ANEXOS_EMAIL,
    "anexos_conteudo": schemas.ANEXOS_CONTEUDO,
    "protocolos": schemas.PROTOCOLOS,
    "respostas": schemas.RESPOSTAS,
    "divergencias": schemas.DIVERGENCIAS,
    "validacoes": schemas.VALIDACOES,
    "controle_pipeline": schemas.CONTROLE_PIPELINE,
    "usuarios": schemas.USUARIOS,
}


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables (``{sf_dir}/{name}.parquet``)."""
    if name not in DRIVER_TABLES:
        raise ValueError(f"unknown driver table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored data-model table, read with its declared schema.

    Columns missing from the files come back as typed NULLs (schema
    evolution by ``mergeSchema`` is left to the caller's writer).
    """
    schema = MODEL_SCHEMAS[name]
    df = spark.read.schema(schema).parquet(path)
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: missing columns become typed NULLs."""
    have = set(df.columns)
    return df.select([
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType))
        .alias(f.name) for f in schema.fields])
