"""Intermediate tables in the shared folder, and reading the input tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cuelight.session import shared_folder

#: name -> query(spark, sf_dir), and name -> DuckDB SQL where SQL can express the query
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    """Register a query of the tables in ``sf_dir``."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the folder that the cluster names for checkpoints, and read back: several readers compute it once,
    and a lost executor costs no more than its running tasks."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
