"""Readers for the five raw tables as files (CSV with header, or parquet)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerline.schemas import SOURCE_NAMES, source_schemas


@dataclass(frozen=True)
class Sources:
    """The five raw tables every model starts from."""

    billing_accounts: DataFrame
    app_accounts: DataFrame
    app_users: DataFrame
    app_usage_daily: DataFrame
    arr_daily: DataFrame


def read_csv_sources(
    spark: SparkSession, directory: str, id_type: T.DataType = T.StringType(), mode: str = "FAILFAST"
) -> Sources:
    """``{directory}/{name}.csv`` (or a folder of part files) with fixed schemas.

    ``escape='"'`` reads doubled quotes inside quoted fields (``"[""pro""]"``);
    FAILFAST makes a malformed row an error instead of a silent NULL row.
    """
    schemas = source_schemas(id_type)
    frames = {
        name: spark.read.schema(schemas[name])
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", mode)
        .option("dateFormat", "yyyy-MM-dd")
        .csv(f"{directory.rstrip('/')}/{name}.csv")
        for name in SOURCE_NAMES
    }
    return Sources(**frames)


def read_parquet_sources(spark: SparkSession, directory: str, id_type: T.DataType = T.StringType()) -> Sources:
    """``{directory}/{name}`` parquet tables (for example written by the streaming ingest)
    with fixed schemas; files whose columns have other types are an error."""
    schemas = source_schemas(id_type)
    frames = {}
    for name in SOURCE_NAMES:
        path = f"{directory.rstrip('/')}/{name}"
        found = {f.name: f.dataType for f in spark.read.parquet(path).schema}
        wrong = [f.name for f in schemas[name] if found.get(f.name) != f.dataType]
        if wrong:
            raise ValueError(f"{path}: missing or differently typed columns: {', '.join(wrong)}")
        frames[name] = spark.read.schema(schemas[name]).parquet(path)
    return Sources(**frames)
