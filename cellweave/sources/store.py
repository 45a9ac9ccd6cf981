"""The store: a folder of Parquet tables ``features``, ``features_by_uuid``, ``h3_lookup``, ``association`` and, once made, ``sentences``."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cellsets import lookup
from . import paths as P

TABLES = ("features", "features_by_uuid", "h3_lookup", "association")
SENTENCES = "feature_id bigint, sentence string"


def default_store(base: str | Path) -> str:
    """Where a store is when nothing names it: beside the gazetteer's tables."""
    return P.join(P.clean(base), "spatial_store")


def write_features(features: DataFrame, store: str | Path) -> DataFrame:
    """Writes and reads back, clustered by feature_id, with a second copy of the columns of a lookup by UUID; no rows is an error."""
    features.repartitionByRange("feature_id").sortWithinPartitions("feature_id").write.mode("overwrite").parquet(f"{store}/features")
    out = features.sparkSession.read.parquet(f"{store}/features")
    if out.isEmpty():
        raise ValueError("no features: is the gazetteer installed?")
    by = ["UUID", "feature_id"]
    out.where("UUID is not null").select(*by, "NAME", "OBJEKTART").repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{store}/features_by_uuid")
    return out


def write_lookup(features: DataFrame, store: str | Path) -> DataFrame:
    """The inverted cell index, clustered and sorted by cell, so that row group statistics prune a search by cell."""
    lookup(features).repartitionByRange("cell", "feature_id").sortWithinPartitions("cell", "feature_id").write.mode("overwrite").parquet(f"{store}/h3_lookup")
    return features.sparkSession.read.parquet(f"{store}/h3_lookup")


def open_store(spark: SparkSession, store: str | Path) -> dict[str, DataFrame]:
    """The tables by name; FileNotFoundError for a folder that isn't there."""
    if not P.exists(spark, store):
        raise FileNotFoundError(f"no store at {store}")
    return {t: spark.read.parquet(f"{store}/{t}") for t in TABLES if P.exists(spark, f"{store}/{t}")}


def register(tables: dict[str, DataFrame]) -> list[str]:
    """Temporary views by the tables' names, for SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return list(tables)


def unregister(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.catalog.dropTempView(name)


def read_sentences(spark: SparkSession, store: str | Path) -> DataFrame:
    """(feature_id, sentence) made before; empty where none was."""
    path = f"{store}/sentences"
    return spark.read.schema(SENTENCES).parquet(path).dropDuplicates(["feature_id"]) if P.exists(spark, path) else spark.createDataFrame([], SENTENCES)


def add_sentences(sentences: DataFrame, store: str | Path) -> None:
    sentences.select(F.col("feature_id").cast("bigint").alias("feature_id"), "sentence").write.mode("append").parquet(f"{store}/sentences")
