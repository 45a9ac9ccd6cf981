"""Per-key results although a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import written


def range_split(df: DataFrame, key: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Range partitions on (key, order) at sampled quantiles: a heavy key spans as many partitions as it has rows for."""
    cols = [*key, *order]
    return df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)


def per_key(df: DataFrame, key: str, order: Sequence[str], aggs: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Aggregates per key over range_split(): each partition makes one partial state per key it holds, and the states of
    keys that cross a partition boundary are stitched by a second, tiny aggregation.

    ``order`` must tell rows of a heavy key apart, else they can't be split. aggs: decomposable aggregates by name. A
    NULL key is a group of its own; an empty table gives no rows. Only the columns used are shuffled.
    """
    return range_split(df, [key], order, partitions).groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])


def category_load(features: DataFrame) -> DataFrame:
    """(objektart, n_rows, sum_cells, max_cells) of every OBJEKTART, NULL included."""
    rows = features.select(F.col("OBJEKTART").alias("objektart"), F.col("h3_cell_count").alias("n"), "feature_id")
    return per_key(rows, "objektart", ["n", "feature_id"], {"n_rows": F.count("*"), "sum_cells": F.sum(F.col("n").cast("bigint")), "max_cells": F.max("n")})


def heavy(load: DataFrame, share: float = 0.05) -> DataFrame:
    """The keys, but for NULL, that hold at least ``share`` of all rows of a category_load, which is written once."""
    load = written(load)
    total = load.agg(F.sum("n_rows")).first()[0] or 0
    return load.where(F.col("objektart").isNotNull() & (F.col("n_rows") >= share * total))
