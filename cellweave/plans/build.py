"""The build: gazetteer tables to a store of features, cell index and association matrix."""

from __future__ import annotations

import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cellsystem import CellSystem
from ..config import BuildConfig
from ..operators.association import collect_categories, compute_all
from ..sources import gazetteer as G
from ..sources import matrix as M
from ..sources import paths as P
from ..sources import store as S

log = logging.getLogger(__name__)


def build(spark: SparkSession, cfg: BuildConfig, db: str | Path, output: str | Path | None = None, read: Callable[[str], DataFrame] | None = None, system: CellSystem | None = None) -> Path | str:
    """Reads ``gazetteer``, ``gaz_source`` and a table per source from ``db``, writes the store and returns its folder.

    ``read`` gives the DataFrame of a source by name; by default it is the Parquet file of that name in ``db``.
    Both folders may be addresses of any file system that Spark reaches.
    """
    db = P.clean(db)
    if not P.exists(spark, db):
        raise FileNotFoundError(f"no gazetteer at {db}")
    out = output or cfg.resolve_output_path(db)
    read = read or (lambda name: spark.read.parquet(f"{db}/{name}.parquet"))
    found = G.discover(spark.read.parquet(f"{db}/gaz_source.parquet"), spark.read.parquet(f"{db}/gazetteer.parquet"), cfg.gazetteer)
    sources = [(r[0], r[1]) for r in found.orderBy("name").collect()]
    raw = G.scan_all(sources, read)
    order = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(sources) for x in (n, i)])
    # Written once before ids are given: conversion is the costly part, and ids read it twice.
    G.convert(raw, cfg, system).write.mode("overwrite").parquet(f"{out}/converted")
    converted = spark.read.parquet(f"{out}/converted")
    for source, n, lost in G.dropped(raw, converted).where("n_dropped > 0").collect():  # a row a source
        log.warning("source %s: %d of %d geometries can't be read or cover no cell", source, lost, n)
    ids = G.dense_ids(converted, [F.element_at(order, F.col("source")), F.col("UUID"), F.col("NAME"), F.col("OBJEKTART"), F.col("h3_cells")])
    features = S.write_features(ids, out)
    S.write_lookup(features, out)
    compute_all(features, cfg.total_area_resolution).write.mode("overwrite").parquet(f"{out}/association")
    M.write_csv(spark.read.parquet(f"{out}/association"), collect_categories(features), out)
    return out if "://" in str(out) else Path(out)
