"""Reading a gazetteer: discovery of its sources, tolerant scans, geometry to cells."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cellsystem import CellSystem, ContainmentMode, PlanarGrid
from ..config import BuildConfig
from ..operators.stage import written

log = logging.getLogger(__name__)


def discover(source: DataFrame, gazetteer: DataFrame, name: str) -> DataFrame:
    """(name, location_id_name) of the sources of one gazetteer."""
    g = gazetteer.where(F.col("name") == name).select(F.col("id").alias("gazetteer_id"))
    return source.join(F.broadcast(g) if g.isLocal() else g, "gazetteer_id").select("name", "location_id_name")


def scan(df: DataFrame, id_col: str, source: str) -> DataFrame:
    """UUID as text, NAME, OBJEKTART, geometry, source; rows without geometry are dropped at the scan; missing columns are NULL."""
    def opt(c: str):
        return F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c)

    return df.where("geometry is not null").select(F.col(id_col).cast("string").alias("UUID"), opt("NAME").alias("NAME"), opt("OBJEKTART").alias("OBJEKTART"), "geometry", F.lit(source).alias("source"))


def scan_all(sources: list[tuple[str, str]], read: Callable[[str], DataFrame]) -> DataFrame:
    """Union of all sources that can be read; the others are logged and left out. An empty list is an error."""
    if not sources:
        raise ValueError("the gazetteer has no sources")
    out = []
    for name, id_col in sources:
        try:
            out.append(scan(read(name), id_col, name))
        except AnalysisException as e:
            log.warning("source %s can't be read: %s", name, e)
    if not out:
        raise ValueError("none of the sources can be read")
    return reduce(DataFrame.unionByName, out)


CONVERTED = "UUID string, NAME string, OBJEKTART string, source string, h3_cells array<bigint>, h3_resolution tinyint, h3_cell_count int"


def convert(raw: DataFrame, cfg: BuildConfig, system: CellSystem | None = None) -> DataFrame:
    """Geometry to cells, in Arrow batches. Rows whose geometry is NULL or can't be read are dropped, as are those that get no cell."""
    system, mode = system or PlanarGrid(), ContainmentMode(cfg.containment_mode)
    args = cfg.target_cells, cfg.min_resolution, cfg.max_resolution, mode
    names = ["UUID", "NAME", "OBJEKTART", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, rows = [], []
            for k, g in enumerate(b.column(4).to_pylist()):
                try:
                    got = system.cover(g, *args)
                except (ValueError, TypeError):
                    continue
                if got[0]:
                    keep.append(k)
                    rows.append(got)
            if keep:
                own = [c.take(pa.array(keep)) for c in b.columns[:4]]
                cells, res, n = pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.int8()), pa.array([len(r[0]) for r in rows], pa.int32())
                yield pa.RecordBatch.from_arrays([*own, cells, res, n], [*names, "h3_cells", "h3_resolution", "h3_cell_count"])

    return raw.where("geometry is not null").select(*names, "geometry").mapInArrow(run, CONVERTED)


def dropped(raw: DataFrame, converted: DataFrame) -> DataFrame:
    """(source, n_read, n_dropped): rows with a geometry, and how many of them convert() gave nothing for."""
    read = raw.where("geometry is not null").groupBy("source").agg(F.count("*").alias("n_read"))
    kept = converted.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
    return read.join(kept, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n_read", (F.col("n_read") - F.coalesce("n", F.lit(0))).alias("n_dropped"))


def dense_ids(df: DataFrame, order: list, name: str = "feature_id") -> DataFrame:
    """Ids 0..n-1 in the given order without one task for all rows: range partitions, a count of each, an offset.

    One count per partition reaches the driver. Full ties are told apart by nothing, so include a unique column where
    ids must be the same each time.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Written once: the sampled bounds of the ranges differ from job to job, and counts and rows must agree on them.
    part = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    ranked = part.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    counts, off, at = dict(part.groupBy("__part").count().collect()), {}, 0
    for p in sorted(counts):
        off[p], at = at, at + counts[p]
    if not off:
        return df.select(F.lit(None).cast("bigint").alias(name), *df.columns)
    base = F.element_at(F.create_map(*[F.lit(x) for kv in off.items() for x in kv]), F.col("__part"))
    return ranked.select((base + F.col("__row") - 1).cast("bigint").alias(name), *df.columns)
