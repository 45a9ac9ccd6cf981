"""Points near other points, and points inside regions, by adaptive coverage.

The area searched (a disc, a region) is covered by cells. A cell that lies wholly inside it accepts all its points by
the equality join alone; only matches in cells on the boundary get the exact test.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cellsystem import PlanarGrid
from ..functions import cells as C
from . import cellsets as S
from .stage import written


#: Sites in a bucket from which it is split into four, and points of a region that are tested in one run; neither changes a result.
CROWD, RUN = 64, 100_000


def near(points: DataFrame, radius: float, id_col: str = "id", split: int = 2, crowd: int = CROWD) -> DataFrame:
    """(id_a, id_b), id_a < id_b: points at most ``radius`` apart. points: (id, x, y); NULL coordinates match nothing.

    Points at one place are one site: what is searched are pairs of sites, and only pairs that belong to the result are
    made of their members. Rows with the same id are one point each but never form a pair with themselves.
    """
    p = points.where("x is not null and y is not null").select(F.col(id_col).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = written(p.distinct())
    sites = written(near_sites(p.select("x", "y").distinct(), radius, split, crowd))
    a = p.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    apart = sites.join(a, ["ax", "ay"]).join(b, ["bx", "by"]).where("a <> b")
    same = a.join(b, (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))).where("a < b")
    return apart.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).unionByName(same.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")))


def near_sites(sites: DataFrame, radius: float, split: int, crowd: int) -> DataFrame:
    """(ax, ay, bx, by): each pair of different places (x, y) at most ``radius`` apart once.

    A disc is covered by buckets of the side radius / split, the half of it that lies in the place's own bucket or in
    one that follows in (column, row) order, so a pair is found once. A bucket that lies wholly inside accepts all its
    places. Of the others, a crowded one is split into its quarters, which are inside, outside or on the edge in turn;
    places in a bucket or quarter on the edge are tested.
    """
    s = radius / split
    p = sites.withColumns({"i": F.floor(F.col("x") / s), "j": F.floor(F.col("y") / s)})
    around = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j")) for i in range(split + 1) for j in range(-split - 1, split + 2) if (i, j) >= (0, 0)])

    def gaps(i, j, side):
        """Squares of the least and the largest distance from the place to the bucket."""
        near2 = far2 = F.lit(0.0)
        for k, c in ((i, "x"), (j, "y")):
            lo = k * side - F.col(c)
            d, e = F.greatest(lo, -lo - side, F.lit(0.0)), F.greatest(F.abs(lo), F.abs(lo + side))
            near2, far2 = near2 + d * d, far2 + e * e
        return near2, far2

    r2 = radius * radius
    crowded = written(p.groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("i", "j", F.lit(True).alias("full")))
    cover = F.filter(F.transform(around, lambda o: F.struct((F.col("i") + o["i"]).alias("i"), (F.col("j") + o["j"]).alias("j"), ((o["i"] == 0) & (o["j"] == 0)).alias("own"))), lambda o: gaps(o["i"], o["j"], s)[0] <= r2)
    a = p.select("x", "y", F.explode(cover).alias("c")).select("x", "y", "c.*").withColumn("inside", gaps(F.col("i"), F.col("j"), s)[1] <= r2)
    a = a.join(crowded, ["i", "j"], "left").withColumn("quarter", F.coalesce("full", F.lit(False)) & ~F.col("inside")).drop("full")
    quarters = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j")) for i in (0, 1) for j in (0, 1)])
    fine = a.where("quarter").select("x", "y", "own", F.explode(F.transform(quarters, lambda o: F.struct((F.col("i") * 2 + o["i"]).alias("i"), (F.col("j") * 2 + o["j"]).alias("j")))).alias("q")).select("x", "y", "own", "q.i", "q.j")
    fine = fine.withColumn("near2", gaps(F.col("i"), F.col("j"), s / 2)[0]).where(F.col("near2") <= r2).withColumn("inside", gaps(F.col("i"), F.col("j"), s / 2)[1] <= r2)
    cols = ["x", "y", "own", "inside", "i", "j", "level"]
    a = a.where("not quarter").withColumn("level", F.lit(0)).select(*cols).unionByName(fine.withColumn("level", F.lit(1)).select(*cols))
    b = p.select(F.col("x").alias("x2"), F.col("y").alias("y2"), "i", "j", F.lit(0).alias("level"))
    # A quarter is found by its bucket's number, doubled, and the half of the bucket the place is in.
    half = [(F.col(k) * 2 + (F.col(c) >= F.col(k) * s + s / 2).cast("bigint")).alias(k) for k, c in (("i", "x"), ("j", "y"))]
    b = b.unionByName(p.join(crowded, ["i", "j"], "left_semi").select(F.col("x").alias("x2"), F.col("y").alias("y2"), *half, F.lit(1).alias("level")))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    after = (F.col("x") < F.col("x2")) | (F.col("x") == F.col("x2")) & (F.col("y") < F.col("y2"))
    j = a.join(b, ["i", "j", "level"]).where(~F.col("own") | after).where(F.col("inside") | (dx * dx + dy * dy <= r2))
    return j.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"))


def inside(points: DataFrame, coverage: DataFrame) -> DataFrame:
    """(id, region_id, interior): points (id, cell) in regions (region_id, cell, interior), by equality on the cell or an ancestor."""
    levels = S.levels_of(coverage)
    p = points.select("id", F.explode(C.ancestors("cell", levels)).alias("cell"))
    return p.join(coverage.where("cell is not null"), "cell").select("id", "region_id", "interior")


def coverage(polygons: DataFrame, min_resolution: int = 5, max_resolution: int = 11) -> DataFrame:
    """(region_id, cell, interior) of polygons (region_id, wkb). Shapes that can't be read, and lines and points, cover nothing."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions.geometry import read_wkb

        grid = PlanarGrid()
        for b in batches:
            for i, w in zip(b["region_id"], b["wkb"]):
                try:
                    if not read_wkb(bytes(w)).polygons:
                        continue
                    got = grid.adaptive(bytes(w), min_resolution, max_resolution)
                except (ValueError, TypeError):
                    continue
                yield pd.DataFrame({"region_id": i, "cell": [c for c, _ in got], "interior": [k for _, k in got]})

    # Dealt out by number of tasks, as a polygon's bytes say little about its work.
    tasks = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return polygons.where("wkb is not null").select("region_id", "wkb").repartition(tasks, "region_id").mapInPandas(run, "region_id bigint, cell bigint, interior boolean")


def inside_polygons(points: DataFrame, polygons: DataFrame, max_resolution: int = 11, run: int = RUN) -> DataFrame:
    """(id, region_id): points (id, x, y) in polygons (region_id, wkb), region_id unique.

    Points at one place are tested once. Matches in boundary cells alone are tested exactly: places are brought to
    their polygon, in runs of about ``run``, so a polygon is moved and read once a run and no region is a task of its own.
    """
    p = written(points.where("x is not null and y is not null").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct())
    places = written(p.select("x", "y").distinct().withColumn("cell", C.at(F.col("x"), F.col("y"), 13)).where("cell is not null"))
    cover = written(coverage(polygons, max_resolution=max_resolution))
    # Which cells of the cover lie on a place is found once per finest cell.
    hit = inside(places.select(F.col("cell").alias("id"), "cell").distinct(), cover).withColumnRenamed("id", "cell")
    at = written(hit.join(places, "cell").select("region_id", "interior", "x", "y"))
    sure = at.where("interior").select("x", "y", "region_id")
    edge = at.where("not interior")
    runs = edge.groupBy("region_id").agg(F.ceil(F.count("*") / F.lit(run)).cast("int").alias("runs"))
    none = F.lit(None).cast("binary")
    rows = edge.join(runs, "region_id").select("region_id", F.pmod(F.xxhash64("x", "y"), F.col("runs")).cast("int").alias("run"), "x", "y", none.alias("wkb"))
    shapes = polygons.join(runs, "region_id").select("region_id", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), "wkb")
    moved = shapes.unionByName(rows).repartition("region_id", "run").sortWithinPartitions("region_id", "run", F.col("wkb").isNull())

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.geometry import read_wkb

        shape, at = None, None
        for b in batches:
            region, n = b.column(0).to_numpy(zero_copy_only=False), b.num_rows
            x, y = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            is_shape = b.column(4).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(is_shape | np.concatenate([[True], (region[1:] != region[:-1])]))
            keep = np.zeros(n, bool)
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), n]):
                if is_shape[lo]:
                    shape, at, lo = read_wkb(b.column(4)[lo].as_py()), region[lo], lo + 1
                if lo < hi and shape is not None and at == region[lo]:
                    keep[lo:hi] = shape.contains(x[lo:hi], y[lo:hi])
            k = np.flatnonzero(keep)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(x[k]), pa.array(y[k]), pa.array(region[k], pa.int64())], ["x", "y", "region_id"])

    found = sure.unionByName(moved.select("region_id", "run", "x", "y", "wkb").mapInArrow(test, "x double, y double, region_id bigint")).distinct()
    return found.join(p, ["x", "y"]).select("id", "region_id")


def locations(features: DataFrame) -> DataFrame:
    """(feature_id, cell) of the features that have exactly one distinct cell, of resolution 13. NULL cells don't count."""
    one = F.array_compact(F.array_distinct("h3_cells"))
    return features.where(F.size(one) == 1).select("feature_id", F.try_element_at(one, F.lit(1)).alias("cell")).where(C.resolution("cell") == 13)


def near_or_inside(features: DataFrame, radius: float = 100.0, region: str = "Gemeindegebiet") -> DataFrame:
    """(relation, feature_id_a, feature_id_b): locations near each other, and locations inside regions given as cells.

    A region's cells are all interior, so no exact test is left for 'inside'. An empty table gives no rows.
    """
    at = written(locations(features))
    x, y = C.grid_xy("cell")
    pairs = near(at.select(F.col("feature_id").alias("id"), ((x + 0.5) * 32).alias("x"), ((y + 0.5) * 32).alias("y")), radius)
    regions = features.where(F.col("OBJEKTART") == region).select(F.col("feature_id").alias("region_id"), F.explode(F.array_distinct("h3_cells")).alias("cell"), F.lit(True).alias("interior"))
    # Regions are found once per cell, then for all that stand in it.
    hit = inside(at.select(F.col("cell").alias("id"), "cell").distinct(), regions).select(F.col("id").alias("cell"), "region_id").distinct()
    held = hit.join(at.withColumnRenamed("feature_id", "id"), "cell").where("id <> region_id").select("id", "region_id")
    return pairs.select(F.lit("near").alias("relation"), F.col("id_a").alias("feature_id_a"), F.col("id_b").alias("feature_id_b")).unionByName(
        held.select(F.lit("inside").alias("relation"), F.least("id", "region_id").alias("feature_id_a"), F.greatest("id", "region_id").alias("feature_id_b"))
    )
