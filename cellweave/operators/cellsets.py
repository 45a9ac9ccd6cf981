"""Set algebra over cells of mixed resolution, one set per key. A set never leaves the executors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C


def levels_of(df: DataFrame, cell: str = "cell") -> list[int]:
    """The resolutions that occur: at most 16 values, so the ancestor lists below stay as short as the data allow."""
    return sorted(r[0] for r in df.select(C.resolution(cell).alias("r")).where("r is not null").distinct().collect())


def levels_in(features: DataFrame, cells: str = "h3_cells") -> list[int]:
    """levels_of the cells of a features table: by its column h3_resolution where there is one, without reading cells."""
    if "h3_resolution" in features.columns:
        return sorted(r[0] for r in features.where("h3_resolution is not null").select(F.col("h3_resolution").cast("int")).distinct().collect())
    return levels_of(features.select(F.explode(cells).alias("cell")))


def lookup(features: DataFrame, id_col: str = "feature_id", cells: str = "h3_cells", keep: Sequence[str] = ()) -> DataFrame:
    """Inverted index: distinct (feature_id, cell, cell_res). NULL and empty lists and NULL cells give no row.

    Repeated cells are removed inside the row, before the shuffle; ``keep`` carries further columns along.
    """
    one = features.select(id_col, *keep, F.explode(F.array_distinct(cells)).alias("cell")).where("cell is not null")
    return one.select(F.col(id_col).alias("feature_id"), *keep, "cell", C.resolution("cell").cast("tinyint").alias("cell_res")).dropDuplicates(["feature_id", "cell"])


def canonical(df: DataFrame, key: Sequence[str] = (), levels: Iterable[int] | None = None) -> DataFrame:
    """Distinct (key, cell) without cells that have an ancestor in the same set. NULL cells are dropped."""
    key = list(key)
    own = df.where("cell is not null").select(*key, "cell").distinct()
    levels = levels_of(own) if levels is None else levels
    up = own.select(*key, F.col("cell").alias("fine"), F.explode(C.ancestors("cell", levels, proper=True)).alias("cell"))
    held = up.join(own, [*key, "cell"], "left_semi").select(*key, F.col("fine").alias("cell")).distinct()
    return own.join(held, [*key, "cell"], "left_anti")


def area(cover: DataFrame, key: Sequence[str] = (), name: str = "area_m2") -> DataFrame:
    """Sum of the areas of a canonical cover, exact in BIGINT; 0 for an empty one without key."""
    return cover.groupBy(*key).agg(F.coalesce(F.sum(C.area_m2("cell")), F.lit(0).cast("bigint")).alias(name))


def total_area(cells: DataFrame, res: int = 10, name: str = "total_m2", levels: Iterable[int] | None = None) -> DataFrame:
    """Area of all cells together, cells finer than ``res`` taken as their ancestor there. levels: the resolutions that occur, if known."""
    levels = None if levels is None else {min(r, res) for r in levels}
    return area(canonical(cells.where("cell is not null").select(C.coarsen("cell", res).alias("cell")), levels=levels), name=name)


def matches(cover: DataFrame, key: str, levels: Iterable[int] | None = None) -> DataFrame:
    """(fine_key, coarse_key, cell, strict): every cell of a set that equals, or lies strictly inside, a cell of a set."""
    levels = levels_of(cover) if levels is None else levels
    fine = cover.select(F.col(key).alias("fine_key"), "cell", F.explode(C.ancestors("cell", levels)).alias("at"))
    coarse = cover.select(F.col(key).alias("coarse_key"), F.col("cell").alias("at"))
    return fine.join(coarse, "at").select("fine_key", "coarse_key", "cell", (F.col("cell") != F.col("at")).alias("strict"))


def pair_area(cover: DataFrame, key: str, levels: Iterable[int] | None = None) -> DataFrame:
    """(key_a, key_b, shared_m2) for ordered pairs of different keys of a canonical cover that share any area.

    One self-join on equal or ancestor cell serves all pairs. Areas are summed on the map side, so what is shuffled
    after the join is bounded by the pairs of keys, whatever the cells.
    """
    m = matches(cover, key, levels).where("fine_key <> coarse_key").select("fine_key", "coarse_key", "strict", C.area_m2("cell").alias("m2"))
    g = m.groupBy("fine_key", "coarse_key", "strict").agg(F.sum("m2").alias("m2"))
    both = g.select(F.col("fine_key").alias("key_a"), F.col("coarse_key").alias("key_b"), "m2").unionByName(g.where("strict").select(F.col("coarse_key").alias("key_a"), F.col("fine_key").alias("key_b"), "m2"))
    return both.groupBy("key_a", "key_b").agg(F.sum("m2").alias("shared_m2"))
