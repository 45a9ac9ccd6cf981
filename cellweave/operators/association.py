"""Area-weighted association between categories: NPMI, B1 (context weight) and B2 (confidence weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cellsets as S
from .stage import written

#: Categories are a vocabulary, not data: the dense matrix is only made up to this many.
MOST_CATEGORIES = 3_000


def npmi(p_a: Column, p_b: Column, p_ab: Column) -> Column:
    """-1 without overlap, 0 where -log2(p_ab) is 0, else clamped to [-1, 1]. Divisors are guarded, as ANSI mode is on."""
    norm = -F.log2(p_ab)
    score = F.log2(p_ab / F.nullif(p_a * p_b, F.lit(0.0))) / F.nullif(norm, F.lit(0.0))
    return F.when(p_ab <= 1e-15, F.lit(-1.0)).when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)))


def category_list(features: DataFrame, col: str = "OBJEKTART") -> DataFrame:
    """Distinct categories in code point order; NULL is no category."""
    return features.where(F.col(col).isNotNull()).select(F.col(col).alias("category")).distinct().orderBy("category")


def collect_categories(features: DataFrame, col: str = "OBJEKTART") -> list[str]:
    found = [r[0] for r in category_list(features, col).limit(MOST_CATEGORIES + 1).collect()]
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories: a dense matrix isn't meant for this")
    return found


def category_cover(features: DataFrame, col: str = "OBJEKTART", cells: str = "h3_cells") -> DataFrame:
    """(category, cell): the distinct cells of all features of each category."""
    return features.where(F.col(col).isNotNull()).select(F.col(col).alias("category"), F.explode(F.array_distinct(cells)).alias("cell")).where("cell is not null").distinct()


def dense_pairs(spark: SparkSession, categories: list[str]) -> DataFrame:
    one = spark.createDataFrame([(c,) for c in categories], "cat_a string")
    return one.select("cat_a", F.explode(F.array(*[F.lit(c) for c in categories]) if categories else F.array().cast("array<string>")).alias("cat_b"))


def scores(areas: DataFrame, pairs: DataFrame, total_m2: int, categories: list[str]) -> DataFrame:
    """Long form (cat_a, cat_b, npmi, b1, b2), all n*n pairs.

    areas: (category, area_m2); pairs: (key_a, key_b, shared_m2). Total area 0 is an error. B1 of two categories
    without area is NULL. Both tables have at most one row per (pair of) categories, of which there are at most
    MOST_CATEGORIES, so areas are broadcast.
    """
    if not total_m2:
        raise ValueError("the total area is 0: there are no cells")
    p = areas.select("category", (F.col("area_m2") / F.lit(total_m2)).alias("p"))
    d = dense_pairs(areas.sparkSession, categories).join(pairs.select(F.col("key_a").alias("cat_a"), F.col("key_b").alias("cat_b"), "shared_m2"), ["cat_a", "cat_b"], "left")
    for side in "ab":
        d = d.join(F.broadcast(p.select(F.col("category").alias(f"cat_{side}"), F.col("p").alias(f"p_{side}"))), f"cat_{side}", "left")
    zero = F.lit(0.0)
    d = d.withColumns({"p_a": F.coalesce("p_a", zero), "p_b": F.coalesce("p_b", zero)})
    d = d.withColumn("p_ab", F.when(F.col("cat_a") == F.col("cat_b"), F.col("p_a")).otherwise(F.coalesce("shared_m2", F.lit(0)) / F.lit(total_m2)))
    d = d.withColumn("npmi", npmi(F.col("p_a"), F.col("p_b"), F.col("p_ab")))
    same, both = F.col("cat_a") == F.col("cat_b"), F.col("p_a") + F.col("p_b")
    b1 = F.when(same, F.col("npmi") * 0.5).when(both > 0, F.col("npmi") * F.col("p_b") / F.nullif(both, zero))
    b2 = F.when(same, F.col("npmi")).when(F.col("p_a") > 0, F.col("npmi") * F.col("p_ab") / F.nullif(F.col("p_a"), zero)).otherwise(zero)
    return d.select("cat_a", "cat_b", "npmi", b1.alias("b1"), b2.alias("b2"))


def compute_all(features: DataFrame, total_area_resolution: int = 10, col: str = "OBJEKTART", cells: str = "h3_cells") -> DataFrame:
    """The whole association matrix of a features table, in long form.

    Total area is that of all cells of features with or without category. Only a list of categories and one number
    reach the driver.
    """
    own = features.select(F.explode(F.array_distinct(cells)).alias("cell")).where("cell is not null").distinct()
    levels = S.levels_in(features, cells)
    total = S.total_area(own, total_area_resolution, levels=levels).first()[0]
    cover = written(S.canonical(category_cover(features, col, cells), ["category"], levels))
    return scores(S.area(cover, ["category"]), S.pair_area(cover, "category", levels), total, collect_categories(features, col))


def associated(matrix: DataFrame, threshold: float = 0.001, max_categories: int = 10) -> DataFrame:
    """(cat_a, cat_b, b1, assoc_rank): per category the strongest others, ties in category order; undefined B1 never passes."""
    ok = matrix.where((F.col("b1") >= threshold) & ~F.isnan("b1") & (F.col("cat_a") != F.col("cat_b")))
    w = Window.partitionBy("cat_a").orderBy(F.desc("b1"), "cat_b")
    return ok.select("cat_a", "cat_b", "b1", F.row_number().over(w).alias("assoc_rank")).where(F.col("assoc_rank") <= max_categories)


def without_static(assoc: DataFrame, static: list[str]) -> DataFrame:
    """Drops static categories AFTER the cut to max_categories; their ranks stay empty."""
    return assoc.where(~F.col("cat_b").isin(list(static))) if static else assoc


def proportional_slots(assoc: DataFrame, max_slots: int = 10, max_per_category: int = 5) -> DataFrame:
    """(cat_a, cat_b, slots): max_slots shared out by B1, rounded half to even; nothing where the weights sum to 0 or less."""
    total = F.sum("b1").over(Window.partitionBy("cat_a"))
    share = F.col("b1") / F.nullif(F.col("total"), F.lit(0.0)) * max_slots
    return assoc.withColumn("total", total).where("total > 0").select("cat_a", "cat_b", F.least(F.lit(max_per_category), F.greatest(F.lit(0), F.bround(share, 0).cast("int"))).alias("slots"))
