"""Items that appear together, by collapsing equal baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import written


def baskets(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(items, weight): distinct sorted item arrays and the number of baskets that have them. NULLs are left out.

    A basket is at most as long as the item vocabulary, whatever the rows it has: items are collected as a set, on
    the map side first.
    """
    own = rows.where(F.col(basket).isNotNull() & F.col(item).isNotNull())
    return own.groupBy(F.col(basket)).agg(F.array_sort(F.collect_set(item)).alias("items")).groupBy("items").agg(F.count("*").alias("weight"))


def pairs(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, n, lift, conviction), item_a < item_b by code points.

    n is the number of baskets. lift = n_ab * n / (n_a * n_b); conviction of a => b = (1 - n_b/n) / (1 - n_ab/n_a),
    NULL where b is in every basket of a. Pairs are enumerated once per distinct basket. An empty table gives no rows.
    """
    w = written(baskets(rows, basket, item))
    total = w.agg(F.sum("weight")).first()[0] or 0
    single = w.select(F.explode("items").alias("i"), "weight").groupBy("i").agg(F.sum("weight").alias("n"))
    # Each item takes those after it, a row at a time: the pairs of one distinct basket, never of a group of rows.
    at = w.select("items", "weight", F.posexplode("items").alias("i", "item_a"))
    one = at.select("item_a", F.explode(F.slice("items", F.col("i") + 2, F.greatest(F.size("items") - F.col("i") - 1, F.lit(0)))).alias("item_b"), "weight")
    p = one.groupBy("item_a", "item_b").agg(F.sum("weight").alias("n_ab"))
    for side in "ab":
        p = p.join(single.select(F.col("i").alias(f"item_{side}"), F.col("n").alias(f"n_{side}")), f"item_{side}")
    n = F.lit(total).cast("double")
    lift = F.col("n_ab") * n / (F.col("n_a").cast("double") * F.col("n_b"))
    sure = 1 - F.col("n_ab") / F.col("n_a").cast("double")
    return p.select("item_a", "item_b", "n_a", "n_b", "n_ab", F.lit(total).cast("bigint").alias("n"), lift.alias("lift"), ((1 - F.col("n_b") / n) / F.nullif(sure, F.lit(0.0))).alias("conviction"))
