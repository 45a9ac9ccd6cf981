"""Association matrices as semicolon-separated CSV: rows and columns are categories, in category order."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import paths as P

#: Tried in this order. Latin-1 takes any byte, so it is the last.
ENCODINGS = ("UTF-8", "ISO-8859-1")
MATRICES = ("npmi", "b1", "b2")


def pivot(matrix: DataFrame, value: str, categories: list[str]) -> DataFrame:
    """Wide form: cat_a and one column per category; at most MOST_CATEGORIES rows."""
    return matrix.groupBy("cat_a").pivot("cat_b", categories).agg(F.first(value)).orderBy("cat_a")


def _quoted(c: Column) -> Column:
    """A field as CSV has it, in quotes where it holds a separator, a quote or a line end."""
    return F.when(c.rlike('[;"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def write_csv(matrix: DataFrame, categories: list[str], folder: str | Path) -> list[str]:
    """npmi_matrix.csv, b1_matrix.csv and b2_matrix.csv on any file system; an undefined value is an empty field.

    A line is put together by the executors from the values of one category, at most one for each other; the lines,
    sorted, go through one writing task. Categories that the matrix lacks, and other ones, aren't written.
    """
    spark, out = matrix.sparkSession, []
    known = spark.createDataFrame([(c,) for c in categories], "cat string")
    rows = matrix.join(known.withColumnRenamed("cat", "cat_a"), "cat_a", "left_semi").join(known.withColumnRenamed("cat", "cat_b"), "cat_b", "left_semi")
    head = ";".join(["", *(f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in ';"\r\n') else c for c in categories)])
    for value in MATRICES:
        cells = F.array_sort(F.collect_list(F.struct("cat_b", F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v"))))
        lines = rows.groupBy("cat_a").agg(F.array_join(F.transform(cells, lambda x: x["v"]), ";").alias("v")).select(F.lit(1).alias("k"), "cat_a", F.concat(_quoted(F.col("cat_a")), F.lit(";"), "v").alias("line"))
        first = spark.createDataFrame([(0, "", head)], "k int, cat_a string, line string")
        target = P.join(folder, f"{value}_matrix.csv")
        first.unionByName(lines).orderBy("k", "cat_a").select("line").coalesce(1).write.mode("overwrite").text(f"{target}.parts")
        P.move_part(spark, f"{target}.parts", target)
        out.append(target)
    return out


def read_csv(spark: SparkSession, path: str | Path, value: str = "b1") -> DataFrame:
    """Long form (cat_a, cat_b, value). Cells that are no number are NULL. Utf-8 is tried first, else Latin-1."""
    if not P.exists(spark, path):
        raise FileNotFoundError(f"no matrix at {path}; build the store first")
    bad = spark.read.text(str(path)).where(~F.is_valid_utf8("value"))
    enc = ENCODINGS[0] if bad.isEmpty() else ENCODINGS[1]
    wide = spark.read.option("sep", ";").option("header", True).option("encoding", enc).option("nullValue", "").option("escape", '"').csv(str(path))
    first, rest = wide.columns[0], wide.columns[1:]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("cat_b"), F.expr(f"try_cast(`{c.replace('`', '``')}` as double)").alias(value)) for c in rest]))
    return wide.select(F.col(f"`{first}`").alias("cat_a"), rows.alias("x")).select("cat_a", "x.cat_b", f"x.{value}")


def categories_of(matrix: DataFrame) -> list[str]:
    """All categories of a stored matrix, in order."""
    return [r[0] for r in matrix.select("cat_a").distinct().orderBy("cat_a").collect()]
