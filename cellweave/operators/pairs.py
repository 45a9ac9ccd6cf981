"""Joins whose result is far larger than both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import written

#: Pairs of a key in one piece of work; rows of the packed side in one array.
PIECE, BLOCK = 1_000_000, 2048


def pairs(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """many.join(few, key), made as the last step: no pair is shuffled or sorted, whatever follows must stream.

    Rows of ``few`` are packed into arrays. Where a key has more than PIECE pairs, its rows of ``many`` are dealt to
    pieces by hash and its arrays go to each; of pieces there are at most eight a partition, so that arrays aren't
    copied without bound. The partitions are stated, as AQE would merge them by their small input. NULL joins nothing.
    ``many`` and ``few`` are read several times: written() tables are best.
    """
    n = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many, few = (df.where(F.col(key).isNotNull()) for df in (many, few))
    size = many.groupBy(key).agg(F.count("*").alias("m")).join(few.groupBy(key).agg(F.count("*").alias("n")), key)
    size = size.select(key, F.least(F.lit(8 * n), F.ceil(F.col("m") * F.col("n") / PIECE)).cast("int").alias("__pieces"), F.ceil(F.col("n") / BLOCK).cast("int").alias("__blocks"))
    size = written(size.where("__pieces > 1 or __blocks > 1"))
    piece, block = (F.pmod(F.xxhash64(*df.columns), F.coalesce(c, F.lit(1))).cast("int") for df, c in ((many, "__pieces"), (few, "__blocks")))
    cols, rest = many.columns, [c for c in few.columns if c != key]
    dealt = many.join(size, key, "left").select(*cols, piece.alias("__piece"))
    packed = few.join(size, key, "left").groupBy(key, F.coalesce("__pieces", F.lit(1)).alias("p"), block.alias("b")).agg(F.collect_list(F.struct(*rest)).alias("__rows"))
    alone = len(rest) == 1  # values take less time than rows; by their field, as collect_list of values drops NULL
    packed = packed.select(key, F.col("__rows")[rest[0]].alias("__rows") if alone else "__rows", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("__piece"))
    on = [key, "__piece"]
    return dealt.repartition(n, *on).join(packed.repartition(n, *on), on).select(*cols, F.explode("__rows").alias(rest[0]) if alone else F.inline("__rows"))
