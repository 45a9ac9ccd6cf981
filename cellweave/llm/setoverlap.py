"""Sizes of the overlaps between many sets by one merge of all of them."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import written

#: Rows a range of identifiers has, as far as sampled quantiles tell: what one merge holds, 8 bytes each.
ROWS = 2_000_000
SCHEMA = "set_a string, set_b string, n bigint"


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of identifiers: sorted runs of all sets are merged by a heap; at each identifier every co-present pair counts, a set with itself for its size."""
    names: list[str] = []
    runs: list[list] = []
    for b in batches:
        for s, ids in _runs(b):
            if not names or names[-1] != s:
                names.append(s)
                runs.append([])
            runs[-1].append(ids)
    streams = [zip((x for part in parts for x in part.tolist()), repeat(k)) for k, parts in enumerate(runs)]
    together: Counter = Counter()
    at, here = None, []
    for i, k in heapq.merge(*streams):
        if i != at:
            if here:
                together[tuple(here)] += 1
            at, here = i, [k]
        elif here[-1] != k:
            here.append(k)
    if here:
        together[tuple(here)] += 1
    # Identifiers with the same co-present sets were counted together, so pairs are enumerated once per combination.
    n: Counter = Counter()
    for sets, c in together.items():
        for x, a in enumerate(sets):
            for b in sets[x:]:
                n[a, b] += c
    if n:
        yield pa.RecordBatch.from_pydict({"set_a": [names[a] for a, _ in n], "set_b": [names[b] for _, b in n], "n": pa.array(n.values(), pa.int64())})


def _runs(b: pa.RecordBatch):
    s = b.column(0).dictionary_encode()
    codes, ids = s.indices.to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
    if not len(codes):
        return
    cuts = [0, *((codes[1:] != codes[:-1]).nonzero()[0] + 1).tolist(), len(codes)]
    for x, y in zip(cuts[:-1], cuts[1:]):
        yield s.dictionary[int(codes[x])].as_py(), ids[x:y]


def overlaps(df: DataFrame, key: str, array: str) -> DataFrame:
    """(set_a, set_b, n_a, n_b, n_shared, error_bound), set_a < set_b by code points, pairs that share something.

    Members are made distinct per set first, so that an identifier held by millions of rows of a set is one row; then
    they are range-partitioned by identifier, as many ranges as the rows ask for, and each is merged on its own. Counts are exact, so the error
    bound is 0. What leaves a range is bounded by the pairs of sets. NULL keys, arrays and members are left out.
    """
    flat = df.where(F.col(key).isNotNull()).select(F.col(key).alias("s"), F.explode(F.array_distinct(array)).alias("id")).where("id is not null").distinct()
    flat = written(flat)
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-flat.count() // ROWS))
    parts = flat.repartitionByRange(ranges, "id").sortWithinPartitions("s", "id").mapInArrow(_count_pairs, SCHEMA)
    n = written(parts.groupBy("set_a", "set_b").agg(F.sum("n").alias("n")))
    size = n.where("set_a = set_b")
    out = n.where("set_a <> set_b").select(F.least("set_a", "set_b").alias("set_a"), F.greatest("set_a", "set_b").alias("set_b"), F.col("n").alias("n_shared"))
    for side in "ab":
        out = out.join(size.select(F.col("set_a").alias(f"set_{side}"), F.col("n").alias(f"n_{side}")), f"set_{side}")
    return out.select("set_a", "set_b", "n_a", "n_b", "n_shared", F.lit(0).cast("bigint").alias("error_bound"))
