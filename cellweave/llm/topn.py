"""Top N rows of every group by secondary sort."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_rows(group: Sequence[str], n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the first n rows of every run of equal group values; all it remembers between batches is the last group and its count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            rows = b.num_rows
            if not rows:
                continue
            new = np.zeros(rows, bool)
            for g in group:
                c = b.column(b.schema.get_field_index(g))
                x, y = c.slice(1), c.slice(0, rows - 1)
                differ = pc.fill_null(pc.not_equal(x, y), True)
                differ = pc.and_not(differ, pc.and_(pc.is_null(x), pc.is_null(y)))
                new[1:] |= differ.to_numpy(zero_copy_only=False)
            key = tuple(b.column(b.schema.get_field_index(g))[0].as_py() for g in group)
            start = np.maximum.accumulate(np.where(new, np.arange(rows), 0))
            rank = np.arange(rows) - start
            if key == last:
                rank[start == 0] += seen
            last = tuple(b.column(b.schema.get_field_index(g))[rows - 1].as_py() for g in group)
            seen = int(rank[-1]) + 1
            keep = rank < n
            if keep.any():
                yield b.filter(pa.array(keep))

    return run


def top_n(df: DataFrame, group: Sequence[str], score: str, tie: str, n: int = 3) -> DataFrame:
    """The n rows of each group with the highest score, ties by the lowest ``tie``; fewer where a group has fewer.

    Every input partition is sorted and cut to n rows a group before anything is shuffled, so that a group with
    millions of rows sends n rows per partition; the rest is hash-partitioned by group, sorted and cut again. Sorting
    spills, batches stream, no group is buffered. Rows with NULL in score or tie are left out; NULL group values are
    groups of their own; repeated rows count as often as they occur. Other columns are carried along.
    """
    order = [*[F.col(f"`{g}`") for g in group], F.col(f"`{score}`").desc(), F.col(f"`{tie}`")]
    cut = first_rows(list(group), n)
    own = df.where(F.col(f"`{score}`").isNotNull() & F.col(f"`{tie}`").isNotNull())
    local = own.sortWithinPartitions(*order).mapInArrow(cut, df.schema)
    return local.repartition(*[F.col(f"`{g}`") for g in group]).sortWithinPartitions(*order).mapInArrow(cut, df.schema)
