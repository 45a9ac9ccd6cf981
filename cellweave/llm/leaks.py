"""Passages of evaluation items inside a corpus, by a prefix-filtered join of word shingles.

A passage leaks where a run of ``run`` words of an item stands in a row in a document. Every such run holds all
run - 4 of its five-word shingles, so one of them is a sufficient prefix: the rarest in the corpus is joined. A match
puts the item beside the document at one place; only the window of the item's size there is fetched, if by place and
length a run fits into it, and compared word by word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stage import written
from .mail import text_parts

SHINGLE, RUN = 5, 12
WORD = re.compile(r"[^\W_]+")
#: Bits of the filter that goes to the executors: PER_SHINGLE for each distinct shingle of the items, 2 ** MOST_BITS (32 MB) at most. Where that is too few, more shingles pass it that are no item's; the join drops them.
PER_SHINGLE, MOST_BITS, SHIFTS = 32, 28, (0, 18, 36)
_ODD = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 400_000:
            self.clear()
        v = self[w] = xxhash.xxh64_intdigest(w)
        return v


_hash = _Hashes()


def words(text: str) -> list[str]:
    t = text.lower()
    return WORD.findall(t if t.isascii() else unicodedata.normalize("NFC", t))


def shingles(ws: list[str]) -> np.ndarray:
    """Hash of the five words from each position on."""
    n = len(ws) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash.__getitem__, ws), np.uint64, len(ws))
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out += h[i : i + n] * _ODD[i]
    out ^= out >> np.uint64(29)
    return out


SCHEMA = "id bigint, part int, pos int, h bigint"


def _scan(read: Callable[[str | None], list[str]], filt=None):
    """Rows (id, part, pos, h) of the shingles of all parts of a text; with a filter, of those that pass it."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if filt is None else filt.value
        for b in batches:
            cols: list[list] = [[], [], [], []]
            size = 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                for k, part in enumerate(read(t.as_py())):
                    h = shingles(words(part))
                    at = np.arange(len(h))
                    if bits is not None:
                        for s in SHIFTS:
                            p = (h[at] >> np.uint64(s)) & np.uint64(len(bits) * 64 - 1)
                            at = at[(bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)]
                    if len(at):
                        for c, v in zip(cols, (np.full(len(at), i), np.full(len(at), k), at, h[at].view(np.int64))):
                            c.append(v)
                        size += len(at)
                if size > 100_000:
                    yield _batch(cols)
                    cols, size = [[], [], [], []], 0
            if size:
                yield _batch(cols)

    return go


def _batch(c) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(c, kinds)], ["id", "part", "pos", "h"])


def _words(read: Callable[[str | None], list[str]]):
    """Rows (id, part, words)."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, words(part)) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for k, part in enumerate(read(t.as_py()))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.list_(pa.string())))], ["id", "part", "words"])

    return go


def _filter(hashes: DataFrame, most: int) -> np.ndarray:
    """A Bloom filter of the hashes, put together by executors; its words, 2 ** most bits at most, reach the driver."""
    n = hashes.count()
    size = 1 << min(most, max(6, (PER_SHINGLE * n - 1).bit_length()))
    place = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit(size - 1)) for s in SHIFTS]))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    rows = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("m")).collect()
    bits = np.zeros(size // 64, np.uint64)
    if rows:
        bits[np.array([r[0] for r in rows])] = np.array([r[1] for r in rows], np.int64).view(np.uint64)
    return bits


def _verify(run: int):
    """(doc_id, item_id, lo, hi): runs of equal words of an item and the window of its size, at least ``run`` long, by their places in the item."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, i, at, own, there in zip(*(b.column(k).to_pylist() for k in range(5))):
                n = 0
                for k, same in enumerate([*(x == y for x, y in zip(own, there)), False]):
                    if same:
                        n += 1
                        continue
                    if n >= run:
                        rows.append((d, i, at + k - n, at + k))
                    n = 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "lo", "hi"])

    return go


def whole(text: str | None) -> list[str]:
    """The text itself as its only part."""
    return [text] if text else []


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, read: Callable[[str | None], list[str]] = text_parts, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, item_id, n_words): items of which at least ``run`` words in a row stand in a text part of the document.

    docs: (doc_id, text), raw mails, or what ``read`` makes parts of; items: (item_id, text). n_words is the number of
    the item's words that stand in such runs, each counted once. NULL and empty texts match nothing, nor do items
    shorter than a run. Every document is read whole; only shingles that may be of an item leave the scan, and their
    frequencies are counted over the whole corpus.
    """
    spark = docs.sparkSession
    own = items.where("text is not null").select(F.col("item_id").alias("id"), "text")
    it = written(own.mapInArrow(_scan(whole), SCHEMA).select(F.col("id").alias("item_id"), "pos", "h"))
    hashes = written(it.select("h").distinct())
    d = docs.where("text is not null").select(F.col("doc_id").alias("id"), "text")
    found = written(d.mapInArrow(_scan(read, spark.sparkContext.broadcast(_filter(hashes, most_bits))), SCHEMA).join(hashes, "h", "left_semi"))
    freq = found.groupBy("h").agg(F.count("*").alias("freq"))
    # Every run of an item by each of its shingles; the rarest one is the prefix. A shingle without frequency: its runs are nowhere.
    end = it.groupBy("item_id").agg((F.max("pos") + SHINGLE).alias("n_words"))
    known = it.join(freq, "h", "left").join(end, "item_id").select("item_id", "pos", "h", F.coalesce("freq", F.lit(0)).alias("freq"), "n_words")
    runs = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(run - SHINGLE))).alias("off")).select("*", (F.col("pos") - F.col("off")).alias("at")).where(f"at >= 0 and at + {run} <= n_words")
    w = Window.partitionBy("item_id", "at").orderBy("freq", "off")
    prefix = runs.withColumn("place", F.row_number().over(w)).where("place = 1 and freq > 0").select("item_id", "h", F.col("pos").alias("q"), "n_words").distinct()
    # One row for each place of an item beside a part, whatever the number of matches that put it there.
    beside = written(found.join(prefix, "h").select("id", "part", "item_id", "n_words", (F.col("pos") - F.col("q")).alias("start")).distinct())
    parts = d.join(beside.select("id").distinct(), "id", "left_semi").mapInArrow(_words(read), "id bigint, part int, words array<string>")
    said = own.mapInArrow(_words(whole), "id bigint, part int, words array<string>").select(F.col("id").alias("item_id"), F.col("words").alias("own"))
    # Bounds by place and length first: the part of the item that lies beside the text must have room for a run.
    lo, hi = F.greatest(F.lit(0), -F.col("start")), F.least(F.col("n_words"), F.size("words") - F.col("start"))
    c = beside.join(parts, ["id", "part"]).withColumns({"lo": lo, "hi": hi}).where(f"hi - lo >= {run}").select("id", "item_id", "lo", "hi", F.expr("slice(words, start + lo + 1, hi - lo)").alias("there"))
    c = c.join(said, "item_id").select("id", "item_id", "lo", F.expr("slice(own, lo + 1, hi - lo)").alias("own"), "there")
    hit = c.mapInArrow(_verify(run), "doc_id bigint, item_id bigint, lo int, hi int").distinct()
    spans = hit.groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("r"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    said_there = F.aggregate("r", start, lambda s, x: F.struct((s["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], s["end"]), F.lit(0))).alias("n"), F.greatest(x["hi"], s["end"]).alias("end")))
    return spans.select("doc_id", "item_id", said_there["n"].cast("bigint").alias("n_words"))
