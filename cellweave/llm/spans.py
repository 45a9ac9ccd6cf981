"""Long spans that stand verbatim in more than one record, by level-wise doubling.

Level 1 looks at windows of a quarter of the last level's length, level 2 at twice that, the last at twice that again,
SLACK - 1 short of a span. A window repeated in no other record rules out every longer span around it, so each level
only looks where the one before left room, and ends where nothing is left. It is enough to look at a content-defined
choice of windows: of any ``slack`` windows in a row the one with the smallest hash, the first of equal ones. Two
records that share a span choose alike inside it. At the last level a window and its slack together are just as long
as a span, so any span in common has a choice of it in common, and the span is that window with some of the few
characters before and after it. Windows are told apart by SHA-256 there, the characters around them as they are; no
text is compared with another, and records meet only on spans they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import written

LEAST, SLACK = 400, 33
CHUNK = 400_000
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_B = 0xD6E8FEB86659FD93
_INV = pow(_B, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_LOW = _mix(np.arange(0x3000, dtype=np.uint32))


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = 1 << n.bit_length()
            for name, base in (("up", _B), ("down", _INV)):
                a = np.full(n, np.uint64(base))
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up, cls.down


class Hashed:
    """Code points of some texts one after the other, and hashes of all their windows of any length in constant time."""

    def __init__(self, texts: list[str]):
        self.ends = np.cumsum([len(t) for t in texts])
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(code)
        v = _LOW[code] if not self.n or code.max() < len(_LOW) else _mix(code)
        up, self.down = _Powers.get(self.n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * up[: self.n], dtype=np.uint64)])
        self.starts = self.ends - [len(t) for t in texts] if len(texts) else self.ends

    def windows(self, size: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start at the given positions; each must end inside the whole."""
        h = (self.sums[at + size] - self.sums[at]) * self.down[at]
        return h ^ (h >> np.uint64(32))

    def all(self, size: int) -> np.ndarray:
        """Hash per position; the largest value where no window of its text starts."""
        n = max(0, self.n - size + 1)
        h = np.full(self.n, _MAX)
        if n:
            w = (self.sums[size:] - self.sums[:-size]) * self.down[:n]
            h[:n] = np.minimum(w ^ (w >> np.uint64(32)), _MAX - np.uint64(1))
            for s, e in zip(self.starts.tolist(), self.ends.tolist()):
                h[max(s, e - size + 1) : e] = _MAX
        return h


def _slide(h: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over h[i : i + width], shorter at the end."""
    out, have = h.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = pick(out[:-step], out[step:]) if len(out) > step else out[:-step]
        have += step
    return out


def chosen(h: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, smallest): runs of window positions with the same smallest hash among the next ``slack``."""
    low = _slide(h, slack, np.minimum)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, int)
    return first, low[first]


def _texts(b: pa.RecordBatch, col: int) -> Iterator[tuple[int, int, list[str]]]:
    at, rows, c = 0, b.num_rows, b.column(col)
    while at < rows:
        to, chars, part = at, 0, []
        while to < rows and (not part or chars < CHUNK):
            part.append(c[to].as_py() or "")
            chars += len(part[-1])
            to += 1
        yield at, to, part
        at = to


RUNS = "id bigint, lo int, hi int, h bigint"


def _sampled(size: int, slack: int):
    """Rows (id, lo, hi, h): for window positions lo..hi of a record the smallest hash among the next ``slack`` windows is h."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            limited = b.num_columns > 2
            for at, to, part in _texts(b, 1):
                x = Hashed(part)
                h = x.all(size)
                ids = b.column(0).slice(at, to - at).to_numpy(zero_copy_only=False)
                cols: list[list] = [[], [], [], []]
                for k, (s, e) in enumerate(zip(x.starts.tolist(), x.ends.tolist())):
                    for p, q in zip(b.column(2)[at + k].as_py(), b.column(3)[at + k].as_py()) if limited else ((0, e - s),):
                        # Positions whose next ``slack`` windows all lie in the part looked at.
                        q = min(q, e - s - size + 1)
                        n = q - p - slack + 1
                        if n < 1:
                            continue
                        first, low = chosen(h[s + p : s + q], slack)
                        keep = first < n
                        first, low = first[keep], low[keep]
                        cols[0].append(np.full(len(first), ids[k]))
                        cols[1].append(first + p)
                        cols[2].append(np.append(first[1:], n) - 1 + p)
                        cols[3].append(low.view(np.int64))
                if cols[0]:
                    a = [np.concatenate(c) for c in cols]
                    yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.int32()), pa.array(a[2], pa.int32()), pa.array(a[3], pa.int64())], ["id", "lo", "hi", "h"])

    return go


LAST = "id bigint, w binary, c binary, l string, r string, pos array<int>, last array<int>"


def _digest(text: str) -> bytes:
    """SHA-256, cut to 128 bits."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def _last(size: int, slack: int):
    """Rows (id, w, c, l, r, pos, last): the windows of a record chosen in its parts, once each.

    w is the digest of the window, l and r the up to slack - 1 characters before and after it, c the digest of all
    three. It stands at every position from pos[k] to last[k].
    """
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, part in _texts(b, 1):
                x = Hashed(part)
                h = x.all(size)
                rows: list[tuple] = []
                for k, (s, e) in enumerate(zip(x.starts.tolist(), x.ends.tolist())):
                    t, i = part[k], b.column(0)[at + k].as_py()
                    found: set[int] = set()
                    for p, q in zip(b.column(2)[at + k].as_py(), b.column(3)[at + k].as_py()):
                        q = min(q, e - s - size + 1)
                        n = q - p - slack + 1
                        if n < 1:
                            continue
                        # Rank and place in one number, so that the least is the first of the smallest.
                        rank = np.unique(h[s + p : s + q], return_inverse=True)[1] * (q - p) + np.arange(q - p)
                        found.update((np.unique(_slide(rank, slack, np.minimum)[:n] % (q - p)) + p).tolist())
                    own: dict[tuple[str, int], tuple[list[int], list[int]]] = {}
                    for p in sorted(found):
                        lo = max(0, p - slack + 1)
                        first, last = own.setdefault((t[lo : p + size + slack - 1], p - lo), ([], []))
                        if last and last[-1] == p - 1:
                            last[-1] = p
                        else:
                            first.append(p)
                            last.append(p)
                    for (around, n), (first, last) in own.items():
                        rows.append((i, _digest(around[n : n + size]), _digest(f"{n} {around}"), around[:n], around[n + size :], first, last))
                if rows:
                    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["id", "w", "c", "l", "r", "pos", "last"])

    return go


def repeated(rows: DataFrame) -> DataFrame:
    """(h): hashes that occur in two records. Only (h, least id, largest id) are shuffled, combined on the map side."""
    return rows.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("h")


def _parts(rows: DataFrame, size: int, slack: int, least: int) -> DataFrame:
    """(id, los, his): stretches [lo, hi) of each record all of whose choices are repeated, long enough for a span.

    In a shared span of ``least`` characters every position up to least - size - slack + 1 from its start makes the
    same choice in both records. Neighbouring runs are joined into islands; an island of fewer positions holds no span.
    """
    rows = written(rows)  # read twice: hashing the texts is the costly part
    good = rows.join(repeated(rows), "h", "left_semi").select("id", "lo", "hi")
    runs = good.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("r"))

    def join(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))))
        return F.when((F.size(acc) > 0) & (x["lo"] <= last["hi"] + 1), grown).otherwise(F.concat(acc, F.array(F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))))

    islands = runs.withColumn("r", F.aggregate("r", F.array().cast("array<struct<lo:int,hi:int>>"), join))
    need = least - size - slack + 2
    long = F.transform(F.filter("r", lambda x: x["hi"] - x["lo"] + 1 >= need), lambda x: F.struct(x["lo"].alias("lo"), (x["hi"] + size + slack - 1).alias("hi")))
    return islands.withColumn("r", long).where(F.size("r") > 0).select("id", F.expr("transform(r, x -> x.lo)").alias("los"), F.expr("transform(r, x -> x.hi)").alias("his"))


def _choices(docs: DataFrame, least: int, slack: int = SLACK) -> DataFrame:
    """The rows of _last() of the records (id, text) that survive all levels before it, written once."""
    last = least - slack + 1
    left, size = docs.where(F.length("text") >= least).select("id", "text"), last // 4
    wide = lambda size: min(5 * size // 3, (least - size) * 6 // 7)  # fewer choices for short windows, of which most are looked at
    parts = _parts(left.mapInArrow(_sampled(size, wide(size)), RUNS), size, wide(size), least)
    while True:
        left = written(left.select("id", "text").join(parts, "id").select("id", "text", "los", "his"))
        size *= 2
        if 2 * size > last or left.isEmpty():
            break
        parts = _parts(left.mapInArrow(_sampled(size, wide(size)), RUNS), size, wide(size), least)
    return written(left.mapInArrow(_last(last, slack), LAST))


SET = ["n", "lo", "hi", "x", "y"]


def _set(rows: DataFrame, *key: str) -> DataFrame:
    """The set of records of each key, told by their number, the least and largest id and two hashes of all."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))


def _spans(rows: DataFrame, least: int, slack: int = SLACK) -> tuple[DataFrame, DataFrame]:
    """(alone, shared): what two records at least have in common around the windows of rows, from _last().

    All records with the same characters around a window are one class (w, c), so what is looked at follows the
    different surroundings, not the records. Where there is one class only, all around the window is shared: alone has
    (w, its set of records), if that is a span. Else shared has (w, c, d, k): the window and the characters around it
    hold a span with d characters before it that another class has too; k is its digest. A window has at most slack
    such spans, which are twice as many in all as there are characters near the ends of shared passages.
    """
    more = slack - 1
    own = rows.select("id", "w", "c", F.length("l").alias("nl"), F.length("r").alias("nr"))
    classes = written(_set(own, "w", "c", "nl", "nr"))
    per = classes.groupBy("w").agg(F.count("*").alias("classes"), F.min("lo").alias("least"), F.max("hi").alias("most")).where("least < most")
    c = classes.join(per.select("w", "classes"), "w")
    alone = written(c.where("classes = 1").where(F.col("nl") + F.col("nr") >= more).select("w", *SET))
    many = c.where("classes > 1").select("w", "c", "lo", "hi")
    around = rows.select("w", "c", "l", "r").join(many.select("w").distinct(), "w", "left_semi").dropDuplicates(["w", "c"])
    each = many.join(around, ["w", "c"]).select("*", F.explode(F.sequence(F.lit(0), F.lit(more))).alias("d")).where(f"length(l) >= d and length(r) >= {more} - d")
    digest = F.expr(f"unhex(left(sha2(concat(w, encode(concat(d, ' ', right(l, d), left(r, {more} - d)), 'UTF-8')), 256), 32))")
    each = written(each.select("w", "c", "lo", "hi", "d", digest.alias("k")))
    both = each.groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("k")
    return alone, each.join(both, "k", "left_semi").select("w", "c", "d", "k")


def _one(sets: DataFrame, key: str) -> DataFrame:
    """A key of each different set."""
    return sets.groupBy(*SET).agg(F.min(key).alias(key)).select(key)


def shared_pairs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records with a span of ``least`` code points in common.

    docs: (id, text), id unique; NULL, empty and shorter texts have none. Spans that the same set of records has are
    taken once, so a long copy makes its pairs once, and only pairs that belong to the result are made.
    """
    rows = _choices(docs, least)
    alone, shared = _spans(rows, least)
    at_ends = written(rows.select("w", "c", "id").join(shared, ["w", "c"]).select("k", "id").distinct())
    held = rows.select(F.col("w").alias("k"), "id").join(_one(alone, "w").withColumnRenamed("w", "k"), "k", "left_semi")
    held = written(held.unionByName(at_ends.join(_one(_set(at_ends, "k"), "k"), "k", "left_semi")))
    return held.withColumnRenamed("id", "id_a").join(held.withColumnRenamed("id", "id_b"), "k").where("id_a < id_b").select("id_a", "id_b").distinct()


def shared_parts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, n_chars, shared_chars, share) of every record: code points that lie in spans found in another record. NULL texts have 0 of 0.

    No pairs are made: a span counts where another record has it.
    """
    rows, size = _choices(docs, least), least - SLACK + 1
    alone, shared = _spans(rows, least)
    at = F.explode(F.arrays_zip("pos", "last")).alias("x")
    whole = rows.join(alone.select("w"), "w", "left_semi").select("id", F.length("l").alias("nl"), F.length("r").alias("nr"), at).select("id", (F.col("x.pos") - F.col("nl")).alias("lo"), (F.col("x.last") + size + F.col("nr")).alias("hi"))
    ends = rows.select("id", "w", "c", "pos", "last").join(shared.select("w", "c", "d"), ["w", "c"]).select("id", "d", at).select("id", (F.col("x.pos") - F.col("d")).alias("lo"), (F.col("x.last") - F.col("d") + least).alias("hi"))
    parts = whole.unionByName(ends)
    # Per record, bounded by its text: equal parts are combined before the shuffle.
    runs = parts.distinct().groupBy("id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("r"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("r", start, lambda s, x: F.struct((s["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], s["end"]), F.lit(0))).alias("n"), F.greatest(x["hi"], s["end"]).alias("end")))
    n = F.coalesce(F.length("text"), F.lit(0))
    out = docs.select("id", n.alias("n_chars")).join(runs.select("id", covered["n"].alias("shared_chars")), "id", "left")
    out = out.withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return out.withColumn("share", F.coalesce(F.col("shared_chars") / F.nullif(F.col("n_chars"), F.lit(0)), F.lit(0.0)))
