"""Mergeable distinct counts: registers on a logarithmic scale of tunable base.

A value goes to one of ``m`` registers by its hash; the register keeps the largest of floor(1 - log_b(u)), u the rest
of the hash as a number in (0, 1]. Base 2 gives the classic registers, a base near 1 finer ones. Two sketches of the
same m and b merge by the maximum. Counts come from the Poisson likelihood P(register <= k) = exp(-n/m * b^-k), which
holds from the empty set on; unions, intersections and Jaccard from the joint likelihood of two sets of registers.
The relative standard error is about sqrt((((b+1)/(b-1)) * ln b - 1) / m): 1.57 % for the defaults.

A sketch is one row (keys, regs): regs has three bytes for each register that is filled (its number, low byte first,
and its value), or all m values where that is shorter. It is merged before and after it is shuffled, so a set held by
many rows sends one sketch a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stage import written

M_BITS, BASE, TOP = 12, 1.2, 250


def stated_error(m_bits: int = M_BITS, base: float = BASE) -> float:
    return math.sqrt(((base + 1) / (base - 1) * math.log(base) - 1) / 2**m_bits)


def register(value: Column, m_bits: int = M_BITS, base: float = BASE) -> tuple[Column, Column]:
    h = F.xxhash64(value)
    u = (F.shiftrightunsigned(h, m_bits).cast("double") + 1.0) / float(2 ** (64 - m_bits))
    k = F.least(F.floor(1.0 - F.log(u) / math.log(base)), F.lit(TOP + 1))
    return h.bitwiseAND(F.lit(2**m_bits - 1)).cast("int"), k.cast("int")


def packed(idx: np.ndarray, reg: np.ndarray, m: int) -> bytes:
    if 3 * len(idx) < m:
        out = np.empty((len(idx), 3), np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = idx & 255, idx >> 8, reg
        return out.tobytes()
    out = np.zeros(m, np.uint8)
    out[idx] = reg
    return out.tobytes()


def unpacked(regs: bytes, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, values) of the filled registers."""
    a = np.frombuffer(regs, np.uint8)
    if len(a) == m:
        at = np.flatnonzero(a)
        return at, a[at]
    a = a.reshape(-1, 3)
    return a[:, 0].astype(np.int64) | a[:, 1].astype(np.int64) << 8, a[:, 2]


def _merged(n_keys: int, m: int):
    """One row for each run of equal keys: registers (idx, reg) or sketches (regs) merged by the maximum. One array of m values is all that is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, names, kinds = np.zeros(m, np.uint8), None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            long = b.num_columns == n_keys + 2
            names, kinds = b.schema.names[:n_keys], [b.schema.field(k).type for k in range(n_keys)]
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for k in range(n_keys):
                x, y = b.column(k).slice(1), b.column(k).slice(0, b.num_rows - 1)
                new[1:] |= pc.and_not(pc.fill_null(pc.not_equal(x, y), True), pc.and_(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            keys = list(zip(*(b.column(k).take(pa.array(starts)).to_pylist() for k in range(n_keys)))) or [()] * len(starts)
            done: list[tuple] = []
            if long:
                idx, reg = (b.column(n_keys + k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for key, lo, hi in zip(keys, starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
                if key != last and last is not None:
                    at = np.flatnonzero(own)
                    done.append((last, packed(at, own[at], m)))
                    own[:] = 0
                last = key
                if long:
                    np.maximum.at(own, idx[lo:hi], reg[lo:hi].astype(np.uint8))
                else:
                    for r in b.column(n_keys).slice(lo, hi - lo):
                        i, v = unpacked(r.as_py(), m)
                        own[i] = np.maximum(own[i], v)
            if done:
                yield batch(done, names, kinds)
        if last is not None:
            at = np.flatnonzero(own)
            yield batch([(last, packed(at, own[at], m))], names, kinds)

    def batch(done, names, kinds) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([d[0][k] for d in done], t) for k, t in enumerate(kinds)), pa.array([d[1] for d in done], pa.binary())], [*names, "regs"])

    return run


def _ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "regs binary"])


def _together(rows: DataFrame, keys: Sequence[str], m_bits: int) -> DataFrame:
    """(keys, regs), one row per set: merged where the rows are, shuffled, merged again."""
    keys, run, ddl = list(keys), _merged(len(keys), 2**m_bits), _ddl(rows, keys)
    cols = [F.col(f"`{k}`") for k in keys]
    local = (rows.sortWithinPartitions(*cols) if keys else rows).mapInArrow(run, ddl)
    moved = local.repartition(*cols).sortWithinPartitions(*cols) if keys else local.coalesce(1)
    return moved.mapInArrow(run, ddl)


def sketch(df: DataFrame, keys: Sequence[str], array: str, m_bits: int = M_BITS, base: float = BASE) -> DataFrame:
    """(keys, regs) of the values in an array column. NULL arrays, empty arrays and NULL values add nothing; a NULL key is a set of its own."""
    v = df.select(*keys, F.explode(F.array_distinct(array)).alias("__v")).where("__v is not null")
    idx, reg = register(F.col("__v"), m_bits, base)
    long = v.select(*keys, idx.alias("idx"), reg.alias("reg")).groupBy(*keys, "idx").agg(F.max("reg").alias("reg"))
    return _together(long, keys, m_bits)


def merge(sketches: DataFrame, keys: Sequence[str], m_bits: int = M_BITS) -> DataFrame:
    """Union of sketches down to the given keys."""
    return _together(sketches.select(*keys, "regs"), keys, m_bits)


def cube(sketches: DataFrame, keys: Sequence[str], m_bits: int = M_BITS) -> DataFrame:
    """merge() for every combination of keys at once: the keys, is_all_<key> flags, regs."""
    keys = list(keys)
    null = {k: F.lit(None).cast(sketches.schema[k].dataType) for k in keys}
    sets = F.array(*[F.struct(*[F.lit(bool(n >> i & 1)).alias(f"is_all_{k}") for i, k in enumerate(keys)]) for n in range(2 ** len(keys))])
    wide = sketches.withColumn("__all", F.explode(sets))
    flags = [f"is_all_{k}" for k in keys]
    wide = wide.select(*[F.when(F.col(f"__all.is_all_{k}"), null[k]).otherwise(F.col(k)).alias(k) for k in keys], *[F.col(f"__all.{f}").alias(f) for f in flags], "regs")
    return _together(wide, keys + flags, m_bits)


def _count(c: np.ndarray, m: int, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Newton's method on log(n/m), all sets at once. c: (sets, TOP + 2) registers by value."""
    k = np.arange(TOP + 2)
    scale = base ** -k.astype(float)
    with np.errstate(all="ignore"):
        theta = np.log(np.maximum(m * (1 - 1 / base) / (math.log(base) * (c * scale).sum(1)), 1e-9))
        filled = m - c[:, 0]
        theta = np.where(c[:, 0] > 0.02 * m, np.log(np.maximum(-np.log(np.maximum(c[:, 0], 0.5) / m), 1e-9)), theta)
        for _ in range(60):
            x = np.exp(theta)[:, None] * scale[None, :]
            z = np.minimum((base - 1) * x, 700)
            e = np.expm1(z)
            g = np.where(z < 1e-8, 1 - z / 2, z / e)
            d = np.where(z < 1e-8, -z / 2, (z * e - z * z * (e + 1)) / (e * e))
            one, two = g - x, d - x
            # Registers at the top hold all that is above: log(1 - exp(-y)), y = n/m * b^-TOP.
            y = np.minimum(np.exp(theta) * base**-TOP, 700)
            one[:, -1] = np.where(y < 1e-8, 1 - y / 2, y / np.expm1(y))
            two[:, -1] = np.where(y < 1e-8, -y / 2, 0)
            one[:, 0] = two[:, 0] = -x[:, 0]
            a, b = (c * one).sum(1), (c * two).sum(1)
            step = np.clip(-a / np.minimum(b, -1e-12), -1, 1)
            theta = theta + step
            if np.abs(step).max(initial=0) < 1e-9:
                break
        # The curvature is that of a Poisson rate; the set is fixed, which takes 1/n off. Collisions leave 1/(2m) at least.
        n = m * np.exp(theta)
        err = np.sqrt(np.maximum(1 / np.maximum(-b, 1e-12) - 1 / n, 0.5 / m))
    return np.where(filled > 0, n, 0.0), np.where(filled > 0, err, 0.0)


def count(sketches: DataFrame, keys: Sequence[str], m_bits: int = M_BITS, base: float = BASE) -> DataFrame:
    """(keys, n_distinct, rel_error, lower, upper): estimate, its standard error from the curvature of the likelihood, and the band of three of them.

    A small set loses values whole, where two fall into one register; as many as that happens to in 99.87 % of sets are
    in the band too.
    """
    m, keys = 2**m_bits, list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                c = np.zeros((b.num_rows, TOP + 2))
                for k, r in enumerate(b.column(len(keys))):
                    c[k] = _histogram(r.as_py(), m)
                n, err = _count(c, m, base)
                band = n * np.exp(-3 * err), np.maximum(n * np.exp(3 * err), n + np.array([_collisions(x * x / (2 * m)) for x in n.tolist()]))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *map(pa.array, (n, err, *band))], [*keys, "n_distinct", "rel_error", "lower", "upper"])

    ddl = ", ".join([*(f"`{k}` {sketches.schema[k].dataType.simpleString()}" for k in keys), "n_distinct double, rel_error double, lower double, upper double"])
    return sketches.select(*keys, "regs").mapInArrow(run, ddl)


def _collisions(mean: float) -> float:
    """The number that a Poisson variable of this mean exceeds in 0.13 % of cases; 0 where the normal band holds it."""
    if mean > 50:
        return 0.0
    k, p = 0, math.exp(-mean)
    total = p
    while total < 0.99865:
        k += 1
        p *= mean / k
        total += p
    return k + 0.1 * (k > 0)


def _histogram(regs: bytes, m: int) -> np.ndarray:
    """The number of registers by value."""
    c = np.bincount(unpacked(regs, m)[1], minlength=TOP + 2).astype(float)
    c[0] = m - c[1:].sum()
    return c


def _joint(ra: np.ndarray, rb: np.ndarray, n: np.ndarray, m: int, base: float, a0: float, b0: float) -> dict:
    """Maximum likelihood of |A - B|, |B - A| and |A and B| from the joint register counts; errors by the inverse curvature."""
    at = [(i, j) for i in (ra, ra - 1) for j in (rb, rb - 1)]
    low = [(i < 0) | (j < 0) for i, j in at]
    pw = lambda k: np.where(k > TOP, 0.0, base ** -np.maximum(k, 0).astype(float))
    ws = [(pw(i), pw(j), pw(np.minimum(i, j))) for i, j in at]
    sign = (1, -1, -1, 1)

    def ll(t: np.ndarray) -> float:
        l1, l2, l3 = np.exp(t)
        p = sum(s * np.where(z, 0.0, np.exp(-(l1 * w[0] + l2 * w[1] + l3 * w[2]))) for s, z, w in zip(sign, low, ws))
        return float((n * np.log(np.maximum(p, 1e-300))).sum())

    def slopes(t: np.ndarray, h: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
        f0, e = ll(t), np.eye(3) * h
        up, dn = [ll(t + x) for x in e], [ll(t - x) for x in e]
        g, H = (np.array(up) - dn) / (2 * h), np.zeros((3, 3))
        for i in range(3):
            H[i, i] = (up[i] - 2 * f0 + dn[i]) / h**2
            for j in range(i):
                H[i, j] = H[j, i] = (ll(t + e[i] + e[j]) - ll(t + e[i] - e[j]) - ll(t - e[i] + e[j]) + ll(t - e[i] - e[j])) / (4 * h * h)
        return g, H

    same = n[(ra == rb) & (ra > 0)].sum() / max(n[(ra > 0) | (rb > 0)].sum(), 1)
    both = min(same * (a0 + b0) / (1 + same), min(a0, b0) * 0.99) + 0.1
    t = np.log(np.maximum([a0 - both, b0 - both, both], 0.05) / m)
    best, floor = ll(t), math.log(1e-3 / m)
    for _ in range(40):
        g, H = slopes(t)
        w, v = np.linalg.eigh(-H)
        step = v @ ((v.T @ g) / np.maximum(np.abs(w), 1e-3))
        step = np.clip(step, -2, 2)
        for _ in range(12):
            new = np.maximum(t + step, floor)
            if (l := ll(new)) >= best - 1e-12:
                break
            step = step / 2
        done = np.abs(new - t).max() < 1e-6
        t, best = new, max(l, best)
        if done:
            break
    _, H = slopes(t)
    w, v = np.linalg.eigh(-H)
    cov = v @ np.diag(1 / np.maximum(w, 1e-6)) @ v.T
    x = m * np.exp(t)
    cov = cov * np.outer(x, x)
    union = x.sum()
    jac, gr = x[2] / union, np.array([-x[2], -x[2], union - x[2]]) / union**2
    var = lambda q: math.sqrt(max(float(q @ cov @ q), 0.0))
    # Near an empty intersection the curvature says little: how far up does the likelihood stay within four and a half
    # units, as it does for three standard errors where it is curved?
    at_ = lambda v: ll(np.log(np.maximum([x[0] + x[2] - v, x[1] + x[2] - v, v], 1e-3) / m))
    lo, hi, top = x[2], min(x[0], x[1]) + x[2], at_(x[2])
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at_(mid) > top - 4.5 else (lo, mid)
    both_error = max(var(np.array([0, 0, 1.0])), (lo - x[2]) / 3)
    return {"n_union": union, "n_union_error": var(np.ones(3)), "n_both": x[2], "n_both_error": both_error, "jaccard": jac, "jaccard_error": max(var(gr), both_error / union)}


JOINT = "key_a string, key_b string, n_a double, n_b double, n_union double, n_union_error double, n_both double, n_both_error double, jaccard double, jaccard_error double"


#: Sets a block of joint() has at most, as far as hashing spreads them: two blocks, 4 KB a set, are what a task holds.
BLOCK = 32


def joint(sketches: DataFrame, key: str, m_bits: int = M_BITS, base: float = BASE) -> DataFrame:
    """Every pair of non-NULL keys with a register in common: sizes, union, intersection and Jaccard with standard errors.

    Sets are dealt to blocks; every two blocks meet in one group of at most twice BLOCK sketches, whatever the sets
    hold, so the pairs, which are the result, are spread over as many tasks as there are pairs of blocks.
    """
    m = 2**m_bits
    s = written(merge(sketches.where(F.col(key).isNotNull()), [key], m_bits).select(F.col(key).cast("string").alias("k"), "regs"))
    blocks = max(1, -(-s.count() // BLOCK))
    own = s.withColumn("mine", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(F.least("mine", x).alias("x"), F.greatest("mine", x).alias("y")))
    groups = own.withColumn("g", F.explode(others)).select(F.col("g.x").alias("x"), F.col("g.y").alias("y"), "mine", "k", "regs")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, y = key[0].as_py(), key[1].as_py()
        sets = [(n, k, _full(r, m)) for n, k, r in zip(*(table.column(c).to_pylist() for c in ("mine", "k", "regs")))]
        rows = []
        for i, (p, a, ra) in enumerate(sets):
            for q, b, rb in sets[i + 1 :] if x == y else sets:
                if x != y and not (p == x and q == y):
                    continue
                (a_, ra_), (b_, rb_) = sorted([(a, ra), (b, rb)], key=lambda z: z[0])
                if not ((ra_ > 0) & (rb_ > 0)).any():
                    continue
                both, n = np.unique(ra_.astype(np.int64) * 256 + rb_, return_counts=True)
                n0 = [float(_count(np.bincount(r, minlength=TOP + 2)[None, :].astype(float), m, base)[0][0]) for r in (ra_, rb_)]
                rows.append({"key_a": a_, "key_b": b_, "n_a": n0[0], "n_b": n0[1]} | _joint(both >> 8, both & 255, n.astype(float), m, base, *n0))
        return pa.Table.from_pylist(rows, schema=SCHEMA)

    return groups.groupBy("x", "y").applyInArrow(run, JOINT)


SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.float64()) for c in JOINT.split(", ")])


def _full(regs: bytes, m: int) -> np.ndarray:
    out = np.zeros(m, np.uint8)
    at, v = unpacked(regs, m)
    out[at] = v
    return out
