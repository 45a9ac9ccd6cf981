"""Columns over 64-bit hierarchical cell ids.

Layout: resolution in bits 52-55, base cell in bits 45-51, then fifteen digits of three bits, digit i (1 the
coarsest) at bit (15-i)*3; digits after the resolution are 7. All functions are bit operations on BIGINT and stay
inside whole-stage code generation; a NULL cell gives NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_RES = 15


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def resolution(cell: Column | str) -> Column:
    return F.shiftright(_c(cell), 52).bitwiseAND(F.lit(15)).cast("int")


def base_cell(cell: Column | str) -> Column:
    return F.shiftright(_c(cell), 45).bitwiseAND(F.lit(127)).cast("int")


def digit(cell: Column | str, i: int) -> Column:
    return F.shiftright(_c(cell), (MAX_RES - i) * 3).bitwiseAND(F.lit(7)).cast("int")


def parent(cell: Column | str, res: int) -> Column:
    """The ancestor at ``res``; the cell itself at its own resolution, NULL for a finer ``res``."""
    c, clear, fill = _c(cell), ~(15 << 52), (1 << (MAX_RES - res) * 3) - 1
    out = c.bitwiseAND(F.lit(clear)).bitwiseOR(F.lit(res << 52)).bitwiseOR(F.lit(fill))
    return F.when(resolution(c) >= res, out)


def coarsen(cell: Column | str, res: int) -> Column:
    """The ancestor at ``res`` of a finer cell; coarser cells stay as they are."""
    return F.when(resolution(cell) > res, parent(cell, res)).otherwise(_c(cell))


def ancestors(cell: Column | str, levels: Iterable[int], proper: bool = False) -> Column:
    """Array of the ancestors at the given resolutions, NULL at those finer than the cell (``proper``: not coarser).

    Made to be exploded and joined: NULL joins nothing, and without a lambda the whole stays in generated code.
    """
    c, ls = _c(cell), sorted(set(levels))
    if not ls:
        return F.array().cast("array<bigint>")
    keep = [F.when((resolution(c) > r) if proper else (resolution(c) >= r), parent(c, r)) for r in ls]
    return F.array(*keep)


def area_m2(cell: Column | str) -> Column:
    """Area on the planar grid, exact in BIGINT: (32 m * 2^(13-res))^2; resolutions 14 and 15 have 256 and 64 m2."""
    r = resolution(cell)
    return F.when(r <= 13, F.call_function("shiftleft", F.lit(1024).cast("bigint"), (F.lit(26) - 2 * r).cast("int"))).when(r == 14, F.lit(256)).when(r == 15, F.lit(64)).cast("bigint")


def from_text(text: Column | str) -> Column:
    """A cell from its hexadecimal or decimal text: hexadecimal if a letter a-f occurs or the text has 15 digits, as cell ids do."""
    t = F.trim(_c(text))
    hexa = t.rlike("[a-fA-F]") | (F.length(t) == 15)
    return F.when(hexa, F.conv(t, 16, 10).try_cast("bigint")).otherwise(t.try_cast("bigint"))


def grid_xy(cell: Column | str, res: int = 13) -> tuple[Column, Column]:
    """Column and row of the cell's south-west corner in units of the side at ``res`` (13 at most, 32 m), over the whole planar grid."""
    c, b = _c(cell), base_cell(cell)
    x = y = F.lit(0).cast("bigint")
    for i in range(1, res + 1):
        d = F.when(resolution(c) >= i, digit(c, i)).otherwise(0)
        x = x + F.shiftleft(d.bitwiseAND(F.lit(1)).cast("bigint"), res - i)
        y = y + F.shiftleft(F.shiftright(d, 1).bitwiseAND(F.lit(1)).cast("bigint"), res - i)
    step = 300_000 * 2 ** res // (32 * 2**13)
    assert step * 32 * 2**13 == 300_000 * 2**res, "base cells don't fall on this grid"
    return (b % 11) * step + x, F.floor(b / 11) * step + y


def at(x: Column, y: Column, res: int) -> Column:
    """The planar cell at ``res`` that holds the point; NULL outside all base cells."""
    side = 32.0 * 2.0 ** (13 - res)
    bx, by = F.floor((x - 2_400_000) / 300_000), F.floor((y - 1_000_000) / 300_000)
    ix, iy = F.floor((x - 2_400_000 - bx * 300_000) / side), F.floor((y - 1_000_000 - by * 300_000) / side)
    base = by * 11 + bx
    out = F.lit((1 << 59) | (res << 52)).cast("bigint") + F.shiftleft(base.cast("bigint"), 45)
    for i in range(1, MAX_RES + 1):
        d = F.lit(7).cast("bigint") if i > res else F.shiftright(iy, res - i).bitwiseAND(F.lit(1)) * 2 + F.shiftright(ix, res - i).bitwiseAND(F.lit(1))
        out = out + F.shiftleft(d, (MAX_RES - i) * 3)
    ok = bx.between(0, 10) & (by >= 0) & (base < 128) & (ix < 1 << res) & (iy < 1 << res)
    return F.when(ok, out)
