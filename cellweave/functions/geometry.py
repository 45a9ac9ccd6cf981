"""Well-known binary without a geometry library: points, lines and polygons, single or multi, either byte order."""

from __future__ import annotations

import struct

import numpy as np

PARTS = {1: "points", 2: "lines", 3: "polygons"}


class Shape:
    """Points (n, 2), lines (list of (n, 2)) and polygons (list of lists of rings)."""

    def __init__(self):
        self.points: list[np.ndarray] = []
        self.lines: list[np.ndarray] = []
        self.polygons: list[list[np.ndarray]] = []

    def segments(self) -> np.ndarray:
        """(n, 4): all edges; a point is an edge without length."""
        out = [np.hstack([p, p]) for p in self.points]
        out += [np.hstack([a[:-1], a[1:]]) if len(a) > 1 else np.hstack([a, a]) for a in self.lines]
        out += [np.hstack([r[:-1], r[1:]]) for rings in self.polygons for r in rings if len(r) > 1]
        return np.vstack(out) if out else np.empty((0, 4))

    def bounds(self) -> tuple[float, float, float, float]:
        s = self.segments()
        if not len(s):
            raise ValueError("empty geometry")
        return s[:, [0, 2]].min(), s[:, [1, 3]].min(), s[:, [0, 2]].max(), s[:, [1, 3]].max()

    def contains(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Even-odd rule over the rings of each polygon; lines and points contain nothing."""
        out = np.zeros(len(x), bool)
        for rings in self.polygons:
            odd = np.zeros(len(x), bool)
            for r in rings:
                for (ax, ay), (bx, by) in zip(r[:-1], r[1:]):
                    cross = (ay > y) != (by > y)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        odd ^= cross & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            out |= odd
        return out

    def relate(self, x: np.ndarray, y: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray]:
        """For squares with south-west corner (x, y) and side s: do they meet the shape, are they wholly inside.

        A square is half open, [x, x+s) by [y, y+s), so that each point lies in one cell.
        """
        edge = np.zeros(len(x), bool)
        for ax, ay, bx, by in self.segments():
            edge |= _clips(ax, ay, bx, by, x, y, s)
        inside = self.contains(x + s / 2, y + s / 2)
        return edge | inside, inside & ~edge


def _clips(ax, ay, bx, by, x, y, s):
    """Liang-Barsky against many squares at once; an edge that only touches the north or east side doesn't count."""
    dx, dy = bx - ax, by - ay
    if dx == dy == 0:
        return (x <= ax) & (ax < x + s) & (y <= ay) & (ay < y + s)
    lo, hi, ok = np.zeros(len(x)), np.ones(len(x)), np.ones(len(x), bool)
    for d, a, c in ((dx, ax, x), (dy, ay, y)):
        if d == 0:
            ok &= (c <= a) & (a < c + s)
        else:
            t0, t1 = (c - a) / d, (c + s - a) / d
            lo, hi = np.maximum(lo, np.minimum(t0, t1)), np.minimum(hi, np.maximum(t0, t1))
    mx, my = ax + (lo + hi) / 2 * dx, ay + (lo + hi) / 2 * dy
    return ok & (lo <= hi) & (mx < x + s) & (my < y + s)


def read_wkb(data: bytes) -> Shape:
    """Raises ValueError for anything that isn't a complete geometry with finite coordinates."""
    shape = Shape()
    try:
        end = _read(memoryview(data), 0, shape)
    except (struct.error, TypeError, IndexError, RecursionError) as e:
        raise ValueError(f"unreadable geometry: {e}") from None
    if end > len(data):
        raise ValueError("geometry ends early")
    s = shape.segments()
    if not len(s) or not np.isfinite(s).all():
        raise ValueError("empty or infinite geometry")
    return shape


def _read(m: memoryview, at: int, shape: Shape) -> int:
    order = "<" if m[at] == 1 else ">" if m[at] == 0 else None
    if order is None:
        raise ValueError("bad byte order")
    (code,) = struct.unpack_from(order + "I", m, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4  # SRID
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x1FFFFFFF
    dims, kind = max(dims, 2 + (0, 1, 1, 2)[code // 1000 % 4]), code % 1000

    def ring(at: int, n: int | None = None) -> tuple[np.ndarray, int]:
        if n is None:
            (n,) = struct.unpack_from(order + "I", m, at)
            at += 4
        size = n * dims * 8
        if at + size > len(m):
            raise ValueError("geometry ends early")
        return np.frombuffer(m[at : at + size], order + "f8").reshape(n, dims)[:, :2].astype(float), at + size

    if kind == 1:
        p, at = ring(at, 1)
        shape.points.append(p)
    elif kind == 2:
        a, at = ring(at)
        shape.lines.append(a)
    elif kind == 3:
        (n,) = struct.unpack_from(order + "I", m, at)
        at, rings = at + 4, []
        for _ in range(n):
            r, at = ring(at)
            rings.append(r)
        shape.polygons.append(rings)
    elif kind in (4, 5, 6, 7):
        (n,) = struct.unpack_from(order + "I", m, at)
        at += 4
        for _ in range(n):
            at = _read(m, at, shape)
    else:
        raise ValueError(f"geometry type {kind}")
    return at
