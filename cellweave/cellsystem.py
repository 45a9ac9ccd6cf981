"""Cell systems: how geometry becomes cells.

The default is a planar grid in the metric CRS of the source. Its ids have the bit layout of ``functions.cells`` but
are NOT ids of the public H3 grid: each cell is a square with four children, digit = 2 * north half + east half, side
32 m * 2^(13-res); base cell b has its south-west corner at east 2,400,000 + 300,000 * (b mod 11), north
1,000,000 + 300,000 * floor(b / 11). Any object with the methods of ``CellSystem`` can be injected instead.
"""

from __future__ import annotations

from enum import Enum
from typing import Protocol

import numpy as np


class ContainmentMode(str, Enum):
    """Which cells belong to a shape: those that touch it, those whose centre is inside, those wholly inside."""

    OVERLAP = "overlap"
    CENTER = "center"
    FULL = "full"


class CellSystem(Protocol):
    def cover(self, wkb: bytes, target_cells: int, min_resolution: int, max_resolution: int, mode: ContainmentMode) -> tuple[list[int], int]: ...


EAST0, NORTH0, STEP, COLUMNS, SIDE0, TOP = 2_400_000.0, 1_000_000.0, 300_000.0, 11, 32.0 * 2**13, 1 << 59


class PlanarGrid:
    """The default cell system."""

    @staticmethod
    def side(res: int) -> float:
        return 32.0 * 2.0 ** (13 - res)

    @staticmethod
    def cell(base: int, ix: int, iy: int, res: int) -> int:
        """Cell at column ix and row iy, counted at ``res`` from the south-west corner of the base cell."""
        out = TOP | res << 52 | base << 45
        for i in range(1, 16):
            d = 7 if i > res else 2 * (iy >> res - i & 1) + (ix >> res - i & 1)
            out |= d << (15 - i) * 3
        return out

    @staticmethod
    def box(cell: int) -> tuple[float, float, float]:
        """East and north of the south-west corner, and the side."""
        res, base = cell >> 52 & 15, cell >> 45 & 127
        ix = iy = 0
        for i in range(1, res + 1):
            d = cell >> (15 - i) * 3 & 7
            ix, iy = ix << 1 | d & 1, iy << 1 | d >> 1
        s = PlanarGrid.side(res)
        return EAST0 + STEP * (base % COLUMNS) + ix * s, NORTH0 + STEP * (base // COLUMNS) + iy * s, s

    def at(self, x: float, y: float, res: int) -> int | None:
        """The cell that holds a point; None outside all base cells."""
        bx, by = int((x - EAST0) // STEP), int((y - NORTH0) // STEP)
        s = self.side(res)
        ix, iy = int((x - EAST0 - bx * STEP) // s), int((y - NORTH0 - by * STEP) // s)
        if not 0 <= bx < COLUMNS or not 0 <= by * COLUMNS + bx < 128 or by < 0 or max(ix, iy) >> res:
            return None
        return self.cell(by * COLUMNS + bx, ix, iy, res)

    def cover(self, wkb: bytes, target_cells: int = 100, min_resolution: int = 5, max_resolution: int = 13, mode: ContainmentMode = ContainmentMode.OVERLAP) -> tuple[list[int], int]:
        """Cells at the finest resolution in [min, max] that has at most ``target_cells`` of them, else at min."""
        from .functions.geometry import read_wkb

        shape = read_wkb(wkb)
        level = self.roots(shape, min_resolution)
        best = self.select(shape, level, min_resolution, mode), min_resolution
        for res in range(min_resolution + 1, max_resolution + 1):
            # Whole cells stay whole below, so only those on the boundary are tested again.
            level = [(b, 2 * ix + dx, 2 * iy + dy, full or None) for b, ix, iy, full in level for dx in (0, 1) for dy in (0, 1)]
            level = self.classify(shape, level, res)
            cells = self.select(shape, level, res, mode)
            if len(cells) > target_cells:
                break
            best = cells, res
        return best

    def adaptive(self, wkb: bytes, min_resolution: int, max_resolution: int) -> list[tuple[int, bool]]:
        """Mixed cover of a polygon: (cell, True) for cells wholly inside, (cell, False) for boundary cells at max_resolution."""
        from .functions.geometry import read_wkb

        shape = read_wkb(wkb)
        level, out = self.roots(shape, min_resolution), []
        for res in range(min_resolution, max_resolution + 1):
            out += [(self.cell(b, ix, iy, res), True) for b, ix, iy, full in level if full]
            edge = [x for x in level if not x[3]]
            if res == max_resolution:
                return out + [(self.cell(b, ix, iy, res), False) for b, ix, iy, _ in edge]
            level = self.classify(shape, [(b, 2 * ix + dx, 2 * iy + dy, None) for b, ix, iy, _ in edge for dx in (0, 1) for dy in (0, 1)], res + 1)
        return out

    def roots(self, shape, res: int) -> list[tuple[int, int, int, bool | None]]:
        x0, y0, x1, y1 = shape.bounds()
        s, out = self.side(res), []
        for by in range(max(0, int((y0 - NORTH0) // STEP)), int((y1 - NORTH0) // STEP) + 1):
            for bx in range(max(0, int((x0 - EAST0) // STEP)), min(COLUMNS - 1, int((x1 - EAST0) // STEP)) + 1):
                if by * COLUMNS + bx > 127:
                    continue
                ox, oy, n = EAST0 + bx * STEP, NORTH0 + by * STEP, (1 << res) - 1
                for ix in range(max(0, int((x0 - ox) // s)), min(n, int((x1 - ox) // s)) + 1):
                    for iy in range(max(0, int((y0 - oy) // s)), min(n, int((y1 - oy) // s)) + 1):
                        out.append((by * COLUMNS + bx, ix, iy, None))
        return self.classify(shape, out, res)

    def classify(self, shape, level, res: int):
        """Drops cells that miss the shape and marks those wholly inside."""
        if not level:
            return []
        s = self.side(res)
        b, ix, iy = (np.array([x[i] for x in level]) for i in range(3))
        x, y = EAST0 + STEP * (b % COLUMNS) + ix * s, NORTH0 + STEP * (b // COLUMNS) + iy * s
        known = np.array([x[3] is True for x in level])
        touch, full = known.copy(), known.copy()
        todo = ~known
        if todo.any():
            touch[todo], full[todo] = shape.relate(x[todo], y[todo], s)
        return [(int(b[i]), int(ix[i]), int(iy[i]), bool(full[i])) for i in np.flatnonzero(touch)]

    def select(self, shape, level, res: int, mode: ContainmentMode) -> list[int]:
        if mode == ContainmentMode.FULL:
            level = [x for x in level if x[3]]
        elif mode == ContainmentMode.CENTER and level:
            s = self.side(res)
            b, ix, iy = (np.array([x[i] for x in level]) for i in range(3))
            inside = shape.contains(EAST0 + STEP * (b % COLUMNS) + (ix + 0.5) * s, NORTH0 + STEP * (b // COLUMNS) + (iy + 0.5) * s)
            level = [x for x, k in zip(level, inside) if k]
        return sorted(self.cell(b, ix, iy, res) for b, ix, iy, _ in level)
