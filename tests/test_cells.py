import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import ContainmentMode, PlanarGrid
from cellweave.functions import cells as C
from cellweave.functions.geometry import read_wkb
from cellweave.operators import cellsets as S

FINE, COARSE = 622054503267303423, 608543704398954495


def wkb_polygon(rings):
    import struct

    out = struct.pack("<BII", 1, 3, len(rings))
    for r in rings:
        out += struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r)
    return out


def wkb_point(x, y):
    import struct

    return struct.pack("<BIdd", 1, 1, x, y)


def test_parent_and_resolution(spark):
    df = spark.createDataFrame([(FINE,), (None,)], "cell long")
    rows = df.select(C.resolution("cell").alias("r"), C.parent("cell", 7).alias("p"), C.parent("cell", 12).alias("none"), C.area_m2("cell").alias("a")).collect()
    assert (rows[0].r, rows[0].p, rows[0].none, rows[0].a) == (10, COARSE, None, 1024 * 4**3)
    assert tuple(rows[1]) == (None, None, None, None)


def test_from_text(spark):
    df = spark.createDataFrame([("8a1fb46622dffff",), (str(FINE),), ("junk!",), (None,)], "t string")
    assert [r[0] for r in df.select(C.from_text("t")).collect()] == [FINE, FINE, None, None]


def test_parent_of_parent_is_parent(spark):
    g, rng = PlanarGrid(), random.Random(1)
    cells = [(g.cell(rng.randrange(128), rng.randrange(1 << 13), rng.randrange(1 << 13), 13),) for _ in range(200)]
    df = spark.createDataFrame(cells, "cell long")
    assert df.where(C.parent(C.parent("cell", 9), 4) != C.parent("cell", 4)).count() == 0


def test_grid_positions_agree(spark):
    g, rng = PlanarGrid(), random.Random(2)
    xy = [(2_400_000 + 300_000 * rng.randrange(11) + rng.uniform(0, 262_143), 1_000_000 + 300_000 * rng.randrange(10) + rng.uniform(0, 262_143)) for _ in range(300)]
    df = spark.createDataFrame(xy, "x double, y double").withColumn("c", C.at(F.col("x"), F.col("y"), 13))
    gx, gy = C.grid_xy("c")
    for r in df.select("x", "y", "c", (gx * 32).alias("gx"), (gy * 32).alias("gy")).collect():
        assert r.c == g.at(r.x, r.y, 13)
        ex, ny, s = g.box(r.c)
        assert (r.gx, r.gy) == (ex - 2_400_000, ny - 1_000_000) and 0 <= r.x - ex < s and 0 <= r.y - ny < s
    outside = spark.createDataFrame([(0.0, 0.0), (2_400_000 + 270_000.0, 1_000_001.0)], "x double, y double").select(C.at(F.col("x"), F.col("y"), 13))
    assert [r[0] for r in outside.collect()] == [None, None]


def test_union_is_canonical_and_areas_add_up(spark):
    g, rng = PlanarGrid(), random.Random(3)
    rows = []
    for k in "ab":
        for _ in range(60):
            r = rng.randrange(8, 12)
            rows.append((k, g.cell(4, rng.randrange(1 << r) >> r - 3, rng.randrange(1 << r) >> r - 3, r)))
    df = spark.createDataFrame(rows + [("a", None)], "k string, cell long")
    cover = S.canonical(df, ["k"])
    assert {tuple(r) for r in S.canonical(cover, ["k"]).collect()} == {tuple(r) for r in cover.collect()}
    area = {r.k: r.area_m2 for r in S.area(cover, ["k"]).collect()}
    union = S.area(S.canonical(df)).first()[0]
    both = {(r.key_a, r.key_b): r.shared_m2 for r in S.pair_area(cover, "k").collect()}
    assert both["a", "b"] == both["b", "a"] and union + both["a", "b"] == area["a"] + area["b"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, cell long")
    assert S.canonical(none, ["k"]).count() == 0 and S.area(S.canonical(none)).first()[0] == 0 and S.total_area(none).first()[0] == 0


def test_lookup_drops_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, [FINE, FINE, None, COARSE]), (2, []), (3, None)], "feature_id long, h3_cells array<long>")
    assert {tuple(r) for r in S.lookup(df).collect()} == {(1, FINE, 10), (1, COARSE, 7)}


@pytest.mark.parametrize("bad", [b"", b"\x01", b"\x02\x00\x00\x00\x00", wkb_point(1, 2)[:-1], wkb_point(float("nan"), 2), b"\x01\x63\x00\x00\x00"])
def test_unreadable_geometry(bad):
    with pytest.raises(ValueError):
        read_wkb(bad)


def test_cover_against_brute_force():
    g = PlanarGrid()
    ring = [(2_500_100.0, 1_100_050.0), (2_503_777.0, 1_100_900.0), (2_502_000.0, 1_104_321.0), (2_500_100.0, 1_100_050.0)]
    shape = read_wkb(wkb_polygon([ring]))
    cells, res = g.cover(wkb_polygon([ring]))
    assert len(cells) <= 100 and len(set(cells)) == len(cells) and all(c >> 52 & 15 == res for c in cells)
    xs, ys = np.random.default_rng(0).uniform([2_500_000, 1_100_000], [2_504_000, 1_105_000], (4000, 2)).T
    inside = shape.contains(xs, ys)
    assert {g.at(x, y, res) for x, y in zip(xs[inside], ys[inside])} <= set(cells)
    full = set(g.cover(wkb_polygon([ring]), mode=ContainmentMode.FULL)[0])
    for x, y, k in zip(xs, ys, inside):
        if g.at(x, y, g.cover(wkb_polygon([ring]), mode=ContainmentMode.FULL)[1]) in full:
            assert k
    mixed = g.adaptive(wkb_polygon([ring]), 5, 11)
    area = sum(1024 * 4 ** (13 - (c >> 52 & 15)) for c, k in mixed if k)
    assert 0.7 < area / (0.5 * abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])))) <= 1


def test_point_cover():
    cells, res = PlanarGrid().cover(wkb_point(2_500_000, 1_100_000))
    assert len(cells) == 1 and res == 13
