import random
import struct

import pytest
from pyspark.sql import functions as F
from test_cells import wkb_point, wkb_polygon

from cellweave import BuildConfig, PlanarGrid, default_preset
from cellweave.config import resolve_config
from cellweave.operators import nearby as N
from cellweave.operators import skew as K
from cellweave.operators.association import compute_all
from cellweave.plans.build import build
from cellweave.sources import gazetteer as GZ
from cellweave.sources import matrix as M
from cellweave.sources import store as ST

G = PlanarGrid()


@pytest.mark.parametrize("crowd, split", [(N.CROWD, 2), (0, 2), (3, 1), (2, 3)])
def test_near_against_brute_force(spark, crowd, split):
    rng = random.Random(1)
    pts = [(i, rng.uniform(0, 1500), rng.uniform(0, 1500)) for i in range(400)] + [(900, 10.0, 10.0), (901, 10.0, 10.0), (901, 10.0, 10.0), (902, 110.0, 10.0), (903, None, 1.0)]
    got = sorted(tuple(r) for r in N.near(spark.createDataFrame(pts, "id long, x double, y double"), 100, split=split, crowd=crowd).collect())
    own = {i: (x, y) for i, x, y in pts if x is not None}
    want = sorted((a, b) for a in own for b in own if a < b and (own[a][0] - own[b][0]) ** 2 + (own[a][1] - own[b][1]) ** 2 <= 10_000)
    assert got == want and (900, 901) in got and (900, 902) in got


def test_inside_polygons(spark):
    hole = [[(2_500_000.0, 1_100_000.0), (2_502_000.0, 1_100_000.0), (2_502_000.0, 1_102_000.0), (2_500_000.0, 1_102_000.0), (2_500_000.0, 1_100_000.0)], [(2_500_500.0, 1_100_500.0), (2_500_900.0, 1_100_500.0), (2_500_700.0, 1_100_911.0), (2_500_500.0, 1_100_500.0)]]
    rng = random.Random(2)
    pts = [(i, rng.uniform(2_499_000, 2_503_000), rng.uniform(1_099_000, 1_103_000)) for i in range(600)]
    from cellweave.functions.geometry import read_wkb
    import numpy as np

    k = read_wkb(wkb_polygon(hole)).contains(np.array([p[1] for p in pts]), np.array([p[2] for p in pts]))
    polys = spark.createDataFrame([(7, wkb_polygon(hole)), (8, b"junk"), (9, None)], "region_id long, wkb binary")
    got = {tuple(r) for r in N.inside_polygons(spark.createDataFrame(pts, "id long, x double, y double"), polys).collect()}
    assert got == {(p[0], 7) for p, x in zip(pts, k) if x}


def test_near_or_inside(spark):
    c = lambda x, y, r=13: G.cell(4, x, y, r)
    rows = [(1, "Turm", [c(0, 0)]), (2, "Turm", [c(3, 0), c(3, 0)]), (3, "Turm", [c(3, 1)]), (4, "Turm", [c(3, 3), c(3, 4)]), (5, "Gemeindegebiet", [c(0, 0, 11), c(9, 9, 11)]), (6, None, None), (7, "Turm", []), (8, "Turm", [c(1, 1, 12)]), (9, "Gemeindegebiet", [c(3, 1)])]
    got = {tuple(r) for r in N.near_or_inside(spark.createDataFrame(rows, "feature_id long, OBJEKTART string, h3_cells array<long>")).collect()}
    near = {("near", a, b) for a, b in [(1, 2), (2, 3), (2, 9), (3, 9)]}
    assert got == near | {("inside", 1, 5), ("inside", 2, 5), ("inside", 3, 5), ("inside", 5, 9), ("inside", 3, 9)}
    assert N.near_or_inside(spark.createDataFrame([], "feature_id long, OBJEKTART string, h3_cells array<long>")).count() == 0


def test_skewed_keys_are_split(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("OBJEKTART"), F.col("id").alias("feature_id"), (F.col("id") % 4).cast("int").alias("h3_cell_count"), F.lit(1).alias("objektart2"))
    parts = K.range_split(df, ["OBJEKTART"], ["feature_id"], 8)
    most = max(r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect())
    assert most < 5_000
    load = K.category_load(df)
    got = {r.objektart: (r.n_rows, r.sum_cells, r.max_cells) for r in load.collect()}
    assert got["hot"][0] == 14_000 and got[None][0] == 2_000 and sum(v[0] for v in got.values()) == 20_000
    assert [r.objektart for r in K.heavy(load).collect()] == ["hot"]
    assert K.category_load(df.limit(0)).count() == 0


def test_config(tmp_path):
    c = BuildConfig.for_gazetteer("swissnames3d")
    assert [s.label for s in c.sentence.static_slots] == ["Gemeinde", "Bezirk", "Kanton"] and c.total_area_resolution == 10
    assert [s.label for s in default_preset().static_slots] == ["Gemeinde", "Kanton", "Bezirk"]
    with pytest.raises(FileNotFoundError, match="swissnames3d"):
        BuildConfig.for_gazetteer("nowhere")
    with pytest.raises(FileNotFoundError):
        BuildConfig.from_yaml(tmp_path / "none.yaml")
    (tmp_path / "c.yaml").write_text("static_slots: [{objektart: X}]\nsentence_generator: {max_slots: 3}\n")
    own = BuildConfig.from_yaml(tmp_path / "c.yaml")
    assert own.gazetteer == "" and own.sentence.static_slots[0].label == "X" and own.sentence.max_slots == 3
    assert c.resolve_output_path("/a") .as_posix() == "/a/spatial_store"
    assert resolve_config(own.sentence, None, "swissnames3d") is own.sentence and resolve_config(None, None, "nowhere") == default_preset()


def test_build_and_matrix_roundtrip(spark, tmp_path):
    spark.createDataFrame([(1, "tiny")], "id long, name string").write.parquet(f"{tmp_path}/gazetteer.parquet")
    spark.createDataFrame([(1, "pts", "PID", 1), (2, "gone", "X", 1), (3, "other", "X", 2)], "id long, name string, location_id_name string, gazetteer_id long").write.parquet(f"{tmp_path}/gaz_source.parquet")
    box = [(2_500_000.0, 1_100_000.0), (2_501_000.0, 1_100_000.0), (2_501_000.0, 1_101_000.0), (2_500_000.0, 1_100_000.0)]
    rows = [(5, "P", "Turm", wkb_point(2_500_900, 1_100_100)), (6, "Q", "Turm", b"\x00bad"), (7, None, None, None), (8, "A", "Gemeindegebiet", wkb_polygon([box])), (9, "Ä", "Ödland", struct.pack(">BIdd", 0, 1, 2_500_900, 1_100_100))]
    spark.createDataFrame(rows, "PID long, NAME string, OBJEKTART string, geometry binary").write.parquet(f"{tmp_path}/pts.parquet")
    out = build(spark, BuildConfig("tiny"), tmp_path, tmp_path / "store")
    t = ST.open_store(spark, out)
    assert sorted(r.feature_id for r in t["features"].collect()) == [0, 1, 2] and {r.UUID for r in t["features"].collect()} == {"5", "8", "9"}
    back = {(r.cat_a, r.cat_b): r.b1 for r in M.read_csv(spark, out / "b1_matrix.csv").collect()}
    want = {(r.cat_a, r.cat_b): r.b1 for r in compute_all(t["features"]).collect()}
    assert back.keys() == want.keys() and all(back[k] == pytest.approx(want[k]) for k in want if want[k] is not None)
    with pytest.raises(ValueError):
        build(spark, BuildConfig("nothing"), tmp_path, tmp_path / "s2")
    with pytest.raises(FileNotFoundError):
        build(spark, BuildConfig("tiny"), tmp_path / "absent")
    with pytest.raises(FileNotFoundError):
        M.read_csv(spark, tmp_path / "no.csv")


def test_matrix_in_latin1(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(";Ödland;Grat\nÖdland;0.5;x\nGrat;0.25;\n".encode("latin-1"))
    assert {tuple(r) for r in M.read_csv(spark, tmp_path / "m.csv").collect()} == {("Ödland", "Ödland", 0.5), ("Ödland", "Grat", None), ("Grat", "Ödland", 0.25), ("Grat", "Grat", None)}


def test_dense_ids(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = sorted((r.v, r.feature_id) for r in GZ.dense_ids(df, ["v"]).collect())
    assert got == [(i, i) for i in range(1000)] and GZ.dense_ids(df.limit(0), ["v"]).count() == 0


def test_extra_columns_with_names_of_our_own(spark):
    odd = ["a", "b", "i", "j", "ax", "ay", "bx", "by", "x2", "own", "inside", "level", "full", "cell", "region_id", "interior", "objektart", "n", "n_rows", "wkb2"]

    def more(df):
        return df.withColumns({n: F.lit(1) for n in odd if n not in df.columns})

    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 60.0, 60.0), (3, 0.0, 0.0), (4, 500.0, 0.0), (None, None, 1.0)], "id long, x double, y double")
    assert {tuple(r) for r in N.near(more(pts), 100).collect()} == {(1, 2), (1, 3), (2, 3)}
    c = G.cell(4, 0, 0, 13)
    f = spark.createDataFrame([(1, "Turm", [c], 1), (2, "Turm", [c, None], 2), (3, "Gemeindegebiet", [G.cell(4, 0, 0, 11)], 1), (4, None, None, None)], "feature_id long, OBJEKTART string, h3_cells array<long>, h3_cell_count int")
    wide = f.withColumns({n: F.lit(1) for n in odd if n != "objektart"})
    assert {tuple(r) for r in N.near_or_inside(wide).collect()} == {("near", 1, 2), ("inside", 1, 3), ("inside", 2, 3)}
    assert {tuple(r) for r in K.category_load(wide).collect()} == {("Turm", 2, 3, 2), ("Gemeindegebiet", 1, 1, 1), (None, 1, None, None)}
    box = wkb_polygon([[(2_500_000.0, 1_100_000.0), (2_501_000.0, 1_100_000.0), (2_501_000.0, 1_101_000.0), (2_500_000.0, 1_101_000.0), (2_500_000.0, 1_100_000.0)]])
    polys = spark.createDataFrame([(7, box)], "region_id long, wkb binary").withColumn("x", F.lit(1))
    at = spark.createDataFrame([(1, 2_500_500.0, 1_100_500.0), (1, 2_500_500.0, 1_100_500.0), (2, 2_500_999.0, 1_100_999.0), (3, 2_501_001.0, 1_100_500.0), (4, None, None)], "id long, x double, y double").withColumn("wkb", F.lit("w"))
    assert sorted(tuple(r) for r in N.inside_polygons(at, polys).collect()) == [(1, 7), (2, 7)]
    assert N.inside_polygons(at.limit(0), polys).count() == 0 and N.inside_polygons(at, polys.limit(0)).count() == 0
