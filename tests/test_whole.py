"""Queries over the whole of their tables, against brute force on small ones."""

import random

import numpy as np
import pytest
from test_cells import wkb_point, wkb_polygon

from cellweave import PlanarGrid
from cellweave.functions.geometry import read_wkb
from cellweave.operators.association import compute_all
from cellweave.plans import queries as Q

G = PlanarGrid()
RES = 52


def up(cell, r):
    return cell & ~(15 << 52) | r << 52 | (1 << (15 - r) * 3) - 1


def above(cell):
    """The proper ancestors."""
    return {up(cell, r) for r in range(cell >> RES & 15)}


def multires(tmp_path, spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        cells = [G.cell(4, rng.randrange(16) * 2 ** (r - 9) if r >= 9 else 0, rng.randrange(4) * 2 ** (r - 9) if r >= 9 else 0, r) for r in rng.choices((8, 9, 10, 11, 13), k=rng.randrange(4))]
        rows.append((i, rng.choice(["Grat", "Bach", "Turm", "Weiler", "Ödland", None]), cells + [None] * (i % 7 == 0)))
    rows += [(200, "Turm", None), (201, "leer", [])]
    spark.createDataFrame(rows, "feature_id long, OBJEKTART string, h3_cells array<bigint>").write.parquet(f"{tmp_path}/features.parquet")
    sets = {}
    for _, k, cells in rows:
        if k is not None:
            sets.setdefault(k, set()).update(c for c in cells or [] if c is not None)
    return {k: {c for c in v if not above(c) & v} for k, v in sets.items()}


def test_union_and_intersection_of_all_categories(spark, tmp_path):
    sets = multires(tmp_path, spark)
    union = [tuple(r) for r in Q.queries()["multires_union"](spark, str(tmp_path)).collect()]
    assert sorted(union) == sorted((k, c) for k, v in sets.items() for c in v) and len({k for k, _ in union}) == 5
    got = [tuple(r) for r in Q.queries()["multires_intersection"](spark, str(tmp_path)).collect()]
    want = [(a, b, c, at != c) for a in sets for b in sets if a != b for c in sets[a] for at in {c, *above(c)} & sets[b]]
    assert sorted(got) == sorted(want) and {x[3] for x in want} == {True, False} and len({x[:2] for x in want}) > 6


def test_pivot_of_all_categories(spark, tmp_path):
    sets = multires(tmp_path, spark)
    got = Q.queries()["matrix_pivot"](spark, str(tmp_path))
    assert got.columns == ["cat_a", *sorted([*sets])]
    want = {(r.cat_a, r.cat_b): r.b1 for r in compute_all(spark.read.parquet(f"{tmp_path}/features.parquet")).collect()}
    rows = {r.cat_a: r for r in got.collect()}
    assert len(want) == len(sets) ** 2 and all(rows[a][b] == (v if v is None else pytest.approx(v, abs=1e-6)) for (a, b), v in want.items())


def test_locations_in_all_polygons(spark, tmp_path):
    rng = random.Random(7)

    def ring(x, y, r):
        a = [(x + rng.uniform(0.3, 1) * r * np.cos(k / 9 * 2 * np.pi), y + rng.uniform(0.3, 1) * r * np.sin(k / 9 * 2 * np.pi)) for k in range(9)]
        return [(float(x), float(y)) for x, y in [*a, a[0]]]

    shapes = [wkb_polygon([ring(2_701_000 + rng.uniform(-900, 900), 1_001_000 + rng.uniform(-900, 900), rng.choice([200, 1500]))]) for _ in range(12)]
    raw = [(f"u{k}", "x", "Wald", g, "namen_fl") for k, g in enumerate([*shapes, shapes[0], wkb_point(2_701_000, 1_001_000), b"bad", None])]
    spark.createDataFrame(raw, "UUID string, NAME string, OBJEKTART string, geometry binary, source string").write.parquet(f"{tmp_path}/raw_features.parquet")
    at = {i: G.cell(1, rng.randrange(64), rng.randrange(64), 13) for i in range(300)}
    spark.createDataFrame([(i, "Turm", [c]) for i, c in at.items()] + [(900, "Turm", None), (901, "Turm", [G.cell(1, 0, 0, 12)])], "feature_id long, OBJEKTART string, h3_cells array<bigint>").write.parquet(f"{tmp_path}/features.parquet")
    ids = {r.UUID: r.feature_id for r in Q.queries()["feature_ids"](spark, str(tmp_path)).collect()}
    own = {i: [G.box(c)[k] + 16 for k in (0, 1)] for i, c in at.items()}
    x, y = (np.array([p[k] for p in own.values()]) for k in (0, 1))
    want = sorted((i, ids[u]) for u, _, _, g, _ in raw[:13] for i, k in zip(own, read_wkb(g).contains(x, y)) if k)
    got = [tuple(r) for r in Q.queries()["p4_inside_polygons"](spark, str(tmp_path)).select("feature_id", "region_id").collect()]
    assert sorted(got) == want and len(want) > 100


def test_candidates_of_all_documents(spark, tmp_path):
    feats = [(i, f"u{i % 9}" if i % 5 else None, f"n{i % 4}", "Turm", [G.cell(4, i % 3, 0, 11)]) for i in range(24)]
    rng = random.Random(8)
    cands = [(k, rng.randrange(60), rng.randrange(2), f"n{rng.randrange(5)}", rng.choice([f"u{rng.randrange(12)}", None]), rng.choice([0.2, 0.5, 0.9, None])) for k in range(120)]
    spark.createDataFrame(feats, "feature_id long, UUID string, NAME string, OBJEKTART string, h3_cells array<bigint>").write.parquet(f"{tmp_path}/features.parquet")
    spark.createDataFrame(cands, "candidate_id long, doc_id long, ref_idx int, mention string, location_id_value string, similarity double").write.parquet(f"{tmp_path}/candidates.parquet")
    refs, has = {}, set()
    for _, d, r, m, u, s in cands:
        refs[d, r, m] = refs.get((d, r, m), False) or bool(u and s and s >= 0.6)
        has.add((d, r, u))
    want = [(d, r, u, i) for (d, r, m), done in refs.items() if not done for i, u, n, *_ in feats if n == m and (u is None or (d, r, u) not in has)]
    got = [tuple(x) for x in Q.queries()["gather_candidates"](spark, str(tmp_path)).select("doc_id", "ref_idx", "UUID", "feature_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({x[0] for x in want}) > 20
    first = {}
    for i, u, *_ in feats:
        if u:
            first.setdefault(u, i)
    rows = Q.queries()["description_fallback"](spark, str(tmp_path)).collect()
    assert {(r.candidate_id, r.feature_id) for r in rows} == {(k, first.get(u)) for k, _, _, _, u, _ in cands} and len(rows) == 120
    assert all(r.description == cands[r.candidate_id][3] for r in rows if r.feature_id is None) and all(r.description.startswith(f"n{r.feature_id % 4}, Turm") for r in rows if r.feature_id is not None)
