"""Joins with far more rows than their sides, and what they shuffle."""

import random

import pytest

from cellweave import PlanarGrid
from cellweave.operators import pairs as P
from cellweave.plans import queries as Q

G = PlanarGrid()


def shuffled(df):
    """Rows of df, and the records that its last plan wrote to shuffles."""
    rows, plans, n = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            plans.append(p.plan())
        if kind == "ShuffleExchangeExec":
            n += p.metrics().apply("shuffleRecordsWritten").value()
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return rows, n


@pytest.fixture
def large(spark):
    """Tables are taken for ones too large to be sent to every executor."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_are_a_join(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 50)
    monkeypatch.setattr(P, "BLOCK", 4)
    rng = random.Random(9)
    key = lambda: rng.choice(["a", "a", "a", "b", "c", "", None])
    many, few = [(key(), i // 2) for i in range(90)], [(key(), i // 2, [f"x{i}"] if i % 3 else None) for i in range(40)]
    few.append(("only few", 1, []))
    got = P.pairs(spark.createDataFrame(many, "k string, i int"), spark.createDataFrame(few, "k string, j int, held array<string>"), "k").collect()
    want = [(k, i, j, h) for k, i in many for q, j, h in few if k is not None and k == q]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 500
    alone = P.pairs(spark.createDataFrame(many, "k string, i int"), spark.createDataFrame([(k, h and h[0]) for k, _, h in few if h != []], "k string, x string"), "k").collect()
    assert sorted(map(tuple, alone), key=str) == sorted([(k, i, h and h[0]) for k, i, _, h in want], key=str) and any(h is None for *_, h in want)


def test_candidates_are_not_shuffled(spark, large, tmp_path):
    """A name of very many features and references: 60,000 pairs out of 500 rows."""
    feats = [(i, f"u{i}", "Grossmöttel") for i in range(300)]
    cands = [(k, k, 0, "Grossmöttel", f"u{k}", 0.1) for k in range(200)]
    spark.createDataFrame(feats, "feature_id long, UUID string, NAME string").write.parquet(f"{tmp_path}/features.parquet")
    spark.createDataFrame(cands, "candidate_id long, doc_id long, ref_idx int, mention string, location_id_value string, similarity double").write.parquet(f"{tmp_path}/candidates.parquet")
    rows, n = shuffled(Q.gather_candidates(spark, str(tmp_path)))
    assert sorted((r.doc_id, r.feature_id) for r in rows) == [(d, i) for d in range(200) for i in range(300) if d != i]
    assert n < 5_000


def test_overlaps_are_not_shuffled(spark, large, tmp_path):
    """Sources with the same cells as very many features: 20 times 1,000 pairs, and some inside a larger cell."""
    here, fine, coarse = (G.cell(4, 0, 0, r) for r in (9, 11, 7))
    cells = {i: [here] for i in range(1000)} | {1000: [fine], 1001: [coarse], 1050: [fine, fine], 1051: [G.cell(4, 500, 500, 9)], 1100: None}
    rows = [(i, f"n{i}", None if i == 7 else f"k{i % 3}", c) for i, c in cells.items()]
    spark.createDataFrame(rows, "feature_id long, NAME string, OBJEKTART string, h3_cells array<bigint>").write.parquet(f"{tmp_path}/features.parquet")
    near = {i: {j for j in cells if cells[j] and j not in (i, 1051)} for i in (*range(0, 1000, 50), 1000, 1050)}
    rows, n = shuffled(Q.intersecting_features(spark, str(tmp_path)))
    area = {here: 1024 << 8, fine: 1024 << 4, coarse: 1024 << 12}
    want = sorted((i, j, "-" if j == 7 else f"k{j % 3}", min(area[cells[i][0]], area[cells[j][0]])) for i, js in near.items() for j in js)
    assert sorted((r.src_id, r.feature_id, r.OBJEKTART or "-", r.shared_m2) for r in rows) == want and len(want) > 20_000
    assert n < 20_000
