import math
import random

import pytest
from pyspark.sql import functions as F

from cellweave import SentenceConfig, StaticSlot
from cellweave.operators import association as A
from cellweave.operators import context as X
from cellweave.operators import resolve as R
from cellweave import PlanarGrid

G = PlanarGrid()
ONE, FAR = G.cell(4, 5, 5, 13), G.cell(4, 900, 900, 13)
ROWS = [
    (0, "u0", "Matterhorn", "Alpiner Gipfel"), (1, "u1", "Zmuttgrat", "Grat"), (2, "u2", "Hoernligrat", "Grat"), (3, "u3", "Theodulstrasse", "Strasse"),
    (4, "u4", "Zermatt", "Gemeindegebiet"), (5, "u5", "Wallis", "Kanton"), (6, "u1", "Zmuttgrat", "Grat"), (7, None, "Ohne", "Grat"), (8, "u8", None, "Strasse"),
    (9, "u9", "", "Weiler"), (10, "u10", "Fern", "Weiler"),
]
CFG = SentenceConfig(static_slots=(StaticSlot("Gemeindegebiet", "Gemeinde", 2), StaticSlot("Bezirk"), StaticSlot("Kanton")))
GOLDEN = "Matterhorn, Alpiner Gipfel, bei Zmuttgrat und Hoernligrat, Grat, Theodulstrasse, Strasse, in Zermatt, Gemeinde, Wallis, Kanton"


def features(spark, ids):
    rows = [(*r, [FAR if r[0] == 10 else ONE]) for r in ROWS if r[0] in ids]
    return spark.createDataFrame(rows, "feature_id long, UUID string, NAME string, OBJEKTART string, h3_cells array<long>")


def matrix(spark):
    b1 = {"Grat": 0.3, "Gemeindegebiet": 0.25, "Strasse": 0.2, "Weiler": 0.0005, "Kanton": float("nan")}
    return spark.createDataFrame([("Alpiner Gipfel", k, v) for k, v in b1.items()], "cat_a string, cat_b string, b1 double")


def run(spark, ids, cfg=CFG, src=0):
    f = features(spark, ids)
    return R.sentences(X.sources_of(f.where(F.col("feature_id") == src)), f, matrix(spark), cfg).first()


def test_golden_sentence(spark):
    r = run(spark, range(6))
    assert r.sentence == GOLDEN and r.categories_used == ["Grat", "Strasse"] and [x.key for x in r.static_context] == ["Gemeinde", "Kanton"]


def test_repeated_uuid_costs_one_slot(spark):
    assert "bei Zmuttgrat, Hoernligrat und Zmuttgrat, Grat" in run(spark, range(7)).sentence
    cfg = SentenceConfig(max_slots_per_category=1)
    assert "bei Zmuttgrat und Zmuttgrat, Grat" in run(spark, range(7), cfg).sentence


def test_null_uuid_and_null_name(spark):
    assert "Ohne, Grat" in run(spark, [*range(6), 7]).sentence
    assert run(spark, [*range(6), 8]).sentence == GOLDEN


def test_no_context(spark):
    assert run(spark, range(11), src=10).sentence == "Fern, Weiler"
    assert run(spark, range(11), SentenceConfig(), src=9).sentence == "Weiler"


def test_filler(spark):
    r = run(spark, range(6), SentenceConfig(max_slots=3, max_slots_per_category=1, max_filler_slots=3))
    assert r.sentence == "Matterhorn, Alpiner Gipfel, bei Zmuttgrat, Grat, Zermatt, Gemeindegebiet, Theodulstrasse, Strasse"
    r = run(spark, range(6), SentenceConfig(max_slots=4, max_slots_per_category=1, max_categories=1, max_filler_slots=2))
    assert r.sentence == "Matterhorn, Alpiner Gipfel, bei Zmuttgrat, Grat, nahe Hoernligrat, Grat, Theodulstrasse, Strasse"


@pytest.mark.parametrize("pa, pb, pab, want", [(0.5, 0.5, 0.25, 0), (0.1, 0.1, 0.1, 1), (0.2, 0.5, 0, -1), (1, 1, 1, 0), (0.2, 0.4, 0.1, 0.096910), (0, 0, 0, -1)])
def test_npmi(spark, pa, pb, pab, want):
    df = spark.createDataFrame([(float(pa), float(pb), float(pab))], "a double, b double, ab double")
    assert df.select(A.npmi(F.col("a"), F.col("b"), F.col("ab"))).first()[0] == pytest.approx(want, abs=1e-6)


def test_scores(spark):
    areas = spark.createDataFrame([("a", 200), ("b", 400)], "category string, area_m2 long")
    pairs = spark.createDataFrame([("a", "b", 100), ("b", "a", 100)], "key_a string, key_b string, shared_m2 long")
    got = {(r.cat_a, r.cat_b): r for r in A.scores(areas, pairs, 1000, ["a", "b", "c"]).collect()}
    r, s = got["a", "b"], got["b", "a"]
    assert [round(x, 6) for x in (r.npmi, r.b1, r.b2, s.b1, s.b2)] == [0.09691, 0.064607, 0.048455, 0.032303, 0.024228]
    assert got["c", "c"].npmi == -1 and got["a", "a"].b1 == 0.5 and got["c", "a"].b2 == 0
    with pytest.raises(ValueError):
        A.scores(areas, pairs, 0, ["a"])


def test_matrix_is_symmetric_and_bounded(spark):
    rng = random.Random(4)
    rows = [(i, f"c{i % 5}", [G.cell(4, rng.randrange(8), rng.randrange(8), 13) for _ in range(3)] if i % 3 else [G.cell(4, rng.randrange(4), rng.randrange(4), 11)]) for i in range(40)] + [(99, None, [ONE]), (98, "c1", None)]
    m = A.compute_all(spark.createDataFrame(rows, "feature_id long, OBJEKTART string, h3_cells array<long>"))
    got = {(r.cat_a, r.cat_b): r.npmi for r in m.collect()}
    assert len(got) == 25 and all(-1 <= v <= 1 and got[b, a] == pytest.approx(v) for (a, b), v in got.items())


def loop(rows, order, cfg):
    """The budget as a loop: rows (cat, uuid, name) in result order."""
    left, out = cfg.max_slots, []
    for c in order:
        if left <= 0:
            break
        k, own = min(cfg.max_slots_per_category, left), [r for r in rows if r[0] == c]
        seen = list(dict.fromkeys(u for _, u, _ in own))[:k]
        out += [(c, n) for _, u, n in own if u in seen]
        left -= len(seen)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_allocation_equals_loop(spark, seed):
    rng = random.Random(seed)
    cfg = SentenceConfig(max_slots=rng.choice([0, 3, 7, 10]), max_slots_per_category=rng.choice([1, 2, 5]))
    rows = [(1, "s", i, rng.choice("abcd"), rng.choice([None, "u1", "u2", "u3", f"v{i}"]), f"n{i}", rng.randrange(3)) for i in range(10, 60)]
    near = spark.createDataFrame(rows, "src_id long, src_cat string, feature_id long, OBJEKTART string, UUID string, NAME string, shared_m2 long").withColumn("own_m2", F.lit(1))
    order = rng.sample("abcd", 3)
    assoc = spark.createDataFrame([("s", c, i + 1) for i, c in enumerate(order)], "cat_a string, cat_b string, assoc_rank int")
    want = loop([(r[3], r[4], r[5]) for r in sorted(rows, key=lambda r: (-r[6], r[2]))], order, cfg)
    assert sorted((r.OBJEKTART, r.NAME) for r in X.allocate(near, assoc, cfg).collect()) == sorted(want)


def test_same_label_twice(spark):
    near = X.neighbours(X.sources_of(features(spark, [0, 4, 5]).where("feature_id = 0")), features(spark, [0, 4, 5]))
    got = X.static_context(near, (StaticSlot("Gemeindegebiet", "Ort"), StaticSlot("Kanton", "Ort"))).first()
    assert [(x.key, x.names) for x in got.static_context] == [("Ort", ["Wallis"])]


def test_proportional_rounds_half_to_even(spark):
    assoc = spark.createDataFrame([("s", "a", 0.25), ("s", "b", 0.75), ("t", "a", -1.0)], "cat_a string, cat_b string, b1 double")
    assert {tuple(r) for r in A.proportional_slots(assoc, 10, 9).collect()} == {("s", "a", 2), ("s", "b", 8)}
    assert math.isclose(round(2.5), 2)


def test_resolver(spark):
    f = features(spark, range(7))
    c = spark.createDataFrame([(1, "u0", "x"), (2, "u1", "y"), (3, "nobody", "z"), (4, None, "w"), (1, "u0", "x")], "candidate_id long, location_id_value string, mention string")
    got = sorted((r.candidate_id, r.feature_id, r.description) for r in R.ContextResolver(f, matrix(spark), CFG).describe(c).collect() if r.candidate_id < 3)
    assert got[0][1] == 0 and got[0][2].startswith("Matterhorn") and got[2][1] == 1 and len(got) == 3
    rest = {r.candidate_id: r.description for r in R.ContextResolver(f, matrix(spark), CFG).describe(c).collect()}
    assert rest[3] == "z" and rest[4] == "w"
    with pytest.raises(ValueError):
        R.ContextResolver(f, matrix(spark), None)


def test_gather(spark):
    refs = spark.createDataFrame([(1, 0, "Grat", None), (1, 1, "Grat", "done")], "doc_id long, ref_idx int, mention string, result string")
    found = spark.createDataFrame([("Grat", 5, "a"), ("Grat", 6, "b"), ("Grat", 7, "b")], "mention string, feature_id long, UUID string")
    have = spark.createDataFrame([(1, 0, "a")], "doc_id long, ref_idx int, UUID string")
    assert sorted(r.feature_id for r in R.gather(refs, found, have).collect()) == [6, 7]
    assert R.mention_text is not None
    assert spark.range(1).select(R.mention_text(F.lit("Zürich liegt"), F.lit(0), F.lit(6))).first()[0] == "Zürich"
