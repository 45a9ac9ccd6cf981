"""The store and the resolver over it."""

import types

import pytest
from pyspark.sql import functions as F
from test_cells import wkb_point
from test_context import CFG, features, matrix

from cellweave import BuildConfig, ContextResolver, build
from cellweave.operators import resolve as R
from cellweave.operators import stage
from cellweave.sources import matrix as M
from cellweave.sources import paths as P
from cellweave.sources import store as ST


@pytest.fixture()
def gazetteer(spark, tmp_path):
    spark.createDataFrame([(1, "tiny")], "id long, name string").write.parquet(f"{tmp_path}/gazetteer.parquet")
    spark.createDataFrame([(1, "pts", "PID", 1)], "id long, name string, location_id_name string, gazetteer_id long").write.parquet(f"{tmp_path}/gaz_source.parquet")
    rows = [(i, f"n{i}", k, wkb_point(2_500_010.0 + x, 1_100_010.0)) for i, (k, x) in enumerate([("Turm", 0), ("Turm", 0), ('Bach; "klein"', 0), ("Gemeindegebiet", 0), ("Turm", 90_000), ("Weiler", 50_000)])]
    spark.createDataFrame(rows, "PID long, NAME string, OBJEKTART string, geometry binary").write.parquet(f"{tmp_path}/pts.parquet")
    return tmp_path


def test_paths(spark, tmp_path):
    assert BuildConfig("x").resolve_output_path("s3a://bucket/gaz") == "s3a://bucket/gaz/spatial_store"
    assert str(BuildConfig("x").resolve_output_path("sqlite:////a/b")) == "/a/b/spatial_store" == ST.default_store("sqlite:////a/b")
    assert P.join("hdfs:///a/", "/b") == "/b" and P.join("a", "s3a://b/c") == "s3a://b/c" and P.parent("s3a://b/c/") == "s3a://b"
    assert P.exists(spark, tmp_path) and not P.exists(spark, f"{tmp_path}/no")


@pytest.mark.parametrize("master, fails", [("local[4]", False), ("local", False), ("spark://host:7077", True), ("local-cluster[2,1,1024]", True)])
def test_shared_folder(master, fails):
    conf = {}
    s = types.SimpleNamespace(conf=types.SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=types.SimpleNamespace(master=master))
    if fails:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            stage.shared_dir(s)
    else:
        assert stage.shared_dir(s) == conf["spark.checkpoint.dir"]


def test_resolver_over_a_store(spark, gazetteer):
    out = build(spark, BuildConfig("tiny"), f"sqlite:///{gazetteer}")
    assert str(out) == ST.default_store(gazetteer)
    r = ContextResolver.open(spark, str(gazetteer), "nowhere")
    assert [s.label for s in r.config.static_slots] == ["Gemeinde", "Kanton", "Bezirk"]
    assert r.categories() == ['Bach; "klein"', "Gemeindegebiet", "Turm", "Weiler"]
    for name in ("association", "csv", "beside"):
        if name == "csv":
            out.joinpath("association").rename(out / "away")
        if name == "beside":
            out.joinpath("b1_matrix.csv").rename(gazetteer / "b1_matrix.csv")
        r.reload()
        assert r.categories() == ['Bach; "klein"', "Gemeindegebiet", "Turm", "Weiler"]
        assert r.matrix.where("cat_a = cat_b").count() == 4
    gazetteer.joinpath("b1_matrix.csv").unlink()
    with pytest.raises(FileNotFoundError):
        r.reload()
    out.joinpath("away").rename(out / "association")
    with pytest.raises(FileNotFoundError):
        ContextResolver.open(spark, str(gazetteer), "nowhere", store=f"{gazetteer}/none")
    with pytest.raises(FileNotFoundError):
        ContextResolver.open(spark, str(gazetteer), config_path=f"{gazetteer}/none.yaml")


def test_sentences_are_made_once(spark, gazetteer):
    at = build(spark, BuildConfig("tiny"), gazetteer)
    r = ContextResolver.open(spark, str(gazetteer), "nowhere", store=str(at), sentence_config=CFG, attribute_map={"mention": "said"})
    c = spark.createDataFrame([(1, "0", "a"), (2, "4", "b"), (3, "zz", "c"), (4, None, None)], "candidate_id long, location_id_value string, said string")
    first = {x.candidate_id: x.description for x in r.describe(c).collect()}
    assert first[3] == "c" and first[4] is None and first[1].startswith("n0, Turm")
    assert ST.read_sentences(spark, at).count() == 2
    # What the store has isn't made again, nor written twice.
    fake = spark.createDataFrame([(5, "made before")], ST.SENTENCES)
    ST.add_sentences(fake, at)
    more = c.unionByName(spark.createDataFrame([(6, "5", "d")], c.schema))
    again = {x.candidate_id: x.description for x in r.describe(more).collect()}
    ids = {x.feature_id: x.UUID for x in r.features.collect()}
    assert {k: again[k] for k in first} == first and again[6] == ("made before" if ids[5] == "5" else again[6])
    assert ST.read_sentences(spark, at).count() == 3


def test_engine_needs_a_configuration(spark):
    engine = types.SimpleNamespace(features=features(spark, range(6)), matrix=matrix(spark))
    with pytest.raises(ValueError):
        ContextResolver.open(spark, "/nowhere", engine=engine)
    r = ContextResolver.open(spark, "/nowhere", engine=engine, sentence_config=CFG)
    assert r.generate(spark.createDataFrame([(0,)], "feature_id long")).first().sentence.startswith("Matterhorn")
    with pytest.raises(ValueError):
        r.reload()


def test_search_by_tiers(spark):
    f = spark.createDataFrame([(1, "a", "Côte d’Or"), (2, "b", "côte  d’or "), (3, "c", "Cote d'Or"), (4, None, "Or"), (5, "e", None), (6, "f", ""), (7, "g", "!!")], "feature_id long, UUID string, NAME string")
    m = spark.createDataFrame([("Côte d’Or",), ("Côte d’Or",), (None,), ("",), ("!!",), ("OR",)], "mention string")

    def found(**kw):
        return {(r.mention, r.feature_id, r.tier) for r in R.search(m, f, **kw).collect()}

    one = {("Côte d’Or", 1, 1), ("", 6, 1), ("!!", 7, 1)}
    assert found() == one == found(method="letters", tiers=1)
    two = one | {("Côte d’Or", 2, 2), ("OR", 4, 2)}
    assert found(method="normalised") == two
    assert found(method="letters") == two | {("Côte d’Or", 3, 3)}
    with pytest.raises(ValueError):
        found(tiers=0)
    assert R.search(m.limit(0), f).count() == 0 and R.search(m, f.limit(0), method="letters").count() == 0


def test_candidates_are_embedded_once(spark):
    c = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, "v", "done"), (3, "w", None), (None, "x", None)], "candidate_id long, mention string, result string")
    done = spark.createDataFrame([(3, [0.5])], "candidate_id long, vector array<double>")
    got = R.embed_candidates(c, done, lambda d: d.withColumn("description", F.upper("mention")), lambda d: d.select("candidate_id", F.array(F.length("description").cast("double")).alias("vector")))
    assert sorted((r.candidate_id, r.vector) for r in got.collect()) == [(1, [1.0]), (3, [0.5])]


def test_views(spark):
    names = ST.register({"features": features(spark, range(3)), "association": matrix(spark)})
    assert spark.sql("SELECT count(*) FROM features JOIN association ON OBJEKTART = cat_a").first()[0] == 5
    ST.unregister(spark, names)
    assert not spark.catalog.tableExists("features")


def test_csv_of_odd_names(spark, tmp_path):
    cats = ["", "a;b", 'c"d', "Ö"]
    m = spark.createDataFrame([(a, b, float(i), None, 0.5) for i, a in enumerate(cats) for b in cats], "cat_a string, cat_b string, b1 double, npmi double, b2 double")
    M.write_csv(m, cats[1:], tmp_path)
    got = {(r.cat_a, r.cat_b): r.b1 for r in M.read_csv(spark, f"{tmp_path}/b1_matrix.csv").collect()}
    assert got == {(a, b): float(i) for i, a in enumerate(cats) if a for b in cats if b}
    assert {r.npmi for r in M.read_csv(spark, f"{tmp_path}/npmi_matrix.csv", "npmi").collect()} == {None}


def test_command_line(spark, gazetteer, capsys):
    from cellweave.cli import main

    gazetteer.joinpath("tiny.yaml").write_text("gazetteer: tiny\noutput_file: mine\n")
    assert main(["--db", str(gazetteer), "--config", f"{gazetteer}/tiny.yaml"]) == f"{gazetteer}/mine"
    assert ST.open_store(spark, f"{gazetteer}/mine").keys() == set(ST.TABLES)
