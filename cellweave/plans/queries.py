"""The named queries of the core. Each takes (spark, folder of Parquet tables).

Searches for neighbours take as sources every feature whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BuildConfig, SentenceConfig, StaticSlot, resolve_config
from ..functions import cells as C
from ..operators import association as A
from ..operators import cellsets as S
from ..operators import context as X
from ..operators import nearby as N
from ..operators import resolve as R
from ..operators import skew as K
from ..operators.stage import shared_dir, written
from ..sources import gazetteer as G
from ..sources import matrix as M
from ..sources import store as ST
from .build import build

#: A lower threshold than the default, as the test categories are nearly independent.
CONFIG = BuildConfig.for_gazetteer("swissnames3d").sentence
FILLED = SentenceConfig(static_slots=CONFIG.static_slots, max_slots=6, max_slots_per_category=2, max_categories=4, max_filler_slots=3)
_matrices: dict[tuple[str, str], DataFrame] = {}


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return X.sources_of(t(spark, d, "features").where("feature_id % 50 = 0"))


def source_discovery(spark, d):
    return G.discover(t(spark, d, "gaz_source"), t(spark, d, "gazetteer"), "landnamen3d")


def _scans(spark, d, more=()):
    """One scan per source of every gazetteer, each by its own name of the id column."""
    raw = t(spark, d, "raw_features")
    names = [(r[0], r[1]) for r in t(spark, d, "gaz_source").select("name", "location_id_name").orderBy("name").collect()]
    ids = dict(names)
    return G.scan_all([*names, *more], lambda n: raw.where(F.col("source") == n).withColumnRenamed("UUID", ids[n]) if n in ids else t(spark, d, n))


def feature_scan_union(spark, d):
    """The scans of all sources, united."""
    return _scans(spark, d).drop("geometry")


def feature_scan_tolerant(spark, d):
    """feature_scan_union where a source named by the gazetteer isn't there: it is logged and left out."""
    return _scans(spark, d, [("verschwunden", "UUID")]).groupBy("source").agg(F.count("*").alias("n"), F.count("NAME").alias("n_named"))


def _raw_ids(spark, d):
    return G.dense_ids(t(spark, d, "raw_features"), ["source", "UUID", "NAME", "OBJEKTART", "geometry"])


def feature_ids(spark, d):
    return _raw_ids(spark, d).drop("geometry")


def geometry_cover(spark, d):
    return G.convert(t(spark, d, "raw_features"), BuildConfig.for_gazetteer("swissnames3d"))


def geometry_drops(spark, d):
    """How many geometries of each source are read, and how many give no cells."""
    raw = t(spark, d, "raw_features")
    return G.dropped(raw, G.convert(raw, BuildConfig.for_gazetteer("swissnames3d")))


def geometry_points(spark, d):
    """geometry_cover of the points alone: one cell of the finest resolution each."""
    raw = t(spark, d, "raw_features").where(F.hex(F.substring("geometry", 1, 5)) == "0101000000")
    return G.convert(raw, BuildConfig.for_gazetteer("swissnames3d"))


def lookup_build(spark, d):
    return S.lookup(t(spark, d, "features"))


def store_counts(spark, d):
    f = t(spark, d, "features")
    a = f.agg(F.count("*").alias("n_features"), F.sum(F.col("h3_cell_count").cast("bigint")).alias("n_cells"))
    b = S.lookup(f).agg(F.count("*").alias("n_lookup"))
    return a.select(F.lit("features").alias("what"), F.col("n_features").alias("n")).unionByName(a.select(F.lit("cells").alias("what"), F.col("n_cells").alias("n"))).unionByName(b.select(F.lit("lookup").alias("what"), F.col("n_lookup").alias("n")))


def source_counts(spark, d):
    return t(spark, d, "features").groupBy("source").agg(F.count("*").alias("n"))


def category_list(spark, d):
    return A.category_list(t(spark, d, "features"))


def _cover(spark, d):
    return S.canonical(A.category_cover(t(spark, d, "features")), ["category"])


def category_area(spark, d):
    return S.area(_cover(spark, d), ["category"])


def total_area(spark, d):
    return S.total_area(t(spark, d, "features").select(F.explode("h3_cells").alias("cell")))


def pair_intersection_area(spark, d):
    return S.pair_area(_cover(spark, d), "category")


def _matrix(spark, d):
    """The association table, written once per session and folder, as a store has it."""
    key = spark.sparkContext.applicationId, d
    if key not in _matrices:
        _matrices[key] = written(A.compute_all(t(spark, d, "features")))
    return _matrices[key]


def npmi_matrix(spark, d):
    return _matrix(spark, d).select("cat_a", "cat_b", F.round("npmi", 6).alias("npmi"))


def b1_matrix(spark, d):
    return _matrix(spark, d).select("cat_a", "cat_b", F.round("b1", 6).alias("b1"))


def b2_matrix(spark, d):
    return _matrix(spark, d).select("cat_a", "cat_b", F.round("b2", 6).alias("b2"))


def matrix_pivot(spark, d):
    """The wide matrix, a column for every category."""
    f = t(spark, d, "features")
    return M.pivot(_matrix(spark, d).withColumn("b1", F.round("b1", 6)), "b1", A.collect_categories(f))


def associated_categories(spark, d):
    return A.associated(_matrix(spark, d)).select("cat_a", "cat_b", F.round("b1", 6).alias("b1"), "assoc_rank")


def associated_dynamic(spark, d):
    return A.without_static(A.associated(_matrix(spark, d)), [s.objektart for s in CONFIG.static_slots]).select("cat_a", "cat_b", "assoc_rank")


def slot_allocation_proportional(spark, d):
    return A.proportional_slots(A.associated(_matrix(spark, d)))


def uuid_lookup(spark, d):
    c = R.lookup_candidates(t(spark, d, "candidates"), t(spark, d, "features"))
    return c.select("candidate_id", F.col("location_id_value").alias("uuid"), "feature_id", "NAME", "OBJEKTART")


def intersecting_features(spark, d):
    return X.shared_area(_sources(spark, d), t(spark, d, "features"), ["OBJEKTART"]).where("src_id <> feature_id").select("src_id", "feature_id", "OBJEKTART", "shared_m2")


def overlap_static_topk(spark, d):
    m = X.cell_sets(_sources(spark, d))
    top = X.static_topk(X.near_sets(m, t(spark, d, "features"), sizes=False), CONFIG.static_slots).withColumnRenamed("src_id", "set_id")
    return m.select("src_id", "set_id").join(top, "set_id").select("src_id", "label", "pos", "feature_id", "NAME")


def _allocated(spark, d, cfg):
    """(members, near, taken) of the sources."""
    m = X.cell_sets(_sources(spark, d))
    near = X.near_sets(m, t(spark, d, "features"), cfg.max_filler_slots > 0)
    assoc = A.without_static(A.associated(_matrix(spark, d), cfg.assoc_threshold, cfg.max_categories), [s.objektart for s in cfg.static_slots])
    return m, near, written(X.allocate_classes(near, X.classes_of(m), assoc, cfg))


def slot_allocation(spark, d):
    m, _, taken = _allocated(spark, d, CONFIG)
    return m.select("src_id", "class_id").join(taken.drop("src_id"), "class_id").select("src_id", "OBJEKTART", "feature_id", "u_rank")


def filler_features(spark, d):
    m, near, taken = _allocated(spark, d, FILLED)
    return X.filler(near, taken, m, FILLED).select("src_id", "pos", "feature_id")


def _sentences(spark, d, cfg):
    return R.sentences(_sources(spark, d), t(spark, d, "features"), _matrix(spark, d), cfg).select(F.col("src_id").alias("feature_id"), "sentence")


def sentence_static(spark, d):
    return _sentences(spark, d, SentenceConfig(static_slots=CONFIG.static_slots, max_slots=0))


def sentence_dynamic(spark, d):
    return _sentences(spark, d, SentenceConfig())


def sentence_full(spark, d):
    return _sentences(spark, d, CONFIG)


def sentence_filler(spark, d):
    return _sentences(spark, d, FILLED)


def _references(c):
    hit = F.when(F.col("similarity") >= 0.6, F.col("location_id_value"))
    return c, c.where("doc_id is not null and ref_idx is not null").groupBy("doc_id", "ref_idx", "mention").agg(F.max(hit).alias("result"))


def gather_candidates(spark, d):
    """New candidates of all references that have no result yet, by exact name."""
    c, refs = _references(t(spark, d, "candidates"))
    return R.gather(refs, R.search(refs, t(spark, d, "features")), c.withColumnRenamed("location_id_value", "UUID"))


def search_tiers(spark, d):
    """Every mention's features by name: as it is (tier 1), in other case and blanks (2), without accents and signs (3)."""
    return R.search(t(spark, d, "candidates"), t(spark, d, "features"), method="letters", tiers=3).select("mention", "feature_id", "tier")


def mention_text(spark, d):
    """A stretch of every text by its place, as references give it: from a tenth to a fifth of the text."""
    n = F.length("text")
    start, end = F.floor(n / 10).cast("int"), F.floor(n / 5).cast("int")
    return t(spark, d, "documents").select("doc_id", R.mention_text(F.col("text"), start, end).alias("mention"))


def candidates_to_embed(spark, d):
    """Distinct candidates below the similarity that decides; those looked up in the first half of the time are embedded already."""
    c = t(spark, d, "candidates").withColumn("result", F.when(F.col("similarity") >= 0.6, F.col("location_id_value")))
    return R.to_embed(c, c.where("gathered_at < timestamp '2024-01-15 00:00:00'"))


def resolve_best(spark, d):
    return R.best(t(spark, d, "candidates").dropDuplicates(["doc_id", "ref_idx", "candidate_id"])).select("doc_id", "ref_idx", "candidate_id")


def description_fallback(spark, d):
    """Every candidate with the sentence of its feature, else with its mention."""
    f = t(spark, d, "features")
    return R.ContextResolver(f, _matrix(spark, d), CONFIG).describe(t(spark, d, "candidates")).select("candidate_id", "feature_id", "description")


def cell_from_text(spark, d):
    """Cells written as hexadecimal or decimal text and read again."""
    hexa, deci = F.lower(F.hex("cell")), F.col("cell").cast("string")
    return t(spark, d, "h3_lookup").select("feature_id", C.from_text(hexa).alias("from_hex"), C.from_text(deci).alias("from_decimal"))


def lookup_store(spark, d):
    """Features and cell index written to a store and read back."""
    at = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    features = ST.write_features(t(spark, d, "features"), at)
    ST.write_lookup(features, at)
    return ST.open_store(spark, at)["h3_lookup"]


def uuid_store(spark, d):
    """The store's second copy of features, clustered by UUID."""
    at = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    ST.write_features(t(spark, d, "features"), at)
    return ST.open_store(spark, at)["features_by_uuid"]


def matrix_csv(spark, d):
    """The B1 matrix written as CSV and read back."""
    at = f"{shared_dir(spark)}/matrix-{uuid.uuid4().hex}"
    M.write_csv(_matrix(spark, d), A.collect_categories(t(spark, d, "features")), at)
    return M.read_csv(spark, f"{at}/b1_matrix.csv").select("cat_a", "cat_b", F.round("b1", 6).alias("b1"))


def build_store(spark, d):
    """The build of every gazetteer from raw_features: features by gazetteer and source, with dense ids."""
    raw, out = t(spark, d, "raw_features"), []
    names = {r[0]: r[1] for r in t(spark, d, "gaz_source").select("name", "location_id_name").collect()}
    for (name,) in t(spark, d, "gazetteer").select("name").orderBy("name").collect():
        at = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
        build(spark, BuildConfig(name), d, at, read=lambda n: raw.where(F.col("source") == n).withColumnRenamed("UUID", names[n]))
        f = ST.open_store(spark, at)["features"]
        out.append(f.groupBy("source").agg(F.count("*").alias("n")).select(F.lit(name).alias("gazetteer"), "source", "n"))
    return reduce(DataFrame.unionByName, out)


def config_precedence(spark, d):
    """Where the settings of the sentences come from: those given, else a file's, else the bundled, else the preset's."""
    given = SentenceConfig(static_slots=(StaticSlot("Given"),))
    rows = [("given", resolve_config(given, None, "swissnames3d")), ("bundled", resolve_config(None, None, "swissnames3d")), ("preset", resolve_config(None, None, "nowhere"))]
    return spark.createDataFrame([(k, ",".join(s.label for s in c.static_slots), c.max_slots) for k, c in rows], "wins string, labels string, max_slots int")


def cell_parent(spark, d):
    return t(spark, d, "h3_lookup").where("cell is not null").select("feature_id", "cell", C.parent("cell", 9).alias("parent_9"), C.parent("cell", 5).alias("parent_5"))


def cell_resolution(spark, d):
    return t(spark, d, "h3_lookup").select("feature_id", C.resolution("cell").alias("res"), C.base_cell("cell").alias("base"), C.area_m2("cell").alias("area_m2"))


def multires_union(spark, d):
    """The union of cells of every category."""
    return _cover(spark, d)


def multires_intersection(spark, d):
    """The cells shared by every pair of categories."""
    return S.matches(written(_cover(spark, d)), "category").where("fine_key <> coarse_key")


def cosine_resolve(spark, d):
    """For every vector whose id is divisible by 50 the most similar other one, at least min_similarity."""
    e = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    norm = F.sqrt(F.aggregate(F.transform("e", lambda x: x * x), F.lit(0.0), lambda a, b: a + b))
    e = e.withColumn("n", norm)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("e").alias("q"), F.col("n").alias("qn"))
    # The stated query set against all rows, the queries replicated in blocks by an equality on the block.
    blocks = 16
    q = q.withColumn("block", F.explode(F.array(*[F.lit(i) for i in range(blocks)])))
    j = e.withColumn("block", (F.col("vec_id") % blocks).cast("int")).join(q, "block").where("vec_id <> q_id")
    dot = F.aggregate(F.zip_with("e", "q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    s = j.select("q_id", "vec_id", F.round(dot / F.nullif(F.col("n") * F.col("qn"), F.lit(0.0)), 6).alias("similarity")).where("similarity >= 0.3")
    return s.groupBy("q_id").agg(F.max(F.struct(F.col("similarity"), (-F.col("vec_id")).alias("v"))).alias("m")).select("q_id", (-F.col("m.v")).alias("vec_id"), F.col("m.similarity").alias("similarity"))


def p4_found(spark, d):
    return N.near_or_inside(t(spark, d, "features"))


def p4_inside_polygons(spark, d):
    """(feature_id, region_id): locations in the polygons of raw_features, whose ids are those of feature_ids."""
    at = N.locations(t(spark, d, "features"))
    x, y = C.grid_xy("cell")
    points = at.select(F.col("feature_id").alias("id"), ((x + 0.5) * 32 + 2_400_000).alias("x"), ((y + 0.5) * 32 + 1_000_000).alias("y"))
    polygons = written(_raw_ids(spark, d).select(F.col("feature_id").alias("region_id"), F.col("geometry").alias("wkb")))
    return N.inside_polygons(points, polygons).withColumnRenamed("id", "feature_id")


def p7_keys(spark, d):
    return K.category_load(t(spark, d, "features"))


def p7_found(spark, d):
    return K.heavy(K.category_load(t(spark, d, "features"))).select("objektart")


QUERIES = [
    source_discovery, feature_scan_union, feature_scan_tolerant, feature_ids, geometry_cover, geometry_points, geometry_drops, lookup_build, store_counts, source_counts, category_list, category_area, total_area, pair_intersection_area,
    npmi_matrix, b1_matrix, b2_matrix, matrix_pivot, associated_categories, associated_dynamic, slot_allocation_proportional, uuid_lookup, intersecting_features, overlap_static_topk,
    slot_allocation, filler_features, sentence_static, sentence_dynamic, sentence_full, sentence_filler, gather_candidates, search_tiers, mention_text, candidates_to_embed, resolve_best, description_fallback,
    cell_parent, cell_resolution, cell_from_text, lookup_store, uuid_store, matrix_csv, build_store, config_precedence, multires_union, multires_intersection, cosine_resolve, p4_found, p4_inside_polygons, p7_found, p7_keys,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
