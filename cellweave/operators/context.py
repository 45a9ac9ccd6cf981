"""Which features share space with a source, and which of them get a slot in its sentence.

Ordering is total everywhere: shared area descending, then feature_id. A source is (src_id, name, category, cells).
Sentence contexts are arrays of (key, names) in order, as maps have none. Work is done once for all sources with the
same cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SentenceConfig, StaticSlot
from ..functions import cells as C
from . import association as A
from . import cellsets as S
from .pairs import pairs
from .stage import written

GROUPS = "array<struct<key:string,names:array<string>>>"


def sources_of(features: DataFrame) -> DataFrame:
    """Sources in the form used here, one per feature_id."""
    return features.select(F.col("feature_id").alias("src_id"), F.col("NAME").alias("src_name"), F.col("OBJEKTART").alias("src_cat"), F.col("h3_cells").alias("src_cells")).dropDuplicates(["src_id"])


def cell_sets(sources: DataFrame) -> DataFrame:
    """sources with cells, set_id and class_id in place of src_cells, written once.

    Sources with the same distinct cells have the same neighbours, so overlaps are made once per set, whatever the
    number of sources that hold it; those with the same category too have the same slots (class). Both ids are the
    least src_id among them, NULL for a source without cells.
    """
    cells = F.array_sort(F.array_distinct(F.array_compact("src_cells")))
    own = sources.select("src_id", "src_name", "src_cat", F.when(F.size(cells) > 0, cells).alias("cells"))
    sets = own.where("cells is not null").groupBy("cells").agg(F.min("src_id").alias("set_id"))
    own = written(own.join(sets, "cells", "left"))
    classes = own.where("set_id is not null").groupBy(F.col("set_id").alias("s"), F.col("src_cat").alias("c")).agg(F.min("src_id").alias("class_id"))
    return written(own.join(classes, (F.col("set_id") == F.col("s")) & F.col("src_cat").eqNullSafe(F.col("c")), "left").drop("s", "c"))


def set_overlaps(sets: DataFrame, features: DataFrame) -> DataFrame:
    """(set_id, feature_id, shared_m2) for all features with a cell equal to, above or below one of the set's.

    Coarse cells are never exploded to fine ones: the finer side brings its ancestors, at resolutions that occur on
    the other side only, and the join is an equality.
    """
    s = sets.where("set_id = src_id").select("set_id", F.explode("cells").alias("cell"))
    t = features.select("feature_id", F.explode(F.array_distinct("h3_cells")).alias("cell")).where("cell is not null")
    up = s.select("set_id", C.area_m2("cell").alias("m2"), F.explode(C.ancestors("cell", S.levels_in(features))).alias("at")).join(t.select("feature_id", F.col("cell").alias("at")), "at")
    down = t.select("feature_id", C.area_m2("cell").alias("m2"), F.explode(C.ancestors("cell", S.levels_of(s), proper=True)).alias("at")).join(s.select("set_id", F.col("cell").alias("at")), "at")
    cols = ["set_id", "feature_id", "m2"]
    return up.select(*cols).unionByName(down.select(*cols)).groupBy("set_id", "feature_id").agg(F.sum("m2").alias("shared_m2"))


def shared_area(sources: DataFrame, features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(src_id, feature_id, shared_m2): set_overlaps for each source; the source itself is among the results.

    ``keep``: columns of the target to bring along. They are fetched once per set, as the sources of a set times its
    neighbours may be far more than all rows that are read.
    """
    m = cell_sets(sources)
    near = set_overlaps(m, features)
    if keep:
        near = near.join(features.select("feature_id", *keep), "feature_id")
    return pairs(written(near), m.select("set_id", "src_id"), "set_id").select("src_id", "feature_id", *keep, "shared_m2")


def with_features(overlaps: DataFrame, features: DataFrame, sizes: bool = True) -> DataFrame:
    """Overlaps with the target's UUID, NAME, OBJEKTART and, for fillers, own size."""
    size = F.aggregate(F.transform(F.array_distinct("h3_cells"), lambda c: F.coalesce(C.area_m2(c), F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return overlaps.join(features.select("feature_id", "UUID", "NAME", "OBJEKTART", *[size.alias("own_m2")] * sizes), "feature_id")


def near_sets(members: DataFrame, features: DataFrame, sizes: bool = True) -> DataFrame:
    """The neighbours of each set of cell_sets, with src_id = set_id, written once."""
    return written(with_features(set_overlaps(members, features), features, sizes).withColumnRenamed("set_id", "src_id"))


def neighbours(sources: DataFrame, features: DataFrame, sizes: bool = True) -> DataFrame:
    """shared_area with the source's category and the target's UUID, NAME, OBJEKTART and, for fillers, own size."""
    return with_features(shared_area(sources, features), features, sizes).join(sources.select("src_id", "src_cat"), "src_id")


def static_topk(near: DataFrame, slots: tuple[StaticSlot, ...]) -> DataFrame:
    """(src_id, slot_order, label, pos, NAME): per slot the best overlaps, the source itself not excluded."""
    spark = near.sparkSession
    table = spark.createDataFrame([(s.objektart, i, s.label, s.slots) for i, s in enumerate(slots)], "OBJEKTART string, slot_order int, label string, slots int")
    w = Window.partitionBy("src_id", "slot_order").orderBy(F.desc("shared_m2"), "feature_id")
    most = max((s.slots for s in slots), default=0)
    hit = near.join(F.broadcast(table), "OBJEKTART").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).where("pos <= slots")
    return hit.select("src_id", "slot_order", "label", "pos", "NAME", "feature_id")


def static_context(near: DataFrame, slots: tuple[StaticSlot, ...]) -> DataFrame:
    """(src_id, static_context). NULL names go after the cut; of slots with the same label the last with a name wins, in the first one's place."""
    own = static_topk(near, slots).where("NAME is not null")
    per = own.groupBy("src_id", "label", "slot_order").agg(F.array_sort(F.collect_list(F.struct("pos", "NAME"))).alias("rows"))
    lab = per.groupBy("src_id", "label").agg(F.min("slot_order").alias("first"), F.max_by("rows", "slot_order").alias("rows"))
    item = F.struct(F.col("label").alias("key"), F.expr("transform(rows, r -> r.NAME)").alias("names"))
    return lab.groupBy("src_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", item.alias("item")))), lambda x: x["item"]).alias("static_context"))


def allocate(near: DataFrame, assoc: DataFrame, cfg: SentenceConfig) -> DataFrame:
    """Rows of ``near`` (with src_cat) that get a slot, with assoc_rank, u_rank and place; the source itself gets none."""
    rows = near.where(F.col("src_id") != F.col("feature_id"))
    classes = rows.select(F.col("src_id").alias("class_id"), F.col("src_id").alias("set_id"), "src_cat").distinct()
    return allocate_classes(rows.drop("src_cat"), classes, assoc, cfg).drop("class_id").join(classes.select(F.col("set_id").alias("src_id"), "src_cat"), "src_id")


def allocate_classes(near: DataFrame, classes: DataFrame, assoc: DataFrame, cfg: SentenceConfig) -> DataFrame:
    """Rows of ``near`` that get a slot in the sentences of each class, with class_id, assoc_rank, u_rank and place.

    near: neighbours of sets, src_id = set_id; classes: (class_id, set_id, src_cat). ``assoc`` never pairs a category
    with itself, so no source of a class is among its rows. Categories come in order of B1; each takes at most
    max_slots_per_category distinct UUIDs (NULL is one) in order of first appearance, while the budget max_slots
    lasts, and all rows of a UUID taken. Which UUIDs come first doesn't depend on the source's category, so it is found
    once per set and category; the loop over categories is a running sum over one row per (class, category). The cut
    to the first UUIDs goes before the shuffle as a window group limit.
    """
    k = cfg.max_slots_per_category
    wanted = assoc.select(F.col("cat_a").alias("src_cat"), F.col("cat_b").alias("OBJEKTART"), "assoc_rank")
    ask = written(classes.where("src_cat is not null").join(wanted, "src_cat").select("class_id", "set_id", "OBJEKTART", "assoc_rank"))
    near = near.join(ask.select(F.col("set_id").alias("src_id"), "OBJEKTART").distinct(), ["src_id", "OBJEKTART"], "left_semi")
    rows = near.withColumn("place", F.struct((-F.col("shared_m2")).alias("m"), F.col("feature_id").alias("f")))
    uuid = F.col(cfg.uuid_field)
    firsts = rows.groupBy(F.col("src_id").alias("set_id"), F.col("OBJEKTART").alias("o"), uuid.alias("u")).agg(F.min("place").alias("first"))
    w = Window.partitionBy("set_id", "o").orderBy("first")
    firsts = written(firsts.withColumn("u_rank", F.row_number().over(w)).where(F.col("u_rank") <= k).drop("first"))
    have = firsts.groupBy("set_id", F.col("o").alias("OBJEKTART")).agg(F.max("u_rank").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("class_id").orderBy("assoc_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = ask.join(have, ["set_id", "OBJEKTART"]).select("class_id", "set_id", "OBJEKTART", "assoc_rank", F.least(F.lit(k), F.greatest(F.lit(0), F.lit(cfg.max_slots) - before)).alias("allowed")).where("allowed > 0")
    taken = per.join(firsts.withColumnRenamed("o", "OBJEKTART"), ["set_id", "OBJEKTART"]).where("u_rank <= allowed").select("class_id", F.col("set_id").alias("s"), F.col("OBJEKTART").alias("o"), "assoc_rank", "u", "u_rank")
    on = (F.col("src_id") == F.col("s")) & (F.col("OBJEKTART") == F.col("o")) & uuid.eqNullSafe(F.col("u"))
    return rows.join(taken, on).drop("s", "o", "u")


def grouped(rows: DataFrame, order: str, name: str, key: str = "src_id") -> DataFrame:
    """(key, name): array of (category, names); NULL names are dropped here, their slots stay spent."""
    per = rows.where("NAME is not null").groupBy(key, order, "OBJEKTART").agg(F.array_sort(F.collect_list(F.struct("place", "NAME"))).alias("rows"))
    item = F.struct(F.col("OBJEKTART").alias("key"), F.expr("transform(rows, r -> r.NAME)").alias("names"))
    return per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, item.alias("item")))), lambda x: x["item"]).alias(name))


def filler(near: DataFrame, taken: DataFrame, members: DataFrame, cfg: SentenceConfig) -> DataFrame:
    """The smallest neighbours for the slots left over, per source: min(max_filler_slots, max_slots - names used), any
    category, without the source and what is taken; groups in order of first appearance.

    near: neighbours of sets; taken: slots of classes; members: cell_sets. Where room is left, fewer than max_slots
    rows are taken, so the first max_slots + max_filler_slots of a set (and one for the source itself) hold them all.
    """
    used = taken.groupBy("class_id").agg(F.count("*").alias("used"))
    room = members.where("src_id = class_id").select("class_id", "set_id").join(used, "class_id", "left").select("class_id", "set_id", F.least(F.lit(cfg.max_filler_slots), F.lit(cfg.max_slots) - F.coalesce("used", F.lit(0))).alias("room")).where("room > 0")
    w = Window.partitionBy("src_id").orderBy("own_m2", "feature_id")
    small = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cfg.max_filler_slots + cfg.max_slots).withColumnRenamed("src_id", "set_id").drop("n")
    left = small.join(room, "set_id").join(taken.select("class_id", "feature_id"), ["class_id", "feature_id"], "left_anti")
    own = left.join(members.select("src_id", "class_id"), "class_id").where(F.col("src_id") != F.col("feature_id"))
    rows = own.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cfg.max_filler_slots).where("pos <= room")
    first = F.min("pos").over(Window.partitionBy("src_id", "OBJEKTART"))
    return rows.withColumns({"first": first, "place": F.struct("pos")})


def contexts(sources: DataFrame, features: DataFrame, matrix: DataFrame, cfg: SentenceConfig) -> DataFrame:
    """(src_id, src_name, src_cat, static_context, context, filler, categories_used), one row per source, empty arrays where there is nothing."""
    members = cell_sets(sources)
    near = near_sets(members, features, cfg.max_filler_slots > 0)
    assoc = A.without_static(A.associated(matrix, cfg.assoc_threshold, cfg.max_categories), [s.objektart for s in cfg.static_slots])
    taken = allocate_classes(near, classes_of(members), assoc, cfg)
    if cfg.max_filler_slots > 0:
        taken = written(taken)
    static = static_context(near, cfg.static_slots).withColumnRenamed("src_id", "set_id")
    out = members.select("src_id", "src_name", "src_cat", "set_id", "class_id").join(static, "set_id", "left").join(grouped(taken, "assoc_rank", "context", "class_id"), "class_id", "left").drop("set_id", "class_id")
    if cfg.max_filler_slots > 0:
        out = out.join(grouped(filler(near, taken, members, cfg), "first", "filler"), "src_id", "left")
    else:
        out = out.withColumn("filler", F.lit(None).cast(GROUPS))
    empty = F.array().cast(GROUPS)
    out = out.withColumns({c: F.coalesce(F.col(c), empty) for c in ("static_context", "context", "filler")})
    return out.withColumn("categories_used", F.expr("transform(context, x -> x.key)"))


def classes_of(members: DataFrame) -> DataFrame:
    """(class_id, set_id, src_cat) of cell_sets."""
    return members.where("src_id = class_id").select("class_id", "set_id", "src_cat")
