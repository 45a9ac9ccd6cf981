"""Candidates of mentions: lookup by UUID, gathering, de-duplication, descriptions with fallback."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BuildConfig, SentenceConfig, resolve_config
from ..functions.sentence import sentence
from ..sources import matrix as M
from ..sources import paths as P
from ..sources import store as S
from . import context as X
from .pairs import pairs
from .stage import written


def first_per_uuid(features: DataFrame) -> DataFrame:
    """One row per UUID, that of the lowest feature_id; NULL is no UUID."""
    w = Window.partitionBy("UUID").orderBy("feature_id")
    return features.where("UUID is not null").withColumn("__row", F.row_number().over(w)).where("__row = 1").drop("__row")


def lookup_candidates(candidates: DataFrame, features: DataFrame, uuid: str = "location_id_value") -> DataFrame:
    """All candidates with feature_id, NAME, OBJEKTART of their UUID, NULL where it is unknown.

    UUIDs are made distinct before the join, so a very frequent one costs a row there; the answers then go back by an
    equality that AQE splits where it is skewed.
    """
    wanted = candidates.select(F.col(uuid).alias("UUID")).where("UUID is not null").distinct()
    known = first_per_uuid(features.select("UUID", "feature_id", "NAME", "OBJEKTART").join(wanted, "UUID", "left_semi"))
    return candidates.join(known.withColumnRenamed("UUID", uuid), uuid, "left")


#: Methods of search: a name as it is; also in other letter case and with other blanks; also without accents and signs.
METHODS = ("exact", "normalised", "letters")
#: Letters with accents, by their decomposition, and what is left of them.
_ACCENTED = [(chr(c), d[0]) for c in range(0xC0, 0x2000) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and all(unicodedata.combining(x) for x in d[1:])]


def search_keys(name: Column) -> list[Column]:
    """What names are compared by, one for each method; the first tier is the best."""
    blank = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    bare = F.translate(blank, "".join(c for c, _ in _ACCENTED), "".join(d for _, d in _ACCENTED))
    return [name, blank, F.regexp_replace(bare, r"[^\p{L}\p{N}]", "")]


def search(mentions: DataFrame, features: DataFrame, text: str = "mention", method: str = "exact", tiers: int = 3) -> DataFrame:
    """Name search, each distinct text once: (text, feature_id, UUID, tier), tier the best by which the name fits.

    ``method`` is the weakest likeness that is allowed, ``tiers`` how many tiers from the best on are given. Texts and
    names without a letter or digit fit by the first two tiers only; NULL fits nothing.
    """
    most = min(METHODS.index(method) + 1, tiers)
    if most < 1:
        raise ValueError("at least one tier is needed")

    def keyed(df: DataFrame, c: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(k + 1).alias("tier"), key.alias("key")) for k, key in enumerate(search_keys(F.col(c))[:most])])
        return df.select("*", F.explode(keys).alias("k")).select(*df.columns, "k.tier", "k.key").where("key <> '' or tier = 1")

    once = keyed(mentions.select(F.col(text).alias("__text")).where("__text is not null").distinct(), "__text")
    named = keyed(features.select("NAME", "feature_id", "UUID").where("NAME is not null"), "NAME").drop("NAME")
    hit = named.join(once, ["tier", "key"])
    if most > 1:
        hit = hit.groupBy("__text", "feature_id").agg(F.min("tier").alias("tier"), F.first("UUID").alias("UUID"))
    return hit.select(F.col("__text").alias(text), "feature_id", "UUID", "tier")


def mention_text(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points, end exclusive."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def gather(references: DataFrame, found: DataFrame, existing: DataFrame, text: str = "mention") -> DataFrame:
    """(doc_id, ref_idx, UUID, feature_id): what a search adds to references without a result; what the reference has is not added again.

    references: (doc_id, ref_idx, text, result); found: (text, feature_id, UUID); existing: (doc_id, ref_idx, UUID). A
    reference brings the UUIDs it has as an array, so the pairs, far more than all rows that are read, aren't shuffled.
    """
    held = existing.where("doc_id is not null and ref_idx is not null and UUID is not null").groupBy("doc_id", "ref_idx").agg(F.collect_set("UUID").alias("held"))
    todo = written(references.where("result is null").select("doc_id", "ref_idx", text).join(held, ["doc_id", "ref_idx"], "left"))
    new = pairs(written(found.select(text, "UUID", "feature_id")), todo, text)
    return new.where(~F.coalesce(F.array_contains("held", F.col("UUID")), F.lit(False))).select("doc_id", "ref_idx", "UUID", "feature_id")


def to_embed(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct candidate_id of unresolved references that have no embedding yet."""
    return candidates.where("result is null and candidate_id is not null").select("candidate_id").distinct().join(done.select("candidate_id"), "candidate_id", "left_anti")


def embed_candidates(candidates: DataFrame, done: DataFrame, describe: Callable[[DataFrame], DataFrame], encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """done with the embeddings of the candidates that to_embed() names: each is described and encoded once.

    describe: rows of candidates -> (candidate_id, description); encode: that -> the columns of ``done``.
    """
    todo = to_embed(candidates, done)
    rows = candidates.join(todo, "candidate_id", "left_semi").dropDuplicates(["candidate_id"])
    return done.unionByName(encode(describe(rows).select("candidate_id", "description")).select(*done.columns))


def sentences(sources: DataFrame, features: DataFrame, matrix: DataFrame, cfg: SentenceConfig) -> DataFrame:
    """contexts() with the rendered sentence."""
    c = X.contexts(sources, features, matrix, cfg)
    return c.withColumn("sentence", sentence(F.col("src_name"), F.col("src_cat"), F.col("context"), F.col("filler"), F.col("static_context"), cfg))


def descriptions(candidates: DataFrame, features: DataFrame, done: DataFrame, fallback: Column, uuid: str = "location_id_value") -> DataFrame:
    """Candidates with description: the sentence of the feature, else the fallback. done: (feature_id, sentence)."""
    c = lookup_candidates(candidates, features, uuid)
    return c.join(done.select("feature_id", "sentence"), "feature_id", "left").withColumn("description", F.coalesce("sentence", fallback))


class ContextResolver:
    """The resolver's operations over DataFrames: a store of features, its matrix and a configuration.

    ``features`` needs feature_id, UUID, NAME, OBJEKTART and h3_cells; ``matrix`` is the long association table. With
    ``store``, sentences are kept in it, so none is made twice. ``attribute_map`` names the columns of candidates that
    differ: candidate_id, location_id_value, mention, similarity.
    """

    def __init__(self, features: DataFrame, matrix: DataFrame | None, config: SentenceConfig | None, store: str | None = None, min_similarity: float = 0.6, max_tiers: int = 3, attribute_map: dict[str, str] | None = None):
        if config is None:
            raise ValueError("an injected store needs an explicit sentence configuration")
        if matrix is None:
            raise ValueError("no association matrix given")
        self.features, self.matrix, self.config, self.store = features, matrix, config, store
        self.min_similarity, self.max_tiers = min_similarity, max_tiers
        self.attributes = {v: k for k, v in (attribute_map or {}).items()}

    @classmethod
    def open(cls, spark: SparkSession, base: str, gazetteer: str = "swissnames3d", store: str | None = None, config_path: str | None = None, sentence_config: SentenceConfig | None = None, engine=None, **rest) -> ContextResolver:
        """Opens a store with its matrix.

        An explicit store wins over the one that the configuration file names below ``base``, that over the bundled
        configuration's, that over the default one; the sentence configuration likewise. The matrix is the store's
        table, else b1_matrix.csv in or beside the store. An ``engine``, any object with ``features`` and ``matrix``,
        takes the place of all of these, and needs a sentence configuration.
        """
        if engine is not None:
            return cls(engine.features, engine.matrix, sentence_config, **rest)
        try:
            build = BuildConfig.from_yaml(config_path) if config_path is not None else BuildConfig.for_gazetteer(gazetteer)
        except FileNotFoundError:
            if config_path is not None:
                raise
            build = None
        at = str(store or (build.resolve_output_path(base) if build else S.default_store(base)))
        config = resolve_config(sentence_config, config_path, gazetteer)
        return cls(S.open_store(spark, at)["features"], stored_matrix(spark, at), config, at, **rest)

    def reload(self) -> None:
        """Reads the store's matrix again."""
        if self.store is None:
            raise ValueError("a resolver without store has nothing to reload")
        self.features.sparkSession.catalog.refreshByPath(self.store)
        self.matrix = stored_matrix(self.features.sparkSession, self.store)

    def categories(self) -> list[str]:
        return M.categories_of(self.matrix)

    def generate(self, feature_ids: DataFrame) -> DataFrame:
        """(feature_id, sentence, static_context, context_by_category, filler_by_category, categories_used)."""
        src = X.sources_of(self.features.join(feature_ids.select("feature_id").distinct(), "feature_id", "left_semi"))
        s = sentences(src, self.features, self.matrix, self.config)
        return s.select(F.col("src_id").alias("feature_id"), "sentence", "static_context", F.col("context").alias("context_by_category"), F.col("filler").alias("filler_by_category"), "categories_used")

    def remembered(self, feature_ids: DataFrame) -> DataFrame:
        """(feature_id, sentence) of the features: those that the store has as they are, the others made and added to it."""
        ids = feature_ids.select("feature_id").distinct()
        if self.store is None:
            return self.generate(ids).select("feature_id", "sentence")
        spark = self.features.sparkSession
        new = written(self.generate(ids.join(S.read_sentences(spark, self.store), "feature_id", "left_anti")).select("feature_id", "sentence"))
        if not new.isEmpty():
            S.add_sentences(new, self.store)
        return S.read_sentences(spark, self.store).join(ids, "feature_id", "left_semi")

    def describe(self, candidates: DataFrame, fallback: Column | None = None) -> DataFrame:
        """Every candidate with its description; unknown UUIDs get ``fallback`` (the mention)."""
        candidates = self._named(candidates)
        known = lookup_candidates(candidates, self.features).where("feature_id is not null").select("feature_id")
        return descriptions(candidates, self.features, self.remembered(known), F.col("mention") if fallback is None else fallback)

    def gather(self, references: DataFrame, existing: DataFrame, method: str = "exact") -> DataFrame:
        """gather() by a search of max_tiers tiers at most."""
        todo = references.where("result is null")
        return gather(references, search(todo, self.features, method=method, tiers=self.max_tiers), existing)

    def embed(self, candidates: DataFrame, done: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return embed_candidates(self._named(candidates), done, self.describe, encode)

    def best(self, candidates: DataFrame) -> DataFrame:
        return best(self._named(candidates), self.min_similarity)

    def _named(self, candidates: DataFrame) -> DataFrame:
        return candidates.withColumnsRenamed({k: v for k, v in self.attributes.items() if k in candidates.columns})


def stored_matrix(spark: SparkSession, store: str) -> DataFrame:
    """The association table of a store, else its b1_matrix.csv, else the one beside it."""
    if P.exists(spark, f"{store}/association"):
        return spark.read.parquet(f"{store}/association")
    own = f"{store}/b1_matrix.csv"
    return M.read_csv(spark, own if P.exists(spark, own) else P.join(P.parent(store), "b1_matrix.csv"))


def best(candidates: DataFrame, min_similarity: float = 0.6) -> DataFrame:
    """Per (doc_id, ref_idx) the candidate of highest similarity, at least min_similarity; ties by candidate_id."""
    w = Window.partitionBy("doc_id", "ref_idx").orderBy(F.desc("similarity"), "candidate_id")
    return candidates.where(F.col("similarity") >= min_similarity).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
