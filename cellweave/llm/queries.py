"""Named queries of the operators for training data, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cooccur, encode, garbled, leaks, setoverlap, sketches, spans, topn


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


KEYS = ["change_day", "OBJEKTART", "source"]


def p1_found(spark, d):
    return p1_restored(spark, d).select("feature_id")


def p1_restored(spark, d):
    return garbled.find(t(spark, d, "features").select("feature_id", "NAME"))


def p2_distinct_cells(spark, d):
    """Distinct cells per day, OBJEKTART and source, alone and in every combination, with error and band."""
    flags = [f"is_all_{k}" for k in KEYS]
    return sketches.count(sketches.cube(sketches.sketch(t(spark, d, "features"), KEYS, "h3_cells"), KEYS), KEYS + flags)


def p2_partials(spark, d):
    """Mergeable partial results of each day and source: one sketch a row."""
    return sketches.sketch(t(spark, d, "features"), ["change_day", "source"], "h3_cells")


def p2_band(spark, d):
    """Every group of p2_distinct_cells with its exact count, and whether that lies in the stated band, widened by two standard errors and a cell."""
    flags = [f"is_all_{k}" for k in KEYS]
    v = t(spark, d, "features").select(*KEYS, F.explode("h3_cells").alias("cell")).where("cell is not null").distinct()
    sets = [[F.col(k) for i, k in enumerate(KEYS) if n >> i & 1] for n in range(2 ** len(KEYS))]
    exact = v.groupingSets(sets, *KEYS).agg(F.countDistinct("cell").alias("n"), *[F.grouping(k).cast("boolean").alias(f) for k, f in zip(KEYS, flags)])
    e = p2_distinct_cells(spark, d).select(*[F.col(c).alias(f"e_{c}") for c in KEYS + flags], (F.col("lower") * F.exp(-2 * F.col("rel_error")) - 1).alias("lower"), (F.col("upper") * F.exp(2 * F.col("rel_error")) + 1).alias("upper"))
    on = [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in KEYS + flags]
    return exact.join(e, on, "left").select(*KEYS, *flags, "n", F.coalesce(F.col("n").between(F.col("lower"), F.col("upper")), F.lit(False)).alias("inside"))


def p2_joint_sources(spark, d):
    """Union, intersection and Jaccard of the cells of every pair of sources."""
    return sketches.joint(sketches.sketch(t(spark, d, "features"), ["source"], "h3_cells"), "source")


def p2_joint_objektart(spark, d):
    """Union, intersection and Jaccard of the cells of every pair of OBJEKTART values."""
    return sketches.joint(sketches.sketch(t(spark, d, "features"), ["OBJEKTART"], "h3_cells"), "OBJEKTART")


def p2_joint_band(spark, d):
    """The pairs of p2_joint_objektart that share cells, with the exact numbers, and whether these lie within four stated errors, to a cell."""
    x, j = p5_overlaps(spark, d), p2_joint_objektart(spark, d)
    j = j.select(F.col("key_a").alias("objektart_a"), F.col("key_b").alias("objektart_b"), "n_union", "n_union_error", "n_both", "n_both_error", "jaccard", "jaccard_error")
    n = F.col("n_a") + F.col("n_b") - F.col("n_shared")
    near = lambda exact, c, least: F.abs(exact - F.col(c)) <= 4 * F.col(f"{c}_error") + least
    inside = near(n, "n_union", 1) & near(F.col("n_shared"), "n_both", 1) & near(F.col("n_shared") / n, "jaccard", 0.01)
    return x.join(j, ["objektart_a", "objektart_b"], "left").select("objektart_a", "objektart_b", n.alias("n_union"), "n_shared", F.coalesce(inside, F.lit(False)).alias("inside"))


def p3_found(spark, d):
    f = t(spark, d, "features").where("OBJEKTART is not null and source is not null and change_day is not null")
    rows = f.select("OBJEKTART", "source", "change_day", "h3_cell_count", "feature_id")
    return topn.top_n(rows, ["OBJEKTART", "source", "change_day"], "h3_cell_count", "feature_id", 3).select(F.col("OBJEKTART").alias("objektart"), "feature_id")


def p5_overlaps(spark, d):
    return setoverlap.overlaps(t(spark, d, "features"), "OBJEKTART", "h3_cells").withColumnsRenamed({"set_a": "objektart_a", "set_b": "objektart_b"})


def p5_found(spark, d):
    return p5_overlaps(spark, d).where("n_shared >= 3 and 4 * n_shared >= least(n_a, n_b)").select("objektart_a", "objektart_b")


def _together(spark, d):
    f = t(spark, d, "features").where("OBJEKTART is not null").select("feature_id", "OBJEKTART")
    rows = t(spark, d, "h3_lookup").where("cell is not null").select("feature_id", "cell").join(f, "feature_id")
    return cooccur.pairs(rows, "cell", "OBJEKTART").withColumnsRenamed({"item_a": "objektart_a", "item_b": "objektart_b"})


def p6_pairs(spark, d):
    return _together(spark, d).withColumns({"lift": F.round("lift", 6), "conviction": F.round("conviction", 6)})


def p6_found(spark, d):
    big = F.col("n_ab").cast("decimal(38,0)") * F.col("n") >= F.col("n_a").cast("decimal(38,0)") * F.col("n_b") * 10
    return _together(spark, d).where("n_ab >= 3 and 20 * n_ab >= least(n_a, n_b)").where(big).select("objektart_a", "objektart_b")


def p8_ids(spark, d):
    return encode.encode(t(spark, d, "documents").select("doc_id", "text"))


def p9_leaks(spark, d):
    return leaks.leaks(t(spark, d, "documents"), t(spark, d, "eval_items"))


def p9_found(spark, d):
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p9_stored_leaks(spark, d):
    """p9_leaks of the texts as they are stored, encodings and markup and all."""
    return leaks.leaks(t(spark, d, "documents"), t(spark, d, "eval_items"), read=leaks.whole)


def _docs(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def p10_found(spark, d):
    return spans.shared_pairs(_docs(spark, d)).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p10_shared(spark, d):
    return spans.shared_parts(_docs(spark, d)).withColumnRenamed("id", "doc_id").withColumn("share", F.round("share", 6))


QUERIES = [p1_found, p1_restored, p2_distinct_cells, p2_band, p2_partials, p2_joint_sources, p2_joint_objektart, p2_joint_band, p3_found, p5_found, p5_overlaps, p6_found, p6_pairs, p8_ids, p9_found, p9_leaks, p9_stored_leaks, p10_found, p10_shared]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def sql() -> dict[str, str]:
    five = """s AS (SELECT DISTINCT OBJEKTART AS o, cell FROM (SELECT OBJEKTART, unnest(h3_cells) AS cell FROM features WHERE OBJEKTART IS NOT NULL) WHERE cell IS NOT NULL),
      z AS (SELECT o, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.o AS objektart_a, b.o AS objektart_b, count(*) AS n_shared FROM s a JOIN s b ON a.cell = b.cell AND a.o < b.o GROUP BY 1, 2),
      r AS (SELECT p.objektart_a, p.objektart_b, x.n AS n_a, y.n AS n_b, p.n_shared, 0::BIGINT AS error_bound FROM p JOIN z x ON x.o = objektart_a JOIN z y ON y.o = objektart_b)"""
    six = """s AS (SELECT DISTINCT l.cell, f.OBJEKTART AS o FROM h3_lookup l JOIN features f USING (feature_id) WHERE l.cell IS NOT NULL AND f.OBJEKTART IS NOT NULL),
      z AS (SELECT o, count(*) AS n FROM s GROUP BY 1), t AS (SELECT count(DISTINCT cell) AS n FROM s), p AS (SELECT a.o AS objektart_a, b.o AS objektart_b, count(*) AS n_ab FROM s a JOIN s b ON a.cell = b.cell AND a.o < b.o GROUP BY 1, 2),
      r AS (SELECT p.objektart_a, p.objektart_b, x.n AS n_a, y.n AS n_b, p.n_ab, t.n AS n FROM p JOIN z x ON x.o = objektart_a JOIN z y ON y.o = objektart_b CROSS JOIN t)"""
    ten = "SELECT doc_id, i, md5_number(substring(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)"
    flags = ", ".join(f"grouping({k}) = 1 AS is_all_{k}" for k in KEYS)
    return {
        "p2_band": f"""SELECT {", ".join(KEYS)}, {flags}, count(DISTINCT cell) AS n, true AS inside FROM (SELECT {", ".join(KEYS)}, unnest(h3_cells) AS cell FROM features) WHERE cell IS NOT NULL GROUP BY CUBE ({", ".join(KEYS)})""",
        "p2_joint_band": f"WITH {five} SELECT objektart_a, objektart_b, n_a + n_b - n_shared AS n_union, n_shared, true AS inside FROM r",
        "p10_found": f"""WITH w AS (SELECT DISTINCT doc_id, h FROM ({ten})) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id""",
        "p10_shared": f"""WITH p AS ({ten}), r AS (SELECT h FROM p GROUP BY 1 HAVING min(doc_id) < max(doc_id)), s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p WHERE h IN (SELECT h FROM r)),
          c AS (SELECT doc_id, sum(least(400, i - coalesce(before, i - 400)))::INT AS shared FROM s GROUP BY 1)
          SELECT d.doc_id, coalesce(length(text), 0)::INT AS n_chars, coalesce(shared, 0)::INT AS shared_chars, coalesce(round(shared / nullif(length(text), 0)::DOUBLE, 6), 0) AS share FROM documents d LEFT JOIN c USING (doc_id)""",
        "p9_stored_leaks": """WITH w AS (SELECT 'd' AS k, doc_id AS id, regexp_extract_all(nfc_normalize(lower(text)), '[\\pL\\pN]+') AS w FROM documents UNION ALL SELECT 'i', item_id, regexp_extract_all(nfc_normalize(lower(text)), '[\\pL\\pN]+') FROM eval_items),
          r AS (SELECT k, id, p, array_to_string(w[p : p + 11], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - 10)) AS p FROM w WHERE len(w) >= 12)),
          h AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, i.p FROM r d JOIN r i ON d.run = i.run WHERE d.k = 'd' AND i.k = 'i'),
          s AS (SELECT *, lag(p) OVER (PARTITION BY doc_id, item_id ORDER BY p) AS before FROM h)
          SELECT doc_id, item_id, sum(least(12, p - coalesce(before, p - 12)))::BIGINT AS n_words FROM s GROUP BY 1, 2""",
        "p3_found": """SELECT OBJEKTART AS objektart, feature_id FROM features WHERE OBJEKTART IS NOT NULL AND source IS NOT NULL AND change_day IS NOT NULL AND h3_cell_count IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY OBJEKTART, source, change_day ORDER BY h3_cell_count DESC, feature_id) <= 3""",
        "p5_overlaps": f"WITH {five} SELECT * FROM r",
        "p5_found": f"WITH {five} SELECT objektart_a, objektart_b FROM r WHERE n_shared >= 3 AND 4 * n_shared >= least(n_a, n_b)",
        "p6_pairs": f"""WITH {six} SELECT *, round(n_ab * n::DOUBLE / (n_a::DOUBLE * n_b), 6) AS lift, CASE WHEN n_ab <> n_a THEN round((1 - n_b / n::DOUBLE) / (1 - n_ab / n_a::DOUBLE), 6) END AS conviction FROM r""",
        "p6_found": f"WITH {six} SELECT objektart_a, objektart_b FROM r WHERE n_ab >= 3 AND 20 * n_ab >= least(n_a, n_b) AND n_ab * n >= 10 * n_a * n_b",
    }
