"""DuckDB SQL of the core queries, put together from common table expressions."""

from __future__ import annotations

from .queries import CONFIG, FILLED


def parent(c: str, r: str) -> str:
    return f"(({c} & ~(15::BIGINT << 52)) | ({r}::BIGINT << 52) | ((1::BIGINT << ((15 - {r}) * 3)::INT) - 1))"


def res(c: str) -> str:
    return f"(({c} >> 52) & 15)"


def m2(c: str) -> str:
    return f"(1024::BIGINT << (26 - 2 * {res(c)})::INT)"


LOOKUP = "lk AS (SELECT DISTINCT feature_id, cell FROM (SELECT feature_id, unnest(h3_cells) AS cell FROM features) WHERE cell IS NOT NULL)"


def ups(name: str, of: str, key: str, proper: bool) -> str:
    """name: (key, cell, anc) with every ancestor of every cell."""
    top = res("cell") + ("" if proper else " + 1")
    return f"{name} AS (SELECT {key}, cell, {parent('cell', 'r')} AS anc FROM (SELECT {key}, cell, unnest(range(0, {top})) AS r FROM {of}))"


COVER = ", ".join([
    "raw AS (SELECT DISTINCT OBJEKTART AS category, cell FROM (SELECT OBJEKTART, unnest(h3_cells) AS cell FROM features WHERE OBJEKTART IS NOT NULL) WHERE cell IS NOT NULL)",
    ups("ra", "raw", "category", True),
    "cov AS (SELECT * FROM raw WHERE (category, cell) NOT IN (SELECT a.category, a.cell FROM ra a JOIN raw b ON a.category = b.category AND a.anc = b.cell))",
    f"areas AS (SELECT category, sum({m2('cell')})::BIGINT AS area_m2 FROM cov GROUP BY 1)",
])
TOTAL = ", ".join([
    f"tc AS (SELECT DISTINCT 1 AS one, CASE WHEN {res('cell')} > 10 THEN {parent('cell', '10')} ELSE cell END AS cell FROM (SELECT unnest(h3_cells) AS cell FROM features) WHERE cell IS NOT NULL)",
    ups("tu", "tc", "one", True),
    f"total AS (SELECT sum({m2('cell')})::BIGINT AS total_m2 FROM tc WHERE cell NOT IN (SELECT a.cell FROM tu a JOIN tc b ON a.anc = b.cell))",
])
MATCH = ", ".join([
    ups("cu", "cov", "category", False),
    "mt AS (SELECT a.category AS fine_key, b.category AS coarse_key, a.cell, a.cell <> b.cell AS strict FROM cu a JOIN cov b ON a.anc = b.cell)",
])
PAIRS = f"pr AS (SELECT key_a, key_b, sum(m)::BIGINT AS shared_m2 FROM (SELECT fine_key AS key_a, coarse_key AS key_b, {m2('cell')} AS m FROM mt WHERE fine_key <> coarse_key UNION ALL SELECT coarse_key, fine_key, {m2('cell')} FROM mt WHERE strict AND fine_key <> coarse_key) GROUP BY 1, 2)"
MATRIX = ", ".join([
    COVER, TOTAL, MATCH, PAIRS,
    "pp AS (SELECT category, area_m2::DOUBLE / total_m2 AS p FROM areas, total)",
    "cats AS (SELECT DISTINCT OBJEKTART AS c FROM features WHERE OBJEKTART IS NOT NULL)",
    """d0 AS (SELECT x.c AS cat_a, y.c AS cat_b, coalesce(a.p, 0) AS p_a, coalesce(b.p, 0) AS p_b, CASE WHEN x.c = y.c THEN coalesce(a.p, 0) ELSE coalesce(s.shared_m2, 0)::DOUBLE / t.total_m2 END AS p_ab
      FROM cats x CROSS JOIN cats y CROSS JOIN total t LEFT JOIN pp a ON a.category = x.c LEFT JOIN pp b ON b.category = y.c LEFT JOIN pr s ON s.key_a = x.c AND s.key_b = y.c)""",
    "d1 AS (SELECT *, CASE WHEN p_ab <= 1e-15 THEN -1.0 WHEN -log2(p_ab) = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, log2(p_ab / (p_a * p_b)) / -log2(p_ab))) END AS npmi FROM d0)",
    """m AS (SELECT cat_a, cat_b, npmi, CASE WHEN cat_a = cat_b THEN npmi * 0.5 WHEN p_a + p_b > 0 THEN npmi * p_b / (p_a + p_b) END AS b1,
      CASE WHEN cat_a = cat_b THEN npmi WHEN p_a > 0 THEN npmi * p_ab / p_a ELSE 0.0 END AS b2 FROM d1)""",
])


def assoc(threshold: float, most: int, static: list[str]) -> str:
    drop = f"WHERE cat_b NOT IN ({', '.join(repr(s) for s in static)})" if static else ""
    return f"""asc0 AS (SELECT * FROM (SELECT cat_a, cat_b, b1, row_number() OVER (PARTITION BY cat_a ORDER BY b1 DESC, cat_b) AS assoc_rank FROM m WHERE b1 >= {threshold} AND cat_a <> cat_b) WHERE assoc_rank <= {most}),
      ass AS (SELECT * FROM asc0 {drop})"""


def near(of: str = "feature_id % 50 = 0") -> str:
    return ", ".join([
        LOOKUP,
        f"src AS (SELECT feature_id AS src_id, NAME AS src_name, OBJEKTART AS src_cat FROM features WHERE {of})",
        "sc AS (SELECT src_id, cell FROM src JOIN lk ON src_id = feature_id)",
        ups("su", "sc", "src_id", False), ups("tu2", "lk", "feature_id", True),
        f"""sh AS (SELECT src_id, feature_id, sum(m)::BIGINT AS shared_m2 FROM (SELECT a.src_id, b.feature_id, {m2('a.cell')} AS m FROM su a JOIN lk b ON a.anc = b.cell
          UNION ALL SELECT b.src_id, a.feature_id, {m2('a.cell')} FROM tu2 a JOIN sc b ON a.anc = b.cell) GROUP BY 1, 2)""",
        f"own AS (SELECT feature_id, sum({m2('cell')})::BIGINT AS own_m2 FROM lk GROUP BY 1)",
        "nr AS (SELECT s.src_id, src.src_cat, s.feature_id, f.UUID, f.NAME, f.OBJEKTART, s.shared_m2, own.own_m2 FROM sh s JOIN features f USING (feature_id) JOIN src ON src.src_id = s.src_id JOIN own ON own.feature_id = s.feature_id)",
    ])


def static(slots) -> str:
    table = ", ".join(f"('{s.objektart}', {i}, '{s.label}', {s.slots})" for i, s in enumerate(slots)) or "('', 0, '', 0)"
    return f"""sl(OBJEKTART, slot_order, label, slots) AS (VALUES {table}),
      stk AS (SELECT * FROM (SELECT src_id, slot_order, label, slots, feature_id, NAME, row_number() OVER (PARTITION BY src_id, slot_order ORDER BY shared_m2 DESC, feature_id) AS pos FROM nr JOIN sl USING (OBJEKTART)) WHERE pos <= slots)"""


def alloc(max_slots: int, k: int) -> str:
    return f"""rw AS (SELECT nr.*, a.assoc_rank FROM nr JOIN ass a ON a.cat_a = nr.src_cat AND a.cat_b = nr.OBJEKTART WHERE nr.src_id <> nr.feature_id),
      rp AS (SELECT *, row_number() OVER (PARTITION BY src_id, assoc_rank ORDER BY shared_m2 DESC, feature_id) AS pos FROM rw),
      fs AS (SELECT *, min(pos) OVER (PARTITION BY src_id, assoc_rank, UUID) AS fp FROM rp),
      ur AS (SELECT *, dense_rank() OVER (PARTITION BY src_id, assoc_rank ORDER BY fp) AS u_rank FROM fs),
      pc AS (SELECT src_id, assoc_rank, least(max(u_rank), {k}) AS c FROM ur GROUP BY 1, 2),
      al AS (SELECT src_id, assoc_rank, least({k}, greatest(0, {max_slots} - coalesce(sum(c) OVER (PARTITION BY src_id ORDER BY assoc_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS allowed FROM pc),
      tk AS (SELECT ur.* FROM ur JOIN al USING (src_id, assoc_rank) WHERE u_rank <= allowed)"""


def fill(cfg) -> str:
    return f"""us AS (SELECT src_id, count(*) AS used FROM tk GROUP BY 1),
      rm AS (SELECT src.src_id, least({cfg.max_filler_slots}, {cfg.max_slots} - coalesce(used, 0)) AS room FROM src LEFT JOIN us ON us.src_id = src.src_id),
      fl AS (SELECT f.* FROM (SELECT src_id, feature_id, OBJEKTART, NAME, row_number() OVER (PARTITION BY src_id ORDER BY own_m2, feature_id) AS pos FROM nr
        WHERE src_id <> feature_id AND (src_id, feature_id) NOT IN (SELECT src_id, feature_id FROM tk)) f JOIN rm ON rm.src_id = f.src_id WHERE pos <= room)"""


def text(names: str, n: str) -> str:
    return f"CASE WHEN {n} = 1 THEN {names}[1] ELSE array_to_string({names}[1:{n} - 1], ', ') || ' und ' || {names}[{n}] END"


def section(name: str, rows: str, order: str, place: str) -> str:
    return f"""{name} AS (SELECT src_id, string_agg({text('ns', 'len(ns)')} || coalesce(', ' || OBJEKTART, ''), ', ' ORDER BY o) AS s FROM
      (SELECT src_id, OBJEKTART, {order} AS o, list(NAME ORDER BY {place}) AS ns FROM {rows} WHERE NAME IS NOT NULL GROUP BY src_id, OBJEKTART{', ' + order if '(' not in order else ''}) GROUP BY src_id)"""


def sentence(cfg, of: str = "feature_id % 50 = 0") -> str:
    """CTEs that end in se (feature_id, sentence)."""
    parts = [MATRIX, assoc(cfg.assoc_threshold, cfg.max_categories, [s.objektart for s in cfg.static_slots]), near(of), static(cfg.static_slots), alloc(cfg.max_slots, cfg.max_slots_per_category), fill(cfg)]
    parts += [
        "ss AS (SELECT src_id, string_agg(NAME || ', ' || label, ', ' ORDER BY slot_order, pos) AS s FROM stk WHERE NAME IS NOT NULL GROUP BY 1)",
        section("bei", "tk", "assoc_rank", "pos"),
        "fl2 AS (SELECT *, min(pos) OVER (PARTITION BY src_id, OBJEKTART) AS fo FROM fl)",
        section("nahe", "fl2", "fo", "pos"),
        """se AS (SELECT src.src_id AS feature_id, concat_ws(', ', CASE WHEN nullif(src_name, '') IS NOT NULL AND src_cat IS NOT NULL THEN src_name || ', ' || src_cat WHEN nullif(src_name, '') IS NOT NULL THEN src_name ELSE coalesce(src_cat, '') END,
          'bei ' || bei.s, 'nahe ' || nahe.s, 'in ' || ss.s) AS sentence FROM src LEFT JOIN bei ON bei.src_id = src.src_id LEFT JOIN nahe ON nahe.src_id = src.src_id LEFT JOIN ss ON ss.src_id = src.src_id)""",
    ]
    return ", ".join(parts)


def q(*parts: str, select: str) -> str:
    return f"WITH {', '.join(parts)} {select}"


def sql() -> dict[str, str]:
    from ..config import SentenceConfig

    slots = [s.objektart for s in CONFIG.static_slots]
    full = assoc(CONFIG.assoc_threshold, CONFIG.max_categories, slots)
    out = {
        "source_discovery": "SELECT s.name, s.location_id_name FROM gaz_source s JOIN gazetteer g ON g.id = s.gazetteer_id WHERE g.name = 'landnamen3d'",
        "feature_scan_union": "SELECT UUID, NAME, OBJEKTART, source FROM raw_features WHERE geometry IS NOT NULL AND source IN (SELECT name FROM gaz_source)",
        "feature_scan_tolerant": "SELECT source, count(*) AS n, count(NAME) AS n_named FROM raw_features WHERE geometry IS NOT NULL AND source IN (SELECT name FROM gaz_source) GROUP BY 1",
        "feature_ids": "SELECT row_number() OVER (ORDER BY source NULLS FIRST, UUID NULLS FIRST, NAME NULLS FIRST, OBJEKTART NULLS FIRST, geometry NULLS FIRST) - 1 AS feature_id, UUID, NAME, OBJEKTART, source FROM raw_features",
        "lookup_build": q(LOOKUP, select=f"SELECT feature_id, cell, {res('cell')}::TINYINT AS cell_res FROM lk"),
        "store_counts": q(LOOKUP, select="SELECT 'features' AS what, count(*) AS n FROM features UNION ALL SELECT 'cells', sum(h3_cell_count)::BIGINT FROM features UNION ALL SELECT 'lookup', count(*) FROM lk"),
        "source_counts": "SELECT source, count(*) AS n FROM features GROUP BY 1",
        "category_list": "SELECT DISTINCT OBJEKTART AS category FROM features WHERE OBJEKTART IS NOT NULL ORDER BY 1",
        "category_area": q(COVER, select="SELECT category, area_m2 FROM areas"),
        "total_area": q(TOTAL, select="SELECT total_m2 FROM total"),
        "pair_intersection_area": q(COVER, MATCH, PAIRS, select="SELECT * FROM pr"),
        "npmi_matrix": q(MATRIX, select="SELECT cat_a, cat_b, round(npmi, 6) + 0.0 AS npmi FROM m"),
        "b1_matrix": q(MATRIX, select="SELECT cat_a, cat_b, round(b1, 6) + 0.0 AS b1 FROM m"),
        "b2_matrix": q(MATRIX, select="SELECT cat_a, cat_b, round(b2, 6) + 0.0 AS b2 FROM m"),
        "matrix_pivot": q(MATRIX, "w AS (SELECT cat_a, cat_b, round(b1, 6) + 0.0 AS b1 FROM m)", select="PIVOT w ON cat_b USING max(b1) GROUP BY cat_a"),
        "associated_categories": q(MATRIX, full, select="SELECT cat_a, cat_b, round(b1, 6) + 0.0 AS b1, assoc_rank FROM asc0"),
        "associated_dynamic": q(MATRIX, full, select="SELECT cat_a, cat_b, assoc_rank FROM ass"),
        "slot_allocation_proportional": q(MATRIX, full, select="SELECT cat_a, cat_b, least(5, greatest(0, round_even(b1 / s * 10, 0)))::INT AS slots FROM (SELECT *, sum(b1) OVER (PARTITION BY cat_a) AS s FROM asc0) WHERE s > 0"),
        "uuid_lookup": "SELECT c.candidate_id, c.location_id_value AS uuid, f.feature_id, f.NAME, f.OBJEKTART FROM candidates c LEFT JOIN (SELECT * FROM features QUALIFY row_number() OVER (PARTITION BY UUID ORDER BY feature_id) = 1) f ON f.UUID = c.location_id_value",
        "intersecting_features": q(near(), select="SELECT src_id, feature_id, OBJEKTART, shared_m2 FROM nr WHERE src_id <> feature_id"),
        "overlap_static_topk": q(near(), static(CONFIG.static_slots), select="SELECT src_id, label, pos, feature_id, NAME FROM stk"),
        "slot_allocation": q(MATRIX, full, near(), alloc(CONFIG.max_slots, CONFIG.max_slots_per_category), select="SELECT src_id, OBJEKTART, feature_id, u_rank FROM tk"),
        "filler_features": q(MATRIX, assoc(FILLED.assoc_threshold, FILLED.max_categories, slots), near(), alloc(FILLED.max_slots, FILLED.max_slots_per_category), fill(FILLED), select="SELECT src_id, pos, feature_id FROM fl"),
        "sentence_static": q(sentence(SentenceConfig(static_slots=CONFIG.static_slots, max_slots=0)), select="SELECT * FROM se"),
        "sentence_dynamic": q(sentence(SentenceConfig()), select="SELECT * FROM se"),
        "sentence_full": q(sentence(CONFIG), select="SELECT * FROM se"),
        "sentence_filler": q(sentence(FILLED), select="SELECT * FROM se"),
        "gather_candidates": """WITH c AS (SELECT * FROM candidates), r AS (SELECT doc_id, ref_idx, mention FROM c WHERE doc_id IS NOT NULL AND ref_idx IS NOT NULL GROUP BY 1, 2, 3
          HAVING max(CASE WHEN similarity >= 0.6 THEN location_id_value END) IS NULL) SELECT r.doc_id, r.ref_idx, f.UUID, f.feature_id FROM r JOIN features f ON f.NAME = r.mention
          WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = r.doc_id AND c.ref_idx = r.ref_idx AND c.location_id_value = f.UUID)""",
        "search_tiers": """WITH m AS (SELECT DISTINCT mention AS t FROM candidates WHERE mention IS NOT NULL), f AS (SELECT feature_id, NAME AS t FROM features WHERE NAME IS NOT NULL),
          mk AS (SELECT t, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS b FROM m), fk AS (SELECT feature_id, t, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS b FROM f),
          ml AS (SELECT *, regexp_replace(strip_accents(b), '[^\\pL\\pN]', '', 'g') AS c FROM mk), fl AS (SELECT *, regexp_replace(strip_accents(b), '[^\\pL\\pN]', '', 'g') AS c FROM fk),
          h AS (SELECT ml.t, feature_id, 1 AS tier FROM ml JOIN fl USING (t) UNION ALL SELECT ml.t, feature_id, 2 FROM ml JOIN fl USING (b) WHERE b <> '' UNION ALL SELECT ml.t, feature_id, 3 FROM ml JOIN fl USING (c) WHERE c <> '')
          SELECT t AS mention, feature_id, min(tier)::INT AS tier FROM h GROUP BY 1, 2""",
        "mention_text": "SELECT doc_id, substring(text, 1 + length(text) // 10, length(text) // 5 - length(text) // 10) AS mention FROM documents",
        "cell_from_text": "SELECT feature_id, cell AS from_hex, cell AS from_decimal FROM h3_lookup",
        "lookup_store": q(LOOKUP, select=f"SELECT feature_id, cell, {res('cell')}::TINYINT AS cell_res FROM lk"),
        "uuid_store": "SELECT UUID, feature_id, NAME, OBJEKTART FROM features WHERE UUID IS NOT NULL",
        "matrix_csv": q(MATRIX, select="SELECT cat_a, cat_b, round(b1, 6) + 0.0 AS b1 FROM m"),
        "config_precedence": "SELECT * FROM (VALUES ('given', 'Given', 10), ('bundled', 'Gemeinde,Bezirk,Kanton', 10), ('preset', 'Gemeinde,Kanton,Bezirk', 10)) v(wins, labels, max_slots)",
        "candidates_to_embed": """SELECT DISTINCT candidate_id FROM candidates WHERE candidate_id IS NOT NULL AND NOT coalesce(similarity >= 0.6 AND location_id_value IS NOT NULL, false)
          AND candidate_id NOT IN (SELECT candidate_id FROM candidates WHERE gathered_at < TIMESTAMPTZ '2024-01-15 00:00:00+00' AND candidate_id IS NOT NULL)""",
        "resolve_best": "SELECT doc_id, ref_idx, candidate_id FROM (SELECT doc_id, ref_idx, candidate_id, max(similarity) AS similarity FROM candidates WHERE similarity >= 0.6 GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY doc_id, ref_idx ORDER BY similarity DESC, candidate_id NULLS FIRST) = 1",
        "description_fallback": q(
            "kc AS (SELECT c.candidate_id, c.mention, f.feature_id FROM candidates c LEFT JOIN (SELECT UUID, min(feature_id) AS feature_id FROM features WHERE UUID IS NOT NULL GROUP BY 1) f ON f.UUID = c.location_id_value)",
            sentence(CONFIG, "feature_id IN (SELECT feature_id FROM kc)"),
            select="SELECT kc.candidate_id, kc.feature_id, coalesce(se.sentence, kc.mention) AS description FROM kc LEFT JOIN se ON se.feature_id = kc.feature_id",
        ),
        "cell_parent": f"SELECT feature_id, cell, CASE WHEN {res('cell')} >= 9 THEN {parent('cell', '9')} END AS parent_9, CASE WHEN {res('cell')} >= 5 THEN {parent('cell', '5')} END AS parent_5 FROM h3_lookup WHERE cell IS NOT NULL",
        "cell_resolution": f"SELECT feature_id, {res('cell')}::INT AS res, ((cell >> 45) & 127)::INT AS base, {m2('cell')} AS area_m2 FROM h3_lookup",
        "multires_union": q(COVER, select="SELECT category, cell FROM cov"),
        "multires_intersection": q(COVER, MATCH, select="SELECT fine_key, coarse_key, cell, strict FROM mt WHERE fine_key <> coarse_key"),
        "cosine_resolve": """WITH s AS (SELECT q.vec_id AS q_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)
          SELECT q_id, vec_id, similarity FROM s WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, vec_id) = 1""",
    }
    i = [f"((cell >> {(15 - k) * 3}) & 7)" for k in range(1, 14)]
    xs = " + ".join(f"(({d} & 1) << {13 - k})" for k, d in enumerate(i, 1))
    ys = " + ".join(f"((({d} >> 1) & 1) << {13 - k})" for k, d in enumerate(i, 1))
    loc = f"""loc AS (SELECT feature_id, cell, (((cell >> 45) & 127) % 11) * 9375 + {xs} AS x, (((cell >> 45) & 127) // 11) * 9375 + {ys} AS y FROM
      (SELECT feature_id, list_distinct(h3_cells) AS l, list_distinct(h3_cells)[1] AS cell FROM features) WHERE len(l) = 1 AND {res('cell')} = 13)"""
    out["p4_found"] = q(
        loc, ups("lu", "loc", "feature_id", False), LOOKUP,
        select="""SELECT 'near' AS relation, a.feature_id AS feature_id_a, b.feature_id AS feature_id_b FROM (SELECT *, x + unnest(range(-3, 4)) AS bx FROM loc) a JOIN loc b ON b.x = a.bx
          WHERE a.feature_id < b.feature_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9 UNION ALL
          SELECT DISTINCT 'inside', least(a.feature_id, b.feature_id), greatest(a.feature_id, b.feature_id) FROM lu a JOIN lk b ON a.anc = b.cell JOIN features f ON f.feature_id = b.feature_id WHERE f.OBJEKTART = 'Gemeindegebiet' AND a.feature_id <> b.feature_id""",
    )
    # Well-known binary by hexadecimal digits: little-endian doubles and counts.
    def double(at: str) -> str:
        bits = " + ".join(f"(('0x' || substr(x, 2 * ({at}) + {2 * k + 1}, 2))::HUGEINT << {8 * k})" for k in range(8))
        return f"(SELECT CASE WHEN b & 9223372036854775807 = 0 THEN 0.0 ELSE (CASE WHEN b >> 63 = 1 THEN -1 ELSE 1 END) * (1 + (b & 4503599627370495)::DOUBLE / 4503599627370496) * pow(2, (((b >> 52) & 2047) - 1023)::DOUBLE) END FROM (SELECT {bits} AS b))"

    shapes = """raw AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST, UUID NULLS FIRST, NAME NULLS FIRST, OBJEKTART NULLS FIRST, geometry NULLS FIRST) - 1 AS region_id, *, hex(geometry) AS x FROM raw_features)"""
    out["p4_inside_polygons"] = q(
        loc, shapes,
        f"""ring AS (SELECT region_id, k, {double('13 + 16 * k')} AS px, {double('21 + 16 * k')} AS py FROM (SELECT region_id, x, unnest(range(0, ('0x' || substr(x, 19, 2))::INT)) AS k FROM raw
          WHERE x LIKE '010300000001000000%' AND length(x) >= 26 AND length(x) >= 2 * (13 + 16 * ('0x' || substr(x, 19, 2))::INT)))""",
        "edge AS (SELECT a.region_id, a.px AS ax, a.py AS ay, b.px AS qx, b.py AS qy FROM ring a JOIN ring b ON a.region_id = b.region_id AND b.k = a.k + 1)",
        "spot AS (SELECT feature_id, (x + 0.5) * 32 + 2400000 AS x, (y + 0.5) * 32 + 1000000 AS y FROM loc)",
        select="SELECT feature_id, region_id FROM spot JOIN edge ON (ay > y) <> (qy > y) AND x < (qx - ax) * (y - ay) / (qy - ay) + ax GROUP BY 1, 2 HAVING count(*) % 2 = 1",
    )
    digits = " + ".join(f"(((((iy >> {13 - k}) & 1) * 2 + ((ix >> {13 - k}) & 1))::BIGINT) << {(15 - k) * 3})" for k in range(1, 14))
    out["geometry_points"] = q(
        f"pt AS (SELECT UUID, NAME, OBJEKTART, source, {double('5')} AS px, {double('13')} AS py FROM (SELECT *, hex(geometry) AS x FROM raw_features) WHERE x LIKE '0101000000%' AND length(x) >= 42)",
        "b AS (SELECT *, floor((px - 2400000) / 300000)::INT AS jx, floor((py - 1000000) / 300000)::INT AS jy FROM pt WHERE isfinite(px) AND isfinite(py))",
        "i AS (SELECT *, floor((px - 2400000 - jx * 300000) / 32)::INT AS ix, floor((py - 1000000 - jy * 300000) / 32)::INT AS iy FROM b WHERE jx BETWEEN 0 AND 10 AND jy >= 0 AND jy * 11 + jx < 128)",
        select=f"SELECT UUID, NAME, OBJEKTART, source, [(1::BIGINT << 59) + (13::BIGINT << 52) + ((jy * 11 + jx)::BIGINT << 45) + {digits} + 63] AS h3_cells, 13::TINYINT AS h3_resolution, 1::INT AS h3_cell_count FROM i WHERE ix < 8192 AND iy < 8192",
    )
    # Shapes that can be read whole: as many bytes as their counts say (the raw features are points, lines and polygons of one ring).
    count = "('0x' || substr(x, {0}, 2))::INT + 256 * ('0x' || substr(x, {1}, 2))::INT"
    line, polygon = count.format(11, 13), count.format(19, 21)
    whole = f"CASE WHEN x LIKE '0101000000%' THEN length(x) >= 42 WHEN length(x) < 26 THEN false WHEN x LIKE '0102000000%' THEN length(x) >= 2 * (9 + 16 * ({line})) WHEN x LIKE '010300000001000000%' THEN length(x) >= 2 * (13 + 16 * ({polygon})) ELSE false END"
    out["build_store"] = f"""SELECT g.name AS gazetteer, r.source, count(*) AS n FROM (SELECT source, hex(geometry) AS x FROM raw_features) r JOIN gaz_source s ON s.name = r.source JOIN gazetteer g ON g.id = s.gazetteer_id
      WHERE {whole} GROUP BY 1, 2"""
    out["geometry_drops"] = f"SELECT source, count(*) AS n_read, count(*) - count(*) FILTER (WHERE {whole}) AS n_dropped FROM (SELECT source, hex(geometry) AS x FROM raw_features WHERE geometry IS NOT NULL) GROUP BY 1"
    out["p7_keys"] = "SELECT OBJEKTART AS objektart, count(*) AS n_rows, sum(h3_cell_count)::BIGINT AS sum_cells, max(h3_cell_count) AS max_cells FROM features GROUP BY 1"
    out["p7_found"] = "SELECT OBJEKTART AS objektart FROM features WHERE OBJEKTART IS NOT NULL GROUP BY 1 HAVING count(*) >= 0.05 * (SELECT count(*) FROM features)"
    return out
