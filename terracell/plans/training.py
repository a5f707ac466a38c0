"""The general record operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.operators import drift, filling, nearby
from terracell.sources.tables import table

NEAR_M = 15.0
# The fixed columns of the one geology table.
COLUMNS = {
    "DESCR": "text", "NOTATION": "text", "LITHO": "text", "AGE": "text", "sheet_no": "long",
    "geology_score": "double", "valide": "text", "bbox": "json",
}


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearby.pairs_within(table(spark, sf, "terrain_checkpoints"), "checkpoint_id", "lat", "lon", NEAR_M)


def p5_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The survey sectors that hold each checkpoint."""
    points = table(spark, sf, "terrain_checkpoints").where(nearby.valid_position(F.col("lat"), F.col("lon")))
    sectors = table(spark, sf, "sectors").withColumn("corners", nearby.box_corners("west", "south", "east", "north"))
    found = nearby.regions_of_points(points, "checkpoint_id", "lon", "lat", sectors, "sector_code", "corners")
    return found.select(F.col("point_id").alias("checkpoint_id"), F.col("region_id").alias("sector_code"))


def p6_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Every missing category with its filling, method and distance in years; null where nothing can be known."""
    forest = table(spark, sf, "forest")
    out = []
    for column, upper in (("essence_canonical", False), ("code_tfv", True)):
        filled = filling.fill_category(forest, "forest_id", "stand_code", "campaign", column, upper=upper)
        out.append(filled.select(F.lit(f"forest.{column}").alias("field"), F.col("row_id").cast("long"), "filled", "method", "distance"))
    return out[0].unionByName(out[1])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_filled(spark, sf).where("filled is not null").select("field", "row_id", "filled")


def p6_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Missing tree scores, interpolated between the campaigns of the stand."""
    filled = filling.fill_number(table(spark, sf, "forest"), "forest_id", "stand_code", "campaign", "tree_score")
    return filled.select("row_id", F.round("filled", 6).alias("filled"), "method", "distance")


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(table(spark, sf, "geology_raw"), table(spark, sf, "geology_files"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.top_level(_changes(spark, sf))


def p7_changes(spark: SparkSession, sf: str) -> DataFrame:
    return drift.dotted(_changes(spark, sf))


def p7_table(spark: SparkSession, sf: str) -> DataFrame:
    return drift.unified(table(spark, sf, "geology_raw"), table(spark, sf, "geology_files"), _changes(spark, sf), COLUMNS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p5_found, p5_regions, p6_found, p6_filled, p6_numbers, p7_found, p7_changes, p7_table)
}

# Letters that imitate, for the oracle's translate().
_FROM = "АВЕЅІЈКМНОРСТУХасеһіјорѕухΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχ"
_TO = "ABESIJKMHOPCTYXacehijopsyxABEZHIKMNOPTYXaikvopux"

_FILL = """
WITH raw AS (
    SELECT 'forest.essence_canonical' AS field, forest_id AS row_id, stand_code, campaign, essence_canonical AS v FROM forest
    UNION ALL SELECT 'forest.code_tfv', forest_id, stand_code, campaign, upper(code_tfv) FROM forest),
form AS (
    SELECT field, row_id, stand_code, campaign,
           trim(regexp_replace(nfc_normalize(translate(regexp_replace(
               array_to_string(list_transform(string_split(v, ''), lambda c: CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) ELSE c END), ''),
               '[\\x{00AD}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]', '', 'g'), '%s', '%s')), '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS v
    FROM raw),
val AS (SELECT *, CASE WHEN v = '' OR lower(v) IN (%s) THEN NULL ELSE v END AS p FROM form),
per AS (SELECT field, stand_code, campaign, min(p) AS lo, max(p) AS hi FROM val WHERE stand_code IS NOT NULL AND campaign IS NOT NULL GROUP BY ALL),
near AS (
    SELECT field, stand_code, campaign, lo, hi,
        last_value(CASE WHEN lo IS NOT NULL THEN struct_pack(c := campaign, lo := lo, hi := hi) END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
        first_value(CASE WHEN lo IS NOT NULL THEN struct_pack(c := campaign, lo := lo, hi := hi) END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a
    FROM per WINDOW w AS (PARTITION BY field, stand_code ORDER BY campaign)),
got AS (
    SELECT field, stand_code, campaign,
        CASE WHEN lo IS NOT NULL THEN CASE WHEN lo = hi THEN lo END
             WHEN least(b.lo, a.lo) = greatest(b.hi, a.hi) THEN least(b.lo, a.lo) END AS filled,
        CASE WHEN lo IS NOT NULL THEN 'same_period' ELSE 'neighbours' END AS method,
        CASE WHEN lo IS NOT NULL THEN 0 ELSE least(campaign - b.c, a.c - campaign) END AS distance
    FROM near),
out AS (SELECT val.field, row_id::BIGINT AS row_id, filled, CASE WHEN filled IS NOT NULL THEN method END AS method,
               CASE WHEN filled IS NOT NULL THEN distance END::BIGINT AS distance
        FROM val LEFT JOIN got USING (field, stand_code, campaign) WHERE p IS NULL)
""" % (_FROM, _TO, ", ".join("'" + s.replace("'", "''") + "'" for s in filling.STAND_INS))

_PAIRS = """
WITH p AS (SELECT checkpoint_id AS id, radians(lat) AS a, radians(lon) AS o FROM terrain_checkpoints
           WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)),
     g AS (SELECT *, floor(a / 4e-6::DOUBLE)::BIGINT AS band FROM p),
     h AS (SELECT * REPLACE (unnest([band - 1, band, band + 1]) AS band) FROM g)
SELECT x.id AS id_a, y.id AS id_b FROM g x JOIN h y ON x.band = y.band AND x.id < y.id
WHERE 2 * 6371008.8::DOUBLE * asin(sqrt(sin((x.a - y.a) / 2) ** 2 + cos(x.a) * cos(y.a) * sin((x.o - y.o) / 2) ** 2)) <= 15
"""

_DRIFT = """
WITH f AS (SELECT r.file_id, feed_code, edition, json_extract_string(payload, '$.feature_code') AS feature, payload
           FROM geology_raw r JOIN geology_files USING (file_id)),
e AS (SELECT file_id, feed_code, edition, feature, k AS name, json_extract(payload, '$."' || k || '"') AS v
      FROM (SELECT *, unnest(json_keys(payload)) AS k FROM f) WHERE k <> 'feature_code'),
t AS (SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer'
      WHEN 'DOUBLE' THEN 'decimal' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END AS kind FROM e),
p AS (SELECT file_id, feed_code, edition, name, list_sort(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL)) AS kinds FROM t GROUP BY ALL),
pair AS (SELECT n.file_id, o.file_id AS old_id FROM geology_files n JOIN geology_files o ON o.feed_code = n.feed_code AND o.edition = n.edition - 1),
gone AS (SELECT pair.file_id, old_id, p.name FROM pair JOIN p ON p.file_id = old_id WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.file_id = pair.file_id AND q.name = p.name)),
come AS (SELECT pair.file_id, old_id, p.name FROM pair JOIN p ON p.file_id = pair.file_id WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.file_id = old_id AND q.name = p.name)),
vals AS (SELECT file_id, name, feature, min(v::VARCHAR) AS lo, max(v::VARCHAR) AS hi FROM t WHERE kind IS NOT NULL GROUP BY ALL),
ren AS (SELECT g.file_id, g.name AS old_name, c.name AS new_name
        FROM gone g JOIN come c USING (file_id) JOIN vals a ON a.file_id = g.old_id AND a.name = g.name
        JOIN vals b ON b.file_id = c.file_id AND b.name = c.name AND b.feature = a.feature
        GROUP BY ALL HAVING avg((a.lo = b.lo AND a.hi = b.hi)::INT) >= 0.95)
SELECT file_id, 'renamed' AS drift_kind, old_name, new_name FROM ren
UNION ALL SELECT file_id, 'removed', name, '' FROM gone WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_id = gone.file_id AND ren.old_name = gone.name)
UNION ALL SELECT file_id, 'added', '', name FROM come WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_id = come.file_id AND ren.new_name = come.name)
UNION ALL SELECT pair.file_id, 'retyped', n.name, n.name FROM pair JOIN p n ON n.file_id = pair.file_id JOIN p o ON o.file_id = old_id AND o.name = n.name
          WHERE n.kinds <> o.kinds AND len(n.kinds) > 0 AND len(o.kinds) > 0
"""

ORACLE: dict[str, str] = {
    "p5_found": _PAIRS,
    "p5_regions": """SELECT checkpoint_id, s.sector_code FROM terrain_checkpoints t JOIN sectors s
        ON t.lon BETWEEN s.west AND s.east AND t.lat BETWEEN s.south AND s.north
        WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)""",
    "p6_found": _FILL + "SELECT field, row_id, filled FROM out WHERE filled IS NOT NULL",
    "p6_filled": _FILL + "SELECT * FROM out",
    "p6_numbers": """
WITH per AS (SELECT stand_code, campaign, avg(tree_score) AS m FROM forest WHERE stand_code IS NOT NULL GROUP BY ALL),
near AS (SELECT stand_code, campaign, m,
    last_value(CASE WHEN m IS NOT NULL THEN struct_pack(c := campaign, m := m) END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
    first_value(CASE WHEN m IS NOT NULL THEN struct_pack(c := campaign, m := m) END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a
    FROM per WINDOW w AS (PARTITION BY stand_code ORDER BY campaign))
SELECT forest_id::BIGINT AS row_id, round(coalesce(m, b.m + (a.m - b.m) * (campaign - b.c) / (a.c - b.c), b.m, a.m), 6) AS filled,
    CASE WHEN m IS NOT NULL THEN 'same_period' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'interpolated' WHEN a IS NOT NULL OR b IS NOT NULL THEN 'carried' END AS method,
    CASE WHEN m IS NOT NULL THEN 0 ELSE least(campaign - b.c, a.c - campaign) END::BIGINT AS distance
FROM forest LEFT JOIN near USING (stand_code, campaign) WHERE tree_score IS NULL""",
    "p7_found": _DRIFT,
}
