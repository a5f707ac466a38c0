"""Grids, boxes, points, days and pixels made from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell import fixed
from terracell.sources.tables import table

NX, CELL = 125, 10.0
SPECIES = {"1-URGENT": "Frêne commun", "2-HIGH": "Hêtre", "3-MEDIUM": "Sapin pectiné", "4-NOT SPECIFIED": "Chêne pubescent"}
GEOLOGY = {"F": "calcaire", "O": "marne", "P": "granite"}


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """``ix, iy, z, zs, species, geology, water, urban``: rough and smooth surface, names and masks."""
    k = F.col("o_orderkey")
    ix, iy = k % NX, F.floor(k / NX)
    named = lambda c, t: F.coalesce(*[F.when(F.col(c) == a, b) for a, b in t.items()])
    return table(spark, sf, "orders").select(
        ix.cast("int").alias("ix"),
        iy.cast("int").alias("iy"),
        F.when(k % 53 != 0, 100 + F.col("o_totalprice") / 300).alias("z"),
        (300 + 0.1 * F.pow(ix - 60, 2) + 0.02 * F.pow(iy % 120 - 60, 2)).alias("zs"),
        named("o_orderpriority", SPECIES).alias("species"),
        named("o_orderstatus", GEOLOGY).alias("geology"),
        (k % 97 == 0).alias("water"),
        (k * 7919 % 211 == 0).alias("urban"),
    )


def rows(cells: DataFrame) -> int:
    """The number of rows of a grid, by one aggregation."""
    last = cells.agg(F.max("iy")).first()[0]
    return 0 if last is None else last + 1


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """``seq, xmin, ymin, xmax, ymax, code, score`` in cell units, spread over all rows of the grid."""
    ny = rows(grid(spark, sf))
    k, side = F.col("p_partkey"), F.col("p_size") / 10
    return table(spark, sf, "part").select(
        k.alias("seq"),
        (k * 37 % NX).cast("double").alias("xmin"),
        (k * 91 % ny).cast("double").alias("ymin"),
        (k * 37 % NX + side).alias("xmax"),
        (k * 91 % ny + side).alias("ymax"),
        (F.col("p_size") % 7 + 1).cast("int").alias("code"),
        ((F.col("p_size") % 10) / 10).alias("score"),
    )


# An uneven octagon with an octagonal hole, as directions and lengths of its corners.
CORNERS = ((1.0, 0.25), (0.75, 0.75), (0.125, 1.0), (-0.75, 0.625), (-1.0, 0.0), (-0.625, -0.75), (0.0, -1.0), (0.875, -0.5))
HOLE = 0.375


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """``seq, code, score, parts``: polygons with a hole, in cell units, spread over all rows of the grid."""
    ny = rows(grid(spark, sf))
    k, r = F.col("p_partkey"), F.col("p_size") / 8

    def ring(scale: float) -> Column:
        far = [r * (1 + F.pmod(k + j, F.lit(3)) * 0.5) * scale for j in range(len(CORNERS))]
        return F.array(*[F.array(k * 37 % NX + 0.3 + far[j] * dx, k * 91 % ny + 0.7 + far[j] * dy) for j, (dx, dy) in enumerate(CORNERS)])

    spread = table(spark, sf, "part").select("p_partkey", "p_size").repartition("p_partkey")  # a row is small, its shape is not
    return spread.select(
        k.alias("seq"), (F.col("p_size") % 7 + 1).cast("int").alias("code"), ((F.col("p_size") % 10) / 10).alias("score"), F.array(ring(1.0), ring(HOLE)).alias("parts")
    )


URBAN_TYPES = ("residential", "Commercial", "route", "batiment", "parking", "hangar", "cemetery")
WATER_TYPES = ("bras_mort", "plan_eau", "canal", "riviere", "torrent")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """``seq, bonus, parts``: lines of three places, in cell units, spread over all rows of the grid."""
    ny = rows(grid(spark, sf))
    k = F.col("s_suppkey")
    x, y = k * 41 % NX + 0.3, k * 67 % ny + 0.45
    mid_x, mid_y = x + (k % 9 - 4) * 2.5, y + (k % 7 - 3) * 3.5
    bonus = F.get(F.array(*[F.lit(fixed.WATER_BONUS[t]) for t in WATER_TYPES]), F.pmod(k, F.lit(len(WATER_TYPES))))
    return table(spark, sf, "supplier").select(k.alias("seq"), bonus.alias("bonus"), F.array(F.array(F.array(x, y), F.array(mid_x, mid_y), F.array(mid_x + 3.1, mid_y - 2.2))).alias("parts"))


def built_up(spark: SparkSession, sf: str) -> DataFrame:
    """``parts, urban_type`` of the polygons."""
    return shapes(spark, sf).select("parts", F.get(F.array(*map(F.lit, URBAN_TYPES)), F.pmod("code", F.lit(len(URBAN_TYPES)))).alias("urban_type"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """``seq, px, py, value`` in cell units, spread over all rows of the grid."""
    ny = rows(grid(spark, sf))
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("seq"),
        (k * 53 % NX).cast("double").alias("px"),
        (k * 29 % ny).cast("double").alias("py"),
        F.when(F.col("c_mktsegment") == "BUILDING", 0.90).otherwise(0.75).alias("value"),
    )


def days(spark: SparkSession, sf: str) -> DataFrame:
    """``day, t, tmin, rain, rh, wind``."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    counts = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        n("view").alias("nv"), n("error").alias("ne"), n("click").alias("nc"), n("purchase").alias("np")
    )
    return counts.select(
        "day",
        (F.col("nv") * 5 % 29 - 1).cast("double").alias("t"),
        (F.col("nv") * 5 % 29 - 7).cast("double").alias("tmin"),
        F.greatest(F.lit(0), F.col("ne") * 11 % 37 - 14).cast("double").alias("rain"),
        (35 + F.col("nc") * 13 % 66).cast("double").alias("rh"),
        (F.col("np") * 7 % 46).cast("double").alias("wind"),
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """``px, py, r, g, b, valid``."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("px"),
        F.col("l_linenumber").alias("py"),
        (F.col("l_orderkey") % 256).cast("int").alias("r"),
        (F.col("l_partkey") % 256).cast("int").alias("g"),
        (F.col("l_suppkey") * 3 % 256).cast("int").alias("b"),
        (F.col("l_partkey") % 17 != 0).alias("valid"),
    )


def _case(column: str, names: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + " END"


SQL_GRID = f"""grid AS (SELECT (o_orderkey % 125)::INT AS ix, (o_orderkey // 125)::INT AS iy,
    CASE WHEN o_orderkey % 53 <> 0 THEN 100 + o_totalprice / 300 END AS z,
    300 + 0.1::DOUBLE * pow(o_orderkey % 125 - 60, 2) + 0.02::DOUBLE * pow((o_orderkey // 125) % 120 - 60, 2) AS zs,
    {_case('o_orderpriority', SPECIES)} AS species, {_case('o_orderstatus', GEOLOGY)} AS geology,
    o_orderkey % 97 = 0 AS water, o_orderkey * 7919 % 211 = 0 AS urban FROM orders)"""
SQL_BOXES = """boxes AS (SELECT p_partkey AS seq, (p_partkey * 37 % 125)::DOUBLE AS xmin, (p_partkey * 91 % ny)::DOUBLE AS ymin,
    p_partkey * 37 % 125 + p_size / 10 AS xmax, p_partkey * 91 % ny + p_size / 10 AS ymax, p_size % 7 + 1 AS code, (p_size % 10) / 10 AS score
    FROM part, (SELECT max(o_orderkey) // 125 + 1 AS ny FROM orders))"""
SQL_SHAPES = f"""corner AS (SELECT p_partkey AS seq, p_size % 7 + 1 AS code, (p_size % 10) / 10 AS score, ring, j,
    p_partkey * 37 % 125 + 0.3::DOUBLE + p_size / 8 * (1 + (p_partkey + j) % 3 * 0.5::DOUBLE) * ring * dx AS x,
    p_partkey * 91 % ny + 0.7::DOUBLE + p_size / 8 * (1 + (p_partkey + j) % 3 * 0.5::DOUBLE) * ring * dy AS y
    FROM part, (SELECT max(o_orderkey) // 125 + 1 AS ny FROM orders), (VALUES {", ".join(f"({j}, {dx}::DOUBLE, {dy}::DOUBLE)" for j, (dx, dy) in enumerate(CORNERS))}) c(j, dx, dy),
    (VALUES (1.0::DOUBLE), ({HOLE}::DOUBLE)) r(ring)),
edge AS (SELECT a.seq, a.code, a.score, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corner a JOIN corner b ON b.seq = a.seq AND b.ring = a.ring AND b.j = (a.j + 1) % {len(CORNERS)}),
shape AS (SELECT seq, code, score, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM corner GROUP BY ALL)"""


def sql_in_shapes(touched: bool, reach: float = 0.0) -> str:
    """CTE ``hit``: every (cell, shape), by looking at each edge from each cell of the box around the shape."""
    near = f"ix BETWEEN floor(xmin) - {reach} AND xmax + {reach} AND iy BETWEEN floor(ymin) - {reach} AND ymax + {reach}"
    inside = "sum(((y1 > iy + 0.5::DOUBLE) <> (y2 > iy + 0.5::DOUBLE) AND ix + 0.5::DOUBLE < (x2 - x1) * (iy + 0.5::DOUBLE - y1) / nullif(y2 - y1, 0) + x1)::INT) % 2 = 1"
    t = "greatest(0, least(1, ((ix + 0.5::DOUBLE - x1) * (x2 - x1) + (iy + 0.5::DOUBLE - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0)))"
    close = f"bool_or(pow(ix + 0.5::DOUBLE - x1 - {t} * (x2 - x1), 2) + pow(iy + 0.5::DOUBLE - y1 - {t} * (y2 - y1), 2) <= {reach * reach})"
    low, high = "greatest(least(y1, y2), iy)", "least(greatest(y1, y2), iy + 1)"
    x = lambda y: f"(x1 + (x2 - x1) * ({y} - y1) / nullif(y2 - y1, 0))"
    touch = f"""bool_or(least(y1, y2) < iy + 1 AND greatest(y1, y2) >= iy AND CASE WHEN y1 = y2 THEN floor(least(x1, x2)) <= ix AND floor(greatest(x1, x2)) >= ix
        ELSE floor(least({x(low)}, {x(high)})) <= ix AND floor(greatest({x(low)}, {x(high)})) >= ix END)"""
    rule = f"({inside})" + (f" OR {touch}" if touched else "") + (f" OR {close}" if reach else "")
    return f"hit AS (SELECT ix, iy, seq, any_value(edge.code) AS code, any_value(edge.score) AS score FROM grid JOIN shape ON {near} JOIN edge USING (seq) GROUP BY ix, iy, seq HAVING {rule})"


SQL_LINES = f"""knee AS (SELECT s_suppkey AS seq, [{", ".join(f"{fixed.WATER_BONUS[t]}::DOUBLE" for t in WATER_TYPES)}][s_suppkey % {len(WATER_TYPES)} + 1] AS bonus,
    s_suppkey * 41 % 125 + 0.3::DOUBLE AS x, s_suppkey * 67 % ny + 0.45::DOUBLE AS y, x + (s_suppkey % 9 - 4) * 2.5::DOUBLE AS mx, y + (s_suppkey % 7 - 3) * 3.5::DOUBLE AS my
    FROM supplier, (SELECT max(o_orderkey) // 125 + 1 AS ny FROM orders)),
line AS (SELECT seq, bonus, x AS x1, y AS y1, mx AS x2, my AS y2 FROM knee UNION ALL SELECT seq, bonus, mx, my, mx + 3.1::DOUBLE, my - 2.2::DOUBLE FROM knee)"""


def sql_on_lines(reach: float) -> str:
    """CTE ``wet``: every (cell, edge of a line) whose square is within ``reach`` of it."""
    t = lambda x, y: f"greatest(0, least(1, (({x} - x1) * (x2 - x1) + ({y} - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0)))"
    corner = lambda x, y: f"pow({x} - x1 - coalesce({t(x, y)}, 0) * (x2 - x1), 2) + pow({y} - y1 - coalesce({t(x, y)}, 0) * (y2 - y1), 2) <= {reach * reach}"
    end = lambda x, y: f"pow(greatest(ix - {x}, 0, {x} - ix - 1), 2) + pow(greatest(iy - {y}, 0, {y} - iy - 1), 2) <= {reach * reach}"
    low, high = "greatest(least(y1, y2), iy)", "least(greatest(y1, y2), iy + 1)"
    x = lambda y: f"coalesce(x1 + (x2 - x1) * ({y} - y1) / nullif(y2 - y1, 0), x1)"
    touch = f"""least(y1, y2) < iy + 1 AND greatest(y1, y2) >= iy AND CASE WHEN y1 = y2 THEN floor(least(x1, x2)) <= ix AND floor(greatest(x1, x2)) >= ix
        ELSE floor(least({x(low)}, {x(high)})) <= ix AND floor(greatest({x(low)}, {x(high)})) >= ix END"""
    close = " OR ".join([f"({touch})"] + ([f"({corner(a, b)})" for a in ("ix", "ix + 1") for b in ("iy", "iy + 1")] + [f"({end('x1', 'y1')})", f"({end('x2', 'y2')})"] if reach else []))
    near = f"ix BETWEEN least(x1, x2) - {reach + 2} AND greatest(x1, x2) + {reach + 2} AND iy BETWEEN least(y1, y2) - {reach + 2} AND greatest(y1, y2) + {reach + 2}"
    return f"wet AS (SELECT ix, iy, seq, bonus FROM grid JOIN line ON {near} WHERE {close})"


SQL_POINTS = """points AS (SELECT c_custkey AS seq, (c_custkey * 53 % 125)::DOUBLE AS px, (c_custkey * 29 % ny)::DOUBLE AS py,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS value FROM customer, (SELECT max(o_orderkey) // 125 + 1 AS ny FROM orders))"""
SQL_DAYS = """counts AS (SELECT ts::DATE AS day, count(*) FILTER (event_type = 'view') AS nv, count(*) FILTER (event_type = 'error') AS ne,
    count(*) FILTER (event_type = 'click') AS nc, count(*) FILTER (event_type = 'purchase') AS np FROM events GROUP BY 1),
days AS (SELECT day, (nv * 5 % 29 - 1)::DOUBLE AS t, (nv * 5 % 29 - 7)::DOUBLE AS tmin, greatest(0, ne * 11 % 37 - 14)::DOUBLE AS rain,
    (35 + nc * 13 % 66)::DOUBLE AS rh, (np * 7 % 46)::DOUBLE AS wind FROM counts)"""
SQL_PIXELS = """pixels AS (SELECT l_orderkey AS px, l_linenumber AS py, (l_orderkey % 256)::INT AS r, (l_partkey % 256)::INT AS g,
    (l_suppkey * 3 % 256)::INT AS b, l_partkey % 17 <> 0 AS valid FROM lineitem)"""
