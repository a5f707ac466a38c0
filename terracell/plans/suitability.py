"""Queries of the grid, model, weather, land cover and lookup operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terracell import fixed
from terracell.functions import curves
from terracell.operators import enrich, focal, graph, grid, landcover, masks, model, polygons, resolve, spatial, weather
from terracell.operators.nearby import valid_position
from terracell.plans import fixtures as fx
from terracell.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


def sql_curve(x: str, c: curves.Curve) -> str:
    """The CASE of a curve, for the oracle."""
    start = "<" if c.start_closed else "<="
    out, begin = [f"WHEN {x} {start} {c.start} THEN {c.before}::DOUBLE"], c.start
    for p in c.pieces:
        t = f"(({x} - {begin}::DOUBLE) / {p.to - begin}::DOUBLE)"
        value = f"{p.a}::DOUBLE" if p.a == p.b else f"{p.a}::DOUBLE + ({p.b}::DOUBLE - {p.a}::DOUBLE) * pow({t}, {p.power}::DOUBLE)"
        out.append(f"WHEN {x} {'<=' if p.closed else '<'} {p.to} THEN {value}")
        begin = p.to
    out.append(f"WHEN {x} IS NOT NULL THEN {c.after}::DOUBLE")
    return "CASE " + " ".join(out) + f" ELSE {'NULL' if c.missing is None else str(c.missing) + '::DOUBLE'} END"


def _sql_near(value: str) -> str:
    """The nine values around each cell, the border repeated."""
    row = "PARTITION BY iy ORDER BY ix"
    inner = f"SELECT ix, iy, {value} AS c, coalesce(lag({value}) OVER ({row}), {value}) AS w, coalesce(lead({value}) OVER ({row}), {value}) AS e FROM grid"
    beside = ", ".join(f"coalesce({f}({v}) OVER k, {v}) AS {side}{v if v != 'c' else ''}" for f, side in (("lag", "n"), ("lead", "s")) for v in "wce")
    return f"SELECT ix, iy, c, w, e, {beside} FROM ({inner}) WINDOW k AS (PARTITION BY ix ORDER BY iy)"


def _sql_box(a: str, n: str, r: int) -> str:
    """FROM clause of all pairs of a cell and a cell in the box around it."""
    off = f"SELECT unnest(range({-r}, {r + 1}))"
    return f"{a} a, ({off} AS dx), ({off} AS dy) JOIN {n} n ON n.ix = a.ix + dx AND n.iy = a.iy + dy"


# --- curves on one row -----------------------------------------------------------------------

_MEASURE = {
    # name: (curve, Spark expression over the grid, SQL expression over the grid)
    "score_altitude": (curves.ALTITUDE, lambda: F.col("z"), "z"),
    "score_slope": (curves.SLOPE, lambda: F.col("z") % 61, "z % 61"),
    "score_roughness": (curves.ROUGHNESS, lambda: F.col("z") % 15, "z % 15"),
    "score_twi": (curves.TWI, lambda: F.col("z") % 21, "z % 21"),
    "score_dist_water": (curves.WATER, lambda: F.col("z") % 1100, "z % 1100"),
    "score_urban_proximity": (curves.URBAN, lambda: F.col("z") % 300, "z % 300"),
    "score_contact": (curves.CONTACT, lambda: F.col("z") % 600, "z % 600"),
    "score_edge": (curves.EDGE, lambda: F.col("z") % 60, "z % 60"),
    "score_canopy": (curves.CANOPY, lambda: F.col("z") % 100, "z % 100"),
}


def _curve_query(name: str) -> None:
    curve, measure, sql = _MEASURE[name]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fx.grid(spark, sf).select("ix", "iy", curve.of(measure()).alias("score"))

    QUERIES[name] = run
    ORACLE[name] = f"WITH {fx.SQL_GRID} SELECT ix, iy, {sql_curve(f'({sql})', curve)} AS score FROM grid"


for _name in _MEASURE:
    _curve_query(_name)


@query(
    f"""WITH {fx.SQL_GRID} SELECT ix, iy,
    round(CASE WHEN z % 50 < 5 THEN 0.85::DOUBLE WHEN z IS NOT NULL THEN 0.65::DOUBLE + 0.35::DOUBLE * cos(radians(z % 360 - 170)) END, 6) AS aspect_score,
    CASE WHEN z % 50 >= 45 THEN 0.15::DOUBLE ELSE 0.20::DOUBLE END AS ground_score FROM grid"""
)
def score_aspect_ground(spark: SparkSession, sf: str) -> DataFrame:
    slope = F.col("z") % 50
    return fx.grid(spark, sf).select(
        "ix", "iy", r6(curves.aspect_score(F.col("z") % 360, slope)).alias("aspect_score"), curves.ground_cover_score(slope).alias("ground_score")
    )


# --- weather ---------------------------------------------------------------------------------

_SQL_WEATHER = f"""WITH {fx.SQL_DAYS},
w AS (SELECT *, coalesce(sum(rain) OVER three, 0) AS recent, coalesce(sum((rain > 2)::INT) OVER three, 0) AS wet, avg(t) OVER three AS warm,
    coalesce(lag(rain, 1) OVER o <= 2, false) AS d1, coalesce(lag(rain, 2) OVER o <= 2, false) AS d2, coalesce(lag(rain, 3) OVER o <= 2, false) AS d3
    FROM days WINDOW o AS (ORDER BY day), three AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *,
    CASE WHEN t BETWEEN 10 AND 20 THEN 1.0 WHEN t <= 5 OR t >= 25 THEN 0.0 WHEN t < 10 THEN (t - 5) / 5 ELSE (25 - t) / 5 END AS s_t,
    greatest(0, least(1, (tmin + 3) / 5)) AS s_f,
    CASE WHEN rain <= 1 THEN 1.0 WHEN rain <= 5 THEN 1 - 0.4::DOUBLE * (rain - 1) / 4 ELSE greatest(0, 0.6::DOUBLE - (rain - 5) / 20) END AS s_p,
    CASE WHEN recent BETWEEN 2 AND 15 THEN 1.0 WHEN recent < 2 THEN greatest(0.2::DOUBLE, recent / 2) ELSE greatest(0.3::DOUBLE, 1 - (recent - 15) / 30) END AS s_r,
    CASE WHEN rh BETWEEN 60 AND 90 THEN 1.0 WHEN rh < 60 THEN greatest(0.2::DOUBLE, rh / 60) ELSE greatest(0.5::DOUBLE, 1 - (rh - 90) / 10) END AS s_h,
    greatest(0, least(1, (37.5::DOUBLE - wind) / 22.5::DOUBLE)) AS s_w FROM w),
b AS (SELECT *, 0.25::DOUBLE * s_t + 0.20::DOUBLE * s_f + 0.15::DOUBLE * s_p + 0.20::DOUBLE * s_r + 0.10::DOUBLE * s_h + 0.10::DOUBLE * s_w AS base,
    CASE WHEN NOT d1 THEN 0 WHEN NOT d2 THEN 1 WHEN NOT d3 THEN 2 ELSE 3 END AS run,
    rain <= 2 AND t >= 8 AND recent >= 10 AND wet >= 1 AS burst FROM s),
c AS (SELECT *, CASE WHEN burst THEN round(((CASE WHEN recent >= 20 THEN 0.20::DOUBLE ELSE 0.12::DOUBLE END)
    + (CASE WHEN t - warm >= 3 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END)) * (CASE WHEN run > 0 THEN greatest(0.4::DOUBLE, 1 - 0.25::DOUBLE * run) ELSE 1.0::DOUBLE END), 3) END AS bonus FROM b),
d AS (SELECT *, greatest(0, least(1, base + coalesce(bonus, 0))) AS score FROM c)
"""


@query(_SQL_WEATHER + "SELECT day, round(base, 6) AS base, round(score, 6) AS score FROM d")
def weather_daily_score(spark: SparkSession, sf: str) -> DataFrame:
    return weather.daily(fx.days(spark, sf)).select("day", r6(F.col("base")).alias("base"), r6(F.col("score")).alias("score"))


@query(_SQL_WEATHER + "SELECT day, recent::DOUBLE AS recent FROM d")
def weather_recent_rain(spark: SparkSession, sf: str) -> DataFrame:
    return weather.daily(fx.days(spark, sf)).select("day", "recent")


@query(_SQL_WEATHER + "SELECT day, bonus, CASE WHEN recent >= 20 THEN 'fort' ELSE 'modéré' END AS intensity FROM d WHERE burst")
def weather_burst(spark: SparkSession, sf: str) -> DataFrame:
    return weather.daily(fx.days(spark, sf)).where("bonus is not null").select("day", "bonus", "intensity")


@query(
    _SQL_WEATHER
    + "SELECT CASE WHEN score >= 0.75 THEN 4 WHEN score >= 0.55 THEN 3 WHEN score >= 0.40 THEN 2 WHEN score >= 0.25 THEN 1 ELSE 0 END AS level, count(*) AS days FROM d GROUP BY 1"
)
def weather_levels(spark: SparkSession, sf: str) -> DataFrame:
    return weather.daily(fx.days(spark, sf)).groupBy("level").agg(F.count("*").alias("days"))


# --- model over one row ----------------------------------------------------------------------


def criteria(g: DataFrame) -> dict[str, Column]:
    """Criterion scores over the rough grid, of columns that are there without a neighbourhood."""
    z = F.col("z")
    return {
        "geology": resolve.scored(F.col("geology"), fixed.GEOLOGY_SCORES),
        "tree_species": F.coalesce(F.when(F.col("species").isNotNull(), resolve.scored(resolve.species(F.col("species")), fixed.SPECIES_SCORES)), F.lit(0.5)),
        "altitude": curves.ALTITUDE.of(z),
        "slope": curves.SLOPE.of(z % 61),
        "twi": curves.TWI.of(z % 21),
        "aspect": curves.aspect_score(z % 360, z % 61),
        "terrain_roughness": curves.ROUGHNESS.of(z % 15),
        "dist_water": curves.WATER.of(z % 1100),
        "urban_proximity": curves.URBAN.of(z % 300),
        "canopy_openness": F.lit(0.10),
        "ground_cover": curves.ground_cover_score(z % 61),
        "disturbance": F.lit(0.3),
        "geology_contact": curves.CONTACT.of(z % 600),
    }


_SQL_SPECIES_SCORE = "CASE species WHEN 'Frêne commun' THEN 1.0 WHEN 'Hêtre' THEN 0.30 WHEN 'Sapin pectiné' THEN 0.55 WHEN 'Chêne pubescent' THEN 0.10 ELSE 0.5 END::DOUBLE"
_SQL_GEOLOGY_SCORE = "CASE geology WHEN 'calcaire' THEN 0.95 WHEN 'marne' THEN 0.85 WHEN 'granite' THEN 0.0 ELSE 0.30 END::DOUBLE"
_SQL_CRITERIA = {
    "geology": _SQL_GEOLOGY_SCORE,
    "tree_species": _SQL_SPECIES_SCORE,
    "altitude": sql_curve("z", curves.ALTITUDE),
    "slope": sql_curve("(z % 61)", curves.SLOPE),
    "twi": sql_curve("(z % 21)", curves.TWI),
    "aspect": "CASE WHEN z % 61 < 5 THEN 0.85::DOUBLE WHEN z IS NOT NULL THEN 0.65::DOUBLE + 0.35::DOUBLE * cos(radians(z % 360 - 170)) END",
    "terrain_roughness": sql_curve("(z % 15)", curves.ROUGHNESS),
    "dist_water": sql_curve("(z % 1100)", curves.WATER),
    "urban_proximity": sql_curve("(z % 300)", curves.URBAN),
    "canopy_openness": "0.10::DOUBLE",
    "ground_cover": "CASE WHEN z % 61 >= 45 THEN 0.15::DOUBLE ELSE 0.20::DOUBLE END",
    "disturbance": "0.3::DOUBLE",
    "geology_contact": sql_curve("(z % 600)", curves.CONTACT),
}
_TOTAL_WEIGHT = sum(fixed.WEIGHTS.values())
_SQL_MODEL = (
    f"WITH {fx.SQL_GRID}, crit AS (SELECT *, "
    + ", ".join(f"{sql} AS s_{k}" for k, sql in _SQL_CRITERIA.items())
    + " FROM grid), wsum AS (SELECT *, "
    + " + ".join(f"coalesce(s_{k} * {fixed.WEIGHTS[k]}::DOUBLE, 0)" for k in _SQL_CRITERIA)
    + " AS total, "
    + " + ".join(f"(CASE WHEN s_{k} IS NOT NULL THEN {fixed.WEIGHTS[k]}::DOUBLE ELSE 0 END)" for k in _SQL_CRITERIA)
    + f""" AS have FROM crit),
model AS (SELECT *, have / {_TOTAL_WEIGHT!r}::DOUBLE AS coverage,
    greatest(0, least(1, total / have * (0.5::DOUBLE + 0.5::DOUBLE * have / {_TOTAL_WEIGHT!r}::DOUBLE))) AS raw,
    urban AS x_urban, water AS x_water, z IS NULL AS x_nodata, coalesce(geology = 'granite', false) AS x_geology, coalesce(z % 61 > 50, false) AS x_slope,
    coalesce(z < 100 OR z > 1400, false) AS x_altitude, coalesce(z % 21 > 18, false) AS x_waterlogged, coalesce(z % 300 < 15, false) AND NOT urban AS x_near_urban FROM wsum),
scored AS (SELECT *, CASE WHEN x_urban OR x_water OR x_nodata OR x_geology OR x_slope OR x_altitude OR x_waterlogged OR x_near_urban THEN 0 ELSE raw END AS score FROM model)
"""
)


def scored_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The grid with its criteria, weighted score, exclusions and final score, all in projections without a shuffle."""
    g = fx.grid(spark, sf)
    g = g.withColumns({f"s_{k}": c for k, c in criteria(g).items()})
    raw, coverage = model.weighted({k: F.col(f"s_{k}") for k in _SQL_CRITERIA})
    z = F.col("z")
    g = g.withColumns({"raw": raw, "coverage": coverage, "altitude": z, "slope": z % 61, "twi": z % 21, "dist_urban": z % 300, "nodata": z.isNull()})
    g = g.withColumns({f"x_{k}": c for k, c in model.exclusions(g).items()})
    out = F.lit(False)
    for k in ("urban", "water", "nodata", "geology", "slope", "altitude", "waterlogged", "near_urban"):
        out = out | F.col(f"x_{k}")
    return g.withColumn("score", F.when(out, 0.0).otherwise(F.col("raw")))


@query(_SQL_MODEL + "SELECT ix, iy, round(coverage, 6) AS coverage, round(raw, 6) AS raw, round(score, 6) AS score FROM scored")
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    return scored_cells(spark, sf).select("ix", "iy", *[r6(F.col(c)).alias(c) for c in ("coverage", "raw", "score")])


@query(
    _SQL_MODEL
    + "SELECT "
    + ", ".join(f"sum(x_{k}::INT)::BIGINT AS {k}" for k in ("urban", "water", "nodata", "geology", "slope", "altitude", "waterlogged", "near_urban"))
    + ", count(*) AS cells FROM scored"
)
def elimination_counts(spark: SparkSession, sf: str) -> DataFrame:
    names = ("urban", "water", "nodata", "geology", "slope", "altitude", "waterlogged", "near_urban")
    return scored_cells(spark, sf).agg(*[F.count_if(F.col(f"x_{k}")).alias(k) for k in names], F.count("*").alias("cells"))


_SQL_CLASS = "(score >= 0.15)::INT + (score >= 0.30)::INT + (score >= 0.45)::INT + (score >= 0.60)::INT + (score >= 0.75)::INT"


@query(
    _SQL_MODEL
    + f"SELECT {_SQL_CLASS} AS class, ['Nul', 'Très faible', 'Faible', 'Moyen', 'Bon', 'Excellent'][{_SQL_CLASS} + 1] AS label, count(*) AS n FROM scored GROUP BY 1, 2"
)
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return model.distribution(scored_cells(spark, sf), "score")


@query(
    _SQL_MODEL
    + """SELECT count(*) AS n_cells, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max, round(avg(score), 6) AS score_mean,
    round(median(score), 6) AS score_median, round(stddev_pop(score), 6) AS score_std, count(*) FILTER (score >= 0.7) AS n_high,
    count(*) FILTER (score >= 0.4 AND score < 0.7) AS n_medium, count(*) FILTER (score < 0.4) AS n_low,
    round(100.0::DOUBLE * count(*) FILTER (score >= 0.7) / count(*), 6) AS pct_high,
    round(100.0::DOUBLE * count(*) FILTER (score >= 0.4 AND score < 0.7) / count(*), 6) AS pct_medium FROM scored"""
)
def run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return model.run_stats(scored_cells(spark, sf), "score")


@query(_SQL_MODEL + "SELECT round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.99), 6) AS p99 FROM scored")
def score_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return scored_cells(spark, sf).agg(*[r6(F.percentile("score", p / 100)).alias(f"p{p}") for p in (90, 95, 99)])


@query(
    _SQL_MODEL
    + " UNION ALL ".join(
        f"""SELECT '{k}' AS criterion, round(min(s_{k}), 6) AS min, round(max(s_{k}), 6) AS max, round(avg(s_{k}), 6) AS mean, round(median(s_{k}), 6) AS median,
    round(stddev_pop(s_{k}), 6) AS std, round(100.0::DOUBLE * count(*) FILTER (s_{k} = 0) / count(*), 6) AS pct_zero,
    round(100.0::DOUBLE * count(*) FILTER (s_{k} >= 0.7) / count(*), 6) AS pct_high FROM scored"""
        for k in ("geology", "tree_species", "altitude", "slope", "twi")
    )
)
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    named = scored_cells(spark, sf).select(*[F.col(f"s_{k}").alias(k) for k in ("geology", "tree_species", "altitude", "slope", "twi")])
    return model.summary(named, ["geology", "tree_species", "altitude", "slope", "twi"])


@query(
    _SQL_MODEL
    + "SELECT round(sum(w * c) / sum(w), 6) AS confidence FROM (VALUES "
    + ", ".join(f"({w}::DOUBLE, (SELECT avg((s_{k} IS NOT NULL)::INT) FROM scored))" for k, w in fixed.WEIGHTS.items() if k in _SQL_CRITERIA)
    + ") t(w, c)"
)
def global_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """The weighted mean of the share of cells that each criterion covers."""
    used = {k: w for k, w in fixed.WEIGHTS.items() if k in _SQL_CRITERIA}
    parts = sum((F.avg(F.col(f"s_{k}").isNotNull().cast("int")) * w for k, w in used.items()), F.lit(0.0))
    return scored_cells(spark, sf).agg(r6(parts / sum(used.values())).alias("confidence"))


@query(_SQL_MODEL + "SELECT ix, iy, round(z, 6) AS altitude, round(score, 6) AS score FROM scored WHERE ix = 7 AND iy = 5")
def cell_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return scored_cells(spark, sf).where("ix = 7 and iy = 5").select("ix", "iy", r6(F.col("altitude")).alias("altitude"), r6(F.col("score")).alias("score"))


@query(
    _SQL_MODEL
    + """SELECT ix, iy, round(CASE WHEN geology = 'calcaire' AND z < 700 AND z % 61 > 10 THEN score * coalesce(greatest(0.5::DOUBLE, 1 - 0.5::DOUBLE * (0.4::DOUBLE * greatest(0, least(1, (z % 15) / 10))
    + 0.6::DOUBLE * greatest(0, least(1, (8 - z % 21) / 6)))), 1) ELSE score END, 6) AS score FROM scored"""
)
def calcdry_penalty(spark: SparkSession, sf: str) -> DataFrame:
    z = F.col("z")
    applies = (enrich.substrate_of(F.col("geology"), z % 61) == 1) & (z < 700) & (z % 61 > 10)
    return scored_cells(spark, sf).select("ix", "iy", r6(model.dry_limestone(F.col("score"), applies, z % 15, z % 21)).alias("score"))


# --- names -----------------------------------------------------------------------------------


def _values(rules) -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, a.replace("'", "''"), b) for i, (a, b) in enumerate(rules))
    return f"(VALUES {rows}) t(seq, k, v)"


def _first_in(text: str, rules) -> str:
    return "(SELECT min_by(v, seq) FROM " + _values(rules) + f" WHERE contains({text}, k))"


_SQL_KEY = "translate(replace(lower(trim(v0)), '''', ''), ' -éèêâîôùû', '__eeeaiouu')"


def _sql_species(v0: str) -> str:
    names = [(n, n) for n in fixed.SPECIES_SCORES if n != "unknown"]
    key = _SQL_KEY.replace("v0", v0)
    alias = list(fixed.SPECIES_ALIASES.items())
    exact = f"(SELECT min_by(v, seq) FROM {_values([(n, n) for n in fixed.SPECIES_SCORES])} WHERE k = {key})"
    exact2 = f"(SELECT min_by(v, seq) FROM {_values(alias)} WHERE k = {key})"
    return f"coalesce({exact}, {exact2}, {_first_in(key, names)}, {_first_in(key, alias)}, 'unknown')"


def _sql_geology(v0: str) -> str:
    codes = f"(SELECT min_by(v, seq) FROM {_values(fixed.GEOLOGY_CODES.items())} WHERE k = trim({v0}))"
    names = f"(SELECT min_by(v, seq) FROM {_values([(n, n) for n in fixed.GEOLOGY_SCORES])} WHERE k = translate(lower(trim({v0})), ' -', '__'))"
    return f"coalesce({codes}, {names}, {_first_in(f'lower(trim({v0}))', fixed.GEOLOGY_KEYWORDS)}, 'unknown')"


@query(f"WITH d AS (SELECT DISTINCT essence AS e FROM forest), r AS (SELECT e, {_sql_species('e')} AS name FROM d) SELECT forest_id, name AS species FROM forest LEFT JOIN r ON forest.essence IS NOT DISTINCT FROM r.e")
def resolve_species(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "forest").select("forest_id", resolve.species(F.col("essence")).alias("species"))


@query(f"WITH d AS (SELECT DISTINCT descr AS e FROM geology), r AS (SELECT e, {_sql_geology('e')} AS name FROM d) SELECT geology_id, name AS category FROM geology LEFT JOIN r ON geology.descr IS NOT DISTINCT FROM r.e")
def resolve_geology(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "geology").select("geology_id", resolve.geology(F.col("descr")).alias("category"))


@query(
    f"""WITH d AS (SELECT DISTINCT descr AS e0, notation AS n FROM geology), t AS (SELECT *, CASE WHEN length(trim(e0)) > 0 THEN lower(trim(e0)) END AS e FROM d),
r AS (SELECT e0, n, coalesce(nullif({_sql_geology('e')}, 'unknown'), {_first_in('e', fixed.GEOLOGY_OVERRIDES)},
    nullif(CASE WHEN length(trim(n)) > 0 THEN coalesce((SELECT min_by(v, seq) FROM {_values(fixed.GEOLOGY_CODES.items())} WHERE k = lower(trim(n)) AND NOT EXISTS (SELECT 1 FROM {_values(fixed.GEOLOGY_CODES.items()).replace('t(seq, k, v)', 'u(seq2, k2, v2)')} WHERE k2 = trim(n))), {_sql_geology('n')}) END, 'unknown'), 'unknown') AS name FROM t)
SELECT geology_id, name AS category FROM geology LEFT JOIN r ON geology.descr IS NOT DISTINCT FROM r.e0 AND geology.notation IS NOT DISTINCT FROM r.n"""
)
def geology_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.geology_cascade(table(spark, sf, "geology"), "descr", "notation", "category").select("geology_id", "category")


@query(
    f"""WITH c AS (SELECT forest_id, code_tfv, upper(trim(code_tfv)) AS code FROM forest),
p AS (SELECT *, string_split(replace(code, 'G', '-'), '-') AS parts FROM c),
q AS (SELECT *, list_filter(list_transform(CASE WHEN code LIKE 'LA%' THEN parts ELSE parts[2:] END, lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) >= 2) AS digits FROM p),
m AS (SELECT map_from_entries(list((k, v))) AS names FROM {_values(fixed.VEGETATION_SPECIES.items())})
SELECT forest_id,
    CASE WHEN code_tfv IS NULL OR length(code_tfv) < 2 OR code LIKE 'FH%' THEN 'unknown' WHEN code LIKE 'FP%' THEN 'peuplier'
         ELSE coalesce(list_filter(list_transform(digits, lambda x: names[x[1:2]]), lambda x: x IS NOT NULL)[1], 'unknown') END AS species,
    CASE WHEN code_tfv IS NULL OR length(code_tfv) < 2 OR code LIKE 'FH%' THEN 0 WHEN code LIKE 'FP%' THEN 1 WHEN code LIKE 'LA%' THEN 4
         WHEN regexp_matches(code, '^F[FO][01]') THEN 1 WHEN regexp_matches(code, '^F[FO]2') THEN 2 WHEN regexp_matches(code, '^F[FO]3') THEN 3 ELSE 0 END AS forest_type
FROM q, m"""
)
def tfv_parse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "forest").select("forest_id", resolve.vegetation_code(F.col("code_tfv")).alias("p")).select("forest_id", "p.species", "p.forest_type")


@query(f"WITH d AS (SELECT DISTINCT tfv AS e FROM forest), r AS (SELECT e, coalesce(CASE WHEN length(e) >= 3 THEN {_first_in('lower(e)', fixed.TEXT_PATTERNS)} END, 'unknown') AS name FROM d) SELECT forest_id, name AS species FROM forest LEFT JOIN r ON forest.tfv IS NOT DISTINCT FROM r.e")
def first_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "forest").select("forest_id", resolve.species_in_text(F.col("tfv")).alias("species"))


_WATER_TEXT = ("River", "big stream", "lake ", "an oxbow pond", "gorge")


@query(
    f"""WITH w AS (SELECT p_partkey, lower(trim(['River', 'big stream', 'lake ', 'an oxbow pond', 'gorge'][p_size % 5 + 1])) AS name FROM part)
SELECT p_partkey, coalesce((SELECT min_by(v, seq) FROM {_values(fixed.WATER_TYPES.items())} WHERE k = name), {_first_in('name', fixed.WATER_TYPES.items())}, 'unknown') AS kind FROM w"""
)
def water_type(spark: SparkSession, sf: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, _WATER_TEXT)), F.col("p_size") % 5)
    return table(spark, sf, "part").select("p_partkey", resolve.water_type(text).alias("kind"))


@query(f"WITH {fx.SQL_GRID} SELECT geology, {_SQL_GEOLOGY_SCORE} AS score, count(*) AS cells FROM grid GROUP BY 1, 2")
def code_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return fx.grid(spark, sf).groupBy("geology").agg(F.count("*").alias("cells")).withColumn("score", resolve.scored(F.col("geology"), fixed.GEOLOGY_SCORES))


# --- boxes, points, resampling ---------------------------------------------------------------

_SQL_IN = "ix BETWEEN xmin AND xmax AND iy BETWEEN ymin AND ymax"


@query(f"WITH {fx.SQL_GRID}, {fx.SQL_BOXES} SELECT ix, iy, EXISTS (SELECT 1 FROM boxes WHERE {_SQL_IN}) AS inside FROM grid")
def rasterize_mask(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.burn_mask(fx.grid(spark, sf), fx.boxes(spark, sf))


@query(f"WITH {fx.SQL_GRID}, {fx.SQL_BOXES}, h AS (SELECT ix, iy, max_by(code, (score, seq)) AS code FROM grid JOIN boxes ON {_SQL_IN} GROUP BY ALL) SELECT ix, iy, coalesce(code, 0) AS code FROM grid LEFT JOIN h USING (ix, iy)")
def rasterize_best(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.burn_code(fx.grid(spark, sf), fx.boxes(spark, sf), "code", ["score", "seq"])


@query(f"WITH {fx.SQL_GRID}, {fx.SQL_BOXES}, h AS (SELECT ix, iy, max_by(code, seq) AS code FROM grid JOIN boxes ON {_SQL_IN} GROUP BY ALL) SELECT ix, iy, coalesce(code, 0) AS code FROM grid LEFT JOIN h USING (ix, iy)")
def rasterize_last(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.burn_code(fx.grid(spark, sf), fx.boxes(spark, sf), "code", ["seq"])


@query(f"WITH {fx.SQL_GRID}, {fx.SQL_BOXES}, h AS (SELECT ix, iy, max(score) AS score FROM grid JOIN boxes ON {_SQL_IN} GROUP BY ALL) SELECT ix, iy, coalesce(h.score, 0)::DOUBLE AS score FROM grid LEFT JOIN h USING (ix, iy)")
def rasterize_max(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.burn_max(fx.grid(spark, sf), fx.boxes(spark, sf), "score")


@query(f"WITH {fx.SQL_GRID}, {fx.SQL_BOXES} SELECT ix, iy, min_by(score, seq)::DOUBLE AS score FROM grid JOIN boxes ON {_SQL_IN} GROUP BY ALL")
def observation_override(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.first_of_boxes(fx.grid(spark, sf), fx.boxes(spark, sf), "score", "seq")


# --- polygons and lines ----------------------------------------------------------------------

_SQL_TOUCHED = f"WITH {fx.SQL_GRID}, {fx.SQL_SHAPES}, {fx.sql_in_shapes(True)}"


@query(_SQL_TOUCHED + " SELECT ix, iy, EXISTS (SELECT 1 FROM hit WHERE hit.ix = grid.ix AND hit.iy = grid.iy) AS inside FROM grid")
def polygon_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that any polygon touches."""
    return polygons.burn_mask(fx.grid(spark, sf), fx.shapes(spark, sf))


@query(f"WITH {fx.SQL_GRID}, {fx.SQL_SHAPES}, {fx.sql_in_shapes(False)} SELECT ix, iy, EXISTS (SELECT 1 FROM hit WHERE hit.ix = grid.ix AND hit.iy = grid.iy) AS inside FROM grid")
def polygon_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Cells whose centre lies in a polygon, outside its hole."""
    return polygons.burn_mask(fx.grid(spark, sf), fx.shapes(spark, sf), touched=False)


@query(f"WITH {fx.SQL_GRID}, {fx.SQL_SHAPES}, {fx.sql_in_shapes(False, 1.6)} SELECT ix, iy, EXISTS (SELECT 1 FROM hit WHERE hit.ix = grid.ix AND hit.iy = grid.iy) AS inside FROM grid")
def polygon_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """Cells whose centre lies within 16 m of a polygon."""
    return polygons.burn_mask(fx.grid(spark, sf), fx.shapes(spark, sf), touched=False, reach=16.0 / fx.CELL)


@query(_SQL_TOUCHED + ", b AS (SELECT ix, iy, max_by(code, (score, seq)) AS code FROM hit GROUP BY ALL) SELECT ix, iy, coalesce(code, 0) AS code FROM grid LEFT JOIN b USING (ix, iy)")
def polygon_best(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.burn_code(fx.grid(spark, sf), fx.shapes(spark, sf), "code", ["score", "seq"])


@query(_SQL_TOUCHED + ", b AS (SELECT ix, iy, max_by(code, seq) AS code FROM hit GROUP BY ALL) SELECT ix, iy, coalesce(code, 0) AS code FROM grid LEFT JOIN b USING (ix, iy)")
def polygon_last(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.burn_code(fx.grid(spark, sf), fx.shapes(spark, sf), "code", ["seq"])


@query(_SQL_TOUCHED + ", b AS (SELECT ix, iy, max(score) AS score FROM hit GROUP BY ALL) SELECT ix, iy, coalesce(b.score, 0)::DOUBLE AS score FROM grid LEFT JOIN b USING (ix, iy)")
def polygon_max(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.burn_max(fx.grid(spark, sf), fx.shapes(spark, sf), "score")


@query(
    f"""WITH {fx.SQL_GRID}, {fx.SQL_POINTS}, cur AS (SELECT ix, iy, ((ix + iy) % 10) / 10 AS current FROM grid)
SELECT ix, iy, min_by(value, seq) AS value FROM cur JOIN points ON pow(ix - px, 2) + pow(iy - py, 2) <= 100 AND current < value GROUP BY ALL"""
)
def point_boost(spark: SparkSession, sf: str) -> DataFrame:
    cells = fx.grid(spark, sf).withColumn("current", ((F.col("ix") + F.col("iy")) % 10) / 10)
    return spatial.first_point_near(cells, fx.points(spark, sf), 10.0, "value", "seq", "current")


@query(
    """SELECT l_partkey, l_suppkey, first.l_orderkey AS l_orderkey, first.l_linenumber AS l_linenumber FROM (
    SELECT l_partkey, l_suppkey, min_by(struct_pack(l_orderkey, l_linenumber), struct_pack(l_orderkey, l_linenumber)) AS first FROM lineitem GROUP BY ALL)"""
)
def dedup_elements(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return spatial.drop_repeats(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query(
    f"""WITH {fx.SQL_GRID}, n AS (SELECT max(iy) + 1 AS ny FROM grid),
p AS (SELECT checkpoint_id, expected, coalesce(tolerance, 0.25::DOUBLE) AS tol, greatest(0, least(124, floor((lon - 4) / 0.0256::DOUBLE)))::INT AS ix,
    greatest(0, least(ny - 1, floor((46.6::DOUBLE - lat) / (2.64::DOUBLE / ny))))::INT AS iy FROM terrain_checkpoints, n
    WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)),
s AS (SELECT p.*, coalesce({sql_curve('z', curves.ALTITUDE)}, 0) AS predicted FROM p JOIN grid USING (ix, iy))
SELECT count(*) AS checkpoints, sum((abs(predicted - expected) < tol)::INT)::BIGINT AS agree, round(avg((abs(predicted - expected) < tol)::INT), 6) AS rate FROM s WHERE expected IS NOT NULL"""
)
def checkpoint_concordance(spark: SparkSession, sf: str) -> DataFrame:
    """How often the score of the nearest cell lies within the tolerance of what is expected.

    The rows of the grid, however many, lie over 2.64 degrees of latitude. Every checkpoint
    with a valid position takes part; one outside the grid meets the nearest border cell.
    """
    some = fx.grid(spark, sf)
    ny = fx.rows(some)
    at = table(spark, sf, "terrain_checkpoints").where(valid_position(F.col("lat"), F.col("lon")) & F.col("expected").isNotNull())
    clamp = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v))).cast("int")
    at = at.select("expected", F.coalesce("tolerance", F.lit(0.25)).alias("tol"), clamp((F.col("lon") - 4) / 0.0256, 125).alias("ix"), clamp((46.6 - F.col("lat")) / (2.64 / max(ny, 1)), ny).alias("iy"))
    cells = some.select("ix", "iy", F.coalesce(curves.ALTITUDE.of(F.col("z")), F.lit(0.0)).alias("predicted"))
    ok = F.abs(F.col("predicted") - F.col("expected")) < F.col("tol")
    return at.join(cells, ["ix", "iy"]).agg(F.count("*").alias("checkpoints"), F.count_if(ok).alias("agree"), r6(F.avg(ok.cast("int"))).alias("rate"))


@query(
    f"""WITH {fx.SQL_GRID}, n AS (SELECT max(iy) + 1 AS ny, ny * 5 // 2 AS ty FROM grid),
t AS (SELECT (range % 200)::INT AS ix, (range // 200)::INT AS iy FROM range((SELECT 200 * ty FROM n))),
u AS (SELECT t.*, ny, ix * (124 / 199) AS u, iy * ((ny - 1) / (ty - 1)) AS v FROM t, n),
c AS (SELECT ix, iy, least(floor(u) + dx, 124)::INT AS jx, least(floor(v) + dy, ny - 1)::INT AS jy,
    (CASE WHEN dx = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN dy = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w
    FROM u, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)),
j AS (SELECT c.*, grid.z FROM c LEFT JOIN grid ON grid.ix = jx AND grid.iy = jy WHERE w > 0)
SELECT ix, iy, round(CASE WHEN max_by(z IS NULL, (w, -jy, -jx)) THEN NULL ELSE sum(w * coalesce(z, 0)) END, 6) AS z FROM j GROUP BY ix, iy"""
)
def resample_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    cells = fx.grid(spark, sf)
    ny = fx.rows(cells)
    out = grid.resample(cells, "z", (fx.NX, ny), (200, ny * 5 // 2))
    return out.select("ix", "iy", r6(F.col("z")).alias("z"))


@query(
    f"""WITH {fx.SQL_GRID}, n AS (SELECT max(iy) + 1 AS ny, (ny + 1) // 2 AS ty FROM grid),
t AS (SELECT (range % 60)::INT AS ix, (range // 60)::INT AS iy, ny, ty FROM n, range((SELECT 60 * ty FROM n)))
SELECT t.ix, t.iy, z FROM t LEFT JOIN grid ON grid.ix = floor(t.ix * (124 / 59) + 0.5::DOUBLE) AND grid.iy = floor(t.iy * ((ny - 1) / (ty - 1)) + 0.5::DOUBLE)"""
)
def resample_nearest(spark: SparkSession, sf: str) -> DataFrame:
    cells = fx.grid(spark, sf)
    ny = fx.rows(cells)
    return grid.resample(cells, "z", (fx.NX, ny), (60, (ny + 1) // 2), nearest=True)


@query(
    f"""WITH p AS (SELECT checkpoint_id, radians(lat) AS phi, radians(lon) AS lam FROM terrain_checkpoints),
v AS (SELECT checkpoint_id, CASE WHEN ok THEN phi END AS phi, CASE WHEN ok THEN lam END AS lam FROM (SELECT *, phi > -pi() / 2 AND phi <= pi() / 2 AND abs(lam) <= pi() AS ok FROM p)),
t AS (SELECT *, tan(pi() / 4 - phi / 2) / pow((1 - {grid._E!r}::DOUBLE * sin(phi)) / (1 + {grid._E!r}::DOUBLE * sin(phi)), {grid._E / 2!r}::DOUBLE) AS t FROM v)
SELECT checkpoint_id, round(700000 + {grid._A * grid._G!r}::DOUBLE * pow(t, {grid._N!r}::DOUBLE) * sin({grid._N!r}::DOUBLE * (lam - {grid._LAM0!r}::DOUBLE)), 3) AS x,
    round(6600000 + {grid._RHO0!r}::DOUBLE - {grid._A * grid._G!r}::DOUBLE * pow(t, {grid._N!r}::DOUBLE) * cos({grid._N!r}::DOUBLE * (lam - {grid._LAM0!r}::DOUBLE)), 3) AS y FROM t"""
)
def project_points(spark: SparkSession, sf: str) -> DataFrame:
    """Every checkpoint in metres; null where it has no position on the globe that the projection can show."""
    x, y = grid.to_metric(F.col("lat"), F.col("lon"))
    return table(spark, sf, "terrain_checkpoints").select("checkpoint_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


# --- neighbourhoods --------------------------------------------------------------------------


@query(
    f"""WITH {fx.SQL_GRID}, b AS (SELECT a.ix, a.iy, avg(n.z) AS m, stddev_pop(n.z) AS s FROM {_sql_box('grid', 'grid', 2)} GROUP BY ALL)
SELECT ix, iy, round(m, 7) AS mean, round(s, 3) AS std FROM b"""
)
def box_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    some = focal.box_std(focal.box_mean(fx.grid(spark, sf), "z", 5, "mean"), "z", 5, "std")
    return some.select("ix", "iy", F.round("mean", 7).alias("mean"), F.round("std", 3).alias("std"))


_SQL_HORN = f"""WITH {fx.SQL_GRID}, near AS ({_sql_near('zs')}),
g AS (SELECT *, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / 80 AS gx, ((nw + 2 * n + ne) - (sw + 2 * s + se)) / 80 AS gy FROM near),
horn AS (SELECT ix, iy, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope,
    CASE WHEN sqrt(gx * gx + gy * gy) < 1e-8 THEN -1 ELSE CASE WHEN degrees(atan2(gx, gy)) < 0 THEN degrees(atan2(gx, gy)) + 360 ELSE degrees(atan2(gx, gy)) END END AS aspect FROM g)
"""


@query(_SQL_HORN + "SELECT ix, iy, round(slope, 6) AS slope, round(aspect, 6) AS aspect FROM horn")
def horn_slope_aspect(spark: SparkSession, sf: str) -> DataFrame:
    return focal.slope_aspect(fx.grid(spark, sf), "zs", fx.CELL).select("ix", "iy", r6(F.col("slope")).alias("slope"), r6(F.col("aspect")).alias("aspect"))


@query(
    _SQL_HORN
    + f""", b AS (SELECT a.ix, a.iy, stddev_pop(n.slope) AS s FROM {_sql_box('horn', 'horn', 2)} GROUP BY ALL)
SELECT ix, iy, round(s, 4) AS roughness FROM b"""
)
def terrain_roughness(spark: SparkSession, sf: str) -> DataFrame:
    sloped = focal.slope_aspect(fx.grid(spark, sf), "zs", fx.CELL)
    return focal.box_std(sloped, "slope", 5, "roughness").select("ix", "iy", F.round("roughness", 4).alias("roughness"))


@query(
    f"""WITH {fx.SQL_GRID}, m AS (SELECT *, ((ix * 7 + iy * 13) % 5 < 2)::INT AS o FROM grid),
d AS (SELECT a.ix, a.iy, any_value(a.o) AS o, avg(n.o) * 49 AS dens FROM {_sql_box('m', 'm', 3)} GROUP BY a.ix, a.iy)
SELECT ix, iy, o = 1 AND dens >= 20 AS kept FROM d"""
)
def density_filter(spark: SparkSession, sf: str) -> DataFrame:
    masked = fx.grid(spark, sf).withColumn("m", (F.col("ix") * 7 + F.col("iy") * 13) % 5 < 2)
    return focal.density_filter(masked, "m", 7, 20, "kept").select("ix", "iy", "kept")


@query(
    f"""WITH {fx.SQL_GRID}, d AS (SELECT a.ix, a.iy, bool_or(n.water) AS grown FROM {_sql_box('grid', 'grid', 2)} GROUP BY ALL),
x AS (SELECT a.ix, a.iy, bool_or(n.water) AS plus FROM {_sql_box('grid', 'grid', 2)} WHERE abs(dx) + abs(dy) <= 2 GROUP BY a.ix, a.iy)
SELECT ix, iy, grown, plus FROM d JOIN x USING (ix, iy)"""
)
def dilate(spark: SparkSession, sf: str) -> DataFrame:
    """The water mask grown twice over eight and over four neighbours."""
    g = focal.dilate(fx.grid(spark, sf), "water", "grown", 2)
    return focal.dilate(g, "water", "plus", 2, cross=True).select("ix", "iy", "grown", "plus")


@query(
    f"""WITH {fx.SQL_GRID}, m AS (SELECT *, (ix * 7 + iy * 13) % 5 < 2 AS o FROM grid),
d AS (SELECT a.ix, a.iy, bool_or(n.o) AS grown FROM {_sql_box('m', 'm', 1)} GROUP BY ALL),
e AS (SELECT a.ix, a.iy, bool_and(n.grown) AND count(*) = 9 AS closed FROM {_sql_box('d', 'd', 1)} GROUP BY ALL)
SELECT ix, iy, closed FROM e"""
)
def close_mask(spark: SparkSession, sf: str) -> DataFrame:
    masked = fx.grid(spark, sf).withColumn("m", (F.col("ix") * 7 + F.col("iy") * 13) % 5 < 2)
    return focal.close_mask(masked, "m", "closed").select("ix", "iy", "closed")


_SQL_FLOW = f"""{fx.SQL_GRID}, near AS ({_sql_near('zs')}),
drops AS (SELECT ix, iy, unnest([struct_pack(d := (c - n) / 10, k := 0), struct_pack(d := (c - ne) / (10 * sqrt(2)), k := 1), struct_pack(d := (c - e) / 10, k := 2), struct_pack(d := (c - se) / (10 * sqrt(2)), k := 3),
    struct_pack(d := (c - s) / 10, k := 4), struct_pack(d := (c - sw) / (10 * sqrt(2)), k := 5), struct_pack(d := (c - w) / 10, k := 6), struct_pack(d := (c - nw) / (10 * sqrt(2)), k := 7)]) AS x FROM near),
best AS (SELECT ix, iy, max(x.d) AS d, max_by(x.k, (x.d, -x.k)) AS k FROM drops GROUP BY ALL),
flow AS (SELECT ix, iy, CASE WHEN d > 0 THEN k ELSE -1 END AS flow FROM best)
"""


@query(f"WITH {_SQL_FLOW} SELECT ix, iy, flow FROM flow")
def d8_direction(spark: SparkSession, sf: str) -> DataFrame:
    return focal.flow_direction(fx.grid(spark, sf), "zs", fx.CELL).select("ix", "iy", F.col("flow").cast("int").alias("flow"))


_SQL_ACC = f"""WITH RECURSIVE {_SQL_FLOW},
nxt AS (SELECT ix, iy, ix + [0, 1, 1, 1, 0, -1, -1, -1][flow + 1] AS tx, iy + [-1, -1, 0, 1, 1, 1, 0, -1][flow + 1] AS ty FROM flow WHERE flow >= 0),
walk(sx, sy, ix, iy) AS (SELECT ix, iy, ix, iy FROM flow UNION ALL SELECT w.sx, w.sy, n.tx, n.ty FROM walk w JOIN nxt n ON n.ix = w.ix AND n.iy = w.iy),
acc AS (SELECT ix, iy, count(*)::DOUBLE AS acc FROM walk GROUP BY ALL)
"""


@query(_SQL_ACC + "SELECT ix, iy, acc FROM acc")
def flow_accumulation(spark: SparkSession, sf: str) -> DataFrame:
    g = focal.flow_direction(fx.grid(spark, sf), "zs", fx.CELL)
    return graph.flow_accumulation(g, fx.NX).select("ix", "iy", "acc")


def wetness(g: DataFrame) -> DataFrame:
    """``ix, iy, twi``: log of the area per width over the tangent of the slope, with floors for both."""
    acc = graph.flow_accumulation(focal.flow_direction(g, "zs", fx.CELL), fx.NX, fx.CELL * fx.CELL)
    tan = focal.central_slope(g, "zs", fx.CELL, "tan").select("ix", "iy", "tan")
    return acc.join(tan, ["ix", "iy"]).select("ix", "iy", _wetness().alias("twi"))


def _wetness() -> Column:
    ratio = (F.col("acc") / fx.CELL) / F.greatest(F.col("tan"), F.tan(F.radians(F.lit(0.1))))
    return F.log(F.greatest(ratio, F.lit(1e-6)))


@query(
    _SQL_ACC
    + """, slope AS (SELECT ix, iy, sqrt(pow((e - w) / (CASE WHEN ix IN (0, 124) THEN 10 ELSE 20 END), 2)
    + pow((s - n) / (CASE WHEN iy = 0 OR iy = (SELECT max(iy) FROM grid) THEN 10 ELSE 20 END), 2)) AS steep FROM near)
SELECT ix, iy, round(ln(greatest(acc * 10 / greatest(steep, tan(radians(0.1::DOUBLE))), 1e-6)), 6) AS twi FROM acc JOIN slope USING (ix, iy)"""
)
def twi(spark: SparkSession, sf: str) -> DataFrame:
    return wetness(fx.grid(spark, sf)).select("ix", "iy", r6(F.col("twi")).alias("twi"))


_SQL_KERNEL = """k AS (SELECT (range - 8)::INT AS d, exp(-0.5::DOUBLE * pow((range - 8) / 2, 2)) AS g FROM range(17)), kw AS (SELECT d, g / (SELECT sum(g) FROM k) AS w FROM k)"""


@query(
    f"""WITH {fx.SQL_GRID}, {_SQL_KERNEL}, last AS (SELECT max(iy) AS ny FROM grid),
a AS (SELECT c.ix, c.iy, sum(w * coalesce(n.z, 0)) AS v FROM grid c, kw, grid n WHERE n.iy = c.iy AND n.ix = greatest(0, least(124, c.ix + d)) GROUP BY ALL),
b AS (SELECT c.ix, c.iy, sum(w * n.v) AS v FROM a c, kw, a n, last WHERE n.ix = c.ix AND n.iy = greatest(0, least(ny, c.iy + d)) GROUP BY ALL)
SELECT ix, iy, round(v, 5) AS smooth FROM b"""
)
def gaussian_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return focal.gaussian(fx.grid(spark, sf), "z", 2.0, "smooth").select("ix", "iy", F.round("smooth", 5).alias("smooth"))


@query(
    f"""WITH {fx.SQL_GRID}, {_SQL_KERNEL}, last AS (SELECT max(iy) AS ny FROM grid),
a AS (SELECT c.ix, c.iy, sum(w * coalesce(n.z, 0)) AS v, sum(w * (n.z IS NOT NULL)::INT) AS h FROM grid c, kw, grid n WHERE n.iy = c.iy AND n.ix = greatest(0, least(124, c.ix + d)) GROUP BY ALL),
b AS (SELECT c.ix, c.iy, sum(w * n.v) AS v, sum(w * n.h) AS h FROM a c, kw, a n, last WHERE n.ix = c.ix AND n.iy = greatest(0, least(ny, c.iy + d)) GROUP BY ALL)
SELECT ix, iy, round(CASE WHEN h > 1e-10 THEN v / h ELSE 0 END, 5) AS smooth FROM b"""
)
def normalized_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return focal.normalized_gaussian(fx.grid(spark, sf), "z", 2.0, "smooth").select("ix", "iy", F.round("smooth", 5).alias("smooth"))


@query(
    f"""WITH {fx.SQL_GRID}, near AS ({_sql_near('zs')}), l AS (SELECT ix, iy, unnest([c, n, ne, e, se, s, sw, w, nw]) AS v FROM near)
SELECT ix, iy, round(median(v), 6) AS median FROM l GROUP BY ix, iy"""
)
def median3(spark: SparkSession, sf: str) -> DataFrame:
    return focal.median3(fx.grid(spark, sf), "zs", "median").select("ix", "iy", r6(F.col("median")).alias("median"))


@query(
    f"""WITH {fx.SQL_GRID}, t AS (SELECT ix, iy FROM grid WHERE water),
d AS (SELECT n.ix, n.iy, min(dx * dx + dy * dy) AS d2 FROM {_sql_box('t', 'grid', 12)} GROUP BY n.ix, n.iy)
SELECT g.ix, g.iy, round(CASE WHEN d2 <= 144 THEN sqrt(d2) END, 6) AS dist FROM grid g LEFT JOIN d USING (ix, iy)"""
)
def edt_bounded(spark: SparkSession, sf: str) -> DataFrame:
    return focal.distance_within(fx.grid(spark, sf), "water", 12, "dist").select("ix", "iy", r6(F.col("dist")).alias("dist"))


@query(
    f"""WITH {fx.SQL_GRID}, t AS (SELECT ix, iy FROM grid WHERE urban),
d AS (SELECT n.ix, n.iy, min(sqrt(dx * dx + dy * dy)) AS d FROM {_sql_box('t', 'grid', 5)} GROUP BY n.ix, n.iy)
SELECT g.ix, g.iy, round(0.8::DOUBLE * least(1, coalesce(CASE WHEN d <= 5 THEN d END, 5) / 5), 6) AS score FROM grid g LEFT JOIN d USING (ix, iy)"""
)
def soft_fade(spark: SparkSession, sf: str) -> DataFrame:
    d = focal.distance_within(fx.grid(spark, sf), "urban", 5, "d")
    return d.select("ix", "iy", r6(model.fade(F.lit(0.8), F.col("d"), 50.0, fx.CELL)).alias("score"))


@query(
    f"""WITH {fx.SQL_GRID}, h AS (SELECT a.ix, a.iy, min_by(n.z, (dx * dx + dy * dy, dy, dx)) AS z FROM {_sql_box('grid', 'grid', 3)} WHERE n.z IS NOT NULL AND dx * dx + dy * dy <= 9 GROUP BY a.ix, a.iy)
SELECT ix, iy, round(h.z, 6) AS filled FROM grid LEFT JOIN h USING (ix, iy)"""
)
def nearest_fill(spark: SparkSession, sf: str) -> DataFrame:
    return focal.nearest_fill(fx.grid(spark, sf), "z", 3, "filled").select("ix", "iy", r6(F.col("filled")).alias("filled"))


# --- regions ---------------------------------------------------------------------------------

_SQL_HOT = f"{fx.SQL_GRID}, hot AS (SELECT *, iy * 125 + ix AS id FROM grid WHERE z > 1350)"
_SQL_REGION = """near8 AS (SELECT a.id AS a, b.id AS b FROM hot a, (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy) JOIN hot b ON b.ix = a.ix + dx AND b.iy = a.iy + dy),
reach(id, lab) AS (SELECT id, id FROM hot UNION SELECT p.b, r.lab FROM reach r JOIN near8 p ON p.a = r.id),
lab AS (SELECT id, min(lab) AS first FROM reach GROUP BY id), region AS (SELECT hot.*, dense_rank() OVER (ORDER BY first) AS region FROM hot JOIN lab USING (id))"""


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    hot = fx.grid(spark, sf).where("z > 1350")
    named = graph.components(hot, fx.NX)
    return hot.join(named, ["ix", "iy"])


@query(f"WITH RECURSIVE {_SQL_HOT}, {_SQL_REGION} SELECT ix, iy, region FROM region")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return _regions(spark, sf).select("ix", "iy", "region")


_SQL_CLUSTER = f"""WITH RECURSIVE {_SQL_HOT}, {_SQL_REGION},
side AS (SELECT r.id, count(*) AS n FROM region r, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dx, dy) JOIN region n ON n.ix = r.ix + dx AND n.iy = r.iy + dy AND n.region = r.region GROUP BY r.id),
e AS (SELECT r.*, coalesce(side.n, 0) < 4 AS edge FROM region r LEFT JOIN side USING (id)),
stats AS (SELECT region, count(*) AS n_cells, count(*) * 100.0::DOUBLE AS size_m2, avg(z / 2000) AS mean_score, max(z / 2000) AS max_score, (avg(ix) + 0.5::DOUBLE) * 10 AS x, -(avg(iy) + 0.5::DOUBLE) * 10 AS y,
    avg(z) AS altitude, 4 * pi() * count(*) * 100 / pow(sum(edge::INT) * 10, 2) AS compactness FROM e GROUP BY region HAVING count(*) >= 4),
names AS (SELECT region, species, count(*) AS n FROM region WHERE species IS NOT NULL GROUP BY ALL),
dom AS (SELECT region, min_by(species, (-n, species)) AS dominant_species FROM names GROUP BY region)
"""


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    cells = _regions(spark, sf).select("ix", "iy", "region", "species", "geology", (F.col("z") / 2000).alias("score"), F.col("z").alias("altitude"), F.lit(0.0).alias("slope"))
    return graph.region_stats(cells, fx.CELL, 4)


@query(_SQL_CLUSTER + "SELECT region, n_cells, size_m2, mean_score, max_score, x, y, altitude, compactness FROM stats")
def cluster_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf).select("region", "n_cells", "size_m2", "mean_score", "max_score", "x", "y", "altitude", "compactness")


@query(_SQL_CLUSTER + "SELECT stats.region, dominant_species FROM stats LEFT JOIN dom USING (region)")
def dominant_category(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf).select("region", "dominant_species")


@query(_SQL_CLUSTER + "SELECT row_number() OVER (ORDER BY round(mean_score, 4) DESC, region) AS rank, region, n_cells, round(mean_score, 4) AS mean_score FROM stats QUALIFY rank <= 30")
def hotspots(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty regions of highest mean score, ranked: the top of the report."""
    top = _clusters(spark, sf).select("region", "n_cells", F.round("mean_score", 4).alias("mean_score")).orderBy(F.desc("mean_score"), "region").limit(30)
    order = F.row_number().over(Window.orderBy(F.desc("mean_score"), "region"))
    return top.withColumn("rank", order)


# --- enrichment ------------------------------------------------------------------------------


def _zone(g: DataFrame) -> DataFrame:
    z, x = F.col("z"), F.col("ix") * 100.0 - 6200
    return g.withColumns(
        {
            "region": enrich.region_of(x, F.col("iy") % 120 * 100.0 - 6000, z),
            "forest_type": F.col("ix") % 4,
            "band": enrich.band_of(z),
            "substrate": enrich.substrate_of(F.col("geology"), z % 61),
        }
    )


_SQL_SHARES = ", ".join(f"('{r}', '{s}', {p}::DOUBLE)" for r, some in fixed.REGIONS.items() for s, p in some.items())
_SQL_AFF = ", ".join(f"('{s}', {b}, {v}::DOUBLE)" for s, some in fixed.AFFINITY.items() for b, v in enumerate(some))
_SQL_MOD = ", ".join(f"({k}, '{s}', {m}::DOUBLE)" for k, some in fixed.SUBSTRATE_FACTORS.items() for s, m in some.items())
_SQL_ZONE = f"""{fx.SQL_GRID},
zone AS (SELECT ix, iy, CASE WHEN iy % 120 * 100 - 6000 < -3000 THEN 'bas_drac' WHEN ix * 100 - 6200 < -3000 AND z > 500 THEN 'vercors' WHEN ix * 100 - 6200 > 3000 AND z > 600 THEN 'belledonne'
    WHEN iy % 120 * 100 - 6000 > 2000 AND z > 400 THEN 'chartreuse' ELSE 'gresivaudan' END AS region, ix % 4 AS forest_type,
    coalesce((z >= 600)::INT + (z >= 1000)::INT + (z >= 1500)::INT + (z >= 1900)::INT, 0) AS band,
    CASE geology WHEN 'calcaire' THEN CASE WHEN z % 61 < 10 THEN 3 ELSE 1 END WHEN 'marne' THEN 3 WHEN 'granite' THEN 4 ELSE 0 END AS substrate FROM grid)"""


@query(f"WITH {_SQL_ZONE} SELECT ix, iy, region, band, substrate FROM zone")
def substrate_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _zone(fx.grid(spark, sf)).select("ix", "iy", "region", "band", "substrate")


_SQL_REGIONAL = f"""WITH {_SQL_ZONE}, p(region, species, p) AS (VALUES {_SQL_SHARES}), a(species, band, a) AS (VALUES {_SQL_AFF}), m(substrate, species, m) AS (VALUES {_SQL_MOD}),
n AS (SELECT DISTINCT species FROM p), sc AS (SELECT species, {_sql_species('species')} AS name FROM n),
s AS (SELECT species, v AS s FROM sc JOIN (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in fixed.SPECIES_SCORES.items())}) t(k, v) ON k = name),
c AS (SELECT * FROM p, (SELECT unnest([0, 1, 2, 3]) AS ft), (SELECT unnest([0, 1, 2, 3, 4]) AS b), (SELECT unnest([0, 1, 2, 3, 4]) AS sub)
    WHERE ft NOT IN (1, 2) OR (ft = 2) = (species IN ({", ".join(f"'{c}'" for c in fixed.CONIFERS)}))),
e AS (SELECT c.region, c.ft, c.b, c.sub, sum(c.p * coalesce(a.a, 1) * coalesce(m.m, 1) * s.s) AS x, sum(c.p * coalesce(a.a, 1) * coalesce(m.m, 1)) AS w
    FROM c JOIN s USING (species) LEFT JOIN a ON a.species = c.species AND a.band = c.b LEFT JOIN m ON m.species = c.species AND m.substrate = c.sub GROUP BY ALL),
f AS (SELECT region, ft, b, sub, CASE WHEN w <> 0 THEN greatest(0.05::DOUBLE, least(1, x / w)) ELSE 0.25::DOUBLE END AS score FROM e)
SELECT ix, iy, round(coalesce(CASE WHEN abs(f.score - 0.25::DOUBLE) > 0.01 THEN f.score END, g.score, 0.25::DOUBLE), 6) AS regional FROM zone
LEFT JOIN f ON f.region = zone.region AND f.ft = forest_type AND f.b = band AND f.sub = substrate
LEFT JOIN f g ON g.region = '_default' AND g.ft = forest_type AND g.b = band AND g.sub = 0"""


@query(_SQL_REGIONAL)
def regional_scores(spark: SparkSession, sf: str) -> DataFrame:
    done = enrich.regional_scores(_zone(fx.grid(spark, sf)))
    return done.select("ix", "iy", r6(F.col("regional")).alias("regional"))




_SQL_WIDE = """k AS (SELECT (range - 100)::INT AS d, exp(-0.5::DOUBLE * pow((range - 100) / 25, 2)) AS g FROM range(201)), kw AS (SELECT d, g / (SELECT sum(g) FROM k) AS w FROM k)"""


@query(
    _SQL_HORN
    + f""", {_SQL_WIDE}, f0 AS (SELECT grid.ix, grid.iy, zs, zs * zs AS sq, (slope < 8)::INT AS flat, urban FROM grid JOIN horn USING (ix, iy)), last AS (SELECT max(iy) AS ny FROM grid),
a AS (SELECT c.ix, c.iy, sum(w * n.zs) AS m, sum(w * n.sq) AS q, sum(w * n.flat) AS f FROM f0 c, kw, f0 n WHERE n.iy = c.iy AND n.ix = greatest(0, least(124, c.ix + d)) GROUP BY ALL),
b AS (SELECT c.ix, c.iy, sum(w * n.m) AS m, sum(w * n.q) AS q, sum(w * n.f) AS f FROM a c, kw, a n, last WHERE n.ix = c.ix AND n.iy = greatest(0, least(ny, c.iy + d)) GROUP BY ALL)
SELECT ix, iy, CASE WHEN urban THEN 0.8::DOUBLE ELSE 0.8::DOUBLE * (1 - 0.15::DOUBLE * CASE WHEN sqrt(greatest(q - m * m, 0)) < 15 THEN f ELSE 0 END) END AS score FROM b JOIN f0 USING (ix, iy)"""
)
def monotony_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """A score lowered on ground that is flat and even over a wide radius, not in excluded cells."""
    g = focal.slope_aspect(fx.grid(spark, sf), "zs", fx.CELL).withColumn("score", F.lit(0.8))
    return model.monotony(g, "score", "slope", "zs", "score", "urban")


# --- land cover ------------------------------------------------------------------------------

_SQL_HSV = f"""WITH {fx.SQL_PIXELS}, a AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM pixels),
h AS (SELECT *, 60::DOUBLE * (CASE WHEN hi = lo THEN 0 WHEN hi = r THEN CASE WHEN (g - b) / (hi - lo) < 0 THEN (g - b) / (hi - lo) + 6 ELSE (g - b) / (hi - lo) END
    WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END) AS hue, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END AS sat, hi / 255 AS val FROM a),
c AS (SELECT *, CASE WHEN NOT valid THEN -1 {" ".join(f"WHEN hue BETWEEN {h0} AND {h1} AND sat BETWEEN {s0}::DOUBLE AND {s1}::DOUBLE AND val BETWEEN {v0}::DOUBLE AND {v1}::DOUBLE THEN {k}" for k, (_, h0, h1, s0, s1, v0, v1) in enumerate(fixed.COLOUR_RULES, 1))} ELSE 0 END AS class FROM h)
"""


def _classed(spark: SparkSession, sf: str) -> DataFrame:
    return landcover.colour_class(fx.pixels(spark, sf), "r", "g", "b", "class", "valid")


@query(_SQL_HSV + "SELECT px, py, r, g, b, class FROM c")
def hsv_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _classed(spark, sf).select("px", "py", "r", "g", "b", "class")


@query(_SQL_HSV + f"SELECT class, CASE WHEN class >= 0 THEN [{', '.join(f'{s}::DOUBLE' for s in fixed.GREEN_SCORES)}][class + 1] ELSE 0.3::DOUBLE END AS green, count(*) AS pixels FROM c GROUP BY 1, 2")
def green_score(spark: SparkSession, sf: str) -> DataFrame:
    return _classed(spark, sf).groupBy("class").agg(F.count("*").alias("pixels")).withColumn("green", landcover.green_score(F.col("class")))


@query(_SQL_HSV + "SELECT count(*) AS pixels_total, count(*) FILTER (class > 0) AS pixels_classified, count(*) FILTER (class = -1) AS pixels_nodata, round(100.0::DOUBLE * count(*) FILTER (class > 0) / count(*) FILTER (class >= 0), 6) AS pct_classified FROM c")
def quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return landcover.quality(_classed(spark, sf), "class")


@query(
    """WITH t AS (SELECT sector_code, floor((west + 180) / 360 * 4096)::BIGINT AS x0, floor((east + 180) / 360 * 4096)::BIGINT AS x1,
    floor((1 - ln(tan(radians(north)) + 1 / cos(radians(north))) / pi()) / 2 * 4096)::BIGINT AS y0, floor((1 - ln(tan(radians(south)) + 1 / cos(radians(south))) / pi()) / 2 * 4096)::BIGINT AS y1 FROM sectors),
u AS (SELECT sector_code, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM t) SELECT sector_code, x, unnest(range(y0, y1 + 1)) AS y FROM u"""
)
def tile_ids(spark: SparkSession, sf: str) -> DataFrame:
    boxes = table(spark, sf, "sectors").select(F.col("sector_code").alias("box_id"), "west", "south", "east", "north")
    return landcover.tiles_of_boxes(boxes, 12).withColumnRenamed("box_id", "sector_code")


@query("SELECT sector_code, round(ln(tan(radians(north)) + 1 / cos(radians(north))), 9) AS top, round(degrees(atan(sinh(pi() * (1 - 2 * 1450 / 4096)))), 6) AS lat FROM sectors")
def mercator_crop(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sectors").select(
        "sector_code", F.round(landcover.mercator_y(F.col("north")), 9).alias("top"), F.round(landcover.tile_lat(F.lit(1450.0), 12), 6).alias("lat")
    )


# --- layers and land cover --------------------------------------------------------------------


@query(
    f"""WITH {fx.SQL_GRID}, t AS (SELECT ix AS tx, iy AS ty FROM grid WHERE water), d AS (SELECT ix, iy, min(pow(ix - tx, 2) + pow(iy - ty, 2)) AS d2 FROM grid, t GROUP BY ALL)
SELECT ix, iy, sqrt(d2) AS dist FROM d"""
)
def edt_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The distance to the nearest water cell, however far."""
    return focal.distance(fx.grid(spark, sf), "water", "dist")


@query(
    f"""WITH {fx.SQL_GRID}, g AS (SELECT ix, iy, CASE WHEN (ix // 20 + iy // 7) % 3 = 0 THEN z END AS v FROM grid),
f AS (SELECT a.ix, a.iy, min_by(b.v, (pow(a.ix - b.ix, 2) + pow(a.iy - b.iy, 2), b.iy, b.ix)) AS v FROM g a, g b WHERE a.v IS NULL AND b.v IS NOT NULL GROUP BY ALL)
SELECT g.ix, g.iy, coalesce(g.v, f.v) AS filled FROM g LEFT JOIN f USING (ix, iy)"""
)
def fill_any_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls filled from the nearest cell with a value, however far."""
    holed = fx.grid(spark, sf).withColumn("v", F.when((F.floor(F.col("ix") / 20) + F.floor(F.col("iy") / 7)) % 3 == 0, F.col("z")))
    return focal.fill_nearest(holed, "v", "filled")


@query(
    f"""WITH {fx.SQL_GRID}, {fx.SQL_LINES}, {fx.sql_on_lines(0.2)}, {fx.SQL_SHAPES}, {fx.sql_in_shapes(True)},
w AS (SELECT DISTINCT ix, iy FROM wet UNION SELECT ix, iy FROM hit WHERE seq % 10 = 0),
d AS (SELECT grid.ix, grid.iy, 10 * sqrt(min(pow(grid.ix - w.ix, 2) + pow(grid.iy - w.iy, 2))) AS dist FROM grid, w GROUP BY ALL)
SELECT ix, iy, w.ix IS NOT NULL AS water, dist AS dist_water FROM d LEFT JOIN w USING (ix, iy)"""
)
def water_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Water from areas (every tenth polygon) and lines, and the distance to it."""
    return masks.water_distance(fx.grid(spark, sf), fx.shapes(spark, sf).where("seq % 10 = 0").select("parts"), fx.lines(spark, sf).select("parts"), fx.CELL)


@query(f"WITH {fx.SQL_GRID}, {fx.SQL_LINES}, {fx.sql_on_lines(10.0)}, b AS (SELECT ix, iy, max(bonus) AS b FROM wet GROUP BY ALL) SELECT ix, iy, greatest(1, coalesce(b, 1))::DOUBLE AS factor FROM grid LEFT JOIN b USING (ix, iy)")
def water_bonus(spark: SparkSession, sf: str) -> DataFrame:
    return masks.water_bonus(fx.grid(spark, sf), None, fx.lines(spark, sf), fx.CELL)


@query(
    f"""WITH {fx.SQL_GRID}, {fx.SQL_LINES}, {fx.sql_on_lines(0.0)}, w AS (SELECT DISTINCT ix, iy FROM wet),
d AS (SELECT grid.ix, grid.iy, 10 * sqrt(min(pow(grid.ix - w.ix, 2) + pow(grid.iy - w.iy, 2))) AS dist FROM grid, w GROUP BY ALL)
SELECT ix, iy, dist AS dist_contact, {sql_curve('dist', curves.CONTACT)} AS score FROM d"""
)
def contact_score(spark: SparkSession, sf: str) -> DataFrame:
    """The distance to contact lines and its score."""
    met = masks.contact_distance(fx.grid(spark, sf), fx.lines(spark, sf).select("parts"), fx.CELL)
    return met.withColumn("score", curves.CONTACT.of(F.col("dist_contact")))


@query(
    f"""WITH {fx.SQL_GRID}, m AS (SELECT ix, iy, z > 600 AS m FROM grid), n AS (SELECT m.*, (SELECT max(iy) FROM grid) AS last,
    coalesce(lag(m) OVER r AND lead(m) OVER r, false) AS h, coalesce(lag(m) OVER c AND lead(m) OVER c, false) AS v FROM m WINDOW r AS (PARTITION BY iy ORDER BY ix), c AS (PARTITION BY ix ORDER BY iy)),
e AS (SELECT ix AS ex, iy AS ey FROM n WHERE m AND NOT (h AND v)),
d AS (SELECT ix, iy, 10 * sqrt(min(pow(ix - ex, 2) + pow(iy - ey, 2))) AS dist FROM grid, e GROUP BY ALL) SELECT ix, iy, dist AS dist_edge, {sql_curve('dist', curves.EDGE)} AS score FROM d"""
)
def edge_score(spark: SparkSession, sf: str) -> DataFrame:
    """The distance to the edge of a mask and its score."""
    return masks.edge_distance(fx.grid(spark, sf).withColumn("m", F.col("z") > 600), "m", fx.CELL).withColumn("score", curves.EDGE.of(F.col("dist_edge")))


_URBAN_WIDTH = "CASE t " + " ".join(f"WHEN '{t}' THEN {round(b / fx.CELL)}" for t, b in fixed.URBAN_BUFFERS.items()) + f" ELSE {round(10 / fx.CELL)} END"
_URBAN_SIZE, _URBAN_LEAST = masks.density_limit(fx.CELL)


@query(
    f"""WITH {fx.SQL_GRID}, {fx.SQL_SHAPES}, {fx.sql_in_shapes(True)}, n AS (SELECT max(iy) AS ny FROM grid),
u AS (SELECT DISTINCT ix, iy, lower([{", ".join(f"'{t}'" for t in fx.URBAN_TYPES)}][code % {len(fx.URBAN_TYPES)} + 1]) AS t FROM hit),
c AS (SELECT a.ix, a.iy, a.t, count(*) AS k FROM u a JOIN u b ON a.t = b.t AND abs(a.ix - b.ix) <= {_URBAN_SIZE // 2} AND abs(a.iy - b.iy) <= {_URBAN_SIZE // 2} GROUP BY ALL),
kept AS (SELECT ix, iy, t, {_URBAN_WIDTH} AS w FROM c, n WHERE k / ((least(ix + {_URBAN_SIZE // 2}, 124) - greatest(ix - {_URBAN_SIZE // 2}, 0) + 1) * (least(iy + {_URBAN_SIZE // 2}, ny) - greatest(iy - {_URBAN_SIZE // 2}, 0) + 1)) * {_URBAN_SIZE**2} >= {_URBAN_LEAST})
SELECT ix, iy, EXISTS (SELECT 1 FROM kept WHERE abs(kept.ix - grid.ix) + abs(kept.iy - grid.iy) <= w) AS urban FROM grid"""
)
def urban_mask(spark: SparkSession, sf: str) -> DataFrame:
    return masks.urban_mask(fx.grid(spark, sf), fx.built_up(spark, sf), fx.CELL)


def _sql_reflect(c: str, last: str) -> str:
    return f"(CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} > {last} THEN 2 * {last} + 1 - ({c}) ELSE {c} END)"


def _sql_median(table_: str, value: str, size: int) -> str:
    off = f"(SELECT unnest(range({-(size // 2)}, {size // 2 + 1}))"
    return f"""(SELECT a.ix, a.iy, median(n.{value}) AS {value} FROM {table_} a, {off} AS dx), {off} AS dy), n0
        JOIN {table_} n ON n.ix = {_sql_reflect('a.ix + dx', '124')} AND n.iy = {_sql_reflect('a.iy + dy', 'ny')} GROUP BY a.ix, a.iy)"""


@query(
    f"""WITH {fx.SQL_GRID}, n0 AS (SELECT max(iy) AS ny FROM grid), c AS (SELECT ix, iy, z, (ix // 6 * 7 + iy // 4 * 3) % 13 - 1 AS cls FROM grid),
g AS (SELECT *, CASE WHEN cls >= 0 THEN [{", ".join(f"{v}::DOUBLE" for v in fixed.GREEN_SCORES)}][cls + 1] ELSE 0.3::DOUBLE END AS green FROM c),
u AS (SELECT a.ix, a.iy, max((n.cls IN {fixed.ROADS})::INT) AS urban FROM {_sql_box('c', 'c', 1)} GROUP BY a.ix, a.iy),
w AS (SELECT a.ix, a.iy, max((n.cls IN {fixed.WATERS})::INT) AS water FROM {_sql_box('c', 'c', 2)} GROUP BY a.ix, a.iy),
m AS (SELECT ix, iy, urban > 0 AS urban, water > 0 AS water, green FROM {_sql_median('u', 'urban', 5)} JOIN {_sql_median('w', 'water', 3)} USING (ix, iy) JOIN {_sql_median('g', 'green', 3)} USING (ix, iy))
SELECT ix, iy, urban, water, CASE WHEN urban THEN 0 WHEN z > 400 AND NOT water THEN greatest(green, 0.4::DOUBLE) ELSE green END::DOUBLE AS green FROM m JOIN c USING (ix, iy)"""
)
def landcover_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Built-up, wet and green cells of colour classes, with high ground protected."""
    cells = fx.grid(spark, sf).withColumn("cls", (F.floor(F.col("ix") / 6) * 7 + F.floor(F.col("iy") / 4) * 3) % 13 - 1)
    return masks.landcover_masks(cells, "cls", F.col("z"))


@query(
    f"""WITH {fx.SQL_GRID}, t AS (SELECT ix, iy, CASE WHEN ix % 3 > 0 THEN z / 2000 ELSE 0 END AS tree, ix / 125 AS green, iy % 10 / 10 AS w FROM grid),
s AS (SELECT *, coalesce(tree > 0.05::DOUBLE, false) AS wood FROM t), k AS (SELECT *, CASE WHEN wood THEN greatest(green, 0.8::DOUBLE) ELSE green END AS shade FROM s)
SELECT ix, iy, 0.1::DOUBLE * shade AS canopy, 0.3::DOUBLE * shade AS disturbance, CASE WHEN wood THEN greatest(w, 0.15::DOUBLE) ELSE w END AS w FROM k"""
)
def landcover_modulation(spark: SparkSession, sf: str) -> DataFrame:
    cells = fx.grid(spark, sf).select("ix", "iy", F.when(F.col("ix") % 3 > 0, F.col("z") / 2000).otherwise(0.0).alias("tree"), (F.col("ix") / 125).alias("green"), (F.col("iy") % 10 / 10).alias("w"), F.lit(0.1).alias("canopy"), F.lit(0.3).alias("disturbance"))
    return masks.modulate(cells, "green", "tree", ["canopy", "disturbance"], "w").select("ix", "iy", "canopy", "disturbance", "w")


@query(f"WITH {fx.SQL_GRID}, t AS (SELECT ix, iy, (z / 1800 >= 0.7::DOUBLE)::INT AS f FROM grid) SELECT a.ix, a.iy, avg(n.f) AS density FROM {_sql_box('t', 't', 3)} GROUP BY a.ix, a.iy")
def favourable_density(spark: SparkSession, sf: str) -> DataFrame:
    cells = fx.grid(spark, sf).withColumn("tree", F.col("z") / 1800)
    return masks.favourable_density(cells, "tree", fx.CELL, "density").select("ix", "iy", "density")


@query(_SQL_HSV + "SELECT avg((r > 250 AND g > 250 AND b > 250)::INT) > 0.95::DOUBLE AS blank FROM c")
def blank_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    return masks.is_blank(fx.pixels(spark, sf))


@query(
    """WITH t AS (SELECT floor((west + 180) / 360 * 4096)::BIGINT AS x0, floor((east + 180) / 360 * 4096)::BIGINT AS x1,
    floor((1 - ln(tan(radians(north)) + 1 / cos(radians(north))) / pi()) / 2 * 4096)::BIGINT AS y0, floor((1 - ln(tan(radians(south)) + 1 / cos(radians(south))) / pi()) / 2 * 4096)::BIGINT AS y1 FROM sectors),
b AS (SELECT min(x0) AS x0, max(x1) + 1 AS x1, min(y0) AS y0, max(y1) + 1 AS y1 FROM t)
SELECT x0 / 4096 * 360 - 180 AS west, x1 / 4096 * 360 - 180 AS east, degrees(atan(sinh(pi() * (1 - 2 * y1 / 4096)))) AS south, degrees(atan(sinh(pi() * (1 - 2 * y0 / 4096)))) AS north FROM b"""
)
def tile_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return landcover.bounds_of_tiles(tile_ids(spark, sf), 12)


@query(
    f"""WITH c AS (SELECT forest_id, essence, code_tfv, tfv, tfv_g11, upper(trim(code_tfv)) AS code FROM forest),
p AS (SELECT *, string_split(replace(code, 'G', '-'), '-') AS parts FROM c),
q AS (SELECT *, list_filter(list_transform(CASE WHEN code LIKE 'LA%' THEN parts ELSE parts[2:] END, lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) >= 2) AS digits FROM p),
m AS (SELECT map_from_entries(list((k, v))) AS names FROM {_values(fixed.VEGETATION_SPECIES.items())}),
d AS (SELECT DISTINCT tfv AS e FROM forest), r AS (SELECT e, CASE WHEN length(e) >= 3 THEN {_first_in('lower(e)', fixed.TEXT_PATTERNS)} END AS name FROM d),
k AS (SELECT q.*, (SELECT v FROM {_values(fixed.VEGETATION_NAMES.items())} WHERE k = essence) AS a1, r.name AS a3,
    CASE WHEN code_tfv IS NULL OR length(code_tfv) < 2 OR code LIKE 'FH%' THEN NULL WHEN code LIKE 'FP%' THEN 'peuplier'
         ELSE list_filter(list_transform(digits, lambda x: names[x[1:2]]), lambda x: x IS NOT NULL)[1] END AS a2,
    CASE WHEN code_tfv IS NULL OR length(code_tfv) < 2 OR code LIKE 'FH%' THEN 0 WHEN code LIKE 'FP%' THEN 1 WHEN code LIKE 'LA%' THEN 4
         WHEN regexp_matches(code, '^F[FO][01]') THEN 1 WHEN regexp_matches(code, '^F[FO]2') THEN 2 WHEN regexp_matches(code, '^F[FO]3') THEN 3 ELSE 0 END AS ft,
    (SELECT v::INT FROM {_values([(a, str(b)) for a, b in fixed.FOREST_KINDS.items()])} WHERE k = tfv_g11) AS g11
    FROM q CROSS JOIN m LEFT JOIN r ON q.tfv IS NOT DISTINCT FROM r.e)
SELECT forest_id, coalesce(a1, a2, a3, 'unknown') AS species, CASE WHEN a1 IS NULL AND ft > 0 THEN ft ELSE coalesce(g11, 0) END AS forest_type FROM k"""
)
def vegetation_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Species and kind of forest of every stand: exact name, code, then patterns of the text."""
    return resolve.vegetation_cascade(table(spark, sf, "forest"), "essence", "code_tfv", ["tfv"], "tfv_g11").select("forest_id", "species", "forest_type")


@query(
    _SQL_MODEL
    + " UNION ALL ".join(
        f"SELECT '{k}' AS criterion, count(*) FILTER (s_{k} IS NULL) AS missing, min(s_{k}) AS low, max(s_{k}) AS high, min(s_{k}) >= -0.001::DOUBLE AND max(s_{k}) <= 1.001::DOUBLE AS valid FROM scored" for k in ("geology", "tree_species", "altitude", "slope", "twi")
    )
)
def score_validation(spark: SparkSession, sf: str) -> DataFrame:
    names = ["geology", "tree_species", "altitude", "slope", "twi"]
    return model.validate(scored_cells(spark, sf).select(*[F.col(f"s_{k}").alias(k) for k in names]), names)


_SQL_CLOSED = f"""{fx.SQL_GRID}, top AS (SELECT *, coalesce(z / 2000 >= 0.85::DOUBLE, false) AS h FROM grid),
wide AS (SELECT a.ix, a.iy, bool_or(n.h) AS h FROM {_sql_box('top', 'top', 1)} GROUP BY a.ix, a.iy),
closed AS (SELECT a.ix, a.iy FROM {_sql_box('wide', 'wide', 1)} GROUP BY a.ix, a.iy HAVING bool_and(n.h) AND count(*) = 9),
hot AS (SELECT grid.*, iy * 125 + ix AS id FROM grid JOIN closed USING (ix, iy))"""


@query(
    f"""WITH RECURSIVE {_SQL_CLOSED}, {_SQL_REGION} SELECT region, count(*) AS n_cells, avg(coalesce(z / 2000, 0)) AS mean_score, max(coalesce(z / 2000, 0)) AS max_score, avg(coalesce(z, 0)) AS altitude FROM region GROUP BY region HAVING count(*) >= 4"""
)
def hotspots_closed(spark: SparkSession, sf: str) -> DataFrame:
    """All regions of high scores after closing, without a limit."""
    cells = fx.grid(spark, sf).select("ix", "iy", (F.col("z") / 2000).alias("score"), F.col("z").alias("altitude"), F.lit(0.0).alias("slope"), "species", "geology")
    return model.hotspots(cells, fx.NX, fx.CELL, threshold=0.85).select("region", "n_cells", "mean_score", "max_score", "altitude")


# --- all together ----------------------------------------------------------------------------


def suitability(g: DataFrame, built_up: DataFrame | None = None, water: DataFrame | None = None, contacts: DataFrame | None = None, weather: float | None = None) -> DataFrame:
    """The whole model over a grid ``ix, iy, z, zs, species, geology, water, urban``: all measures, scores and the class.

    In order: terrain (slope, roughness, wetness) from the smooth surface; the built-up mask
    (of the cells and of areas ``parts, urban_type``); water distance and bonus (of the cells
    and of lines ``parts, bonus``); contact lines ``parts``; the criterion scores, weighted;
    hard exclusions; the fade towards excluded cells; the penalties for even ground and for
    dry limestone; smoothing over the cells that are not excluded; the weather factor; the
    class. Distances are exact however far. ``score`` is the final score, ``raw`` the
    weighted one, ``excluded`` whether any exclusion holds.
    """
    keys, extent = ["ix", "iy"], polygons.extent_of(g)
    on_lines = lambda lines, reach: polygons.spans(lines, "parts", extent, reach=reach, filled=False)
    layers = {} if built_up is None else {"__town": masks.urban_lists(g, built_up, extent, fx.CELL)}
    if water is not None:
        bonus = on_lines(water.where("bonus is not null").select("bonus", "parts"), 100.0 / fx.CELL)
        layers |= {"__wet": polygons.lists_of(on_lines(water.select("parts"), 2.0 / fx.CELL), F.lit(True), []), "__bonus": polygons.lists_of(bonus, F.col("bonus"), ["bonus"])}
    if contacts is not None:
        layers["__met"] = polygons.lists_of(on_lines(contacts.select("parts"), 0.0), F.lit(True), [])
    cells = polygons.all_looked_up(g, layers) if layers else g
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    if built_up is not None:
        cells = cells.withColumn("urban", no("urban") | no("__town"))
    if water is not None:
        cells = cells.withColumn("water", no("water") | no("__wet")).withColumn("factor", F.greatest(F.coalesce("__bonus", F.lit(1.0)), F.lit(1.0)))
    else:
        cells = cells.withColumn("factor", F.lit(1.0))
    cells = focal.terrain(cells.drop("__town", "__wet", "__bonus"), "zs", fx.CELL).drop("flow")
    cells = focal.box_std(cells, "slope", 5, "roughness")
    reach = {"dist_water": "water", "dist_urban": "urban"} | ({} if contacts is None else {"dist_contact": "__met"})
    cells = focal.distances(cells, reach).drop("__met").withColumns({o: F.col(o) * fx.CELL for o in reach})
    cells = cells if contacts is not None else cells.withColumn("dist_contact", F.lit(None).cast("double"))
    acc = graph.flow_accumulation(focal.flow_direction(g, "zs", fx.CELL), fx.NX, fx.CELL * fx.CELL)
    cells = cells.join(acc, keys).withColumn("twi", _wetness()).drop("acc", "tan")
    known = resolve.scored(resolve.species(F.col("species")), fixed.SPECIES_SCORES)
    scores = {
        "geology": resolve.scored(F.col("geology"), fixed.GEOLOGY_SCORES),
        "tree_species": F.when(F.col("species").isNotNull(), known).otherwise(0.5),
        "altitude": curves.ALTITUDE.of(F.col("altitude")),
        "slope": curves.SLOPE.of(F.col("slope")),
        "aspect": curves.aspect_score(F.col("aspect"), F.col("slope")),
        "terrain_roughness": curves.ROUGHNESS.of(F.col("roughness")),
        "twi": curves.TWI.of(F.col("twi")),
        "dist_water": masks.water_score(F.col("dist_water"), F.col("factor")),
        "urban_proximity": curves.URBAN.of(F.col("dist_urban")),
        "canopy_openness": F.lit(0.10),
        "ground_cover": curves.ground_cover_score(F.col("slope")),
        "disturbance": F.lit(0.3),
        "geology_contact": curves.CONTACT.of(F.col("dist_contact")),
    }
    raw, coverage = model.weighted({k: F.col(f"s_{k}") for k in scores})

    def scored(cells: DataFrame) -> DataFrame:
        """Adds what follows from a cell's own measures; taken again at the end, since it is more to take along than to find."""
        cells = cells.withColumns({"altitude": F.col("zs"), "nodata": F.col("z").isNull()})
        return cells.withColumns({f"s_{k}": c for k, c in scores.items()}).withColumns({"raw": raw, "coverage": coverage})

    measures = cells.columns
    cells, out = scored(cells), F.lit(False)
    for c in model.exclusions(cells).values():
        out = out | c
    cells = cells.select(*measures, "raw", out.alias("excluded"))
    cells = focal.distances(cells, {"__e": "excluded"})
    cells = cells.withColumn("score", F.when(F.col("excluded"), 0.0).otherwise(model.fade(F.col("raw"), F.col("__e"), 15.0, fx.CELL))).drop("__e", "raw")
    dry = (enrich.substrate_of(F.col("geology"), F.col("slope")) == 1) & (F.col("zs") < 700) & (F.col("slope") > 10) & ~F.col("excluded")
    lime = F.when(F.coalesce(dry, F.lit(False)), model.dry_factor(F.col("roughness"), F.col("twi"))).otherwise(1.0)
    cells = model.settled(cells, "score", "slope", "zs", lime, "excluded", "__s", extent=extent)
    cells = scored(cells).withColumn("score", F.when(F.col("excluded"), 0.0).otherwise(F.col("__s") * (1.0 if weather is None else 0.4 + 0.6 * weather))).drop("__s")
    return cells.withColumn("class", model.class_of(F.col("score")))


@query()
def suitability_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """The number of cells of each class, with all layers."""
    lines = fx.lines(spark, sf)
    done = suitability(fx.grid(spark, sf), fx.built_up(spark, sf), lines, lines.where("seq % 3 = 0").select("parts"))
    return model.distribution(done, "score")
