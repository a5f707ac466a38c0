"""Vector layers, observations and forecasts from JSON, with fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell import fixed
from terracell.operators import resolve


def _first_of(names: list[str], properties: str = "properties") -> Column:
    """The first of several property names that a feature has."""
    return F.coalesce(*[F.try_element_at(F.col(properties), F.lit(n)) for n in names])


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """``properties`` (map), ``kind``, ``xmin, ymin, xmax, ymax`` and ``geometry`` (JSON) of each feature of some collections.

    The box is that of all numbers of the coordinates, taken in pairs; a feature without
    geometry has a null box.
    """
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<string>").alias("c"))
    one = text.select(F.explode("c.features").alias("f")).select(
        F.from_json("f", "properties map<string,string>, geometry string").alias("f")
    )
    shape = F.from_json("f.geometry", "type string, coordinates string")
    out = one.select(F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry"), shape.alias("s"))
    pairs = F.transform(
        F.regexp_extract_all("s.coordinates", F.lit(r"\[\s*(-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+)"), F.lit(1)),
        lambda p: F.transform(F.split(p, ","), lambda v: F.trim(v).cast("double")),
    )
    out = out.withColumn("p", pairs)
    side = lambda k, f: f(F.transform("p", lambda v: v[k]))
    return out.select(
        "properties",
        F.col("s.type").alias("kind"),
        side(0, F.array_min).alias("xmin"),
        side(1, F.array_min).alias("ymin"),
        side(0, F.array_max).alias("xmax"),
        side(1, F.array_max).alias("ymax"),
        "geometry",
    )


def in_box(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """The features whose box meets a box; on Parquet the test reaches the scan."""
    return df.where((F.col("xmin") <= east) & (F.col("xmax") >= west) & (F.col("ymin") <= north) & (F.col("ymax") >= south))


def normal_forest(df: DataFrame, source: str) -> DataFrame:
    """Features with ``essence, essence_canonical, tfv, tree_score, source``."""
    essence = _first_of(["ESSENCE", "essence", "Essence", "species", "genus", "LIBELLE"])
    return df.withColumns(
        {
            "essence": essence,
            "essence_canonical": resolve.species(essence),
            "tfv": _first_of(["TFV", "tfv"]),
            "tree_score": resolve.scored(resolve.species(essence), fixed.SPECIES_SCORES),
            "source": F.lit(source),
        }
    )


def normal_geology(df: DataFrame, source: str) -> DataFrame:
    """Features with ``descr, notation, geology_canonical, geology_score, source``."""
    descr, notation = _first_of(["DESCR", "descr", "DESCRIPTION", "LITHO"]), _first_of(["NOTATION", "notation", "CODE"])
    named = resolve.geology_cascade(df.withColumns({"descr": descr, "notation": notation}), "descr", "notation", "geology_canonical")
    return named.withColumns({"geology_score": resolve.scored(F.col("geology_canonical"), fixed.GEOLOGY_SCORES), "source": F.lit(source)})


def normal_water(df: DataFrame, source: str) -> DataFrame:
    """Features with ``nom, water_type, water_type_key, water_bonus, source``."""
    kind = F.coalesce(_first_of(["water_type", "type", "nature", "NATURE", "regime"]), F.lit("unknown"))
    return df.withColumns(
        {
            "nom": F.coalesce(_first_of(["NOM", "nom", "name", "NAME", "toponyme", "TOPONYME"]), F.lit("Sans nom")),
            "water_type": kind,
            "water_type_key": resolve.water_type(kind),
            "water_bonus": resolve.scored(resolve.water_type(kind), fixed.WATER_BONUS),
            "source": F.lit(source),
        }
    )


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """``type, id, tags`` and the nodes' box of the elements of map service answers, one row for each element.

    Elements repeated in several answers come once; ones in tunnels or below ground level
    are left out.
    """
    schema = "elements array<struct<type: string, id: bigint, tags: map<string,string>, geometry: array<struct<lat: double, lon: double>>>>"
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["elements"]).alias("e")).select("e.*")
    tag = lambda k: F.try_element_at(F.col("tags"), F.lit(k))
    kept = text.where(F.coalesce(tag("tunnel"), F.lit("no")).isin("no", "") & ~F.coalesce(tag("layer"), F.lit("0")).startswith("-"))
    side = lambda f, k: f(F.transform("geometry", lambda p: p[k]))
    boxed = kept.select("type", "id", "tags", side(F.array_min, "lon").alias("xmin"), side(F.array_min, "lat").alias("ymin"), side(F.array_max, "lon").alias("xmax"), side(F.array_max, "lat").alias("ymax"))
    return boxed.dropDuplicates(["type", "id"])


def observations(spark: SparkSession, path: str) -> DataFrame:
    """``seq, nom, xmin, ymin, xmax, ymax, score`` of a JSON list of observation boxes.

    The score is ``score_override``, else the sum of the shares times the species scores.
    """
    schema = "array<struct<nom: string, xmin: double, xmax: double, ymin: double, ymax: double, score_override: double, essences: map<string,double>>>"
    one = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)).alias("seq", "o")).select("seq", "o.*")
    shares = F.transform(F.map_entries("essences"), lambda e: e["value"] * resolve.scored(resolve.species(e["key"]), fixed.SPECIES_SCORES))
    total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return one.select("seq", "nom", zero("xmin"), zero("ymin"), zero("xmax"), zero("ymax"), F.coalesce("score_override", total).alias("score"))


def citizen_points(spark: SparkSession, path: str) -> DataFrame:
    """``seq, id, lat, lon, quality_grade, observed_on, value``: the value by the grade of the observation."""
    schema = "results array<struct<id: bigint, location: string, quality_grade: string, observed_on: string>>"
    one = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)["results"]).alias("seq", "o")).select("seq", "o.*")
    part = lambda k: F.get(F.split("location", ","), F.lit(k)).try_cast("double")
    value = F.when(F.col("quality_grade") == "research", 0.90).otherwise(0.75)
    return one.select("seq", "id", part(0).alias("lat"), part(1).alias("lon"), "quality_grade", "observed_on", value.alias("value")).where("lat is not null and lon is not null")


def forecast(spark: SparkSession, path: str) -> DataFrame:
    """``day, t_max, t_min, t, rain, rain_chance, rh, wind, certainty`` from arrays by day, with a default for each missing value."""
    # Field names and defaults.
    names = {
        "temperature_max": ("t_max", 15.0), "temperature_min": ("t_min", 5.0), "temperature_mean": ("t", 10.0), "precipitation": ("rain", 0.0),
        "precipitation_probability": ("rain_chance", 50.0), "relativehumidity_mean": ("rh", 70.0), "windspeed_mean": ("wind", 10.0), "predictability": ("certainty", 80.0),
    }
    fields = ", ".join(f"{n}: array<double>" for n in names)
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", f"data_day struct<time: array<string>, {fields}>")["data_day"].alias("d"))
    days = one.select("d", F.posexplode("d.time").alias("k", "day"))
    return days.select(F.to_date("day").alias("day"), *[F.coalesce(F.get(F.col(f"d.{n}"), F.col("k")), F.lit(v)).alias(a) for n, (a, v) in names.items()])
