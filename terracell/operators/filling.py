"""Fill missing values from records of the same entity, near in time."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from terracell.functions.textform import canonical

# What people write where there is no value, in lower case.
STAND_INS = (
    "-", "--", "—", "–", "?", "??", "???", ".", "..", "...", "/", "*", "#n/a", "#na", "n/a", "na", "n.a.", "n.a", "nc", "n.c.",
    "nr", "n.r.", "nd", "n.d.", "ns", "s.o.", "so", "null", "none", "nil", "nan", "void", "vide", "empty", "unknown", "inconnu",
    "inconnue", "indéfini", "indefini", "non renseigné", "non renseigne", "non relevé", "non connu", "non défini",
    "à compléter", "a completer", "sans objet", "aucun", "aucune", "missing", "undefined", "x", "xx", "xxx", "xxxx", "tbd",
)


@F.pandas_udf(StringType())  # a type, not its name, which would need a session at import
def _form(values: pd.Series) -> pd.Series:
    return pd.Series(canonical(pa.array(values, pa.string()))[0].to_pylist(), dtype=object)


def text_form(value: Column) -> Column:
    """The common form of a text; only values that are not plain text leave the JVM."""
    plain = value.rlike(r"^[\x21-\x7eÀ-ÖØ-öø-ÿŒœ]+( [\x21-\x7eÀ-ÖØ-öø-ÿŒœ]+)*$")
    return F.coalesce(F.when(plain, value), _form(F.when(~plain, value)))


def present(form: Column) -> Column:
    """The form where it is a value, null where it is blank or stands for no value."""
    return F.when((F.length(form) > 0) & ~F.lower(form).isin(*STAND_INS), form)


def fill_category(
    df: DataFrame,
    row_id: str,
    entity: str,
    period: str,
    column: str,
    upper: bool = False,
    gap_limit: int | None = None,
) -> DataFrame:
    """Carry a category to the rows of an entity that miss it.

    Returns one row for each row of ``df`` whose ``column`` is missing (null, blank or a
    stand-in): ``row_id, filled, method, distance``. ``method`` is ``same_period`` when the
    present values of that entity and period are all one value, ``neighbours`` when that
    period has none and those of the nearest earlier and later periods are one value
    between them, else null together with ``filled``. ``distance`` is the gap in periods to
    the nearest neighbour used; neighbours further than ``gap_limit`` are left out.

    Rows whose entity or period is null are not filled. Repeated rows count like single
    ones, ties cannot occur (several values give none), extra columns are ignored, an empty
    table gives an empty result. The rows are reduced to one per entity and period before
    the ordered pass, so an entity holding most rows costs as many rows as it has periods.
    """
    form = text_form(df[column])
    rows = df.select(
        df[row_id].alias("row_id"),
        df[entity].alias("__entity"),
        df[period].cast("long").alias("__period"),
        present(F.upper(form) if upper else form).alias("__value"),
    )
    per_period = (
        rows.where(F.col("__entity").isNotNull() & F.col("__period").isNotNull())
        .groupBy("__entity", "__period")
        .agg(F.min("__value").alias("__lo"), F.max("__value").alias("__hi"), F.max(F.col("__value").isNull()).alias("__misses"))
    )
    order = Window.partitionBy("__entity").orderBy("__period")
    seen = F.when(F.col("__lo").isNotNull(), F.struct("__period", "__lo", "__hi"))
    around = per_period.withColumns(
        {
            "__before": F.last(seen, True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "__after": F.first(seen, True).over(order.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).where("__misses")
    if gap_limit is not None:
        near = F.col("__period")
        around = around.withColumns(
            {
                "__before": F.when(near - F.col("__before.__period") <= gap_limit, F.col("__before")),
                "__after": F.when(F.col("__after.__period") - near <= gap_limit, F.col("__after")),
            }
        )
    low = F.least("__before.__lo", "__after.__lo")
    high = F.greatest("__before.__hi", "__after.__hi")
    found = around.select(
        "__entity",
        "__period",
        F.when(F.col("__lo").isNotNull(), F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")))
        .otherwise(F.when(low == high, low))
        .alias("filled"),
        F.when(F.col("__lo").isNotNull(), F.lit("same_period")).otherwise(F.lit("neighbours")).alias("__method"),
        F.when(F.col("__lo").isNotNull(), F.lit(0).cast("long"))
        .otherwise(F.least(F.col("__period") - F.col("__before.__period"), F.col("__after.__period") - F.col("__period")))
        .alias("__gap"),
    )
    return (
        rows.where("__value is null")
        .join(found, ["__entity", "__period"], "left")
        .select(
            "row_id",
            "filled",
            F.when(F.col("filled").isNotNull(), F.col("__method")).alias("method"),
            F.when(F.col("filled").isNotNull(), F.col("__gap")).alias("distance"),
        )
    )


def fill_number(df: DataFrame, row_id: str, entity: str, period: str, column: str, gap_limit: int | None = None) -> DataFrame:
    """Interpolate a number for the rows of an entity that miss it (null or NaN).

    Returns one row for each such row: ``row_id, filled, method, distance``. The value of a
    period is the mean of its present values. ``same_period`` takes that mean;
    ``interpolated`` lies on the line between the nearest earlier and later periods;
    ``carried`` takes the one side there is. ``distance`` is the gap to the nearer period
    used. Periods further than ``gap_limit`` are not used. Rows of a null entity or period
    are not filled; nothing to fill from gives null in all three columns.
    """
    value = F.when(~F.isnan(df[column].cast("double")), df[column].cast("double"))
    rows = df.select(
        df[row_id].alias("row_id"), df[entity].alias("__entity"), df[period].cast("long").alias("__period"), value.alias("__value")
    )
    per_period = (
        rows.where(F.col("__entity").isNotNull() & F.col("__period").isNotNull())
        .groupBy("__entity", "__period")
        .agg(F.avg("__value").alias("__mean"), F.max(F.col("__value").isNull()).alias("__misses"))
    )
    order = Window.partitionBy("__entity").orderBy("__period")
    seen = F.when(F.col("__mean").isNotNull(), F.struct("__period", "__mean"))
    around = per_period.withColumns(
        {
            "__before": F.last(seen, True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "__after": F.first(seen, True).over(order.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).where("__misses")
    back, ahead = F.col("__period") - F.col("__before.__period"), F.col("__after.__period") - F.col("__period")
    if gap_limit is not None:
        around = around.withColumns(
            {"__before": F.when(back <= gap_limit, F.col("__before")), "__after": F.when(ahead <= gap_limit, F.col("__after"))}
        )
    a, b = F.col("__before.__mean"), F.col("__after.__mean")
    found = around.select(
        "__entity",
        "__period",
        F.coalesce("__mean", a + (b - a) * back / (back + ahead), a, b).alias("filled"),
        F.when(F.col("__mean").isNotNull(), "same_period")
        .when(a.isNotNull() & b.isNotNull(), "interpolated")
        .when(a.isNotNull() | b.isNotNull(), "carried")
        .alias("method"),
        F.when(F.col("__mean").isNotNull(), F.lit(0).cast("long")).otherwise(F.least(back, ahead)).alias("distance"),
    )
    return (
        rows.where("__value is null").join(found, ["__entity", "__period"], "left").select("row_id", "filled", "method", "distance")
    )
