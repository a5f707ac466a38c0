"""Scores for cells without a known species: observations, points, then regional shares."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell import fixed
from terracell.operators import resolve


@functools.cache
def regional_table() -> tuple[tuple[str, int, int, int, float], ...]:
    """``region, forest_type, band, substrate, score`` for all combinations, from the fixed values alone.

    Shares are kept to the broad-leaved or coniferous species of the forest type (all, where
    none is left), changed by the substrate, and weigh the species scores together with the
    affinity to the band; 0.25 where nothing weighs. Everything sums within a combination,
    so the steps that only rescale the shares cancel out. A score that is hardly different
    from 0.25 gives way to the general share; the region '' stands for any other region.
    """
    bands, substrates = range(len(fixed.BANDS)), range(5)
    own: dict[tuple[str, int, int, int], float] = {}
    for (region, shares), kind, band, substrate in itertools.product(fixed.REGIONS.items(), range(4), bands, substrates):
        total = got = 0.0
        for name, share in shares.items():
            if kind in (1, 2) and (name in fixed.CONIFERS) == (kind == 1):
                continue
            weight = share * fixed.AFFINITY.get(name, (1.0,) * len(bands))[band] * fixed.SUBSTRATE_FACTORS.get(substrate, {}).get(name, 1.0)
            total += weight
            got += weight * fixed.SPECIES_SCORES[resolve.species_name(name)]
        own[region, kind, band, substrate] = min(1.0, max(0.05, got / total)) if total else 0.25
    rows = [(r, k, b, s, v if abs(v - 0.25) > 0.01 else own["_default", k, b, 0]) for (r, k, b, s), v in own.items()]
    rows += [("", k, b, s, own["_default", k, b, 0]) for k, b, s in itertools.product(range(4), bands, substrates)]
    return tuple(rows)


def band_of(altitude: Column) -> Column:
    """The band of altitude, 0 where it is missing."""
    return F.coalesce(sum((F.when(altitude >= b, 1).otherwise(0) for b in fixed.BANDS[1:]), F.lit(0)), F.lit(0))


def region_of(dx: Column, dy: Column, altitude: Column) -> Column:
    """The region by offset from the centre and altitude; the last rule that holds counts."""
    return (
        F.when(dy < -3000, "bas_drac")
        .when((dx < -3000) & (altitude > 500), "vercors")
        .when((dx > 3000) & (altitude > 600), "belledonne")
        .when((dy > 2000) & (altitude > 400), "chartreuse")
        .otherwise("gresivaudan")
    )


def substrate_of(category: Column, slope: Column) -> Column:
    """Substrate of a geological category; dry limestone on flat ground counts as marly."""
    pairs = [F.lit(x) for kv in fixed.SUBSTRATES.items() for x in kv]
    code = F.coalesce(F.try_element_at(F.create_map(*pairs), category), F.lit(0))
    return F.when((code == 1) & (slope < 10), 3).otherwise(code)


def regional_scores(cells: DataFrame) -> DataFrame:
    """Adds ``regional`` to cells with ``region, forest_type, band, substrate``; unknown regions get the general shares."""
    table = cells.sparkSession.createDataFrame(list(regional_table()), "__r string, forest_type int, band int, substrate int, regional double")
    known = F.when(F.col("region").isin(*fixed.REGIONS), F.col("region")).otherwise("")
    small = F.broadcast(table)  # 7 regions x 4 types x 5 bands x 5 substrates
    found = cells.withColumn("__r", known).join(small, ["__r", "forest_type", "band", "substrate"], "left").drop("__r")
    return found.withColumn("regional", F.coalesce("regional", F.lit(0.25)))
