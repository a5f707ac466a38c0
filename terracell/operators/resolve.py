"""Names resolved by ordered rules: exact tables first, then the first rule that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell import fixed


def first_contained(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The category of the first rule whose keyword the text holds, else null."""
    out = F.when(text.contains(rules[0][0]), F.lit(rules[0][1]))
    for keyword, category in rules[1:]:
        out = out.when(text.contains(keyword), F.lit(category))
    return out


def looked_up(key: Column, table: dict[str, str]) -> Column:
    """The entry of a small fixed table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def scored(name: Column, scores: dict[str, float], default: str = "unknown") -> Column:
    pairs = [F.lit(x) for kv in scores.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(scores[default]))


def species_key(raw: Column) -> Column:
    """Small letters, blanks and hyphens as underscores, without apostrophes and eight accents."""
    return F.translate(F.lower(F.trim(raw)), " -éèêâîôùû'", "__eeeaiouu")


def species(raw: Column) -> Column:
    """Canonical species: exact name, exact alias, first name contained, first alias contained, else unknown."""
    key = species_key(raw)
    names = {n: n for n in fixed.SPECIES_SCORES}
    contained = tuple((n, n) for n in fixed.SPECIES_SCORES if n != "unknown")
    return F.coalesce(
        looked_up(key, names),
        looked_up(key, fixed.SPECIES_ALIASES),
        first_contained(key, contained),
        first_contained(key, tuple(fixed.SPECIES_ALIASES.items())),
        F.lit("unknown"),
    )


def species_name(text: str) -> str:
    """:func:`species` of a text in the driver, for small fixed tables."""
    key = text.strip().lower().translate(str.maketrans(" -éèêâîôùû", "__eeeaiouu", "'"))
    if key in fixed.SPECIES_SCORES:
        return key
    if key in fixed.SPECIES_ALIASES:
        return fixed.SPECIES_ALIASES[key]
    inside = [(n, n) for n in fixed.SPECIES_SCORES if n != "unknown"] + list(fixed.SPECIES_ALIASES.items())
    return next((name for word, name in inside if word in key), "unknown")


def geology(raw: Column) -> Column:
    """Geological category: map code, category name, first keyword contained, else unknown."""
    code = F.trim(raw)
    names = {n: n for n in fixed.GEOLOGY_SCORES}
    return F.coalesce(
        looked_up(code, fixed.GEOLOGY_CODES),
        looked_up(F.translate(F.lower(code), " -", "__"), names),
        first_contained(F.lower(code), fixed.GEOLOGY_KEYWORDS),
        F.lit("unknown"),
    )


def geology_cascade(df: DataFrame, descr: str, notation: str, out: str) -> DataFrame:
    """Adds ``out``: the category of the description, then of its late overrides, then of the map notation; else unknown.

    Three projections without a shuffle: each chain of rules is evaluated in one of them,
    so none is pasted into the others and the generated code stays small.
    """
    text, code = F.trim(df[descr]), F.trim(df[notation])
    df = df.withColumns({"__t": F.when(F.length(text) > 0, F.lower(text)), "__c": F.when(F.length(code) > 0, code)})
    df = df.withColumns({"__1": geology(F.col("__t")), "__2": first_contained(F.col("__t"), fixed.GEOLOGY_OVERRIDES)})
    codes = F.coalesce(looked_up(F.col("__c"), fixed.GEOLOGY_CODES), looked_up(F.lower("__c"), fixed.GEOLOGY_CODES))
    df = df.withColumn("__3", F.when(F.col("__c").isNotNull(), F.coalesce(codes, geology(F.col("__c")))))
    known = lambda c: F.when(F.col(c) != "unknown", F.col(c))
    return df.withColumn(out, F.coalesce(known("__1"), F.col("__2"), known("__3"), F.lit("unknown"))).drop("__t", "__c", "__1", "__2", "__3")


def water_type(raw: Column) -> Column:
    """Water type key: exact name, first name contained, else unknown."""
    text = F.lower(F.trim(raw))
    return F.coalesce(looked_up(text, fixed.WATER_TYPES), first_contained(text, tuple(fixed.WATER_TYPES.items())), F.lit("unknown"))


def vegetation_code(raw: Column) -> Column:
    """``struct<species, forest_type>`` of a vegetation code such as FF1-09-09, FF2G61-61, LA6-04 or FP."""
    code = F.upper(F.trim(raw))
    heath = code.startswith("LA")
    third = F.substring(code, 3, 1)
    wood = code.rlike("^F[FO].")
    kind = F.when(heath, 4).when(wood & third.isin("1", "0"), 1).when(wood & (third == "2"), 2).when(wood & (third == "3"), 3).otherwise(0)
    parts = F.split(F.translate(code, "G", "-"), "-")
    parts = F.when(heath, parts).otherwise(F.slice(parts, 2, 100))
    digits = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "[^0-9]", "")), lambda d: F.length(d) >= 2)
    named = F.filter(F.transform(digits, lambda d: looked_up(F.substring(d, 1, 2), fixed.VEGETATION_SPECIES)), lambda s: s.isNotNull())
    found = F.coalesce(F.try_element_at(named, F.lit(1)), F.lit("unknown"))
    plain = F.length(raw) >= 2
    return F.struct(
        F.when(~F.coalesce(plain, F.lit(False)) | code.startswith("FH"), "unknown").when(code.startswith("FP"), "peuplier").otherwise(found).alias("species"),
        F.when(~F.coalesce(plain, F.lit(False)) | code.startswith("FH"), 0).when(code.startswith("FP"), 1).otherwise(kind).alias("forest_type"),
    )


def species_in_text(raw: Column) -> Column:
    """The first species pattern contained in a free text of three letters or more, else unknown."""
    return F.coalesce(F.when(F.length(raw) >= 3, first_contained(F.lower(raw), fixed.TEXT_PATTERNS)), F.lit("unknown"))


def vegetation_cascade(df: DataFrame, essence: str, code: str, texts: list[str], group: str, out: tuple[str, str] = ("species", "forest_type")) -> DataFrame:
    """Adds species and kind of forest: the exact name, then the code, then patterns in the texts in their order.

    The kind of forest is that of the code where the name says nothing, else that of the
    vegetation group. Three projections without a shuffle.
    """
    df = df.withColumns({"__n": looked_up(F.col(essence), fixed.VEGETATION_NAMES), "__c": vegetation_code(F.col(code))})
    known = lambda c: F.when(c != "unknown", c)
    named = F.coalesce("__n", known(F.col("__c.species")), *[known(species_in_text(F.col(t))) for t in texts], F.lit("unknown"))
    kinds = F.create_map(*[F.lit(x) for kv in fixed.FOREST_KINDS.items() for x in kv])
    coded = F.when(F.col("__n").isNull() & (F.col("__c.forest_type") > 0), F.col("__c.forest_type"))
    kind = F.coalesce(coded, F.try_element_at(kinds, F.col(group)), F.lit(0))
    return df.withColumns({out[0]: named, out[1]: kind}).drop("__n", "__c")


def best_score(columns: list[Column], rule, scores: dict[str, float]) -> Column:
    """The greatest score that any of several columns gives under a naming rule."""
    each = [F.coalesce(scored(rule(c), scores), F.lit(scores["unknown"])) for c in columns]
    return F.greatest(*each) if len(each) > 1 else each[0]
