"""Area profiles: four source tables cleaned, enriched and fused.

Sources (column names are fixed here, rename before if yours differ):

* population: code, area, age, class, n
* geography: area, dep, reg, latitude, longitude (+ anything to carry along)
* establishments: code, area, dep, reg, and one count per fine size class
* wages: code, area, and one mean rate per category
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areastats.functions import code_prefix_fill, decimal_comma, differs, in_range, map_values, not_in, replace_text
from areastats.operators import cleaning, joins, stats


@dataclass(frozen=True)
class ProfileRules:
    """Everything about the sources that is a matter of country and year, not of method."""

    sizes: Mapping[str, Sequence[str]]
    rates: Mapping[str, str]
    region_names: Mapping[int, str]
    excluded_regions: Sequence[int] = ()
    region_recodes: Mapping[int, int] = field(default_factory=dict)
    dep_recodes: Mapping[str, str] = field(default_factory=dict)
    code_replacements: Mapping[str, str] = field(default_factory=dict)
    region_fixes: Sequence[tuple[str, object, int]] = ()  # (column, value, region to set)
    dep_fixes: Sequence[tuple[str, object, str]] = ()
    age_from: int = 15
    age_below: int = 65
    no_coordinate: str = "-"
    dep_prefix: int = 2
    total: str = "firms"


def clean_regions(df: DataFrame, rules: ProfileRules) -> DataFrame:
    """Leave out the excluded regions and give the others their present number."""
    kept = df.where(not_in("reg", rules.excluded_regions))
    return cleaning.recode(kept, "reg", rules.region_recodes)


def _clean_codes(df: DataFrame, rules: ProfileRules) -> DataFrame:
    out = cleaning.recode(df, "dep", rules.dep_recodes)
    return out.withColumn("code", replace_text("code", rules.code_replacements)) if "code" in df.columns else out


def clean_population(population: DataFrame, establishments: DataFrame, rules: ProfileRules) -> DataFrame:
    """People of working age per area and class.

    Age and every other finer dimension are summed away first, on the source's own
    keys, so that the lookups and joins after it work on far fewer rows.
    """
    working = population.where(in_range("age", rules.age_from, rules.age_below) & differs("n", 0))
    people = working.groupBy("area", "class", "code").agg(F.sum("n").alias("pop"))
    people = cleaning.lookup(people, establishments, "code", {"reg": "reg", "dep": "dep"}, order=["area", "reg", "dep"])
    people = cleaning.override(people, [(F.col(c) == F.lit(v), "reg", to) for c, v, to in rules.region_fixes])
    people = cleaning.drop_null(people, ["reg"])
    people = _clean_codes(people, rules)
    people = cleaning.override(people, [(F.col(c) == F.lit(v), "dep", to) for c, v, to in rules.dep_fixes])
    return stats.group_sums(people, ["area", "class", "code", "reg", "dep"], ["pop"])


def clean_wages(wages: DataFrame, establishments: DataFrame, rules: ProfileRules) -> DataFrame:
    """Rates per area with region and department; unknown departments come from the code."""
    rows = cleaning.lookup(wages, establishments, "code", {"reg": "reg", "dep": "dep"}, order=["area", "reg", "dep"])
    rows = _clean_codes(cleaning.drop_null(rows, ["reg"]), rules)
    rows = rows.withColumn("dep", code_prefix_fill("dep", "code", rules.dep_prefix))
    rows = rows.withColumnsRenamed(dict(rules.rates))
    return rows.select("code", "area", "reg", "dep", *rules.rates.values())


def clean_geography(geography: DataFrame, rules: ProfileRules) -> DataFrame:
    """Places that have coordinates, with region name and numeric coordinates."""
    rows = clean_regions(geography, rules)
    rows = cleaning.recode(rows, "dep", rules.dep_recodes)
    rows = rows.where(differs("longitude", rules.no_coordinate))
    return rows.withColumns(
        {
            "reg_name": map_values("reg", rules.region_names, default="null"),
            "longitude": decimal_comma("longitude"),
        }
    )


def clean_establishments(establishments: DataFrame, rules: ProfileRules) -> DataFrame:
    """Firms per area in the coarse size classes, and in all of them together."""
    rows = _clean_codes(establishments, rules)
    rows = cleaning.sum_columns(rows, rules.sizes)
    rows = cleaning.sum_columns(rows, {rules.total: list(rules.sizes)})
    return rows.select("code", "area", "dep", "reg", *rules.sizes, rules.total)


def build_profile(
    population: DataFrame,
    geography: DataFrame,
    establishments: DataFrame,
    wages: DataFrame,
    rules: ProfileRules,
) -> DataFrame:
    """One row per area name and class, with population, rates, firms and place.

    Duplicate places are settled by the lowest code, department and region.
    """
    firms = clean_regions(establishments, rules)
    people = clean_population(population, firms, rules)
    rates = clean_wages(wages, firms, rules)
    places = clean_geography(geography, rules)
    fused = joins.equi_join(clean_establishments(firms, rules), places, ["area", "dep", "reg"])
    fused = joins.equi_join(rates, fused, ["code", "area", "dep", "reg"])
    full = joins.equi_join(people, fused, ["code", "area", "reg", "dep"])
    order = ["code", "dep", "reg", "latitude", "longitude"]
    return cleaning.keep_first(full, ["area", "class"], order).drop("code")


def collapse_profile(profile: DataFrame, rules: ProfileRules) -> DataFrame:
    """One row per area: the classes' population summed, everything else taken once."""
    firsts = ["reg", "reg_name", "dep", *rules.rates.values(), *rules.sizes, rules.total]
    return stats.collapse(profile, ["area"], ["pop"], firsts, ["class"])
