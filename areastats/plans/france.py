"""Preset for the French town tables of 2014-2017 (INSEE codes, regions as of 2016).

File layouts, the renaming to the names used by `plans.profile`, and the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areastats.operators.cleaning import drop_columns, invert_mapping, rename_columns
from areastats.plans.profile import ProfileRules
from areastats.plans.report import ReportColumns
from areastats.sources import read_features, read_table

# Overseas regions, old region numbers to new ones, region names,
# department recodes of Corsica, and two towns whose codes are missing.
OVERSEAS = [1, 2, 3, 4, 5, 6]
REGION_RECODES = {
    21: 44, 22: 32, 23: 28, 25: 28, 26: 27, 31: 32, 41: 44, 42: 44, 43: 27, 54: 75, 72: 75, 73: 76, 74: 75, 82: 84, 83: 84, 91: 76,
}
REGION_NAMES = {
    11: "Ile-de-France",
    24: "Centre-Val de Loire",
    27: "Bourgogne-Franche-Comté",
    28: "Normandie",
    32: "Hauts-de-France",
    44: "Grand Est",
    52: "Pays de la Loire",
    53: "Bretagne",
    75: "Nouvelle-Aquitaine",
    76: "Occitanie",
    84: "Auvergne-Rhône-Alpes",
    93: "PACA",
    94: "Corse",
}
REGION_NUMBERS = invert_mapping(REGION_NAMES)
CORSICA_DEPS = {"2A": "20", "2B": "96"}
CORSICA_CODES = {"2A": "20", "2B": "20"}
REGION_FIXES = {"L'Oudon": 52, "Culey": 44}
DEP_FIXES = {"L'Oudon": "44", "Culey": "55"}

# Size classes of establishments and wage columns of the source files.
SIZES = {
    "micro": ["E14TS1", "E14TS6"],
    "small": ["E14TS10", "E14TS20"],
    "medium": ["E14TS50", "E14TS100"],
    "large": ["E14TS200", "E14TS500"],
}
RATES = {
    "SNHM14": "rate_total",
    "SNHMC14": "rate_executive",
    "SNHMP14": "rate_middle",
    "SNHME14": "rate_employee",
    "SNHMO14": "rate_worker",
    "SNHMF14": "rate_women",
    "SNHMFC14": "executive_f",
    "SNHMFP14": "middle_f",
    "SNHMFE14": "employee_f",
    "SNHMFO14": "worker_f",
    "SNHMH14": "rate_men",
    "SNHMHC14": "executive_m",
    "SNHMHP14": "middle_m",
    "SNHMHE14": "employee_m",
    "SNHMHO14": "worker_m",
}
AGE_RATES = [
    "SNHM1814", "SNHM2614", "SNHM5014", "SNHMF1814", "SNHMF2614", "SNHMF5014", "SNHMH1814", "SNHMH2614", "SNHMH5014",
]

POPULATION_SCHEMA = "NIVGEO string, CODGEO string, LIBGEO string, MOCO string, AGEQ80_17 int, SEXE int, NB double"
GEOGRAPHY_SCHEMA = (
    "EU_circo string, `code_région` int, `nom_région` string, `chef.lieu_région` string, `numéro_département` string, "
    "`nom_département` string, `préfecture` string, `numéro_circonscription` string, nom_commune string, codes_postaux string, "
    "code_insee string, latitude double, longitude string, `éloignement` string"
)
ESTABLISHMENT_SCHEMA = (
    "CODGEO string, LIBGEO string, REG int, DEP string, E14TST bigint, E14TS0ND bigint, "
    + ", ".join(f"{c} bigint" for parts in SIZES.values() for c in parts)
)
WAGE_SCHEMA = "CODGEO string, LIBGEO string, " + ", ".join(f"{c} double" for c in [*RATES, *AGE_RATES])

RULES = ProfileRules(
    sizes=SIZES,
    rates=RATES,
    region_names=REGION_NAMES,
    excluded_regions=OVERSEAS,
    region_recodes=REGION_RECODES,
    dep_recodes=CORSICA_DEPS,
    code_replacements=CORSICA_CODES,
    region_fixes=[("area", name, reg) for name, reg in REGION_FIXES.items()],
    dep_fixes=[("area", name, dep) for name, dep in DEP_FIXES.items()],
)
_MEN = ["executive_m", "middle_m", "employee_m", "worker_m"]
_WOMEN = ["executive_f", "middle_f", "employee_f", "worker_f"]
COLUMNS = ReportColumns(
    classes={1: "men", 2: "women"},
    total_rate="rate_total",
    category_rates=["rate_executive", "rate_middle", "rate_employee", "rate_worker"],
    class_rates=("rate_men", "rate_women"),
    band_rates=[c for pair in zip(_MEN, _WOMEN) for c in pair],
    box_groups=[_MEN, _WOMEN, [_MEN[0], _WOMEN[0], _MEN[1], _WOMEN[1]], [_MEN[2], _WOMEN[2], _MEN[3], _WOMEN[3]]],
    gap_rates=("executive_m", "worker_f"),
    sizes=list(SIZES),
    large="large",
    rate_limits={"worker_m": 50},
    band_pairs=list(zip(_MEN, _WOMEN)),
)


def read_sources(
    spark: SparkSession, population: str, geography: str, establishments: str, wages: str
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Read the four CSV files and give their columns the names the preparation uses."""
    names = {"CODGEO": "code", "LIBGEO": "area", "DEP": "dep", "REG": "reg"}
    people = rename_columns(
        drop_columns(read_table(spark, population, POPULATION_SCHEMA), ["NIVGEO", "MOCO"]),
        {**names, "AGEQ80_17": "age", "SEXE": "class", "NB": "n"},
    )
    places = read_table(spark, geography, GEOGRAPHY_SCHEMA).select(
        F.col("nom_commune").alias("area"),
        F.col("`numéro_département`").alias("dep"),
        F.col("`code_région`").alias("reg"),
        "latitude",
        "longitude",
    )
    firms = rename_columns(drop_columns(read_table(spark, establishments, ESTABLISHMENT_SCHEMA), ["E14TST", "E14TS0ND"]), names)
    pay = rename_columns(drop_columns(read_table(spark, wages, WAGE_SCHEMA), AGE_RATES), names)
    return people, places, firms, pay


def read_outlines(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Department outlines with their code as `dep`."""
    return read_features(spark, path, ["code"], lines).withColumnRenamed("code", "dep")
