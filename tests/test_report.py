import pytest
from conftest import rows

from areastats.operators.models import ModelSpec
from areastats.plans import france, report
from areastats.plans.profile import build_profile, clean_population, clean_regions, collapse_profile

WAGE_COLUMNS = [*france.RATES, *france.AGE_RATES]
POPULATION = """NIVGEO,CODGEO,LIBGEO,MOCO,AGEQ80_17,SEXE,NB
COM,01001,Alpha,11,0,1,50
COM,01001,Alpha,11,15,1,10
COM,01001,Alpha,12,60,1,20
COM,01001,Alpha,11,20,2,40
COM,01001,Alpha,11,65,2,99
COM,01001,Alpha,11,25,2,0
COM,2A004,Beta,11,30,1,7
COM,2A004,Beta,11,30,2,8
COM,97101,Far,11,30,1,5
COM,76618,Culey,11,30,1,3
"""
GEOGRAPHY = """EU_circo,code_région,nom_région,chef.lieu_région,numéro_département,nom_département,préfecture,numéro_circonscription,nom_commune,codes_postaux,code_insee,latitude,longitude,éloignement
x,82,Old,L,01,Ain,B,1,Alpha,01000,1001,46.15,"4,926114",
x,82,Old,L,01,Ain,B,2,Alpha,01001,1001,46.15,"4,926114",
x,94,Corse,A,2A,Corse,A,1,Beta,20000,2A004,41.9,"8,7",
x,82,Old,L,01,Ain,B,1,Gamma,01002,1002,46.2,-,
x,1,Far,F,971,Far,F,1,Far,97100,97101,16.0,"-61,5",
"""
ESTABLISHMENTS = """CODGEO,LIBGEO,REG,DEP,E14TST,E14TS0ND,E14TS1,E14TS6,E14TS10,E14TS20,E14TS50,E14TS100,E14TS200,E14TS500
01001,Alpha,82,01,100,60,20,10,4,3,1,1,1,0
2A004,Beta,94,2A,30,20,5,3,1,1,0,0,0,0
01002,Gamma,82,01,3,2,1,0,0,0,0,0,0,0
97101,Far,1,971,9,5,4,0,0,0,0,0,0,0
"""


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("towns")
    wages = ["CODGEO,LIBGEO," + ",".join(WAGE_COLUMNS)]
    for code, name, base in (("01001", "Alpha", 10), ("2A004", "Beta", 12), ("01002", "Gamma", 11), ("97101", "Far", 9)):
        wages.append(f"{code},{name}," + ",".join(str(base + i / 10) for i in range(len(WAGE_COLUMNS))))
    files = {"population": POPULATION, "geography": GEOGRAPHY, "establishments": ESTABLISHMENTS, "wages": "\n".join(wages)}
    paths = {}
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
        paths[name] = str(folder / f"{name}.csv")
    return france.read_sources(spark, **paths)


def test_population_is_cleaned_and_rolled_up(sources):
    people, _, firms, _ = sources
    got = clean_population(people, clean_regions(firms, france.RULES), france.RULES)
    assert rows(got.select("area", "class", "code", "reg", "dep", "pop")) == [
        ("Alpha", 1, "01001", 84, "01", 30.0),
        ("Alpha", 2, "01001", 84, "01", 40.0),
        ("Beta", 1, "20004", 94, "20", 7.0),
        ("Beta", 2, "20004", 94, "20", 8.0),
        ("Culey", 1, "76618", 44, "55", 3.0),  # no establishment: codes are stated by hand
    ]


def test_profile_of_towns(sources):
    full = build_profile(*sources, france.RULES)
    got = rows(full.select("area", "class", "reg_name", "dep", "pop", "rate_total", "micro", "large", "firms", "longitude"))
    assert got == [
        ("Alpha", 1, "Auvergne-Rhône-Alpes", "01", 30.0, 10.0, 30, 1, 40, 4.926114),
        ("Alpha", 2, "Auvergne-Rhône-Alpes", "01", 40.0, 10.0, 30, 1, 40, 4.926114),
        ("Beta", 1, "Corse", "20", 7.0, 12.0, 8, 0, 10, 8.7),
        ("Beta", 2, "Corse", "20", 8.0, 12.0, 8, 0, 10, 8.7),
    ]
    simple = collapse_profile(full, france.RULES)
    assert rows(simple.select("area", "pop", "dep", "worker_f", "firms")) == [
        ("Alpha", 70.0, "01", pytest.approx(10.9), 40),
        ("Beta", 15.0, "20", pytest.approx(12.9), 10),
    ]


# -- the report on the test tables --------------------------------------------


@pytest.fixture(scope="module")
def prepared(spark, data):
    from catalog.profile import RULES, sources

    return report.prepare(*sources(spark, data), RULES)


COLUMNS = report.ReportColumns(
    classes={1: "a", 2: "b"},
    total_rate="rate_all",
    category_rates=["rate_f", "rate_o"],
    class_rates=("rate_f", "rate_o"),
    band_rates=["rate_f", "rate_o"],
    box_groups=[["rate_f", "rate_o"]],
    gap_rates=("rate_f", "rate_o"),
    sizes=["micro", "small", "medium", "large"],
    large="large",
    rate_limits={"rate_f": 1900},
    band_pairs=[("rate_f", "rate_o")],
)


def test_descriptive_sections(prepared):
    n = prepared.simple.count()
    assert n > 500 and prepared.profile.count() > n
    layers = report.map_section(prepared, COLUMNS)["size_layers"]
    assert {r[0] for r in layers.select("layer").distinct().collect()} == set(COLUMNS.sizes)
    people = report.population_section(prepared, COLUMNS)
    totals = {r["version"]: r for r in people["population_totals"].collect()}
    for r in totals.values():
        assert r["total"] == r["total_a"] + r["total_b"]
    assert totals["source"]["total"] > totals["profile"]["total"]
    shares = people["class_share_source"].collect()
    assert all(r["share_a"] + r["share_b"] == pytest.approx(100) for r in shares)
    firms = report.firms_section(prepared, COLUMNS)
    assert sum(r["share_pct"] for r in firms["large_firms"].collect()) == pytest.approx(100)
    assert firms["firms_population_correlation"].first()["correlation"] > 0.5
    for name, table in report.wages_section(prepared, COLUMNS).items():
        assert table.count() > 0, name


def test_every_pair_of_bands_is_compared(spark):
    banded = spark.createDataFrame(
        [("p", "Q1", None, "Q2", "Q2"), ("q", "Q1", "Q3", None, "Q4"), (None, None, "Q2", None, None)],
        "area string, a_band string, b_band string, c_band string, d_band string",
    )
    got = report.unmatched_bands(banded, [("a", "b"), ("c", "d")], ["area"])
    assert sorted(tuple(r) for r in got.fillna("-").collect()) == [
        ("a/b", "-", "b", "Q2", "right_only"),
        ("a/b", "p", "a", "Q1", "left_only"),
        ("c/d", "q", "d", "Q4", "right_only"),
    ]


def test_band_section(spark, prepared, tmp_path):
    features = prepared.simple.select("dep").distinct().selectExpr("dep", "'[]' AS coordinates")
    got = report.band_section(prepared, COLUMNS, features, k=3, n_init=2)
    deps = got["department_profile"].count()
    assert got["clusters"].count() == got["map_layer"].count() == deps
    assert sum(r["n"] for r in got["cluster_sizes"].collect()) == deps
    curve = [r["distortion"] for r in got["elbow"].orderBy("k").collect()]
    assert len(curve) == 5 and curve[0] > curve[-1]
    few = {k: got[k] for k in ("quartiles", "clusters")}
    report.write_report(few, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "clusters")).count() == deps
    for name, table in got.items():
        assert table.columns, name


def test_model_section(prepared):
    tree = ModelSpec("tree", "tree", {"max_depth": 3})
    got = report.model_section(prepared, COLUMNS, [ModelSpec("linear", "linear"), tree], [ModelSpec("ridge", "ridge"), tree])
    board = got["leader_board"].collect()
    assert {(r["variant"], r["model"]) for r in board} == {
        ("numeric", "linear"), ("numeric", "tree"), ("one_hot", "ridge"), ("one_hot", "tree"),
    }
    top = got["coefficients_numeric_linear"].collect()
    assert [r["magnitude"] for r in top] == sorted((r["magnitude"] for r in top), reverse=True)
    assert got["predictions"].count() == 4 * got["predictions"].where("variant = 'numeric' AND model = 'tree'").count()
