import pytest

from cairnframe.operators import reference as R
from cairnframe.plans import spec
from cairnframe.plans.suggest import suggestions


def test_places(spark):
    places = spark.createDataFrame([(1, "India", None, None), (2, "Sikkim", 1, "Sikim; Denjong"), (3, "Assam", 1, "")], "code bigint, name string, parent bigint, aliases string")
    names = spark.createDataFrame([("sikkim",), ("Denjong",), ("Asam",), ("Nowhere",), (None,)], "place string")
    got = {r.place: (r.code, r.similarity) for r in R.match_places(names, places).collect()}
    assert got["sikkim"] == (2, 1.0) and got["Denjong"] == (2, 1.0) and got["Asam"][0] == 3 and "Nowhere" not in got
    assert {r.name: r.parent_name for r in R.place_parents(places).collect()} == {"India": None, "Sikkim": "India", "Assam": "India"}


def test_vocabulary(spark):
    v = spark.createDataFrame([("tea", "herbal tea"), ("dye", None)], "term string, alias string")
    rows = spark.createDataFrame([("Herbal-Tea",), ("a strong dye",), ("rope",), (None,)], "value string")
    assert sorted((r.value or "", r.term or "") for r in R.match_vocabulary(rows, v).collect()) == [("", ""), ("Herbal-Tea", "tea"), ("a strong dye", "dye"), ("rope", "rope")]
    assert R.match_vocabulary(rows, v, strict=True).count() == 2


def test_registry_answers(spark):
    values = spark.createDataFrame([(1, "Rosa", "extracted", 0.8, 10.0), (2, "x", "default", 0.0, 10.0)], "id bigint, value string, origin string, confidence double, value_num double")
    answers = spark.createDataFrame([(1, "rosa "), (2, "Poa"), (3, "New")], "id bigint, answer string")
    got = {r.id: (r.value, r.origin, r.confidence) for r in R.confirmed(values, answers, ["id"]).collect()}
    assert got[1][1] == "extracted" and got[1][2] == pytest.approx(0.95) and got[2] == ("Poa", "registry", 0.8) and got[3] == ("New", "registry", 0.8)
    checks = spark.createDataFrame([(1, 12.0), (2, 500.0)], "id bigint, answer double")
    assert {r.id: r.confidence for r in R.cross_checked(values, checks, ["id"], 5).collect()} == pytest.approx({1: 0.9, 2: 0.0})
    rates = spark.createDataFrame([("USD", "2024-01-01", 0.9)], "currency string, date string, rate double")
    amounts = spark.createDataFrame([("USD", "2024-01-01"), ("USD", "2024-01-02")], "currency string, on_date string")
    assert {r.on_date: r.rate for r in R.dated_rates(amounts, rates).collect()} == {"2024-01-01": 0.9, "2024-01-02": None}


def test_suggestions():
    s = spec.from_dict({"entities": {"plant": ["name", {"name": "height_m", "type": "number"}, {"name": "height_ft", "type": "number"}, "region_count", {"name": "flowering", "type": "month"}, "season"], "region": ["name"]}, "relations": ["plant grows_in region"]})
    got = {x.field: x.formula for x in suggestions(s, {"plant.name": 1, "plant.height_m": 1, "plant.flowering": 1, "region.name": 1})}
    assert got == {"height_ft": "convert(height_m, 'm', 'ft')", "region_count": "count(region via grows_in)", "season": "season_of(flowering, 'northern')"}
