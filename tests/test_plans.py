import json
import sqlite3

import pytest

from cairnframe.plans import capture, connectors, sqlgate, suggest
from cairnframe.plans.spec import from_dict


def test_connectors_ask_once_and_read_in_batches(spark):
    c = connectors.Connector("names", "alias", ("plant", "place"), ("canonical_name",), lambda t: json.loads(t)["names"], daily_cap=2, licence="CC-BY")
    rows = [(1, "plant", "Salix"), (2, "plant", "salix "), (3, "place", "Vale"), (4, "book", "Vale"), (5, "plant", None), (6, "plant", "Rosa"), (7, "plant", "Acer")]
    records = spark.createDataFrame(rows, "entity_id bigint, entity_type string, canonical_name string")
    (got, kinds), = connectors.wanted([c], connectors.Use(("names",), {"names": ("plant",)}))
    cache = spark.createDataFrame([("names\u001fsalix", '{"names": ["Willow", "", "Sallow"]}'), ("names\u001frosa", "broken")], "key string, answer string")
    assert kinds == ("plant",) and [r.canonical_name for r in connectors.requests(records, got, kinds, cache).collect()] == ["Acer"]
    assert connectors.requests(records, got, kinds, cache.limit(0), used_today=1).count() == 1 and connectors.requests(records, got, kinds, cache, 2).count() == 0
    found = connectors.answers(records, got, kinds, cache)
    assert {(r.entity_id, r.value) for r in found.collect()} == {(1, "Willow"), (1, "Sallow"), (2, "Willow"), (2, "Sallow")}
    assert connectors.attribution([c], found) == ["names: CC-BY"] and connectors.wanted([c], connectors.Use(())) == []
    places = spark.createDataFrame([("vale", 1.0, 2.0)], "name string, latitude double, longitude double")
    here = spark.createDataFrame([(1, "Vale", None, None), (2, "Vale", 8.0, 9.0), (3, None, None, 9.0)], "id bigint, place string, latitude double, longitude double")
    assert {(r.id, r.latitude, r.longitude) for r in connectors.located(here, places).collect()} == {(1, 1.0, 2.0), (2, 8.0, 9.0), (3, None, None)}


def test_structures_questions_and_words(tmp_path):
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("create table maker (id integer primary key, name text not null)")
    db.execute("create table tool (code text primary key, weight real, made date, maker_id integer references maker(id))")
    db.commit()
    db.close()
    entities, relations = capture.imported(str(tmp_path / "x.db"))
    assert [(e.name, e.identity) for e in entities] == [("maker", ["id"]), ("tool", ["code"])] and relations == [("tool", "has_maker", "maker")]
    assert [f.type for f in entities[1].fields] == ["text", "number", "date", "number"] and entities[0].field("name").required
    asked = capture.questions(entities)
    assert [q["ask"] for q in asked] == ["unit"]
    assert capture.with_answers(entities, [(asked[0], " KG "), (asked[0], "")])[1].field("weight").unit == "kg"
    drafted = capture.from_words("a list of alpine plants with name, height (m) and flowering month")
    assert drafted.name == "alpine_plant" and [(f.name, f.type, f.unit) for f in drafted.fields] == [("name", "text", None), ("height", "number", "m"), ("flowering_month", "month", None)]
    (tmp_path / "s.sql").write_text("create table t (a int primary key)")
    assert capture.imported(str(tmp_path / "s.sql"))[0][0].name == "t"
    with pytest.raises(ValueError):
        capture.imported("x.foo")


def test_suggestions_are_decided_once(spark):
    new = [suggest.Suggestion("plant", "height_ft", "convert(height_m, 'm', 'ft')", True), suggest.Suggestion("plant", "season", "season_of(month)", False)]
    first = suggest.stored(spark, new)
    done = suggest.decided(first, "plant", "season", "rejected")
    again = suggest.stored(spark, new, done)
    assert {(r.field, r.status) for r in again.collect()} == {("height_ft", "pending"), ("season", "rejected")}
    assert [s.field for s in suggest.applied(new, "auto_safe")[0]] == ["height_ft"] and suggest.applied(new, "off") == ([], []) and len(suggest.applied(new, "suggest")[1]) == 2
    text = "# mine\nproject: x\nderived:\n  plant:  # all of them\n    a: \"1\"\nentities:\n  plant: [name]\n"
    import yaml

    grown = suggest.with_derivation(text, "plant", "b", 'concat("x", name)')
    assert yaml.safe_load(grown)["derived"]["plant"] == {"a": "1", "b": 'concat("x", name)'} and "# mine" in grown and "# all of them" in grown
    assert yaml.safe_load(suggest.with_derivation(text, "book", "c", "2"))["derived"]["book"] == {"c": "2"}
    assert from_dict(yaml.safe_load(suggest.with_derivation("project: y\n", "book", "c", "2"))).derived["book"][0].formula == "2"


def test_results_for_reading(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "n bigint, t string")
    assert sqlgate.shown(df).splitlines()[2].startswith("1  a,b") and sqlgate.shown(df, "csv") == 'n,t\n1,"a,b"\n2,' and json.loads(sqlgate.shown(df, "json").splitlines()[1]) == {"n": 2, "t": None}
    with pytest.raises(ValueError):
        sqlgate.shown(df, "odd")
