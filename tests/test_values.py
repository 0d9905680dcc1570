import sqlite3

import pytest
from pyspark.sql import functions as F

from cairnframe.operators import conflict, evidence, normal_forms, relations, resolution
from cairnframe.operators import values as V
from cairnframe.operators.normal_forms import Table, check
from cairnframe.plans import build, capture, export, review, spec, sqlgate

CELL = "entity_id bigint, name string, value string, value_num double, value_max double, tier int, domain string, fetched_at string, seq bigint"


def test_conflict_rules(spark):
    rows = spark.createDataFrame([(1, "h", "3000-4500", 3000.0, 4500.0, 2, "b.test", "2024", 1), (1, "h", "3010", 3010.0, None, 1, "a.test", "2023", 2), (1, "h", "900", 900.0, None, 3, "c.test", "2025", 3), (1, "h", "900", 900.0, None, 3, "c.test", "2025", 4), (2, "t", "X", None, None, 3, "c.test", None, 5), (2, "t", " x ", None, None, 3, None, None, 6)], CELL)
    cell = ["entity_id", "name"]
    kept = lambda rule, **k: {(r.entity_id, r.value) for r in conflict.resolved(rows, cell, rule, **k).collect() if r.status == "accepted"}
    assert kept("majority") == {(1, "3010"), (2, "X")}
    assert kept("newest") == {(1, "900"), (2, "X")}
    assert kept("trusted_first", trusted=["c.test"]) == {(1, "900"), (2, "X")}
    assert kept("majority", authority=["c.test"]) == {(1, "900"), (2, "X")}
    assert kept("keep_all_and_flag") == {(1, "3010"), (1, "900"), (2, "X")}
    score = {r.value: r.confidence for r in conflict.resolved(rows, cell, "majority").collect()}
    assert score["3010"] == pytest.approx(0.75) and score["900"] == 0.0 and score["X"] == 0.4
    assert conflict.resolved(rows.limit(0), cell).count() == 0


def test_proof(spark):
    df = spark.createDataFrame([("3,000 m", "It grows at 3000  m – rarely", "So: it grows at 3000 m - rarely."), ("x", None, "x"), ("5", "about 6", "about 6"), ("a", "b", "c"), (None, "q", "q")], "v string, q string, p string")
    got = [r.reason for r in df.select(evidence.proof(F.col("v"), F.col("q"), F.col("p")).alias("r")).select("r.reason").collect()]
    assert got == [evidence.VERIFIED, evidence.NO_QUOTE, evidence.NOT_IN_QUOTE, evidence.NOT_ON_PAGE, evidence.NOT_IN_QUOTE]
    wide = spark.createDataFrame([("１，２００ｍ", "It is 1,200m high", "it is 1,200m high."), ("ﬁne", "so fine", "So ﬁne a day")], "v string, q string, p string")
    assert all(r[0] for r in wide.select(evidence.proof(F.col("v"), F.col("q"), F.col("p"))["kept"]).collect())
    long_ = "x" * 900 + " 41 " + "y" * 900
    t = spark.createDataFrame([("By Dr. Rao in May. Then", "Dr. Rao"), (long_, "41"), ("It is 3.5 km away. Far 7", "3.5 km"), ("a\nIn 1,200 of 30 m\nb", "30 or 1,200"), (None, "x"), ("x", None), ("x", " "), ("x", "z")], "t string, v string")
    got = [r[0] for r in t.select(evidence.evidence_sentence(F.col("t"), F.col("v"))).collect()]
    assert got[0] == "By Dr. Rao in May." and "41" in got[1] and len(got[1]) <= 400 and got[2] == "It is 3.5 km away." and got[3] == "in 1,200 of 30 m" and set(got[4:]) == {""}
    s = df.select(evidence.evidence_sentence(F.lit("One. Two 7 here! Three"), F.lit("7")).alias("s")).first().s
    assert s == "Two 7 here!"
    t = spark.createDataFrame([("notwebmd.com",), ("a.webmd.com",), ("x.gov.in",)], "d string")
    assert [r[0] for r in t.select(evidence.trust_tier(F.col("d"), {"webmd.com": 2})).collect()] == [3, 2, 1]


def test_normal_forms(spark):
    zones = spark.createDataFrame([(i, f"p{i}", f"z{i % 4}", f"zone {i % 4}") for i in range(12)], "place_id bigint, name string, zone_code string, zone_name string")
    assert any("determined by" in p for p in check([Table("place", zones, ["place_id"])], "3NF"))
    assert check([Table("place", zones.drop("zone_name"), ["place_id"])], "3NF") == []
    j = spark.createDataFrame([(1, 1, "f"), (1, 2, "f"), (2, 1, "g")], "plant_id bigint, region_id bigint, family string")
    assert any("alone" in p for p in check([Table("plant_region", j, ["plant_id", "region_id"], "junction")], "2NF"))
    assert any("more than one value" in p for p in check([Table("t", spark.createDataFrame([("a; b",)], "x string"), ["x"])], "1NF"))
    full = spark.createDataFrame([(1, a, b) for a in "xy" for b in "pq"], "plant bigint, use string, region string")
    assert any("independent" in p for p in normal_forms.multivalued(Table("f", full, ["plant", "use", "region"])))
    assert normal_forms.spurious_rows(spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 1, 1)], "a int, b int, c int"), ["a", "b", "c"]) == 1


def test_resolution(spark):
    rows = spark.createDataFrame([("plant", "Saussurea obvallata", 1), ("plant", "saussurea  OBVALLATA", 2), ("plant", "Saussurea obvalata", 3), ("plant", "Brahma Kamal", 4), ("plant", None, 5), ("plant", "Rosa 12", 6), ("plant", "Rosa 13", 7)], "entity_type string, identity string, seq bigint")
    aliases = spark.createDataFrame([("plant", "brahma kamal", "Saussurea obvallata")], "entity_type string, alias string, identity string")
    got = {r.seq: r for r in resolution.resolve(rows, aliases).collect()}
    assert len({got[i].entity_id for i in (1, 2, 3, 4)}) == 1 and got[3].canonical_name == "Saussurea obvallata"
    assert got[5].entity_id is None and got[6].entity_id != got[7].entity_id


def test_long_and_wide(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, 3.5)], "id bigint, t string, x double")
    long = V.to_long(df, "id", ["t", "x"], {"value_max": F.lit(None).cast("double"), "confidence": F.lit(0.5), "tier": F.lit(1), "seq": F.lit(1)})
    assert long.count() == 3
    wide = {r.id: r for r in V.to_wide(long, ["t", "x"], "id").collect()}
    assert wide[1].t == "a" and wide[2].t is None and wide[2].x == "3.5"
    assert V.case_style("first_name", "camelCase") == "firstName"
    assert [r.id for r in V.sort_by(df, ["t"]).collect()] == [1, 2]


def test_relations(spark):
    edges = spark.createDataFrame([(1, "r", 9), (2, "r", 9), (2, "r", 9)], "from_id bigint, relation string, to_id bigint")
    e = spark.createDataFrame([(9,), (1,), (5,)], "entity_id bigint")
    assert {r.entity_id: r.related for r in relations.related_count(e, edges, "r").collect()} == {9: 2, 1: 1, 5: 0}
    rows = spark.createDataFrame([("u", "2024", 1), ("u", "2025", 2), ("u", "2025", 3)], "url string, at string, id bigint")
    assert relations.latest(rows, ["url"], "at", "id").first().id == 3


SPEC = {
    "project": "plants", "entities": {"plant": {"identity": "name", "fields": ["name", {"name": "altitude_m", "type": "range", "unit": "m", "sanity": [0, 9000]}, {"name": "month", "type": "month"}, {"name": "use", "multiple": True}]}},
    "derived": {"plant": {"zone": {"method": "lookup", "inputs": ["altitude_m"], "cutoffs": [1500, 3000], "labels": ["low", "mid", "high"]}}}, "conflict": "majority",
}


def test_build(spark, tmp_path):
    s = spec.from_dict(SPEC)
    assert spec.validate(s) == []
    rows = [("plant", "Rosa alba", "name", "Rosa alba", 1, "a.test", "2024", "x", 1), ("plant", "Rosa alba", "altitude_m", "9,842 ft", 1, "a.test", "2024", "x", 2), ("plant", "rosa ALBA", "altitude_m", "3,000 m", 2, "b.test", "2024", "x", 3), ("plant", "Rosa alba", "altitude_m", "99999 m", 3, "c.test", "2024", "x", 4), ("plant", "Rosa alba", "use", "tea", 1, "a.test", "2024", "x", 5), ("plant", "Rosa alba", "use", "oil", 1, "b.test", "2024", "x", 6), ("plant", "Rosa alba", "month", "in June", 1, "a.test", "2024", "x", 7)]
    c = spark.createDataFrame(rows, "entity_type string, identity string, name string, raw_value string, tier int, domain string, fetched_at string, origin string, seq bigint")
    d = build.build(c, s)
    assert d.problems == [] and d.rejects.count() == 1
    t = {x.name: x for x in d.tables}
    row = t["plant"].df.first()
    assert row["altitude_m"] == "3000" and row["month"] == 6 and row["zone"] == "high"
    assert sorted(r["use"] for r in t["plant_use"].df.collect()) == ["oil", "tea"]
    export.write_all([x for x in d.tables if x.name == "plant"], str(tmp_path / "out"), ["csv", "sqlite", "xlsx", "sql", "json", "parquet"])
    with sqlite3.connect(tmp_path / "out" / "dataset.db") as db:
        assert db.execute("select altitude_m from plant").fetchone() == ("3000",)
    export.pack(str(tmp_path / "out"), str(tmp_path / "p.zip"))
    assert "metadata.json" in export.read_pack(str(tmp_path / "p.zip"))["files"]
    q = review.queue(d.values, d.rejects)
    assert {r.kind for r in q.collect()} >= {"sanity"}
    first = d.values.where("name = 'use'").first()
    decisions = spark.createDataFrame([(first.entity_id, "use", first.value, "reject")], "entity_id bigint, name string, value string, decision string")
    assert review.decided(d.values, decisions).where("name = 'use' and status = 'superseded'").count() == 1


def test_spec_problems():
    bad = spec.from_dict({"entities": {"a": {"identity": "zz", "fields": [{"name": "x", "type": "nmber"}]}}, "relations": ["a likes b"], "derived": {"a": {"p": "q + 1", "q": "p + 1"}}, "conflict": "best"})
    text = " ".join(p.message for p in spec.validate(bad))
    for part in ("did you mean number", "is no field", "unknown entity 'b'", "need one another", "unknown rule"):
        assert part in text


def test_sql_gate(spark):
    df = spark.range(3)
    assert sqlgate.query(spark, "with t as (select id from v) select count(*) as n from t", {"v": df}).first().n == 3
    for bad in ("drop table v", "insert into v values (1)", "select 1; drop table v", "with x as (select 1) insert into v select * from x", ""):
        with pytest.raises(Exception):
            sqlgate.query(spark, bad, {"v": df})


def test_capture(spark):
    df = spark.createDataFrame([("a", "3 m", "2020-01-02", "yes", "June"), ("b", "4", "2021-03-04", "no", "May")], ["Plant name", "Height (m)", "Seen", "Rare", "Month"])
    e = capture.from_rows(df, "plant")
    assert [f.type for f in e.fields] == ["text", "number", "date", "bool", "month"] and e.identity == ["plant_name"] and e.fields[1].unit == "m"
    d = capture.from_ddl("create table book (isbn text primary key, price numeric(10,2) not null, added date);")[0]
    assert d.identity == ["isbn"] and [f.type for f in d.fields] == ["text", "number", "date"]
    j = capture.from_json_schema({"title": "b", "required": ["id"], "properties": {"id": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}, "n": {"type": "integer"}}})
    assert j.identity == ["id"] and j.fields[1].multiple and j.fields[2].type == "number"
