import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnframe.functions.latin import latin, name_key
from cairnframe.operators import extraction as X
from cairnframe.operators import normal_forms
from cairnframe.operators.conflict import disputed_by_trusted
from cairnframe.operators.derive import Derivation, code_failures, derived_rows
from cairnframe.plans import build, report, review
from cairnframe.plans.spec import from_dict
from cairnframe.sources import records

SPEC = from_dict(
    {
        "project": "plants", "tiers": {"flora.test": 1}, "min_confidence": 0.1, "conflict": "majority", "authority": {"height": ["board.test"]},
        "entities": {
            "plant": {"identity": "name", "label": "shown_as", "fields": ["name", "shown_as", {"name": "height", "type": "number", "unit": "m", "extract": r"regex:\d+ m\b"}, {"name": "common_name", "multiple": True}, {"name": "rating", "extract": "p.rating@class"}, {"name": "family", "required": True}, {"name": "status", "default": "wild"}]},
            "region": {"identity": "region", "fields": [{"name": "region", "vocabulary": "places"}]},
        },
        "relations": ["plant grows_in region"],
    }
)
PAGES = "page_id bigint, url string, domain string, source_id string, fetched_at string, tier int, title string, headings string, text string, lang string, content_hash string, relevance double"


@pytest.fixture(scope="module")
def pages(spark):
    text = "Salix nova is a shrub of North Vale. It reaches 12 m in old age. It is no. 4 of its family, Salicaceae."
    rows = [
        (1, "https://a.flora.test/1", "a.flora.test", None, "2024", 3, "Salix nova (Grey Willow) | Flora", "Salix nova (Grey Willow) | Habitat", text, "en-GB", "h1", 2.0),
        (2, "https://board.test/2", "board.test", None, "2025", None, "Salix nova - Board", None, "The board measured 14 m of Salix nova.", None, "h2", 0.0),
        (3, "file.csv#1", "file.csv", "file.csv", "2023", 2, None, None, None, None, None, 1.0),
    ]
    return spark.createDataFrame(rows, PAGES)


@pytest.fixture(scope="module")
def fields(spark):
    rows = [(1, "family", "Salicaceae"), (1, "rating", "four"), (1, "common_name", "Salix nova"), (1, "common_name", "ग्रे"), (2, "family", "Salicaceae"), (3, "name", "Salix nova"), (3, "height", "13 m")]
    return spark.createDataFrame(rows, "page_id bigint, name string, value string")


def test_rules_and_proof(pages, fields):
    judged = X.page_tiers(pages, SPEC)
    assert {r.page_id: r.tier for r in judged.collect()} == {1: 1, 2: 3, 3: 2}
    found = X.by_rules(judged, fields, SPEC.primary)
    got = {(r.page_id, r.field, r.raw_value): r for r in found.collect()}
    # Page 3 lacks the required family.
    assert {p for p, _, _ in got} == {1, 2}
    assert got[1, "height", "12 m"].quote == "It reaches 12 m in old age."
    assert got[1, "rating", "four"].quote == "[p.rating@class] four" and got[1, "rating", "four"].by_selector
    assert {v for p, f, v in got if f == "common_name"} == {"Salix nova", "ग्रे"}
    assert {r.identity for r in got.values()} == {"Salix nova (Grey Willow)", "Salix nova"}
    kept, rejected = X.verified(found, pages)
    assert ("common_name", "ग्रे") in {(r.field, r.raw_value) for r in rejected.collect()}
    assert {(r.page_id, r.field) for r in kept.collect()} >= {(1, "height"), (1, "rating"), (1, "family"), (2, "height")}
    assert report.rejections(rejected).count() >= 1
    assert X.by_rules(judged.limit(0), fields, SPEC.primary).count() == 0
    assert [r.page_id for r in X.relevant(pages).orderBy("page_id").collect()] == [1, 3]
    assert {r.page_id for r in X.without_refused_sources(pages, ["file.csv"], ["Board.test"]).collect()} == {1}


def test_vocabulary_and_answers(spark, pages, fields):
    vocabulary = spark.createDataFrame([("places", "Northern Vale", "North Vale")], "vocabulary string, term string, alias string")
    places = spark.createDataFrame([("Old Mill", "The Mill; Mill End")], "name string, aliases string")
    terms = X.vocabulary_terms(vocabulary, places)
    assert {(r.term, r.alias) for r in terms.collect()} == {("Northern Vale", "North Vale"), ("Northern Vale", "Northern Vale"), ("Old Mill", "Old Mill"), ("Old Mill", "The Mill"), ("Old Mill", "Mill End")}
    answer = "Sure:\n```json\n" + json.dumps({"records": [{"type": "plant", "fields": {"name": {"value": "Salix nova", "quote": "x"}, "family": {"value": "Made up", "quote": "not there at all"}, "height": {"value": "14 m", "quote": "The board measured 14 m", "unit": "m"}, "odd": 1}}, {"type": "ghost"}], "relations": [{"from": "plant:Salix nova", "name": "grows_in", "to": "region:Vale"}, {"from": "bad"}]}) + "\n```"
    answers = X.model_answers(pages, lambda texts: pd.Series([answer if "board" in t else None for t in texts]))
    assert {r.page_id for r in answers.where("answer is not null").collect()} == {2}
    got = X.extract(pages, fields, SPEC, terms, answers)
    kept = {(r.route, r.field, r.raw_value) for r in got.candidates.collect()}
    assert ("vocabulary", "region", "Northern Vale") in kept and ("ai", "height", "14 m") in kept and ("ai", "family", "Made up") not in kept
    assert {(r.relation, r.to_identity) for r in got.relations.collect()} == {("grows_in", "Northern Vale"), ("grows_in", "Vale")}
    assert {(r.alias, r.source) for r in got.aliases.where("page_id = 1").collect()} == {("Salix nova", "page"), ("Grey Willow", "page"), ("ग्रे", "field")}
    assert X.json_in("no") is None and X.json_in("{bad}") is None and "plant" in X.schema_prompt(SPEC)
    blocks = spark.createDataFrame([(1, '{"name": ["Sallow", "Grey Willow"], "alternateName": "Osier"}'), (2, "broken")], "page_id bigint, data string")
    assert {r.alias for r in X.other_names(pages, fields, SPEC.primary, blocks).where("source = 'json-ld'").collect()} == {"Sallow", "Osier"}


def test_from_pages_to_cells(spark, pages, fields):
    got = X.extract(pages, fields, SPEC)
    candidates = got.candidates.withColumnRenamed("field", "name").withColumn("seq", F.xxhash64("page_id", "name", "raw_value")).withColumn("identity", F.lit("Salix nova"))
    d = build.build(candidates, SPEC, fuzzy=False)
    cells = {r.name: r for r in d.values.where("status = 'accepted' and entity_type = 'plant'").collect()}
    # The board is the authority on heights; a default is no evidence.
    assert cells["height"].value == "14" and cells["status"].origin == "default" and cells["status"].confidence == 0.0
    assert d.values.where("name = 'height' and status = 'superseded'").count() == 1
    table = next(t for t in d.tables if t.name == "plant").df.first()
    assert table["height"] == 14.0 and table["status"] == "wild"
    told = normal_forms.provenance(d.values.withColumns({"quote": F.lit("q"), "page_id": F.lit(1).cast("bigint")}), pages)
    assert told.where("url is not null").count() == told.count() > 0


def test_labels_names_and_identifiers(spark):
    entities = spark.createDataFrame([(1, "plant", "Salix nova"), (2, "plant", "Ålpin rose")], "entity_id bigint, entity_type string, canonical_name string")
    values = spark.createDataFrame([(1, "plant", "shown_as", "Grey Willow", 0.9, 0, "accepted"), (1, "plant", "shown_as", "Willow", 0.4, 1, "accepted")], "entity_id bigint, entity_type string, name string, value string, confidence double, group bigint, status string")
    named, former = build.labelled(entities, values, SPEC)
    assert {r.canonical_name for r in named.collect()} == {"Grey Willow", "Ålpin rose"} and [r.alias for r in former.collect()] == ["Salix nova"]
    aliases = former.union(spark.createDataFrame([(2, "Alpenrose")], "entity_id bigint, alias string"))
    registry = spark.createDataFrame([("SALIX NOVA", "gbif", "77"), ("grey willow ", "gbif", "77"), ("nobody", "x", "1")], "name string, authority string, identifier string")
    assert [tuple(r) for r in normal_forms.identifiers(registry, named, aliases).collect()] == [(1, "gbif", "77")]
    found = review.find_entity(named, aliases, "alpin rose").collect()
    assert [(r.entity_id, r.how) for r in found] == [(2, "name")]
    assert [(r.entity_id, r.how) for r in review.find_entity(named, aliases, "alpenrosé").collect()] == [(2, "alias")]
    assert [(r.entity_id, r.how) for r in review.find_entity(named, aliases, "gray willow").collect()] == [(1, "similar")]
    assert latin("Мост Ёж") == "most ezh" and latin("मोन्ब्रिउम") == "monbrium" and latin("தமிழ்") == "thamizh"
    assert spark.range(1).select(name_key(F.lit("Ærø – Łódź"))).first()[0] == "aero lodz"


def test_lineage_of_derived_values(spark):
    values = spark.createDataFrame([(1, 11, "a", 0.9, "extracted", "accepted"), (1, 12, "b", 0.7, "inferred", "accepted"), (2, 13, "a", 0.8, "extracted", "accepted")], "entity_id bigint, value_id bigint, name string, confidence double, origin string, status string")
    wide = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 1.0), (2, 1.0, None, 1.0, 1.0)], "entity_id bigint, a double, b double, total double, fixed double")
    got = {(r.entity_id, r.name): (r.confidence, r.inputs) for r in derived_rows(wide, values, [Derivation("total", "a + coalesce(b, 0)"), Derivation("fixed", "1")], "x").collect()}
    assert got[1, "total"] == (0.45, [11, 12]) and got[2, "total"] == (pytest.approx(0.6), [13]) and got[1, "fixed"] == (0.5, [])
    d = Derivation("c", method="code", inputs=("a", "b"), code=lambda row: 1 / (row["a"] - 1))
    assert [(r.n, "ZeroDivisionError" in r.error) for r in code_failures(wide, d).collect()] == [(2, True)]


def test_notes_junctions_and_decisions(spark):
    groups = spark.createDataFrame([(1, "x", 0, "a", 0, ["o.test"], "accepted"), (1, "x", 1, "b", 1, ["p.test", "q.test"], "superseded"), (2, "x", 0, "a", 0, ["o.test"], "accepted"), (2, "x", 1, "b", 1, ["p.test"], "superseded")], "entity_id bigint, name string, group bigint, value string, tier int, domains array<string>, status string")
    assert [(r.entity_id, r.others) for r in disputed_by_trusted(groups, ["entity_id", "name"]).collect()] == [(1, ["b"])]
    pairs = spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "plant_id bigint, region_id bigint")
    names = spark.createDataFrame([(5, "Vale")], "entity_id bigint, canonical_name string")
    assert {tuple(r) for r in normal_forms.named_junction(pairs, names, "plant_id", "region_id").collect()} == {(1, 5, "Vale"), (2, 6, None)}
    only = spark.createDataFrame([(1,), (5,)], "entity_id bigint")
    assert [tuple(r) for r in normal_forms.junction(pairs, only, only, "plant_id", "region_id").collect()] == [(1, 5)]
    decisions = review.decide(None, 1, "x", "b", "keep", spark)
    decisions = review.decide(decisions, 1, "x", "b", "reject")
    assert [r.decision for r in decisions.collect()] == ["reject"] and review.forget(decisions, 1, "x").count() == 0
    items = spark.createDataFrame([(1, "plant", "x", "b"), (2, "plant", "x", "b")], "entity_id bigint, entity_type string, name string, value string")
    assert [r.entity_id for r in review.open_items(items, decisions).collect()] == [2]
    assert review.more_sources(items, names.withColumn("entity_id", F.lit(2).cast("bigint"))).first().query == '"Vale" x b'
    with pytest.raises(ValueError):
        review.decide(None, 1, "x", "b", "maybe", spark)
    history = spark.createDataFrame([("u", "n", "old", "2023")], "url string, name string, value string, seen_at string")
    assert review.with_history(history, history.withColumns({"value": F.lit("new"), "seen_at": F.lit("2024")})).first().value == "new"


def test_reports(spark):
    values = spark.createDataFrame([("a.test", 3, "review", 0.4, 1, "t", "x"), ("a.test", 3, "review", 0.2, 2, "t", "x"), ("b.test", 1, "accepted", 0.9, 1, "t", "y")], "domain string, tier int, status string, confidence double, entity_id bigint, entity_type string, name string")
    assert [(r.domain, r.n, r.confidence) for r in report.held_back(values).collect()] == [("a.test", 2, 0.4)]
    assert "a.test" in report.held_back_text(values, 0.5)[0] and report.filled_cells(values) == 1
    kept = spark.createDataFrame([("t", "x", f" {i}", str(i)) for i in range(9)] + [("t", "y", "a", "a")], "entity_type string, name string, raw_value string, value string")
    r = report.standardization(kept).collect()
    assert [(x.name, x.changes, len(x.examples)) for x in r] == [("x", 9, 3)]
    pages = spark.createDataFrame([(1, "2024"), (2, "2025")], "page_id bigint, fetched_at string")
    fields = spark.createDataFrame([(1, "h", "1"), (1, "h", "2")], "page_id bigint, name string, value string")
    assert {tuple(x) for x in report.rule_health(pages, fields, ["h", "k"]).collect()} == {("h", 2, 1, "2024"), ("k", 2, 0, None)}


def test_files_services_and_sites(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.csv").write_text("name,height\nSalix,3 m\n")
    (tmp_path / "in" / "deep" / "n.md").write_text("# Note\ntext")
    (tmp_path / "in" / "x.bin").write_bytes(b"\x00")
    pages, fields, skipped = records.read_folder(spark, str(tmp_path / "in"))
    assert pages.count() == 2 and {r.name for r in fields.collect()} >= {"name", "height"} and [r.suffix for r in skipped.collect()] == [".bin"]
    assert records.service_records('{"results": [{"a": 1}, 2]}') == [{"a": 1}] and records.service_records('{"a": 1}') == [{"a": 1}] and records.service_records("[{}]") == [{}]
    assert records.decoded("é".encode("cp1252")) == "é" and records.decoded("é".encode()) == "é" and records.decoded(b'<meta charset="cp1251">\xcf').endswith("П")
    rules, delay = records.robots("User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 2 # s\n\nUser-agent: bad\nDisallow: /")
    assert delay == 2.0 and not records.may_fetch(rules, "/private/x") and records.may_fetch(rules, "/private/open/y") and records.may_fetch(rules, "/z")
    assert not records.may_fetch(records.robots("User-agent: bad\nDisallow: /", "bad")[0], "/z")
    (tmp_path / "my_places.csv").write_text("Name,Kind,Parent\nVale,valley,North\nVale,valley,South\n")
    kind, places = records.load_reference(spark, str(tmp_path / "my_places.csv"))
    assert kind == "places" and [r.parent for r in places.collect()] == ["South"]
    with pytest.raises(ValueError):
        records.reference_kind("odd.csv", ["foo"])
    one = records.registered(None, spark, "s", "csv", "a.csv")
    assert [r.tier for r in records.registered(one, spark, "s", "csv", "b.csv", 1).collect()] == [1]
    for k in ("json", "csv", "text"):
        records.export_pages(spark.createDataFrame([(1, "u", "t", "x\ny", "2024")], "page_id bigint, url string, title string, text string, fetched_at string"), str(tmp_path / k), k)
        assert any((tmp_path / k).iterdir())
