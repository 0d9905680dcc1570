"""Queries over texts and names of every kind, against brute force."""

import re

from cairnframe.plans import registry

SPLIT = re.compile(r"(?<=[.!?।])\s+|\n+")


def test_sentences_of_every_text(spark, tmp_path):
    texts = [None, "", "One. Two! Three?", "Café is open. “Yes” – no.", "यह एक है। दूसरा है।", "a.\tb.  c.\r\n\r\n d", "x. y.　z. w", " \t\n \n.", "e.g. 3.5 m", "\x85\nq!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n for r in registry.QUERIES["sentence_count"](spark, str(tmp_path)).collect()}
    assert got == {i: sum(1 for s in SPLIT.split(t) if s.strip()) for i, t in enumerate(texts) if t is not None}


def test_conflicts_of_measured_fields(spark, tmp_path):
    units = [("length", "m", "m", 1.0, 0.0), ("length", "km", "m", 1000.0, 0.0), ("length", "ft", "m", 0.3048, 0.0)]
    spark.createDataFrame(units, "quantity string, unit string, base_unit string, factor double, unit_offset double").write.parquet(str(tmp_path / "ref_units.parquet"))
    rows = [
        (1, 1, "altitude_m", "3 km", None, None, 1, "a"),
        (2, 1, "altitude_m", "3000-4500 m", None, None, 2, "b"),
        (3, 1, "altitude_m", "9842", "ft", None, 2, "c"),
        (4, 1, "altitude_m", "10 m", None, None, 0, "d"),
        (5, 2, "height", "52.8", None, "it gives 52.8 m, no more", 3, "a"),
        (6, 2, "height", "53", None, None, 3, "b"),
        (7, 2, "height", "tall", None, None, 3, "c"),
        (8, 3, "region", "North", None, None, 3, "a"),
        (9, 3, "region", "north ", None, None, None, "b"),
        (10, 4, "height", "5 m to 10 m", None, None, 1, "a"),
        (11, 4, "height", "5.05-10.1 m", None, None, 1, "b"),
        (12, 5, "population", "1'017", None, None, 1, "a"),
        (13, 5, "population", "1 020", None, None, 1, "b"),
        (14, 6, "height", None, None, None, 1, "a"),
    ]
    names = "candidate_id bigint, subject_id bigint, field string, raw_value string, unit string, quote string, tier int, source_id string"
    spark.createDataFrame(rows, names).selectExpr("*", "'2024-01-01T00:00:00Z' as fetched_at").write.parquet(str(tmp_path / "candidates.parquet"))
    won = {(r.entity_id, r.name): r for r in registry.QUERIES["conflict_majority"](spark, str(tmp_path)).collect() if r.status == "accepted"}
    assert {k: r.value for k, r in won.items()} == {(1, "altitude_m"): "3 km", (2, "height"): "52.8", (3, "region"): "North", (4, "height"): "5 m to 10 m", (5, "population"): "1'017"}
    assert won[(5, "population")].confidence == 0.95 and won[(4, "height")].confidence == 0.95
    first = {(r.entity_id, r.name): (r.value, r.value_num, r.value_max) for r in registry.QUERIES["conflict_trusted_first"](spark, str(tmp_path)).collect()}
    assert first[(1, "altitude_m")] == ("10 m", 10.0, None) and first[(4, "height")] == ("5 m to 10 m", 5.0, 10.0)
    assert set(first) == set(won)


def test_names_of_every_script(spark, tmp_path):
    rows = [(1, "plant", "मोन्ब्रिउम रिजिना"), (2, "plant", " मोन्ब्रिउम  रिजिना."), (3, "plant", "Salt-Ferry"), (4, "plant", "salt ferry"), (5, "plant", " "), (6, "plant", None), (7, "place", "மலை")]
    spark.createDataFrame(rows, "candidate_id bigint, entity_type string, identity string").write.parquet(str(tmp_path / "candidates.parquet"))
    got = {(r.entity_type, r.canonical_name, r.rows) for r in registry.QUERIES["entities_exact"](spark, str(tmp_path)).collect()}
    assert got == {("plant", "मोन्ब्रिउम रिजिना", 2), ("plant", "Salt-Ferry", 2), ("place", "மலை", 1)}


def test_index_of_whole_pages(spark, tmp_path):
    rows = [(1, "Salt ferry", None, "Salt", "a ferry, a नाव"), (2, None, "Ferry", None, None)]
    spark.createDataFrame(rows, "page_id bigint, title string, description string, headings string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.page_id, r.term): r.tf for r in registry.QUERIES["term_index"](spark, str(tmp_path)).collect()}
    assert got == {(1, "salt"): 6.0, (1, "ferry"): 5.0, (1, "a"): 2.0, (1, "नाव"): 1.0, (2, "ferry"): 2.0}
