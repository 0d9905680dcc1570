"""Index cells of any size lose no match."""

from cairnframe.llm import entities
from tests.llm.test_entities import FIELDS, ROWS, UNITS


def test_hot_groups_are_met_whole(spark):
    # One thing told by 24 sources in two attributes only, among 400 others.
    out, n = [], 0
    for k in range(424):
        one = k < 24
        facts = {"first_described": "1753" if one else str(1500 + k), "region": "the one" if one else f"region {k % 97}"}
        for f, v in facts.items():
            n += 1
            out.append((n, k, f"d{k}.test", "plant", "Monbrium rijina" if one else f"Gen{chr(97 + k % 26)}ra sp{chr(97 + k // 26)}exo", f, v, None, None, k))
    rows = spark.createDataFrame(out, ROWS)
    aliases = spark.createDataFrame([], "page_id bigint, alias string")
    units = spark.createDataFrame(UNITS, "quantity string, unit string, base_unit string, factor double, unit_offset double")
    found = lambda **k: {(r.subject_a, r.subject_b) for r in entities.matches(rows, aliases, units, FIELDS, entities.Model(**k)).collect()}
    whole = found(hot=10**6)
    assert {(a, b) for a in range(24) for b in range(a + 1, 24)} <= whole
    assert found(hot=4) == whole
    assert found(hot=4, block=5) == whole
