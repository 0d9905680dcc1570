import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from cairnframe.functions.quantity import Units
from cairnframe.operators import units
from cairnframe.operators.units import changepoints, read_quantities, undo_unit_changes, unit_histories

TABLE = [("length", "m", "m", 1.0, 0.0), ("length", "km", "m", 1000.0, 0.0), ("length", "ft", "m", 0.3048, 0.0), ("length", "in", "m", 0.0254, 0.0), ("length", '"', "m", 0.0254, 0.0), ("length", "'", "m", 0.3048, 0.0), ("area", "km2", "ha", 100.0, 0.0), ("area", "sq mi", "ha", 258.9988110336, 0.0), ("temperature", "°f", "c", 5 / 9, -160 / 9), ("mass", "lb", "kg", 0.45359237, 0.0), ("mass", "oz", "kg", 0.028349523125, 0.0), ("time", "years", "d", 365.25, 0.0), ("time", "months", "d", 30.4375, 0.0)]


@pytest.mark.parametrize(
    "raw,unit,quote,expected",
    [
        ("1,234.5 m", None, None, (1234500000, 1234500000)),
        ("12,5 km", None, None, (12500000000, 12500000000)),
        ("146 113 In", "m", None, (3711270200, 3711270200)),
        ("3 1/2 lb", None, None, (1587573, 1587573)),
        ("3½ lb", None, None, (1587573, 1587573)),
        ("914—1,327 m", None, None, (914000000, 1327000000)),
        ("from 2.2 to 2.4 km", None, None, (2200000000, 2400000000)),
        ("(km) 2", "m", None, (2000000000, 2000000000)),
        ("oz.: 2", None, None, (56699, 56699)),
        ("465 m (1,526 ft)", None, None, (465000000, 465000000)),
        ("50 years 6 months", None, None, (18445125000, 18445125000)),
        ("5' 11\"", None, None, (1803400, 1803400)),
        ("2 thousand ft", None, None, (609600000, 609600000)),
        ("1.63 × 10^3 m", None, None, (1630000000, 1630000000)),
        ("7.22×10³ m", None, None, (7220000000, 7220000000)),
        ("0.02 km2", "m", None, (2000000, 2000000)),
        ("0.5 Sq Mi", None, None, (129499406, 129499406)),
        ("≈ −40 °F", None, None, (-40000000, -40000000)),
        ("about 2 m in summer", None, None, (2000000, 2000000)),
        ("12", "KM. ", None, (12000000000, 12000000000)),
        ("12", None, "noted as 112 m, later 12 ft", (3657600, 3657600)),
        ("23 spans", "m", None, None),
        ("12", None, None, None),
        ("12", "furlong", "12 m", None),
        ("two fists", "m", None, None),
        ("", "m", None, None),
        (None, "m", None, None),
    ],
)
def test_quantities(raw, unit, quote, expected):
    got = Units(TABLE).standard(raw, unit, quote)
    assert (got[2:] if got else None) == expected


@given(st.integers(0, 10**6), st.sampled_from(["m", "km", "ft"]))
def test_grouped_digits_read_as_plain(n, unit):
    u = Units(TABLE)
    assert u.standard(f"{n:,} {unit}", None, None) == u.standard(f"{n} {unit}", None, None)


def test_read_quantities_rows(spark):
    table = spark.createDataFrame(TABLE, "quantity string, unit string, base_unit string, factor double, unit_offset double")
    rows = spark.createDataFrame([(1, "2 km", None, None, "x"), (1, "2 km", None, None, "x"), (2, None, None, None, "x"), (3, "x" * 100000, "m", None, "x"), (None, "1", "m", None, "x")], "candidate_id bigint, raw_value string, unit string, quote string, lo_micro string")
    got = sorted((r.candidate_id or 0, r.base_unit, r.lo_micro) for r in read_quantities(rows, table, ["candidate_id"]).collect())
    assert got == [(0, "m", 1000000), (1, "m", 2000000000), (1, "m", 2000000000)]
    assert read_quantities(rows.limit(0), table, ["candidate_id"]).count() == 0


def _cost(x, ends, penalty):
    total, a = 0.0, 0
    for b in ends:
        total += ((x[a:b] - x[a:b].mean()) ** 2).sum() + penalty
        a = b
    return total


def test_changepoints_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = np.concatenate([rng.normal(m, 0.1, rng.integers(1, 6)) for m in rng.normal(0, 3, 3)])
        n, penalty = len(x), 0.5
        best = min(_cost(x, [i + 1 for i in range(n - 1) if mask >> i & 1] + [n], penalty) for mask in range(1 << (n - 1)))
        assert abs(_cost(x, changepoints(x, penalty), penalty) - best) < 1e-9
    assert changepoints(np.array([]), 1.0) == []


def test_unit_change_is_undone():
    values = np.array([100.0, 101, 99, 0.1, 0.101, 100])
    stated = np.array([True, True, True, False, False, True])
    shift = undo_unit_changes(values, stated, np.array([1.0, 1000.0]), 0.5, 0.08)
    assert np.allclose(shift, [1, 1, 1, 1000, 1000, 1])


def test_histories(spark):
    table = spark.createDataFrame(TABLE, "quantity string, unit string, base_unit string, factor double, unit_offset double")
    data = [(i, 1, "height", f"{100 + i % 3} m", None, None) for i in range(6)] + [(9, 1, "height", "0.1", None, None), (10, 2, "height", "5", None, None), (11, 3, "height", None, None, None)]
    rows = spark.createDataFrame(data, "candidate_id bigint, subject_id bigint, field string, raw_value string, unit string, quote string").selectExpr("*", "timestamp_seconds(candidate_id) as at")
    got = {r.candidate_id: r for r in unit_histories(rows, table, ["subject_id", "field"]).collect()}
    assert abs(got[9]["value"] - 100) < 1e-6 and got[9]["unit_shift"] == pytest.approx(1000)
    assert got[0]["unit_shift"] == 1 and got[10]["base_unit"] is None and 11 not in got
    assert got[0].stated and got[0].lo_micro == 100_000_000 and not got[9].stated and got[9].lo_micro is None
    assert unit_histories(rows.limit(0), table, ["subject_id", "field"]).count() == 0


@pytest.mark.parametrize("timed", [True, False])
def test_pieces_of_a_long_history(spark, timed):
    # The unit is stated in the first hundred readings only; the last third is in feet, with a real change before it.
    rng = np.random.default_rng(5)
    n, data = 3000, []
    for i in range(n):
        v = (100.0 if i < 1200 else 260.0) * float(np.exp(rng.normal(0, 0.02))) * (1 / 0.3048 if i >= 2000 else 1)
        data.append((i, 1, f"{v:.5f}" + (" m" if i < 100 else "")))
    data += [(n + i, 2 + i % 3, f"{5 + i % 4} m") for i in range(60)]
    table = spark.createDataFrame(TABLE + [("length", "ft", "m", 0.3048, 0.0)], "quantity string, unit string, base_unit string, factor double, unit_offset double").distinct()
    rows = spark.createDataFrame(data, "candidate_id bigint, subject_id bigint, raw_value string").selectExpr("*", "'f' as field", "string(null) as unit", "string(null) as quote", "timestamp_seconds(candidate_id) as at" if timed else "timestamp(null) as at")
    read = lambda **k: {r.candidate_id: (r.base_unit, round(r.value, 6), r.stated) for r in unit_histories(rows, table, ["subject_id", "field"], **k).collect()}
    whole = read(window=10**6)
    assert sum(abs(np.log(v / (100 if i < 1200 else 260))) > 0.2 for i, (_, v, _) in whole.items() if i < n) == 0
    assert all(b == "m" for b, _, _ in whole.values())
    for window in (100, 257, 1024):
        assert read(window=window, margin=24) == whole


def test_weighted_items_like_values():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 0.1, 30) for m in (0, 2, 2.5, 0)])
    assert changepoints(x, 0.5) == [30, 60, 90, 120]
    size = np.array([10] * 12)
    sums, squares = x.reshape(12, 10).sum(1), (x**2).reshape(12, 10).sum(1)
    assert units._segment(size, sums, squares, 0.5) == [3, 6, 9, 12]


@pytest.mark.parametrize("margin", [8, 64])
def test_histories_come_out_the_same_at_any_window(spark, margin):
    # Small real changes every few readings, some in another unit; three subjects, of which one is null and one without a unit.
    rng = np.random.default_rng(9)
    data, expected, factors = [], {}, np.array([1.0, 1000.0, 0.3048, 0.0254])
    for subject, n in ((1, 900), (None, 400), (3, 300)):
        level = np.repeat(rng.normal(4, 0.3, n // 5), 5)
        v = np.round(np.exp(level + rng.normal(0, 0.15, n)) / np.where(np.arange(n) % 60 > 40, 0.3048, 1.0), 5)
        said = (rng.random(n) < 0.05) & (subject != 3)
        shift = undo_unit_changes(v, said, factors if subject != 3 else np.ones(1), 0.5, 0.08)
        for i in range(n):
            data.append((len(data), subject, f"{v[i]:.5f}" + (" m" if said[i] else "")))
            expected[data[-1][0]] = 1.0 if said[i] else shift[i]
    table = spark.createDataFrame([r for r in TABLE if r[0] == "length"], "quantity string, unit string, base_unit string, factor double, unit_offset double")
    rows = spark.createDataFrame(data, "candidate_id bigint, subject_id bigint, raw_value string").selectExpr("*", "'f' as field", "string(null) as unit", "string(null) as quote", "timestamp_seconds(candidate_id) as at")
    assert len(set(expected.values())) > 2
    for window in (32, 250, 10**6):
        got = {r.candidate_id: r for r in unit_histories(rows, table, ["subject_id", "field"], window=window, margin=margin).collect()}
        assert len(got) == len(data)
        assert [i for i, r in got.items() if abs(r.unit_shift - expected[i]) > 1e-6] == []
        assert all((r.base_unit == "m") == (r.subject_id != 3) and (r.lo_micro is None) != r.stated for r in got.values())
