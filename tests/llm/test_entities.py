import pytest
from pyspark.sql import functions as F

from cairnframe.llm import entities, names, survivors

FIELDS = {"plant": [entities.Field("first_described", "year", 0), entities.Field("region", "text", 0), entities.Field("family", "text", 0), entities.Field("height", "number", 0.05)]}
UNITS = [("length", "m", "m", 1.0, 0.0), ("length", "ft", "m", 0.3048, 0.0)]
ROWS = "candidate_id bigint, subject_id bigint, domain string, entity_type string, identity string, field string, raw_value string, unit string, quote string, page_id bigint"


@pytest.mark.parametrize(
    "a,b",
    [("Monbrium rijina", "मोन्ब्रिउम रिजिना"), ("rijina, Monbrium", "Monbrium  RIJINA (herbarium sheet)"), ("Monbrium rijina Kelv. ex Mund.", "Monbrium rijina"), ("Amber Meadow of Xidosu, The", "the amber-meadow of xidosu"), ("M. rijina", "Monbrium rijina"), ("New Yokisu Ridge, Peña Lúgar", "New Yokisu Ridge"), ("The Salt Ferry / Orla Syvert", "The Salt Ferry – entry")],
)
def test_names_meet(a, b):
    assert set(names.forms(a)) & set(names.forms(b))


def test_bit_vectors():
    assert names.dice(names.bits("kiksone ostkera"), names.bits("kiksoe ostkera")) > 0.8
    assert names.dice(names.bits("abc"), names.bits("xyz")) < 0.4 and names.dice(0, 0) == 0.0
    assert names.forms("") == () and names.forms("…") == ()


def _rows(spark):
    out, n = [], 0
    for k in range(60):
        for d in ("a.test", "b.test", "c.test") if k < 20 else ("a.test",):
            name = f"Gen{chr(97 + k % 26)}ra sp{chr(97 + k // 2 % 26)}ex{chr(97 + k % 7)}o"
            facts = {"first_described": str(1700 + k), "region": f"region {k % 9}", "family": f"family {k % 7}", "height": f"{1.2 ** (k % 30) * (1.01 if d == 'b.test' else 1):.4f} m"}
            if d == "c.test":
                name = name[0] + ". " + name.split()[1]
                facts.pop("family")
            for f, v in facts.items():
                n += 1
                out.append((n, k * 10 + ord(d[0]) - 97, d, "plant", name, f, v, None, None, k))
    out += [(9001, 900, "z.test", None, "x", "region", "region 1", None, None, None), (9002, 901, None, "plant", "x", "region", "region 1", None, None, None), (9003, None, "a.test", "plant", None, None, None, None, None, None), (9004, 902, "z.test", "plant", "y" * 5000, "region", None, None, None, None)]
    return spark.createDataFrame(out + out[:5], ROWS).withColumn("source", F.lit("clash")).withColumn("kind", F.lit(1))


def test_matches(spark):
    aliases = spark.createDataFrame([(1, None)], "page_id bigint, alias string")
    units = spark.createDataFrame(UNITS, "quantity string, unit string, base_unit string, factor double, unit_offset double")
    rows = _rows(spark)
    got = entities.matches(rows, aliases, units, FIELDS).collect()
    pairs = {(r.subject_a, r.subject_b) for r in got}
    want = {(k * 10 + i, k * 10 + j) for k in range(20) for i in range(3) for j in range(i + 1, 3)}
    assert len(pairs & want) >= 0.95 * len(want) and len(pairs - want) <= 2
    assert all(0.5 <= r.confidence <= 1 for r in got)
    # Dividing hot cells loses no match.
    divided = {(r.subject_a, r.subject_b) for r in entities.matches(rows, aliases, units, FIELDS, entities.Model(hot=2)).collect()}
    assert len(want & divided) >= 0.95 * len(want)
    assert entities.matches(rows.limit(0), aliases, units, FIELDS).count() == 0


CANDIDATES = "candidate_id bigint, subject_id bigint, field string, raw_value string, tier int, confidence double, fetched_at string"


def test_survivors(spark):
    rows = [
        (1, 1, "f", "n/a", 1, 0.9, None), (2, 1, "f", "x", 2, 0.9, "2024-01-01T00:00:00+02:00"), (3, 1, "f", "y", 2, 0.9, "2023-12-31 23:00:00"), (4, 1, "f", "z", None, 1.0, None),
        (5, 2, "f", "x", 1, None, None), (6, 2, "f", "y", 1, 0.1, None), (7, 3, "f", "x", 1, 0.1, None), (8, 4, "f", None, 1, 0.1, None), (9, 4, "f", " — ", 1, 0.1, None), (10, 5, "f", "a", 1, 0.5, "20240101T000000Z"), (11, 5, "f", "b", 1, 0.5, "2024-01-01T00:00:00Z"),
        (12, None, None, "a" * 100000, 1, float("nan"), "odd"), (13, None, None, "b", 1, 0.1, "odd"),
    ]
    df = spark.createDataFrame(rows, CANDIDATES).withColumn("n", F.lit(0)).withColumn("best", F.lit("x"))
    got = {r.subject_id: r.candidate_id for r in survivors.survivors(df, ["subject_id", "field"]).collect()}
    assert got == {1: 3, 2: 6, 5: 10, None: 13}
    assert survivors.survivors(df.limit(0), ["subject_id", "field"]).count() == 0


def test_fusion_discounts_copies(spark):
    rows = []
    for i in range(60):
        # On most items five good sources outvote a bad one and its two copies; on the last 20 only two of them speak.
        rows += [(i, f"good{k}", f"t{i}", k) for k in range(5 if i < 40 else 2)]
        rows += [(i, "bad", f"f{i}", 3)] + [(i, f"copy{k}", f"f{i}", 14 + k) for k in range(2)]
    rows += [(99, None, "x", 1), (98, "good1", None, 1)]
    df = spark.createDataFrame(rows, "item bigint, src string, val string, at bigint").withColumn("leader", F.lit(1)).withColumn("key", F.lit(2))
    got = {r.item: r for r in survivors.fused_values(df, ["item"], "src", "val", "at").collect()}
    assert all(got[i].value == f"t{i}" for i in range(60))
    assert got[99].value == "x" and 98 not in got
    assert survivors.fused_values(df.limit(0), ["item"], "src", "val", "at").count() == 0


def test_fusion_with_many_sources_and_copiers(spark):
    # Forty honest sources of accuracy 0.8, and twelve that copy the errors of one bad source; two items of every ten are told by the ring and two honest ones only.
    import random

    rng, rows, truth = random.Random(11), [], {}
    for i in range(300):
        truth[i] = f"t{i}"
        honest = rng.sample(range(40), 2 if i % 10 < 2 else 9)
        rows += [(i, f"h{k:02d}", truth[i] if rng.random() < 0.8 else f"e{i}-{rng.randrange(20)}", rng.randrange(100)) for k in honest]
        lie = truth[i] if rng.random() < 0.1 else f"lie{i}"
        rows += [(i, "bad", lie, 50)] + [(i, f"ring{k:02d}", lie, 60 + k) for k in range(12) if rng.random() < 0.35]
    df = spark.createDataFrame(rows, "item bigint, src string, val string, at bigint")
    got = {r.item: r.value for r in survivors.fused_values(df, ["item"], "src", "val", "at").collect()}
    votes = {}
    for i, _, v, _ in rows:
        votes.setdefault(i, {}).setdefault(v, 0)
        votes[i][v] += 1
    plain = sum(max(sorted(c), key=c.get) == truth[i] for i, c in votes.items())
    fused = sum(got[i] == truth[i] for i in truth)
    assert fused >= 0.93 * len(truth) and fused > plain


def _fused(rows, rounds=5, n=20, prior=0.8, copy=0.8):
    """The fusion of `fused_values` with every pair of the sources of every value, by loops."""
    import math
    from collections import defaultdict

    values, pairs = defaultdict(list), defaultdict(list)
    for i, s, v, t in sorted(rows, key=lambda r: r[3]):
        values[i, v].append(s)
    for x, sources in values.items():
        for k, s in enumerate(sources):
            for earlier in sources[:k]:
                pairs[s, earlier].append(x)
    a, c, p = defaultdict(lambda: prior), {}, {}
    for _ in range(rounds):
        strength = {s: math.log(n * a[s] / (1 - a[s])) for _, s, _, _ in rows}
        score = {x: sum(strength[s] * (1 - max((c.get((s, e), 0) for e in sources[:k]), default=0)) for k, s in enumerate(sources)) for x, sources in values.items()}
        for i in {i for i, _ in values}:
            of = [x for x in values if x[0] == i]
            total = sum(math.exp(score[x]) for x in of) + max(0, n + 1 - len(of))
            p.update({x: math.exp(score[x]) / total for x in of})
        given = defaultdict(list)
        for x, sources in values.items():
            for s in sources:
                given[s].append(p[x])
        a = {s: min(0.99, max(0.05, (sum(q) + 2 * prior) / (len(q) + 2))) for s, q in given.items()}
        c = {k: copy * sum(1 - p[x] for x in of) / (len(of) + 2) for k, of in pairs.items()}
    return {i: max((q, x[1]) for x, q in p.items() if x[0] == i) for i in {i for i, _ in values}}


@pytest.mark.parametrize("block", [256, 3])
def test_fusion_knows_every_pair_of_sources(spark, monkeypatch, block):
    # Seven sources lie together, each time after another one of its own; nine honest ones outvote them, on the last ten items only three speak.
    import random

    rng, rows = random.Random(4), []
    for i in range(40):
        ring, honest = [f"ring{k}" for k in range(7)], [f"h{k}" for k in range(9 if i < 30 else 3)]
        rng.shuffle(ring)
        rows += [(i, s, f"t{i}", t) for t, s in enumerate(honest)] + [(i, s, f"lie{i}", 20 + t) for t, s in enumerate([f"seed{i}", *ring])]
        rows += [(100 + 10 * i + k, f"ring{k}", "t", 0) for k in range(7)]
    rows += [(1000 + i, f"{s}{k}", f"{s}{i}", k) for i in range(20) for s, n in (("h", 2), ("ring", 2)) for k in range(i % n + 1)]
    monkeypatch.setattr(survivors, "BLOCK", block, raising=False)
    df = spark.createDataFrame(rows, "item bigint, src string, val string, at bigint")
    got = {r.item: (r.probability, r.value) for r in survivors.fused_values(df, ["item"], "src", "val", "at").collect()}
    expected = _fused(rows)
    assert all(expected[i][1] == f"t{i}" for i in range(40))
    assert {i: v for i, (_, v) in got.items()} == {i: v for i, (_, v) in expected.items()}
    assert max(abs(got[i][0] - expected[i][0]) for i in expected) < 2e-6
