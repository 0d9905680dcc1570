"""Close names: every pair of a block counts, and hardly any is compared letter by letter."""

import difflib
import random
import re
from functools import partial
from itertools import combinations

import pytest

from cairnframe.operators import resolution

SCHEMA = "entity_type string, key string, seq bigint"


def _names(n: int, seed: int) -> list[str]:
    """Distinct names, nearly all of one dense block; some long, some with digits, some of another script."""
    r, out = random.Random(seed), {}
    syllable = lambda: r.choice("bdfgklmnprstv") + r.choice("aeiou")
    while len(out) < n:
        if out and r.random() < 0.4:
            name = list(r.choice(list(out)))
            for _ in range(r.randint(1, 3)):
                at = r.randrange(3, len(name) + 1)
                name[at : at + r.randint(0, 1)] = r.choice(["", r.choice("aeioutrs")])
        else:
            name = "the " + "".join(syllable() for _ in range(r.randint(2, 9))) + r.choice(["", " of the " + syllable() + "na", " 12"])
            name = name.replace("th", "ठत") if r.random() < 0.05 else name
        if len("".join(name).strip()) > 3:
            out["".join(name).strip()] = None
    return list(out)


def _by_loops(names: list[tuple[str, int]], threshold: float) -> set[tuple]:
    def blocks(key):
        digits, letters = re.sub("[^0-9]", "", key), re.sub("[^a-z]", "", key)
        return {("a", digits, letters[:3]), ("z", digits, letters[-3:])}

    best = {}
    for (x, i), (y, j) in combinations(names, 2):
        (earlier, first), (key, _) = sorted([(x, i), (y, j)], key=lambda v: v[1])
        if i == j or not blocks(x) & blocks(y) or abs(len(x) - len(y)) > max(2, int(0.25 * max(len(x), len(y)))):
            continue
        m = difflib.SequenceMatcher(None, key, earlier)
        if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold:
            best[key] = max(best.get(key, (0,)), (m.ratio(), -first, earlier))
    return {("t", key, b[2], b[0]) for key, b in best.items()}


@pytest.mark.parametrize("threshold, piece", [(0.92, 1 << 15), (0.92, 60), (0.7, 60), (1.0, 60)])
def test_as_by_loops(spark, monkeypatch, threshold, piece):
    monkeypatch.setattr(resolution, "near_pairs", partial(resolution.near_pairs, piece=piece))
    names = [(name, i // 2 if i < 20 else i) for i, name in enumerate(_names(520, 7))]
    df = spark.createDataFrame([("t", *n) for n in random.Random(1).sample(names, len(names))], SCHEMA)
    assert {tuple(r) for r in resolution.close_names(df, threshold).collect()} == _by_loops(names, threshold)


def test_dense_block_is_not_compared_by_letters(spark):
    r = random.Random(3)
    names = {"mirmora " + "".join(r.choice("bdfgklmnprstvxz") + r.choice("aeiou") for _ in range(3)) for _ in range(9000)}
    df = spark.createDataFrame([("t", n, i) for i, n in enumerate(sorted(names))], SCHEMA)
    plan = resolution.close_names(df)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "levenshtein" in line]
    assert resolution.near_pairs(df).count() < len(names) ** 2 // 2 * 0.01


def test_empty_and_null(spark):
    df = spark.createDataFrame([("t", "", 1), ("t", None, 2), (None, "mirmora", 3), ("t", "mirmora", None), ("t", "a", 4)], SCHEMA)
    assert resolution.close_names(df).count() == 0
    assert resolution.close_names(df.limit(0)).count() == 0


def test_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "t", "Mirmora jicifu baro", 9), (2, "t", "mirmora jicifu  barro", 10), (3, "t", None, 11), (4, "t", " ", 12)], "x int, entity_type string, identity string, seq bigint")
    got = {r.x: r for r in resolution.resolve(df).collect()}
    assert set(got[1].asDict()) == {"x", "entity_type", "identity", "seq", "entity_id", "canonical_name"} and got[2].canonical_name == "Mirmora jicifu baro"
    assert got[1].entity_id == got[2].entity_id and got[3].entity_id is None and got[4].entity_id is None and got[4].identity == " "
