import itertools
import random

import pytest
from pyspark.sql import functions as F

from cairnframe.llm import main_text, records, site_lines

PAGE = "page_id bigint, domain string, title string, headings string, text string, landed_at timestamp"


def _site(spark, n=12):
    rows = []
    for i in range(n):
        name = f"Rosa alba{chr(97 + i)}x"
        body = [f"Between {i} and 9 m the records of {name} become frequent again. Old roots.", f"For years the register names {name} only twice." + (" The soil is thin." if i % 2 else "")]
        text = ["Home | Books", f"{i + 3} replies to “{name}”", name, *body, f"History of {name}", f"{name} – 1896", f"{100 + i}-234: 3,950 m", "Popular this week", f"Rosa alba{chr(97 + (i + 1) % n)}x", "", "Terms of use"]
        rows.append((i, "a.test", f"{name} (12-34{i})", f"{name} | History of {name} | Popular this week", "\n".join(text), None))
    rows.append((90, "a.test", "Row 1", None, "name: x; region: y; sheet: 1-2", None))
    rows.append((91, "a.test", None, None, None, None))
    rows.append((92, "a.test", "T", None, "", None))
    rows.append((93, None, None, None, "word " * 20000, None))
    return spark.createDataFrame(rows, PAGE).selectExpr("*", "'x' as line_no", "'y' as prefixes")


def test_furniture(spark):
    pages = _site(spark)
    got = {}
    for r in main_text.furniture_lines(pages, least=6).collect():
        got.setdefault(r.page_id, set()).add(r.line_no)
    for i in range(12):
        assert got[i] == {1, 2, 9, 10, 12}, i
    assert 90 not in got and 91 not in got and 92 not in got
    bodies = {r.page_id: r for r in main_text.main_bodies(pages, main_text.furniture_lines(pages, least=6)).collect()}
    assert bodies[0].text.split("\n")[0] == "Rosa albaax" and "Popular" not in bodies[0].headings and bodies[91].text is None
    assert main_text.furniture_lines(pages.limit(0)).count() == 0


def test_runs_unique_to_a_record_stay(spark):
    # A title-less line stays unless each of its parts stands on a page of another record; copies of a record are no evidence.
    shared = "Read the notice. By reading on you agree."
    rows = [(i, "a.test", f"Rosa nova{chr(97 + i // 2)}", None, f"Rosa nova{chr(97 + i // 2)}\nIt grows on scree. Soil {chr(97 + i // 2)}q is thin.\n{shared}\nSee: Rosa nova{chr(97 + (i // 2 + 1) % 4)} and Rosa nova{chr(97 + (i // 2 + 2) % 4)}\n12-34: 5 m, sheet 12", None) for i in range(8)]
    got = {(r.page_id, r.line_no) for r in main_text.furniture_lines(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {(i, k) for i in range(8) for k in (3, 4)}


def test_masking():
    assert main_text.title_tokens("The Red Loom – the tome (12-3)") == ["the", "red", "loom"]
    assert main_text.masked("7 of the red loom 1 2 x".split(), ["the", "red", "loom"]) == ["#", "of", "<T>", "#", "x"]


def test_repeated_lines_like_brute_force(spark):
    rng = random.Random(4)
    words = ["Alpha", "alpha!", "BETA  gamma", "beta-gamma", "delta", "", " ", "…", "Épsilon", "éPSILON", "zeta"]
    rows = [(i, rng.choice(["a", "b", None]), None, None, rng.choice([None, "\n".join(rng.choice(words) for _ in range(rng.randrange(8)))]), None) for i in range(60)]
    rows += rows[:3]
    pages = spark.createDataFrame(rows, PAGE).withColumn("h", F.lit(1)).withColumn("words", F.lit("x"))
    key = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    on = {}
    for p, d, _, _, t, _ in rows:
        for line in (t or "").split("\n"):
            if key(line) and d:
                on.setdefault((d, key(line)), set()).add(p)
    want = {(p, k) for p, d, _, _, t, _ in rows if t and d for k, line in enumerate(t.split("\n"), 1) if key(line) and len(on[d, key(line)]) >= 8}
    assert {(r.page_id, r.line_no) for r in site_lines.repeated_lines(pages).collect()} == want
    assert site_lines.repeated_lines(pages.limit(0)).count() == 0


def _blocks_by_brute_force(rows, least):
    docs, count = {}, {}
    for p, d, *_, t, _ in rows:
        if t and d:
            docs[p] = (d, [(n, w) for n, line in enumerate(t.split("\n"), 1) if (w := " ".join("".join(c if c.isalnum() else " " for c in line.lower()).split()))])
    for p, (d, lines) in docs.items():
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                count.setdefault((d, *(w for _, w in lines[i:j])), set()).add(p)
    out = set()
    for p, (d, lines) in docs.items():
        reach = 0
        for i in range(len(lines)):
            n = max((j - i for j in range(i + 1, len(lines) + 1) if len(count[d, *(w for _, w in lines[i:j])]) >= least), default=0)
            if n and i + n > reach:
                reach = i + n
                out.add((p, lines[i][0], n))
    return out


def test_blocks_like_brute_force(spark):
    rng = random.Random(7)
    long_ = [f"notice {i}" for i in range(23)]
    rows = []
    for i in range(90):
        lines = [rng.choice(["alpha", "Beta!", "gamma", "", "…", f"own {i}"]) for _ in range(rng.randrange(12))]
        if i % 3 == 0:
            at, a = rng.randrange(len(lines) + 1), rng.randrange(4)
            lines[at:at] = long_[a : 23 - rng.randrange(4)] * (1 + i % 2)
        rows.append((i, rng.choice(["a"] * 9 + ["b", None]), None, None, rng.choice(["\n".join(lines)] * 9 + [None]), None))
    rows += rows[:3]
    pages = spark.createDataFrame(rows, PAGE).selectExpr("*", "1 as k", "'x' as v", "2 as h", "3 as documents")
    for least in (3, 8):
        got = {(r.page_id, r.first_line, r.lines) for r in site_lines.repeated_blocks(pages, least).collect()}
        want = _blocks_by_brute_force(rows, least)
        assert got == want and max(n for _, _, n in want) > 16


def test_blocks_and_deletion(spark):
    rows = [(i, "a", None, None, f"x{i}\nn1\nn2\nn3\nn4\ny{i}", None) for i in range(9)]
    pages = spark.createDataFrame(rows, PAGE)
    blocks = site_lines.repeated_blocks(pages).collect()
    assert {(b.first_line, b.lines, *b.line_nos) for b in blocks} == {(2, 4, 2, 3, 4, 5)}
    left = site_lines.without_lines(pages, site_lines.repeated_lines(pages)).collect()
    assert {r.text for r in left} == {f"x{i}\ny{i}" for i in range(9)}


def _keys(spark, rows):
    return records.keyed(spark.createDataFrame(rows, PAGE).withColumn("key", F.lit("clash")))


@pytest.mark.parametrize(
    "a,b,same",
    [
        (("T", "Some text, here."), ("t", "some  TEXT here"), True),
        (("T", "Some text"), ("U", "Some text"), False),
        (("R", "name: X y; region: B"), ("r", "REGION: b | Name: x Y"), True),
        (("R", "name: X; region: B"), ("R", "name: B; region: X"), False),
        (("T", "one\ntwo"), ("T", "two\none"), False),
        ((None, "x"), (None, "X!"), True),
    ],
)
def test_canonical_keys(spark, a, b, same):
    got = [bytes(r.key) for r in _keys(spark, [(1, "d", a[0], None, a[1], None), (2, "e", b[0], None, b[1], None)]).collect()]
    assert (got[0] == got[1]) == same


def test_ledger(spark):
    rows = [(i, "d", "t", None, f"Text {i % 3}", None) for i in range(9)] + [(20, "d", "t", None, None, None), (21, "d", "t", None, " .", None), (22, "d", "t", None, "long " * 20000, None)]
    keys = _keys(spark, rows).withColumn("at", F.timestamp_seconds(F.col("id")))
    ledger = records.record_ledger(keys, F.col("id") % 2, [0, 1])
    got = {r.first_id: r.copies for r in ledger.collect()}
    assert got == {0: 3, 1: 3, 2: 3, 22: 1}
    pairs = {(r.page_a, r.page_b) for r in records.copy_pairs(keys, ledger).collect()}
    assert pairs == {(a, b) for a, b in itertools.combinations(range(9), 2) if a % 3 == b % 3}
    none = records.Ledger(spark)
    assert none.update(keys.limit(0)).count() == 0


def test_many_parts_and_hot_keys(spark):
    parts = [f"label {i}: value {i}" for i in range(100_000)]
    got = _keys(spark, [(1, "d", "T", None, "; ".join(parts), None), (2, "e", "t", None, " |\n".join(x.upper() for x in reversed(parts)), None)])
    assert got.select("key").distinct().count() == 1
    # A third of all rows under one key, in blocks far smaller than the key; a page that stands twice is paired once.
    rows = [(i, "d", "t", None, "same" if i % 3 == 0 else f"text {i}", None) for i in range(600)] + [(0, "d", "t", None, "Same!", None)]
    keys = _keys(spark, rows)
    ledger = records.record_ledger(keys, F.lit(1), [1])
    want = {(a, b) for a in range(0, 600, 3) for b in range(a + 3, 600, 3)}
    for block in (7, 64, 10_000):
        pairs = [(r.page_a, r.page_b) for r in records.copy_pairs(keys, ledger, block).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    facts = {r.id: (r.copies, r.first_id) for r in records.members(keys, ledger).collect()}
    assert facts[300] == (201, 0) and facts[1] == (1, 1)


def test_bullets_inside_values():
    import re

    split = lambda t: [p for p in re.split(records.SEPARATOR, t) if p]
    assert split("a: x · y; b: z") == ["a: x · y", "b: z"] and split("a: x • b: y\n• c: d") == ["a: x", "b: y", "c: d"]
