import base64
import hashlib
import os

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnframe.llm import containers, mojibake, tokens

here = pytest.mark.skipif(not os.path.exists(tokens.BYTE_BPE_50K), reason="the vocabulary is not here")


def _reference():
    import tiktoken

    with open(tokens.BYTE_BPE_50K, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.WORDS, mergeable_ranks=ranks, special_tokens={})


@here
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_tokens_like_the_public_library(text):
    assert tokens.vocabulary(tokens.BYTE_BPE_50K).encode(text) == _REFERENCE.encode_ordinary(text)


_REFERENCE = _reference() if os.path.exists(tokens.BYTE_BPE_50K) else None


@here
@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 4000 + "x", "é" * 2000, "日本" * 1000, "'s't'll" * 50, "\n\n\t \r\n x", "<|endoftext|>", "x1y22z333"])
def test_long_words(text):
    bpe = tokens.vocabulary(tokens.BYTE_BPE_50K)
    assert bpe.encode(text) == _REFERENCE.encode_ordinary(text)
    assert tokens.decoded(bpe.encode(text)) == text
    assert b"".join(bpe.fragments(text.encode())) == text.encode()


@here
def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (1, "Hello world")], "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("tokens", F.lit(3))
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encoded(df).collect())
    assert got == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert sorted((r.doc_id, r.tokens) for r in tokens.token_counts(df).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert tokens.encoded(df.limit(0)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_fill_holds_capacity(sizes):
    out = containers.fill(sizes, 100)
    assert sorted(i for w in out for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 100 for w in out)


def test_differencing_is_even():
    out = containers.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in out) in ([14, 16], [15, 15])


def test_containers(spark):
    rows = [(i, (i * 37) % 300 + 1) for i in range(2000)] + [(5000, 1000), (5001, 300), (5002, 0), (5003, None), (5004, -1)] + [(7777, 50)] * 700
    df = spark.createDataFrame(rows, "doc_id bigint, tokens bigint").withColumn("block", F.lit("x")).withColumn("container", F.lit(1)).withColumn("n", F.lit(1))
    got = containers.containers(df, 300, per_block=16).collect()
    used, per_doc = {}, {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.tokens
        per_doc.setdefault((r.doc_id, r.copy), []).append(r.tokens)
    assert max(used.values()) <= 300
    assert len(per_doc) == len(rows) and sorted(per_doc[5000, 1]) == [100, 300, 300, 300]
    assert all(len(v) == 1 for k, v in per_doc.items() if k[0] != 5000)
    assert sum(used.values()) == sum(max(0, n or 0) for _, n in rows)
    assert sum(used.values()) / (300 * len(used)) > 0.9
    assert containers.containers(df.limit(0), 300).count() == 0


CLEAN = ["A café ledger from Bröndal mentions São Berim – “stubborn”.", "L’été où tout fut décrit, la vallée était fermée ; à près de 3 °C.", "Почва тонкая, известковая, полна старых корней.", "Już w 1952 zapisano księdze gminy, ale stronę później wycięto ło żółć.", "मिट्टी पतली है और पुरानी जड़ों से भरी है।", "Für größtenteils Mädchen läßt sich zählen, später über Bücher.", "O chão é fino e cheio de raízes. NÃO MENCIONA A REGIÃO.", "plain ascii only; √(area) ≈ 5 ├─ box"]


def _sloppy(b: bytes, name: str) -> str:
    back = {v: k for k, v in mojibake.TABLES[name].items()}
    return "".join(chr(x) if x < 128 else back.get(x, chr(x)) for x in b)


def test_restores(spark):
    clean = [(i, CLEAN[i % len(CLEAN)] + f" {i}") for i in range(400)]
    garbled, want = [], {}
    for k, name in enumerate(("cp1252", "latin_1", "mac_roman", "cp1251", "cp437", "cp850")):
        for j in range(5):
            text = CLEAN[j] + f" g{k}"
            i = 1000 + k * 10 + j
            bad = _sloppy(text.encode(), name)
            if j == 1:
                bad = _sloppy(text[:30].encode(), name) + text[30:]
            garbled.append((i, bad))
            want[i] = text
    garbled.append((2000, _sloppy(_sloppy(CLEAN[0].encode(), "cp1252").encode(), "cp1252")))
    want[2000] = CLEAN[0]
    garbled.append((2001, "A caf� ledger"))
    df = spark.createDataFrame(clean + garbled + [(3000, None), (3001, ""), (3002, "x" * 100000)], "doc_id bigint, text string").withColumn("restored", F.lit(1))
    got = {r.doc_id: r for r in mojibake.repaired(df).collect()}
    assert {i for i in got if i < 1000 or i >= 3000} == set()
    right = sum(i in got and got[i].restored == t for i, t in want.items())
    assert right >= 0.9 * len(want), [(i, got.get(i) and got[i].restored, t) for i, t in want.items() if i not in got or got[i].restored != t]
    assert got[2001].lost
    hashes = {r.doc_id: r.restored_hash for r in mojibake.restored_hashes(mojibake.repaired(df)).collect()}
    assert hashes[2001] == "" and hashes[2000] == hashlib.sha256(CLEAN[0].encode()).hexdigest()[:32]
    assert mojibake.repaired(df.limit(0)).count() == 0


def _natural(n=400):
    return pd.DataFrame({"text": [CLEAN[i % len(CLEAN)] + f" {i}" for i in range(n)]})


def _scores(spark, texts):
    return mojibake.Scores(mojibake.pair_counts(spark.createDataFrame(texts)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-4.0, -2.0, -1.0, -0.5, 0.5, 1.0, 3.0]), max_size=9))
def test_maximal_segments_like_brute_force(x):
    # Of the segments of largest sum the shortest, then the same to its left and right.
    def split(a, b):
        best = max((sum(x[i:j]), i - j, -i) for i in range(a, b) for j in range(i + 1, b + 1)) if b > a else (0, 0, 0)
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        return [*split(a, i), (i, j), *split(j, b)]

    assert mojibake.maximal_segments(x) == split(0, len(x))


def test_only_isolated_runs_are_tested(spark):
    scores = _scores(spark, _natural())
    good = "L’été à près de 3 °C. NÃO MENCIONA"
    bad = _sloppy("São Berim – żółć".encode(), "cp1252")
    text = good + " " + bad
    runs, every = mojibake.segments(text, scores), [f.span() for f in mojibake.FOREIGN.finditer(text)]
    assert {f for f in every if f[0] >= len(good)} <= set(runs) < set(every)
    assert mojibake.restore(text, scores) == (good + " São Berim – żółć", True)
    # Where no run is isolated nothing is tested, though mappings would fit.
    class Blind(mojibake.Scores):
        def odd(self, codes):
            return super().odd(codes) * 0 - 1.0

    assert mojibake.restore(text, Blind(mojibake.pair_counts(spark.createDataFrame(_natural())))) == (text, False)


def test_encodings_of_two_bytes(spark):
    scores = _scores(spark, _natural())
    for name in mojibake.WIDE:
        for word in ("größte", "Почва", "żółć", "é"):
            try:
                bad = word.encode().decode(name)
            except UnicodeError:
                continue
            assert mojibake.restore(f"wo {bad} wo", scores) == (f"wo {word} wo", True), (name, word)
