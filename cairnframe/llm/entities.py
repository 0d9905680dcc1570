"""The same real-world things across sources that share no key, matched with a confidence.

Every subject is encoded as fixed bit vectors: twelve bits for each attribute (a digest of its
text, or a step on a logarithmic scale of its number) and 128 bits for the q-grams of each form
of its names. Close pairs are found by multi-index hashing: the vectors are divided into chunks,
and subjects meet where they agree exactly in a name form, in a name's word and an attribute, or
in two attributes, the latter where both chunks together are selective enough; numbers have two overlapping grids, so that a pair within the
tolerance always shares a cell of one. A pair's agreements and disagreements are weighed by how
rare agreement by chance is (log-likelihood ratios), the names by the Dice score of their bit
vectors, and the sum with the prior odds of a match gives the confidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.quantity import Units
from cairnframe.functions.text import fold, is_missing, squeeze
from cairnframe.llm.names import bits, dice, forms
from cairnframe.operators.groups import map_groups
from cairnframe.operators.pivot import month_number
from cairnframe.operators.units import unit_rows
from cairnframe.session import cut

BITS, CODES = 12, 4096
#: The evidence, in nats, of names whose bit vectors have a Dice score of 0.8 or more.
CLOSE = 5.0


@dataclass(frozen=True)
class Field:
    """An attribute: `kind` text, year or month (equal or not), number (relative `tolerance`) or degree (absolute)."""

    name: str
    kind: str
    tolerance: float = 0.05


@dataclass(frozen=True)
class Model:
    """Chances and limits of the match model; all documented parameters.

    `same` is the chance that two descriptions of one thing agree in an attribute that both give;
    `selective` the least information, in nats, of a pair of attribute chunks that serves as an
    index (less where a type has so few subjects that a cell of less holds three by chance); `hot` the size beyond which an index cell is divided by a further attribute where every
    match in it must agree in one, or else met in blocks of about `block` rows.
    """

    same: float = 0.955
    same_name: float = 0.7
    selective: float = 7.3
    hot: int = 96
    block: int = 1024
    least: float = 0.5


def attribute_codes(rows: DataFrame, units: DataFrame, fields: list[Field], subject: str = "subject_id") -> DataFrame:
    """(`subject`, `codes`): per subject a map from field position to its code 1…4095.

    Of a text the most frequent value stands (ties: the smallest code), of a number the median.
    Counts per code are merged before the shuffle, and there are at most 4,095 codes a field, so a
    subject of any number of rows stays small. Missing and unreadable values give no code.
    """
    known = unit_rows(units)
    kinds = {f.name: f for f in fields}
    place = F.create_map(*[F.lit(x) for i, f in enumerate(fields) for x in (f.name, i)])
    numeric = [f.name for f in fields if f.kind in ("number", "degree")]
    usable = rows.where(F.col("field").isin(*kinds) & ~is_missing(F.col("raw_value")))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Units(known)
        for b in batches:
            at, codes = [], []
            for i, (name, raw, unit, quote) in enumerate(zip(b["field"], b["raw_value"], b["unit"], b["quote"])):
                got = table.standard(raw, unit, quote)
                if got:
                    value = (got[2] + got[3]) / 2e6
                else:
                    plain = table.read(raw)
                    if plain is None or plain[0] == "sum" or plain[2] is not None or unit is not None or kinds[name].kind == "degree":
                        continue
                    value = (plain[0] + plain[1]) / 2
                if kinds[name].kind == "degree":
                    code = round(value / 0.05) + CODES // 2
                elif value > 0:
                    code = round((math.log(value) + 14) / 0.008)
                else:
                    continue
                if 0 < code < CODES:
                    at.append(i)
                    codes.append(code)
            out = b[[subject, "field"]].iloc[at].reset_index(drop=True)
            out["code"] = np.array(codes, dtype=np.int32)
            yield out

    id_type = rows.schema[subject].dataType.simpleString()
    numbers = usable.where(F.col("field").isin(*numeric)).select(subject, "field", "raw_value", "unit", "quote").mapInPandas(step, f"`{subject}` {id_type}, field string, code int")
    # Measured values without any stated unit are plain numbers of unknown scale; a field whose rows mostly state units ignores them by the median.
    v = squeeze(F.col("raw_value"))
    months = [f.name for f in fields if f.kind == "month"]
    years = [f.name for f in fields if f.kind == "year"]
    digits = F.regexp_extract(v, r"^(?:0?[1-9]|1[0-2])$", 0).try_cast("int")
    month = F.coalesce(digits, month_number(F.regexp_extract(v, r"([\p{L}\p{M}]{3,})\.?$", 1)))
    year = F.regexp_extract(v, r"(?<!\d)(\d{4})(?!\d)", 1).try_cast("int")
    text = (F.pmod(F.xxhash64(fold(v)), F.lit(CODES - 1)) + 1).cast("int")
    code = F.when(F.col("field").isin(*months), month).when(F.col("field").isin(*years), F.pmod(year, F.lit(CODES - 1)) + 1).otherwise(text)
    others = usable.where(~F.col("field").isin(*numeric)).select(subject, "field", code.cast("int").alias("code")).where("code is not null")
    counted = numbers.unionByName(others).groupBy(subject, "field", "code").agg(F.count("*").alias("n"))
    best = counted.groupBy(subject, "field").agg(F.min(F.struct((-F.col("n")).alias("n"), "code"))["code"].alias("mode"), F.percentile("code", F.lit(0.5), F.col("n")).cast("int").alias("middle"))
    final = best.select(subject, place[F.col("field")].alias("at"), F.when(F.col("field").isin(*numeric), F.col("middle")).otherwise(F.col("mode")).alias("code"))
    return final.groupBy(subject).agg(F.map_from_entries(F.collect_list(F.struct("at", "code"))).alias("codes"))


def name_forms(rows: DataFrame, aliases: DataFrame, subject: str = "subject_id", name: str = "identity", page: str = "page_id") -> DataFrame:
    """(`subject`, `forms`): the comparable forms of a subject's identities and of the aliases on its pages, each once.

    Null names give none. Distinct names are taken before the shuffle, so repeated rows and hot
    subjects cost little.
    """
    own = rows.where(F.col(name).isNotNull()).select(subject, F.col(name).alias("name")).distinct()
    pages = rows.where(F.col(page).isNotNull()).select(subject, page).distinct()
    other = aliases.where(F.col("alias").isNotNull()).select(page, F.col("alias").alias("name")).distinct().join(pages, page).select(subject, "name")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [(i, f) for i, n in zip(b[subject], b["name"]) for f in forms(n)]
            yield pd.DataFrame(pairs, columns=[subject, "form"])

    id_type = rows.schema[subject].dataType.simpleString()
    return own.unionByName(other).mapInPandas(run, f"`{subject}` {id_type}, form string").distinct()


def _pack(codes: Column, slots: list[int]) -> Column:
    out = F.lit(0).cast("bigint")
    for k, s in enumerate(slots):
        out = out.bitwiseOR(F.shiftleft(F.coalesce(F.try_element_at(codes, F.lit(s)), F.lit(0)).cast("bigint"), BITS * k))
    return out


def matches(rows: DataFrame, aliases: DataFrame, units: DataFrame, fields: dict[str, list[Field]], model: Model = Model(), subject: str = "subject_id", source: str = "domain", kind: str = "entity_type") -> DataFrame:
    """(`subject_a`, `subject_b`, `confidence`), smaller first: subjects of different sources that are one thing.

    `fields` lists each entity type's attributes, at most ten. Subjects of other types, of null
    type or of null source match none. Subject ids are whole numbers; null ones match none. A subject in several sources or types takes the smallest.
    An empty table gives none. Cells of the index beyond `model.hot` rows are divided by every
    further attribute as long as that loses no match, and then met block against block.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col(subject).isNotNull())
    every = list(dict.fromkeys(f for fs in fields.values() for f in fs))
    position = {f: i for i, f in enumerate(every)}
    codes = attribute_codes(rows, units, every, subject)
    known = rows.where(F.col(kind).isin(*fields) & F.col(source).isNotNull()).groupBy(subject).agg(F.min(kind).alias("kind"), F.min(F.xxhash64(source)).alias("source"))
    packed = [None, None]
    for half in (0, 1):
        for t, fs in fields.items():
            mine = [position[f] for f in fs[half * 5 : half * 5 + 5]]
            value = _pack(F.col("codes"), mine)
            packed[half] = F.when(F.col("kind") == t, value) if packed[half] is None else packed[half].when(F.col("kind") == t, value)
    profiles = cut(known.join(codes, subject, "left").select(F.col(subject).alias("id"), "kind", "source", packed[0].alias("low"), packed[1].alias("high")))
    named = cut(name_forms(rows, aliases, subject).select(F.col(subject).alias("id"), "form").join(profiles.select("id", "kind"), "id"))
    weights, size = _weights(profiles, fields, model)
    if not size:
        return spark.createDataFrame([], f"subject_a {rows.schema[subject].dataType.simpleString()}, subject_b {rows.schema[subject].dataType.simpleString()}, confidence double")
    counted = cut(named.select("kind", "id", F.explode(F.split("form", " ")).alias("word")).where("length(word) > 2").distinct().groupBy("kind", "word").agg(F.count("*").alias("w")))
    index = Index(fields, weights, size, model)
    likely = cut(_likely(profiles, named, counted, index, model))
    return _named(likely, named, counted, size, model, rows.schema[subject].dataType.simpleString())


def _mix(*parts) -> np.ndarray:
    """A 64-bit digest of parallel integer arrays."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (np.asarray(p).astype(np.uint64) ^ out) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(29))
            out = out * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(32))
    return out.view(np.int64) if isinstance(out, np.ndarray) else out


CARRIED = ["id", "kind", "source", "low", "high"]
CELL = [*CARRIED, "key", "used", "need"]


class Index:
    """What the index and the scoring of pairs need, by number of type and attribute; a few dozen numbers.

    `gain` is the log-likelihood ratio of agreement, `loss` that of disagreement, `steps` the
    tolerance in steps of the code (0: equal or not).
    """

    def __init__(self, fields: dict[str, list[Field]], weights: dict, size: dict[str, int], model: Model):
        self.kinds, self.model = list(fields), model
        n = len(fields)
        odds = math.log(model.least / (1 - model.least))
        self.gain, self.loss, self.steps, self.size = np.zeros((n, 10)), np.zeros((n, 10)), np.zeros((n, 10), dtype=np.int64), np.ones(n)
        for t, fs in enumerate(fields.values()):
            self.size[t] = size.get(self.kinds[t], 1)
            for k, f in enumerate(fs):
                self.gain[t, k], self.loss[t, k] = weights[self.kinds[t]].get(k, (0.0, 0.0))
                self.steps[t, k] = _steps(f) if f.kind in ("number", "degree") else 0
        # Few subjects need less to be told apart: a cell may hold about three by chance, however few there are.
        self.selective = np.minimum(model.selective, np.log(self.size / 3))
        # What attributes must tell of a match: alone with names that are merely close, and beside any evidence.
        self.prior = np.log(self.size) + odds
        self.apart = self.prior - CLOSE

    @staticmethod
    def codes(b: pd.DataFrame) -> np.ndarray:
        low, high = b["low"].to_numpy(np.int64), b["high"].to_numpy(np.int64)
        return np.stack([((low if k < 5 else high) >> (BITS * (k % 5))) & (CODES - 1) for k in range(10)], axis=1)

    def grids(self, t: int, k: int) -> tuple[int, ...]:
        return (0, 1) if self.steps[t, k] else (0,)

    def cell(self, t: int, k: int, codes: np.ndarray, grid: int) -> np.ndarray:
        """Index cells of an attribute: the code itself, or for numbers a bin twice the tolerance wide on one of two grids half a bin apart."""
        step = self.steps[t, k]
        return (codes + grid * step) // (2 * step) if step else codes

    def pairs_of_chunks(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A cell for every two attributes that together tell enough."""
        for b in batches:
            codes, kinds, out = self.codes(b), b["kind"].to_numpy(), []
            for t in range(len(self.kinds)):
                for i in range(10):
                    for j in range(i + 1, 10):
                        if not self.gain[t, i] or not self.gain[t, j] or self.gain[t, i] + self.gain[t, j] < self.selective[t]:
                            continue
                        at = np.flatnonzero((kinds == t) & (codes[:, i] > 0) & (codes[:, j] > 0))
                        for g in self.grids(t, i):
                            for h in self.grids(t, j):
                                key = _mix(np.full(len(at), ((t * 10 + i) * 2 + g) * 20 + j * 2 + h), self.cell(t, i, codes[at, i], g), self.cell(t, j, codes[at, j], h))
                                out.append(b.iloc[at][CARRIED].assign(key=key, used=np.int64((1 << i) | (1 << j))))
            if out:
                yield pd.concat(out, ignore_index=True)

    def words(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A cell for every word of a name with an attribute that is no number, where both together tell enough."""
        for b in batches:
            codes, kinds, out = self.codes(b), b["kind"].to_numpy(), []
            told = np.log(self.size[kinds] / b["w"].to_numpy())
            for t in range(len(self.kinds)):
                for k in range(10):
                    if self.gain[t, k] and not self.steps[t, k]:
                        at = np.flatnonzero((kinds == t) & (codes[:, k] > 0) & (told + self.gain[t, k] >= self.selective[t]))
                        key = _mix(np.full(len(at), 1_000_000 + t * 10 + k), b["word"].to_numpy(np.int64)[at], codes[at, k])
                        out.append(b.iloc[at][CARRIED].assign(key=key, used=np.int64(1 << k)))
            if out:
                yield pd.concat(out, ignore_index=True)

    def divided(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells of hot cells by every attribute that they do not share already."""
        for b in batches:
            need = b["need"].to_numpy()
            codes, kinds, used, key, out = self.codes(b), b["kind"].to_numpy(), b["used"].to_numpy(), b["key"].to_numpy(np.int64), []
            for t in range(len(self.kinds)):
                for k in range(10):
                    if self.gain[t, k]:
                        at = np.flatnonzero((kinds == t) & (codes[:, k] > 0) & ((used >> k) & 1 == 0))
                        for g in self.grids(t, k):
                            out.append(b.iloc[at][CARRIED].assign(key=_mix(key[at], np.full(len(at), k * 2 + g), self.cell(t, k, codes[at, k], g)), used=used[at] | (1 << k), need=need[at]))
            if out:
                yield pd.concat(out, ignore_index=True)

    def meet(self, b: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """Pairs within cells whose attributes do not speak against a match, with their log-likelihood ratios."""
        n = len(b)
        codes, kinds, source, ids, side = self.codes(b), b["kind"].to_numpy(), b["source"].to_numpy(), b["id"].to_numpy(), b["side"].to_numpy()
        cell_of = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
        left_in = np.array([*starts[1:], n])[cell_of] - np.arange(n) - 1
        parts = []
        # Rows are paired with the later rows of their cell, about two million pairs at a time.
        edges = np.concatenate([[0], np.cumsum(left_in)])
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + 2_000_000, "right")) - 1)
            count = left_in[at:end]
            x = np.repeat(np.arange(at, end), count)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
            keep = (source[x] != source[y]) & ((side[x] == 0) | (side[x] != side[y]))
            x, y = x[keep], y[keep]
            total = np.zeros(len(x))
            t = kinds[x]
            for k in range(10):
                a, c = codes[x, k], codes[y, k]
                agree = np.abs(a - c) <= self.steps[t, k]
                total += np.where((a > 0) & (c > 0), np.where(agree, self.gain[t, k], self.loss[t, k]), 0.0)
            good = np.flatnonzero(total > -1.0)
            x, y = x[good], y[good]
            parts.append(pd.DataFrame({"id": np.minimum(ids[x], ids[y]), "id2": np.maximum(ids[x], ids[y]), "kind": kinds[x], "attributes": np.round(total[good], 6)}))
            at = end
        return pd.concat(parts, ignore_index=True).drop_duplicates(["id", "id2"])


def _likely(profiles: DataFrame, named: DataFrame, words: DataFrame, index: Index, model: Model) -> DataFrame:
    """(id, id2, kind, attributes): pairs that meet in a cell and whose attributes do not speak against a match.

    Every pair that scores as a match is formed if it shares a cell, whatever the cell's size. A
    cell beyond `model.hot` rows is divided by every attribute that it does not share yet where
    what it shares is too little for a match, so that a match must agree in a further one; where it
    is enough, rows go into blocks and each block meets each. Of a name form's cell the score asks
    the more the more subjects bear it; a pair of several forms is found in the rarest's cell, and
    other cells need only find pairs without a common form. Hot cells are known from
    counts that are combined before the shuffle; their keys are broadcast only up to 200,000.
    """
    number = F.create_map(*[F.lit(x) for i, t in enumerate(index.kinds) for x in (t, i)])
    id_type = profiles.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, kind int, source bigint, low bigint, high bigint, key bigint, used bigint"
    plain = profiles.select("id", number[F.col("kind")].alias("kind"), "source", "low", "high")
    whole = named.select("id", F.col("kind").alias("_kind"), "form").join(plain, "id")
    # A name form is a chunk; two attributes are; a word of a name with an attribute is, and finds names that differ elsewhere.
    forms_ = whole.select(*CARRIED, F.xxhash64("_kind", "form").alias("key"), F.lit(0).cast("bigint").alias("used"))
    each = whole.select(*CARRIED, "_kind", F.explode(F.split("form", " ")).alias("word")).where("length(word) > 2").distinct()
    told = each.join(words.where("w > 1").select(F.col("kind").alias("_kind"), "word", "w"), ["_kind", "word"]).select(*CARRIED, F.xxhash64("word").alias("word"), "w")
    per_kind = lambda v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), F.col("kind") + 1)
    attributes = plain.mapInPandas(index.pairs_of_chunks, schema).unionByName(told.mapInPandas(index.words, schema)).withColumn("need", per_kind(index.apart))
    cells = forms_.withColumn("need", F.lit(None).cast("double")).unionByName(attributes)
    shared = sum((F.when(F.getbit("used", F.lit(k)) == 1, per_kind(index.gain[:, k])).otherwise(0.0) for k in range(10)), F.lit(0.0))
    of_name = per_kind(index.prior) - F.log(F.greatest(F.lit(1.0), model.same_name * per_kind(index.size) / F.col("n")))
    calm = []
    # Each round shares one more of the ten attributes; a cell that shares all is settled.
    while True:
        hot = cut(cells.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > model.hot))
        many = hot.count()
        if not many:
            calm.append(cells.select(*CARRIED, "key", F.lit(0).alias("side")))
            break
        marked = cells.join(F.broadcast(hot) if many <= 200_000 else hot, "key", "left").withColumn("need", F.coalesce("need", of_name))
        calm.append(marked.where("n is null").select(*CARRIED, "key", F.lit(0).alias("side")))
        enough = shared >= F.col("need") - 1e-6
        calm.append(_blocks(marked.where(F.col("n").isNotNull() & enough), model.block))
        cells = marked.where(F.col("n").isNotNull() & ~enough).select(*CELL).mapInPandas(index.divided, f"{schema}, need double")
    cells = calm[0]
    for c in calm[1:]:
        cells = cells.unionByName(c)
    met = map_groups(cells, ["key"], [], index.meet, f"id {id_type}, id2 {id_type}, kind int, attributes double")
    name = F.array(*[F.lit(t) for t in index.kinds])
    return met.groupBy("id", "id2").agg(F.first("kind").alias("kind"), F.first("attributes").alias("attributes")).select("id", "id2", name[F.col("kind")].alias("kind"), "attributes")


def _blocks(cells: DataFrame, size: int) -> DataFrame:
    """Rows of cells of `n` rows in blocks of about `size`, once for every block that theirs meets; `side` tells two blocks apart."""
    placed = cells.withColumn("_of", F.ceil(F.col("n") / size)).withColumn("_mine", F.pmod(F.xxhash64("id", "key"), "_of"))
    met = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_of") - 1)))
    key = F.when(F.col("_of") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("_mine", "_other"), F.greatest("_mine", "_other")))
    return met.select(*CARRIED, key.alias("key"), F.when(F.col("_mine") == F.col("_other"), 0).when(F.col("_mine") < F.col("_other"), 1).otherwise(2).alias("side"))


def _slots() -> list[Column]:
    return [F.shiftrightunsigned(F.col("low" if k < 5 else "high"), BITS * (k % 5)).bitwiseAND(F.lit(CODES - 1)) for k in range(10)]


def _steps(f: Field) -> int:
    """The tolerance of a number in steps of its code."""
    return max(1, math.ceil(f.tolerance / (0.05 if f.kind == "degree" else 0.008)))


def _cell(code: Column, f: Field, grid: int) -> Column:
    """The index cell of a code: itself, or for numbers a bin twice the tolerance wide on one of two grids half a bin apart."""
    if f.kind not in ("number", "degree"):
        return code
    return F.floor((code + grid * _steps(f)) / (2 * _steps(f)))


def _weights(profiles: DataFrame, fields: dict[str, list[Field]], model: Model) -> tuple[dict, dict]:
    """Per type and attribute the log-likelihood ratios of agreement and disagreement, from all subjects.

    Agreement by chance is the sum of squared shares of the values (of bins, for numbers): at most
    4,095 counts for each of ten attributes of a type, aggregated before they reach the driver as
    one number each.
    """
    slot = _slots()
    codes = [F.when((F.col("kind") == t) & (slot[k] > 0), F.struct(F.lit(k).alias("k"), _cell(slot[k], f, 0).cast("bigint").alias("c"))) for t, fs in fields.items() for k, f in enumerate(fs)]
    counts = profiles.select("kind", F.explode(F.array_compact(F.array(*codes))).alias("x")).groupBy("kind", "x.k", "x.c").agg(F.count("*").alias("n"))
    chance = counts.groupBy("kind", "k").agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("u")).collect()
    size = {r["kind"]: r["n"] for r in profiles.where("kind is not null").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    out: dict = {t: {} for t in fields}
    for r in chance:
        u = min(0.5, max(r["u"], 1e-6))
        out[r["kind"]][r["k"]] = (math.log(model.same / u), math.log((1 - model.same) / (1 - u)))
    return out, size


def _named(pairs: DataFrame, named: DataFrame, words: DataFrame, size: dict[str, int], model: Model, id_type: str) -> DataFrame:
    """Pairs with the evidence of their names and the prior, as confidences of at least `model.least`."""
    common = named.groupBy("kind", "form").agg(F.count("*").alias("n"))
    rare = named.select("kind", "form", F.explode(F.split("form", " ")).alias("word")).distinct().join(words, ["kind", "word"]).groupBy("kind", "form").agg(F.min("w").alias("w"))
    wanted = pairs.select("id").union(pairs.select("id2")).distinct()
    told = named.join(wanted, "id", "left_semi").join(common, ["kind", "form"]).join(rare, ["kind", "form"], "left")
    # A subject's names travel as one text, which a worker takes apart once however many pairs it is in.
    one = F.concat_ws("|", "form", F.col("n").cast("string"), F.coalesce(F.col("w").cast("string"), F.lit("")))
    lists = told.groupBy("id").agg(F.collect_list("form").alias("forms"), F.array_join(F.array_sort(F.collect_list(one)), ";").alias("names"))
    both = pairs.join(lists, "id", "left").join(lists.select(F.col("id").alias("id2"), F.col("forms").alias("forms2"), F.col("names").alias("names2")), "id2", "left")
    # Without a shared form names add at most CLOSE; weaker pairs are dropped before Python sees them.
    prior = F.lit(0.0)
    for t, n in size.items():
        prior = F.when(F.col("kind") == t, math.log(n)).otherwise(prior)
    told_apart = (F.col("attributes") >= prior - CLOSE) | F.coalesce(F.arrays_overlap("forms", "forms2"), F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, j, t, attributes, x, y in zip(b["id"], b["id2"], b["kind"], b["attributes"], b["names"], b["names2"]):
                log_odds = attributes - math.log(size[t]) + name_evidence(x, y, size[t], model)
                p = 1 / (1 + math.exp(-max(-50.0, min(50.0, log_odds))))
                if p >= model.least:
                    out.append((i, j, round(p, 6)))
            yield pd.DataFrame(out, columns=["subject_a", "subject_b", "confidence"])

    return both.where(told_apart).select("id", "id2", "kind", "attributes", "names", "names2").mapInPandas(run, f"subject_a {id_type}, subject_b {id_type}, confidence double")


@lru_cache(maxsize=1 << 16)
def _names(text: str, limit: float) -> tuple[dict[str, int], list[str]]:
    """(form → its number of subjects, the forms with a word of at most `limit` subjects)."""
    parts = [x.split("|") for x in text.split(";")]
    return {f: int(n) for f, n, _ in parts}, [f for f, _, w in parts if w and int(w) <= limit]


def name_evidence(x: str | None, y: str | None, size: int, model: Model) -> float:
    """The log-likelihood ratio of two lists of names, each "form|its subjects|its rarest word's subjects;…".

    A shared form counts by how few subjects bear it, forms of close bit vectors somewhat less;
    names that are both made of rare words and far apart count against a match, others hardly.
    """
    if not x or not y:
        return 0.0
    limit = max(12.0, size / 150)
    mine, told = _names(x, limit)
    theirs, other = _names(y, limit)
    shared = [n for f, n in mine.items() if f in theirs]
    if shared:
        return math.log(max(1.0, model.same_name * size / min(shared)))
    if not told or not other:
        return -1.0
    closest, a, b = max((dice(bits(f), bits(g)), f, g) for f in told for g in other)
    if 0.6 <= closest < 0.8 and _worst_word(a, b) < 0.5:
        # One word in common carries the score; the other is another word, not a misspelling.
        return 0.0
    return CLOSE if closest >= 0.8 else 3.5 if closest >= 0.7 else 1.5 if closest >= 0.6 else -4.0


def _worst_word(a: str, b: str) -> float:
    """The least Dice score of a word of one form with its best counterpart in the other; 1 for unequal numbers of words."""
    x, y = a.split(), b.split()
    return min(max(dice(bits(p), bits(q)) for q in y) for p in x) if len(x) == len(y) else 1.0
