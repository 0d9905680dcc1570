"""Entities out of names: exact keys, aliases and registry ids first, then close names."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cairnframe.functions.standard import comparison_key, script
from cairnframe.operators.groups import map_groups
from cairnframe.session import cut, ship

CLOSE, DENSE, PIECE = 0.92, 400, 1 << 15
#: Comparisons that are made at once.
WHOLE = 1 << 18
#: A key's part in a cell: compared with all others, or with those of the other side.
LEFT, RIGHT, BOTH = 0, 1, 2
#: Bits of a key's mask for the space and each letter: how many of it are told apart.
_BITS = (2, *(3 if c in "aeilnorstu" else 2 for c in "abcdefghijklmnopqrstuvwxyz"))


def block_keys(key: Column) -> Column:
    """Two keys under which close names meet: all digits with the first three, and with the last three letters."""
    digits = F.regexp_replace(key, "[^0-9]", "")
    letters = F.regexp_replace(key, "[^a-z]", "")
    return F.array_distinct(F.array(F.concat(F.lit("a"), digits, F.lit(":"), F.substring(letters, 1, 3)), F.concat(F.lit("z"), digits, F.lit(":"), F.substring(letters, -3, 3))))


def _ratio(threshold: float):
    """Similarities of pairs that reach the threshold; two cheap upper bounds spare most full comparisons."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, y in zip(b["key"], b["earlier"]):
                m = difflib.SequenceMatcher(None, x, y)
                out.append(m.ratio() if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold else 0.0)
            yield b.assign(similarity=out)

    return run


def _masks(keys: list[str]) -> np.ndarray:
    """Two 64-bit masks a key: its letters as counts in unary, and which pairs of neighbouring letters it has.

    Taking one letter away changes one bit of the first at most, and three of the second.
    """
    n = len(keys)
    sizes = np.fromiter(map(len, keys), np.int64, n)
    code = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(n), sizes)
    # Digits are the same within a block, so they have no bits.
    held = (code < 48) | (code > 57)
    counts = np.bincount(row[held] * len(_BITS) + np.where(code < 128, code & 31, code)[held] % len(_BITS), minlength=n * len(_BITS)).reshape(n, -1)
    masks, bit = np.zeros((n, 2), np.uint64), 0
    for c, most in enumerate(_BITS):
        for least in range(1, most + 1):
            masks[:, 0] |= (counts[:, c] >= least).astype(np.uint64) << np.uint64(bit)
            bit += 1
    if n:
        both = row[1:] == row[:-1]
        place = ((code[:-1] * 31 + code[1:]) * 0x9E3779B1 >> 12) % 64
        np.bitwise_or.at(masks[:, 1], row[1:][both], np.uint64(1) << place[both].astype(np.uint64))
    return masks


def _met(sizes: np.ndarray, letters: np.ndarray, left: np.ndarray, right: np.ndarray | None, spare: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs, left with right (without right: each pair of left once), whose letters differ by no more than `spare` of both lengths.

    Both sides are ordered by length, so a threshold holds for a whole stretch of one length against another.
    """
    own = right is None
    right = left if own else right
    a, b = letters[left], letters[right]
    if len(a) * len(b) <= WHOLE:
        most = np.floor(np.add.outer(sizes[left], sizes[right]) * spare + 1e-9)
        i, j = np.nonzero(np.bitwise_count(np.bitwise_xor.outer(a, b)) <= most)
        apart = i < j if own else slice(None)
        yield left[i[apart]], right[j[apart]]
        return
    ends = np.unique(sizes[right])
    for size in np.unique(sizes[left]):
        first, last = np.searchsorted(sizes[left], [size, size + 1])
        for other in ends:
            most = int(np.floor((size + other) * spare + 1e-9))
            if abs(size - other) > most or (own and other < size):
                continue
            low, high = np.searchsorted(sizes[right], [other, other + 1])
            step = max(1, WHOLE // int(high - low))
            for at in range(first, last, step):
                to = min(at + step, last)
                start = at if own and other == size else low
                i, j = np.nonzero(np.bitwise_count(np.bitwise_xor.outer(a[at:to], b[start:high])) <= most)
                i, j = i + at, j + start
                apart = i < j if own else slice(None)
                yield left[i[apart]], right[j[apart]]


def _cell_pairs(threshold: float):
    """Work on whole cells: pairs of keys whose letters and pairs of letters allow the threshold, the later key first."""
    spare = 1 - threshold

    def work(b: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        keys, seq, side, sizes = b["key"].to_numpy(), b["seq"].to_numpy(), b["side"].to_numpy(), b["size"].to_numpy()
        masks, found = _masks(list(keys)), []
        for start, end in zip(first, np.append(first[1:], len(b))):
            rows = np.arange(start, end)
            pairs = (rows, None) if side[start] == BOTH else (rows[side[start:end] == LEFT], rows[side[start:end] == RIGHT])
            for i, j in _met(sizes, masks[:, 0], *pairs, spare):
                most = 3 * np.floor((sizes[i] + sizes[j]) * spare + 1e-9)
                near = (np.bitwise_count(masks[i, 1] ^ masks[j, 1]) <= most) & (seq[i] != seq[j])
                found.append(np.stack([i[near], j[near]]))
        i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        later, earlier = np.where(seq[i] > seq[j], i, j), np.where(seq[i] > seq[j], j, i)
        return pd.DataFrame({"entity_type": b["entity_type"].to_numpy()[later], "key": keys[later], "earlier": keys[earlier], "earlier_seq": seq[earlier]})

    return work


def near_pairs(keyed: DataFrame, threshold: float = CLOSE, piece: int = PIECE) -> DataFrame:
    """(`entity_type`, `key`, `earlier`, `earlier_seq`): pairs that meet in a block and may reach the threshold, once for each block.

    `keyed` has entity_type, key (distinct) and seq. A block of over 400 keys is divided by the keys' lengths in
    steps, of which a close pair is at most one apart, and each step into pieces of at most about `piece` keys; each
    piece meets the pieces of its own and of the neighbouring step, so a task's cell is bounded and no pair is left out.
    """
    ship(keyed.sparkSession)
    size = F.greatest(F.length("key"), F.lit(1))
    # A ratio of the threshold allows the longer key (2 − threshold) / threshold times the length of the shorter, the length rule three times.
    step = F.floor(F.log(size.cast("double")) / F.lit(math.log((2 - threshold) / max(threshold, 0.5) + 1e-6))).cast("int")
    blocks = keyed.select("entity_type", "key", "seq", size.alias("size"), step.alias("step"), F.explode(block_keys(F.col("key"))).alias("block"))
    counted = blocks.groupBy("entity_type", "block", "step").agg(F.count("*").alias("n"))
    pieces = F.map_from_entries(F.collect_list(F.struct("step", F.ceil(F.col("n") / piece).cast("int"))))
    sized = counted.groupBy("entity_type", "block").agg(F.sum("n").alias("n"), pieces.alias("pieces")).where("n > 1")
    cells = """case when n <= {dense} then array(named_struct('cell', '', 'side', {both})) else flatten(array(
        transform(sequence(0, pieces[step] - 1), q -> named_struct('cell', concat_ws(':', step, least(p, q), step, greatest(p, q)), 'side', case when p = q then {both} when p < q then {left} else {right} end)),
        if(map_contains_key(pieces, step + 1), transform(sequence(0, pieces[step + 1] - 1), q -> named_struct('cell', concat_ws(':', step, p, step + 1, q), 'side', {left})), array()),
        if(map_contains_key(pieces, step - 1), transform(sequence(0, pieces[step - 1] - 1), q -> named_struct('cell', concat_ws(':', step - 1, q, step, p), 'side', {right})), array()))) end"""
    placed = blocks.join(sized, ["entity_type", "block"]).withColumn("p", F.expr("cast(pmod(xxhash64(key), pieces[step]) as int)"))
    met = placed.select("entity_type", "block", "key", "seq", "size", F.expr(f"inline({cells.format(dense=DENSE, both=BOTH, left=LEFT, right=RIGHT)})"))
    # The rows are few and their pairs many, so tasks are not left to be joined by their bytes.
    tasks = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), keyed.sparkSession.sparkContext.defaultParallelism)
    return map_groups(met, ["entity_type", "block", "cell"], ["size"], _cell_pairs(threshold), "entity_type string, key string, earlier string, earlier_seq bigint", tasks)


def close_names(names: DataFrame, threshold: float = CLOSE) -> DataFrame:
    """(`entity_type`, `key`, `earlier`, `similarity`): each key's most similar earlier key at or above the threshold.

    `names` has entity_type, key and seq (its first appearance). Keys meet in blocks, where bit masks leave the
    pairs whose letters may reach the threshold; lengths (a difference of at most a quarter, or two) and edits
    are looked at next, and similarity is computed in Arrow batches on the pairs that are left.
    """
    keyed = names.groupBy("entity_type", "key").agg(F.min("seq").cast("bigint").alias("seq")).where("seq is not null")
    longest = F.greatest(F.length("key"), F.length("earlier"))
    near = F.abs(F.length("key") - F.length("earlier")) <= F.greatest(F.lit(2), F.floor(longest * 0.25))
    # A ratio of the threshold leaves at most (1 − threshold) of both lengths unmatched, and the edit distance is no larger.
    edits = F.levenshtein("key", "earlier") <= F.floor((F.length("key") + F.length("earlier")) * (1 - threshold) + 1e-9)
    met = near_pairs(keyed, threshold).where(near & edits).distinct()
    scored = met.mapInPandas(_ratio(threshold), "entity_type string, key string, earlier string, earlier_seq bigint, similarity double").where(F.col("similarity") >= threshold)
    best = scored.groupBy("entity_type", "key").agg(F.max(F.struct("similarity", (-F.col("earlier_seq")).alias("s"), "earlier")).alias("b"))
    return best.select("entity_type", "key", F.col("b.earlier").alias("earlier"), F.col("b.similarity").alias("similarity"))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two texts are, 0 to 1 (ratio of matching blocks); null with a null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def canonical_keys(names: DataFrame, threshold: float = CLOSE, fuzzy: bool = True, rounds: int = 20) -> DataFrame:
    """(`entity_type`, `key`, `root`): every key with the earliest key it attaches to, link by link.

    Links always lead to earlier keys, so following them ends; the pointers are doubled until
    nothing moves, with the lineage cut each round.
    """
    keys = names.select("entity_type", "key").distinct()
    if not fuzzy:
        return keys.withColumn("root", F.col("key"))
    links = close_names(names, threshold).select("entity_type", "key", F.col("earlier").alias("root"))
    current = cut(keys.join(links, ["entity_type", "key"], "left").withColumn("root", F.coalesce("root", "key")))
    for _ in range(rounds):
        up = current.select("entity_type", F.col("key").alias("root"), F.col("root").alias("above"))
        moved = cut(current.join(up, ["entity_type", "root"]).select("entity_type", "key", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
        current = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return current


def resolve(candidates: DataFrame, aliases: DataFrame | None = None, identifiers: DataFrame | None = None, threshold: float = CLOSE, fuzzy: bool = True) -> DataFrame:
    """`candidates` (entity_type, identity, seq, …) with `entity_id` and `canonical_name`.

    Order of evidence: the same comparison key, a known alias (entity_type, alias, identity), the
    same registry identifier (entity_type, name, authority, identifier), a close earlier name. The
    first spelling in `seq` names the entity. A null or blank identity has no entity.
    """
    # Names repeat over many rows, so keys are made of each spelling once.
    spelled = candidates.where("identity is not null").groupBy("entity_type", "identity").agg(F.min("seq").alias("seq")).withColumn("key", comparison_key(F.col("identity"))).where("key != ''")
    if aliases is not None:
        by_alias = aliases.select("entity_type", comparison_key(F.col("alias")).alias("key"), comparison_key(F.col("identity")).alias("_to")).where("key != _to").groupBy("entity_type", "key").agg(F.min("_to").alias("_to"))
        spelled = spelled.join(by_alias, ["entity_type", "key"], "left").withColumn("key", F.coalesce("_to", "key")).drop("_to")
    if identifiers is not None:
        ids = identifiers.select("entity_type", comparison_key(F.col("name")).alias("key"), "authority", "identifier")
        one = ids.groupBy("entity_type", "authority", "identifier").agg(F.min("key").alias("_to"))
        same = ids.join(one, ["entity_type", "authority", "identifier"]).groupBy("entity_type", "key").agg(F.min("_to").alias("_to"))
        spelled = spelled.join(same, ["entity_type", "key"], "left").withColumn("key", F.coalesce("_to", "key")).drop("_to")
    if fuzzy:
        spelled = cut(spelled)
    roots = canonical_keys(spelled.select("entity_type", "key", "seq"), threshold, fuzzy)
    rooted = spelled.join(roots, ["entity_type", "key"])
    names = rooted.groupBy("entity_type", "root").agg(F.min_by("identity", "seq").alias("canonical_name"))
    found = rooted.join(names, ["entity_type", "root"]).select("entity_type", "identity", "canonical_name", F.xxhash64("entity_type", "root").alias("entity_id"))
    return candidates.join(found, ["entity_type", "identity"], "left")


def alias_rows(names: DataFrame) -> DataFrame:
    """(`entity_id`, alias, language, script): each alias once per entity and language."""
    return names.where(F.trim(F.col("alias")) != "").select("entity_id", "alias", F.coalesce("language", F.lit("")).alias("language")).distinct().withColumn("script", script(F.col("alias")))


def first_seen(rows: DataFrame, by: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """`rows` numbered in order within `by`; for small groups such as the values of one page."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
