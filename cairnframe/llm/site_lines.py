"""Lines and blocks of lines that a site repeats in many of its documents.

Every document is a sequence of line identifiers (digests of the case-folded words of a line,
within its domain). Equal prefixes of the domain's suffixes are found as in a suffix array built
by prefix doubling: suffixes are first grouped by one identifier, those that stand in too few
documents fall out, and the rest are grouped by 2, 4, 8 … identifiers; the longest common prefix
that enough documents share is then closed in on by halving steps. Groups are told by a digest
of the prefix, which any worker can compute from its own document, so that what is shuffled are
digests to be counted and no domain is gathered anywhere. There is no longest block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.text import fold
from cairnframe.session import bucket_count, bucketed, cut

#: An odd base of the digests' polynomial modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: So many digests are broadcast at most (16 bytes each); beyond that the join is shuffled.
FEW = 200_000


def line_words(line: Column) -> Column:
    """What two lines must share to be the same: letters, marks and digits without case; others only part words."""
    return F.trim(F.regexp_replace(fold(line), r"[^\p{L}\p{M}\p{Nd}]+", " "))


def suffixes(pages: DataFrame, page: str = "page_id", domain: str = "domain", text: str = "text") -> DataFrame:
    """(`page`, `v`, `k`, `line_no`, `h`, `g`): the line identifier at each position, two digests of domain and words.

    `line_no` counts from 1, blank lines included; `k` counts lines that hold letters or digits
    only, others, null texts and null domains have no identifier. `v` tells several texts of one
    page apart.
    """
    words = F.filter(F.transform(F.split(text, "\n"), lambda line, i: F.struct((i + 1).alias("line_no"), line_words(line).alias("words"))), lambda x: x["words"] != "")
    lines = pages.where(F.col(text).isNotNull() & F.col(domain).isNotNull()).select(page, F.col(domain).alias("_site"), F.xxhash64(text).alias("v"), F.posexplode(words).alias("k", "x"))
    return lines.select(page, "v", "k", F.col("x.line_no").cast("bigint").alias("line_no"), F.xxhash64("_site", "x.words").alias("h"), F.hash("x.words", "_site").alias("g"))


def repeated(rows: DataFrame, key: list[str], page: str, least: int) -> DataFrame:
    """Keys that stand in at least `least` different documents, with their number.

    Documents are counted distinct in two steps, first by (key, document) and then by key with
    partial counts, so that a line of a third of all documents burdens no single task.
    """
    counts = cut(rows.groupBy(*key).agg(F.count_distinct(page).alias("documents")).where(F.col("documents") >= least))
    return F.broadcast(counts) if counts.count() <= FEW else counts


def _flat(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The documents of a batch end to end: document, position, identifier, and the end of the run of neighbouring positions."""
    sizes = b["k"].map(len).to_numpy()
    doc = np.repeat(np.arange(len(b)), sizes)
    k, h = np.concatenate(b["k"].to_list()), np.concatenate(b["h"].to_list())
    last = np.append((k[1:] != k[:-1] + 1) | (doc[1:] != doc[:-1]), True)
    ends = np.flatnonzero(last) + 1
    return doc, k, h, ends[np.searchsorted(ends, np.arange(len(k)), "right")]


def _digests(h: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from positions and lengths to digests of the identifiers there; equal blocks have equal digests wherever they stand.

    A digest is a polynomial modulo 2^64, taken from running sums of identifiers times powers of
    `BASE` and shifted back by powers of its inverse.
    """
    with np.errstate(over="ignore"):
        powers, inverse = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(h), x, dtype=np.uint64))]) for x in (BASE, INVERSE))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h.astype(np.uint64) * powers[:-1])])

    def digest(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (sums[at + length] - sums[at]) * inverse[at] + length.astype(np.uint64)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return (x ^ (x >> np.uint64(29))).view(np.int64)

    return digest


def repeated_blocks(pages: DataFrame, least: int = 8, page: str = "page_id", domain: str = "domain", text: str = "text") -> DataFrame:
    """Maximal repeated blocks: (`page`, `first_line`, `lines`, `line_nos`).

    At each position that begins a repeated line the block is the longest run of lines, passing
    over those without letters or digits, that at least `least` different documents of the domain
    hold; blocks that lie inside one begun earlier are left out, so every repeated line is in one
    block at least, be it its only line. `line_nos` are the numbers of the block's lines. Null
    texts and domains have no blocks; several texts of one page are one document.

    Lines of no use are dropped by the first count, prefixes of 2, 4, 8 … lines counted by the
    second. Every further round tests one longer prefix at each position, by steps of half the
    size down to one line, so a longest block of n lines takes about log₂ n rounds. Positions that
    already hold a longer block don't test a shorter one; for all of them one position of each
    different block witnesses its prefixes, so the work on a long block doesn't grow with the
    number of documents that hold it.
    """
    kind = pages.schema[page].dataType.simpleString()
    rows = suffixes(pages, page, domain, text)
    lines = rows.join(repeated(rows, ["h", "g"], page, least).select("h", "g"), ["h", "g"])
    documents = lines.groupBy(page, "v").agg(F.array_sort(F.collect_set(F.struct("k", "line_no", "h"))).alias("s")).select(page, "v", *[F.col(f"s.{c}").alias(c) for c in ("k", "line_no", "h")])
    stored = pages.sparkSession.table(bucketed(documents, "site_lines", bucket_count(pages), page))
    schema = f"`{page}` {kind}, v bigint, k int, x int, n int, digest bigint, witness boolean"

    def prefixes(b: pd.DataFrame, doc: np.ndarray, k: np.ndarray, at: np.ndarray, before: np.ndarray, length: np.ndarray, digest: np.ndarray, witness: bool) -> pd.DataFrame:
        return pd.DataFrame({page: b[page].to_numpy()[doc[at]], "v": b["v"].to_numpy()[doc[at]], "k": k[at], "x": before.astype(np.int32), "n": length.astype(np.int32), "digest": digest, "witness": witness})

    def powers_of_two(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                doc, k, h, end = _flat(b)
                digest, at, n = _digests(h), np.arange(len(k)), 2
                while len(at := at[at + n <= end[at]]):
                    size = np.full(len(at), n)
                    yield prefixes(b, doc, k, at, size // 2, size, digest(at, size), False)
                    n *= 2

    def longer(step: int) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                doc, k, h, end = _flat(b)
                digest, now = _digests(h), _lengths(b, doc, k)
                # Twice a power of two was counted before, so a block only grows by less than its length.
                at = np.flatnonzero((np.arange(len(k)) + now + step <= end) & (now > step))
                yield prefixes(b, doc, k, at, now[at], now[at] + step, digest(at, now[at] + step), False)
                told = [(i + np.searchsorted(ks, j), n, x) for i, ks, leads in zip(_firsts(b), b["k"], b["leads"]) if leads is not None for j, x, m in leads for n in range(x + step, m, 2 * step)]
                if told:
                    at, n, x = np.array(told, dtype=np.int64).T
                    yield prefixes(b, doc, k, at, x, n, digest(at, n), True)

        return run

    def kept(candidates: DataFrame) -> DataFrame:
        """The candidates whose prefix enough documents hold; `lead` marks one position of each different prefix."""
        groups = candidates.groupBy("digest").agg(F.count_distinct(page).alias("documents"), F.max("witness").alias("seen"), F.min(F.when(~F.col("witness"), F.struct(page, "v", "k"))).alias("first"))
        counts = cut(groups.where(f"first is not null and (seen or documents >= {least})").select("digest", "first"))
        joined = candidates.where("not witness").join(F.broadcast(counts) if counts.count() <= FEW else counts, "digest")
        return cut(joined.select(page, "v", "k", "x", "n", (F.struct(page, "v", "k") == F.col("first")).alias("lead")))

    def state(found: DataFrame, *columns: str) -> DataFrame:
        return stored.select(page, "v", "k", "h", *columns).join(_by_document(found, page), [page, "v"], "left")

    found = kept(stored.select(page, "v", "k", "h").mapInPandas(powers_of_two, schema))
    step = (found.agg(F.max("n")).first()[0] or 1) // 2
    while step >= 1:
        found = found.unionByName(kept(state(found).mapInPandas(longer(step), schema)))
        step //= 2

    def maximal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            doc, k, _, _ = _flat(b)
            now, numbers, out, reach, before = _lengths(b, doc, k), np.concatenate(b["line_no"].to_list()), [], -1, -1
            for i in range(len(k)):
                if doc[i] != before:
                    before, reach = doc[i], -1
                if i + now[i] > reach:
                    reach = i + now[i]
                    out.append((b[page].iloc[doc[i]], numbers[i], now[i], numbers[i:reach].tolist()))
            yield pd.DataFrame(out, columns=[page, "first_line", "lines", "line_nos"])

    return state(found, "line_no").mapInPandas(maximal, f"`{page}` {kind}, first_line bigint, lines int, line_nos array<bigint>")


def _by_document(found: DataFrame, page: str) -> DataFrame:
    """One row per document: where blocks of more than one line begin (`at`), their lengths (`now`), and the prefixes that it leads.

    `leads` holds (position, length before, length) of each prefix that a document witnesses.
    """
    best = found.groupBy(page, "v", "k").agg(F.max("n").alias("n"), F.array_compact(F.collect_list(F.when(F.col("lead") & (F.col("n") - F.col("x") > 1), F.array("k", "x", "n")))).alias("led"))
    s = best.groupBy(page, "v").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("s"), F.flatten(F.collect_list("led")).alias("leads"))
    return s.select(page, "v", F.col("s.k").alias("at"), F.col("s.n").alias("now"), "leads")


def _firsts(b: pd.DataFrame) -> np.ndarray:
    """Where each document begins among the positions of a batch."""
    sizes = b["k"].map(len).to_numpy()
    return np.cumsum(sizes) - sizes


def _lengths(b: pd.DataFrame, doc: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The length of the block at each position, as far as known; 1 where none is."""
    out, first = np.ones(len(k), dtype=np.int64), [*_firsts(b), len(k)]
    for d, (at, n) in enumerate(zip(b["at"], b["now"])):
        if at is not None:
            mine = slice(first[d], first[d + 1])
            out[mine][np.searchsorted(k[mine], at)] = n
    return out


def repeated_lines(pages: DataFrame, least: int = 8, page: str = "page_id", domain: str = "domain", text: str = "text") -> DataFrame:
    """(`page`, `line_no`) of each line of a repeated block, which are the lines that stand on at least `least` pages of their domain."""
    return repeated_blocks(pages, least, page, domain, text).select(page, F.explode("line_nos").alias("line_no")).distinct()


def without_lines(pages: DataFrame, lines: DataFrame, page: str = "page_id", text: str = "text") -> DataFrame:
    """`pages` with the given (`page`, `line_no`) lines deleted from `text`; null texts stay null."""
    drop_ = lines.groupBy(page).agg(F.collect_set(F.col("line_no").cast("int")).alias("_drop"))
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.coalesce("_drop", F.array().cast("array<int>")), i + 1))
    return pages.join(drop_, page, "left").withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(kept, "\n"))).drop("_drop")
