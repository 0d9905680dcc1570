"""Text decoded with the wrong character encoding: found, and restored where nothing was lost.

Adjacent characters are scored by the corpus: the pointwise mutual information of the pair,
counted over all documents. Pairs inside runs that read as UTF-8 in some encoding are left out of
the counts, so that garbling, which repeats the same characters again and again, cannot make its
own pairs look natural. Improbable runs are isolated as maximum-scoring segments of the pairs'
improbability, and inverse mappings, strict byte for byte, are tested inside those runs only. A
mapping stands where it makes the run and its surroundings more probable, by the surprise of
character classes (scripts and kinds of signs with their case), which the corpus also counts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Single-byte encodings that text is wrongly decoded with, in order of preference where several fit alike.
ENCODINGS = ("cp1252", "latin_1", "mac_roman", "cp1251", "cp437", "cp850", "iso8859_15", "cp1250", "iso8859_2", "cp1254", "cp1257", "koi8_r", "cp1253", "cp866", "cp852", "iso8859_5", "cp1256", "cp1255", "cp858", "mac_cyrillic")
#: Encodings of two bytes a character, for runs that hold East Asian characters.
WIDE = ("gbk", "big5", "shift_jis")
#: Single-byte encodings that are taken for one another: what the text was read as, and what it was.
READ_AS = ("cp1252", "latin_1", "mac_roman", "cp1251", "cp1250", "koi8_r", "cp437", "cp850")
WAS = ("cp1250", "cp1251", "cp1252", "iso8859_2", "koi8_r", "iso8859_5", "cp1253", "cp1254", "cp1257", "mac_roman", "cp850", "cp437", "cp866", "mac_cyrillic")
CLASSES = 64
#: Buckets of the hashed counts of character pairs and of characters.
BUCKETS, SIGNS = 1 << 18, 1 << 16
REPLACED = "�"
#: The improbability of a pair of plain ASCII.
PLAIN = -4.0


def _tables() -> dict[str, dict[str, int]]:
    """Character → byte from 0x80 on, for each single-byte encoding; bytes that it leaves undefined stand for themselves."""
    out = {}
    for name in ENCODINGS:
        table = {}
        for b in range(0x80, 0x100):
            try:
                c = bytes([b]).decode(name)
            except UnicodeDecodeError:
                c = chr(b)
            if len(c) == 1 and ord(c) > 0x7F:
                table.setdefault(c, b)
        out[name] = table
    return out


TABLES = _tables()
#: Characters that some encoding takes for the first byte of a character of two bytes or more.
LEADS = frozenset(c for table in TABLES.values() for c, b in table.items() if 0xC2 <= b <= 0xF4)
FOREIGN = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=1 << 16)
def kind(c: str) -> int:
    """The class of a character: below 64, by script and case for letters, by category for the rest."""
    o = ord(c)
    cat = unicodedata.category(c)
    if o < 0x80:
        return 1 if cat == "Ll" else 2 if cat == "Lu" else 3 if cat == "Nd" else 4 if c.isspace() else 5
    if 0x80 <= o < 0xA0:
        return 6
    case = 1 if cat == "Lu" else 0
    if cat[0] in "LM":
        for k, (low, high) in enumerate(((0xC0, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x900, 0x97F), (0x980, 0xDFF), (0xE00, 0xFFF), (0x600, 0x6FF), (0x590, 0x5FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0x1E00, 0x1EFF))):
            if low <= o <= high:
                return 8 + 2 * k + case
        return 34 + case
    return {"Sm": 36, "Sc": 37, "Sk": 38, "So": 39, "Pi": 40, "Pf": 41, "Pd": 42, "Po": 43, "Ps": 44, "Pe": 45, "No": 46, "Nd": 47, "Zs": 48, "Cf": 49}.get(cat, 50)


def _bucket(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (((x.astype(np.uint64) * np.uint64(0x9E3779B1) + y.astype(np.uint64) * np.uint64(0x85EBCA77)) >> np.uint64(7)) % np.uint64(BUCKETS)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@dataclass(frozen=True)
class Counts:
    """What the corpus tells: class pairs (64 × 64), and character pairs beyond ASCII and their characters, hashed."""

    classes: np.ndarray
    pairs: np.ndarray
    signs: np.ndarray


def pair_counts(documents: DataFrame, text: str = "text") -> Counts:
    """Counts over all documents of adjacent characters, those of runs that some encoding inverts left out.

    The sizes are fixed, whatever the corpus (331,776 numbers), so they come to the driver. Every
    partition sends its sums; null texts count nothing.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(CLASSES * CLASSES + BUCKETS + SIGNS, dtype=np.int64)
        known = np.full(0x110000, -1, dtype=np.int8)
        for b in batches:
            codes = _codes(whole := "\n".join(b[text]))
            if len(codes) < 2:
                continue
            for c in np.unique(codes[known[codes] < 0]):
                known[c] = kind(chr(c))
            natural = np.ones(len(codes) - 1, dtype=bool)
            for f in FOREIGN.finditer(whole):
                if inverses(f[0]):
                    natural[max(0, f.start() - 1) : f.end()] = False
            classes = known[codes].astype(np.int64)
            sums[: CLASSES * CLASSES] += np.bincount((classes[:-1] * CLASSES + classes[1:])[natural], minlength=CLASSES * CLASSES)
            foreign = natural & ((codes[:-1] > 127) | (codes[1:] > 127))
            x, y = codes[:-1][foreign], codes[1:][foreign]
            sums[CLASSES * CLASSES : -SIGNS] += np.bincount(_bucket(x, y), minlength=BUCKETS)
            # Each pair counts both of its characters, so the shares of characters are those among such pairs.
            sums[-SIGNS:] += np.bincount(x % SIGNS, minlength=SIGNS) + np.bincount(y % SIGNS, minlength=SIGNS)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"cell": at, "n": sums[at]})

    total = documents.where(F.col(text).isNotNull()).select(text).mapInPandas(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES * CLASSES + BUCKETS + SIGNS)
    for r in total.collect():
        out[r["cell"]] = r["n"]
    return Counts(out[: CLASSES * CLASSES].reshape(CLASSES, CLASSES), out[CLASSES * CLASSES : -SIGNS], out[-SIGNS:])


class Scores:
    """Tables of pairs out of corpus counts.

    `odd` of two adjacent characters is above 0 if their mutual information is low: the less often
    than expected they meet, the higher, and `novel` more for pairs whose share of all is below
    `rare`, which by themselves tell nothing of dependence. Pairs of plain ASCII never are odd.
    `surprise` is −ln P(next | class), smoothed; `rarity` −ln of a pair's share.
    """

    def __init__(self, counts: Counts, margin: float = 1.0, novel: float = 2.0, rare: float = 2e-6):
        self.pairs, self.total = counts.pairs, counts.pairs.sum() + 1
        share = (counts.pairs + 0.5) / (self.total + BUCKETS / 2)
        self.rarity = -np.log(share)
        self.usual = float((share * self.rarity).sum())
        self.log_pairs = np.log(counts.pairs + 0.5)
        self.signs = counts.signs / 2
        self.margin = margin
        self.bonus = np.where(counts.pairs < 1 + rare * self.total, novel, 0.0)
        classes = counts.classes
        total, left, right = classes.sum() + 1, classes.sum(1), classes.sum(0)
        self.surprise = -np.log((classes + 0.5) / (left[:, None] + CLASSES / 2))
        # A class that the corpus never shows is as surprising as one character in all of it.
        self.surprise[:, right == 0] = np.maximum(self.surprise[:, right == 0], math.log(total + CLASSES))
        self.surprise[left == 0, :] = np.maximum(self.surprise[left == 0, :], math.log(total + CLASSES))

    def odd(self, codes: np.ndarray) -> np.ndarray:
        """The improbability of each pair of adjacent characters."""
        return self.scored(codes)[0]

    def scored(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The improbability of each pair of adjacent characters and its rarity, which is 0 for plain ASCII."""
        x, y = codes[:-1], codes[1:]
        odd, rarity = np.full(len(x), PLAIN), np.zeros(len(x))
        at = np.flatnonzero((x > 127) | (y > 127))
        x, y = x[at], y[at]
        cell = _bucket(x, y)
        expected = self.signs[x % SIGNS] * self.signs[y % SIGNS] / self.total
        odd[at] = np.log(expected + 0.5) - self.log_pairs[cell] - self.margin + self.bonus[cell]
        rarity[at] = self.rarity[cell]
        return odd, rarity

    def cost(self, classes: list[int]) -> float:
        return sum(self.surprise[x, y] for x, y in zip(classes, classes[1:]))


def maximal_segments(scores: list[float]) -> list[tuple[int, int]]:
    """[start, end) of the maximum-scoring segments: each of positive sum, none extensible without loss, in one sweep (Ruzzo–Tompa)."""
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum through
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low = i, before
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= total:
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, i + 1, low, total))
    return [(a, b) for a, b, _, _ in stack]


def segments(text: str, scores: Scores, odd: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(start, end) of each run of foreign characters that a maximum-scoring segment of the text's pairs touches."""
    odd = scores.odd(_codes(text)) if odd is None else odd
    if not (odd > 0).any():
        return []
    # Pair i joins characters i and i + 1; a stretch between pairs of plain ASCII is swept if it holds a positive pair.
    touched = np.zeros(len(text), dtype=bool)
    breaks = np.flatnonzero(odd == PLAIN)
    edges = np.concatenate([[-1], breaks, [len(odd)]])
    for k in np.unique(np.searchsorted(breaks, np.flatnonzero(odd > 0))):
        a, b = edges[k] + 1, edges[k + 1]
        for i, j in maximal_segments(odd[a:b].tolist()):
            touched[a + i : a + j + 1] = True
    return [f.span() for f in FOREIGN.finditer(text) if touched[f.start() : f.end()].any()]


def invert(run: str, encoding: str) -> str | None:
    """The text whose UTF-8 bytes were read as `run` in `encoding`, or None if there is none."""
    try:
        if encoding in WIDE:
            return run.encode(encoding).decode("utf-8")
        table = TABLES[encoding]
        return bytes([table[c] for c in run]).decode("utf-8")
    except (KeyError, UnicodeError):
        return None


@lru_cache(maxsize=1 << 16)
def inverses(run: str) -> tuple[tuple[str, str], ...]:
    """(encoding, text) for each encoding that inverts a run of foreign characters."""
    tried = (ENCODINGS if run[0] in LEADS and len(run) > 1 else ()) + (WIDE if any(c >= "\u2e80" for c in run) else ())
    return tuple((name, text) for name in tried if (text := invert(run, name)) is not None and text != run)


@lru_cache(maxsize=256)
def _swap(read_as: str, was: str) -> dict[int, str | None]:
    """Characters beyond ASCII of one encoding as those of another with the same bytes."""
    back = {b: c for c, b in TABLES[was].items()}
    return {ord(c): back[b] for c, b in TABLES[read_as].items() if b in back}


def reread(text: str, scores: Scores) -> str | None:
    """The text read in the single-byte encoding it was written in, if it was read in another, or None.

    Tried where at least a fifth of its foreign runs are improbable, or its character pairs are on
    average a nat rarer than the corpus's, and every foreign character exists in the wrong
    encoding. The pair of encodings stands that makes the character pairs most common in the
    corpus, if they gain at least half a nat each.
    """
    odd, rarity = scores.scored(_codes(text))
    before, n = float(rarity.sum()), int((odd != PLAIN).sum())
    foreign = FOREIGN.findall(text)
    if before < (scores.usual + 1.0) * n and 5 * len(segments(text, scores, odd)) < len(foreign):
        return None
    best, least = None, before - 0.5 * n
    signs = {ord(c) for run in foreign for c in run}
    for read_as in READ_AS:
        for was in WAS:
            table = _swap(read_as, was) if read_as != was and read_as in TABLES and was in TABLES else None
            if table is None or not signs <= table.keys():
                continue
            fixed = text.translate(table)
            now = float(scores.scored(_codes(fixed))[1].sum())
            if fixed != text and now < least:
                best, least = fixed, now
    return best


def _gains(text: str, a: int, b: int, scores: Scores) -> dict[str, tuple[float, str]]:
    """By encoding, how much more probable the run [a, b) gets with its neighbours when it is undone, and what it gets to be.

    A run garbled several times is followed through its stages, which need not look natural; each
    is shorter than the one before, so there is a last.
    """
    before, after, run = text[max(0, a - 1) : a], text[b : b + 1], text[a:b]
    out: dict[str, tuple[float, str]] = {}
    cost = None
    for name, now in inverses(run):
        cost = scores.cost([kind(c) for c in before + run + after]) if cost is None else cost
        while now is not None:
            gain = cost - scores.cost([kind(c) for c in before + now + after])
            if gain > out.get(name, (0.0, ""))[0]:
                out[name] = gain, now
            now = invert(now, name) if not now.isascii() else None
    return out


def restore(text: str, scores: Scores, odd: np.ndarray | None = None) -> tuple[str, bool]:
    """The text with garbled runs restored, repeatedly for text that was garbled more than once, and whether any was.

    Of each isolated run every inverse mapping is tried; it fits if the inverse with its
    neighbours is more probable than the run with its own. The encoding of most gain over the
    isolated runs restores those that it fits; ties go to the first of `ENCODINGS`. Every round
    shortens the text, so there is a last.
    """
    changed = False
    while runs := segments(text, scores, odd):
        odd, fits, total = None, [], {}
        for a, b in runs:
            if gains := _gains(text, a, b, scores):
                fits.append((a, b, gains))
                for name, (gain, _) in gains.items():
                    total[name] = total.get(name, 0.0) + gain
        if not fits:
            break
        name = max(total, key=lambda n: (total[n], -_ORDER[n]))
        out, at = [], 0
        for a, b, gains in fits:
            if name in gains:
                out += [text[at:a], gains[name][1]]
                at = b
        text, changed = "".join(out) + text[at:], True
    if not changed and (fixed := reread(text, scores)) is not None:
        return fixed, True
    return text, changed


_ORDER = {name: i for i, name in enumerate(ENCODINGS + WIDE)}


def repaired(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(`doc`, `restored`, `lost`) of each garbled document; `restored` is null where characters are lost.

    Two passes: the corpus counts, then one narrow pass that scores whole batches at once,
    isolates and inverts. Null and empty texts are never garbled. A text with U+FFFD has lost
    characters.
    """
    counts = documents.sparkSession.sparkContext.broadcast(pair_counts(documents, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(counts.value)
        for b in batches:
            rows, at = [], 0
            whole = _codes("\n".join(b[text]))
            odd, rarity = scores.scored(whole)
            for i, t in zip(b[doc], b[text]):
                mine = slice(at, at + max(0, len(t) - 1))
                at += len(t) + 1
                # A text without an improbable pair and of usual rarity is natural throughout.
                if t.isascii() or not ((odd[mine] > 0).any() or rarity[mine].sum() >= (scores.usual + 1.0) * (odd[mine] != PLAIN).sum()):
                    if REPLACED in t:
                        rows.append((i, None, True))
                    continue
                fixed, changed = restore(t, scores, odd[mine])
                if REPLACED in fixed:
                    rows.append((i, None, True))
                elif changed:
                    rows.append((i, fixed, False))
            yield pd.DataFrame(rows, columns=[doc, "restored", "lost"])

    id_type = documents.schema[doc].dataType.simpleString()
    return documents.where(F.col(text).isNotNull()).select(doc, text).mapInPandas(run, f"`{doc}` {id_type}, restored string, lost boolean")


def restored_hashes(repaired_: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(`doc`, `restored_hash`): the first 32 hex digits of SHA-256 of the restored text, empty where characters are lost."""
    return repaired_.select(doc, F.coalesce(F.substring(F.sha2(F.encode("restored", "UTF-8"), 256), 1, 32), F.lit("")).alias("restored_hash"))
