"""Quantities recorded in different units, brought to common units.

Two stages. Reading takes the number and the unit that a row states, in its value, in its
unit column or beside the same number in its quote. What no row states is inferred from the
history of its source: exact penalised changepoint search on the logarithms of the values
finds level shifts, and a shift that equals the ratio of two known factors of the quantity
is a change of unit and is reversed.
"""

from __future__ import annotations

import math
import os
import pickle
import tempfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.quantity import Units
from cairnframe.operators.groups import starts

def unit_rows(units: DataFrame) -> list[tuple]:
    """The unit table on the driver. It is a reference table; more than 100,000 rows are refused."""
    rows = units.select("quantity", "unit", "base_unit", "factor", "unit_offset").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("a unit table of more than 100,000 rows is not a reference table")
    return [tuple(r) for r in rows if r["unit"] and r["factor"] is not None]


def read_quantities(rows: DataFrame, units: DataFrame, keep: list[str], value: str = "raw_value", unit: str = "unit", quote: str = "quote") -> DataFrame:
    """`keep` columns of each row whose quantity can be read, with the quantity in its base unit.

    Adds `quantity`, `base_unit`, `lo_micro` and `hi_micro` (millionths of the base unit, to the
    nearest whole number; a single value twice). The unit in `value` counts; if there is none, the
    one in `unit`; if that is null or blank, the one that follows the same number in `quote`. Rows
    with a null, blank or unreadable value, without any unit or with one outside `units` come out
    of no row. Repeated rows stay repeated; other columns are ignored. One narrow pass, no shuffle.
    """
    known = unit_rows(units)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Units(known)
        for b in batches:
            got = [table.standard(*x) for x in zip(b[value], b[unit], b[quote])]
            hit = [i for i, x in enumerate(got) if x]
            out = b[keep].iloc[hit].reset_index(drop=True)
            for k, name in enumerate(("quantity", "base_unit", "lo_micro", "hi_micro")):
                out[name] = pd.Series([got[i][k] for i in hit], dtype="object" if k < 2 else "int64")
            yield out

    columns = list(dict.fromkeys([*keep, value, unit, quote]))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    texts = rows.select(*columns).where(F.col(value).rlike(r"[\p{Nd}½¼¾⅓⅔⅛⅜⅝⅞]"))
    return texts.mapInPandas(read, f"{schema}, quantity string, base_unit string, lo_micro bigint, hi_micro bigint")


def with_numbers(rows: DataFrame, units: DataFrame, keep: list[str], value: str = "raw_value", unit: str = "unit", quote: str = "quote") -> DataFrame:
    """Every row's `keep` columns with `value_num` and `value_max`, its number or range in the base unit of what it states.

    Units are found as in `read_quantities`; a number without any stands as it is written, one of an
    unknown unit is no number. `value_max` is null for a single value, both are null where no
    number can be read. One narrow pass, no shuffle.
    """
    known = unit_rows(units)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Units(known)
        for b in batches:
            low, high = np.full(len(b), None, dtype=object), np.full(len(b), None, dtype=object)
            for i, (raw, u, q) in enumerate(zip(b[value], b[unit], b[quote])):
                got = table.standard(raw, u, q)
                if got:
                    ends = got[2] / 1e6, got[3] / 1e6
                else:
                    plain = table.read(raw) if raw else None
                    if plain is None or plain[0] == "sum" or plain[2] is not None or plain[5] or (u and u.strip()):
                        continue
                    ends = min(plain[:2]), max(plain[:2])
                low[i], high[i] = ends[0], ends[1] if ends[1] > ends[0] else None
            yield b[keep].assign(value_num=pd.Series(low, index=b.index, dtype="float64"), value_max=pd.Series(high, index=b.index, dtype="float64"))

    columns = list(dict.fromkeys([*keep, value, unit, quote]))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*columns).mapInPandas(read, f"{schema}, value_num double, value_max double")


def changepoints(values: np.ndarray, penalty: float) -> list[int]:
    """Ends of the segments of the exact penalised least-squares segmentation.

    Minimises the sum over segments of squared distances to the segment's mean plus `penalty`
    per segment; see `Search`.
    """
    return _segment(np.ones(len(values)), values, values**2, penalty)


class Search:
    """`changepoints` of a stream: nothing but the starts that can still win is held.

    Functional pruning: every start of the last segment keeps the levels (intervals of the
    segment's mean) at which it costs less than all others. One without any level can never win
    again, so no optimum is lost; a few starts are left at any time, however long the stream.
    """

    def __init__(self, penalty: float):
        self.penalty, self.at, self.size, self.total, self.square = penalty, 0, 0.0, 0.0, 0.0
        # A start: cost before it, sums before it, place; then the mean, and the radius of its levels, of the present step.
        self.starts = [[0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0]]
        self.pieces = [(-math.inf, math.inf, self.starts[0])]

    def add(self, count: float, total: float, square: float) -> int:
        """Where the last segment begins in the best segmentation up to this item, which stands for `count` values."""
        size, sum_, squares = self.size + count, self.total + total, self.square + square
        self.at, self.size, self.total, self.square = self.at + 1, size, sum_, squares
        best, first = math.inf, 0
        for x in self.starts:
            n, s = size - x[1], sum_ - x[2]
            x[5] = s / n
            x[6] = x[0] + max(squares - x[3] - s * x[5], 0.0)
            if x[6] < best:
                best, first = x[6], x[4]
        limit = best + self.penalty
        for x in self.starts:
            x[6] = math.sqrt((limit - x[6]) / (size - x[1])) if x[6] <= limit else -1.0
        new = [limit, size, sum_, squares, self.at, 0.0, 0.0]
        pieces, free = [], None
        for lo, hi, x in self.pieces:
            a, b = max(lo, x[5] - x[6]), min(hi, x[5] + x[6])
            if x[6] < 0 or a >= b:
                free = lo if free is None else free
                continue
            if free is not None or a > lo:
                pieces.append((lo if free is None else free, a, new))
            pieces.append((a, b, x))
            free = b if b < hi else None
        if free is not None:
            pieces.append((free, math.inf, new))
        self.pieces = pieces
        alive = {id(x): x for _, _, x in pieces}
        self.starts = sorted(alive.values(), key=lambda x: x[4])
        return first


def _segment(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, penalty: float) -> list[int]:
    """`changepoints` of items that each stand for `counts` values of the given sums, which stay together."""
    search = Search(penalty)
    came = [search.add(*x) for x in zip(counts.tolist(), sums.tolist(), squares.tolist())]
    ends, t = [], len(came)
    while t:
        ends.append(t)
        t = came[t - 1]
    return ends[::-1]


def log_ratios(factors: np.ndarray) -> np.ndarray:
    """Natural logarithms of the ratios of any two factors, each once, in order."""
    return np.unique(np.round(np.log(factors[:, None] / factors[None, :]).ravel(), 9))


def reversal(shift: float, ratios: np.ndarray, tolerance: float) -> float:
    """The factor of the known ratio nearest to a level shift, or 1 where none is within `tolerance`."""
    k = int(np.argmin(np.abs(ratios - shift)))
    known = abs(ratios[k]) > 1e-9 and abs(ratios[k] - shift) <= tolerance and abs(ratios[k] - shift) < abs(shift)
    return math.exp(ratios[k]) if known else 1.0


class History:
    """One history's readings as they come in time order, and then the factor of each; a reading takes 40 bytes in `arrays`."""

    def __init__(self, penalty: float):
        self.search, self.first, self.total, self.said = Search(penalty), None, 0.0, 0

    def add(self, values: np.ndarray, stated: np.ndarray) -> np.ndarray:
        """Of each usable reading where its last segment begins so far, and the running sums of logarithms and of stated readings."""
        usable = np.isfinite(values) & (values > 0)
        logs = np.log(values[usable])
        if self.first is None and len(logs):
            self.first = float(logs[0])
        out = np.empty(len(logs), dtype=[("came", "i8"), ("total", "f8"), ("said", "i8")])
        for i, (x, states) in enumerate(zip(logs.tolist(), stated[usable].tolist())):
            x -= self.first
            self.total, self.said = self.total + x, self.said + states
            out[i] = self.search.add(1.0, x, x * x), self.total, self.said
        return out


def settled(arrays: np.ndarray, onto: np.ndarray, out: np.ndarray, factors: np.ndarray, tolerance: float) -> None:
    """Writes into `out` the factor by which each usable reading of a history must be multiplied.

    `arrays` are those of `History`; `onto` is room for the segments' ends. From the first segment
    that holds stated readings, in their absence the longest (ties: the earliest), levels go to
    both ends. A segment that states its unit sets the level. One that is off by a known ratio
    (within `tolerance` in natural logarithms) is brought back by it; any other shift is a real
    change, and its level is the next one's measure.
    """
    arrays, ratios = np.asarray(arrays), log_ratios(factors)
    came, total, said = arrays["came"], arrays["total"], arrays["said"]

    def facts(a: int, b: int) -> tuple[float, bool]:
        return float(total[b - 1] - (total[a - 1] if a else 0.0)) / (b - a), bool(said[b - 1] > (said[a - 1] if a else 0))

    b = len(came)
    while b:
        a = int(came[b - 1])
        onto[a], b = b, a
    start, longest, a = 0, 0, 0
    while a < len(came):
        b = int(onto[a])
        if facts(a, b)[1]:
            start = a
            break
        if b - a > longest:
            start, longest = a, b - a
        a = b
    for ahead in (True, False):
        a, b = start, int(onto[start])
        level = facts(a, b)[0]
        while True:
            mid, states = facts(a, b)
            factor = 1.0 if states else reversal(level - mid, ratios, tolerance)
            if factor == 1.0:
                level = mid
            out[a:b] = factor
            if ahead and b < len(came):
                a, b = b, int(onto[b])
            elif not ahead and a:
                a, b = int(came[a - 1]), a
            else:
                break


def undo_unit_changes(values: np.ndarray, stated: np.ndarray, factors: np.ndarray, penalty: float, tolerance: float) -> np.ndarray:
    """The factor by which each reading of a history, in time order, must be multiplied; see `settled`."""
    out = np.ones(len(values))
    arrays = History(penalty).add(values, stated)
    if len(arrays) > 1:
        shift = np.ones(len(arrays))
        settled(arrays, np.zeros(len(arrays), dtype=np.int64), shift, factors, tolerance)
        out[np.isfinite(values) & (values > 0)] = shift
    return out


def unit_histories(rows: DataFrame, units: DataFrame, by: list[str], row_id: str = "candidate_id", at: str = "at", value: str = "raw_value", unit: str = "unit", quote: str = "quote", penalty: float = 0.5, tolerance: float = 0.08, window: int = 4096, margin: int = 64) -> DataFrame:
    """Every reading that holds a number, with unstated and changed units put right.

    `by` names one source history (for instance subject and field), `at` its time order. Rows
    that state a unit are read as in `read_quantities` and keep what they state; the rest start in
    the base unit of their history's stated quantity and are brought back where their segment is
    off by a known ratio. Histories in which no row states a unit have no quantity and come out
    unchanged with `base_unit` null. Rows without a number come out of no row; a null `at` counts
    as earliest; ties in time are ordered by `row_id`.

    Returns `by`, `row_id`, `base_unit`, `value`, `unit_shift`, `stated`, and of stated rows
    `lo_micro` and `hi_micro`.

    Every history is searched whole, by one exact search over its readings in time order, however
    many there are. The search needs what came before, so a history is one task's work; it streams
    through that task: of one of more than `window` readings what was read is put down on the
    worker's local disk until the last reading has come, so neither a hot history nor equal or
    null times swell memory. `window` sets where readings wait, no result; `margin` is without
    effect and only accepted.
    """
    known = unit_rows(units)
    logs = {}
    for quantity, _, _, factor, offset in known:
        if not offset and factor > 0:
            logs.setdefault(quantity, set()).add(float(factor))
    logs = {q: np.array(sorted(f)) for q, f in logs.items()}

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Units(known)
        for b in batches:
            got = []
            for x in zip(b[value], b[unit], b[quote]):
                read = table.standard(*x)
                if read:
                    got.append((read[0], read[1], (read[2] + read[3]) / 2e6, True, read[2], read[3]))
                else:
                    plain = table.read(x[0])
                    bare = plain is not None and plain[0] != "sum" and plain[2] is None and not plain[5]
                    got.append((None, None, (plain[0] + plain[1]) / 2, False, 0, 0) if bare else None)
            hit = [i for i, g in enumerate(got) if g]
            out = b[[*by, row_id, at]].iloc[hit].reset_index(drop=True)
            for k, (name, kind) in enumerate((("quantity", "object"), ("base_unit", "object"), ("number", "float64"), ("stated", "bool"), ("lo_micro", "int64"), ("hi_micro", "int64"))):
                out[name] = pd.Series([got[i][k] for i in hit], dtype=kind)
            yield out

    types = {c: rows.schema[c].dataType.simpleString() for c in [*by, row_id, at]}
    kept = ", ".join(f"`{c}` {types[c]}" for c in [*by, row_id, at])
    read_ = "quantity string, base_unit string, number double, stated boolean, lo_micro bigint, hi_micro bigint"
    readings = (
        rows.select(*dict.fromkeys([*by, row_id, at, value, unit, quote]))
        .where(F.col(value).rlike(r"[\p{Nd}½¼¾⅓⅔⅛⅜⅝⅞]"))
        .mapInPandas(number, f"{kept}, {read_}")
    )
    facts = ["base_unit", "value", "unit_shift", "stated", "lo_micro", "hi_micro"]

    def told(b: pd.DataFrame, base: np.ndarray, shift: np.ndarray) -> pd.DataFrame:
        return b[[*by, row_id, "stated", "lo_micro", "hi_micro"]].assign(base_unit=base, value=b["number"].to_numpy(float) * shift, unit_shift=shift)[[*by, row_id, *facts]]

    def repair(b: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        number, stated, quantity, base = b["number"].to_numpy(float), b["stated"].to_numpy(bool), b["quantity"].to_numpy(), b["base_unit"].to_numpy(object, copy=True)
        shift = np.ones(len(b))
        for i, j in zip(first, [*first[1:], len(b)]):
            if not stated[i:j].all():
                kind, base[i:j][~stated[i:j]] = _most(_counted(quantity[i:j])), _most(_counted(base[i:j]))
                if j - i > 1:
                    shift[i:j] = np.where(stated[i:j], 1.0, undo_unit_changes(number[i:j], stated[i:j], logs.get(kind, np.ones(1)), penalty, tolerance))
        return told(b, base, shift)

    def put_right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, long_ = None, None
        for b in (x.iloc[k : k + window] for x in batches for k in range(0, len(x), window)):
            # Of a long history `rest` is the last row only, to tell whether it goes on.
            b = pd.concat([rest, b], ignore_index=True) if rest is not None else b.reset_index(drop=True)
            first = starts(b, by)
            if long_ is not None:
                end = first[1] if len(first) > 1 else len(b)
                long_.add(b.iloc[1:end])
                if end == len(b):
                    rest = b.iloc[-1:]
                    continue
                yield from long_.put_right(logs, tolerance, told)
                long_, b, first = None, b.iloc[end:], first[1:] - end
            if len(first) > 1:
                yield repair(b.iloc[: first[-1]], first[:-1])
            rest = b.iloc[first[-1] :]
            if len(rest) > window:
                long_ = _Spool(penalty)
                long_.add(rest)
                rest = rest.iloc[-1:]
        if long_ is not None:
            yield from long_.put_right(logs, tolerance, told)
        elif rest is not None:
            yield repair(rest, np.zeros(1, dtype=np.int64))

    schema = ", ".join(f"`{c}` {types[c]}" for c in [*by, row_id]) + ", base_unit string, value double, unit_shift double, stated boolean, lo_micro bigint, hi_micro bigint"
    out = readings.repartition(*by).sortWithinPartitions(*by, at, row_id, "number", "stated").mapInPandas(put_right, schema)
    return out.withColumns({c: F.when(F.col("stated"), F.col(c)) for c in ("lo_micro", "hi_micro")})


class _Spool:
    """A history that is too long for memory: its readings, and the arrays of its search, on the worker's disk."""

    def __init__(self, penalty: float):
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.folder = folder if os.path.isdir(folder) else None
        self.rows, self.arrays, self.n = tempfile.TemporaryFile(dir=self.folder), tempfile.TemporaryFile(dir=self.folder), 0
        self.history, self.kinds, self.bases = History(penalty), Counter(), Counter()

    def add(self, b: pd.DataFrame) -> None:
        if not len(b):
            return
        pickle.dump(b, self.rows)
        got = self.history.add(b["number"].to_numpy(float), b["stated"].to_numpy(bool))
        self.arrays.write(got.tobytes())
        self.n += len(got)
        self.kinds.update(_counted(b["quantity"]))
        self.bases.update(_counted(b["base_unit"]))

    def put_right(self, logs: dict, tolerance: float, told: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with self.rows, self.arrays, tempfile.TemporaryFile(dir=self.folder) as ends, tempfile.TemporaryFile(dir=self.folder) as factors:
            self.arrays.flush()
            shift = np.ones(self.n)
            if self.n > 1:
                room = {"mode": "w+", "shape": (self.n,)}
                shift = np.memmap(factors, dtype="f8", **room)
                settled(np.memmap(self.arrays, dtype=[("came", "i8"), ("total", "f8"), ("said", "i8")], mode="r", shape=(self.n,)), np.memmap(ends, dtype="i8", **room), shift, logs.get(_most(self.kinds), np.ones(1)), tolerance)
            base, at, length = _most(self.bases), 0, self.rows.tell()
            self.rows.seek(0)
            while self.rows.tell() < length:
                b = pickle.load(self.rows)
                x, stated = b["number"].to_numpy(float), b["stated"].to_numpy(bool)
                usable, factor = np.isfinite(x) & (x > 0), np.ones(len(b))
                factor[usable] = shift[at : at + int(usable.sum())]
                at += int(usable.sum())
                yield told(b, np.where(stated, b["base_unit"].to_numpy(object), base), np.where(stated, 1.0, factor))


def _counted(values: Iterable[str | None]) -> Counter:
    return Counter(v for v in values if v is not None)


def _most(counts: Counter) -> str | None:
    """The most frequent text, ties going to the smallest; None where there is none."""
    return min(counts, key=lambda v: (-counts[v], v), default=None)
