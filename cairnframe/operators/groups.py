"""Imperative work on small, bounded groups without a pandas call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, partitions: int | None = None) -> DataFrame:
    """Rows of `work(batch, starts)` over batches of whole groups.

    Rows are shuffled by `keys` and sorted by `keys` and `order` (nulls first); a batch holds
    whole groups, `starts` their first positions. A group stays in memory, so callers bound its
    size beforehand.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            if not len(b):
                continue
            b = pd.concat([rest, b], ignore_index=True) if rest is not None else b
            first = starts(b, keys)
            if len(first) > 1:
                cut = first[-1]
                yield work(b.iloc[:cut], first[:-1])
                rest = b.iloc[cut:]
            else:
                rest = b
        if rest is not None and len(rest):
            rest = rest.reset_index(drop=True)
            yield work(rest, starts(rest, keys))

    shuffled = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return shuffled.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def starts(b: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where a new group begins; nulls equal nulls."""
    new = np.zeros(len(b), dtype=bool)
    new[0] = True
    for k in keys:
        v = b[k]
        same = (v.values[1:] == v.values[:-1]) | (v.isna().values[1:] & v.isna().values[:-1])
        new[1:] |= ~np.asarray(same, dtype=bool)
    return np.flatnonzero(new)
