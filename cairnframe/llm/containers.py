"""Items of varying length filled into containers of fixed capacity.

Items are spread at random over blocks of about `per_block` containers' worth, and each block is
divided by Karmarkar–Karp multiway differencing: partial partitions are merged, the two of
largest imbalance first, with opposing order, which leaves windows of nearly equal sums. A
block begins with the fewest windows that could hold it; whenever a window exceeds the capacity
the number of windows rises.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.operators.groups import map_groups
from cairnframe.session import cut


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of `sizes` in `windows` subsets of nearly equal sums (largest differencing first; ties by order)."""
    heap = []
    zero = np.zeros(windows, dtype=np.int64)
    for i, s in enumerate(sizes):
        sums = zero.copy()
        sums[-1] = s
        heap.append((-int(s), i, sums, {windows - 1: [i]}))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, i, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        # a ascends, so b is added in descending order; positions of b's members turn with it.
        total = a + b[::-1]
        order = np.argsort(total, kind="stable")
        place = np.empty(windows, dtype=np.int64)
        place[order] = np.arange(windows)
        total = total[order]
        total -= total[0]
        members: dict[int, list[int]] = {}
        for k, m in x.items():
            members[int(place[k])] = m
        for k, m in y.items():
            at = int(place[windows - 1 - k])
            members[at] = members[at] + m if at in members else m
        n += 1
        heapq.heappush(heap, (-int(total[-1]), n, total, members))
    return [*heap[0][3].values()] if heap else []


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """`difference` with the fewest windows, rising one by one, of which none exceeds `capacity`."""
    windows = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        out = difference(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return out
        windows += 1


def containers(items: DataFrame, capacity: int, item: str = "doc_id", size: str = "tokens", per_block: int = 160) -> DataFrame:
    """(`item`, `copy`, `part`, `size`, `container`): every item in a container of `capacity`.

    An item is whole (part 0) unless it is longer than a container; then its full containers are
    parts 0, 1, … and the remainder is packed like any other item. An item of size 0 or null goes
    into a container without taking space. Repeated rows are items of their own, numbered by
    `copy`. No container's sum exceeds the capacity. An empty table gives none.

    Blocks depend on a digest of item, copy and part only, so no value of the data can swell one;
    the corpus contributes one number, its total size.
    """
    copies = cut(items.groupBy(F.col(item), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("n")).agg(F.count("*").alias("copies")))
    numbered = copies.select(item, "n", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    parts = numbered.select(item, "copy", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1))).alias("part"))
    sized = parts.select(item, "copy", F.col("part").cast("bigint").alias("part"), F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("bigint").alias(size))
    rest = F.when(F.col("n") % capacity > 0, F.col("n") % capacity).otherwise(0)
    total = copies.agg(F.sum(rest * F.col("copies")), F.sum("copies")).first()
    blocks = max(1, math.ceil((total[0] or 0) / (per_block * capacity)), math.ceil((total[1] or 0) / (per_block * 64)))
    key = F.xxhash64(F.col(item), F.col("copy"), F.col("part"))
    placed = sized.withColumn("block", F.pmod(key, F.lit(blocks)))
    def pack(b: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        sizes, out = b[size].to_numpy(), np.zeros(len(b), dtype=np.int64)
        block = b["block"].to_numpy()
        for i, j in zip(starts, [*starts[1:], len(b)]):
            mine = [k for k in range(i, j) if sizes[k] > 0]
            for w, window in enumerate(fill([int(sizes[k]) for k in mine], capacity)):
                out[[mine[k] for k in window]] = w
        return b[[item, "copy", "part", size]].assign(container=[f"{x}-{w}" for x, w in zip(block, out)])

    kind = items.schema[item].dataType.simpleString()
    # A block is little data but much work, so tasks are made by the number of blocks, not by bytes.
    partitions = min(blocks, max(items.sparkSession.sparkContext.defaultParallelism * 2, -(-blocks // 32)))
    open_ = map_groups(placed.where(F.col(size) < capacity), ["block"], [item, "copy", "part"], pack, f"`{item}` {kind}, copy bigint, part bigint, `{size}` bigint, container string", partitions)
    # A part that fills a container needs no packing; the container is named after it.
    full = placed.where(F.col(size) == capacity).select(item, "copy", "part", size, F.concat_ws("-", F.lit("full"), F.col(item), "copy", "part").alias("container"))
    return open_.unionByName(full)
