"""Byte-level BPE of a whole corpus with a public tokenizer's vocabulary.

Forced boundaries: a pair of bytes that stands side by side in no token of the vocabulary can
never be merged across, so a word of the text is cut at every such pair, the fragments are
encoded independently and their ids concatenated. Very long words thus fall into short pieces,
and fragments, being few and short, are remembered.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The vocabulary file's place is a parameter; this is where the public tokenizers are installed.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut into words before byte pairs are merged: a fixed pattern of the public tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBPE:
    """Ranks of a vocabulary, and its table of byte pairs that occur inside tokens."""

    def __init__(self, path: str, words: str = WORDS, remembered: int = 1 << 18):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.inside = np.zeros((256, 256), dtype=bool)
        for token in self.ranks:
            codes = np.frombuffer(token, dtype=np.uint8)
            self.inside[codes[:-1], codes[1:]] = True
        self.words = regex.compile(words)
        self.remembered, self.known = remembered, {}

    def fragments(self, word: bytes) -> list[bytes]:
        """`word` cut at its forced boundaries."""
        codes = np.frombuffer(word, dtype=np.uint8)
        cuts = np.flatnonzero(~self.inside[codes[:-1], codes[1:]]) + 1
        if not len(cuts):
            return [word]
        ends = [0, *cuts.tolist(), len(word)]
        return [word[a:b] for a, b in zip(ends, ends[1:])]

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of a fragment: the pair of lowest rank is merged first, the leftmost of equals, until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(fragment)) is not None:
            return [whole]
        n = len(fragment)
        part = [fragment[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(fragment[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = after[i]
            # An entry is stale if either part was merged away or has grown since.
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = b""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(part[i] + part[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, size + len(part[after[i]])))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + size))
        return [ranks[p] for p in part if p]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; none for an empty or null text."""
        out: list[int] = []
        known = self.known
        for word in self.words.findall(text) if text else ():
            ids = known.get(word)
            if ids is None:
                ids = [i for fragment in self.fragments(word.encode("utf-8", "surrogatepass")) for i in self.merge(fragment)]
                if len(known) >= self.remembered:
                    known.clear()
                if len(word) <= 64:
                    known[word] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBPE:
    """One vocabulary per Python worker and file."""
    return ByteBPE(path)


def encoded(documents: DataFrame, path: str = BYTE_BPE_50K, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(`doc`, `ids`) of every row: token ids as a list of integers, the empty list for an empty or null text.

    One narrow pass over whole texts, no shuffle; repeated rows stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            flat, ends = [], [0]
            for t in b.column(1):
                flat.append(np.array(bpe.encode(t.as_py()), dtype=np.int64))
                ends.append(ends[-1] + len(flat[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.array([], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[doc, "ids"])

    kind = documents.schema[doc].dataType.simpleString()
    return documents.select(doc, text).mapInArrow(run, f"`{doc}` {kind}, ids array<bigint>")


def token_counts(documents: DataFrame, path: str = BYTE_BPE_50K, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(`doc`, `tokens`) of every row; the ids themselves leave no Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(bpe.encode(t.as_py())) for t in b.column(1)], pa.int64())], names=[doc, "tokens"])

    kind = documents.schema[doc].dataType.simpleString()
    return documents.select(doc, text).mapInArrow(run, f"`{doc}` {kind}, tokens bigint")


def decoded(ids: list[int], path: str = BYTE_BPE_50K) -> str:
    """The text of ids, for round trips."""
    bpe = vocabulary(path)
    back = bpe.__dict__.setdefault("_back", {v: k for k, v in bpe.ranks.items()})
    return b"".join(back[i] for i in ids).decode("utf-8")
