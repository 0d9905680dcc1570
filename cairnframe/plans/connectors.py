"""Lookups of entities in services, over cached answers: what to ask, within which limits, and what the answers say.

Nothing here opens a connection. `requests` says which keys a service has still to be asked;
whoever may use the network stores the answers by key, and `answers` reads them in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the answers of a connector are: a value of a field, other names, an identifier, or a check of a value.
KINDS = ("value", "alias", "identifier", "check")


@dataclass(frozen=True)
class Connector:
    """A service: which entities it knows, what it needs, and how its answers are read.

    `read` takes one answer's text and gives its values as texts; an answer it fails on gives none.
    """

    name: str
    kind: str
    entities: tuple[str, ...]
    inputs: tuple[str, ...]
    read: Callable[[str], list[str]]
    target: str | None = None
    daily_cap: int = 1000
    licence: str | None = None


@dataclass(frozen=True)
class Use:
    """A project's choice of connectors, and the entity types that each may look at (all of its own if none are named)."""

    names: tuple[str, ...]
    scope: dict[str, tuple[str, ...]] = field(default_factory=dict)


def wanted(connectors: list[Connector], use: Use) -> list[tuple[Connector, tuple[str, ...]]]:
    """The connectors in use with the entity types they are asked about."""
    out = []
    for c in connectors:
        if c.name in use.names:
            kinds = tuple(k for k in c.entities if k in use.scope.get(c.name, c.entities))
            if kinds:
                out.append((c, kinds))
    return out


def located(records: DataFrame, places: DataFrame, place: str = "place") -> DataFrame:
    """`records` with `latitude` and `longitude`: their own, else those of the place they name, in any case."""
    known = places.select(F.lower(F.trim("name")).alias("_k"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")).dropDuplicates(["_k"])
    both = records.withColumn("_k", F.lower(F.trim(F.col(place)))).join(known, "_k", "left")
    own = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return both.withColumns({"latitude": F.when(own, F.col("latitude")).otherwise(F.col("_lat")), "longitude": F.when(own, F.col("longitude")).otherwise(F.col("_lon"))}).drop("_k", "_lat", "_lon")


def request_key(connector: Connector) -> Column:
    """The key under which an answer is cached: the connector and its inputs, in one spelling."""
    return F.concat_ws("\u001f", F.lit(connector.name), *[F.lower(F.trim(F.col(c).cast("string"))) for c in connector.inputs])


def keyed(records: DataFrame, connector: Connector, kinds: tuple[str, ...]) -> DataFrame:
    """Records of the given types that have all inputs of a connector, with their `key`."""
    mine = records.where(F.col("entity_type").isin(*kinds))
    for c in connector.inputs:
        mine = mine.where(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    return mine.withColumn("key", request_key(connector))


def requests(records: DataFrame, connector: Connector, kinds: tuple[str, ...], cache: DataFrame, used_today: int = 0) -> DataFrame:
    """(`key`, inputs) that are not cached yet, each once, as many as the day's cap leaves; the rest wait for another day."""
    open_ = keyed(records, connector, kinds).select("key", *connector.inputs).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    return open_.orderBy("key").limit(max(0, connector.daily_cap - used_today))


def answers(records: DataFrame, connector: Connector, kinds: tuple[str, ...], cache: DataFrame) -> DataFrame:
    """(`entity_id`, `connector`, `kind`, `name`, `value`): what the cached answers say of the records, each value once."""
    read = connector.read

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, answer in zip(b["key"], b["answer"]):
                try:
                    out += [(key, str(v)) for v in read(answer) if v not in (None, "")]
                except Exception:  # an answer that cannot be read says nothing
                    continue
            yield pd.DataFrame(out, columns=["key", "value"])

    mine = cache.where(F.col("answer").isNotNull() & F.startswith("key", F.lit(connector.name + "\u001f")))
    # Every different answer is read once, however many records share its key.
    told = mine.select("key", "answer").mapInPandas(run, "key string, value string")
    asked = keyed(records, connector, kinds).select("entity_id", "key")
    return asked.join(told, "key").select("entity_id", F.lit(connector.name).alias("connector"), F.lit(connector.kind).alias("kind"), F.lit(connector.target).alias("name"), "value").distinct()


def attribution(connectors: list[Connector], found: DataFrame) -> list[str]:
    """The licence lines of the services whose answers are in a dataset."""
    have = {r["connector"] for r in found.select("connector").distinct().collect()}
    return [f"{c.name}: {c.licence}" for c in connectors if c.name in have and c.licence]
