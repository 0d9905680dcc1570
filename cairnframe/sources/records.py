"""Scans of files and records into landing pages and their fields.

Every record becomes a page row and attribute–value rows, whatever format it came in. Formats
that Spark reads itself are read by Spark; the rest are parsed from whole files, one task a file.
"""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = {".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json", ".txt": "text", ".md": "text", ".docx": "docx", ".xlsx": "xlsx", ".pdf": "pdf", ".parquet": "parquet", ".xml": "feed", ".rss": "feed", ".atom": "feed"}
FIELDS = "url string, name string, value string"


def guess_type(location: str) -> str:
    """The kind of a source by its address or suffix."""
    low = location.lower().split("?")[0]
    if low.startswith("osm:"):
        return "osm"
    suffix = re.search(r"\.[a-z]+$", low)
    kind = SUFFIXES.get(suffix[0]) if suffix else None
    if low.startswith(("http://", "https://")):
        return kind if kind in ("csv", "pdf", "feed") else "feed" if re.search(r"(?:/feed|/rss|/atom)/?$", low) else "api" if kind == "json" or "/api/" in low else "website"
    return kind or ("folder" if low.endswith("/") or not suffix else "file")


def column_map(columns: list[str], fields: list[str], given: dict[str, str] | None = None) -> dict[str, str]:
    """Source column → field: as given, else by name without case, blanks and underscores alike."""
    same = lambda s: re.sub(r"[\s_]+", " ", s.strip().lower())
    known = {same(f): f for f in fields}
    return {c: (given or {}).get(c) or known[same(c)] for c in columns if (given or {}).get(c) or same(c) in known}


def read_csv(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A delimited file with a header, all columns text; the separator goes by the suffix."""
    sep = separator or ("\t" if path.lower().endswith(".tsv") else ",")
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿")) if df.columns else df


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """Records of a JSON file: a list, one object, or an object with `records`, `results` or `data`."""
    df = spark.read.option("multiLine", not (lines if lines is not None else path.endswith(".jsonl"))).json(path)
    for wrapper in ("records", "results", "data"):
        if df.columns == [wrapper] or wrapper in df.columns and isinstance(df.schema[wrapper].dataType, T.ArrayType):
            return df.select(F.inline(wrapper))
    return df


def flat_columns(schema: T.StructType, prefix: str = "") -> list[Column]:
    """Nested columns by dotted names; lists of plain values joined by "; ", other lists as JSON."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        c = F.col(".".join(f"`{p}`" for p in name.split(".")))
        if isinstance(f.dataType, T.StructType):
            out += flat_columns(f.dataType, f"{name}.")
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType)):
            out.append(F.array_join(F.transform(c, lambda x: x.cast("string")), "; ").alias(name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(F.to_json(c).alias(name))
        else:
            out.append(c.cast("string").alias(name))
    return out


def flatten(value, prefix: str = "") -> dict[str, str]:
    """A nested Python record as dotted names and texts; plain lists joined by "; "."""
    if isinstance(value, dict):
        return {k: v for key, x in value.items() for k, v in flatten(x, f"{prefix}{key}.").items()}
    name = prefix.rstrip(".")
    if isinstance(value, list):
        if all(not isinstance(x, (dict, list)) for x in value):
            return {name: "; ".join(str(x) for x in value)}
        return {k: v for i, x in enumerate(value) for k, v in flatten(x, f"{prefix}{i}.").items()}
    return {} if value is None else {name: str(value)}


def record_rows(df: DataFrame, location: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, fields) of a record table: one page per record with the text "name: value. …", and its fields.

    A record's address is the location with its key, or with a digest of its content; records
    equal in every column are one page.
    """
    flat = df.select(*flat_columns(df.schema))
    names = flat.columns
    content = F.concat_ws(". ", *[F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in names])
    at = F.col(f"`{key}`") if key else F.left(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])), 256), F.lit(16))
    keyed = flat.withColumn("_url", F.concat(F.lit(f"{location}#"), at)).dropDuplicates(["_url"])
    pages = keyed.select(F.col("_url").alias("url"), content.alias("text"), F.lit(location).alias("source_id"))
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in names])
    fields = keyed.select(F.col("_url").alias("url"), F.inline(pairs)).where("value is not null")
    return pages, fields


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(url, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("text"))


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def docx_text(content: bytes) -> str:
    """Paragraphs of a word-processor file, by its own zipped XML."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    return "\n".join(t for p in root.iter(f"{w}p") if (t := "".join(x.text or "" for x in p.iter(f"{w}t"))))


def cell_name(row: int, column: int) -> str:
    """The A1 name of a cell, both counted from 1."""
    letters = ""
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def xlsx_rows(content: bytes) -> list[tuple[str, int, dict[str, str]]]:
    """(sheet, row, {header: value}) of every sheet; the first row is the header."""
    s = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in si.iter(f"{s}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{s}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        names = [e.get("name") for e in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{s}sheet")]
        for k, name in enumerate(names, 1):
            header: dict[str, str] = {}
            for r in ET.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{s}row"):
                cells = {}
                for c in r.iter(f"{s}c"):
                    v, inline = c.find(f"{s}v"), c.find(f"{s}is")
                    text = "".join(t.text or "" for t in inline.iter(f"{s}t")) if inline is not None else shared[int(v.text)] if v is not None and c.get("t") == "s" else v.text if v is not None else None
                    if text is not None:
                        cells[re.sub(r"\d", "", c.get("r"))] = text
                if not header:
                    header = cells
                else:
                    out.append((name, int(r.get("r")), {header[k2]: v for k2, v in cells.items() if k2 in header}))
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(url, text) of the word-processor files below a path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"url": b["path"], "text": [docx_text(c) for c in b["content"]]})

    return _files(spark, path, "*.docx").mapInPandas(run, "url string, text string")


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(url, name, value) of the spreadsheet files below a path; the address names sheet and row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"{p}#{sheet}!{r}", n, v) for p, c in zip(b["path"], b["content"]) for sheet, r, cells in xlsx_rows(c) for n, v in cells.items()]
            yield pd.DataFrame(rows, columns=["url", "name", "value"])

    return _files(spark, path, "*.xlsx").mapInPandas(run, FIELDS)


def page_numbers(ranges: str) -> set[int]:
    """"12-14,50" as the numbers it names."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in ranges.split(","))):
        a, _, b = part.partition("-")
        out |= set(range(int(a), int(b or a) + 1))
    return out


def feed_links(xml: str) -> list[str]:
    """Entry links of an RSS or Atom feed."""
    out = []
    for e in ET.fromstring(xml).iter():
        tag = e.tag.rpartition("}")[2]
        if tag in ("item", "entry"):
            for x in e:
                if x.tag.rpartition("}")[2] == "link":
                    out.append((x.get("href") or x.text or "").strip())
    return [x for x in out if x]


def osm_features(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, lat, lon, name, tags) of a saved map response; elements without name or place are left out."""
    schema = "elements array<struct<type string, id bigint, lat double, lon double, center struct<lat double, lon double>, tags map<string,string>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("elements"))
    lat, lon = F.coalesce("lat", "center.lat"), F.coalesce("lon", "center.lon")
    return e.select("id", "type", lat.alias("lat"), lon.alias("lon"), F.try_element_at("tags", F.lit("name")).alias("name"), "tags").where("name is not null and lat is not null and lon is not null")


def osm_filter(text: str) -> list[tuple[str, str | None]]:
    """"amenity=school, shop" as tag conditions; a tag without value means any."""
    parts = [p.strip() for p in re.split(r"[,;&]", text) if p.strip()]
    return [(k.strip(), v.strip() or None) for k, _, v in (p.partition("=") for p in parts)]


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row per address, the last fetched; ties go to the greatest content hash."""
    from cairnframe.operators.relations import latest

    return latest(pages, ["url"], "fetched_at", "content_hash")


def read_source(spark: SparkSession, location: str, kind: str | None = None, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, fields) of a source, by its declared kind or its suffix."""
    kind = kind or guess_type(location)
    if kind in ("csv", "json", "parquet"):
        df = {"csv": read_csv, "json": read_json}.get(kind, lambda s, p: s.read.parquet(p))(spark, location)
        return record_rows(df, location, key)
    empty = spark.createDataFrame([], FIELDS)
    if kind == "text":
        return read_text(spark, location).withColumn("source_id", F.lit(location)), empty
    if kind == "docx":
        return read_documents(spark, location).withColumn("source_id", F.lit(location)), empty
    if kind == "xlsx":
        fields = read_sheets(spark, location)
        text = fields.groupBy("url").agg(F.concat_ws(". ", F.array_sort(F.collect_list(F.concat("name", F.lit(": "), "value")))).alias("text"))
        return text.withColumn("source_id", F.lit(location)), fields
    if kind == "osm":
        f = osm_features(spark, location.removeprefix("osm:"))
        return record_rows(f.select("id", "name", "lat", "lon", "tags"), location, "id")
    if kind == "folder":
        pages, fields, _ = read_folder(spark, location)
        return pages, fields
    raise ValueError(f"a source of kind {kind!r} needs a network or a library that is not part of this engine")


#: Files that a folder source reads, by suffix.
SUFFIXES = {".csv": "csv", ".tsv": "csv", ".json": "json", ".txt": "text", ".md": "text", ".docx": "docx", ".xlsx": "xlsx"}


def read_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, fields, skipped) of every readable file below a folder; `skipped` lists (path, suffix) of the rest.

    Files are told apart by suffix from a listing alone. Text files and documents are read by kind
    in one scan each; tables, whose headings differ, file by file.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    known = listed.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    skipped = known.where(~F.col("suffix").isin(*SUFFIXES))
    files = [r["path"] for r in known.where(F.col("suffix").isin(*SUFFIXES)).orderBy("path").toLocalIterator()]
    pages, fields = None, spark.createDataFrame([], FIELDS)
    for path in files:
        p, f = read_source(spark, path, SUFFIXES["." + path.rsplit(".", 1)[1].lower()])
        pages = p if pages is None else pages.unionByName(p, allowMissingColumns=True)
        fields = fields.unionByName(f, allowMissingColumns=True)
    return (spark.createDataFrame([], "url string, text string, source_id string") if pages is None else pages), fields, skipped


def registered(sources: DataFrame | None, spark: SparkSession, source_id: str, kind: str, location: str, tier: int = 3, authoritative_for: list[str] | None = None) -> DataFrame:
    """The source registry with one more source; a source of the same id is replaced."""
    new = spark.createDataFrame([(source_id, kind, location, tier, authoritative_for or [])], "source_id string, kind string, location string, tier int, authoritative_for array<string>")
    return new if sources is None else sources.where(F.col("source_id") != source_id).unionByName(new)


# The reference tables and the columns that tell them.
REFERENCE = {
    "units": ("quantity", "unit", "base_unit", "factor"), "places": ("name", "kind", "parent"), "vocab": ("vocabulary", "term"),
    "authority_ids": ("authority", "identifier", "name"), "source_rank": ("domain", "tier"),
}


def reference_kind(path: str, columns: list[str]) -> str:
    """Which reference table a file holds, by its name, else by its columns; a ValueError if neither tells."""
    name = path.rsplit("/", 1)[-1].lower()
    for kind in REFERENCE:
        if kind.split("_")[0].rstrip("s") in name:
            return kind
    have = {c.strip().lower() for c in columns}
    best = max(REFERENCE, key=lambda k: (set(REFERENCE[k]) <= have, len(set(REFERENCE[k]) & have)))
    if not set(REFERENCE[best][:2]) <= have:
        raise ValueError(f"{path} is none of the reference tables {', '.join(REFERENCE)}")
    return best


def load_reference(spark: SparkSession, path: str, kind: str | None = None, existing: DataFrame | None = None) -> tuple[str, DataFrame]:
    """(kind, table) of a reference file, its rows replacing those of `existing` with the same first two columns."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF(*[c.strip().lower() for c in rows.columns])
    kind = kind or reference_kind(path, rows.columns)
    key = [c for c in REFERENCE[kind][:2] if c in rows.columns]
    whole = [F.col(c) for c in rows.columns if c not in key]
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    one = placed.groupBy(*key).agg(F.max_by(F.struct(*whole), "_at").alias("r")).select(*key, "r.*") if whole else rows.distinct()
    return kind, one if existing is None else existing.join(one.select(*key), key, "left_anti").unionByName(one, allowMissingColumns=True)


def service_records(payload: str) -> list[dict]:
    """The records of a JSON service's answer: a list, or what stands under records, results or data."""
    got = json.loads(payload)
    if isinstance(got, dict):
        got = next((got[k] for k in ("records", "results", "data") if isinstance(got.get(k), list)), [got])
    return [r for r in got if isinstance(r, dict)] if isinstance(got, list) else []


def decoded(content: bytes, content_type: str | None = None, most: int = 5 << 20) -> str:
    """A page's text from at most `most` bytes: by the header's charset, the page's own, UTF-8, else Windows-1252."""
    raw = content[:most]
    said = re.search(r"charset=[\"']?([\w-]+)", content_type or "") or re.search(r"charset=[\"']?([\w-]+)", raw[:2048].decode("latin-1"))
    for name in ([said[1]] if said else []) + ["utf-8"]:
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("cp1252", "replace")


def robots(text: str, agent: str = "*") -> tuple[list[tuple[bool, str]], float | None]:
    """(rules, delay) of a robots file for an agent: (allowed, path prefix), the longest first, and seconds between fetches."""
    groups: dict[str, list] = {}
    names, fresh = [], True
    for line in text.splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [value.lower()] if fresh is False or not names else [*names, value.lower()]
            fresh = True
        elif key in ("allow", "disallow", "crawl-delay") and names:
            fresh = False
            for n in names:
                groups.setdefault(n, []).append((key, value))
    mine = groups.get(agent.lower(), groups.get("*", []))
    rules = sorted(((k == "allow", v) for k, v in mine if k != "crawl-delay" and v), key=lambda r: (-len(r[1]), not r[0]))
    delays = [float(v) for k, v in mine if k == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", v)]
    return rules, delays[0] if delays else None


def may_fetch(rules: list[tuple[bool, str]], path: str) -> bool:
    """Whether the longest rule that a path begins with allows it; paths under no rule are free."""
    return next((ok for ok, prefix in rules if path.startswith(prefix.rstrip("*"))), True)


def export_pages(pages: DataFrame, path: str, kind: str = "json") -> None:
    """Raw pages as JSON lines, CSV or texts, one output file per task."""
    told = pages.select("page_id", "url", "title", "text", "fetched_at")
    if kind == "json":
        told.write.mode("overwrite").json(path)
    elif kind == "csv":
        told.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    elif kind == "text":
        told.select(F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", "url", F.lit(""))), F.coalesce("url", F.lit("")), F.coalesce("text", F.lit("")), F.lit("")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"pages can be written as json, csv or text, not {kind!r}")
