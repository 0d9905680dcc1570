"""Output targets: columns, filters, shapes and file formats of built tables."""

from __future__ import annotations

import json
import sqlite3
import zipfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.operators import values as V
from cairnframe.operators.normal_forms import Table


@dataclass
class Target:
    """What to write: filters, columns, shape and order, in this order of application."""

    where: dict = field(default_factory=dict)
    columns: list = field(default_factory=list)
    shape: str = "wide"
    sort_by: list = field(default_factory=list)
    descending: bool = False
    style: str | None = None


def shaped(table: Table, target: Target) -> DataFrame:
    df = V.where(table.df, target.where) if target.where else table.df
    if target.columns:
        df = V.choose(df, target.columns, table.key)
    if target.shape == "long":
        df = V.to_long(df, table.key[0], [c for c in df.columns if c not in table.key])
    if target.sort_by:
        df = V.sort_by(df, [c for c in target.sort_by if c in df.columns], target.descending)
    return V.restyled(df, target.style) if target.style else df


def cascaded(tables: list[Table], primary: str, target: Target) -> list[Table]:
    """Tables with the target's filter on the primary one carried over to tables that hold its key."""
    main = next(t for t in tables if t.name == primary)
    kept = Table(main.name, V.where(main.df, target.where), main.key, main.kind, main.derived)
    out = []
    for t in tables:
        same = [k for k in main.key if k in t.df.columns]
        out.append(kept if t is main else Table(t.name, V.cascade(t.df, kept.df, same[0], same[0]), t.key, t.kind, t.derived) if same else t)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def write_csv_single(tables: dict[str, DataFrame], path: str) -> None:
    write_csv(V.stack_tables(tables), path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def nested(main: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """The main table with each child's rows as an array of structs under its name; empty where there are none."""
    out = main
    for name, child in children.items():
        rest = [c for c in child.columns if c != key]
        rows = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
        out = out.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return out


def sql_statements(df: DataFrame, table: str) -> DataFrame:
    """INSERT statements with every value quoted as text."""
    quote = lambda c: F.when(c.isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")))
    names = ", ".join(f'"{c}"' for c in df.columns)
    return df.select(F.concat(F.lit(f'INSERT INTO "{table}" ({names}) VALUES ('), F.concat_ws(", ", *[quote(F.col(c)) for c in df.columns]), F.lit(");")).alias("value"))


def write_sqlite(tables: list[Table], path: str) -> None:
    """One database file with keys and indexes; rows are streamed through the driver one partition at a time."""
    Path(path).unlink(missing_ok=True)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "INTEGER"}
    with sqlite3.connect(path) as db:
        for t in tables:
            columns = ", ".join(f'"{c}" {kinds.get(k, "TEXT")}' for c, k in t.df.dtypes)
            key = ", ".join(f'"{k}"' for k in t.key)
            db.execute(f'CREATE TABLE "{t.name}" ({columns}{f", PRIMARY KEY ({key})" if t.key else ""})')
            plain = t.df.select(*[F.col(c) if k in kinds else F.col(c).cast("string") for c, k in t.df.dtypes])
            db.executemany(f'INSERT INTO "{t.name}" VALUES ({", ".join("?" * len(t.df.columns))})', (tuple(r) for r in plain.toLocalIterator()))
            for c in t.df.columns:
                if c.endswith("_id") and c not in t.key:
                    db.execute(f'CREATE INDEX "ix_{t.name}_{c}" ON "{t.name}" ("{c}")')


def write_xlsx(tables: dict[str, DataFrame], path: str) -> None:
    """A spreadsheet file with a bold, frozen header on every sheet; at most 1,048,575 rows a sheet, the format's own bound."""
    from xml.sax.saxutils import escape

    from cairnframe.sources.records import cell_name

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(tables)
        z.writestr("[Content_Types].xml", head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1)) + "</Types>")
        z.writestr("_rels/.rels", head + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", head + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + f'<Relationship Id="r{n + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", head + f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(t[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, t in enumerate(tables, 1)) + "</sheets></workbook>")
        z.writestr("xl/styles.xml", head + f'<styleSheet {ns}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, df in enumerate(tables.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                cell = lambda r, c, v, s="": "" if v is None else f'<c r="{cell_name(r, c)}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
                out.write((head + f'<worksheet {ns}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData><row r="1">' + "".join(cell(1, c, v, ' s="1"') for c, v in enumerate(df.columns, 1)) + "</row>").encode())
                for r, row in enumerate(df.toLocalIterator(), 2):
                    if r > 1_048_576:
                        raise ValueError("a spreadsheet holds no more than 1,048,575 rows; choose another format")
                    out.write((f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>").encode())
                out.write(b"</sheetData></worksheet>")


def metadata(tables: list[Table]) -> dict:
    """Row counts, columns and keys of the written tables."""
    return {"tables": [{"name": t.name, "kind": t.kind, "key": t.key, "columns": t.df.columns, "rows": t.df.count()} for t in tables]}


def write_all(tables: list[Table], folder: str, formats: list[str]) -> dict:
    """Every table in every format, with a metadata.json; returns the metadata."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    writers = {"csv": write_csv, "parquet": write_parquet, "json": write_json}
    for f in formats:
        if f == "sqlite":
            write_sqlite(tables, str(root / "dataset.db"))
        elif f == "xlsx":
            write_xlsx({t.name: t.df for t in tables}, str(root / "dataset.xlsx"))
        elif f == "sql":
            for t in tables:
                sql_statements(t.df, t.name).write.mode("overwrite").text(str(root / f"{t.name}.sql"))
        else:
            for t in tables:
                writers[f](t.df, str(root / f"{t.name}.{f}"))
    about = metadata(tables)
    (root / "metadata.json").write_text(json.dumps(about, indent=2))
    return about


def pack(folder: str, path: str) -> None:
    """A folder of exports as one zip with a manifest."""
    root = Path(folder)
    files = sorted(p for p in root.rglob("*") if p.is_file())
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, p.relative_to(root))
        z.writestr("manifest.json", json.dumps({"files": [str(p.relative_to(root)) for p in files]}))


def read_pack(path: str) -> dict:
    with zipfile.ZipFile(path) as z:
        return json.loads(z.read("manifest.json"))
