"""Read-only SQL over the landed and built tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class NotReadOnly(ValueError):
    """The text is not one reading statement."""


def read_only(spark: SparkSession, text: str) -> None:
    """Refuses anything that parses to a command or a change; only one SELECT or WITH passes."""
    word = text.strip().split(None, 1)[0].lower() if text.strip() else ""
    if word not in ("select", "with", "values", "table"):
        raise NotReadOnly("only a SELECT or WITH statement may be run")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    seen, queue = [], [plan]
    while queue:
        p = queue.pop()
        seen.append(p.getClass().getName())
        children = p.children()
        queue += [children.apply(i) for i in range(children.size())]
    if any(x in name for name in seen for x in ("Insert", "Delete", "Update", "Merge", "Command", "Create", "Drop", "Alter", "Truncate")):
        raise NotReadOnly("the statement changes something")


def query(spark: SparkSession, text: str, views: dict[str, DataFrame]) -> DataFrame:
    """One reading statement over the given tables as views."""
    read_only(spark, text)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def shown(df: DataFrame, form: str = "table", most: int = 1000) -> str:
    """The first `most` rows of a result as a text table, JSON lines or CSV, for reading."""
    import csv
    import io
    import json

    rows, columns = df.limit(most).collect(), df.columns
    if form == "json":
        return "\n".join(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) for r in rows)
    texts = [["" if v is None else str(v) for v in r] for r in rows]
    if form == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([columns, *texts])
        return out.getvalue().rstrip("\n")
    if form != "table":
        raise ValueError(f"a result can be shown as table, json or csv, not {form!r}")
    widths = [max(len(c), *[len(t[i]) for t in texts], 1) for i, c in enumerate(columns)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    return "\n".join([line(columns), line(["-" * w for w in widths]), *[line(t) for t in texts]])
