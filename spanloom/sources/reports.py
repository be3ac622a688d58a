"""Small results as Markdown and CSV. Only aggregated tables of a bounded number of rows belong here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_cell

#: More rows than this are told, not listed.
MOST_ROWS = 200


def markdown_table(rows: DataFrame, order: list[str], most: int = MOST_ROWS) -> str:
    """A Markdown table of the first rows in order, with a line telling how many more there are."""
    cells = [F.coalesce(markdown_cell(F.col(c).cast("string")), F.lit("")).alias(c) for c in rows.columns]
    listed = rows.orderBy(*order).select(*cells).limit(most + 1).collect()
    out = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    out += ["| " + " | ".join(r) + " |" for r in listed[:most]]
    if len(listed) > most:
        out.append(f"\n… {rows.count() - most} more")
    return "\n".join(out) + "\n"


def report(title: str, sections: dict[str, DataFrame], order: dict[str, list[str]]) -> str:
    return "\n".join([f"# {title}\n", *(f"## {name}\n\n{markdown_table(rows, order[name])}" for name, rows in sections.items())])


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Distributed CSV with a header; refuses an existing path."""
    rows.select(*(columns or rows.columns)).write.mode("errorifexists").option("header", True).csv(path)


def confusion_grid(confusion: DataFrame, labels: list[str]) -> DataFrame:
    """(gold_label, <label>..., <BOUNDARY>, <MISSED>), zero filled, with a <SPURIOUS> row: labels x labels cells at most."""
    columns = [*labels, "<BOUNDARY>", "<MISSED>"]
    grid = confusion.groupBy("gold_label").pivot("pred_label", columns).agg(F.sum("n"))
    all_ = confusion.sparkSession.createDataFrame([(x,) for x in [*labels, "<SPURIOUS>"]], "gold_label string")
    return all_.join(grid, "gold_label", "left").na.fill(0)
