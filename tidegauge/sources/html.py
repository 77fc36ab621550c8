"""HTML tables to rows: one small parser per page, everything after it in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rules as R

CELL_SCHEMA = "page_id bigint, table_no int, row_no int, column_no int, cell string"

# Header aliases of the known table layouts.
LAYOUTS = {
    "identity": {"security_code": ("sec code", "security code"), "name": ("name", "company name"), "isin": ("isin", "isin code")},
    "prices": {"date": ("date",), "price": ("price",), "open": ("open",), "high": ("high",), "low": ("low",), "volume": ("vol",),
               "change": ("change %",)},
}


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells, self.table, self.row, self.column, self.text = [], -1, -1, -1, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.column = self.row + 1, -1
        elif tag in ("td", "th"):
            self.column, self.text = self.column + 1, []

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.text is not None and self.table >= 0:
            self.cells.append((self.table, self.row, self.column, " ".join("".join(self.text).replace("\xa0", " ").split())))
            self.text = None


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        rows = []
        for page_id, html in zip(pages["page_id"], pages["html"]):
            parser = _Tables()
            parser.feed(html or "")
            rows += [(page_id, *cell) for cell in parser.cells]
        yield pd.DataFrame(rows, columns=["page_id", "table_no", "row_no", "column_no", "cell"])


def extract_cells(pages: DataFrame) -> DataFrame:
    """Every table cell of ``pages(page_id, html)``."""
    return pages.select("page_id", "html").mapInPandas(_extract, CELL_SCHEMA)


def normalised_header(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(cell), "[^a-z0-9%]+", " "))


def read_tables(pages: DataFrame, layout: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """Rows of the tables whose header carries every wanted column exactly once.

    Returns ``(rows, issues)``: pages without such a table are reported as
    drift, short rows too. Only the first matching table of a page counts.
    """
    cells = extract_cells(pages)
    aliases = F.create_map(*[F.lit(x) for name, words in layout.items() for w in words for x in (w, name)])
    heads = cells.where("row_no = 0").withColumn("field", F.element_at(aliases, normalised_header(F.col("cell")))).where("field IS NOT NULL")
    per_field = heads.groupBy("page_id", "table_no", "field").agg(F.count("*").alias("n"), F.min("column_no").alias("column_no"))
    good = per_field.groupBy("page_id", "table_no").agg(F.count("*").alias("fields"), F.max("n").alias("most")).where(
        (F.col("fields") == len(layout)) & (F.col("most") == 1)
    ).groupBy("page_id").agg(F.min("table_no").alias("table_no"))
    wanted = per_field.join(good, ["page_id", "table_no"]).select("page_id", "table_no", "column_no", "field")
    body = cells.where("row_no > 0").join(wanted, ["page_id", "table_no", "column_no"])
    rows = body.groupBy("page_id", "table_no", "row_no").agg(
        *[F.max(F.when(F.col("field") == f, F.col("cell"))).alias(f) for f in layout], F.count("*").alias("_cells")
    )
    drift = pages.select("page_id").join(good, "page_id", "left_anti").withColumn("issue_codes", F.array(F.lit("REQUIRED_TABLE_HEADERS_NOT_FOUND")))
    short = rows.where(F.col("_cells") < len(layout)).select("page_id", F.array(F.lit("SHORT_TABLE_ROW")).alias("issue_codes"))
    issues = R.issues(drift.unionByName(short), "html_tables", "page_id")
    return rows.where(F.col("_cells") == len(layout)).drop("_cells"), issues
