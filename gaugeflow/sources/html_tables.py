"""Station and forecast rows from web pages held in a table (page id, text).

Pages spread over tasks and go through them in Arrow batches; a page is read whole,
and only rows leave it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gaugeflow.schemas import FORECAST
from gaugeflow.session import known_to_workers

_ATTRIBUTES = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
# Text; tags of tables, rows and cells; comments, scripts and styles, other tags with quoted attributes, declarations; lone brackets.
_TOKEN = re.compile(
    rf"([^<]++)|<(/?)(table|tr|td)(?![^\s/>]){_ATTRIBUTES}>|<!--.*?(?:-->|\Z)|<(script|style)(?u:\b)[^>]*+>.*?(?:</\4\s*>|\Z)"
    rf"|</?[a-z]{_ATTRIBUTES}>|<[!?/][^>]*+>|(<)", re.I | re.S | re.A)
_CLOSED = re.compile(r"<(table|tr|td)(?:\s(?:[^<>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+)?/>", re.I | re.A)
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_NOT_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"
# Character references met in table cells.
_ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


_BLANKS = " \t\r\n\f\u000b\u00a0"


def _plain(text: str) -> str:
    """Characters for their references."""
    for name, char in _ENTITIES:
        text = text.replace(name, char)
    return text


def _page_tables(page: str) -> list[list[list[str]]]:
    """The cell texts of all rows of all tables of a page, in order of their starts.

    One pass with the open elements as a stack: an end tag closes the last open element of its name and all
    inside it, one without an open element closes nothing, and the page's end closes the rest."""
    tables: list = []
    stack: list[tuple] = []  # the name of an open element, where it adds what it holds, the texts before it
    open_tables: list[list] = []
    open_rows: list[list] = []
    texts: list[str] = []  # all texts of the page; a cell holds those from its start to its end
    whole = _CLOSED.sub(r"<\1></\1>", page) if "/>" in page else page
    for text, slash, name, _, bracket in _TOKEN.findall(whole):
        if not name:
            if open_rows and (text or bracket):
                texts.append(_plain(text) if "&" in text else text or bracket)
            continue
        name = name.lower()
        if not slash:
            if name == "table":
                tables.append([])
                open_tables.append(tables[-1])
            elif name == "tr":
                row: list = []
                for table in open_tables:
                    table.append(row)
                open_rows.append(row)
            else:
                for row in open_rows:
                    row.append(None)
            stack.append((name, [(row, len(row) - 1) for row in open_rows] if name == "td" else (), len(texts)))
        elif stack and stack[-1][0] == name:
            _close(stack, open_tables, open_rows, texts)
        elif any(name == x[0] for x in stack):
            while _close(stack, open_tables, open_rows, texts) != name:
                pass
    while stack:
        _close(stack, open_tables, open_rows, texts)
    return tables


def _close(stack: list[tuple], open_tables: list, open_rows: list, texts: list[str]) -> str:
    """Close the last open element and return its name."""
    name, places, begin = stack.pop()
    if name == "table":
        open_tables.pop()
    elif name == "tr":
        open_rows.pop()
    elif places:
        text = "".join(texts[begin:]).strip(_BLANKS)
        for row, place in places:
            row[place] = text
    return name


def _rows_of(ids: tuple[str, ...], names: list[str]):
    """Arrow batches of ids and _page (UTF-8 bytes) to batches of ids, table_no, row_no and cells."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in batches:
            at, table_no, row_no, cells = [], [], [], []
            for i, page in enumerate(pages.column("_page").to_pylist()):
                for t, rows in enumerate(_page_tables(page.decode("utf-8", "replace"))):
                    for r in range(1, len(rows)):
                        at.append(i)
                        table_no.append(t)
                        row_no.append(r)
                        cells.append(rows[r])
            take = pa.array(at, pa.int64())
            found = [pages.column(c).take(take) for c in ids]
            found += [pa.array(table_no, pa.int32()), pa.array(row_no, pa.int32()), pa.array(cells, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(found, names=names)

    return work


def _is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(_NUMBER) | text.rlike(_NOT_FINITE), F.lit(False))


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def table_rows(pages: DataFrame, html: str = "html", ids: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """ids, table_no, row_no and the cell texts of every table row but each table's first.

    Tables, rows and cells are elements of the page's tree: a table has the rows of tables nested in it too,
    a row the cells of those, and a cell all text inside it. What has no end tag ends with what it is in.
    Comments, scripts and styles hold nothing. Null pages have no rows."""

    known_to_workers(pages.sparkSession)
    own = pages.select(*ids)
    names = [*ids, "table_no", "row_no", "cells"]
    types = StructType([*own.schema.fields, *(StructField(n, t) for n, t in zip(names[len(ids):], (IntegerType(), IntegerType(), ArrayType(StringType()))))])
    held = pages.filter(F.col(html).rlike("(?i)<table")).select(*ids, F.col(html).cast("binary").alias("_page"))
    return held.mapInArrow(_rows_of(ids, names), types)


def parse_station_pages(pages: DataFrame, html: str = "html", ids: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Station rows: at least eight cells, and every level cell must be a number."""
    rows = table_rows(pages, html, ids).filter(F.size("cells") >= 8)

    def cell(i: int) -> Column:
        return F.get(F.col("cells"), F.lit(i))

    numeric = _is_number(cell(5)) & _is_number(cell(6)) & _is_number(cell(7))
    numeric = numeric & ((F.size("cells") <= 8) | _is_number(cell(8)))
    names = ("station_id", "station_name", "river_name", "basin", "state")
    return rows.filter(numeric).select(
        *ids, *[cell(i).alias(n) for i, n in enumerate(names)],
        _number(cell(5)).alias("current_level"), _number(cell(6)).alias("warning_level"),
        _number(cell(7)).alias("danger_level"), _number(cell(8)).alias("highest_flood_level"),
        F.coalesce(cell(9), F.lit("unknown")).alias("trend"),
    )


def parse_forecast_feed(feed: DataFrame, body: str = "body", ids: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Forecast rows from JSON arrays; texts that are no JSON are read as table rows of four cells."""
    fields = [f.name for f in FORECAST]
    is_json = F.try_parse_json(F.col(body)).isNotNull()
    listed = feed.filter(is_json).select(*ids, F.from_json(body, f"array<{FORECAST.simpleString()}>").alias("_a"))
    from_json = listed.select(*ids, F.explode("_a").alias("_e")).select(*ids, *[F.col(f"_e.{f}").alias(f) for f in fields])
    rows = table_rows(feed.filter(~is_json), body, ids).filter(F.size("cells") >= 4)
    level, sure = F.get(F.col("cells"), F.lit(1)), F.get(F.col("cells"), F.lit(3))
    from_html = rows.filter(_is_number(level) & _is_number(sure)).select(
        *ids, F.get(F.col("cells"), F.lit(0)).alias("station_id"), _number(level).alias("forecast_level"),
        F.get(F.col("cells"), F.lit(2)).alias("forecast_time"), _number(sure).alias("confidence"),
    )
    return from_json.unionByName(from_html)
