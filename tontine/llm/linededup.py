"""Line deduplication by site-relative frequency.

Documents are grouped by host. A line's frequency is the share of the host's pages that contain it; lines above a
boilerplate ratio are dropped from every page of that host. A page is a distinct text of the host: exact copies of one
page count once, so an article copied many times does not turn into boilerplate.

Lines are compared after trimming blanks, tabs, carriage returns, vertical tabs and form feeds, by a 64-bit hash; blank
lines are neither counted nor dropped. A host's dropped lines number at most (mean lines of a page) / ratio.

Defined results
* null text stays null, empty text empty; rows with a null host are left as they are;
* a line is dropped only if at least ``least_pages`` pages hold it, so small hosts keep their text;
* a page whose lines are all dropped keeps its row with an empty text; repeated rows are answered each;
* extra columns pass through ``clean``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tontine.sources.shared import spool

#: A line is boilerplate above this percentage of the host's pages, on this many pages at least.
PERCENT = 1
LEAST_PAGES = 5
#: Blank, tab, carriage return, vertical tab and form feed.
BLANKS = " \t\r\x0b\x0c"


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(
    documents: DataFrame, host: str, text: str, percent: float = PERCENT, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """``host, lines``: per host the keys of the lines to drop.

    Only 64-bit keys are shuffled, never text. Counts are summed map-side, so a line on a third of all pages is one row
    per task; the totals per host meet them in an ordinary join.
    """
    blank = line_key(F.lit(""))
    body = F.col(text).cast("string")
    pages = (
        documents.filter(F.col(host).isNotNull() & body.isNotNull())
        .select(
            F.col(host).cast("string").alias("host"),
            F.xxhash64(body).alias("page"),
            F.xxhash64(F.lit(1), body).alias("twin"),
            F.array_distinct(F.transform(lines_of(body), line_key)).alias("lines"),
        )
        .dropDuplicates(["host", "page", "twin"])
    )
    pages = spool(pages.select("host", "lines"), "page-lines")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = (
        pages.select("host", F.explode("lines").alias("line")).filter(F.col("line") != blank)
        .groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    )
    common = counts.join(totals, "host").filter(F.col("n") * 100 > F.col("pages") * percent)
    return common.groupBy("host").agg(F.collect_list("line").alias("lines"))


def clean(
    documents: DataFrame,
    host: str = "source",
    text: str = "text",
    percent: float = PERCENT,
    least_pages: int = LEAST_PAGES,
    dropped_name: str = "dropped_lines",
) -> DataFrame:
    """All columns of ``documents`` with ``text`` cleaned, and ``dropped_name``.

    The per-host lists are small next to the pages; Spark broadcasts them if their written size allows it, else the
    join is a shuffle by host whose hot hosts adaptive execution splits.
    """
    found = spool(boilerplate(documents, host, text, percent, least_pages), "boilerplate")
    packed = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("row"))
    joined = packed.join(found, F.col(f"row.`{host}`").cast("string") == F.col("host"), "left")
    body = F.col(f"row.`{text}`")
    kept = F.filter(lines_of(body), lambda line: ~F.array_contains(F.col("lines"), line_key(line)))
    cleaned = F.when(F.col("lines").isNull() | body.isNull(), body).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col("lines").isNull() | body.isNull(), F.lit(0)).otherwise(F.size(lines_of(body)) - F.size(kept))
    # Worked out before the columns of ``documents`` are named again, which may be called ``lines`` or ``row`` too.
    worked = joined.select("row", cleaned.alias("cleaned"), dropped.cast("int").alias("dropped"))
    columns = [F.col("cleaned" if c == text else f"row.`{c}`").alias(c) for c in documents.columns]
    return worked.select(*columns, F.col("dropped").alias(dropped_name))
