"""Offline ingest: scraped pages -> the three stored telecom tables.

The reference fetched each site with a browser and parsed it in one process;
here the fetched pages are a table ``(page_id, url, html)`` and each ingest
is a DataFrame job: S6 element stream -> table/pair extraction -> cleaning ->
completeness gate -> write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commsight.operators.aggregates import completeness_check, tag_sources
from commsight.operators.clean import drop_leading, replace_values
from commsight.operators.sequence import forward_fill
from commsight.session import materialize
from commsight.sources import html as H
from commsight.sources.tables import MCC_RENAMES, read_table, write_table

# The one country spelling the mobile-code source rewrites.
MCC_COUNTRY_ALIASES = {"United States of America": "United States"}
# Row count the mobile-code scrape is expected to reach.
MCC_EXPECTED_ROWS = 2080
# Class tokens of headings and paragraphs on the ISP page.
ISP_HEADING_CLASS = "graf--h"
ISP_BODY_CLASS = "graf--p"


def mobile_code_elements(pages: DataFrame) -> DataFrame:
    return H.html_elements(pages, **H.TABLES)


def mobile_codes(pages: DataFrame, table_id: str = "mncmccTable", elements: DataFrame | None = None) -> DataFrame:
    """mcc_mnc_table: S6 -> S3 -> P1 -> P2.  Each cell goes where the page's
    own ``thead`` puts it, in whatever order the page has its columns."""
    el = mobile_code_elements(pages) if elements is None else elements
    rows = H.html_table_by_header(el, MCC_RENAMES, table_id=table_id)
    rows = replace_values(rows, "Country", MCC_COUNTRY_ALIASES)
    return rows.select(*MCC_RENAMES.values())


def mobile_code_rejects(elements: DataFrame, table_id: str = "mncmccTable") -> DataFrame:
    """Cells of the mobile-code pages that no column takes, and unread pages."""
    return H.html_cell_rejects(elements, MCC_RENAMES, table_id=table_id)


# Header texts of the operator list, which are its columns.
OPERATOR_COLUMNS = ("Country", "Operator", "Network Code", "Display Text")


def operator_list(pages: DataFrame, container_class: str = "entry-content", drop: int = 0,
                  elements: DataFrame | None = None) -> DataFrame:
    """mideye_mobile_network_list: S6 -> S4 (first body row is the header)
    -> P5 fill blank countries from the row above -> P6 drop ``drop`` rows.

    The reference dropped two rows (``input[2:]``): the header *and* the
    first data row.  S4 already removes the header, so ``drop=0`` keeps every
    operator; pass ``drop=1`` to reproduce the reference's table exactly.
    A blank first country stays null (the reference raised an error).
    """
    el = H.html_elements(pages, **H.TABLES) if elements is None else elements
    t = H.html_table_by_header(el, {c: c for c in OPERATOR_COLUMNS}, container_class=container_class,
                               header="first_row")
    # Rows of one page are bounded by construction (one parsed input row):
    # plain windows, and no statistics pass that would parse pages again.
    t = drop_leading(t, drop, keys=["page_id"], order=["row_pos"], width=None)
    t = forward_fill(t, "Country", ["row_pos"], keys=["page_id"], width=None)
    return t.select(*OPERATOR_COLUMNS)


def operator_rejects(elements: DataFrame, container_class: str = "entry-content") -> DataFrame:
    """Cells of the operator pages that no column takes, and unread pages."""
    return H.html_cell_rejects(elements, {c: c for c in OPERATOR_COLUMNS}, container_class=container_class,
                               header="first_row")


def isp_list(pages: DataFrame, heading_class: str = ISP_HEADING_CLASS, body_class: str = ISP_BODY_CLASS) -> DataFrame:
    """traforama_isp_list: S6 -> S7 (h3 heading paired with the next p)."""
    el = H.html_elements(pages, keep_tags=("h3", "p"))
    head = (F.col("tag") == "h3") & F.array_contains("classes", heading_class)
    body = (F.col("tag") == "p") & F.array_contains("classes", body_class)
    pairs = H.pair_heading_body(el, head, body, keys=["page_id"], order=["pos"])
    return pairs.select("Country", "Providers")


def store(df: DataFrame, path: str, source: str, expected_rows: int = 1,
          rejects: DataFrame | None = None) -> DataFrame:
    """A8 + K2: check the new table against its expected size, then replace
    the stored table only if it has rows.  Returns the check row
    (source, expected_rows, n_rows, status) as a DataFrame.

    ``rejects`` are stored beside the table, under ``{path}_rejects`` (an
    empty set of them too), so that what a run could not place can be looked
    up.  Rows are checked where they were written.
    """
    spark = df.sparkSession
    n = write_table(df, path)
    if rejects is not None:
        write_table(rejects, f"{path}_rejects", min_rows=0)
    written = read_table(spark, path) if n else df.limit(0)
    exp = spark.createDataFrame([(source, expected_rows)], "source string, expected_rows long")
    tagged = tag_sources({source: written.select(F.lit("x").alias("Country"))})
    return completeness_check(tagged, exp)


def ingest_mobile_codes(pages: DataFrame, path: str) -> DataFrame:
    """Pages -> stored mobile-code table and its rejects; pages are parsed
    once.  Returns the check row."""
    el = materialize(mobile_code_elements(pages), "elements")
    return store(mobile_codes(pages, elements=el), path, "mcc_mnc_table", MCC_EXPECTED_ROWS, mobile_code_rejects(el))


def ingest_operator_list(pages: DataFrame, path: str) -> DataFrame:
    """Pages -> stored operator table and its rejects; pages are parsed once.
    Returns the check row."""
    el = materialize(H.html_elements(pages, **H.TABLES), "elements")
    return store(operator_list(pages, elements=el), path, "mideye_mobile_network_list", 1, operator_rejects(el))
