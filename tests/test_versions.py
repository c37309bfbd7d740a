"""Versioned tables: publication, failed writers, clean-up; ingest rejects."""

import os

import pytest
from pyspark.sql import functions as F

from commsight.plans import ingest
from commsight.sources import tables as S
from tests.conftest import rows


def test_readers_see_whole_versions_only(spark, tmp_path):
    path = os.path.join(tmp_path, "t")
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "x long")
    assert S.write_table(df(1, 2), path) == 2
    old = S.read_table(spark, path)
    # A writer that dies: its rows lie there, unpublished and half written.
    df(7, 8, 9).write.parquet(f"{path}/version=2-dead")
    assert rows(S.read_table(spark, path)) == [(1,), (2,)] and list(S.table_versions(spark, path)) == [1]
    assert S.write_table(df(3), path) == 1
    assert rows(S.read_table(spark, path)) == [(3,)] and rows(old) == [(1,), (2,)]
    assert S.drop_unpublished(spark, path) == 1
    assert S.write_table(df(4), path) == 1
    assert list(S.table_versions(spark, path)) == [2, 3]  # the last two stay
    assert S.write_table(df(), path) == 0 and rows(S.read_table(spark, path)) == [(4,)]


def test_failing_job_and_second_writer_leave_the_table(spark, tmp_path):
    path = os.path.join(tmp_path, "t")
    S.write_table(spark.range(3), path)
    with pytest.raises(Exception):
        S.write_table(spark.range(1000).withColumn("x", F.when(F.col("id") > 900, F.raise_error(F.lit("midway")))), path)
    assert rows(S.read_table(spark, path)) == [(0,), (1,), (2,)]
    # Another writer publishes the same version while this one writes.
    published = spark.range(7).withColumn("late", F.lit(True))

    class Racing:
        sparkSession = spark

        @property
        def write(self):
            S.write_table(published, path)
            return spark.range(5).write

    with pytest.raises(RuntimeError, match="another writer"):
        S.write_table(Racing(), path)
    assert S.read_table(spark, path).count() == 7


def test_ingest_follows_headers_and_stores_rejects(spark, tmp_path):
    page = ("<table id='mncmccTable'><thead><tr><th>MNC</th><th>MCC</th><th>Country</th><th>Seen</th></tr></thead>"
            "<tbody><tr><td>01</td><td>310</td><td>United States of America</td><td>today</td></tr></tbody></table>")
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    path = os.path.join(tmp_path, "codes")
    assert ingest.ingest_mobile_codes(pages, path).first().n_rows == 1
    assert rows(S.read_table(spark, path), "Mobile Country Code", "Mobile Network Code", "Country",
                "Network Operator") == [("310", "01", "United States", None)]
    assert rows(S.read_table(spark, path + "_rejects"), "text", "reason") == [("today", "unknown header")]
    ops = ("<div class='entry-content'><table><tbody><tr><td>Operator</td><td>Country</td></tr><tr><td>A</td>"
           "<td>Peru</td></tr><tr><td>B</td><td></td><td>more</td></tr></tbody></table></div>")
    path = os.path.join(tmp_path, "ops")
    ingest.ingest_operator_list(spark.createDataFrame([(1, ops)], "page_id long, html string"), path)
    assert rows(S.read_table(spark, path), "Country", "Operator") == [("Peru", "A"), ("Peru", "B")]
    assert rows(S.read_table(spark, path + "_rejects"), "text", "reason") == [("more", "beyond the header")]
