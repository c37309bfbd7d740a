import os

from pyspark.sql import functions as F

from commsight.operators.clean import drop_leading, filter_by_country_key
from commsight.operators.models import model_map
from commsight.operators.sequence import forward_fill
from commsight.sources import html as H
from commsight.sources import tables as S
from tests.conftest import rows

MCC_PAGE = """<html><body><div class="wrap"><table id="mncmccTable">
<thead><tr><th>MCC</th><th>MNC</th><th>ISO</th><th>Country</th><th>Country Code</th><th>Network</th></tr></thead>
<tbody><tr><td>716</td><td>06</td><td>pe</td><td>Peru</td><td>51</td><td> Claro &amp; Co\t</td></tr>
<tr></tr>
<tr><td>001</td><td>01</td><td>xx</td><td>United States of America</td><td>1</td><td>Test</td></tr>
</tbody></table><table id="other"><tr><td>skip</td></tr></table></div></body></html>"""

MIDEYE_PAGE = """<div class="entry-content"><table><tbody>
<tr><th>Country</th><th>Operator</th><th>Network Code</th><th>Display Text</th></tr>
<tr><td>Afghanistan</td><td>AWCC</td><td>41201</td><td>AF AWCC</td></tr>
<tr><td></td><td>Salaam</td><td>41220</td><td>SALAAM</td></tr>
<tr><td></td><td>MTN</td><td>41240</td><td>MTN AF</td></tr>
<tr><td>Albania</td><td>Vodafone</td><td>27602</td><td>VODAFONE AL</td></tr>
</tbody></table></div><table><tbody><tr><td>outside</td></tr></tbody></table>"""

ISP_PAGE = """<div class="css-11y878r">
<h3 class="graf graf--h3">Peru - 3 providers</h3><p class="graf graf--p">Claro, Movistar</p>
<p class="graf graf--p">orphan paragraph</p>
<h3 class="graf graf--h3">Chile</h3><h3 class="graf graf--h3">Chile - dup</h3><p class="graf graf--p">Entel</p>
<h3 class="graf graf--h3"> - </h3><p class="graf graf--p">dash</p>
<h3 class="graf graf--h3">  </h3><p class="graf graf--p">nobody</p>
<h3 class="graf graf--h3">Iran</h3><p class="other">wrong class</p><p class="graf graf--p">MCI<br>Irancell</p>
</div>"""

CARD = ('<a class="flex flex-col gap-2 rounded border border-gray-100 p-2 hover:border-teal-300 '
        'hover:shadow-lg hover:shadow-teal-600/40" href="{href}"><div class="text font-medium hover:text-purple">'
        '{name}</div><div class="text-xs text-gray-500">Colocation</div><div class="text-xs text-gray-500">'
        '{addr}</div></a>')


def _pages(spark, *htmls, urls=None):
    data = [(i, (urls or {}).get(i, f"https://site.test/p/{i}"), h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(data, "page_id long, url string, html string")


def test_html_elements_text_entities_script(spark):
    p = _pages(spark, "<html><head><title>A &amp; B</title><script>var t='</p>';</script></head>"
                      "<body><p>one<p>two <b> three </b></body></html>")
    el = H.html_elements(p)
    got = {(r.tag, r.text) for r in el.collect()}
    assert ("title", "A & B") in got and ("p", "one") in got and ("p", "twothree") in got
    assert ("script", "") in got


def test_html_table_rows_thead(spark):
    el = H.html_elements(_pages(spark, MCC_PAGE))
    cols = list(S.MCC_RENAMES.values())
    t = H.html_table_rows(el, cols, table_id="mncmccTable")
    got = rows(t, "row_idx", "Mobile Country Code", "Mobile Network Code", "Country", "Network Operator")
    assert got == [(0, "716", "06", "Peru", "Claro & Co"), (1, "001", "01", "United States of America", "Test")]
    hdr = [r.name for r in H.html_table_header(el, "mncmccTable").orderBy("col_idx").collect()]
    assert hdr == list(S.MCC_RENAMES)


def test_html_table_first_row_header_drop_and_fill(spark):
    el = H.html_elements(_pages(spark, MIDEYE_PAGE))
    t = H.html_table_rows(el, ["Country", "Operator", "Network Code", "Display Text"],
                          container_class="entry-content", header="first_row")
    filled = forward_fill(t, "Country", ["row_pos"], keys=["page_id"], width=None)
    got = rows(filled, "row_idx", "Country", "Operator")
    assert got == [(0, "Afghanistan", "AWCC"), (1, "Afghanistan", "Salaam"), (2, "Afghanistan", "MTN"),
                   (3, "Albania", "Vodafone")]
    # P6 with an explicit n (the reference dropped two rows: header and first data row)
    assert rows(drop_leading(t, 1, keys=["page_id"], order=["row_pos"]), "Operator") == [
        ("MTN",), ("Salaam",), ("Vodafone",)]


def test_pair_heading_body_on_element_stream(spark):
    el = H.html_elements(_pages(spark, ISP_PAGE))
    cls = F.col("classes")
    pairs = H.pair_heading_body(el, (F.col("tag") == "h3") & F.array_contains(cls, "graf--h3"),
                                (F.col("tag") == "p") & F.array_contains(cls, "graf--p"),
                                keys=["page_id"], order=["pos"], width=3)
    # " - " strips to "-", which has no " - " to cut at, so it pairs (as in
    # the reference); the blank heading does not.
    assert rows(pairs, "Country", "Providers") == [("-", "dash"), ("Chile", "Entel"), ("Iran", "MCIIrancell"),
                                                   ("Peru", "Claro, Movistar")]


def test_html_cards_and_country_filter(spark):
    page = "<div>" + "".join([
        CARD.format(href="/locations/a", name="DC A", addr="1 Road, Austin, USA"),
        CARD.format(href="https://x.test/b", name="DC B", addr="Main st,  usa "),
        CARD.format(href="c", name="DC C", addr="no comma"),
        CARD.format(href="/d", name="DC D", addr=""),
    ]) + '<a class="flex" href="/notacard">x</a></div>'
    p = _pages(spark, page, urls={0: "https://www.example.com/locations?query=united%20states"})
    cards = H.html_cards(H.html_elements(p, url="url"))
    got = rows(cards, "Name", "Type", "Address", "Link")
    assert ("DC A", "Colocation", "1 Road, Austin, USA", "https://www.example.com/locations/a") in got
    assert ("DC C", "Colocation", "no comma", "https://www.example.com/c") in got
    assert len(got) == 4
    us = filter_by_country_key(cards, "Address", "United States")
    assert rows(us, "Name") == [("DC A",), ("DC B",)]


def test_csv_roundtrip_keeps_text_and_write_gate(spark, tmp_path):
    path = os.path.join(tmp_path, "isp.csv")
    with open(path, "w") as f:
        f.write('Country,Providers\nPeru,"Claro, Movistar\nBitel"\n,\nChile,001\n')
    df = S.load_csv_table(spark, path, S.ISP_LIST_SCHEMA)
    got = rows(df)
    assert ("Peru", "Claro, Movistar\nBitel") in got and ("Chile", "001") in got and (None, None) in got
    target = os.path.join(tmp_path, "table")
    assert S.write_table(df, target) == 3
    empty = spark.createDataFrame([], S.ISP_LIST_SCHEMA)
    assert S.write_table(empty, target) == 0
    assert spark.read.parquet(target).count() == 3  # old table kept
    out = os.path.join(tmp_path, "csv_out")
    S.write_csv(df, out)
    assert rows(S.load_csv_table(spark, out, S.ISP_LIST_SCHEMA)) == got
    S.table_payload(df, "traforama_isp_list", os.path.join(tmp_path, "payload"))
    cols = spark.read.json(os.path.join(tmp_path, "payload", "traforama_isp_list", "columns")).first()
    assert list(cols["columns"]) == ["Country", "Providers"]


def test_scan_table_allowlist(spark):
    import pytest

    with pytest.raises(ValueError):
        S.scan_table(spark, "/tmp", "users; DROP TABLE x")


def test_model_map_stub(spark):
    df = spark.createDataFrame([(1, "hi"), (2, None)], "id long, prompt string")
    out = model_map(df, lambda s: s.fillna("").str.upper(), "prompt")
    assert rows(out, "id", "reply") == [(1, "HI"), (2, "")]


def test_deeply_nested_malformed_page_is_cheap(spark):
    import time

    from commsight.sources.html import _parse_page

    html = "<html><body>" + "<b>x" * 5000 + "<p>end</p></body></html>"
    t0 = time.time()
    rows_ = list(_parse_page(1, html))
    assert time.time() - t0 < 5
    body = [r for r in rows_ if r[5] == "body"][0]
    assert body[8].startswith("xxx") and body[8].endswith("end")  # whole text, not a prefix
    assert body[1:3] == (1, 5002)  # its interval ends with its last descendant
    innermost_p = [r for r in rows_ if r[5] == "p"][0]
    assert innermost_p[8] == "end" and innermost_p[4] == 5002


def test_deep_table_extra_cells_and_first_table(spark):
    from commsight.sources import html as H

    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    deep = "<div class='box'>" + "<div><span>" * 300 + "<table><tbody>" + row("a", "b") + row("a", "b", "c") + row("d")
    deep += "</tbody><tbody>" + row("e", "f") + "</tbody></table><table>" + row("g", "h") + "</table></div>"
    pages = spark.createDataFrame([(1, deep), (None, deep), (2, None)], "page_id long, html string")
    el = H.html_elements(pages, keep_tags=H.TABLE_TAGS)
    got = H.html_table_rows(el.where("page_id = 1"), ["x", "y"], container_class="box")
    assert rows(got, "x", "y") == [("a", "b"), ("d", None)]
    bad = H.html_table_rejects(el.where("page_id = 1"), ["x", "y"], container_class="box")
    assert rows(bad, "cells", "reason") == [(["a", "b", "c"], "3 cells for 2 columns")]
    assert el.where("page_id IS NULL").count() == el.where("page_id = 1").count()


def test_100000_nested_elements_in_linear_memory(spark):
    import tracemalloc

    def peak(n):
        tracemalloc.start()
        out = 0
        for r in H._parse_page(1, "<div>" * n + "<p>deep" + "</div>" * n, None, frozenset(["p"])):
            out += 1
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, top

    (n1, small), (n2, large) = peak(10_000), peak(100_000)
    assert (n1, n2) == (10_001, 100_001) and large < 13 * small
    page = "<div>" * 100_000 + "<table id='t'><tbody><tr><td>x</td></tr></tbody></table>"
    el = H.html_elements(spark.createDataFrame([(1, page)], "page_id long, html string"), **H.TABLES)
    assert rows(H.html_table_rows(el, ["c"], table_id="t"), "c") == [("x",)]


def test_containment_is_that_of_a_tree_walk(spark):
    import random

    rng = random.Random(5)
    html = ""
    for _ in range(400):
        t = rng.choice(["div", "section", "b", "ul"])
        html += rng.choice([f"<{t} class='{rng.choice('xy')}'>", f"<{t}>", f"</{t}>", f"</{t}>", "<i></i>"])
    el = H.html_elements(spark.createDataFrame([(1, html), (2, html[::2])], "page_id long, html string")).cache()
    everything = {(r.page_id, r.pos): r for r in el.collect()}
    cond = F.array_contains("classes", "x")
    got = {(r.page_id, r.pos): r for r in H.enclosing(el.withColumn("in", H.inside(cond)), cond, "around").collect()}
    assert len(got) == len(everything)
    for k, r in everything.items():
        up = r.parent
        while up >= 0 and "x" not in everything[k[0], up].classes:
            up = everything[k[0], up].parent
        assert got[k].around == (None if up < 0 else up) and got[k]["in"] == (up >= 0)


def test_columns_follow_the_page_header(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    head = lambda *c: "<thead><tr>" + "".join(f"<th>{x}</th>" for x in c) + "</tr></thead>"
    pages = _pages(
        spark, "<table id=t>" + head("MNC", "MCC", "Note") + "<tbody>" + row("01", "716", "n") + row("02") + "</table>",
        "<table id=t>" + head("MCC", "MNC", "MCC") + "<tbody>" + row("310", "4", "again", "more") + "</table>",
        "<table id=t><tbody>" + row("no", "header") + "</table>")
    el = H.html_elements(pages, **H.TABLES)
    names = {"MCC": "code", "MNC": "net"}
    got = H.html_table_by_header(el, names, table_id="t")
    assert rows(got, "page_id", "row_idx", "code", "net") == [(0, 0, "716", "01"), (0, 1, None, "02"), (1, 0, "310", "4")]
    bad = H.html_cell_rejects(el, names, table_id="t")
    assert rows(bad, "page_id", "col_idx", "text", "reason") == [
        (0, 2, "n", "unknown header"), (1, 2, "again", "repeated header"), (1, 3, "more", "beyond the header"),
        (2, 0, "no", "no header"), (2, 1, "header", "no header")]
