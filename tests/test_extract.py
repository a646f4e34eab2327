"""Page extraction on inline pages: captions, panels, grids, footnotes, labels and mentions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.operators import extract as X
from paperloom.operators import html_tree
from paperloom.operators.html_tree import has, parse

PAGE = """<html><h1 class="ltx_title ltx_title_document">On <math alttext="x^2">x2</math> things<!-- no --> Journal: none</h1>
<div class="ltx_abstract"><p class="ltx_p">An abstract&nbsp;here.</p></div>
<figure class="ltx_figure" id="S1.F1"><img src="img/1.png"><figcaption class="ltx_caption">Figure 1: plain</figcaption></figure>
<figure class="ltx_figure" id="S1.F2"><figcaption class="ltx_caption">Figure 2: (a) first. (b) second.</figcaption>
 <figure class="ltx_figure_panel" id="p1"><img src="a.png"></figure><figure class="ltx_figure_panel"><img src="b.png"></figure><figure class="ltx_figure_panel"></figure></figure>
<figure class="ltx_figure"><img src="q.png"><figcaption class="ltx_caption">Equation of state</figcaption></figure>
<figure class="ltx_figure"><img src="m.png"><figcaption class="ltx_caption">With <math class="ltx_Math" alttext="a">a</math></figcaption></figure>
<figure class="ltx_figure"><img src="n.png"><figcaption class="ltx_caption">no number</figcaption></figure>
<figure class="ltx_table" id="T3"><figcaption class="ltx_caption">Table 3: cap<span class="ltx_note ltx_role_footnote"><sup class="ltx_note_mark">1</sup><span class="ltx_note_content"><sup class="ltx_note_mark">1</sup>note one</span></span></figcaption>
 <table><thead><tr><th rowspan="2">h</th><th colspan="2">w</th></tr><tr></tr></thead><tbody><tr><td>x<span class="ltx_note ltx_role_footnote"><sup class="ltx_note_mark">1</sup><span class="ltx_note_content">note one</span></span></td><td colspan="0">y</td></tr>
 <tr><td colspan="bad">z<table><tr><td>in</td><td></td><td>ner</td></tr></table></td></tr></tbody></table></figure>
<figure class="ltx_table"><table><tr><td>lost</td></tr></table><figcaption>Table IV. one</figcaption><table><tr><td>1</td></tr></table><figcaption>second</figcaption><div><table><tr><td>2</td></tr></table></div></figure>
<p class="ltx_p">See Fig. 1 and figure 2(a).</p><p class="ltx_p">Figure 10, Figs. 1.</p><p class="ltx_p">See Fig. 1 and figure 2(a).</p>
<p class="ltx_p">Tab. 3a and TABLE IV hold.</p><figure><p class="ltx_p">Fig. 1 inside a figure</p></figure><a href="../up">u</a></html>"""


@pytest.fixture(scope="module")
def record():
    return X.page_record("2410.00010", "https://example.org/html/2410.00010", PAGE)


def test_title_and_abstract(record):
    assert record["title"] == "On $x^2$ things Journal: none" and record["abstract"] == "An abstract here."
    assert record["links"] == ["https://example.org/up"]


def test_references_without_semicolon():
    page = "<h1>a &amp;&amp;&amp</h1><p>&lt;b &copy &ampx; &#38; &#38 & c&quot</p>"
    told = lambda **x: [(r["title"], r["paragraphs"][0]["text"]) for r in [X.page_record("p", "", page, any_paragraph=True, **x)]][0]
    assert told() == ("a &&&", '<b © &x; & & & c"') and told(closed=True) == ("a &&&amp", "<b &copy &ampx; & &#38 & c&quot")


def test_figures(record):
    rows = [(f["figure_id"], f["sub_id"], f["sub_caption"], f["source"]) for f in record["figures"]]
    assert rows == [
        ("1", None, None, "https://example.org/html/img/1.png"), ("2", "a", "first.", "https://example.org/html/a.png"), ("2", "b", "second.", "https://example.org/html/b.png"),
        ("2", "c", "", None), ("3", None, None, "https://example.org/html/n.png"),
    ]
    assert record["figures"][1]["html_id"] == "p1" and record["figures"][2]["html_id"] == "S1.F2"
    assert len(X.page_record("p", "", PAGE, rule="strict")["figures"]) == 6 and len(X.page_record("p", "", PAGE, rule=None)["figures"]) == 7


def test_tables(record):
    first, second, third = record["tables"]
    assert (first["table_id"], first["n_rows"], first["n_cols"]) == ("2410.00010_T3", 3, 3)
    cells = {(c["row"], c["col"]): (c["text"], c["is_header"], c["rowspan"], c["colspan"]) for c in first["cells"]}
    assert cells == {(0, 0): ("h", True, 2, None), (0, 1): ("w", True, None, 2), (1, 1): ("x[^1]", False, None, None), (1, 2): ("y", False, None, None), (2, 0): ("zin ner", False, None, None)}
    assert first["footnotes"] == [{"marker": "1", "text": "note one"}] and first["caption"] == "Table 3: cap[^1]"
    assert [c["text"] for c in second["cells"]] == ["1"] and [c["text"] for c in third["cells"]] == ["2"]
    assert second["table_num"] == 2 and third["table_num"] == 3


def test_datasets(spark):
    pages = spark.createDataFrame([("2410.00010", "https://example.org/html/2410.00010", PAGE), ("2410.00011", "u", "<p>nothing</p>"), ("2410.00012", None, None)], "page_id string, url string, html string")
    records = X.page_records(pages)
    assert {r.paper_id: r.title for r in records.collect()}["2410.00010"] == "On $x^2$ things"
    cited = {(r.figure_id, r.text) for r in X.figure_references(records).collect()}
    assert cited == {("1", "See Fig. 1 and figure 2(a)."), ("2", "See Fig. 1 and figure 2(a).")}
    tables = {r.table_num: r for r in X.tables(records).collect() if r.paper_id == "2410.00010" and r.caption != "second"}
    assert tables[3].references == ["Tab. 3a and TABLE IV hold."] and tables[2].references == ["Tab. 3a and TABLE IV hold."]
    assert X.metadata(records).count() == 1 and X.item_captions(records).count() == 8
    assert {r.item_type for r in X.item_references(records).collect()} == {"figure", "table"}
    assert X.dense_cells(X.tables(records, references=False)).filter("table_id = '2410.00010_T3'").count() == 8  # the uncaptioned third table has the number of its place


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 4)), max_size=5), max_size=6))
def test_cells_never_overlap(rows):
    html = "<table>" + "".join("<tr>" + "".join(f'<td rowspan="{d}" colspan="{a}">c</td>' for d, a in r) + "</tr>" for r in rows) + "</table>"
    cells, n_rows, n_cols, _ = X.grid_of(parse(html).find(has("table")))
    origins = [(c["row"], c["col"]) for c in cells]
    assert len(set(origins)) == len(origins) and n_rows == sum(bool(r) for r in rows)
    assert all(c["col"] + (c["colspan"] or 1) <= n_cols for c in cells)


def test_tree_closes_open_elements():
    root = parse("<p>a<p>b<ul><li>c<li>d</ul><script>x</script><!-- y --><br>e")
    assert [p.text() for p in root.find_all(has("p"))][0] == "a" and len(root.find_all(has("li"))) == 2 and "x" not in root.text()


def _flat(node):
    return [(c.tag, c.attrs, c.classes, [d.tag for d in c.walk()], _flat(c)) if not isinstance(c, str) else c for c in node.children]


def test_plain_pages_do_without_the_tokenizer(monkeypatch):
    page = PAGE.replace("<!-- no -->", "<!-- no --><script>a</p>b</script>")
    slow = html_tree._Builder()
    slow.feed(page)
    for node in reversed(slow.root.order):
        node.parent.end = max(node.parent.end, node.end)
    expected = X.page_record("p", "u", page)
    monkeypatch.setattr(html_tree._Builder, "feed", None)
    assert _flat(parse(page)) == _flat(slow.root) and X.page_record("p", "u", page) == expected


@given(st.lists(st.sampled_from('<p>|</p>|<p class="a  b">|<td>|<tr>|</tr>|<table>|</table>|<br/>|<img src="a&amp;b&c"/>|<li>|text|&amp;|&lt|<|>|"|<!-- c -->|<!--->|<!-- > -->|<!doctype x>|<script>|</script >|<style>|<A HREF="X">|</A>|<a b=c>|<a b="<">|<a b="c"d="e">|<?pi?>|</>|<p/>|<a b="1" b="2">|</p x>'.split("|")), max_size=12))
@settings(max_examples=300, deadline=None)
def test_quick_trees_are_the_tokenizers(bits):
    page = "".join(bits)
    slow = html_tree._Builder()
    slow.feed(page)
    slow.close()
    for node in reversed(slow.root.order):
        node.parent.end = max(node.parent.end, node.end)
    assert html_tree._quick(page) is None or _flat(parse(page)) == _flat(slow.root)


def test_only_the_named_parts(spark, monkeypatch):
    full = X.page_record("p", "u", PAGE)
    monkeypatch.setattr(X, "tables_of", None)
    assert X.page_record("p", "u", PAGE, parts=("figures", "title")) == {k: full[k] for k in ("paper_id", "url", "figures", "title")}
    monkeypatch.undo()
    records = X.page_records(spark.createDataFrame([("p", "u", PAGE)], "page_id string, url string, html string"), parts=("tables",))
    assert records.columns == ["paper_id", "url", "tables"] and X.tables(records, references=False).count() == len(full["tables"])
