"""Pages to records: one pass of a table function per page, everything after it DataFrame code.

``page_records`` parses each page once and returns a row per page with nested figures,
tables and paragraphs; the datasets are projections of it. Numbering is shared by rows and
references, panels without a letter are lettered by place, spans are at least one, and ids
are unique across papers.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .html_tree import Node, closed_references, has, parse

_NOTE = pa.struct([("marker", pa.string()), ("text", pa.string())])
_CELL = pa.struct([("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("is_header", pa.bool_()), ("colspan", pa.int32()), ("rowspan", pa.int32())])
_FIGURE = pa.struct([(k, pa.string()) for k in ("figure_id", "sub_id", "html_id", "source", "caption", "sub_caption")] + [("footnotes", pa.list_(_NOTE))])
_TABLE = pa.struct([(k, pa.string()) for k in ("table_id", "html_id")] + [("table_num", pa.int32())] + [(k, pa.string()) for k in ("sub_id", "caption", "sub_caption")] + [("n_rows", pa.int32()), ("n_cols", pa.int32()), ("cells", pa.list_(_CELL)), ("footnotes", pa.list_(_NOTE))])
_PARA = pa.struct([("ord", pa.int32()), ("text", pa.string())])
PARTS = ("title", "abstract", "figures", "tables", "paragraphs", "links")
RECORD = pa.schema([("paper_id", pa.string()), ("url", pa.string()), ("title", pa.string()), ("abstract", pa.string()), ("figures", pa.list_(_FIGURE)), ("tables", pa.list_(_TABLE)), ("paragraphs", pa.list_(_PARA)), ("links", pa.list_(pa.string()))])
_NOTE_DDL = "struct<marker:string,text:string>"
_DDL = {
    "paper_id": "string", "url": "string", "title": "string", "abstract": "string",
    "figures": f"array<struct<figure_id:string,sub_id:string,html_id:string,source:string,caption:string,sub_caption:string,footnotes:array<{_NOTE_DDL}>>>",
    "tables": f"array<struct<table_id:string,html_id:string,table_num:int,sub_id:string,caption:string,sub_caption:string,n_rows:int,n_cols:int,cells:array<struct<row:int,col:int,text:string,is_header:boolean,colspan:int,rowspan:int>>,footnotes:array<{_NOTE_DDL}>>>",
    "paragraphs": "array<struct<ord:int,text:string>>", "links": "array<string>",
}
RECORD_DDL = ", ".join(f"{k} {v}" for k, v in _DDL.items())


def squeeze(s: str) -> str:
    return " ".join(s.split())


def math_text(node: Node | str) -> str:
    """Text with each formula as its alternative text between dollar signs."""
    if isinstance(node, str):
        return node
    if node.tag == "math":
        alt = node.attrs.get("alttext", "")
        return f"${alt}$" if alt else node.text()
    return "" if node.tag in ("script", "style") else "".join(map(math_text, node.children))


def flat_table(table: Node) -> str:
    """A nested table as its non-empty cell texts."""
    cells = (squeeze(math_text(c)) for c in table.find_all(lambda n: n.tag in ("td", "th")))
    return " ".join(c for c in cells if c)


def noted_text(node: Node) -> tuple[str, list[dict]]:
    """Text with footnotes taken out, each replaced by ``[^marker]``, and the footnotes."""
    notes: list[dict] = []

    def walk(x) -> str:
        if isinstance(x, str) or x.tag in ("math", "script", "style"):
            return math_text(x)
        if x.tag == "table":
            return flat_table(x)
        if "ltx_note" in x.classes and "ltx_role_footnote" in x.classes:
            mark, body = x.find(has("sup", "ltx_note_mark")), x.find(has("span", "ltx_note_content"))
            marker = squeeze(mark.text()) if mark else "?"
            parts = [] if body is None else [c for c in body.children if isinstance(c, str) or not ("ltx_tag_note" in c.classes or (c.tag == "sup" and "ltx_note_mark" in c.classes))]
            notes.append({"marker": marker, "text": squeeze("".join(map(walk, parts)))})
            return f"[^{marker}]"
        return "".join(map(walk, x.children))

    inner = "".join(map(walk, node.children)) if node.tag != "table" else flat_table(node)
    return squeeze(inner), notes


def distinct(notes: list[dict]) -> list[dict]:
    """Notes without repeats, in order."""
    return list({(n["marker"], n["text"]): n for n in reversed(notes)}.values())[::-1]


def own_caption(figure: Node) -> tuple[str, list[dict]]:
    """Text and notes of a figure's direct caption."""
    caption = next((c for c in figure.elements() if c.tag == "figcaption" and "ltx_caption" in c.classes), None)
    return noted_text(caption) if caption else ("", [])


def split_caption(caption: str) -> list[tuple[str, str]]:
    """Lettered parts of a caption."""
    return [(m[1], m[2].strip()) for m in re.finditer(r"[(]([a-z])[)]\s*([^)]*?)(?=\s*[(][a-z][)]|$)", caption)]


def label_panels(panel_captions: list[str], outer: str) -> list[tuple[str, str]]:
    """(letter, caption) of each panel, from its own caption or its part of the outer one; else by place."""
    if any(panel_captions):
        found = [re.search(r"(?i)[(]([a-z])[)]", c) for c in panel_captions]
        named = [(m[1].lower() if m else "", c) for m, c in zip(found, panel_captions)]
    else:
        parts = split_caption(outer)[: len(panel_captions)]
        named = parts + [("", "")] * (len(panel_captions) - len(parts))
    return [(letter or (chr(97 + i) if i < 26 else f"p{i}"), c) for i, (letter, c) in enumerate(named)]


def is_equation(figure: Node, rule: str, caption: str) -> bool:
    """Whether a figure shows an equation. ``reference`` counts any formula inside, ``strict`` only outside captions."""
    def formula(n: Node) -> bool:
        hit = any("ltx_eqn" in c or "ltx_equation" in c or "ltx_Math" in c for c in n.classes)
        return hit and (rule == "reference" or not n.inside("figcaption"))

    below = figure.walk()
    return any(n.classes and formula(n) for n in below) or not any(n.tag == "img" for n in below) or bool(re.match(r"(?i)\s*equation\b", caption))


def outer_figures(root: Node, cls: str) -> list[Node]:
    """Figures of a class that are no panels."""
    return [n for n in root.walk() if n.tag == "figure" and cls in n.classes and "ltx_figure_panel" not in n.classes]


def number_in(caption: str, kind: str) -> int | None:
    m = re.search(rf"(?i)\b{kind}\s+(\d+)", caption)
    return int(m[1]) if m else None


def figures_of(root: Node, url: str, rule: str | None = "reference") -> list[dict]:
    """A row per figure or panel; ``rule`` None keeps equations."""
    rows, count = [], 0
    for figure in outer_figures(root, "ltx_figure"):
        caption, notes = own_caption(figure)
        if rule and is_equation(figure, rule, caption):
            continue
        count += 1
        found = number_in(caption, "figure")
        number = count if found is None else found

        def row(node, sub_id, sub_caption, extra=()):
            image = node.find(has("img"))
            source = image.attrs.get("src") if image else None
            return {"figure_id": str(number), "sub_id": sub_id, "html_id": node.attrs.get("id", figure.attrs.get("id", "")), "source": urljoin(url or "", source) if source else None,
                    "caption": caption, "sub_caption": sub_caption, "footnotes": distinct([*notes, *extra])}

        panels = figure.find_all(has("figure", "ltx_figure_panel"))
        own = [own_caption(p) for p in panels]
        rows += [row(p, letter, text, n) for p, (letter, text), (_, n) in zip(panels, label_panels([c for c, _ in own], caption), own)] if panels else [row(figure, None, None)]
    return rows


def grid_of(table: Node) -> tuple[list[dict], int, int, list[dict]]:
    """Cells at their row and column, with rows and columns counted over spans; a row without cells takes no place.

    Spans end where HTML ends them: 1,000 columns, 65,534 rows.
    """
    cells, notes, taken, row, width = [], [], set(), 0, 0
    rows = [r for part in table.elements() for r in ([part] if part.tag == "tr" else part.elements() if part.tag in ("thead", "tbody", "tfoot") else []) if r.tag == "tr"]
    for tr in rows:
        col, some = 0, False
        for cell in (c for c in tr.elements() if c.tag in ("td", "th")):
            some = True
            while (row, col) in taken:
                col += 1
            across, down = (max(1, int(v)) if v.isdigit() else 1 for v in (cell.attrs.get("colspan", "1"), cell.attrs.get("rowspan", "1")))
            across, down = min(across, 1000), min(down, 65534)
            content, found = noted_text(cell)
            notes += found
            cells.append({"row": row, "col": col, "text": content, "is_header": cell.tag == "th", "colspan": across if across > 1 else None, "rowspan": down if down > 1 else None})
            taken.update((r, c) for r in range(row, row + min(down, len(rows) + 1)) for c in range(col, col + across))
            col += across
            width = max(width, col)
        row += some
    return cells, row, width, notes


def tables_of(root: Node, paper: str) -> list[dict]:
    """A record per logical table or panel. A wrapper's parts begin at its direct captions."""
    records, count = [], 0
    for wrapper in outer_figures(root, "ltx_table"):
        groups: list[tuple[Node, list[Node]]] = []
        for child in wrapper.elements():
            if child.tag == "figcaption":
                groups.append((child, []))
            elif groups:
                groups[-1][1].append(child)
        for head, content in groups:
            count += 1
            caption, notes = noted_text(head)
            found = number_in(caption, "table")
            number = count if found is None else found

            def record(table, html_id, sub_id, sub_caption, extra):
                cells, n_rows, n_cols, own = grid_of(table)
                return {"table_id": f"{paper}_T{number}{sub_id or ''}", "html_id": html_id, "table_num": number, "sub_id": sub_id, "caption": caption, "sub_caption": sub_caption,
                        "n_rows": n_rows, "n_cols": n_cols, "cells": cells, "footnotes": distinct([*notes, *extra, *own])}

            is_panel, anchor = has("figure", "ltx_figure_panel"), wrapper.attrs.get("id", "")
            panels = [p for c in content for p in ([c] if is_panel(c) else c.find_all(is_panel))]
            if panels:
                own = [own_caption(p) for p in panels]
                for p, (letter, text), (_, n) in zip(panels, label_panels([c for c, _ in own], caption), own):
                    if table := p.find(has("table")):
                        records.append(record(table, p.attrs.get("id", anchor), letter, text, n))
            elif table := next((t for c in content for t in ([c] if c.tag == "table" else [c.find(has("table"))]) if t), None):
                records.append(record(table, anchor, None, None, []))
    return records


def paragraphs_of(root: Node, any_paragraph: bool = False) -> list[dict]:
    """Paragraphs outside figures that hold text, by their place among all."""
    found = [n for n in root.walk() if n.tag == "p" and (any_paragraph or "ltx_p" in n.classes) and not n.inside("figure")]
    texts = [squeeze(math_text(p)) for p in found]
    return [{"ord": i, "text": t} for i, t in enumerate(texts) if t]


def page_record(paper: str, url: str, html: str, rule: str | None = "reference", any_paragraph: bool = False, closed: bool = False, parts: tuple[str, ...] = PARTS) -> dict:
    """All that one page holds, or the named parts. ``closed`` reads no reference without its semicolon; by default, as in browsers, ``&amp`` is one."""
    root = parse(closed_references(html or "") if closed else html)

    def title():
        found = root.find(has("h1", "ltx_title_document")) or (root.find(has("h1")) if any_paragraph else None)
        return squeeze(math_text(found)) if found else ""

    def abstract():
        found = root.find(has("div", "ltx_abstract"))
        first = found.find(has("p", "ltx_p")) if found else None
        return squeeze(math_text(first)) if first else ""

    make = {
        "title": title, "abstract": abstract, "figures": lambda: figures_of(root, url, rule), "tables": lambda: tables_of(root, paper), "paragraphs": lambda: paragraphs_of(root, any_paragraph),
        "links": lambda: [urljoin(url or "", a.attrs["href"]) for a in root.walk() if a.tag == "a" and a.attrs.get("href")],
    }
    return {"paper_id": paper, "url": url} | {k: make[k]() for k in parts}


def page_records(pages: DataFrame, rule: str | None = "reference", any_paragraph: bool = False, id_col: str = "page_id", closed: bool = False, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row per page of (page_id, url, html): nested figures, tables, paragraphs and links, or only the named parts."""
    names = ["paper_id", "url", *parts]
    schema = pa.schema([RECORD.field(k) for k in names])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64).to_pylist()
                rows = [page_record(r["paper_id"], r["url"], r["html"], rule, any_paragraph, closed, parts) for r in part]
                yield pa.RecordBatch.from_pylist(rows, schema)

    rows = pages.select(F.col(id_col).cast("string").alias("paper_id"), "url", "html").mapInArrow(run, ", ".join(f"{k} {_DDL[k]}" for k in names))
    return rows.withColumn("title", T.clean_title(F.col("title"))) if "title" in parts else rows


def captions(records: DataFrame) -> DataFrame:
    """A row per figure or panel."""
    return records.select("paper_id", F.explode("figures").alias("f")).select("paper_id", "f.figure_id", "f.sub_id", "f.html_id", "f.source", "f.caption", "f.sub_caption", "f.footnotes")


def _citing(pattern: Column) -> Column:
    """The distinct paragraphs of a record that match a pattern, the first of each, in order: array<struct<ord, text>>."""
    met = F.filter("paragraphs", lambda p: T.mentions(p["text"], pattern))
    first = F.transform(met, lambda p: p["text"])
    return F.filter(F.transform(met, lambda p, i: F.struct(p["ord"].alias("ord"), p["text"].alias("text"), (F.array_position(first, p["text"]) == i + 1).alias("new"))), lambda p: p["new"])


def _label():
    label = T.table_label(F.col("caption"))
    return F.when(label != "", label).otherwise(F.col("table_num").cast("string"))


def _table_rows(records: DataFrame, *kept: str) -> DataFrame:
    return records.select("paper_id", *kept, F.explode("tables").alias("t")).select("paper_id", *kept, "t.*").withColumn("label", _label())


def tables(records: DataFrame, references: bool = True, numeric: bool = False) -> DataFrame:
    """A row per table; with the paragraphs that mention its label, or with ``numeric`` its number alone.

    A page's tables and paragraphs lie in one record, so nothing is joined or parsed again.
    """
    rows = _table_rows(records, *["paragraphs"] * references)
    if references:
        name = F.col("table_num").cast("string") if numeric else F.col("label")
        rows = rows.withColumn("references", F.transform(_citing(T.table_mention(name, numeric)), lambda p: p["text"]))
    return rows.drop("paragraphs", "label")


def figure_references(records: DataFrame) -> DataFrame:
    """(paper_id, figure_id, ord, text) of the distinct paragraphs that mention a figure."""
    items = records.select("paper_id", "paragraphs", F.explode(F.array_distinct(F.transform("figures", lambda f: f["figure_id"]))).alias("figure_id"))
    return items.select("paper_id", "figure_id", F.explode(_citing(T.figure_mention(F.col("figure_id")))).alias("p")).select("paper_id", "figure_id", "p.ord", "p.text")


def table_references(records: DataFrame) -> DataFrame:
    """(paper_id, label, ord, text) of the distinct paragraphs that mention a table."""
    rows = _table_rows(records, "paragraphs").select("paper_id", "label", F.explode(_citing(T.table_mention(F.col("label")))).alias("p"))
    return rows.select("paper_id", "label", "p.ord", "p.text").distinct()


def dense_cells(table_rows: DataFrame) -> DataFrame:
    """Each table's cells repeated over their spans: (table_id, row, col, text)."""
    cell = table_rows.select("table_id", F.explode("cells").alias("c"))
    down, across = (F.coalesce(F.col(f"c.{k}"), F.lit(1)) for k in ("rowspan", "colspan"))
    rows = cell.withColumn("row", F.explode(F.sequence(F.col("c.row"), F.col("c.row") + down - 1)))
    return rows.withColumn("col", F.explode(F.sequence(F.col("c.col"), F.col("c.col") + across - 1))).select("table_id", "row", "col", "c.text")


def metadata(records: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """(url, paper_id, title, abstract, categories) of pages that hold something."""
    some = records.filter((F.col("title") != "") | (F.col("abstract") != "") | (F.size("figures") > 0) | (F.size("tables") > 0))
    rows = some.select("url", "paper_id", "title", "abstract")
    if categories is None:
        return rows.withColumn("categories", F.lit(""))
    return rows.join(categories.select("paper_id", T.joined_categories(F.col("categories")).alias("categories")), "paper_id", "left").fillna("", ["categories"]).select("url", "paper_id", "title", "abstract", "categories")


def item_captions(records: DataFrame) -> DataFrame:
    """Figure and table captions together, by item type."""
    figures = captions(records).select("paper_id", F.lit("figure").alias("item_type"), F.col("figure_id").alias("item_id"), "sub_id", "caption", "sub_caption")
    rows = tables(records, references=False).select("paper_id", F.lit("table").alias("item_type"), F.col("table_num").cast("string").alias("item_id"), "sub_id", "caption", "sub_caption")
    return figures.unionByName(rows)


def item_references(records: DataFrame) -> DataFrame:
    """Figure and table references together, from one pass over the records; panels of a table repeat its paragraphs."""
    figure = F.transform(F.array_distinct(F.transform("figures", lambda f: f["figure_id"])), lambda n: F.struct(F.lit("figure").alias("item_type"), n.alias("item_id"), T.figure_mention(n).alias("pattern")))

    def named(t):
        label = T.table_label(t["caption"])
        number = t["table_num"].cast("string")
        return F.struct(F.lit("table").alias("item_type"), number.alias("item_id"), T.table_mention(F.when(label != "", label).otherwise(number)).alias("pattern"))

    items = records.select("paper_id", "paragraphs", F.explode(F.concat(figure, F.transform("tables", named))).alias("x"))
    met = items.select("paper_id", "x.item_type", "x.item_id", F.posexplode(_citing(F.col("x.pattern"))).alias("place", "p"))
    return met.select("paper_id", "item_type", "item_id", F.when(F.col("item_type") == "figure", F.col("p.ord")).otherwise(F.col("place")).alias("ord"), F.col("p.text").alias("reference_text"))


def categories_of(feeds: DataFrame, scheme: str | None = None) -> DataFrame:
    """(paper_id, categories) from Atom XML: terms of the subject scheme, or those with a dot; first-seen order."""
    if scheme:
        terms = F.xpath("xml", F.lit(f"//*[local-name()='category'][@scheme='{scheme}']/@term"))
    else:
        terms = F.filter(F.xpath("xml", F.lit("//*[local-name()='category']/@term")), lambda t: t.contains("."))
    return feeds.select("paper_id", F.array_distinct(terms).alias("categories"))
