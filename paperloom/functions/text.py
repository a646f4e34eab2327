"""Scalar functions over text columns, as native expressions unless said otherwise.

Patterns are Java's; where Python's Unicode classes matter they carry the ``U`` flag.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Longest abstract in a prompt, and the word counts that divide captions by length.
ABSTRACT_LIMIT = 600
SHORT, MEDIUM = 20, 60
UNCATEGORISED = "_uncategorised"

_NOISE = (
    r"(?is)(\s*\b(isbn|doi|price|note|thanks|ccs|conference|journal)\s*:"
    r"|this\s+(work\s+was\s+supported|material\s+is\s+based|is\s+a\s+preprint)).*$"
)


def blank(x: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(x, F.lit(""))


def collapse(x: Column) -> Column:
    """Runs of Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def clean_title(x: Column) -> Column:
    """A title up to the first trace of venue or funding notes."""
    return F.trim(F.regexp_replace(x, _NOISE, ""))


def caption_number(caption: Column, kind: str = "Figure") -> Column:
    """The number after ``Figure`` or ``Table`` in a caption, or null."""
    return F.regexp_extract(caption, rf"(?i)\b{kind}\s+(\d+)", 1).try_cast("int")


def subcaptions(caption: Column) -> Column:
    """array<struct<label, text>> of the lettered parts of a caption."""
    pattern = F.lit(r"[(]([a-z])[)]\s*([^)]*?)(?=\s*[(][a-z][)]|$)")
    labels, texts = F.regexp_extract_all(caption, pattern, F.lit(1)), F.regexp_extract_all(caption, pattern, F.lit(2))
    return F.transform(F.arrays_zip(labels.alias("label"), texts.alias("text")), lambda p: F.struct(p["label"].alias("label"), F.trim(p["text"]).alias("text")))


def table_label(caption: Column) -> Column:
    """Label of a table caption: optional appendix letter, then digits or a Roman numeral.

    A word boundary must precede the number, so that ``Table A:`` has no label, and a dot
    between letter and number is dropped. Empty where there is none.
    """
    pattern = r"(?i)\btab(?:le|[.])?(?:\s+|(?=\d))([A-Z](?=[.]?\d)|)[.]?(\d+|[IVXLCDM]+(?![A-Za-z]))"
    return F.concat(F.regexp_extract(caption, pattern, 1), F.regexp_extract(caption, pattern, 2))


def roman_value(x: Column) -> Column:
    """Value of a Roman numeral, null where it is none."""
    digits = F.transform(F.split(F.upper(x), ""), lambda c: F.element_at(F.create_map(*[F.lit(v) for p in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000)) for v in p]), c))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    total = F.aggregate(F.reverse(digits), start, lambda a, v: F.struct((a["sum"] + F.when(v >= a["last"], v).otherwise(-v)).alias("sum"), v.alias("last")), lambda a: a["sum"])
    return F.when(x.rlike("(?i)^[IVXLCDM]+$") & (total > 0), total)


def paper_of_table(table_id: Column) -> Column:
    """The paper part of a table id."""
    return F.regexp_extract(table_id, r"^(.+?)_T\d+", 1)


def first_category(categories: Column, default: str = "") -> Column:
    """The first of semicolon-separated categories."""
    first = F.trim(F.split(blank(categories), ";")[0])
    return F.when(first == "", F.lit(default)).otherwise(first)


def category_list(categories: Column) -> Column:
    """All non-empty categories, or the bucket of those without."""
    parts = F.filter(F.transform(F.split(blank(categories), ";"), lambda c: F.trim(c)), lambda c: c != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(UNCATEGORISED)))


def word_count(x: Column) -> Column:
    """Words between white space; none in a blank text."""
    t = collapse(blank(x))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def length_bucket(caption: Column, sub_caption: Column) -> Column:
    """short, medium or long, by the words of caption and sub-caption."""
    n = word_count(F.concat_ws(" ", caption, sub_caption))
    return F.when(n < SHORT, "short").when(n <= MEDIUM, "medium").otherwise("long")


def cut_text(x: Column, limit: int = ABSTRACT_LIMIT) -> Column:
    """A text over ``limit`` characters ends at its last blank before that, with an ellipsis."""
    head = F.substring(x, 1, limit)
    back = F.locate(" ", F.reverse(head))
    cut = F.when(back > 0, F.substring(head, F.lit(1), F.lit(limit) - back)).otherwise(head)
    return F.when(F.length(x) > limit, F.concat(cut, F.lit(" ..."))).otherwise(x)


def scrub_mentions(x: Column) -> Column:
    """Drop words that point at a figure (``fig. 3``, but also what follows any ``figure``)."""
    return collapse(F.regexp_replace(x, r"(?i)\bfig(?:ure)?[.]?\s*[a-z\d]+\b", ""))


def one_line(x: Column) -> Column:
    """A value fit for a line of tab-separated text."""
    return F.trim(F.regexp_replace(x, r"[\t\r\n]+", " "))


def has_placeholder(x: Column) -> Column:
    """Whether a query still holds an angle-bracketed placeholder."""
    return x.rlike(r"<[^>]{1,60}>")


def figure_mention(number: Column) -> Column:
    """Pattern that finds mentions of a figure's number; a letter may follow, digits may not."""
    return F.concat(F.lit(r"(?i)\bfig(?:ure)?[.]?\s*"), number, F.lit(r"(?:-?[a-z]|[(][a-z][)])?\b"))


def table_mention(label: Column, numeric: bool = False) -> Column:
    """Pattern that finds mentions of a table's label; an appendix letter may be set off by a dot."""
    if numeric:
        return F.concat(F.lit(r"(?i)\btab(?:le|[.])?\s*"), label, F.lit(r"(?:-?[a-z]|[(][a-z][)])?\b"))
    spread = F.regexp_replace(label, r"^([A-Za-z])(?=\d)", "$1[.]?")
    return F.concat(F.lit(r"(?i)\btab(?:le|[.])?\s*"), spread, F.lit(r"(?:[a-z]|[(][a-z][)]|[.-][a-z\d])?\b"))


def mentions(text: Column, pattern: Column) -> Column:
    """Whether a text has a match of a row's own pattern."""
    return F.regexp_like(text, pattern)


def decode_first_object(raw: str | None) -> str | None:
    """The first JSON object of a reply, code fences and trailing prose set aside, re-encoded."""
    if raw is None:
        return None
    text = re.sub(r"```(?:json)?", "", raw).strip()
    at = text.find("{")
    if at < 0:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(text[at:])
    except ValueError:
        return None
    return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None


@F.pandas_udf(StringType())
def first_object(raw: pd.Series) -> pd.Series:
    """Column form of :func:`decode_first_object`; Spark's own parsers reject trailing text."""
    return raw.map(decode_first_object, na_action="ignore")


def json_field(obj: Column, name: str, default: str = "") -> Column:
    """A field of a JSON object as trimmed text."""
    return F.coalesce(F.trim(F.get_json_object(obj, f"$.{name}")), F.lit(default))


def verdict(obj: Column) -> Column:
    """ACCEPT or REJECT; whatever cannot be read rejects."""
    v = F.upper(json_field(obj, "verdict"))
    return F.when(v == "ACCEPT", v).otherwise("REJECT")


def context_block(title: Column, abstract: Column, categories: Column, figure_id: Column, sub_id: Column, caption: Column, sub_caption: Column, references: Column) -> Column:
    """The lines that describe a figure to an agent."""
    sub = F.when(blank(sub_id) != "", F.concat(F.lit(" (sub-figure "), sub_id, F.lit(")"))).otherwise("")
    cited = F.when(blank(references) == "", "(none found)").otherwise(references)
    lines = [
        ("Paper title: ", blank(title)), ("Paper abstract: ", cut_text(blank(abstract))), ("Paper categories: ", blank(categories)), ("Figure id: ", F.concat(figure_id, sub)),
        ("Figure caption: ", blank(caption)), ("Sub-caption: ", blank(sub_caption)), ("How the figure is referenced elsewhere in the text: ", cited),
    ]
    return F.concat_ws("\n", *[F.concat(F.lit(k), v) for k, v in lines])


def result_context(image_id: Column, paper_id: Column, title: Column, score: Column, caption: Column, sub_caption: Column, paragraphs: Column, most: int = 3, chars: int = 400) -> Column:
    """The lines that cite a search result: score to three places and the first paragraphs, cut."""
    shown = F.least(F.size(paragraphs), F.lit(most))
    cut = F.transform(F.slice(paragraphs, 1, most), lambda p: F.concat(F.lit("  • "), F.substring(p, 1, chars), F.when(F.length(p) > chars, "...").otherwise("")))
    head = F.concat(F.lit("Cited in the paper ("), shown.cast("string"), F.lit(" of "), F.size(paragraphs).cast("string"), F.lit(" paragraph(s) shown):"))
    named = F.when(blank(title) != "", title).otherwise(paper_id)
    return F.concat_ws(
        "\n",
        F.format_string("[Figure %s]", image_id), F.format_string("Paper: %s  (id: %s)", named, paper_id), F.format_string("Retrieval score: %.3f", score), F.concat(F.lit("Caption: "), caption),
        F.when(blank(sub_caption) != "", F.concat(F.lit("Sub-panel caption: "), sub_caption)),
        F.when(F.size(paragraphs) > 0, F.concat_ws("\n", head, F.array_join(cut, "\n"))),
    )


def shown_percent(score: Column) -> Column:
    """A share as a percentage with one decimal."""
    return F.round(score * 100, 1)


def shown_caption(caption: Column) -> Column:
    """The first 120 characters."""
    return F.substring(caption, 1, 120)


def path_paper(path: Column) -> Column:
    """The folder a file lies in."""
    return F.element_at(F.split(path, "/"), -2)


def path_stem(path: Column) -> Column:
    """A file's name without folders and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"[.][^.]*$", "")


def uid_stem(uid: Column) -> Column:
    """``paper::F3`` as ``paper_3``; every leading F goes."""
    parts = F.split(uid, "::")
    return F.concat_ws("_", parts[0], F.regexp_replace(F.element_at(parts, -1), "^F+", ""))


def paper_id(year: Column, month: Column, number: Column) -> Column:
    """``YYMM.NNNNN``."""
    return F.concat(year, month, F.lit("."), F.lpad(number.cast("string"), 5, "0"))


def year_month(paper: Column) -> Column:
    """struct<year, month> of an identifier, null where it is too short."""
    return F.when(F.length(paper) >= 4, F.struct(F.substring(paper, 1, 2).alias("year"), F.substring(paper, 3, 2).alias("month")))


def joined_categories(categories: Column) -> Column:
    return F.array_join(categories, "; ")


def without_letter(figure: Column) -> Column:
    """A figure id without trailing panel letters a to j."""
    return F.regexp_replace(figure, "[a-j]+$", "")


def anchored(url: Column, html_id: Column) -> Column:
    """A page's URL with an anchor where there is one."""
    return F.when(F.trim(blank(html_id)) != "", F.concat(url, F.lit("#"), F.trim(html_id))).otherwise(url)


def caption_or_sub(caption: Column, sub_caption: Column) -> Column:
    """The caption, or the sub-caption where it is blank."""
    return F.coalesce(F.nullif(F.trim(caption), F.lit("")), F.trim(blank(sub_caption)))


def image_text(content: Column) -> Column:
    """Base64 of an image's bytes as stored, on one line; Spark breaks it after 76 characters."""
    return F.translate(F.base64(content), "\r\n", "")
