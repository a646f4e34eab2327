"""Text and vector functions, and the decisions on odd inputs."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import vectors as V
from paperloom.operators import agents


@pytest.fixture(scope="module")
def of(spark):
    def run(f, *values):
        df = spark.createDataFrame([values], ", ".join(f"c{i} {'int' if isinstance(v, int) else 'string'}" for i, v in enumerate(values)))
        return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first().x

    return run


def test_white_space_and_titles(of):
    assert of(T.collapse, " a \n b ") == "a b"
    assert of(T.clean_title, "Deep things  DOI: 10.1/x") == "Deep things"
    assert of(T.clean_title, "Deep This work was supported by none") == "Deep"


def test_captions(of):
    assert of(T.caption_number, "see FIGURE  12b") == 12 and of(T.caption_number, "none") is None
    assert [tuple(r) for r in of(T.subcaptions, "Figure 1: (a) First. (b) Second.")] == [("a", "First."), ("b", "Second.")]
    assert [tuple(r)[0] for r in of(T.subcaptions, "(a) f(x) plot (b) g")] == ["a", "x", "b"]
    assert of(T.caption_or_sub, "  ", "sub ") == "sub" and of(T.anchored, "u", " ") == "u" and of(T.anchored, "u", "S1") == "u#S1"


@pytest.mark.parametrize(("caption", "label"), [("Table 3: x", "3"), ("TABLE III", "III"), ("Table A1. y", "A1"), ("Tab. B.2", "B2"), ("Table A: z", ""), ("none", ""), ("Tab.4b", "4")])
def test_table_labels(of, caption, label):
    assert of(T.table_label, caption) == label


@pytest.mark.parametrize(("text", "number", "found"), [("Fig. 3", "3", True), ("Figure 3(a)", "3", True), ("Fig.3a", "3", True), ("figure 30", "3", False), ("Figs. 3", "3", False), ("Figure 3.2", "3", True), ("config 3", "3", False), ("fig 3-b.", "3", True)])
def test_figure_mentions(of, text, number, found):
    assert of(lambda t, n: T.mentions(t, T.figure_mention(n)), text, number) is found


@pytest.mark.parametrize(("text", "label", "found"), [("Table B.2 shows", "B2", True), ("Table B2", "B2", True), ("TABLE iii", "III", True), ("Table 30", "3", False), ("Tab. 3-1", "3", True)])
def test_table_mentions(of, text, label, found):
    assert of(lambda t, n: T.mentions(t, T.table_mention(n)), text, label) is found


def test_categories_and_lengths(of):
    assert of(T.first_category, "cs.LG; math.ST") == "cs.LG" and of(lambda c: T.first_category(c, "unknown"), " ") == "unknown"
    assert of(T.category_list, " a;; b ") == ["a", "b"] and of(T.category_list, "") == [T.UNCATEGORISED]
    assert of(T.word_count, "") == 0 and of(T.length_bucket, "a " * 60, "") == "medium" and of(T.length_bucket, "a " * 61, "") == "long"
    assert of(T.cut_text, "ab " * 250) == ("ab " * 200)[:599] + " ..." and of(T.cut_text, "x" * 700) == "x" * 600 + " ..."


def test_scrubbing_and_json(of):
    assert of(T.scrub_mentions, "as fig. 3b and figure out this") == "as and this"
    assert of(T.has_placeholder, "a <thing> b") and not of(T.has_placeholder, "a < b")
    assert of(T.first_object, 'x ```json\n{"query": "é", "n": {"a": 1}}\n``` tail {') == '{"query": "é", "n": {"a": 1}}'
    assert of(T.first_object, "none") is None and of(T.first_object, "[1]") is None
    assert of(lambda r: T.verdict(T.first_object(r)), '{"verdict": "accept"}') == "ACCEPT" and of(lambda r: T.verdict(T.first_object(r)), "?") == "REJECT"


def test_ids_and_paths(of):
    assert of(lambda n: T.paper_id(F.lit("24"), F.lit("10"), n), 10) == "2410.00010" and of(T.paper_of_table, "2410.00010_T3a") == "2410.00010"
    assert of(T.uid_stem, "p::FF3") == "p_3" and of(T.path_stem, "x/p/1a.png") == "1a" and of(T.path_paper, "x/p/1a.png") == "p"
    assert of(T.roman_value, "XIV") == 14 and of(T.roman_value, "12") is None and of(T.year_month, "24") is None


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [1.0, 0.0]), (2, [0.0, 0.0], None)], "i int, a array<float>, p array<float>")
    got = {r.i: r for r in df.select("i", V.norm(F.col("a")).alias("n"), V.normalised(F.col("a")).alias("u"), V.is_zero(F.col("a")).alias("z")).collect()}
    assert got[1].n == 5 and got[1].u == [0.6, 0.8] and got[2].n == 1 and got[2].u == [0, 0] and got[2].z and not got[1].z
    patches = np.array([[1, 0], [0.99, 0.01], [0, 1], [0.01, 0.99], [1, 0.02], [0, 0.9]], np.float32)
    small = V.pooled(patches, 3)
    assert small.shape == (2, 2) and {int(r.argmax()) for r in small} == {0, 1} and V.pooled(patches, 1) is patches


def test_image_text_is_one_line(of):
    assert of(lambda c: T.image_text(c.cast("binary")), "x" * 100) == base64.b64encode(b"x" * 100).decode()


def test_agent_rounds():
    def model(*replies):
        return agents.ScriptedModel(list(replies))

    good, yes, no = '{"query": "cells dividing fig. 2"}', '{"verdict": "accept"}', '{"verdict": "reject", "feedback": "shorter"}'
    assert agents.rounds(model(good, yes), "c") == ("cells dividing", 1)
    m = model("no", good, no, good, yes)
    assert agents.rounds(m, "c") == ("cells dividing", 3)
    assert agents.UNREADABLE in m.asked[1][1]["content"][0]["text"] and "shorter" in m.asked[3][1]["content"][0]["text"]
    assert agents.rounds(model(good, no), "c", most=1) == (None, 1) and agents.rounds(model('{"query": "<topic>"}'), "c") == (None, 3)
    assert agents.review(model('{"verdict": "maybe"}'), "c", "q")[0] == "REJECT" and agents.review(model("?"), "c", "q")[0] == "REJECT"
    assert agents.typed([{"role": "user", "content": "x"}], b"i")[0]["content"][0]["type"] == "image"
