import html as library
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from tierlabel.llm.common import table
from tierlabel.llm.pages import Block, BlockRules, blocks_of, extract_text, label_blocks, labelled_blocks, main_text, stop_density

PAGES = T.StructType([T.StructField("page_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("url", "html", "text", "n_chars", "good", "place")]])
LONG = "The river is as wide as the road that leads to the town, and it was there that we saw the old mill for the first time."
NAMES = "Alexander Barbara Christopher Dorothy Ferdinand Gwendolyn Henrietta Isabella Jonathan Katherine Leopold"


def test_boilerplate_elements_are_left_out():
    page = f"""<!DOCTYPE html><html><head><title>The title of it</title><style>p{{}}</style></head><body class="has-sidebar">
      <header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home and the news</a></ul></nav>
      <div class="cookieNotice">{LONG}</div><div id="top-ad">{LONG}</div><script>var t="</p><p>{LONG}</p>";</script>
      <main><article><header><h1>Old mill</h1><p>By A. Writer</p></header><p>{LONG}</p><!-- <p>no</p> --><p>Short one.</p>
      <form><p>{LONG}</p><input name=q></form><aside><p>{LONG}</p></aside><p hidden>{LONG}</p><p>{LONG} Again.</p></article>
      <section id="comments"><article class="comment"><p>{LONG} I liked it.</p></article></section></main>
      <div class="sidebar">{LONG}</div><footer>&copy; {LONG}</footer></body></html>"""
    assert main_text(page) == f"Old mill {LONG} Short one. {LONG} Again."


def test_rules_without_an_article():
    menu = "<div><a href=x>News of the day</a> | <a href=y>All about us and the team</a> | <a href=z>Contact</a></div>"
    page = f"<body>{menu}<div>Tiny.</div><p>{LONG}</p><p>So it is.</p><p>{LONG}</p><div>{NAMES}</div><div>End</div></body>"
    # short blocks go with their nearest decided neighbour; of two as near, with the good one
    assert main_text(page) == f"Tiny. {LONG} So it is. {LONG}"


def test_text_of_blocks():
    page = "<article><p>A&amp;amp;B &#8364;&nbsp;5 &lt;b&gt;<br>x<b>y</b>z\n\t w <p>1 < 2 and a<b>c</b> <i>d</i>e</article>"
    assert main_text(page) == "A&amp;B € 5 <b> xyz w 1 < 2 and ac de"


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("plain words", "plain words"),
        ("<article>Be.</article>", "Be."),
        ("<p>one</p></div></nav></p><p>two", "one two"),
        ("<p>one<!-- never closed <p>two</p>", "one"),
        ("<p>one<script>never closed", "one"),
        ("<p>one<a href='x", "one"),
        ('<p title="a > b">one</p><p title=don\'t>two</p>', "one two"),
        ("<div hidden><p>x</p></div><p>one", "one"),
        ("<ul><li>one<li>two</ul>", "one two"),
        ("<nav><p>x<p>y</nav>one", "one"),
        ("<ul><li class=ad>x<li>two</ul>", "two"),
        ("<p><b>one<br><p>two</b></p><div>three", "one two three"),
        (f"<a href=x><h3>{LONG}</h3></a><p>{LONG} Own.</p>", f"{LONG} Own."),
        (f"<a href=x><a href=y>z</a><p>{LONG}</p>", LONG),
        ("1 < 2 <3 <", "1 < 2 <3 <"),
    ],
)
def test_odd_pages(page, want):
    assert main_text(page) == want


def test_long_and_deep_pages_take_time_in_proportion():
    for page in ("<div>" * 100_000 + "</p>" * 100_000 + "x", "<p>" * 200_000 + "x", "<" * 300_000, "<a href=\"" * 50_000, "<!--" * 50_000, "<b>x" * 100_000 + "</i>" * 100_000, "<script>" * 50_000, "a</" * 100_000):
        main_text(page)
    assert main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>") == " ".join([LONG] * 20_000)


def test_labels_equal_a_plain_reading_of_the_rules():
    rules = BlockRules()
    r = random.Random(2)
    kinds = [("s", 20, 0), ("g", 100, 0), ("n", 100, 0), ("m", 100, 0), ("l", 30, 25)]
    words = {"g": "the of is", "n": "stone brick", "m": "the stone brick wall door roof beam nail saw plank", "s": "the tiny one", "l": "link to"}
    for _ in range(300):
        blocks = []
        for _ in range(r.randrange(1, 14)):
            kind, size, linked = r.choice(kinds)
            text = (words[kind] + " ") * 60
            blocks.append(Block(text[:size].strip(), linked, r.choice([0, 0, 1])))
        first = []
        for b in blocks:
            density = stop_density(b.text, rules.stop_words)
            if b.link_chars > rules.max_link_density * len(b.text):
                first.append(False)
            elif len(b.text) >= rules.short and density >= rules.high_density:
                first.append(True)
            elif len(b.text) >= rules.short and density < rules.low_density and not b.part:
                first.append(False)
            else:
                first.append(None)
        second = []
        for i, b in enumerate(blocks):
            own = [j for j, x in enumerate(blocks) if x.part == b.part]
            at = own.index(i)
            decided = [(abs(own.index(j) - at), not first[j]) for j in own if first[j] is not None]
            second.append(not min(decided)[1] if decided else True)
        inside = sum(len(b.text) for b, s in zip(blocks, second) if s and b.part)
        if inside and 2 * inside >= sum(len(b.text) for b, s in zip(blocks, second) if s):
            second = [s and b.part > 0 for b, s in zip(blocks, second)]
        assert label_blocks(blocks).tolist() == second


def test_given_pages_give_their_articles(spark, small):
    rows = table(spark, small, "pages")
    found = {r.page_id: r for r in extract_text(rows).collect()}
    for p in rows.collect():
        article = re.search(r"(?s)<article>(.*)</article>", p.html).group(1)
        want = " ".join(library.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>|<br>", " ", article))).split())
        assert (found[p.page_id].text, found[p.page_id].n_chars, found[p.page_id].url) == (want, len(want), p.url)


def test_tables(spark):
    rows = [(1, "u", f"<p>{LONG}</p>"), (1, "u", f"<p>{LONG}</p>"), (None, None, None), (2, None, "")]
    pages = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES)
    assert sorted(map(tuple, extract_text(pages).collect()), key=repr) == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, None, "", 0)], key=repr)
    found = labelled_blocks(pages).collect()
    assert [(r.page_id, r.place, r.text, r.good) for r in found] == [(1, 0, LONG, True)] * 2
    assert extract_text(pages.limit(0)).collect() == [] and labelled_blocks(pages.limit(0)).collect() == []
    assert label_blocks([]).dtype == np.bool_
