"""Template removal on the pages, with and without markup that says what is the article."""

import re
import time

import pytest

from tessera.llm import html
from tessera.llm.queries import op8_html_extraction

SF = "/root/testdata/sf0.1"


def article_text(page):
    """The text of the one article element of a generated page, worked out without a tree."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    body = re.sub(r"<(?:/?(?:p|h1|ul|li|div)|article)[^>]*>", "\n", body)
    lines = [" ".join(html.html.unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|a|i|em)(?:\s[^>]*)?>", "", x))).split()) for x in body.split("\n")]
    return "\n".join(x for x in lines if x)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


def test_query_gives_the_article_of_every_page(spark, pages):
    want = {r["page_id"]: article_text(r["html"]) for r in pages.collect()}
    rows = op8_html_extraction(spark, SF).collect()
    assert len(rows) == len(want) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in rows)


def test_templates_find_the_article_without_markup(spark, pages):
    """With articles, menus, footers and class names left aside, only what recurs on a host's pages can tell."""
    want = {r["page_id"]: article_text(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html.extract(pages, trust_markup=False).collect()}
    plain = {r["page_id"]: r["text"] for r in html.extract(pages, trust_markup=False, min_pages=1 << 40).collect()}
    assert sum(got[p] != plain[p] for p in want) > 0.5 * len(want)
    assert all(want[p] in got[p] for p in want)
    assert sum(map(len, want.values())) >= 0.95 * sum(map(len, got.values()))
    assert sum(len(got[p]) - len(want[p]) for p in want) < 0.5 * sum(len(plain[p]) - len(want[p]) for p in want)


def test_menus_with_an_active_entry_are_one_template(spark):
    menu = "<div class='menu'><ul>" + "".join("<li class='item-{0}'>Entry {0}</li>".format(k) for k in "abc") + "</ul></div>"
    rows = [(i, "http://h/x", menu.replace(f"item-{'abc'[i % 3]}", "item active") + f"<section><p>Story {i} is its own</p></section>") for i in range(9)]
    found = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(found, trust_markup=False).collect()}
    assert got == {i: f"Story {i} is its own" for i in range(9)}


def test_rows_without_an_id_have_their_host_s_templates(spark):
    rows = [(None if i % 2 else 7, "http://h/x", f"<div class=box>Box</div><article><div>Inner box</div><p>Story {i} is longer</p></article>") for i in range(12)]
    found = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r["text"] for r in html.extract(found).collect()) == sorted(f"Story {i} is longer" for i in range(12))


def test_many_slots_are_joined_by_host(spark, pages, monkeypatch):
    some = pages.where("page_id < 400")
    want = sorted(html.extract(some, trust_markup=False).collect())
    monkeypatch.setattr(html, "BROADCAST_SLOTS", -1)
    assert sorted(html.extract(some, trust_markup=False).collect()) == want


def test_two_articles_and_a_heading_before_them():
    page = "<nav>Menu</nav><main><h1>Head</h1><article><p>One</p></article><div class=ad>Ad</div><article><p>Two</p></article></main><footer>End</footer>"
    assert html.extract_text(page) == "Head\nOne\nTwo"


@pytest.mark.parametrize("page", ["<div>{0}x{1}", "<p><table>{2}x", "<ul>{3}x", "<p>{4}</p>"])
def test_time_grows_with_length_alone(page):
    def seconds(n):
        text = page.format("<div>" * n, "</div>" * n, "<div><li>" * n, "<li><ul>" * n, "<textarea>" * n)
        start = time.process_time()
        html.extract_text(text)
        html.subtrees(text)
        return time.process_time() - start

    seconds(2_000)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.05)


def test_the_bulk_of_an_article_is_no_template(spark):
    """One body under many headings: the articles differ, but their body is no part of the site's template."""
    body = "<div class=content>" + "The same long story stands here. " * 9 + "</div>"
    rows = [(i, "http://h/x", f"<nav>Menu</nav><article><h1>Title {i}</h1>{body}<div class=x>Box</div></article>") for i in range(12)]
    found = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(found).collect()}
    assert got == {i: f"Title {i}\n" + ("The same long story stands here. " * 9).strip() for i in range(12)}
