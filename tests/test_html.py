"""Elements of pages against the standard library's parser, and the columns made from them."""

import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalume.sources import html


class Counter(HTMLParser):
    """Tags of one name with the text before them."""

    def __init__(self, name):
        super().__init__(convert_charrefs=False)
        self.name, self.open, self.found, self.text = name, [], [], ""

    def handle_starttag(self, tag, attrs):
        if tag == self.name:
            self.open.append(len(self.found))
            self.found.append([len(self.text), None])

    def handle_endtag(self, tag):
        if tag == self.name and self.open:
            self.found[self.open.pop()][1] = len(self.text)

    def handle_data(self, data):
        self.text += data


PIECES = st.lists(st.sampled_from(["<div>", "<DIV class='a'>", "</div>", "</div >", "<p>", "</p>", "x", "yz ", "<divan>", "</divan>", "<!-- <div> -->", "<!-- </div> -->"]), max_size=30)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_elements_equal_a_parsers(pieces):
    page = "".join(pieces)
    parsed = Counter("div")
    parsed.feed(page)
    parsed.close()
    wanted = [parsed.text[a:b] for a, b in parsed.found]

    def plain(text):
        reader = Counter("div")
        reader.feed(text)
        reader.close()
        return reader.text

    assert [plain(page[a:b]) for a, b, _ in html.elements(page, "div")] == wanted


@pytest.mark.parametrize("tag, wanted", [("<a>", {}), ("<a href=x id='y z' Class = \"a b\" hidden>", {"href": "x", "id": "y z", "class": "a b", "hidden": ""}), ("<a href='1' href='2'/>", {"href": "1"}), ('<a title="x > y">', {"title": "x > y"})])
def test_attributes(tag, wanted):
    assert html.attributes(tag) == wanted


def test_paths():
    page = "<h3 class='t'>no</h3><h3 class='u t'><a href='/1'>one</a></h3><h3 class=t><a>two</a></h3>"
    assert html.first_match(page, "h3.t a") == "one"
    assert html.first_match(page, "h3.t a@href") == "/1"
    assert html.first_match(page, "h3.t a@name") is None
    assert html.first_match(page, "div a") is None
    assert html.first_match("", "a") is None


def test_many_nested_elements_in_one_page():
    n = 100_000
    begun = time.time()
    found = html.elements("<div>" * n + "x" + "</div>" * n, "div")
    assert len(found) == n and found[0][:2] == (5, 11 * n + 1 - 6) and found[-1][:2] == (5 * n, 5 * n + 1)
    for piece in ("<div ", "</div>", "<!--", "<div '", '<div a="', "<script>", "<!-- <div> ->"):
        assert html.elements(piece * n, "div") == []
    assert time.time() - begun < 20


def test_tables_and_records_of_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<table>"), (4, "<table><tr><td>a<td>b</tr></table>"), (5, "<table><tr><th> x &amp; y </th></tr></table></table>")]
    pages = spark.createDataFrame([(i, h, "mine") for i, h in rows], "page_id long, html string, item_no string")
    found = {r.page_id: r.t for r in pages.select("page_id", html.tables(F.col("html")).alias("t")).collect()}
    assert found == {1: [], 2: [], 3: [""], 4: ["a b\tb"], 5: ["x & y"]}
    cells = html.select_records(pages, "tr", {"page": "td"})
    assert cells.columns == ["page_id", "item_no", "page"]
    assert sorted(tuple(r) for r in cells.collect()) == [(4, 0, "a b"), (5, 0, None)]
    assert html.select_records(pages.limit(0), "tr", {"page": "td"}).count() == 0
