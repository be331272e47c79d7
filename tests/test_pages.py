"""Bodies of pages against an HTML parser."""

import re
from html.parser import HTMLParser

from corpusmill.functions.text import html_body
from corpusmill.plans import QUERIES
from pyspark.sql import functions as F

APART = {"script", "style", "nav", "header", "footer", "noscript", "title"}
BLOCKS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article"}


class Body(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.apart, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        if tag in APART:
            self.apart.append(tag)
        elif tag in BLOCKS and not self.apart:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.apart and tag == self.apart[-1]:
            self.apart.pop()
            self.parts.append(" ")
        elif tag in BLOCKS and not self.apart:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.apart:
            self.parts.append(data)


def words(text):
    return [re.findall(r"\S+", line) for line in text.split("\n") if line.strip()]


def test_bodies(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r.body for r in QUERIES["page_bodies"](spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for i, html in pages.items():
        parser = Body()
        parser.feed(html or "")
        parser.close()
        assert [w for line in words(got[i]) for w in line] == [w for line in words("".join(parser.parts)) for w in line], i


def test_entities_and_empty_pages(spark):
    rows = spark.createDataFrame([("<p>a &lt;b&gt; &amp;lt;</p>",), (None,), ("<SCRIPT>x</SCRIPT> y<br/>z",)], "h string")
    assert [r[0] for r in rows.select(html_body(F.col("h"))).collect()] == ["a <b> &lt;", "", "y\nz"]
