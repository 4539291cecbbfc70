"""Text of pages: malformed markup in linear time, quoted values, character references."""

import time
from html import unescape

import pytest
from pyspark.sql import functions as F

from drawfield.llm import warc


def texts(spark, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "n int, html string")
    return [r.t for r in rows.select("n", warc.plain_text(F.col("html")).alias("t")).orderBy("n").collect()]


CASES = [
    ("<p>one<br>two</p>", "one\ntwo"),
    ("a<img alt='x>y'>b", "ab"), ('a<img alt="x>y" src=z>b', "ab"), ("<a title=\"it's > here\">in</a>", "in"),
    ("<p>don't <b>stop</b> it's</p>", "don't stop it's"),
    ("x<script>var a = '<b>';</script>y", "x y"), ("x<SCRIPT type='a>b'>hidden</SCRIPT >y", "x y"),
    ("x<script>hidden", "x"), ("x<style>a<p>b", "x"), ("x<!-- a <p> --> y <!-- open", "x y"),
    ("<head><title>hidden</title><meta name=x></head><body>seen</body>", "seen"),
    ("<scripted>seen</scripted>", "seen"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("a <", "a <"), ("a<b", "a"),
    ("&eacute;&#233;&#xE9;&#x27;&mdash;&amp;lt;", "ééé'—&lt;"), ("&unknown; &#1114112; &#xD800; &; & &amp", "&unknown; &#1114112; &#xD800; &; & &amp"),
    ("&#128512;&#0;", "\U0001F600&#0;"), ("a&nbsp;b", "a b"), ("", ""), (" \n ", ""),
]


def test_cases(spark):
    got = texts(spark, [h for h, _ in CASES])
    for (html, want), text in zip(CASES, got):
        assert text == want, html


def test_references_are_those_of_the_standard_library(spark):
    names = [n for n in warc.NAMED if n != "nbsp"]
    page = " ".join(f"x&{n};y" for n in names)
    assert texts(spark, [page]) == [" ".join(f"x{unescape(f'&{n};')}y" for n in names)]


@pytest.mark.parametrize("part", ["<script>", "<!--", "<a ", "<a '", '<p "', "<title ", "<style", "&#", "&amp"])
def test_malformed_pages_take_linear_time(spark, part):
    texts(spark, ["warm-up &#65;"])
    start = time.time()
    texts(spark, [part * 32_000])
    assert time.time() - start < 6  # quadratic patterns took over a minute
