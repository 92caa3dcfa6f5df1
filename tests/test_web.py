import re
from pathlib import Path

import pytest

from strataloom.functions.html import blocks_of
from strataloom.operators import web
from strataloom.sources import shared

LONG = " ".join(f"word{i}" for i in range(20))
DATA = Path("/root/testdata/sf0.01")


def texts(page):
    return [b[0] for b in blocks_of(page)[1]]


def test_blocks_of_a_page():
    title, blocks = blocks_of(
        '<!DOCTYPE html><title>A &amp; B\n c</title><script>var t = "<p>no</p>";</SCRIPT ><nav><ul><li><a href="/x>y">Home page</a></ul></nav><!-- <p>gone</p> --><h1>Head<b>line</b></h1>'
        "<p>One <a href='q'>two three</a> four&nbsp;five<br>six &lt;7&gt; a < b</p>tail"
    )
    assert title == "A & B c"
    assert blocks == [("Home page", 2, 2, True, False), ("Headline", 1, 0, False, True), ("One two three four five six <7> a < b", 10, 2, False, False), ("tail", 1, 0, False, False)]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<p class='never ends", "</", "<!--", "<script>x", "<title>only", "&#xD800; &bogus; &amp", "<a><a><a></p></nav></nav>x", "<<p>>"])
def test_broken_pages_are_read_as_they_come(page):
    title, blocks = blocks_of(page)
    assert isinstance(title, str) and all(len(b) == 5 for b in blocks)


def test_a_page_cut_anywhere_keeps_the_blocks_before():
    page = "<body>" + "".join(f'<div class="c{i}"><p>text {i} <a href="{i}">link</a></p></div>' for i in range(30)) + "</body>"
    whole = texts(page)
    for at in range(0, len(page), 7):
        cut = texts(page[:at])
        assert cut[:-1] == whole[: max(0, len(cut) - 1)]


def test_an_anchor_ends_with_its_block_and_furniture_with_its_element():
    assert [b[2:4] for b in blocks_of("<p><a>one two</p><p>three four</p><footer>five<p>six</p></footer><p>seven</p>")[1]] == [(2, False), (0, False), (0, True), (0, True), (0, False)]


def test_long_pages_take_time_in_proportion():
    import time

    took = []
    for n in (20_000, 80_000):
        page = "<p>some words <b>x</b><script>a<b</script></p>" * n
        at = time.time()
        assert len(texts(page)) == n
        took.append(time.time() - at)
    assert took[1] < 12 * took[0]


SCHEMA = "page_id long, url string, html string, title string, text string, blocks int, `__host` string"


def page(i, url, html):
    return (i, url, html, "t", "x", 1, "h")


def rows():
    made = [page(i, f"http://Big.example:80/{i}", f"<p>{LONG} {i}</p><p>Share this page with all of your friends and subscribe to our news letter every single day now</p><p>short {i}</p><p>lonely one</p><p>{i}</p>") for i in range(12)]
    made += [page(20, "http://u@small.example/", f"<p>{LONG}</p><div><a>{LONG}</a></div><aside>{LONG}</aside><h2>heading</h2><p>{LONG}</p>"), page(21, None, f"<p>{LONG}</p>"), page(22, "no url at all", None), page(None, "http://small.example/", "")]
    return made + [made[0], made[0]]


def test_judged_pages(spark):
    cleaned = web.judged_pages(spark.createDataFrame([r[:3] for r in rows()], "page_id long, url string, html string")).collect()
    assert len(cleaned) == len(rows())
    for r in cleaned:
        got = [(b.kept, b.template) for b in r.blocks]
        if r.page_id is not None and r.page_id < 12:
            # the line that all pages of the host hold goes; what stands beside a long block stays
            assert got[:4] == [(True, False), (False, True), (True, False), (False, "lonely" in r.blocks[3].text)]
        elif r.page_id == 20:
            assert got == [(True, False), (False, False), (False, False), (True, False), (True, False)]
        else:
            assert got == ([(True, False)] if r.page_id == 21 else [])


def test_clean_pages_keep_other_columns_and_take_no_rows(spark):
    cleaned = web.clean_pages(spark.createDataFrame([r[:3] + ("w",) for r in rows()], "page_id long, url string, html string, `__salt` string"))
    assert cleaned.columns == ["page_id", "url", "__salt", "title", "text", "n_blocks", "n_kept"]
    assert {r.page_id: r.text for r in cleaned.collect()}[20] == f"{LONG}\nheading\n{LONG}"
    assert web.clean_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_host_of_most_pages_is_salted_where_templates_are_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    cleaned = web.judged_pages(spark.createDataFrame([r[:3] for r in rows()], "page_id long, url string, html string"))
    assert sum(b.template for r in cleaned.collect() for b in r.blocks) == 2 * 14


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_articles_stay_and_furniture_goes(spark):
    got = {r.page_id: r.text.split() for r in web.clean_pages(spark.read.parquet(f"{DATA}/pages.parquet")).select("page_id", "text").collect()}
    stayed = total = outside = 0
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search("<article>(.*?)(</article>|$)", r.html, re.DOTALL).group(1)
        words = " ".join(b[0] for b in blocks_of(article)[1]).split()
        total += len(words)
        kept = len(got[r.page_id])
        inside = len(set(got[r.page_id]) & set(words)) and min(kept, len(words))
        stayed += inside
        outside += kept - inside
    assert stayed > 0.97 * total and outside < 0.001 * total, (stayed, total, outside)
