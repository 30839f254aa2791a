"""Main content of pages that do not mark it, by hand-labelled pages; pages with characters that no encoding holds."""

import pytest

from larkspur.functions import content, html

TEXT = "A river, as it nears the sea, slows and drops what it carried, and so builds land where there was none before."
MORE = "What it builds is flat, fertile and never still: banks break, channels wander, and every flood redraws the map."
MENU = '<div id="menu"><ul>' + "".join(f'<li><a href="/{k}">A link to page {k}, with a long name</a></li>' for k in range(12)) + "</ul></div>"

PAGES = {
    "a div among menu, advertisement and footer": (f'<body>{MENU}<div class="ad"><p>{MORE * 3}</p></div><div class="story"><h1>Deltas</h1><p>{TEXT}</p><p>{MORE}</p></div><footer><p>{TEXT}</p></footer></body>', f"# Deltas\n{TEXT}\n{MORE}"),
    "paragraphs in the body itself": (f"<body><p>{TEXT}</p><p>{MORE}</p></body>", f"{TEXT}\n{MORE}"),
    "unclosed paragraphs": (f"<div><div>x</div><div><p>{TEXT}<p><b>{MORE}<p>{TEXT}</div></div>", f"{TEXT}{MORE}{TEXT}"),  # lines end where elements do
    "a list of links weighs less than its text": (f'<div><p>{"".join(f"<a href=/{k}>{TEXT}</a>" for k in range(9))}</p></div><div><p>{TEXT} {MORE}</p></div>', f"{TEXT} {MORE}"),
    "a part beside the best": (f"<div id=top><section><p>{TEXT}</p><p>{MORE}</p><p>{TEXT}</p></section><section><p>{MORE}</p></section><section>short</section></div>", f"{TEXT}\n{MORE}\n{TEXT}\n\n{MORE}"),
    "an article is taken at its word": (f"<div><p>{TEXT}</p><p>{MORE}</p></div><article><p>short</p></article>", "short"),
    "nothing that weighs": ("<div>just <b>words</b></div>", "just words"),
}


@pytest.mark.parametrize("name", PAGES)
def test_labelled_pages(name):
    page, want = PAGES[name]
    assert html.to_main(page)[0] == want


def test_bounds():
    page, _ = PAGES["paragraphs in the body itself"]
    assert html.to_main(None) == (None, None)
    assert html.to_main("") == ("", None)
    big = MENU + f"<div><p>{TEXT}</p></div>" + "<!-- x -->" * 100_001
    assert html.to_main(big)[0] == html.to_markdown(big)[0] != html.to_main(MENU + f"<div><p>{TEXT}</p></div>")[0]
    deep = "<div>" * 3001 + f"<p>{TEXT}</p>" + MENU
    assert html.to_main(deep)[0] == html.to_markdown(deep)[0]
    assert content.main_parts("<a href=x>" * 50 + TEXT) == []


def test_surrogates_and_large_numbers_survive(spark):
    from pyspark.sql import functions as F

    pages = ["a&#55357;b", "a&#55357;&#56832;b", "<h1>&#xD83D;</h1>", "<title>&#55357;</title>x", "x&#" + "9" * 5000 + ";y", "&#128512;"]
    rows = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = {r.id: r.m for r in rows.select("id", html.markdown(F.col("html")).alias("m")).collect()}
    assert [got[k].text for k in range(6)] == ["a�b", "a\U0001f600b", "# �", "�x", "x\0y", chr(128512 & 0xFFFF)]
    assert got[3].title == "�"
    assert rows.select(html.main_content(F.col("html")).alias("m")).count() == 6


def test_large_and_deep_pages_are_searched(spark, tmp_path):
    from pyspark.sql import functions as F

    import __spark_entry__

    part = f"<div><p>{TEXT}</p><p>{MORE}</p></div>"
    comment = "<!-- x -->" * 100_001
    marked = f"<nav>{MENU}</nav><article><p>short</p></article>"
    pages = [MENU + part, MENU + part + comment, "<div>" * 3_001 + MENU + part, "<div>" * 60_000 + MENU + part + "</div>" * 60_000, marked, marked + comment, "", None]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    got = dict(rows.select("page_id", html.main_content(F.col("html"))["text"]).collect())
    assert [got[k] for k in range(8)] == [f"{TEXT}\n{MORE}"] * 4 + ["short"] * 2 + ["", None]
    rows.write.parquet(f"{tmp_path}/pages.parquet")
    found = __spark_entry__.queries()["htm7_main_content"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(0, False), (1, False), (2, False), (3, False), (4, True), (5, True), (6, False), (7, None)]
