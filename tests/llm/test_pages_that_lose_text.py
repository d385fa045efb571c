"""Pages whose articles went before: copies of a page, teasers within a main part, empty comments, open quotes, names of article parts, and long broken tables."""

import time

from accordant.llm import page_extract


def test_copies_of_a_page_are_one_page(spark):
    pages = [(i, f"https://h.example.com/{i}", f"<html><body><article><h1>Title</h1><div class='body'><p>the one text</p></div></article></body></html>") for i in range(5)]
    pages += [(i, f"https://h.example.com/{i}", f"<html><body><article><h1>T{i}</h1><div class='body'><p>own text {i}</p></div><div class='box'>in all of these</div></article></body></html>") for i in range(5, 20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in page_extract.extract_pages(df).collect()}
    assert got == {i: "Title the one text" for i in range(5)} | {i: f"T{i} own text {i}" for i in range(5, 20)}
    loose = spark.createDataFrame([(i, f"https://h.example.com/{i}", f"<p>one text</p>" if i < 5 else f"<p>text {i}</p>") for i in range(20)], df.schema)
    assert {r.page_id: r.text for r in page_extract.extract_pages(loose).collect()} == {i: "one text" if i < 5 else f"text {i}" for i in range(20)}


def test_a_main_part_with_a_teaser_is_the_article():
    body = "<p>" + "long text of the page " * 10 + "</p>"
    assert page_extract.extract(f"<main>{body}<article>teaser</article></main>") == "long text of the page " * 9 + "long text of the page teaser"
    assert page_extract.extract(f"<main>menu words<article>{body}</article></main>") == ("long text of the page " * 10).strip()


def test_empty_comments_and_open_quotes():
    assert page_extract.extract("<p>a<!-->b</p><p>c</p>") == "ab c" and page_extract.extract("<p>a<!--->b</p>") == "ab" and page_extract.extract("<p>a<!-- x --> b</p>") == "a b"
    assert page_extract.extract("""<p title="p > q">a</p><p title='it"s'>b</p><p title="x>c</p>""") == "a b c"
    assert page_extract.extract("""<p class='open>a</p><p title="p > q">b</p>""") == "a b"


def test_parts_of_an_article_stay():
    page = "<article><div class='toc'>contents</div><p>text</p><div class='tags'>tags</div></article>"
    assert page_extract.extract(page) == "contents text tags"


def test_long_broken_tables_take_time_in_proportion():
    took = []
    for n in (4000, 8000, 16000):
        began = time.perf_counter()
        page_extract.extract("<table><tr><td><table>" + "<span>" * n + "</td>" * n + "end")
        took.append(time.perf_counter() - began)
    assert took[1] < 1 and took[2] < 6 * took[0] + 0.2
