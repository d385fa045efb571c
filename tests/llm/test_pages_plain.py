"""Main-text extraction against a plain count of subtrees, and on pages that are broken or nested deeply."""

import collections
import random
import time

from accordant.llm import page_extract


def test_subtree_counts_against_a_plain_version(spark):
    rng = random.Random(3)
    boxes = [f"<div class='k{i}'>" + " ".join(rng.choice("stone river cloud lamp field".split()) for _ in range(rng.choice((3, 90)))) + f" {i}</div>" for i in range(12)]
    pages = []
    for host, n in (("one.example.com", 40), ("two.example.com", 12), ("few.example.com", 3)):
        for k in range(n):
            own = [f"<p>own text {host} {k} {j}</p>" for j in range(3)]
            shared = [b for i, b in enumerate(boxes) if rng.random() < (i + 1) / 24]
            body = own[:1] + [x for pair in zip(shared, [""] * len(shared)) for x in pair] + own[1:]
            pages.append((len(pages), host, k, body, shared))
    counts = collections.Counter((host, b) for _, host, _, _, shared in pages for b in shared)
    sizes = collections.Counter(host for _, host, *_ in pages)
    gone = {x for x, on in counts.items() if on >= page_extract.MIN_PAGES and on >= min(page_extract.MANY_PAGES, page_extract.MIN_SHARE * sizes[x[0]])}
    assert 0 < len(gone) < len(counts) and any(len(b) > 400 for _, b in gone)
    strip = lambda x: x.replace("<p>", "").replace("</p>", "").split(">", 1)[-1].replace("</div>", "") if x.startswith("<div") else x.replace("<p>", "").replace("</p>", "")
    expected = {i: " ".join(strip(x) for x in body if x and (host, x) not in gone) for i, host, _, body, _ in pages}
    df = spark.createDataFrame([(i, f"https://{host}/a/{k}", f"<html><body><nav>m</nav><article>{''.join(body)}</article></body></html>") for i, host, k, body, _ in pages], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in page_extract.extract_pages(df.repartition(3)).collect()} == expected


def test_broken_and_deep_pages():
    began = time.perf_counter()
    assert page_extract.extract("<p>before<a " + "b " * 5000) == "before"
    assert page_extract.extract("<p>before<a href='" + "x" * 10_000) == "before"
    for tag in ("div class=a", "span", "ul><li"):
        deep = f"<{tag}>" * 10_000 + "end"
        assert page_extract.extract(deep) == "end" and page_extract.templates_of(deep)
    page_extract.extract('<a "x ' * 20_000)
    page_extract.extract("<p>" + "</div></b>" * 20_000)
    assert time.perf_counter() - began < 30


def test_names_are_taken_whole():
    page = (
        "<article><p>a</p><section id='related-work'>work</section><div class='search-results-table'>table</div><math>x</math><object>o</object>"
        "<div class='related-posts'>no</div><div id='siteFooter'>no</div><div class='ad'>no</div><div class='big cookie_banner'>no</div><div class='adventure'>b</div></article>"
    )
    assert page_extract.extract(page) == "a work table xo b"
