"""From landed pages to postings: cycles, copies, the gate of three links, first links, pages that never landed."""
import pytest

from rolecall.operators.reading import LandedPages

SITE = "https://a.example.com"
LD = '<script type="application/ld+json">{"@type":"JobPosting","title":"%s"%s}</script>'


def test_colliding_names_take_the_smallest_free_number(spark):
    import time
    from pyspark.sql import functions as F
    from rolecall.operators.jsonld import unique_fragments

    def walked(bases):
        out = []
        for base in bases:
            name, n = base, 1
            while name in out:
                n += 1
                name = f"{base}-{n}"
            out.append(name)
        return out

    cases = [["x", "x", "x-2"], ["x-2", "x", "x"], ["x-02", "x", "x", "x-3", "x", "x"], ["a", "a-2", "a", "a-2", "a-2", "a"], [], ["y--5", "y", "y", "y-2", "y"]]
    for bases in cases:
        df = spark.createDataFrame([(bases,)], "b array<string>")
        assert df.select(unique_fragments(F.col("b"))).head()[0] == walked(bases)
    many = spark.createDataFrame([(["x-2"] + ["x"] * 3000,)], "b array<string>")
    started = time.perf_counter()
    assert many.select(unique_fragments(F.col("b"))).head()[0] == ["x-2", "x", *[f"x-{n}" for n in range(3, 3002)]]
    print(f"3001 colliding names: {time.perf_counter() - started:.1f} s")


def link(number, text=None):
    return f'<a href="/jobs/{number}">{text or f"Post {number}"}</a>'


def more(page):
    return f'<a href="/careers?page={page}">{page}</a>'


PAGES = [
    ("a", "/careers", link(1001) + link(1002) + link(1003) + more(2) + LD % ("Embedded", ',"url":"/e"')),
    ("a", "/careers?page=2", link(1004) + link(1001, "Other words") + link(1005) + more(3) + more(1)),
    ("a", "/careers?page=3", link(1006) + link(1007) + more(2) + more(4)),          # two links: page 4 isn't followed
    ("a", "/careers?page=4", link(1008) + link(1009) + link(1010)),
    ("a", "/jobs/1001", LD % ("Detail one", "") + LD % ("Second", "")),
    ("a", "/jobs/1002#apply", "<p>no data</p>"),
    ("a", "/jobs/1004", None),
    ("a", "/jobs/1005", LD % ("Detail five", "")),
    ("a", "/jobs/1005", LD % ("Detail five", "")),                                  # landed twice
    ("b", "/careers", ""),
]


@pytest.fixture(scope="module")
def landed(spark):
    rows = [(d, SITE.replace("a.", f"{d}.") + p, SITE.replace("a.", f"{d}.") + p, h, ["example.com"]) for d, p, h in PAGES] + [("c", None, None, None, None)]
    pages = spark.createDataFrame(rows, "domain string, url string, final_url string, html string, domains array<string>")
    return pages, LandedPages(pages.repartition(3), upto=2), LandedPages(pages.repartition(2))


def starts(spark):
    return spark.createDataFrame([("a", SITE + "/careers", 1), ("a", SITE + "/careers#top", 2), ("b", "https://b.example.com/careers", 1), ("z", "https://z.example.com/", 1)],
                                 "domain string, url string, rank int")


def test_rounds_end_although_pages_name_one_another(spark, landed):
    _, _, whole = landed
    found = {(r.domain, r.page_key.partition("/careers")[2], r.round) for r in whole.listings(starts(spark)).collect()}
    assert found == {("a", "", 0), ("b", "", 0), ("a", "?page=2", 1), ("a", "?page=3", 2)}


def test_postings(spark, landed):
    _, _, whole = landed
    got = sorted((r.domain, r.title, r.url, r.source) for r in whole.read(whole.listings(starts(spark))).collect())
    assert got == sorted([
        ("a", "Embedded", SITE + "/e", "json-ld"), ("a", "Detail one", SITE + "/jobs/1001#job-detail-one", "json-ld"),
        ("a", "Post 1002", SITE + "/jobs/1002", "html-heuristic"), ("a", "Post 1003", SITE + "/jobs/1003", "html-heuristic"),
        ("a", "Post 1004", SITE + "/jobs/1004", "html-heuristic"), ("a", "Detail five", SITE + "/jobs/1005#job-detail-five", "json-ld"),
        ("a", "Post 1006", SITE + "/jobs/1006", "html-heuristic"), ("a", "Post 1007", SITE + "/jobs/1007", "html-heuristic")])


def test_a_wish_for_two_pages_tells_that_the_listing_is_longer(spark, landed):
    _, short, _ = landed
    listings = short.listings(starts(spark))
    assert {r.page_key.partition("/careers")[2] for r in listings.collect()} == {"", "?page=2"}
    assert [tuple(r) for r in short.too_long(listings).collect()] == [("a", 3)]


def test_nothing_landed(spark, landed):
    pages, _, _ = landed
    none = LandedPages(pages.limit(0))
    listings = none.listings(starts(spark))
    assert listings.count() == 0 and none.read(listings).count() == 0
