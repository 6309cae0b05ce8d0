import html.entities
from datetime import datetime

from pyspark.sql import functions as F

from rolecall.functions import classify as C, dates as DT, text as TX, urls as U


def column(spark, values, expression, kind="STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_fold_equals_full_decomposition(spark):
    chars = [chr(c) for c in [*range(1, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]]
    words = [f"a{c}b" for c in chars]
    got = column(spark, words, TX.fold)
    assert [(w, g) for w, g in zip(words, got) if g != TX.fold_text(w)] == []
    assert column(spark, ["São  Paulo", "STRASSE", "Straße", "Côte d’Ivoire", "U.S.A.", "½ 각 ﾃﾞ", None, ""], TX.fold) == [
        "sao paulo", "strasse", "strasse", "cote divoire", "usa", "1⁄2 \u1100\u1161\u11a8 テ", None, ""]


def test_fold_exact_agrees(spark):
    assert column(spark, ["Ǆ ½ ﬁ", None, "É"], TX.fold_exact) == [TX.fold_text("Ǆ ½ ﬁ"), None, "e"]


def test_clean_and_lists(spark):
    assert column(spark, ["  a \t b\n", "", None, " "], TX.clean) == ["a b", None, None, None]
    assert column(spark, [["a", " a ", None, "", "b"], []], TX.clean_list, "ARRAY<STRING>") == ["a | b", None]


def test_unescape(spark):
    texts = ["a&amp;b", "&#8217;x&#x2F;y", "&lt;&gt;&quot;", "plain", "&#x1F600;", "a & b", "&amp;lt;"]
    assert column(spark, texts, TX.unescape_markup) == ["a&b", "’x/y", '<>"', "plain", "\U0001F600", "a & b", "&lt;"]
    assert column(spark, ["&eacute;&thetasym;", "&euro;5 &rarr; &nosuch; &Aring;", "&amp;euro;", "a&b;"], TX.unescape_markup) == [
        "éϑ", "€5 → &nosuch; Å", "&euro;", "a&b;"]


def test_unescape_goes_once_from_left_to_right(spark):
    texts = ["&#38;lt;b", "it&#146;s", "&copy 2024", "caf&eacute", "&notit; &notin; &nosuch &&amp;& &#; &#xg;", "&#0;&#xD800;&#1;", "&" * 3, None, "", "&#99999999999999999999;&#x0000000000000000000041;&#000000000000000000000065;", "x" * 99999 + "&gt"]
    texts += [f"a&{name}b;c" for name in html.entities.html5] + [f"&#{n};" for n in range(0, 300)] + [f"&#x{n:x} " for n in range(0xFFF0, 0x10010)]
    assert column(spark, texts, TX.unescape_markup) == [t and html.unescape(t) for t in texts]


def test_titles_and_slugs(spark):
    assert column(spark, ["/jobs/senior-data_engineer-123456/", "/jobs/42", "/x/o'neil-3d"], TX.title_from_path) == [
        "Senior Data Engineer", None, "O'Neil 3D"]
    assert column(spark, ["  C++ / Ünï  Dev! ", "x" * 100], TX.slug) == ["c-n-dev", "x" * 100]
    assert column(spark, ["NEW YORK", "NYC", "Suite 5", "Bonn", "y" * 61], TX.tidy_city) == ["New York", "NYC", None, "Bonn", None]


def test_url_key(spark):
    urls = ["https://www.Acme.com/jobs/1/?utm=1", "http://acme.com/jobs/1#top", "https://x.io/j?a=1&gh_jid=7#job-a.b-1", "", None,
            "https://u:p@Acme.com:8080/x/"]
    assert column(spark, urls, U.url_key) == ["acme.com/jobs/1", "acme.com/jobs/1", "x.io/j?gh_jid=7#job-a.b-1", "", "", "acme.com/x"]


def test_resolve(spark):
    base = F.lit("https://a.com/x/y/z?q=1#f")
    hrefs = ["/r", "s", "../t", "./u/../v?k=1", "//b.org/w", "?p=2", "#h", "", "mailto:x@y.z", "http://c.net", "../../../up", ".."]
    want = ["https://a.com/r", "https://a.com/x/y/s", "https://a.com/x/t", "https://a.com/x/y/v?k=1", "https://b.org/w",
            "https://a.com/x/y/z?p=2", "https://a.com/x/y/z?q=1#h", "https://a.com/x/y/z?q=1#f", "mailto:x@y.z", "http://c.net",
            "https://a.com/up", "https://a.com/x/"]
    assert column(spark, hrefs, lambda h: U.resolve(base, h)) == want


def test_hosts_and_locales(spark):
    assert column(spark, ["careers.shop.example.co.uk", "a.b.com", "com", "x.com.de", None], U.registrable_domain) == [
        "example.co.uk", "b.com", "com", "x.com.de", ""]
    assert column(spark, ["/de/jobs", "/fr-ca", "/en/x", "/us/en/", "/en-gb/", "/jp/", "/jobs"], U.non_english_locale) == [
        True, True, False, False, False, True, False]
    assert column(spark, ["jobs.linkedin.com", "x.com", "acme.com"], lambda h: U.denied_host(h)["denied"]) == [True, True, False]


def test_dates(spark):
    as_of = F.lit(datetime(2024, 3, 10, 15, 0))
    texts = ["2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123456+02:00", "2024-01-02T03:04:05+0200", "2024-01-02 03:04",
             "Posted Today", "posted 30+ days ago", "Posted Yesterday", "junk", "", "2024", "2024-13-01"]
    got = column(spark, texts, lambda c: DT.from_text(c, as_of).cast("timestamp_ntz"))
    assert got == [datetime(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 1, 4, 5, 123456), datetime(2024, 1, 2, 1, 4, 5),
                   datetime(2024, 1, 2, 3, 4), datetime(2024, 3, 10), datetime(2024, 2, 9), datetime(2024, 3, 9), None, None, None, None]
    assert column(spark, [1700000000000, 1700000000, 10**18, None], lambda c: DT.from_epoch(c).cast("timestamp_ntz"), "BIGINT") == [
        datetime(2023, 11, 14, 22, 13, 20), datetime(2023, 11, 14, 22, 13, 20), None, None]


def test_workplace_and_employment(spark):
    work = {"Remote": "remote", "Fully Remote": "remote", "TELECOMMUTE": "remote", "Hybrid remote": "hybrid", "Flex": "hybrid",
            "Flexible": "hybrid", "On-site": "onsite", "OnSite": "onsite", "In Office": "onsite", "Office": "onsite", "banana": None,
            "Unspecified": None, "": None}
    assert column(spark, list(work), C.workplace_of) == list(work.values())
    kinds = {"Full-time": "full_time", "FULL_TIME": "full_time", "Permanent": "full_time", "Part-time": "part_time", "Contractor": "contract",
             "Temporary": "contract", "Internship": "intern", "Co-op": "intern", "Volunteer": "other", "n/a": None, "": None}
    assert column(spark, list(kinds), C.employment_type_of) == list(kinds.values())


def test_challenge_pages(spark):
    pages = ["<title>Just a moment...</title>", "<p>solve the captcha</p>", "<a x>" * 9 + "captcha", "captcha" + "x" * 60_000, "<p>ok</p>", ""]
    assert column(spark, pages, C.is_challenge) == [True, True, False, False, False, False]


def test_has_word(spark):
    assert column(spark, ["Remote - EU", "Menu", "eu-west", "UK&I team", None], lambda c: TX.has_word(c, "EU")) == [True, False, True, False, False]
    assert column(spark, ["in UK&I.", "UKI"], lambda c: TX.has_any_word(c, ["UK&I", "DACH"])) == [True, False]


def test_iso_forms(spark):
    texts = ["2023-11-05T06:07:08.123456789Z", "20231105", "20231105T060708Z", "20231105T0607+0200", "2023-W45-7", "2023W45", "2023-W53-1",
             "2020-W53-5T10:00", "202311", "20231345", "5 Nov", "", None]
    want = [datetime(2023, 11, 5, 6, 7, 8, 123456), datetime(2023, 11, 5), datetime(2023, 11, 5, 6, 7, 8), datetime(2023, 11, 5, 4, 7),
            datetime(2023, 11, 12), datetime(2023, 11, 6), None, datetime(2021, 1, 1, 10), None, None, None, None, None]
    assert column(spark, texts, lambda c: DT.from_text(c).cast("timestamp_ntz")) == want
