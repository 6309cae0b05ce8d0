import json

from pyspark.sql import functions as F

from rolecall.functions import variants as J
from rolecall.operators import filters as FL, jsonld as LD, search as S, sniff as SN
from rolecall.operators.anchors import anchors, is_job_link, job_links, pagination
from rolecall.operators.search import Search
from rolecall.sources import apis

JOB_PATHS = {"/careers/software-engineer-123456": True, "/careers/search": False, "/careers/list/135592/": True, "/careers/list/?x=1": False,
             "/careers/search/job/data-analyst-225712": True, "/jobs/teams": False, "/careers/life-at-acme": False, "/about": False,
             "/x?gh_jid=42": True, "/jobs?page=2": False, "/jobs/ab": False}


def test_job_link_paths(spark):
    df = spark.createDataFrame([(f"https://acme.com{p}", w) for p, w in JOB_PATHS.items()], "u STRING, w BOOLEAN")
    test = is_job_link(F.col("u"), F.array(F.lit("acme.com")), F.lit("https://acme.com/careers"))
    assert [r.u for r in df.filter(test != F.col("w")).collect()] == []
    assert df.filter(is_job_link(F.col("u"), F.array(F.lit("other.com")), F.lit("x"))).count() == 0


def test_job_links_of_a_page(spark):
    html = ('<a href="/jobs/a-1000">Dev <b>Remote, US</b></a><a href="/jobs/a-1000/#x">Again</a><a href="/jobs/data-lead-2000"><i>Apply</i></a>'
            '<a href="/jobs/saved-3">Saved jobs</a><a class=b href=/roles/night-guard>Learn more</a>')
    df = spark.createDataFrame([(1, "https://acme.com/jobs", ["acme.com"], html)], "id INT, final_url STRING, domains ARRAY<STRING>, html STRING")
    got = sorted((r.url, r.title, r.location) for r in job_links(df, ["id"]).collect())
    assert got == [("https://acme.com/jobs/a-1000", "Dev", "Remote, US"), ("https://acme.com/jobs/data-lead-2000", "Data Lead", None),
                   ("https://acme.com/roles/night-guard", "Night Guard", None)]


def test_json_ld_is_walked_to_any_depth(spark):
    node = {"@type": "JobPosting", "title": "deep ]}[ \" x"}
    for _ in range(40):
        node = {"@graph": [node]}
    html = f'<script type="application/ld+json">{json.dumps(node)}</script>'
    df = spark.createDataFrame([(1, html)], "id INT, html STRING")
    found = LD.postings(LD.blocks(df, ["id"]), ["id"]).select(J.scalar(J.get(F.col("posting"), "title")).alias("t")).collect()
    assert [r.t for r in found] == ["deep ]}[ \" x"]


def test_fragments_skip_names_already_taken(spark):
    df = spark.createDataFrame([(["x", "x", "x-2", "x", "y"],)], "b ARRAY<STRING>")
    assert df.select(LD.unique_fragments(F.col("b")).alias("n")).first().n == ["x", "x-2", "x-2-2", "x-3", "y"]


def test_fragments_of_a_long_page(spark):
    df = spark.createDataFrame([(["dev"] * 2000 + [f"n{i}" for i in range(1000)],), (["a", "b", "a", "b"],), ([],)], "b ARRAY<STRING>")
    got = [r.n for r in df.select(LD.unique_fragments(F.col("b")).alias("n")).collect()]
    assert got[0][:3] == ["dev", "dev-2", "dev-3"] and got[0][1999:2001] == ["dev-2000", "n0"] and len(set(got[0])) == 3000
    assert got[1:] == [["a", "b", "a-2", "b-2"], []]


def test_links_are_those_a_reader_sees(spark):
    html = ('<!-- <a href="/old">Old</a> --><script>document.write(\'<a href="/js">Js</a>\')</script>'
            '<a title="more > less" href="/one" data-href="/no">One<script>x("</a>")</script></a><a data-href="/never">Never</a>'
            "<a\nclass='b'href='/two'>Two</a><a href=/three>it's</a>")
    df = spark.createDataFrame([(1, "https://acme.com/", html)], "id INT, final_url STRING, html STRING")
    assert [(r.href, list(r.chunks)) for r in anchors(df, ["id"]).orderBy("pos").collect()] == [
        ("/one", ["One"]), ("/two", ["Two"]), ("/three", ["it's"])]


def test_pagination_names_the_last_page(spark):
    df = spark.createDataFrame([(1, "https://acme.com/jobs", '<a href="/jobs?page=900000000000">last</a>')], "id INT, final_url STRING, html STRING")
    rows = pagination(df, ["id"], upto=3).orderBy("page_number").collect()
    assert [(r.page_number, r.url, r.last_page) for r in rows] == [
        (2, "https://acme.com/jobs?page=2", 900000000000), (3, "https://acme.com/jobs?page=3", 900000000000)]


def test_repeated_json_keys(spark):
    df = spark.createDataFrame([('{"a": 1, "a": 2}',)], "j STRING")
    assert df.select(J.scalar(J.get(J.parse(F.col("j")), "a")).alias("a")).first().a == "2"


def test_listings_come_in_document_order(spark):
    good = {"id": 1, "title": "Dev", "team": "T"}
    df = spark.createDataFrame([(json.dumps({"a": {"jobs": [good] * 3}, "b": [good] * 3, "c": [[[good] * 60]]}),)], "j STRING")
    got = df.select(SN.listing_arrays(J.parse(F.col("j"))).alias("f")).first().f
    assert [(x.path, len(x.objects)) for x in got] == [("a.jobs", 3), ("b", 3), ("c[][]", 60)]


def test_boards_are_read_whole_and_once(spark):
    rows = [("a", 0, 5, [1, 2], 1), ("a", 0, 5, [1, 3], 2), ("a", 2, 0, [4, 5], 1), ("a", 4, 0, [6, 7], 1), ("b", 0, 4, [1, 2], 1), ("b", 2, 4, None, 1),
            ("c", 1, 9, [9], 1), ("d", 0, 0, [], 1)]
    df = spark.createDataFrame([(d, "x", d, o, t, i, f) for d, o, t, i, f in rows],
                               "domain STRING, ats STRING, token STRING, page_offset INT, total INT, items ARRAY<INT>, fetched_at INT")
    got = sorted((r.domain, r.page_offset, r.pos, r.item) for r in apis.board_rows(df).collect())
    assert got == [("a", 0, 0, 1), ("a", 0, 1, 3), ("a", 2, 0, 4), ("a", 2, 1, 5), ("a", 4, 0, 6), ("b", 0, 0, 1), ("b", 0, 1, 2)]
    assert len(apis.board_rows(df, max_jobs=3).filter("domain = 'a'").collect()) == 3
    why = {r.domain: r.truncated for r in apis.truncation(df, page_size=2).collect()}
    assert why == {"a": None, "b": "a results page could not be read", "d": None}
    assert {r.domain: r.truncated for r in apis.truncation(df, page_size=2, max_jobs=3).collect()}["a"] == "board has 5 jobs, read 3"


def test_pages_after_a_row(spark):
    rows = [(1, "b"), (2, None), (3, "A"), (4, "a"), (5, "C"), (6, None), (7, "b")]
    df = spark.createDataFrame(rows, "posting_id INT, title STRING")
    for order in ("asc", "desc"):
        whole = [(r.title, r.posting_id) for r in FL.page(df, 100, "title", order).collect()]
        walked, last = [], None
        while True:
            part = FL.page(df, 2, "title", order) if last is None else FL.page_after(df, last, 2, "title", order)
            part = [(r.title, r.posting_id) for r in part.collect()]
            if not part:
                break
            walked, last = walked + part, part[-1]
        assert walked == whole, order


def test_readable_and_lookup(spark):
    data = {"A": {"city": "Berlin", "country": {"name": "Germany"}}, "b": ["x", {"label": " y "}, "x", True], "Title": "", "name": 5, "N": None}
    df = spark.createDataFrame([(json.dumps(data),)], "j STRING").select(J.parse(F.col("j")).alias("v"))
    e = J.lowered(F.col("v"))
    row = df.select(J.readable(J.first_of(e, ["a"])).alias("a"), J.readable(J.first_of(e, ["B"])).alias("b"),
                    J.readable(J.first_of(e, ["title", "name"])).alias("t"), J.first_key(e, ["title", "name"]).alias("k"),
                    J.first_of(e, ["n"]).isNull().alias("none")).first()
    assert tuple(row) == ("Berlin, Germany", "x | y", "5", "name", True)


def test_listing_arrays_need_a_majority(spark):
    good, bad = {"id": 1, "title": "Dev", "team": "T"}, {"x": 1}
    docs = [[good] * 3, [good] * 2, [good] * 3 + [bad] * 2, [good] * 3 + [bad] * 3, {"a": {"b": [good] * 3}}, [{"title": "News", "link": "/n"}] * 4]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i INT, j STRING")
    got = df.select("i", F.inline(SN.listing_arrays(J.parse(F.col("j"))))).collect()
    assert {(r.i, r.path) for r in got} == {(0, ""), (2, ""), (4, "a.b")}


def test_search_forms_agree(spark):
    rows = [(1, "Senior Machine Learning Engineer", "Acme"), (2, "learning machine", "Acme"), (3, "Engineering manager", "Global"),
            (4, "Créateur, machine-learning", "X"), (5, "Intern", "Engineer GmbH")]
    df = spark.createDataFrame(rows, "id INT, title STRING, company STRING")
    cases = [(dict(all_of=["eng"]), {1, 3, 5}), (dict(all_of=['"machine learning"']), {1, 4}), (dict(all_of=["eng", "acme"]), {1}),
             (dict(all_of=[["intern", "manager"]], none_of=["glob"]), {5}), (dict(none_of=["machine"]), {3, 5}), (dict(all_of=["createur"]), {4}),
             (dict(all_of=["m"]), set()), (dict(all_of=["c++", "eng"]), set())]
    index = S.search_tokens(df, "id", ["title", "company"])
    for case, want in cases:
        query = Search.of(**case)
        assert {r.id for r in S.search(df, query, ["title", "company"]).collect()} == want, case
        assert {r.id for r in S.matching_ids(index, query, "id", everything=df).collect()} == want, case
