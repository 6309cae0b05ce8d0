"""Work that large tables made too slow: done once, and spread over the cores."""
from pyspark.sql import functions as F

from rolecall.functions import variants as J
from rolecall.operators import anchors as A, boards as B, objects as O, search as S, sniff as SN
from rolecall.operators.keyed import spread
from rolecall.operators.reading import LandedPages
from rolecall.operators.search import Search
from rolecall.plans import extraction as EX
from rolecall.plans.registry import Tables
from rolecall.sources import readers as RD
from rolecall.sources.gazetteer import Gazetteer


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sniffed_json_is_walked_once(spark):
    jobs = '{"jobs":[' + ",".join(f'{{"id":"{i}","Title":"Cook {i}","city":"Rome","Country":"IT","type":"Full-Time"}}' for i in range(3)) + "]}"
    rows = [("p", "https://a.io/careers", 1, "https://a.io/api", jobs), ("p", "https://a.io/careers", 2, "https://a.io/api", '{"x":1}'), ("q", None, 3, None, None)]
    df = spark.createDataFrame(rows, "page string, page_url string, pos long, url string, body string")
    found = SN.sniffed_postings(df.withColumn("data", J.parse(F.col("body"))), "page")
    assert "parse_json" not in _plan(found)
    assert {(r.title, r.url, r.location, r.employment_type) for r in found.collect()} == {
        (f"Cook {i}", f"https://a.io/careers#job-{i}", "Rome, IT", "Full-Time") for i in range(3)}


def test_rows_are_spread(spark):
    assert spread(spark.range(100).coalesce(1)).select(F.spark_partition_id()).distinct().count() > 1


def test_map_lookups_equal_entry_lookups(spark):
    keys = ["title", "jobTitle", "n"]
    df = spark.createDataFrame([('{"Title":"","JOBTITLE":"x","n":[]}',), ('{"n":0,"TITLE":"a","title":"b"}',), ("[1]",), (None,)], "t string")
    e = df.select(J.lowered(J.parse(F.col("t"))).alias("e"))
    m = J.by_key(F.col("e"))
    for r in e.select(F.to_json(J.first_of(F.col("e"), keys)).alias("a"), F.to_json(J.first_in(m, keys)).alias("b"),
                      J.first_key(F.col("e"), keys).alias("c"), J.first_entry_in(m, keys)["k"].alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)


def test_page_text_is_made_once(spark):
    rows = [("a", 1, "https://apply.workable.com/x https://jobs.lever.co/acme ?gh_jid=1"), ("a", 2, None), ("b", 3, "https://boards.greenhouse.io/embed icims.com"),
            ("c", 4, "https://h.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/jobs"), ("d", 5, "https://h.fa.us2.oraclecloud.com/x"), (None, 6, "taleo.net")]
    df = spark.createDataFrame(rows, "domain string, pos long, html string").select(
        "*", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("final_url"), F.lit(None).cast("array<string>").alias("json_urls"))
    found = B.unsupported_vendors(df)
    assert "Join" not in _plan(found)
    assert {(r.domain, tuple(r.vendors), r.saw_gh_jid) for r in found.collect()} == {
        ("a", ("workable",), True), ("b", ("icims",), False), ("c", (), False), ("d", ("oracle",), False), (None, ("taleo",), False)}


def test_phrases_are_found_in_the_pass_of_the_words(spark):
    texts = [(1, "la la land", "x"), (2, "la", "la land"), (3, "of the landing", ""), (4, "the of", "the"), (5, "La  LA landing", "of"), (5, "of", "zz")]
    df = spark.createDataFrame(texts, "id long, title string, company string")
    index = S.search_tokens(df, "id", ["title", "company"])
    found = S.matching_ids(index, Search.of(all_of=[['"la la land"', '"of the"', "land"]], none_of=['"of the"', "zz"]), "id")
    assert _plan(found).count("posexplode") == 1
    assert {r.id for r in found.collect()} == {1, 2}
    both = S.matching_ids(index, Search.of(all_of=[['"la la"'], ["land"]]), "id")
    assert {r.id for r in both.collect()} == {1, 5}


def test_tags_are_taken_apart_once(spark, monkeypatch):
    calls, real = [], A.anchors
    monkeypatch.setattr(A, "anchors", lambda *a: calls.append(1) or real(*a))
    links = "".join(f'<a href="/jobs/{i}00000">Job number {i}</a>' for i in range(3))
    rows = [("a", f"https://a.io/careers{q}", f"https://a.io/careers{q}", links + '<a href="/careers?page=2">next</a>', ["a.io"]) for q in ("", "?page=2")]
    landed = LandedPages(spark.createDataFrame(rows, "domain string, url string, final_url string, html string, domains array<string>"))
    assert len(calls) == 1
    starts = spark.createDataFrame([("a", "https://a.io/careers", 1)], "domain string, url string, rank int")
    assert {(r.page_key, r.round) for r in landed.listings(starts).collect()} == {("https://a.io/careers", 0), ("https://a.io/careers?page=2", 1)}


def test_workday_places_are_read_once_per_step(spark, monkeypatch):
    sizes, real = [], RD.slug_place
    monkeypatch.setattr(RD, "slug_place", lambda df, *a: sizes.append(df.count()) or real(df, *a))
    body = '{"total":1,"jobPostings":[{"title":"T","externalPath":"%s","postedOn":"Posted Today"}]}'
    rows = [("c", "workday", f"t/{i}", "h.io", 0, 200, body % path) for i, path in enumerate(["/job/US-WA-Spokane/x"] * 3 + ["/x", "/job/GB-London/y"])]
    df = spark.createDataFrame(rows, "domain string, ats string, token string, endpoint string, page_offset int, status int, body string")
    found = RD.workday(df, Gazetteer.load(spark), F.expr("TIMESTAMP_NTZ '2024-03-10 15:00:00'")).collect()
    assert sizes == [2]
    assert sorted((r.token, r.city, r.country) for r in found) == [("t/0", "Spokane", "US"), ("t/1", "Spokane", "US"), ("t/2", "Spokane", "US"),
                                                                   ("t/3", None, None), ("t/4", "London", "GB")]


ODD = ['{"r":{"jobs":[{"ID":7,"name":" A \\u0085 b ","city":"Rome","Country":{"label":"IT"},"type":"intern"},{"id":8,"title":"Cook","Location":{"city":"Lyon","country":null},"teams":["X",{"name":"X"},["Y"]]},'
       '{"url":"//x/1","title":"Chef","team":"T","remote":true},{"jobId":"R 1/2","title":"Baker","date":1700000000,"type":"thing"},5,{}]},"a":[[{"title":"no"}]],"":{"k":[[[{"title":"Deep 1","slug":"d","offices":[{"x":1},"Ulm"]},'
       '{"TITLE":"no","title":"Deep 2","slug":"","reqid":1.50,"datePosted":"2024-02-29"},{"title":"Deep 3","href":"/d/3","count":3,"req_id":true}]]]}}',
       '[{"id":1,"title":"Filter one","count":2,"location":"x"},{"id":2,"title":"Filter two","count":2,"location":"x"},{"id":3,"title":"Filter","count":1,"location":"x"}]',
       '{"x":[{"id":1,"title":"Two only","city":"x"},{"id":2,"title":"Two only","city":"x"}]}', "null", "[]", "5", '"[1]"', "[1,", "", None]


def test_a_payload_is_read_without_expressions_by_the_same_rules(spark):
    rows = [("p", "https://a.io/c?x#y", i, None, text) for i, text in enumerate(ODD)]
    df = spark.createDataFrame(rows, "page string, page_url string, pos long, url string, body string").withColumn("data", J.parse(F.col("body")))
    by_expressions = df.select("pos", F.to_json("data").alias("t"), F.transform(SN.listing_arrays(F.col("data")), lambda f: F.struct(f["path"], F.size(f["objects"]))).alias("f"))
    for r in by_expressions.collect():
        assert [(path, len(objects)) for path, objects in (O.listings(r.t) if r.t is not None else [])] == [tuple(f) for f in r.f or []]
    first = list(O.postings(spark.createDataFrame([(ODD[0],)], "t string").select(F.to_json(J.parse(F.col("t")))).head()[0]))
    names = list(O.FOUND)
    told = [{k: v for k, v in zip(names, p, strict=True) if v is not None and k not in ("array", "item")} for p in first]
    assert told == [
        {"json_path": "k[][]", "title": "Deep 1", "id_text": "d", "place": "Ulm"},
        {"json_path": "k[][]", "title": "Deep 2", "id_text": "1.5", "date_text": "2024-02-29"},
        {"json_path": "k[][]", "title": "Deep 3", "own_url": "/d/3", "id_text": "true"},
        {"json_path": "r.jobs", "title": "A b", "id_text": "7", "city": "Rome", "country": "IT", "place": "Rome, IT", "loose_type": "intern"},
        {"json_path": "r.jobs", "title": "Cook", "id_text": "8", "city": "Lyon", "place": "Lyon", "department": "X | Y"},
        {"json_path": "r.jobs", "title": "Chef", "own_url": "//x/1", "department": "T", "remote": True},
        {"json_path": "r.jobs", "title": "Baker", "id_text": "R 1/2", "number": 1700000000.0, "loose_type": "thing"}]
    found = {(r.title, r.url, r.location, r.employment_type, str(r.posted)) for r in SN.sniffed_postings(df, "page").collect()}
    assert found == {("A b", "https://a.io/c?x#job-7", "Rome, IT", "intern", "None"), ("Cook", "https://a.io/c?x#job-8", "Lyon", None, "None"),
                     ("Chef", "https://x/1", None, None, "None"), ("Baker", "https://a.io/c?x#job-R-1-2", None, None, "2023-11-14 22:13:20")}


def test_payloads_are_written_after_rows_are_spread(spark, tmp_path):
    spark.createDataFrame([(k, k // 4, None if k == 7 else "1-URGENT") for k in range(12)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    made = EX.payloads(Tables(spark, str(tmp_path)))
    assert {r.o_orderkey for r in made.filter("body is null").collect()} == {7}
    assert "element_at" not in _plan(SN.sniffed_postings(made.withColumn("data", J.parse(F.col("body"))), "o_custkey"))
    written = made.select(F.to_json(J.parse(F.col("body"))).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at" not in written.split("Repartition")[1]
    assert "concat" not in made.select("body")._jdf.queryExecution().optimizedPlan().toString()  # all six texts were put together for each row


def test_companies_without_an_own_reader_are_read_without_walking_by_expressions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SN, "listing_arrays", lambda *_: 1 / 0)
    orders = [(6 * i + i % 2, c, "1-URGENT") for i, c in enumerate([10, 10, 11, 11, 11, 12, 30, 30])] + [(100, 13, "2-HIGH"), (None, 11, "2-HIGH"), (103, None, "2-HIGH")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    found = EX.adapter_rows(Tables(spark, str(tmp_path))).collect()
    assert {(r.domain, r.reader, r.postings) for r in found} == {(10, "own", 2), (11, "sniffed", 6), (12, "sniffed", 4), (30, "sniffed", 4)}
