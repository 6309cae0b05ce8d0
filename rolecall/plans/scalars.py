"""Queries over text, URL, date and classification expressions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C, dates as DT, text as TX, urls as U, vocab as V
from . import duck as D
from .registry import pick, query, utc

col, lit = F.col, F.lit

WORKPLACE_WORDING = ["three days in-person", None, "hybrid / remote", "Work from home", " flex ", "somewhere", "N/A",
                     "remote within the EU", "flexible hours", "office", "in-office only", "on site", "none", "  "]
TYPE_WORDING = ["Apprenticeship", "seasonal help", None, "regular", "part time (60 %)", "fixed term, 12 months", "temp",
                "n/a", "freelancing", "full time or part time", "Working student", "on call", "FTE", "temperate", " ", "consultant"]


# ---- text ----

@query("text_clean", f"""
    SELECT doc_id, md5({D.clean('text')}) AS cleaned_md5, length({D.clean('text')})::BIGINT AS cleaned_length,
           md5(nullif(array_to_string(list_distinct_ordered, ' | '), '')) AS lines_md5
    FROM (SELECT *, list_filter(lines, lambda x, i: list_position(lines, x) = i) AS list_distinct_ordered
          FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {D.clean('x')}),
                                                 lambda x: x IS NOT NULL) AS lines FROM documents))""")
def text_clean(t):
    """STR-1: collapsed text, and lines as an ordered distinct list."""
    d = t.documents.select("doc_id", TX.clean(col("text")).alias("cleaned"),
                           TX.clean_list(F.split("text", "\n")).alias("lines"))
    return d.select("doc_id", F.md5("cleaned").alias("cleaned_md5"),
                    F.length("cleaned").cast("bigint").alias("cleaned_length"), F.md5("lines").alias("lines_md5"))


@query("text_fold", f"SELECT doc_id, md5({D.fold('text')}) AS folded_md5 FROM documents")
def text_fold(t):
    """STR-2: case-, accent- and punctuation-insensitive form."""
    return t.documents.select("doc_id", F.md5(TX.fold(col("text"))).alias("folded_md5"))


# Names in scripts and signs that fold to other letters, each with its folded form.
FOLDED = [("שָׁלוֹם", "שלום"), ("ﾃﾞｰﾀ", "テータ"), ("½ Zoll", "1⁄2 zoll"), ("Ǆep", "dzep"), ("Ŀ.", "l·"), ("ΌΣΟΣ", "οσοσ"),
          ("㎏", "kg"), ("İZMİR", "izmir"), ("Ⅷ", "viii"), ("ﷲ", "الله"), ("①②", "12"), ("𝐁𝐞𝐫𝐧", "bern"), ("Đà Nẵng", "đa nang"),
          ("각", "\u1100\u1161\u11a8"), ("가 나", "\u1100\u1161 \u1102\u1161"), ("ŉ", "ʼn"), ("Ꮳ", "Ꮳ"), ("O’Fallon…", "ofallon"), ("…", ""), ("ẞ", "ss")]


@query("text_fold_scripts", f"""
    SELECT p_partkey, md5(concat_ws(' ', nullif({D.pick([f for _, f in FOLDED], 'p_partkey')}, ''), lower(p_name))) AS folded_md5 FROM part""")
def text_fold_scripts(t):
    """STR-2: letters of other scripts, and signs that stand for several letters."""
    text = F.concat(pick([x for x, _ in FOLDED], col("p_partkey")), lit(" "), F.upper("p_name"))
    return t.part.select("p_partkey", F.md5(TX.fold(text)).alias("folded_md5"))


# Texts with references, each with what they say.
REFERENCES = [("&#38;lt;b", "&lt;b"), ("it&#146;s", "it’s"), ("&copy 2024", "© 2024"), ("caf&eacute", "café"), ("&amp;eacute;", "&eacute;"),
              ("&#x26;amp;", "&amp;"), ("&notit;", "¬it;"), ("&notin;", "∉"), ("R&D; &nosuch;", "R&D; &nosuch;"), ("&#0;&#xD800;&#1114112;", "\ufffd" * 3),
              ("a&#1;b&#11;c", "abc"), ("&#x1F600;&#128512", "😀😀"), ("&", "&"), ("&&amp;&", "&&&"), ("&#;&#x;&#xg;", "&#;&#x;&#xg;"),
              ("&LT;&ltx&gt", "<<x>"), ("&nbsp;&NotEqualTilde;", "\u00a0≂̸"), ("&#99999999999999999999;", "\ufffd"), ("&#129;&#x80;", "\u0081€"), ("&amp", "&")]


@query("text_references", f"""
    SELECT p_partkey, md5({D.pick([f for _, f in REFERENCES], 'p_partkey')} || '|' || p_name) AS undone_md5 FROM part""")
def text_references(t):
    """STR-6: references undone once, from left to right, with and without ';'."""
    text = F.concat(pick([x for x, _ in REFERENCES], col("p_partkey")), lit("|"), col("p_name"))
    return t.part.select("p_partkey", F.md5(TX.unescape_markup(text)).alias("undone_md5"))


@query("text_slug", f"""
    SELECT p_partkey, {D.slug("p_name || ' / ' || p_brand || ' — ' || p_type")} AS slug FROM part""")
def text_slug(t):
    """STR-3: URL slug."""
    return t.part.select("p_partkey", TX.slug(F.concat_ws(" ", "p_name", lit("/"), "p_brand", lit("—"), "p_type"))
                         .alias("slug"))


_PART_PATH = "'/jobs/' || replace(p_name, ' ', '-') || '_' || p_type || '-' || (p_partkey * 100003)::VARCHAR || '/'"


@query("title_from_path", f"""
    SELECT p_partkey, CASE WHEN length(w) >= 3 THEN {D.title_case('w')} END AS title FROM (
      SELECT p_partkey, trim(regexp_replace(regexp_replace(string_split(rtrim(p, '/'), '/')[-1],
                        '[-_]?\\d{{4,}}$', ''), '[-_]+', ' ', 'g')) AS w
      FROM (SELECT p_partkey, {_PART_PATH} AS p FROM part))""")
def title_from_path(t):
    """STR-4: a title read from the last step of a URL path."""
    path = F.concat(lit("/jobs/"), F.replace("p_name", lit(" "), lit("-")), lit("_"), col("p_type"), lit("-"),
                    (col("p_partkey") * 100003).cast("string"), lit("/"))
    return t.part.select("p_partkey", TX.title_from_path(path).alias("title"))


@query("names_match", f"""
    SELECT p_partkey, {D.names_match("p_name || ' Inc.'", "split_part(p_name, ' ', 2)")} AS part_of_name,
           {D.names_match("p_brand", "'brand' || p_size::VARCHAR")} AS brand_is_size FROM part""")
def names_match(t):
    """STR-5: loose company-name comparison."""
    return t.part.select(
        "p_partkey",
        TX.names_match(F.concat("p_name", lit(" Inc.")), F.split_part("p_name", lit(" "), lit(2))).alias("part_of_name"),
        TX.names_match(col("p_brand"), F.concat(lit("brand"), col("p_size").cast("string"))).alias("brand_is_size"))


@query("text_prepare", f"""
    SELECT page_id, md5(replace(replace(replace({D.unescape('html')}, '\\/', '/'), '\\u002F', '/'), '\\u002f', '/'))
           AS prepared_md5 FROM pages""")
def text_prepare(t):
    """STR-6: HTML references and JSON-escaped slashes undone."""
    return t.pages.select("page_id", F.md5(TX.prepare(col("html"))).alias("prepared_md5"))


@query("whole_word", f"""
    SELECT doc_id, {D.has_word('text', 'la')} AS has_la, {D.has_word('text', 'of the')} AS has_of_the,
           {D.has_word('text', 'und', 'les', 'que')} AS has_any FROM documents""")
def whole_word(t):
    """STR-7 / UDF-1: whole word or phrase, any case, in any script."""
    text = col("text")
    return t.documents.select("doc_id", TX.has_word(text, "la").alias("has_la"),
                              TX.has_word(text, "of the").alias("has_of_the"),
                              TX.has_any_word(text, ["und", "les", "que"]).alias("has_any"))


@query("whole_word_sql", f"""
    SELECT lang, count(*) FILTER (WHERE {D.has_word('text', 'the')})::BIGINT AS with_the, count(*)::BIGINT AS documents
    FROM documents GROUP BY lang""")
def whole_word_sql(t):
    """UDF-1: the same test as a SQL function."""
    TX.register_has_word(t.spark)
    t.documents.createOrReplaceTempView("rolecall_documents")
    return t.spark.sql("SELECT lang, count_if(has_word(text, 'the')) AS with_the, count(*) AS documents "
                       "FROM rolecall_documents GROUP BY lang")


@query("tidy_city", f"""
    SELECT c_custkey, CASE WHEN regexp_matches(c, '\\p{{Nd}}') OR length(c) > 60 THEN NULL
           WHEN upper(c) = c AND lower(c) <> c AND length(c) > 3 THEN {D.title_case('c')} ELSE c END AS city
    FROM (SELECT c_custkey, {D.pick(['c_mktsegment', 'n_name', 'lower(c_mktsegment)'], 'c_custkey')
                             .replace("'c_mktsegment'", 'c_mktsegment').replace("'n_name'", 'n_name')
                             .replace("'lower(c_mktsegment)'", 'lower(c_mktsegment)')} AS c
          FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def tidy_city(t):
    """STR-8: city spelling."""
    c = F.element_at(F.array("c_mktsegment", "n_name", F.lower("c_mktsegment")), (col("c_custkey") % 3 + 1).cast("int"))
    return (t.customer.join(t.nation, col("c_nationkey") == col("n_nationkey"))
            .select("c_custkey", TX.tidy_city(c).alias("city")))


_NOW = "TIMESTAMP '2001-12-31 23:59:00'"


@query("age_bucket", f"""
    SELECT o_orderkey, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN h < 24 THEN h || 'h ago'
        WHEN d < 7 THEN d || 'd ago' WHEN d < 30 THEN (d // 7) || 'w ago' WHEN d < 365 THEN (d // 30) || 'mo ago'
        ELSE (d // 365) || 'y ago' END AS age
    FROM (SELECT o_orderkey, m, m // 60 AS h, m // 60 // 24 AS d FROM (
        SELECT o_orderkey, floor(date_sub('second', o_orderdate, {_NOW}) / 60)::BIGINT AS m FROM orders))""")
def age_bucket(t):
    """STR-9: relative time against a fixed moment."""
    return t.orders.select("o_orderkey", DT.age_bucket(col("o_orderdate"), F.expr(f"CAST({_NOW} AS TIMESTAMP_NTZ)"))
                           .alias("age"))


@query("safe_link", f"""
    SELECT page_id, CASE WHEN regexp_matches(trim(u), '(?i)^https?://[^/?#\\s]+') THEN trim(u) END AS link
    FROM (SELECT page_id, {D.pick(['0', '1', '2', '3'], 'page_id')} AS k, CASE k WHEN '0' THEN ' ' || url
          WHEN '1' THEN 'javascript:go("' || url || '")' WHEN '2' THEN {D.path('url')} ELSE upper(url) END AS u FROM pages)""")
def safe_link(t):
    """STR-10: only absolute http(s) addresses survive."""
    url = col("url")
    k = col("page_id") % 4
    u = (F.when(k == 0, F.concat(lit(" "), url)).when(k == 1, F.concat(lit('javascript:go("'), url, lit('")')))
         .when(k == 2, U.path(url)).otherwise(F.upper(url)))
    return t.pages.select("page_id", U.safe_link(u).alias("link"))


# ---- URLs ----

_KEYED = ("url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'gh_jid=' || (page_id * 7)::VARCHAR || "
          "'#job-' || page_id::VARCHAR")


@query("url_key", f"""
    SELECT page_id, {D.url_key('url')} AS url_key, {D.url_key(f"replace({_KEYED}, '#top', '')")} AS posting_key FROM pages""")
def url_key(t):
    """URL-1: comparable form of a URL, keeping gh_jid and a job fragment."""
    url = col("url")
    keyed = F.concat(url, F.when(F.contains(url, lit("?")), lit("&")).otherwise(lit("?")), lit("gh_jid="),
                     (col("page_id") * 7).cast("string"), lit("#job-"), col("page_id").cast("string"))
    return t.pages.select("page_id", U.url_key(url).alias("url_key"),
                          U.url_key(F.replace(keyed, lit("#top"), lit(""))).alias("posting_key"))


_UK = "regexp_replace({h}, 'example\\.(com|org|net)$', 'co.uk')"


@query("registrable_domain", f"""
    SELECT page_id, {D.site_domain('url')} AS domain,
           {D.registrable_domain(_UK.format(h=D.host('url')))} AS uk_domain FROM pages""")
def registrable_domain(t):
    """URL-2: the domain a host belongs to, two-part suffixes included."""
    h = U.host(col("url"))
    return t.pages.select("page_id", U.registrable_domain(h).alias("domain"),
                          U.registrable_domain(F.regexp_replace(h, r"example\.(com|org|net)$", "co.uk")).alias("uk_domain"))


_TYPED = "CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '  ' || regexp_replace(url, '^https?://', '') ELSE 'localhost/' || page_id END"


@query("parse_site", f"""
    SELECT page_id, CASE WHEN good THEN regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.\\-]*:', 'https:') END AS input_url,
           CASE WHEN good THEN 'https://' || h || '/' END AS root_url, CASE WHEN good THEN h END AS host,
           CASE WHEN good THEN d END AS domain,
           CASE WHEN good THEN regexp_replace(split_part(d, '.', 1), '[^a-z0-9]', '', 'g') END AS slug,
           CASE WHEN good THEN upper(left(split_part(d, '.', 1), 1)) || substr(split_part(d, '.', 1), 2) END AS name,
           CASE WHEN NOT good THEN 'not a valid web address' END AS error
    FROM (SELECT *, contains(h, '.') AS good, {D.registrable_domain('h')} AS d FROM (
        SELECT page_id, u, rtrim({D.host('u')}, '.') AS h FROM (
            SELECT page_id, CASE WHEN regexp_matches(trim(r), '(?i)^[a-z][a-z0-9+.\\-]*://') THEN trim(r)
                   ELSE 'https://' || trim(r) END AS u FROM (SELECT page_id, {_TYPED} AS r FROM pages))))""")
def parse_site(t):
    """URL-3: what a person types -> site, or a reason why it is none."""
    k = col("page_id") % 3
    raw = (F.when(k == 0, col("url")).when(k == 1, F.concat(lit("  "), F.regexp_replace("url", "^https?://", "")))
           .otherwise(F.concat(lit("localhost/"), col("page_id").cast("string"))))
    return t.pages.select("page_id", U.parse_site(raw).alias("site")).select("page_id", "site.*")


@query("denied_host", f"""
    SELECT page_id, h AS host, {D.registrable_domain('h')} IN {D.in_list([*V.JOB_BOARDS, *V.SOCIAL_SITES])} AS denied,
           CASE {D.registrable_domain('h')} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in V.JOB_BOARDS.items())} END AS board
    FROM (SELECT page_id, split_part({D.host('url')}, '.', 1) || '.' ||
                 {D.pick([*V.JOB_BOARDS, *V.SOCIAL_SITES, 'example.com'], 'page_id')} AS h FROM pages)""")
def denied_host(t):
    """URL-6: job boards and social sites."""
    h = F.concat(F.substring_index(U.host(col("url")), ".", 1), lit("."),
                 pick([*V.JOB_BOARDS, *V.SOCIAL_SITES, "example.com"], col("page_id")))
    return t.pages.select("page_id", h.alias("host")).select("page_id", "host", U.denied_host(col("host")).alias("d")) \
        .select("page_id", "host", "d.denied", "d.board")


@query("non_english_locale", f"""
    SELECT page_id, {D.non_english_locale(D.path('url'))} AS foreign_page,
           {D.non_english_locale("'/us' || " + D.path('url'))} AS foreign_under_country FROM pages""")
def non_english_locale(t):
    """URL-7: a leading locale that is not English."""
    p = U.path(col("url"))
    return t.pages.select("page_id", U.non_english_locale(p).alias("foreign_page"),
                          U.non_english_locale(F.concat(lit("/us"), p)).alias("foreign_under_country"))


# ---- dates ----

@query("date_from_number", """
    SELECT event_id, date_trunc('millisecond', ts) AS from_millis,
           date_trunc('second', ts) AS from_seconds, NULL::TIMESTAMP AS overflow FROM events""")
def date_from_number(t):
    """DT-1: epoch seconds and milliseconds are told apart by size; what no calendar holds is NULL."""
    millis = F.unix_millis(col("ts").cast("timestamp"))
    return t.events.select("event_id", utc(DT.from_epoch(millis)).alias("from_millis"),
                           utc(DT.from_epoch(F.floor(millis / 1000))).alias("from_seconds"),
                           utc(DT.from_epoch(millis * 1000000)).alias("overflow"))


_FORMS = ["%Y-%m-%d", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S+02:00", "%Y-%m-%d %H:%M", "%d.%m.%Y", "%Y"]
_SPARK_FORMS = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "yyyy-MM-dd HH:mm",
                "dd.MM.yyyy", "yyyy"]


@query("date_from_text", f"""
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate
        WHEN 2 THEN o_orderdate - INTERVAL 2 HOUR WHEN 3 THEN o_orderdate END AS posted FROM orders""")
def date_from_text(t):
    """DT-1: ISO dates and date-times (with or without zone) -> UTC; other text -> NULL."""
    k = (col("o_orderkey") % 6).cast("int")
    text = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in _SPARK_FORMS]), k + 1)
    return t.orders.select("o_orderkey", utc(DT.from_text(text)).alias("posted"))


@query("date_relative", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN l_shipdate
        WHEN 1 THEN l_shipdate - INTERVAL 1 DAY WHEN 2 THEN l_shipdate - to_days(l_quantity::INTEGER)
        END AS posted FROM lineitem""")
def date_relative(t):
    """DT-2: 'Posted 30+ Days Ago' counted back from the day of the scan."""
    k = col("l_linenumber") % 4
    text = (F.when(k == 0, lit("Posted Today")).when(k == 1, lit("posted yesterday"))
            .when(k == 2, F.concat(lit("Posted "), col("l_quantity").cast("int").cast("string"), lit("+ Days Ago")))
            .otherwise(lit("Recently")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             utc(DT.from_text(text, as_of=col("l_shipdate"))).alias("posted"))


@query("posted_within", """
    SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 365 DAY""")
def posted_within(t):
    """DT-3: posted within N days of a given moment; the cut-off reaches the scan."""
    return t.orders.filter(DT.within_days(col("o_orderdate"), 365, F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'"))) \
        .select("o_orderkey", "o_orderdate")


# ---- classification ----

@query("workplace_of", f"""
    SELECT o_orderkey, {D.workplace_of('v')} AS workplace, {D.workplace_of('v')} = 'remote' AS remote
    FROM (SELECT o_orderkey, {D.pick(WORKPLACE_WORDING, 'o_orderkey')} AS v FROM orders)""")
def workplace_of(t):
    """CLS-1 / CLS-3: feed wording -> workplace, and remote derived from it."""
    w = C.workplace_of(pick(WORKPLACE_WORDING, col("o_orderkey")))
    return t.orders.select("o_orderkey", w.alias("workplace")).withColumn("remote", C.remote_of(col("workplace")))


_HINTS = ["Remote", "hybrid", "Remote or Hybrid", "London", "Remotely"]


@query("workplace_from_text", f"""
    SELECT p_partkey, {D.workplace_from_text(D.pick(_HINTS, 'p_partkey'), "p_name || ' (' || p_type || ')'")} AS workplace FROM part""")
def workplace_from_text(t):
    """CLS-2: workplace named in the location or title; never on-site, never both."""
    return t.part.select("p_partkey", C.workplace_from_text(
        pick(_HINTS, col("p_partkey")), F.concat("p_name", lit(" ("), "p_type", lit(")"))).alias("workplace"))


@query("employment_type_of", f"""
    SELECT o_orderkey, {D.employment_type_of('v')} AS employment_type
    FROM (SELECT o_orderkey, {D.pick(TYPE_WORDING, 'o_orderkey')} AS v FROM orders)""")
def employment_type_of(t):
    """CLS-4: feed wording -> kind of contract."""
    return t.orders.select("o_orderkey", C.employment_type_of(pick(TYPE_WORDING, col("o_orderkey"))).alias("employment_type"))


@query("employment_type_trusted", f"""
    SELECT event_id, coalesce({D.clean('typed')}, CASE WHEN {D.employment_type_of('event_type')} <> 'other'
           THEN event_type END) AS employment_text
    FROM (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'regular ' || event_type ELSE event_type END AS event_type,
                 CASE WHEN value > 20 THEN 'Full-time' END AS typed FROM events)""")
def employment_type_trusted(t):
    """CLS-5: a bare 'type' value counts only when it is employment vocabulary."""
    loose = F.when(col("event_type").isin("click", "view"), F.concat(lit("regular "), "event_type")).otherwise(col("event_type"))
    typed = F.when(col("value") > 20, lit("Full-time"))
    return t.events.select("event_id", C.trusted_type(typed, loose).alias("employment_text"))


@query("outcome_cascade", """
    SELECT o_orderkey, CASE WHEN s AND k % 2 = 0 THEN 'timed_out' WHEN s THEN 'stopped' WHEN k % 4 = 1 THEN 'found'
        WHEN k % 5 = 2 THEN 'unreachable' WHEN k % 7 = 3 THEN 'unsupported' WHEN k % 3 = 0 THEN 'no_listings'
        WHEN k % 11 < 3 THEN 'blocked' WHEN k % 13 < 4 THEN 'no_listings' ELSE 'no_careers_page' END AS outcome
    FROM (SELECT o_orderkey, o_custkey AS k, o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS s FROM orders)""")
def outcome_cascade(t):
    """CLS-13: how a scan ended."""
    k = col("o_custkey")
    return t.orders.select("o_orderkey", C.outcome_of(
        stopped=(col("o_orderstatus") == "P") & (col("o_orderpriority") == "1-URGENT"), timed_out=k % 2 == 0,
        rows=F.when(k % 4 == 1, 3).otherwise(0), unreachable=k % 5 == 2, unsupported=F.when(k % 7 == 3, 1).otherwise(0),
        candidates=F.when(k % 3 == 0, 2).otherwise(0), blocked=k % 11 < 3, job_board=k % 13 < 4).alias("outcome"))


@query("run_source", f"""
    SELECT label, base, count(*)::BIGINT AS runs FROM (SELECT label, {D.base_source('label')} AS base FROM (
        SELECT CASE WHEN ats IS NOT NULL AND g THEN ats || ' (by name)' WHEN ats IS NOT NULL THEN ats
               WHEN n > 0 THEN CASE WHEN sniffed THEN 'json' ELSE 'page' END END AS label
        FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN 'lever' WHEN o_orderstatus = 'F' THEN 'greenhouse' END AS ats,
                     o_orderpriority < '3' AS g, o_custkey % 3 AS n, o_custkey % 2 = 0 AS sniffed FROM orders)))
    GROUP BY label, base""")
def run_source(t):
    """CLS-17: run-level source label and its base form."""
    ats = F.when(col("o_orderstatus") == "O", lit("lever")).when(col("o_orderstatus") == "F", lit("greenhouse"))
    label = C.run_source(ats, col("o_orderpriority") < "3", col("o_custkey") % 3, col("o_custkey") % 2 == 0)
    return (t.orders.select(label.alias("label")).withColumn("base", C.base_source(col("label")))
            .groupBy("label", "base").agg(F.count("*").alias("runs")))
