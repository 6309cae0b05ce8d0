"""Postings in the JSON a rendered page loaded: which arrays are listings, and reading their objects."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as C, dates as DT, urls as U, variants as J, vocab as V
from ..session import shared_folder
from . import objects as O
from .keyed import computed, first_per_key, kept

_TODO = "array<struct<path:string,at:string,node:variant>>"
_FOUND = "array<struct<path:string,at:string,objects:array<variant>>>"


def _step(path: Column, at: Column, i: Column, node: Column) -> Column:
    """A node one level further in; `at` sorts as the document is read."""
    return F.struct(path.alias("path"), F.concat(at, F.lit("/"), F.lpad(i.cast("string"), 9, "0")).alias("at"), node.alias("node"))


def _named(n: Column, e: Column) -> Column:
    return F.when(n["path"] == "", e["key"]).otherwise(F.concat(n["path"], F.lit("."), e["key"]))


def _root(data: Column) -> Column:
    return F.array(F.struct(F.lit("").alias("path"), F.lit("").alias("at"), data.alias("node"))).cast(_TODO)


def _levels(data: Column) -> Column:
    return F.coalesce(J.nesting(F.to_json(data)), F.lit(1))


def captured(responses: DataFrame, page_url: str) -> DataFrame:
    """Responses worth reading: not empty, from the page's own domain or a known platform. responses: page_url, url, body."""
    host = U.host(F.col("url"))
    own = U.registrable_domain(host) == U.registrable_domain(U.host(F.col(page_url)))
    known = F.lit(False)
    for h in V.API_HOSTS:
        known = known | U.same_site(host, F.lit(h))
    return responses.filter((own | known) & (F.length("body") > 0))


def listing_arrays(data: Column, levels: Column | None = None) -> Column:
    """Arrays that list postings, in document order, as array<struct<path, at, objects>>; `at` is the place in the document.

    All elements of all levels are visited (`levels`: how deep the text nests, where the caller has it); found arrays are not
    looked into further.
    """
    if levels is None:
        return J.let(data, lambda d: listing_arrays(d, _levels(d)))

    def children(n: Column) -> Column:
        listed = F.transform(J.items(n["node"]), lambda x, i: _step(F.concat(n["path"], F.lit("[]")), n["at"], i, x)).cast(_TODO)
        keyed = F.transform(J.fields(n["node"]), lambda e, i: _step(_named(n, e), n["at"], i, e["value"])).cast(_TODO)
        inner = F.coalesce(listed, keyed, F.array().cast(_TODO))
        return F.filter(inner, lambda x: J.is_nested(x["node"]))

    def judged(n: Column) -> Column:
        def listing(objects: Column) -> Column:
            enough = F.size(F.filter(objects, J.looks_like_posting)) >= V.MIN_SHARE * F.size(objects)
            return F.when((F.size(objects) >= V.MIN_ITEMS) & enough, objects)

        objects = F.filter(J.items(n["node"]), J.is_object)
        return F.struct(n["path"].alias("path"), n["at"].alias("at"), n["node"].alias("node"), J.let(objects, listing).alias("objects"))

    start = F.struct(_root(data).alias("todo"), F.array().cast(_FOUND).alias("found"))

    def level(acc: Column, _: Column) -> Column:
        def split(nodes: Column) -> Column:
            hits = F.filter(nodes, lambda n: n["objects"].isNotNull())
            rest = F.filter(nodes, lambda n: n["objects"].isNull())
            return F.struct(
                F.flatten(F.transform(rest, children)).cast(_TODO).alias("todo"),
                F.concat(acc["found"], F.transform(hits, lambda n: F.struct(n["path"].alias("path"), n["at"].alias("at"), n["objects"].alias("objects"))))
                .cast(_FOUND).alias("found"))

        return J.let(F.transform(acc["todo"], judged), split)

    found = F.aggregate(F.sequence(F.lit(1), levels), start, level, lambda acc: acc["found"])
    return F.array_sort(found, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))


def sniffed_postings(payloads: DataFrame, page: str, page_url: str = "page_url", as_of: Column | None = None) -> DataFrame:
    """Postings of each page from the payloads it loaded (page, page_url, pos, url, data).

    Payloads of one endpoint and place in the JSON are pages of one listing; of several listings the one with the most
    distinct postings is taken, the first among equals, and only with three or more.
    """
    texts = payloads.select(page, page_url, F.col("pos").alias("payload"), U.path(F.coalesce("url", F.lit(""))).alias("endpoint"),
                            F.to_json("data").alias("text"))  # a filter by it would run before rows are spread
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    work = texts.mapInArrow(O.read, f"{held}, {O.FOUND_DDL}")
    keep = [page, "payload", "endpoint", "array", "json_path", "item"]
    own, ident = F.col("own_url"), F.coalesce("id_text", F.lit(""))
    url = F.when(own.rlike("^(https?://|/)"), U.resolve(F.col(page_url), own)).when(
        ident != "", U.job_fragment_url(F.col(page_url), F.regexp_replace(ident, r"[^A-Za-z0-9._~\-]+", "-")))
    rows = computed(work, url=url, location=F.col("place"),
                    posted=F.coalesce(DT.from_epoch(F.col("number")), DT.from_text(F.col("date_text"), as_of)),
                    employment_type=C.trusted_type(F.col("typed"), F.col("loose_type")))
    rows = rows.select(*keep, "title", "url", "location", "remote", "department", "posted", "employment_type", "workplace",
                       "city", "region", "country").filter(F.col("title").isNotNull() & F.col("url").isNotNull())
    listing = [page, "endpoint", "json_path"]
    order = [F.col("payload"), F.col("array"), F.col("item")]
    # rows are placed by posting, so a page with most of the postings is spread over all tasks; listings are counted with
    # partial sums, and the winner of each page (one row) is joined back; both read a scratch table, so that the JSON is
    # walked once
    folder = f"{shared_folder(payloads.sparkSession)}/sniffed-{uuid.uuid4().hex}"
    once = kept(first_per_key(rows, [*listing, "url"], order), folder, "postings")
    sized = once.groupBy(*listing).agg(F.count("*").alias("__n"), F.min(F.struct("payload", "array")).alias("__first"))
    best = first_per_key(sized.filter(F.col("__n") >= V.MIN_ITEMS), [page], [F.col("__n").desc(), F.col("__first"), F.col("json_path")])
    return once.join(best.select(*listing), listing, "left_semi").withColumn("source", F.lit("json-sniffed"))


def payload_profile(payloads: DataFrame, keep: list[str]) -> DataFrame:
    """What each payload holds: its top-level keys and the sizes of its arrays at any depth, by path."""
    sizes = "array<struct<path:string,size:int>>"

    def children(n: Column) -> Column:
        inner = F.get(J.items(n["node"]), F.lit(0))
        first = F.array(_step(F.concat(n["path"], F.lit("[]")), n["at"], F.lit(0), inner)).cast(_TODO)
        listed = F.when(J.items(n["node"]).isNotNull(), F.when(J.is_nested(inner), first).otherwise(F.array().cast(_TODO)))
        keyed = F.transform(J.fields(n["node"]), lambda e, i: _step(_named(n, e), n["at"], i, e["value"])).cast(_TODO)
        return F.coalesce(listed, keyed, F.array().cast(_TODO))

    def level(acc: Column, _: Column) -> Column:
        arrays = F.filter(acc["todo"], lambda n: J.items(n["node"]).isNotNull())
        named = F.transform(arrays, lambda n: F.struct(F.when(n["path"] == "", F.lit("[]")).otherwise(n["path"]).alias("path"),
                                                       F.size(J.items(n["node"])).alias("size")))
        return F.struct(F.flatten(F.transform(acc["todo"], children)).cast(_TODO).alias("todo"),
                        F.concat(acc["arrays"], named).cast(sizes).alias("arrays"))

    start = F.struct(_root(F.col("data")).alias("todo"), F.array().cast(sizes).alias("arrays"))
    arrays = F.aggregate(F.sequence(F.lit(1), _levels(F.col("data"))), start, level, lambda acc: acc["arrays"])
    keys = F.transform(J.fields(F.col("data")), lambda e: e["key"])
    return payloads.select(*keep, keys.alias("keys"), arrays.alias("arrays"))
