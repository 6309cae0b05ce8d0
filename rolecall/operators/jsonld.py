"""Postings embedded in pages as JSON-LD. All work on a page happens inside its row; nothing is shuffled."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as TX, urls as U, variants as J
from .keyed import computed

SCRIPT = r"(?is)<script\b[^>]*type\s*=\s*[\"']?[^\"'>]*ld\+json[^>]*>(.*?)</script\s*>"
_NODES = "array<struct<path:string,node:variant>>"
CHILD_KEYS = ["@graph", "itemListElement", "item"]


def blocks(pages: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per readable JSON-LD block: keep columns, block (its position), doc, levels (how deep it nests)."""
    found = pages.select(*keep, F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("block", "raw"))
    found = found.filter(F.trim("raw") != "")
    return computed(found, doc=J.parse(F.col("raw")), levels=J.nesting(F.col("raw"))).drop("raw").filter(F.col("doc").isNotNull())


def _children(n: Column) -> Column:
    listed = F.transform(J.items(n["node"]), lambda x, i: F.struct(
        F.concat(n["path"], F.lit("/"), F.lpad(i.cast("string"), 9, "0")).alias("path"), x.alias("node")))
    keyed = F.filter(F.array(*[F.struct(F.concat(n["path"], F.lit(f"/{i}")).alias("path"), J.get(n["node"], k).alias("node"))
                               for i, k in enumerate(CHILD_KEYS)]), lambda x: x["node"].isNotNull())
    return F.coalesce(listed.cast(_NODES), keyed.cast(_NODES))


def _is_posting(v: Column) -> Column:
    kinds = J.get(v, "@type")
    many = F.coalesce(F.exists(J.items(kinds), lambda t: J.scalar(t) == "JobPosting"), F.lit(False))
    return J.is_object(v) & (F.coalesce(J.scalar(kinds) == "JobPosting", F.lit(False)) | many)


def postings(found: DataFrame, keep: Sequence[str]) -> DataFrame:
    """JobPosting nodes of the blocks in document order: keep columns, block, path, posting. Any depth is walked."""
    start = F.struct(F.array(F.struct(F.lit("").alias("path"), F.col("doc").alias("node"))).cast(_NODES).alias("todo"),
                     F.array().cast(_NODES).alias("found"))

    def level(acc: Column, _: Column) -> Column:
        return F.struct(F.flatten(F.transform(acc["todo"], _children)).cast(_NODES).alias("todo"),
                        F.concat(acc["found"], F.filter(acc["todo"], lambda n: _is_posting(n["node"]))).cast(_NODES).alias("found"))

    nodes = F.aggregate(F.sequence(F.lit(1), F.col("levels")), start, level, lambda acc: acc["found"])
    return found.select(*keep, "block", F.inline(nodes)).withColumnRenamed("node", "posting")


def _places(p: Column) -> Column:
    return J.let(J.get(p, "jobLocation"), lambda where: F.coalesce(
        J.items(where), F.when(J.filled(where), F.array(where)), F.array().cast("array<variant>")))


def _country(address: Column) -> Column:
    c = J.get(address, "addressCountry")
    return F.coalesce(J.scalar(c), J.scalar(J.get(c, "name")))


def _address_text(place: Column) -> Column:
    def text(address: Column) -> Column:
        parts = F.filter(F.array(J.scalar(J.get(address, "addressLocality")), J.scalar(J.get(address, "addressRegion")),
                                 _country(address)), lambda x: x.isNotNull() & (x != ""))
        return F.when(J.is_object(address), F.array_join(parts, ", ")).otherwise(J.scalar(address))

    return J.let(F.when(J.is_object(place), J.get(place, "address")).otherwise(place), text)


def _first_address(p: Column) -> Column:
    addresses = F.filter(F.transform(_places(p), lambda x: J.get(x, "address")), J.is_object)
    return F.get(addresses, F.lit(0))


def _or(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def posting_fields(p: Column) -> dict[str, Column]:
    """Feed columns of a JobPosting node, before conforming."""
    kind = J.get(p, "employmentType")
    address = J.let(_first_address(p), lambda a: F.struct(J.text(J.get(a, "addressLocality")).alias("city"),
                                                          J.text(J.get(a, "addressRegion")).alias("region"), _country(a).alias("country")))
    ident = J.get(p, "identifier")
    telecommute = F.upper(J.scalar(J.get(p, "jobLocationType"))) == "TELECOMMUTE"
    first_kind = F.when(J.items(kind).isNotNull(), F.get(J.items(kind), F.lit(0))).otherwise(kind)
    return {
        "company": J.scalar(J.get(J.get(p, "hiringOrganization"), "name")),
        "title": _or(J.scalar(J.get(p, "title")), J.scalar(J.get(p, "name"))),
        "own_url": F.nullif(F.trim(J.text(J.get(p, "url"))), F.lit("")),
        "identifier": F.trim(_or(J.scalar(ident), J.scalar(J.get(ident, "value")), J.scalar(J.get(ident, "name")))),
        "location": TX.clean_list(F.transform(_places(p), _address_text)),
        "remote": F.when(telecommute, F.lit(True)),
        "department": F.coalesce(J.readable(J.get(p, "occupationalCategory"), 2), J.readable(J.get(p, "industry"), 2)),
        "posted_text": J.scalar(J.get(p, "datePosted")),
        "employment_type": J.text(first_kind),
        "address": address}


def unique_fragments(bases: Column) -> Column:
    """Names in order -> the same names made unique: the second 'x' becomes 'x-2', skipping names already given.

    Mostly the n-th 'x' is 'x-n', which one count says; only where such a name is somebody's own name too is the page
    walked name by name.
    """
    def numbered(sorted_: Column) -> Column:
        # equal names stand together, in page order: the place inside the run is the number
        def step(acc: Column, x: Column) -> Column:
            n = F.when(acc["last"] == x["name"], acc["n"] + 1).otherwise(1)
            name = F.when(n == 1, x["name"]).otherwise(F.concat(x["name"], F.lit("-"), n.cast("string")))
            return F.struct(F.array_append(acc["out"], F.struct(x["i"].alias("i"), name.alias("name"))).alias("out"), x["name"].alias("last"), n.alias("n"))

        start = F.struct(F.array().cast("array<struct<i:int,name:string>>").alias("out"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"))
        return F.transform(F.array_sort(F.aggregate(sorted_, start, step, lambda acc: acc["out"])), lambda x: x["name"])

    placed = F.transform(bases, lambda name, i: F.struct(name.alias("name"), i.alias("i")))
    quick = J.let(F.array_sort(placed), numbered)
    return J.let(quick, lambda names: F.when(F.size(F.array_distinct(names)) == F.size(names), names).otherwise(_walked(bases)))


def _walked(bases: Column) -> Column:
    """Name by name: a name already given takes the smallest number whose name is free, found among the numbers taken."""
    def step(taken: Column, base: Column) -> Column:
        prefix = F.concat(base, F.lit("-"))

        def number(name: Column) -> Column:
            suffix = F.substr(name, F.length(prefix) + 1)
            n = suffix.try_cast("int")
            return F.when(n.cast("string") == suffix, n)  # 'x-02' takes no number

        numbers = F.filter(F.transform(F.filter(taken, lambda x: F.startswith(x, prefix)), number), lambda n: n.isNotNull())
        free = J.let(numbers, lambda ns: F.get(F.array_except(F.sequence(F.lit(2), F.size(ns) + 2), ns), F.lit(0)))
        return F.array_append(taken, F.when(F.array_contains(taken, base), F.concat(prefix, free.cast("string"))).otherwise(base))

    return F.aggregate(bases, F.array().cast("array<string>"), step)


def page_postings(pages: DataFrame, key: str) -> DataFrame:
    """Postings embedded in listing pages with their URLs: own URL, or the page plus #job-<id or title>.

    The postings of one page are numbered inside that page's row, so a page is never spread over tasks.
    """
    walked = _in_row(pages, [key, "final_url"])
    fields = F.transform("nodes", lambda n: F.struct(*[c.alias(name) for name, c in posting_fields(n["node"]).items()]))
    work = computed(walked, postings=fields)
    base = F.transform("postings", lambda p: F.when(p["own_url"].isNull(), F.coalesce(F.nullif(TX.slug(_or(
        p["identifier"], p["title"])), F.lit("")), F.lit("posting"))))
    work = computed(work, bases=base)
    named = computed(work, names=unique_fragments(F.filter("bases", lambda b: b.isNotNull())))
    rows = named.select(key, "final_url", "bases", "names", F.posexplode("postings").alias("pos", "p"))
    # a posting without its own URL takes the next of the page's unique names
    nth = F.size(F.filter(F.slice("bases", 1, F.col("pos") + 1), lambda b: b.isNotNull()))
    url = F.when(F.col("p.own_url").isNotNull(), U.resolve(F.col("final_url"), F.col("p.own_url"))).otherwise(
        U.job_fragment_url(F.col("final_url"), F.try_element_at("names", nth)))
    return rows.select(key, "pos", "p.*", "p.address.*", url.alias("url")).drop("address")


def _in_row(pages: DataFrame, keep: Sequence[str]) -> DataFrame:
    """All JobPosting nodes of a page as one array, block after block, in document order."""
    raws = F.filter(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1)),
                    lambda r: F.contains(r, F.lit("JobPosting")) | F.contains(r, F.lit("\\u")))     # others hold no posting
    work = computed(pages.select(*keep, "html"), raws=raws).drop("html").filter(F.size("raws") > 0)
    work = computed(work, docs=F.filter(F.transform("raws", lambda r: F.struct(J.parse(r).alias("doc"), J.nesting(r).alias("levels"))),
                                        lambda d: d["doc"].isNotNull())).drop("raws")

    def walk(d: Column) -> Column:
        start = F.struct(F.array(F.struct(F.lit("").alias("path"), d["doc"].alias("node"))).cast(_NODES).alias("todo"),
                         F.array().cast(_NODES).alias("found"))

        def level(acc: Column, _: Column) -> Column:
            return F.struct(F.flatten(F.transform(acc["todo"], _children)).cast(_NODES).alias("todo"),
                            F.concat(acc["found"], F.filter(acc["todo"], lambda n: _is_posting(n["node"]))).cast(_NODES).alias("found"))

        found = F.aggregate(F.sequence(F.lit(1), d["levels"]), start, level, lambda acc: acc["found"])
        return F.array_sort(found, lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))

    return computed(work, nodes=F.flatten(F.transform("docs", walk))).drop("docs").filter(F.size("nodes") > 0)
