"""From landed pages to postings for companies without a board: listing pages, their further pages, the links' own pages.

Each page's markup is read once, where it lies: its posting links, the further pages it names and the postings it embeds
become tables of keys and fields. Following a listing is then a matter of keys alone, round by round until no page is new.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import urls as U
from ..session import shared_folder
from . import anchors as A, jsonld as LD
from .cascade import merge_generic
from .keyed import first_per_key, kept

LEAST_LINKS = 3  # a page with fewer posting links is no listing whose further pages count
FEED = ["title", "url", "location", "company", "department", "posted_text", "employment_type", "remote", "city", "region", "country", "source"]


class LandedPages:
    """What landed pages hold, read once: `links`, `further` and `postings`, each with domain and page_key.

    pages: domain, url (as asked for), final_url, html, domains (the company's own). A page is known by its `url` without
    the fragment (result pages differ in nothing but a parameter, which url_key leaves out); of several copies the first
    by `final_url` counts. `upto` is the last result page the crawl would fetch, if there is such a wish.
    """

    def __init__(self, pages: DataFrame, upto: int | None = None):
        self.folder = f"{shared_folder(pages.sparkSession)}/reading-{uuid.uuid4().hex}"
        keyed = pages.select("domain", U.without_fragment(F.col("url")).alias("page_key"), "final_url", "html", "domains")
        keep = ["domain", "page_key"]
        # copies are told apart by address alone; markup isn't sorted
        first = kept(keyed.groupBy(*keep).agg(F.min("final_url").alias("__first")), self.folder, "keys")
        self.keys = first.select(*keep)
        # the tags are taken apart once, for postings' links and for further pages
        tags = kept(A.anchors(keyed, [*keep, "domains"]), self.folder, "tags")
        self.links = self._store(A.job_links_among(tags, [*keep, "final_url"]), first, "links")
        last = 2 ** 31 - 1 if upto is None else upto
        self.further = self._store(A.pagination_among(tags, [*keep, "final_url"], last).withColumn("next_key", U.without_fragment(F.col("url"))), first, "further")
        place = F.to_json(F.struct(*keep, "final_url"))
        found = LD.page_postings(keyed.withColumn("__page", place), "__page")
        found = found.select(F.from_json("__page", "domain string, page_key string, final_url string").alias("p"), *[c for c in found.columns if c != "__page"])
        self.postings = self._store(found.select("p.*", "*").drop("p"), first, "postings")
        self.upto = upto

    def _store(self, rows: DataFrame, first: DataFrame, name: str) -> DataFrame:
        """Rows of the copies that count, one of each."""
        mine = rows.join(first, ["domain", "page_key"]).filter(F.col("final_url") == F.col("__first")).drop("__first", "final_url")
        return kept(mine.distinct(), self.folder, name)

    def listings(self, starts: DataFrame) -> DataFrame:
        """(domain, page_key, round, place) of the start pages (domain, url, rank) and of all further pages they lead to.

        A page leads on only if it has LEAST_LINKS posting links and the page it names has landed. Rounds end when no page is
        new, so pages that name one another are read once.
        """
        counts = self.links.groupBy("domain", "page_key").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_LINKS)
        landed = self.keys.select("domain", F.col("page_key").alias("next_key"))
        edges = self.further.join(counts.select("domain", "page_key"), ["domain", "page_key"], "left_semi").join(landed, ["domain", "next_key"], "left_semi")
        edges = kept(edges.select("domain", "page_key", "next_key", "page_number").distinct(), self.folder, "edges")
        first = starts.select("domain", U.without_fragment(F.col("url")).alias("page_key"), "rank").groupBy("domain", "page_key").agg(F.min("rank").cast("bigint").alias("place"))
        reached = kept(first.join(self.keys, ["domain", "page_key"], "left_semi").select("domain", "page_key", F.lit(0).alias("round"), "place"), self.folder, "round-0")
        new, number = reached, 0
        while True:
            number += 1
            ahead = edges.join(new.select("domain", "page_key"), ["domain", "page_key"]).groupBy("domain", "next_key").agg(F.min("page_number").cast("bigint").alias("place"))
            ahead = ahead.select("domain", F.col("next_key").alias("page_key"), F.lit(number).alias("round"), "place")
            new = kept(ahead.join(reached, ["domain", "page_key"], "left_anti"), self.folder, f"round-{number}")
            if not new.head(1):
                return reached
            # all rounds so far are one scan; none is written again
            reached = new.sparkSession.read.schema(new.schema).parquet(*[f"{self.folder}/round-{n}" for n in range(number + 1)])

    def too_long(self, listings: DataFrame) -> DataFrame:
        """(domain, last_page) of companies with a listing of more pages than `upto`: what they list is not all there is."""
        counts = self.links.groupBy("domain", "page_key").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_LINKS)
        named = self.further.join(listings.select("domain", "page_key"), ["domain", "page_key"], "left_semi").join(counts, ["domain", "page_key"], "left_semi")
        limit = F.lit(self.upto).cast("bigint")
        return named.filter(F.col("last_page") > limit).groupBy("domain").agg(F.max("last_page").alias("last_page"))

    def read(self, listings: DataFrame) -> DataFrame:
        """Postings of the listings: those embedded in them, and each link once per company, read from its own page if that has one.

        Columns: domain and FEED. A link's first appearance counts: by round, place of the page, place on the page. Its own
        page's first embedded posting replaces it; a link whose page has none, or has not landed, is a row of its own.
        """
        feed = [F.lit("json-ld").alias("source") if c == "source" else F.col(c) for c in FEED]
        embedded = self.postings.join(listings.select("domain", "page_key"), ["domain", "page_key"], "left_semi").select("domain", *feed)
        order = [F.col("round"), F.col("place"), F.col("page_key"), F.col("pos")]
        links = first_per_key(self.links.join(listings, ["domain", "page_key"]), ["domain", "url_key"], order)
        page = U.url_key(F.col("page_key"))
        own = first_per_key(self.postings.filter("pos = 0").withColumn("url_key", page), ["domain", "url_key"], [F.col("page_key")])
        own = own.select("domain", "url_key", *feed)
        # links are known by company and address
        both = F.to_json(F.struct("domain", "url_key"))
        return merge_generic(embedded, links.withColumn("url_key", both), own.withColumn("url_key", both))
