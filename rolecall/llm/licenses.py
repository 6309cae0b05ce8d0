"""License scan by exact set-similarity join. DataFrame functions only.

Base: places where the words of a license name stand one after another. Method: every run of a template's length divided
by the threshold, in words, is compared with the template by containment (the share of the template's distinct words that
the run holds). Line breaks, comment marks and indentation are no words, so a statement may be wrapped in any way. Texts
are cut into blocks that overlap by half, so that every run lies within a block. Template words are ordered by their
frequency in the whole corpus, rarest first. A block with a matching run must hold one of a template's first words
(prefix filter) and enough words of templates at all (length filter), and where the first common word stands in both
orders bounds how many can be common (positional filter). The runs of what is left are compared exactly.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.keyed import computed
from .exchange import prepare, stored

# On lower-cased text the same as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, which Java matches eight times slower.
WORDS = "[a-z0-9\\x{80}-\\x{10FFFF}]+"
WORDS_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Names of licenses whose words are looked for one after another, with their labels.
NAMES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Wordings by which texts state a license, with their labels.
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
]


def lowered(text: Column) -> Column:
    """Text with A-Z lower-cased. Other letters may change too, but never into or out of ASCII, so words stay words."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def _places(words: Column, names: dict[str, str]) -> Column:
    """struct(label, at) of every place where a name's words stand one after another."""
    def label_at(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, label in names.items():
            hit = F.lit(True)
            for k, word in enumerate(name.split()):
                hit = hit & (F.coalesce(F.get(words, i + k), F.lit("")) == word)
            out = F.when(hit, F.lit(label)).otherwise(out)
        return out

    n = F.size(words)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(at, lambda i: F.struct(label_at(i).alias("label"), i.cast("bigint").alias("at"))), lambda p: p["label"].isNotNull())


def template_ranks(docs: DataFrame, templates: list[tuple[str, str]], text_column: str = "text") -> list[str]:
    """The templates' words, rarest first by the number of documents that hold them; one row for each template word."""
    vocabulary = sorted({w for t, _ in templates for w in t.split()})
    held = F.array_intersect(words_of(lowered(F.col(text_column))), F.array(*[F.lit(w) for w in vocabulary]))
    counts = dict(map(tuple, docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()))
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def run_length(template: str, threshold: float) -> int:
    """The words a run may have that is compared with a template."""
    return math.ceil(len(template.split()) / threshold - 1e-9)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, names: dict[str, str] = NAMES, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    `found` lists matching runs as (label, at, run, share): the first best run of each stretch of starts as long as the
    longest run; `at` is its first word's number from 0. score is 1 where a base name stands, else the largest share of a
    matching run, else 0. Defined results: NULL text is empty (no words, empty labels, score 0); repeated rows and NULL
    ids get rows of their own; templates of equal share are all found; an empty table gives no rows; further columns are
    ignored.
    """
    spark = prepare(docs.sparkSession)
    order = template_ranks(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    sets = [(label, sorted({rank[w] for w in t.split()})) for t, label in templates]
    need = [math.ceil(threshold * len(s) - 1e-9) for _, s in sets]
    prefixes = [s[:len(s) - n + 1] for (_, s), n in zip(sets, need, strict=True)]
    rare = F.array(*[F.lit(w) for w in sorted({order[i] for p in prefixes for i in p})])
    runs = [run_length(t, threshold) for t, _ in templates]
    stretch = max(runs)
    text = lowered(F.col("text"))
    maybe = F.lit(False)
    for name in names:
        maybe = maybe | (F.col("text").contains(name.split()[0]) & F.col("text").contains(name.split()[-1]))
    texts = computed(docs.select("doc_id", "text"), text=text)  # once, not in every expression that reads it
    texts = computed(texts, words=words_of(F.col("text")))
    # block b holds the runs that start at words b * stretch to (b + 1) * stretch - 1
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1, F.lit(stretch))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda at: F.struct(at.alias("at"), F.slice("words", at + 1, 2 * stretch).alias("words")))
    base = stored(texts.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"),
        F.when(maybe, _places(F.col("words"), names)).otherwise(F.array().cast("array<struct<label:string,at:bigint>>")).alias("places"),
        F.filter(blocks, lambda b: F.arrays_overlap(b["words"], rare)).alias("blocks")).withColumn("row", F.monotonically_increasing_id()), "scanned")
    # blocks as sorted ranks of the template words they hold
    ranks = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    held = F.array_intersect(F.col("block.words"), F.array(*[F.lit(w) for w in order]))
    held = computed(base.select("row", F.explode("blocks").alias("block")), held=F.array_sort(F.transform(held, lambda w: F.element_at(ranks, w))))
    held = held.filter(F.size("held") >= min(need))
    index = spark.createDataFrame([(word, at, k, label, s, [order[i] for i in s], n, run) for k, ((label, s), n, p, run) in enumerate(zip(sets, need, prefixes, runs, strict=True)) for at, word in enumerate(p)],
                                  "word int, t_at int, template int, label string, ranks array<int>, words array<string>, need int, run int")
    # the block's words are in the same order; the first common word at places i and j leaves room for so many common ones
    room = F.least(F.size("ranks") - F.col("t_at"), F.size("held") - F.col("b_at"))
    common = F.size(F.array_intersect("held", "ranks"))
    first = F.least(F.lit(stretch), F.size("block.words"))
    # of equal shares the smallest start: its negative is the largest
    best = F.array_max(F.transform(F.sequence(F.lit(0), first - 1), lambda i: F.struct(
        F.size(F.array_intersect(F.slice("block.words", i + 1, F.col("run")), F.col("words"))).alias("share"), (-i).alias("back"))))
    pairs = (held.select("row", "block", "held", F.posexplode("held").alias("b_at", "word")).join(F.broadcast(index), "word")
             .filter(F.size("held") >= F.col("need")).filter(room >= F.col("need")).filter(common >= F.col("need"))
             .dropDuplicates(["row", "block", "template"]))
    at = F.col("block.at") - F.col("best.back")
    found = (computed(pairs, best=best).filter(F.col("best.share") >= F.col("need"))
             .groupBy("row").agg(F.collect_list(F.struct("label", at.cast("bigint").alias("at"), F.array_join(F.slice("block.words", 1 - F.col("best.back"), F.col("run")), " ").alias("run"),
                                                         (F.col("best.share") / F.size("words")).alias("share"))).alias("found")))
    labels = F.transform("places", lambda p: p["label"])
    extra = F.coalesce(F.transform("found", lambda m: m["label"]), F.array().cast("array<string>"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    at = F.transform("places", lambda p: p["at"])
    return base.join(found, "row", "left").select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, extra)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0))).alias("score"),
        F.coalesce("found", F.array().cast("array<struct<label:string,at:bigint,run:string,share:double>>")).alias("found"))


def scan_sql(templates: list[tuple[str, str]] = TEMPLATES, names: dict[str, str] = NAMES, threshold: float = 0.8) -> str:
    """The same rows (without `found`) in SQL, comparing the runs that start at each template word with its template."""
    cases = " ".join("WHEN " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(name.split())) + f" THEN '{label}'" for name, label in names.items())
    shares = " UNION ALL ".join(f"""
        SELECT r, '{label}' AS label, count(DISTINCT word) OVER (PARTITION BY r ORDER BY i RANGE BETWEEN CURRENT ROW AND {run_length(t, threshold) - 1} FOLLOWING) / {len(set(t.split()))} AS share
        FROM o WHERE word IN ({", ".join(f"'{x}'" for x in sorted(set(t.split())))})""" for t, label in templates)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(replace(coalesce(text, ''), 'K', 'é')) AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '{WORDS_SQL}') AS w FROM d),
    p AS (SELECT *, list_filter(list_transform(range(0, len(w)), lambda i: {{'label': CASE {cases} END, 'at': i}}), lambda x: x.label IS NOT NULL) AS p FROM w),
    o AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM w),
    s AS ({shares}),
    m AS (SELECT r, list(label) AS labels, max(share) AS share FROM s WHERE share >= {threshold} - 1e-9 GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(list_transform(p, lambda x: x.at)) AS first_word,
           list_max(list_transform(p, lambda x: x.at)) AS last_word,
           array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(m.labels, [])))), ',') AS labels,
           CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
    FROM p LEFT JOIN m USING (r)"""
