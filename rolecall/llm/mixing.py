"""Mixing sources to target weights: budgets down a domain-language-source tree, then seeded token prefixes of every leaf.

DataFrame functions only.
"""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from .exchange import prepare, stored

LEVELS = ["domain", "lang", "source"]
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def _named(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("none"))


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """Place of a document in a leaf's epoch: a seeded permutation, a new one for each epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _weight(name: str, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col(name)), F.lit(1.0)).cast("double")


def _share_out(nodes: DataFrame, parents: list[str], name: str, weights: dict[str, float]) -> DataFrame:
    """Give each child of a parent its share of `budget`: proportional to its weight, but at most `room`.

    What a short child cannot take goes to its siblings in proportion. With children in the order of room / weight, the
    level up to which all are filled is the largest of the levels at which the children so far are full.
    """
    nodes = nodes.withColumn("w", _weight(name, weights)).filter("w > 0 and room > 0")
    order = Window.partitionBy(*parents).orderBy(F.col("room") / F.col("w"), name)
    full = F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("budget") - F.coalesce(full, F.lit(0.0))) / rest
    whole = Window.partitionBy(*parents)
    return (nodes.withColumn("level", level).withColumn("level", F.max("level").over(whole))
            .withColumn("budget", F.least(F.col("room"), F.col("w") * F.col("level"))).drop("w", "level"))


def leaf_budgets(leaves: DataFrame, budget_share: float, max_epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """(domain, lang, source, tokens, take) from leaves (domain, lang, source, tokens).

    The whole budget is budget_share of all tokens. A leaf has room for max_epochs times its tokens, an inner node for
    the sum of its leaves with weight. Going down the tree, a shortage is made up by siblings first; only what a whole
    subtree cannot take has gone to the siblings of its ancestor.
    """
    one = F.lit(1)
    total = leaves.agg((F.floor(F.sum("tokens") * budget_share)).cast("double").alias("budget"))
    leaves = leaves.filter("tokens > 0")
    for name in LEVELS:
        leaves = leaves.filter(_weight(name, weights.get(name, {})) > 0)
    leaves = leaves.withColumn("room", (F.col("tokens") * max_epochs).cast("double")).withColumn("one", one)
    budgets = total.withColumn("one", one)
    for depth, name in enumerate(LEVELS):
        parents, path = ["one", *LEVELS[:depth]], ["one", *LEVELS[:depth + 1]]
        nodes = leaves.groupBy(*path).agg(F.sum("room").alias("room"))
        budgets = _share_out(nodes.join(budgets.select(*parents, "budget"), parents), parents, name, weights.get(name, {})).select(*path, "budget")
    return leaves.join(budgets, ["one", *LEVELS]).select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).cast("bigint").alias("take"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], budget_share: float = 0.5, max_epochs: int = 2, seed: int = 7,
        bucket_digits: int = 3) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, take_tokens): the chosen documents, once for each epoch.

    Tokens are words. A leaf's whole epochs take every document; the last one takes documents in seeded order until the
    leaf's budget is reached, and take_tokens of the one that crosses it is what was left. Prefix sums go over buckets
    of the order key first, so a leaf of any size is spread over tasks. Weights not named are 1; weight 0 leaves a
    branch out. Defined results: NULL domain, lang or source is the branch "none"; texts without words (NULL, empty)
    are never taken; repeated rows are documents of their own, in any order among themselves; an empty table gives no rows;
    further columns are ignored.
    """
    rows, leaves = _counted(docs, domain)
    plan = stored(leaf_budgets(leaves, budget_share, max_epochs, weights), "budgets")
    return _taken(rows, plan, seed, bucket_digits).select("doc_id", *LEVELS, "epoch", "n_tokens", "take_tokens")


def _counted(docs: DataFrame, domain: Column) -> tuple[DataFrame, DataFrame]:
    prepare(docs.sparkSession)
    rows = stored(docs.select("doc_id", _named(domain).alias("domain"), _named(F.col("lang")).alias("lang"), _named(F.col("source")).alias("source"),
                              word_count(F.col("text")).alias("n_tokens")), "counted")
    return rows, rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))


def _taken(rows: DataFrame, plan: DataFrame, seed: int, digits: int) -> DataFrame:
    planned = rows.filter("n_tokens > 0").join(plan, LEVELS).withColumn("last", F.floor(F.col("take") / F.col("tokens"))).withColumn(
        "rest", F.col("take") - F.col("last") * F.col("tokens"))
    whole = planned.filter("last > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last") - 1)))
    keyed = planned.filter("rest > 0").withColumn("key", order_key(F.col("doc_id"), F.col("last"), seed)).withColumn("bucket", F.substring("key", 1, digits))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    part = (keyed.join(sums, [*LEVELS, "bucket"]).filter("base < rest").withColumn("start", F.col("base") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
            .filter("start < rest"))
    columns = ["doc_id", *LEVELS, "n_tokens"]
    return (whole.select(*columns, F.col("epoch").cast("bigint").alias("epoch"), F.col("n_tokens").alias("take_tokens"), F.lit(None).cast("string").alias("key"))
            .unionByName(part.select(*columns, F.col("last").cast("bigint").alias("epoch"), F.least("n_tokens", F.col("rest") - F.col("start")).alias("take_tokens"), "key")))


def keep_mixed(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], budget_share: float, seed: int = 7) -> DataFrame:
    """The rows of docs that one epoch of the mix takes, whole and with all columns; texts do not move.

    Of each leaf the documents up to the last key taken stay, so only one key per leaf is joined to the documents.
    Defined results are those of `mix`: texts without words go, NULL domain, lang or source is the branch "none", copies of
    a row stay or go together; an empty table gives no rows; further columns may have any name.
    """
    free = "_" * (2 + max(map(len, docs.columns)))  # before names of our own: longer than any name of the caller's
    rows, leaves = _counted(docs, domain)
    plan = stored(leaf_budgets(leaves, budget_share, 1, weights), "budgets")
    last = _taken(rows, plan, seed, 3).groupBy(*[F.col(c).alias(f"{free}{c}") for c in LEVELS]).agg(F.max("key").alias(f"{free}last"))
    key = order_key(F.col("doc_id"), F.lit(0), seed)
    own = [_named(domain), _named(F.col("lang")), _named(F.col("source"))]
    match = functools.reduce(lambda a, b: a & b, [F.col(f"{free}{c}") == value for c, value in zip(LEVELS, own, strict=True)])
    until = F.col(f"{free}last")
    kept = docs.join(stored(last, "cutoffs"), match).filter(word_count(F.col("text")) > 0).filter(until.isNull() | (key <= until))
    return kept.select(*[f"`{c}`" for c in docs.columns])


def mix_sql(domain: str, weights: dict[str, dict[str, float]], budget_share: float, max_epochs: int, seed: int) -> str:
    """The same rows in SQL, over one sorted window per leaf."""
    def weight(name: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in weights.get(name, {}).items())
        return f"(CASE {name} {cases} ELSE 1.0::DOUBLE END)" if cases else "1.0::DOUBLE"

    steps, path = [], []
    for depth, name in enumerate(LEVELS):
        parents, path = list(path), [*path, name]
        by = ", ".join(parents) or "1"
        on = f"USING ({', '.join(parents)})" if parents else "ON true"
        steps.append(f"""n{depth} AS (SELECT {', '.join(path)}, sum(room) AS room FROM l GROUP BY ALL),
    c{depth} AS (SELECT n.*, p.budget, {weight(name)} AS w FROM n{depth} n JOIN {'b' + str(depth - 1) if depth else 'total'} p {on}),
    v{depth} AS (SELECT *, (budget - coalesce(sum(room) OVER (PARTITION BY {by} ORDER BY room / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (PARTITION BY {by} ORDER BY room / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c{depth}),
    b{depth} AS (SELECT {', '.join(path)}, least(room, w * max(level) OVER (PARTITION BY {by})) AS budget FROM v{depth})""")
    leaf = ", ".join(LEVELS)
    return f"""
    WITH d AS (SELECT doc_id, {domain} AS domain, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
                      CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
    a AS (SELECT {leaf}, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
    total AS (SELECT CAST(floor(sum(tokens) * {budget_share}) AS DOUBLE) AS budget FROM a),
    l AS (SELECT *, CAST(tokens * {max_epochs} AS DOUBLE) AS room FROM a WHERE tokens > 0 AND {' AND '.join(f'{weight(n)} > 0' for n in LEVELS)}),
    {', '.join(steps)},
    p AS (SELECT {leaf}, tokens, CAST(floor(budget + 1e-6) AS BIGINT) AS take FROM l JOIN b2 USING ({leaf})),
    q AS (SELECT d.*, take // tokens AS last, take % tokens AS rest FROM d JOIN p USING ({leaf}) WHERE n_tokens > 0),
    k AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY md5(concat('{seed}:', last, ':', doc_id)), n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS start
          FROM q WHERE rest > 0)
    SELECT doc_id, {leaf}, unnest(range(0, last)) AS epoch, n_tokens, n_tokens AS take_tokens FROM q WHERE last > 0
    UNION ALL SELECT doc_id, {leaf}, last AS epoch, n_tokens, CAST(least(n_tokens, rest - start) AS BIGINT) AS take_tokens FROM k WHERE start < rest"""
