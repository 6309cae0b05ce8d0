"""Merkle manifest of a data set, with nested-interval labels.

Leaves are ranked within their source; a node is labelled by the interval [low, high) of the leaf ranks it covers, and
level l holds the intervals of 16^l ranks. Parents come from grouping by interval, ancestors from containment joins whose
key is the bucket of the interval on its level, and the siblings of a node are the intervals of its parent without its
own. Everything is DataFrame code: no group has more than FANOUT rows, however many leaves a source has.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.keyed import with_known_size
from .exchange import prepare, stored

FANOUT = 16
BUCKET_ROWS = 50_000
SENT_ROWS = 2_000  # tables with a path or a digest in each row are broadcast up to so many rows
STEP = "struct<left:string,right:string>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of text."""
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """`-` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(row: dict[str, Column], names: list[str]) -> Column:
    return digest(F.concat(*[field(row[name]) for name in names]))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Rows with `low`, their place (from 0) in their tree along `order`, and `n`, the number of rows of the tree.

    The rows are range-partitioned by tree and order, so a tree with most of the rows is spread over many ranges, and
    copies of a row, numbered as they are written, likewise; places are numbered inside a range and moved by the sizes of
    the tree's earlier ranges, one row for each tree and range.
    """
    rows, order = stored(rows.withColumn("__copy", F.monotonically_increasing_id()), "leaves"), [*order, "__copy"]
    total = rows.count()
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_ROWS + 1)
    ranged = stored(rows.repartitionByRange(ranges, F.asc_nulls_first(tree), *[F.asc_nulls_first(c) for c in order])
                    .withColumn("__range", F.spark_partition_id()), "ranged")
    mine = Window.partitionBy("__range", tree).orderBy(*[F.asc_nulls_first(c) for c in order])
    earlier = Window.partitionBy(tree).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(tree, "__range").agg(F.count("*").alias("__size"))
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("__size").over(earlier), F.lit(0)), "n": F.sum("__size").over(Window.partitionBy(tree))})
    sizes = sizes.select(F.col(tree).alias("__tree"), F.col("__range").alias("__of"), "__before", "n")
    placed = ranged.withColumn("__place", F.row_number().over(mine))
    placed = placed.join(with_known_size(stored(sizes, "ranges")), placed[tree].eqNullSafe(F.col("__tree")) & (F.col("__range") == F.col("__of")))
    return placed.withColumn("low", F.col("__place") - 1 + F.col("__before")).drop("__tree", "__of", "__range", "__place", "__before", "__copy")


def _bucket(level: int) -> Column:
    return F.floor(F.col("low") / F.lit(FANOUT ** level))


def parents(nodes: DataFrame, level: int, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """The nodes of a level from those below it: (tree, n, low, high, digest, children), children by interval.

    `nodes` has tree, n, low, high, digest. A tree of a single leaf keeps that leaf's digest.
    """
    child = F.struct("low", "high", "digest", *extra)
    made = nodes.groupBy("tree", "n", _bucket(level).alias("__bucket")).agg(F.sort_array(F.collect_list(child)).alias("children"))
    hashed = digest(F.array_join(F.col("children.digest"), ""))
    return made.select("tree", "n", F.col("children")[0]["low"].alias("low"), F.element_at("children", -1)["high"].alias("high"),
                       F.when(F.col("n") == 1, F.col("children")[0]["digest"]).otherwise(hashed).alias("digest"), "children")


def steps(children: Column, own: Column) -> Column:
    """The digests beside a node: those of its parent's intervals that lie before its own, and those after it."""
    left = F.filter(children, lambda c: c["high"] <= own["low"])
    right = F.filter(children, lambda c: c["low"] >= own["high"])
    return F.struct(F.array_join(F.transform(left, lambda c: c["digest"]), "").alias("left"),
                    F.array_join(F.transform(right, lambda c: c["digest"]), "").alias("right"))


def build(leaves: DataFrame, extra: list[str]) -> list[DataFrame]:
    """Levels 1, 2, … of the trees of `leaves` (tree, n, low, high, digest, extra), each stored; every tree ends in one node.

    Level 1 keeps the extra columns of the leaves in its children.
    """
    levels = [stored(parents(leaves, 1, extra), "level")]
    most = levels[0].agg(F.max("n")).head()[0] or 0
    while FANOUT ** len(levels) < most:
        level = len(levels) + 1
        below = levels[-1].filter(F.col("n") > FANOUT ** (level - 1)).drop("children")
        levels.append(stored(parents(below, level), "level"))
    return levels


def attach(nodes: DataFrame, upper: DataFrame, level: int) -> DataFrame:
    """Nodes of a level with the path of their ancestors: those of the level above whose interval contains theirs.

    `upper` has (tree, low, high, children, path) of the level above. Tree and bucket of the interval are the join's key,
    containment its condition.
    """
    up = upper.select(F.col("tree").alias("__tree"), F.col("low").alias("__low"), F.col("high").alias("__high"), F.col("children").alias("__children"),
                      F.col("path").alias("__path"), _bucket(level + 1).alias("__bucket"))
    inside = (F.col("__low") <= F.col("low")) & (F.col("high") <= F.col("__high"))
    found = nodes.join(up, F.col("tree").eqNullSafe(F.col("__tree")) & (_bucket(level + 1) == F.col("__bucket")) & inside)
    path = F.concat(F.array(steps(F.col("__children"), F.struct("low", "high"))), "__path")
    return found.withColumn("path", path).drop("__tree", "__low", "__high", "__children", "__path", "__bucket")


def paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Level 1 with `path`: the digests beside every ancestor, from the node itself up, then those `above` gives its tree.

    above: (tree, top), one row for each tree, top the steps from the tree's root on.
    """
    top = above.select(F.col("tree").alias("__tree"), "top")
    done = None
    for level in range(len(levels), 0, -1):
        nodes = levels[level - 1]
        ends = nodes.filter(F.col("n") <= FANOUT ** level)  # trees that end here
        now = ends.join(with_known_size(top, SENT_ROWS), F.col("tree").eqNullSafe(F.col("__tree"))).withColumnRenamed("top", "path").drop("__tree")
        if done is not None:
            now = now.unionByName(attach(nodes.filter(F.col("n") > FANOUT ** level), done, level))
        done = stored(now, "paths") if level > 1 else now
    return done


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and the digests beside its path."""
    return F.aggregate(path, start, lambda now, s: digest(F.concat(s["left"], now, s["right"])))


def manifest(docs: DataFrame, columns: list[str], changed: dict[str, Column] | None = None, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """One row per row of docs: the id, low (its rank in its source), leaf, subroot, root, path, checked_leaf, folded_root, verified.

    A leaf is the digest of `columns`, each `-` if NULL, else byte count, colon and value. Leaves of a source ascend by id;
    every FANOUT consecutive nodes become their digest until one remains, the subroot; subroots, ordered by source (NULL
    first, else by UTF-8 bytes), likewise give the root. `path` has the digests left and right of each node from the leaf
    up. `changed` gives columns as found later: the leaf is computed again from them and folded along the path.

    Defined results: a NULL id comes first in its source; NULL and empty texts are different values; rows with equal ids
    follow by their digest, so identical rows share their places in either order; an empty table gives no rows; other
    columns are read only if named in `columns`, whatever they are called.
    """
    prepare(docs.sparkSession)
    now = {name: F.col(name) for name in columns}
    found = leaf({**now, **(changed or {})}, columns) if changed else leaf(now, columns)
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("tree"), leaf(now, columns).alias("digest"), found.alias("found"))
    leaves = ranked(rows, "tree", ["id", "digest", "found"]).withColumn("high", F.col("low") + 1)
    levels = build(leaves, ["id", "found"])
    roots = levels[0].filter(F.col("n") <= FANOUT).select("tree", "digest")
    for k, level in enumerate(levels[1:], 2):
        roots = roots.union(level.filter(F.col("n") <= FANOUT ** k).select("tree", "digest"))
    roots = stored(roots, "subroots")

    # the tree of sources, one row for each source
    sources = ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), "tree", ["source"]).withColumn("high", F.col("low") + 1)
    over = build(sources, ["source"])
    whole = over[-1].select(F.col("digest").alias("root"))
    above = paths(over, whole.select(F.lit("").alias("tree"), F.array().cast(f"array<{STEP}>").alias("top")))
    tops = above.select(F.explode("children").alias("c"), "children", "path", "n")
    tops = tops.select(F.col("c.source").alias("tree"), F.col("c.digest").alias("subroot"), _first_step().alias("top"))
    tops = stored(tops.crossJoin(F.broadcast(whole)), "tops")  # the root is one row

    level1 = paths(levels, tops.select("tree", "top"))
    each = level1.select("tree", "n", F.explode("children").alias("c"), "children", "path")
    each = each.select("tree", F.col("c.id").alias("id"), F.col("c.low").alias("low"), F.col("c.digest").alias("leaf"), F.col("c.found").alias("checked_leaf"),
                       _first_step().alias("path"))
    named = tops.select(F.col("tree").alias("__tree"), "subroot", "root")
    full = each.join(with_known_size(named, SENT_ROWS), F.col("tree").eqNullSafe(F.col("__tree"))).drop("__tree")
    full = full.withColumn("folded_root", fold(F.col("checked_leaf"), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))
    return full.withColumnsRenamed({"id": id_column, "tree": source_column})


def _first_step() -> Column:
    """The path of child c: beside it in its parent, then the parent's path; a tree of one leaf has no node above the leaf."""
    own = F.array(steps(F.col("children"), F.col("c")))
    return F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(own, "path"))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


CRC_SQL = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


def manifest_sql(columns: list[str], changed_text: str, table: str = "documents") -> str:
    """DuckDB SQL for the digest columns of `manifest`, with text found as `changed_text` (over columns and crc, the id's crc32)."""
    def leaf_sql(names: dict[str, str]) -> str:
        parts = [f"coalesce(strlen(CAST({names.get(c, c)} AS VARCHAR)) || ':' || CAST({names.get(c, c)} AS VARCHAR), '-')" for c in columns]
        return f"sha256({' || '.join(parts)})"

    sides = """SELECT a.level, a.source, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
                      coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
               FROM {nodes} a JOIN {nodes} b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.place // 16 = b.place // 16
               WHERE a.n > 1 GROUP BY ALL"""
    up = """SELECT level + 1, source, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM {nodes}
            WHERE n > 1 GROUP BY level, source, place // 16, n"""
    return f"""
    WITH RECURSIVE given AS (SELECT *, xor({CRC_SQL.format(text="coalesce(CAST(doc_id AS VARCHAR), '')")}, 4294967295) AS crc FROM {table}),
    found AS (SELECT *, {changed_text} AS found_text FROM given),
    leaves AS (SELECT doc_id, source, {leaf_sql({})} AS leaf, {leaf_sql({"text": "found_text"})} AS found FROM found),
    placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS place,
                      count(*) OVER (PARTITION BY source) AS n FROM leaves),
    nodes AS (SELECT 0 AS level, source, place, n, leaf AS digest FROM placed UNION ALL {up.format(nodes="nodes")}),
    tops AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
    over AS (SELECT 0 AS level, '' AS source, place, n, digest FROM tops UNION ALL {up.format(nodes="over")}),
    beside AS ({sides.format(nodes="nodes")}), above AS ({sides.format(nodes="over")}),
    walk AS (SELECT doc_id, source, leaf, 0 AS level, place, n, found AS folded, '' AS proof, row_number() OVER () AS row FROM placed
             UNION ALL
             SELECT w.doc_id, w.source, w.leaf, w.level + 1, w.place // 16, (w.n + 15) // 16, sha256(s.l || w.folded || s.r), w.proof || s.l || s.r, w.row
             FROM walk w JOIN beside s ON s.level = w.level AND s.source IS NOT DISTINCT FROM w.source AND s.place = w.place WHERE w.n > 1),
    rest AS (SELECT w.doc_id, w.leaf, t.digest AS subroot, 0 AS level, t.place, t.n, w.folded, w.proof, w.row
             FROM walk w JOIN tops t ON t.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
             UNION ALL
             SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.place // 16, (w.n + 15) // 16, sha256(s.l || w.folded || s.r), w.proof || s.l || s.r, w.row
             FROM rest w JOIN above s ON s.level = w.level AND s.place = w.place WHERE w.n > 1),
    top AS (SELECT digest AS root FROM over WHERE n = 1)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM rest, top WHERE n = 1"""
