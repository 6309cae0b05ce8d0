"""SimHash near-duplicate detection with pivot distance tables, on request verified by shingle sets."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.keyed import with_known_size
from .components import components
from .exchange import give_back, giving_back, prepare, stored

HEAVY = 4096
TILE_BYTES = 16_000_000
TILE_SETS = 16_384                 # sets compared in one task, if they are not too long together
PIVOTS = 12
LANES = 3                          # fingerprints of sets have 192 bits
FIELDS = [f"f{i}" for i in range(LANES)]
PER_BUCKET = 512                   # unrelated rows a band value holds, about, at most
MAX_IDS = 1_000_000                # ids, 8 bytes each, that are broadcast
LANE_STEP = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprint(text: str | None, words: int, lanes: int = 1, block: int = 65_536) -> bytes:
    """Big-endian fingerprint of 64 bits per lane; a bit is 1 if set in over half the shingles' hashes."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return bytes(8 * lanes)
    n = max(1, len(tokens) - words + 1)
    counts = np.zeros(64 * lanes, np.int64)
    for start in range(0, n, block):
        stop = min(n, start + block)
        spread = [tokens[start + i:stop + i] for i in range(words)] if len(tokens) >= words else [tokens]
        shingles = map(b" ".join, zip(*spread, strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, stop - start)
        for lane in range(lanes):
            x = h if lane == 0 else _mix(h + np.uint64(LANE_STEP * lane & 0xFFFFFFFFFFFFFFFF))
            counts[64 * lane:64 * lane + 64] += np.unpackbits(x.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(docs: DataFrame, words: int = 5, lanes: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint hex) of every document; NULL text is empty text, whose fingerprint is zero."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in giving_back(frames):
            yield pd.DataFrame({"doc_id": f["doc_id"], "fingerprint": [fingerprint(t, words, lanes).hex() for t in f["text"]]})

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInPandas(run, f"doc_id {kind}, fingerprint string")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a text of fewer words is one shingle, one without words has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(min(len(tokens), 1), len(tokens) - words + 1)
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)][:n]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, n))


def set_fingerprint(hashes: np.ndarray, lanes: int, block: int = 65_536) -> bytes:
    """The fingerprint of a set of shingle hashes, each counted once."""
    counts = np.zeros(64 * lanes, np.int64)
    for start in range(0, len(hashes), block):
        h = hashes[start:start + block]
        for lane in range(lanes):
            x = h if lane == 0 else _mix(h + np.uint64(LANE_STEP * lane & 0xFFFFFFFFFFFFFFFF))
            counts[64 * lane:64 * lane + 64] += np.unpackbits(x.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(key, hashes) of every document: its set of shingle hashes; equal sets have equal keys (128 bits)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in giving_back(frames):
            for at in range(0, len(f), 100):
                blobs = [shingle_set(t, words).tobytes() for t in f["text"].iloc[at:at + 100]]
                yield pd.DataFrame({"key": [xxhash.xxh3_128_hexdigest(b) for b in blobs], "hashes": blobs})

    return docs.select("text").mapInPandas(run, "key string, hashes binary")


def set_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, known, key, f0, f1, f2) of every document: the key of its shingle set and the set's fingerprint of LANES * 64 bits.

    A NULL id is 0 and not known: pandas would turn the other ids into floating point.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in giving_back(frames):
            for at in range(0, len(f), 100):
                part = f.iloc[at:at + 100]
                sets = [shingle_set(t, words) for t in part["text"]]
                bits = np.frombuffer(b"".join(set_fingerprint(x, LANES) for x in sets), ">u8").astype(np.uint64).view(np.int64).reshape(-1, LANES)
                yield pd.DataFrame({"doc_id": part["doc_id"], "known": part["known"], "key": [xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets],
                                    **{f"f{i}": bits[:, i] for i in range(LANES)}})

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select(F.coalesce("doc_id", F.lit(0).cast(kind)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
    return source.mapInPandas(run, f"doc_id {kind}, known boolean, key string, {', '.join(f'{f} bigint' for f in FIELDS)}")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values).sum(axis=1, dtype=np.int32) if values.ndim > 1 else np.bitwise_count(values).astype(np.int32)


def _pivots(lanes: int) -> np.ndarray:
    return np.random.default_rng(2024).integers(0, 2 ** 64, (PIVOTS, lanes), np.uint64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of 0..n-1 by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def close_pairs(fps: np.ndarray, cell: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell that differ in at most `most` bits.

    `fps` is (n, lanes), `cell` is sorted. The distances to the reference fingerprints are computed once per row; a
    pair is dropped as soon as one coordinate differs by more than `most` (triangle inequality), and only survivors
    are compared bit by bit.
    """
    table = np.stack([_bits(fps ^ p) for p in _pivots(fps.shape[1])], axis=1).astype(np.int16)
    order = np.lexsort((table[:, 0], cell))  # by the first coordinate, so that a run of partners ends early
    cell, fps, table = cell[order], fps[order], table[order]
    active, step, left, right = np.arange(len(cell)), 0, [], []
    while len(active):
        step += 1
        active = active[active + step < len(cell)]
        active = active[(cell[active] == cell[active + step]) & (table[active + step, 0] - table[active, 0] <= most)]
        near = active
        for k in range(1, table.shape[1]):
            near = near[np.abs(table[near, k] - table[near + step, k]) <= most]
        near = near[_bits(fps[near] ^ fps[near + step]) <= most]
        left.append(near)
        right.append(near + step)
        if step % 64 == 0:  # what is already linked need not be listed pair by pair
            left, right = _spanning(len(cell), left, right)
    left, right = _spanning(len(cell), left, right)
    return order[left[0]], order[right[0]]


def _spanning(n: int, left: list, right: list) -> tuple[list, list]:
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    root = _roots(n, a, b)
    at = np.flatnonzero(root != np.arange(n))
    return [root[at]], [at]


def links(distinct: DataFrame, most: int, bands: int, digits: int, per_group: int = 40_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly those within `most` bits which share a band.

    A band is `digits` hex digits. With bands > most, every pair within `most` bits shares one (an exact search). A band
    value held by more than HEAVY fingerprints is cut into tiles, and pairs of tiles are compared by different tasks;
    nothing is left out. Within a cell only a spanning forest of the links is returned, so the output is linear.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * bands // per_group + 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                      lambda i: F.struct(i.alias("band"), F.substr(F.col("fingerprint"), i * digits + 1, F.lit(digits)).alias("value")))
    rows = distinct.select(F.unhex("fingerprint").alias("fp"), F.inline(cut))
    heavy = (rows.groupBy("band", "value").count().filter(F.col("count") > HEAVY)
             .select("band", "value", F.ceil(F.col("count") / HEAVY).cast("int").alias("tiles")))
    heavy = with_known_size(stored(heavy, "heavy"))
    tile = F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))
    tiled = (rows.join(heavy, ["band", "value"], "left").withColumn("tile", tile).withColumn("other", other)
             .select("fp", F.xxhash64("band", "value", F.least("tile", "other"), F.greatest("tile", "other")).alias("cell")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        give_back()
        cell, fps = group["cell"].to_numpy(), group["fp"].to_numpy()
        lanes = np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(group), -1)
        order = np.argsort(cell, kind="stable")
        a, b = close_pairs(lanes[order], cell[order], most)
        return pd.DataFrame({"a": [fps[i].hex() for i in order[a]], "b": [fps[i].hex() for i in order[b]]}, columns=["a", "b"]).astype("object")

    return tiled.groupBy(F.pmod("cell", F.lit(groups)).alias("g")).applyInPandas(compare, "a string, b string")


def near_duplicates(docs: DataFrame, words: int = 5, lanes: int = 1, most: int = 3, bands: int = 4, digits: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id (smallest doc_id reachable over fingerprints within `most` bits).

    Defined results: NULL or empty text has fingerprint zero and links like any other; repeated rows each get a row; a
    NULL doc_id gets its group's component_id (NULL if the group has no id); an empty table gives no rows; further
    columns are ignored. Copies share a fingerprint and are compared once.
    """
    prepare(docs.sparkSession)
    table = stored(fingerprints(docs, words, lanes), "fingerprints")
    distinct = stored(table.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "distinct")
    found = components(links(distinct.select("fingerprint"), most, bands, digits), "simhash")
    roots = distinct.join(found, distinct.fingerprint == found.node, "left").select("fingerprint", "low", F.coalesce("root", "fingerprint").alias("root"))
    roots = stored(roots, "roots")
    least = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = roots.join(least, "root").select("fingerprint", "component_id")
    return table.join(ids, "fingerprint").select("doc_id", "fingerprint", "component_id")


def similar_pairs(fps: np.ndarray, sets: list[np.ndarray], most: int, similarity: float) -> list[tuple[int, int]]:
    """Links between rows that connect exactly those within `most` bits whose sets have the Jaccard similarity.

    Rows already connected are not compared again, so a group of copies takes one comparison a row.
    """
    sizes, label, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    for i in range(len(sets)):
        near = np.flatnonzero(label[i + 1:] != label[i]) + i + 1
        near = near[np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i]) - 1e-9]
        near = near[_bits(fps[near] ^ fps[i]) <= most]
        for j in near:
            if label[i] != label[j] and sizes[i] and sizes[j]:
                a, b = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
                common = int((b[np.searchsorted(b, a).clip(max=len(b) - 1)] == a).sum())
                if common >= similarity * (len(a) + len(b) - common) - 1e-9:
                    out.append((i, int(j)))
                    label[label == label[j]] = label[i]
    return out


def verified_links(members: DataFrame, most: int, similarity: float) -> DataFrame:
    """Edges (a, b) between the keys of `members` (key, fingerprint, hashes, root) of one root that have the similarity.

    A root with many or long sets is cut into tiles, and pairs of tiles are compared by different tasks.
    """
    spark = members.sparkSession
    size = F.octet_length("hashes")
    total = members.agg(F.coalesce(F.sum(size), F.lit(0))).head()[0]
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TILE_BYTES + 1)
    needed = F.ceil(F.greatest(F.count("*") / TILE_SETS, F.sum(size) / TILE_BYTES)).cast("int")
    heavy = members.groupBy("root").agg(needed.alias("tiles")).filter("tiles > 1")
    heavy = with_known_size(stored(heavy, "heavy"))
    tile = F.pmod(F.xxhash64("key"), F.coalesce("tiles", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))
    tiled = (members.join(heavy, "root", "left").withColumn("tile", tile).withColumn("other", other)
             .select("key", F.unhex("fingerprint").alias("fp"), "hashes", F.xxhash64("root", F.least("tile", "other"), F.greatest("tile", "other")).alias("cell")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        give_back()
        a, b = [], []
        for _, f in group.groupby("cell", sort=False):
            keys, lanes = f["key"].to_numpy(), np.frombuffer(b"".join(f["fp"]), ">u8").astype(np.uint64).reshape(len(f), -1)
            for i, j in similar_pairs(lanes, [np.frombuffer(x, np.uint64) for x in f["hashes"]], most, similarity):
                a.append(keys[i])
                b.append(keys[j])
        return pd.DataFrame({"a": a, "b": b}, columns=["a", "b"]).astype("object")

    return tiled.groupBy(F.pmod("cell", F.lit(groups)).alias("g")).applyInPandas(compare, "a string, b string")


def bands_for(n: int, similarity: float, recall: float = 0.98) -> tuple[int, int]:
    """(width, number) of the bands for n fingerprints: sets of that similarity share one with about that chance.

    The width grows with the number of rows, so that a band value is held by about PER_BUCKET unrelated rows at most; the
    number of bands grows as the width asks for it. A bit differs with the angle between the sets, as vectors, over pi.
    """
    width = max(16, math.ceil(math.log2(max(n, 1) / PER_BUCKET)))
    agree = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** width
    return width, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def band_cells(fps: np.ndarray, width: int, bands: range) -> Iterator[np.ndarray]:
    """Values of each band for all rows, the band's number above its bits; a band reads `width` bits drawn by a fixed seed."""
    bits = np.ascontiguousarray(np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1).T)
    for k in bands:
        value = np.full(len(fps), k, np.int64)
        for at in _band_bits(k, len(bits), width):
            value = value << np.int64(1) | bits[at]
        yield value


def _band_bits(band: int, bits: int, width: int) -> np.ndarray:
    return np.random.default_rng((77, band)).choice(bits, width, replace=False)


def first_shared_band(a: np.ndarray, b: np.ndarray, width: int, bands: int) -> np.ndarray:
    """The first band in which two rows of fingerprints have the same value; `bands` if there is none."""
    out, differ = np.full(len(a), bands), a ^ b
    for k in reversed(range(bands)):
        mask = np.zeros(64 * a.shape[1], np.uint8)
        mask[_band_bits(k, len(mask), width)] = 1
        lanes = np.packbits(mask).view(">u8").astype(np.uint64)
        out[((differ & lanes) == 0).all(axis=1)] = k
    return out


def _lanes(frame: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(frame[FIELDS].to_numpy(np.int64)).view(np.uint64)


def candidate_links(distinct: DataFrame, similarity: float, most: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (f0, f1, f2) of at most `most` differing bits that share a band; a, b are their hex.

    A row in the shuffle is a band value and the fingerprint. Band values that many rows hold are cut into tiles, and pairs of
    tiles are compared by different tasks (their cells are negative numbers). Such values are known beforehand: one with more than HEAVY rows has more
    than HEAVY over the number of tasks in at least one task, so only such counts are sent. Two rows that share several
    bands are linked in the first of them; a link between them in a later one says nothing new and is left out.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    width, bands = bands_for(n, similarity)
    tasks = max(1, distinct.rdd.getNumPartitions())
    floor = max(2, HEAVY // tasks)

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in giving_back(frames):
            for value in band_cells(_lanes(f), width, range(bands)):
                yield pd.DataFrame({"cell": value, **{c: f[c] for c in FIELDS}})

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [_lanes(f) for f in frames]
        if held:
            for value in band_cells(np.concatenate(held), width, range(bands)):
                cell, many = np.unique(value, return_counts=True)
                yield pd.DataFrame({"cell": cell[many >= floor], "n": many[many >= floor]})

    heavy = distinct.mapInPandas(counts, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") + tasks * (floor - 1) > HEAVY)
    heavy = with_known_size(stored(heavy.select("cell", F.ceil((F.col("n") + tasks * (floor - 1)) / HEAVY).cast("int").alias("tiles")), "heavy"))
    rows = distinct.mapInPandas(cells, f"cell bigint, {', '.join(f'{f} bigint' for f in FIELDS)}")
    tile = F.pmod(F.xxhash64(*FIELDS), F.coalesce("tiles", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    tiled = (rows.join(heavy, "cell", "left").withColumn("tile", tile).withColumn("other", other)
             .select(*FIELDS, F.when(F.col("tiles").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", low, high).bitwiseOR(F.lit(-2 ** 63))).alias("cell")))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * bands // 400_000 + 1)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        give_back()
        cell, fps = group["cell"].to_numpy(), _lanes(group)
        order = np.argsort(cell, kind="stable")
        cell, fps = cell[order], fps[order]
        same = cell[1:] == cell[:-1]  # rows alone in their cell have nothing to compare with
        shared = np.append(same, False) | np.append(False, same)
        cell, fps = cell[shared], fps[shared]
        a, b = to_smallest(fps, *close_pairs(fps, cell, most))
        near = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1) <= most
        new = (cell[b] < 0) | ~near | (first_shared_band(fps[a], fps[b], width, bands) == cell[b] >> np.int64(width))
        a, b = a[new], b[new]
        name = lambda at: [x.tobytes().hex() for x in fps[at].astype(">u8")]
        return pd.DataFrame({"a": name(a), "b": name(b)}, columns=["a", "b"]).astype("object")

    return tiled.groupBy(F.pmod(F.xxhash64("cell"), F.lit(groups)).alias("g")).applyInPandas(compare, "a string, b string")


def to_smallest(fps: np.ndarray, root: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with every row linked to its component's smallest fingerprint.

    Cells of different bands hold different members of a large group, but the small ones recur, so most bands repeat the
    same links and a group's links stay few.
    """
    place = np.empty(len(fps), np.int64)
    place[np.lexsort(fps.T[::-1])] = np.arange(len(fps))
    row_at = np.empty(len(fps), np.int64)
    row_at[place] = np.arange(len(fps))
    best = place.copy()
    np.minimum.at(best, root, place[member])
    a, b = np.concatenate([best[root], best[root]]), np.concatenate([place[member], place[root]])
    pairs = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
    return row_at[pairs[:, 0]], row_at[pairs[:, 1]]


def similar_documents(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, component_id) of every document: documents whose sets of distinct shingles have the Jaccard similarity are linked.

    Fingerprints only find candidates: those of distinct sets that share a band and differ in a quarter of their bits at
    most (see bands_for for the share of links found). The sets of the candidates' groups are then made again from their
    texts and compared, and components are built of the pairs that reach the similarity. Texts without words are linked
    with each other; other defined results are those of near_duplicates.
    """
    prepare(docs.sparkSession)
    most = 16 * LANES
    table = stored(set_fingerprints(docs, words), "sets")
    own_id = F.when(F.col("known"), F.col("doc_id"))
    distinct = stored(table.groupBy("key", *FIELDS).agg(F.min(own_id).alias("low")), "distinct")
    name = F.concat(*[F.lower(F.lpad(F.hex(f), 16, "0")) for f in FIELDS])
    found = components(candidate_links(stored(distinct.select(*FIELDS).distinct(), "fingerprints"), similarity, most), "simhash")
    rooted = distinct.withColumn("fingerprint", name).join(found, F.col("fingerprint") == found.node, "left")
    rooted = stored(rooted.select("key", "low", "fingerprint", F.coalesce("root", "fingerprint").alias("root")), "candidates")
    several = rooted.groupBy("root").count().filter("count > 1").select("root")
    wanted = stored(rooted.join(several, "root"), "wanted")
    # the sets of one document for each key; only ids are sent to the texts, up to a size
    ids = with_known_size(stored(wanted.filter("low is not null").select(F.col("low").alias("doc_id")).distinct(), "ids"), MAX_IDS)
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    if wanted.filter("low is null").head(1):
        texts = texts.unionByName(docs.select("doc_id", "text").filter("doc_id is null"))
    sets = shingle_sets(texts, words).groupBy("key").agg(F.first("hashes").alias("hashes"))
    members = stored(sets.join(wanted.select("key", "fingerprint", "root"), "key"), "members")
    same = components(verified_links(members, most, similarity), "similar")
    roots = stored(distinct.join(same, distinct.key == same.node, "left").select("key", "low", F.coalesce("root", "key").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    own = table.select(own_id.alias("doc_id"), "key")
    return own.join(roots.join(least, "root").select("key", "component_id"), "key").select("doc_id", "component_id")


def keep_similar(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The rows of docs whose id is the smallest of its group of similar_documents, all columns kept, one row for each such id.

    Defined results: rows with a NULL doc_id cannot be told apart and stay; of rows with equal ids that all stay, one
    does; texts without words are one group; an empty table gives no rows; further columns may have any name. The ids to
    drop are sent to the rows up to MAX_IDS of them (8 bytes each); beyond, both are shuffled by id.
    """
    groups = similar_documents(docs, words, similarity).filter("doc_id is not null")
    counts = stored(groups.groupBy("doc_id").agg(F.sum((F.col("doc_id") == F.col("component_id")).cast("int")).alias("n")), "groups")
    dropped = with_known_size(counts.filter("n = 0").select("doc_id"), MAX_IDS)
    kept = docs.join(dropped, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    if counts.filter("n > 1").head(1):
        kept = kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null"))
    return kept


def keep_one(docs: DataFrame, words: int, lanes: int, most: int, bands: int, digits: int) -> DataFrame:
    """The rows of docs whose id is the smallest of its near-duplicate group, all columns kept, one row for each such id.

    Groups are those of near_duplicates. Rows with a NULL doc_id cannot be told apart and stay.
    """
    groups = stored(near_duplicates(docs, words, lanes, most, bands, digits), "groups")
    first = groups.filter("doc_id = component_id").groupBy("doc_id").count()
    kept = docs.join(first.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if first.filter("count > 1").head(1):
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id is null"))
