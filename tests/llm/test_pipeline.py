"""The pipeline's stages: recall of the near-dedup search, and NULL, empty, repeated and clashing rows in each."""
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolecall.llm import exchange, simhash

FOLDER = "/root/testdata/sf0.001"
CLASHING = "kept string, spans int, n_bytes int, n_removed string, __domain string, __last int, key string, f0 int, fingerprint string"


@pytest.mark.parametrize("size", [10, 100, 1000])
def test_recall_at_the_limit(size):
    """Links at a similarity of 0.80 to 0.82: found if they share a band and differ in a quarter of the bits at most."""
    rng, width_bands, pairs = np.random.default_rng(size), simhash.bands_for(200_000, 0.8), []
    for _ in range(400):
        share = rng.uniform(0.80, 0.82)
        shared = int(np.ceil(share * size))
        own = size - shared
        common = rng.integers(0, 2 ** 64, shared, np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2 ** 64, k, np.uint64)]) for k in (own // 2, own - own // 2))
        assert shared >= 0.8 * (shared + own)
        pairs.append([np.frombuffer(simhash.set_fingerprint(x, simhash.LANES), ">u8").astype(np.uint64) for x in (a, b)])
    left, right = (np.stack(x) for x in zip(*pairs, strict=True))
    width, bands = width_bands
    shared = np.zeros(len(pairs), bool)
    for x, y in zip(simhash.band_cells(left, width, range(bands)), simhash.band_cells(right, width, range(bands)), strict=True):
        shared |= x == y
    found = shared & (np.bitwise_count(left ^ right).sum(axis=1) <= 16 * simhash.LANES)
    print(f"recall of {size} shingles at 0.80-0.82: {found.mean():.3f}")
    assert found.mean() >= 0.9


def test_band_cells_take_their_own_bits():
    fps = np.random.default_rng(0).integers(0, 2 ** 64, (50, 3), np.uint64)
    cells = list(simhash.band_cells(fps, 16, range(53)))
    assert len(cells) == 53 and all((c >> 16 == k).all() for k, c in enumerate(cells))
    again = list(simhash.band_cells(fps, 16, range(7, 9)))
    assert (again[0] == cells[7]).all() and (again[1] == cells[8]).all()
    flipped = fps ^ np.uint64(2 ** 64 - 1)
    assert all(((a ^ b) & 0xFFFF == 0xFFFF).all() for a, b in zip(cells, simhash.band_cells(flipped, 16, range(53)), strict=True))


def test_first_shared_band():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2 ** 64, (300, 3), np.uint64)
    b = a.copy()
    for row in b:
        for bit in rng.choice(192, 25, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    same = np.stack([x == y for x, y in zip(simhash.band_cells(a, 16, range(53)), simhash.band_cells(b, 16, range(53)), strict=True)])
    assert (simhash.first_shared_band(a, b, 16, 53) == np.where(same.any(axis=0), same.argmax(axis=0), 53)).all()


@pytest.mark.parametrize("heavy", [16, 4096])
def test_heavy_cells_are_cut_and_lose_nothing(spark, monkeypatch, heavy):
    """Many fingerprints near one another, in tiles or not: all of them are one component, by few links."""
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2 ** 64, 3, np.uint64)
    fps = [base.copy() for _ in range(150)]
    for f in fps:
        for bit in rng.integers(0, 192, 12):
            f[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    fps = np.unique(np.stack(fps), axis=0)
    df = spark.createDataFrame([tuple(map(int, f.view(np.int64))) for f in fps], "f0 bigint, f1 bigint, f2 bigint").repartition(3)
    from rolecall.llm.components import components
    links = simhash.candidate_links(df, 0.8, 48).cache()
    assert heavy < 4096 or links.count() < 12 * len(fps)
    found = components(links)
    assert found.count() == len(fps) and found.select("root").distinct().count() == 1


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "short text", "short text"] + [" ".join(rng.choice(words, 90)) for _ in range(40)]
    texts += [texts[10] + " end", texts[11] + " " + texts[12], "x" * 50_000]
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"
    data = [(None if i == 30 else 2 ** 55 + i, t, [None, "en"][i % 2], [None, "src0", "src1"][i % 3], 0, "mine", 1, 2, "own", "d", 3, "k", 4, "f") for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, data[20], data[20]], schema).repartition(3).cache()


def written(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def test_stages_keep_columns_and_take_any_row(spark, rows):
    docs = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for given in (rows, docs):
            after = written(spark, stage(spark, given, FOLDER))
            assert after.dtypes == rows.dtypes
            if after.count():
                own = [c.split()[0] for c in CLASHING.split(", ")]
                assert [tuple(r) for r in after.select(*own).distinct().collect()] == [("mine", 1, 2, "own", "d", 3, "k", 4, "f")]
            assert after.filter("doc_id is not null").join(rows, "doc_id", "left_anti").count() == 0
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.groupBy().agg(F.count("*")).head()[0] >= docs.count()


def test_stages_take_an_empty_table(spark, rows):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), FOLDER).count() == 0


def test_near_dedup_keeps_one_of_equal_ids_and_rows_without_id(spark, rows):
    kept = simhash.keep_similar(rows, 5, 0.8).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(None) == 1 and len(set(ids)) == len(ids)
    known = {r.doc_id - 2 ** 55: r.text for r in kept if r.doc_id is not None}
    assert 0 in known and 1 not in known and 3 in known and 4 not in known and 45 not in known and 10 in known and 46 in known


def test_dropping_scratch_keeps_results(spark):
    exchange.drop_scratch(spark)
    scratch, kept = exchange.stored(spark.range(3).toDF("a"), "scratch"), exchange.stored(spark.range(4).toDF("a"), "result", scratch=False)
    place = scratch.inputFiles()[0].rsplit("/", 1)[0]
    exchange.drop_scratch(spark)
    assert kept.count() == 4 and not exchange._SCRATCH
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(place)
