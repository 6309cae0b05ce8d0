"""The training-data operators against brute force on small tables with NULLs, empty and long texts, copies and clashing columns."""
import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from rolecall.llm import components, crosspolytope, katz, licenses, mixing, packing, quality, queries, repeats, rollups, simhash, tokens, topk

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, part int, score double"


def texts():
    rng = np.random.default_rng(5)
    words = ["river", "stone", "Garden", "über", "lamp", "the", "of", "and", "naïve", "x1", "license", "mit"]
    line = " ".join(rng.choice(words, 60))
    out = [None, "", " ", "a", "one two", line, line, line + " end", "abc " * 120, "\0 z", "a  b \n c\n\n  d", "x <|endoftext|> y",
           "Released under the MIT License.\nfoo", "Licensed under CC BY-NC 4.0.", "gnu general public license", "Kİ apache license"]
    for i in range(30):
        own = " ".join(rng.choice(words, 80))
        out.append(own + " " + line + "\n" + " ".join(rng.choice(words, 20)))
    out.append(" ".join(rng.choice(words, 30_000)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 7 else None, t, [None, "en", "de"][i % 3], [None, "src0", "src1", "src12"][i % 4], 1, "clash", 1, 0.5) for i, t in enumerate(texts())]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def roots(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_repeats(docs):
    want, count = collections.Counter(), collections.Counter()
    data = [(i, t.encode()) for i, t in pairs(docs)]
    for _, b in data:
        count.update(b[s:s + 200] for s in range(len(b) - 199))
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if count[b[s:s + 200]] > 1:
                gone[s:s + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
                              for r in repeats.remove_repeats(docs).collect())
    assert got == want and sum(n for k, n in want.items() if k[2]) > 30


def test_simhash(docs):
    rows = simhash.near_duplicates(docs, words=3).collect()
    by = collections.Counter((r.doc_id, r.fingerprint) for r in rows)

    def fp(text):
        w = text.encode().lower().split()
        sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    own = [(i, fp(t)) for i, t in pairs(docs)]
    assert by == collections.Counter((i, f"{f:016x}") for i, f in own)
    root = roots(len(own), [(a, b) for a in range(len(own)) for b in range(a) if (own[a][1] ^ own[b][1]).bit_count() <= 3])
    least = {r: min((own[i][0] for i in range(len(own)) if root[i] == r and own[i][0] is not None), default=None) for r in set(root)}
    assert collections.Counter((r.doc_id, r.component_id) for r in rows) == collections.Counter((own[i][0], least[root[i]]) for i in range(len(own)))
    kept = simhash.keep_one(docs, 5, 8, 100, 42, 3)
    assert kept.columns == docs.columns and kept.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("tile", [16_000_000, 4000])
def test_pipeline_links_by_shingle_sets(spark, monkeypatch, tile):
    import corpus_pipeline

    monkeypatch.setattr(simhash, "TILE_BYTES", tile)
    rng, rows, number = np.random.default_rng(11), [], iter(range(10 ** 9))
    fresh = lambda n: [f"w{next(number)}" for _ in range(n)]
    for share in (0.62, 0.66, 0.7, 0.74, 0.78, 0.79, 0.81, 0.83, 0.85, 0.9):
        for _ in range(3):  # the first words stay: common / all of the shingles is about the share
            base = fresh(int(rng.integers(150, 300)))
            keep = math.ceil(2 * share / (1 + share) * len(base))
            rows += [base, base[:keep] + fresh(len(base) - keep)]
    line = fresh(8)
    for _ in range(4):  # a repeated line outweighs 100 own words, if repeats are counted
        rows.append(fresh(100) + line * 60)
    for _ in range(30):  # short texts: the last word differs; the same words; one word more
        base = fresh(8)
        rows += [base, base[:7] + fresh(1), base, fresh(2)]
        base = fresh(24)
        rows += [base, base + fresh(1)]
    base = fresh(60)
    rows += [base + fresh(1) for _ in range(40)] + [[], []]
    sets = [{" ".join(w[i:i + 5]) for i in range(len(w) - 4)} or set([" ".join(w)] if w else []) for w in rows]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, df, FOLDER).collect()} == set(root)


def test_close_pairs_with_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 20)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2 ** 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))} | {int(x) for x in rng.integers(0, 2 ** 62, 50)})
    found = simhash.links(spark.createDataFrame([(f"{f:016x}",) for f in fps], "fingerprint string"), 3, 4, 4)
    got = {r.node: r.root for r in components.components(found).collect()}
    root = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert all(got.get(f"{f:016x}", f"{f:016x}") == f"{fps[root[i]]:016x}" for i, f in enumerate(fps))


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_packing(docs):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs, PATH, window=256, unit=32).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in dict(pairs(docs)).items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        copies = sum(j == i for j, _ in pairs(docs))
        for r in by[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        cover = np.zeros(len(ids), int)
        for r in by[i]:
            cover[r.start:r.start + r.length] += 1
        assert (cover == copies).all()
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and at & (at - 1) == 0 and at == s[0].sequence_length


def test_encoder_equals_whole_texts():
    own = [t or "" for t in texts()] + ["don't we'll", " lead", "trail ", "tab\tx \t y", "a  b  c", "12 34 !! ?"]
    assert tokens.Encoder(PATH).encode(own) == [np.array(e.ids, "<u4").tobytes() for e in tokens.Encoder(PATH).tokenizer.encode_batch(own, add_special_tokens=False)]


def test_quality(spark, docs):
    folder = spark.read.parquet(f"{FOLDER}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/../sf0.01/labels.parquet")
    rows = {r.doc_id: r for r in quality.classify(folder, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in known if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(rows[i].predicted == known[i] for i in held) / len(held) > 0.93
    odd = spark.createDataFrame([(None, 1), (5, None), (6, 7), (8, 1)], "doc_id bigint, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, odd).collect())
    assert {r.score for r in quality.classify(docs, odd.limit(0)).collect()} == {0.5}


def test_mixing_and_licenses_equal_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    con.execute("create table d as select doc_id::bigint doc_id, text, lang, source from documents; drop view documents; alter table d rename to documents")
    con.execute("update documents set doc_id = null where isnan(doc_id::double)")
    plain = lambda rows: sorted((tuple(r) for r in rows), key=str)
    for df, sql in ((mixing.mix(docs.filter("doc_id is not null"), queries.domain(), queries.WEIGHTS, 0.5, 2, 7), queries.ORACLES["op5_mixing"].replace("FROM documents", "FROM documents WHERE doc_id IS NOT NULL")),
                    (licenses.scan_licenses(docs).drop("found"), queries.ORACLES["op9_licenses"])):
        want = con.execute(sql)
        names = [x[0] for x in want.description]
        assert plain(df.select(*names).collect()) == plain(want.fetchall())


WRAPPED = {  # statements as they stand in files, with the label they must get
    "bsd": "/*\r\n * Copyright (c) 2020 A. Person. All rights reserved.\r\n *\r\n * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that the following holds:\r\n */",
    "gpl-notice": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation.",
    "apache-2": "// Licensed under the Apache License,\n//\n// Version 2.0 (the \"License\");",
    "mit-text": "\tPermission is hereby granted, free of charge, to any\n\n\tperson obtaining a copy\n\tof this software and associated files",
    "mpl": "-- This Source Code Form is subject\r-- to the terms of the Mozilla Public\r-- License, v. 2.0."}


@pytest.mark.parametrize("before", [0, 5, 27, 28, 29, 55, 700])
def test_licenses_wrapped_over_lines(spark, before):
    rows = [(i, "word " * before + text, None, None, 1) for i, text in enumerate(WRAPPED.values())]
    apart = " ".join(w + " lamp river" for w in licenses.TEMPLATES[7][0].split())  # all the words, but in no run
    rows.append((9, apart, None, None, 1))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in licenses.scan_licenses(table).collect()}
    for i, label in enumerate(WRAPPED):
        assert label in got[i].labels.split(","), label
        words = re.findall("[a-z0-9]+", rows[i][1].lower())
        for f in got[i].found:
            run = f.run.split()
            assert words[f.at:f.at + len(run)] == run
            template = next(set(t.split()) for t, x in licenses.TEMPLATES if x == f.label)
            assert abs(len(template & set(run)) / len(template) - f.share) < 1e-12 and f.share >= 0.8 - 1e-9
    assert got[9].labels == "" and got[9].score == 0
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    want = con.execute(queries.ORACLES["op9_licenses"]).fetchall()
    names = [x[0] for x in con.description]
    assert sorted(map(str, want)) == sorted(str(tuple(got[r.doc_id][n] for n in names)) for r in got.values())


def test_keep_mixed_takes_what_mix_takes(docs):
    once = {(r.doc_id) for r in mixing.mix(docs, queries.domain(), queries.WEIGHTS, 0.6, 1, 3).collect()}
    kept = mixing.keep_mixed(docs, queries.domain(), queries.WEIGHTS, 0.6, 3)
    assert {r.doc_id for r in kept.collect()} == once and kept.columns == docs.columns


def test_katz(spark, docs):
    rows = katz.katz_scores(docs).collect()
    own = [(i, [*t.encode().lower().split(), b""]) for i, t in pairs(docs)]
    train = [w for i, w in own if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    c = collections.Counter(w for d in train for w in d)
    n, v = sum(c.values()), len(c)
    after = collections.defaultdict(collections.Counter)
    for d in train:
        for a, b in zip([b"\t", *d], d, strict=False):
            after[a][b] += 1
    of = collections.Counter(x for f in after.values() for x in f.values())
    d = katz.discounts([of[r] for r in range(1, 7)])
    p = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))

    def cond(a, b):
        f = after.get(a)
        if not f:
            return p(b)
        cut = {w: (d[r] if r <= 5 else 1) * r for w, r in f.items()}
        den = sum(f.values()) + (0 if sum(f.values()) - sum(cut.values()) > 1e-9 else 1)
        return cut[b] / den if b in cut else (1 - sum(cut.values()) / den) / (1 - sum(map(p, f))) * p(b)
    for a in list(after)[:5]:
        assert abs(sum(cond(a, w) for w in c) + cond(a, b"never seen") - 1) < 1e-9
    want = sorted((str(i), len(w), sum(x in c for x in w), round(sum(math.log10(p(x)) for x in w), 4),
                   round(sum(math.log10(cond(a, b)) for a, b in zip([b"\t", *w], w, strict=False)), 4)) for i, w in own)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in rows)
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3:] for x in got], [x[3:] for x in want], atol=1e-3)
    assert {r.train_tokens for r in rows} == {n}


def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 64))
    rows = []
    for i in range(400):
        x = base[i // 10 if i % 3 else 0]
        rows.append((i, (x + rng.normal(size=64) * np.linalg.norm(x) / 8 * rng.choice([0, 0.1, 0.18])).astype(np.float32).tolist(), i % 2, "clash"))
    rows += [(900, None, 0, ""), (901, [0.0] * 64, 0, ""), (902, [float("nan")] + [1.0] * 63, 0, ""), (903, [None] + [1.0] * 63, 0, ""), (904, rows[0][1], None, ""), (None, rows[0][1], 0, ""),
             (905, [], 0, ""), (906, [1.0, 2.0], 0, "")]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, key string")


def test_crosspolytope(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope, "HEAVY", 40)
    rows, df = vectors(spark)
    got = {r.vec_id: r for r in crosspolytope.near_vectors(df).collect()}
    x = np.array([r[1] for r in rows[:400]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.arange(400)[:, None] % 2 == np.arange(400) % 2)
    np.fill_diagonal(near, False)
    root = roots(400, zip(*np.nonzero(near), strict=True))
    assert near.sum() > 2000
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(400)] == [(near[i].sum(), root[i], root[i] == i) for i in range(400)]
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 907)) and not got[None].kept


def test_topk(spark):
    rows, df = vectors(spark)
    own = {i: np.floor(256 * np.array(e, np.float64)).astype(int) for i, e, _, _ in rows if i is not None and e is not None and None not in e and np.isfinite(e).all()}
    want = sorted((q, rank, i, s) for q in own if q % 50 == 0
                  for rank, (s, i) in enumerate(sorted(((int(own[q] @ own[i]), i) for i in own if i != q and len(own[i]) == len(own[q])), key=lambda x: (-x[0], x[1]))[:5], 1))
    assert sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()) == want


def test_topk_stops_on_proof():
    rng = np.random.default_rng(2)
    values = rng.integers(-90, 90, (3000, 32))
    order, ranked = topk.build(values)
    cuts, of = topk.segments(order)
    for q in values[:20]:
        near = topk.search(q, values, order, ranked, cuts, of, 5)
        assert set(np.argsort(-(values @ q), kind="stable")[:5]) <= set(near) and len(near) < 3000


def test_topk_stops_on_proof_when_segments_tie():
    rng = np.random.default_rng(4)
    for levels in (2, 3, 5):
        for _ in range(8):
            values = rng.integers(0, levels, (2000, 12)) * 40 - 40
            values[rng.choice(2000, 200, replace=False)] = values[0]
            order, ranked = topk.build(values)
            cuts, of = topk.segments(order)
            for q in values[:25] + rng.integers(-3, 4, (25, 12)):
                near, best = topk.search(q, values, order, ranked, cuts, of, 5), values @ q
                assert set(np.flatnonzero(best >= np.sort(best)[-5])) <= set(near)


def test_rollups(spark, tmp_path):
    columns = "doc_id bigint, op string, source string, lang string, tokenizer_version string, n_tokens bigint, seq int"
    table = rollups.Rollups(spark, str(tmp_path))
    batches = {1: [(1, "insert", "a", "en", "v1", 10, 0), (2, "insert", "a", None, "v1", 5, 0), (None, "insert", "a", "en", "v1", 3, 0), (3, "insert", "b", "en", "v1", None, 0), (4, "huh", "b", "en", "v1", 9, 0)],
               2: [(1, "revise", "a", "en", "v2", 12, 1), (1, "insert", "a", "en", "v1", 99, 0), (2, "delete", None, None, None, None, 0), (7, "delete", "a", "en", "v1", 4, 0), (8, "revise", "b", "en", "v1", 4, 0)], 3: []}
    table.commit(1, spark.createDataFrame(batches[1], columns), [])
    for number, before in ((2, [1]), (3, [1, 2]), (2, [1, 2, 3])):
        table.commit(number, spark.createDataFrame(batches[number], columns), before)
    got = {tuple(r) for r in table.totals([1, 2, 3]).collect()}
    assert got == {("a", "en", "v1", 1, 3), ("a", "en", "v2", 1, 12), ("b", "en", "v1", 2, 4)}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    for df in (repeats.remove_repeats(none), simhash.near_duplicates(none), packing.pack_documents(none, PATH), quality.classify(none, labels), mixing.mix(none, queries.domain(), queries.WEIGHTS),
               licenses.scan_licenses(none), katz.katz_scores(none), crosspolytope.near_vectors(vectors(spark)[1].limit(0)), topk.top_k(vectors(spark)[1].limit(0), vectors(spark)[1].limit(0))):
        assert df.collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.dtypes == docs.dtypes
        docs = spark.createDataFrame(after.collect(), after.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.agg(F.countDistinct("doc_id")).head()[0] == docs.count()
