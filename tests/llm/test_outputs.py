"""Id files, Merkle manifest and fill-in-middle against brute force on small tables."""
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolecall.llm import fim, idfiles, merkle, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]
# extra columns carry the names the operators use themselves
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, low bigint, tree string, digest string, part int, path string"


def texts():
    rng = np.random.default_rng(9)
    words = ["river", "STONE", "Garden", "über", "don't", "naïve", "x1", "日本", "éte", "a b", "a\x1cb", "ΣΑΣ", "İ"]
    out = [None, "", " ", "a", "\n\t x  y ", "in <|endoftext|> out", "x<|startoftext|>y", "<P> stays", "a<S", "S>b", "<", "same", "same"]
    out += [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 300, 60)]
    out.append(" ".join(rng.choice(words, 40_000)))
    out.append("<" * 5000)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    big = 2 ** 60  # ids that floating point cannot hold
    rows = [(None if i == 9 else big + i * 7 % 50 if i % 5 == 4 else -i if i % 11 == 3 else i, t, [None, "en", "de"][i % 3],
             [None, "src0", "a", "src0", "é", "", "src0"][i % 7], None if i % 13 == 0 else i, 1, "t", "d", 3, "p") for i, t in enumerate(texts())]
    rows += [rows[20]] * 40 + [(None, "t", None, "only one", 1, 1, "t", "d", 3, "p")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def given(docs):
    return [r.asDict() for r in docs.select(*LEAF).collect()]


def first_null(value):
    return (value is not None, value if value is not None else 0)


def test_word_encoder_equals_the_tokenizer():
    plain = Tokenizer.from_file(PATH)
    for t, got in zip(texts(), tokens.WordEncoder.of(PATH).encode(texts()), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids


LATIN = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))
PLAIN_WORDS = [*LATIN, LATIN, *(f"{c}a{c}{m}" for c, m in zip(LATIN, "!#$%&()*+,-./:;=?@[]^_{|}~" * 9, strict=False)),
               "it's", "don't.", "we'll...", "a.b", "x<y>", "end.\"", "µ", "ªº", "12", "a1", "²", "ſ", "K", "é", "&&&", "%%%a"]


@pytest.mark.parametrize("kind, name", [(tokens.Encoder, "byte_bpe_50k.json"), (tokens.WordEncoder, "word_bpe_49k.json")])
def test_plain_words_are_asked_of_the_model(kind, name):
    encoder = kind(public_tokenizers.path(name))
    own = [" ".join(PLAIN_WORDS), *PLAIN_WORDS, *(f"a {w} {w}" for w in PLAIN_WORDS), "\n".join(PLAIN_WORDS)]
    assert encoder.encode(own) == encoder._ids(own)
    assert encoder._plain.fullmatch("word") and encoder._plain.fullmatch("éß,")


def asked(encoder, monkeypatch):
    """Lists that fill with what the encoder asks of the model, and with the texts it hands to the tokenizer."""
    units, made = [], []
    ask, make = encoder._units, encoder._ids
    monkeypatch.setattr(encoder, "_units", lambda unit: units.append(unit) or ask(unit))
    monkeypatch.setattr(encoder, "_ids", lambda texts: made.extend(texts) or make(texts))
    return units, made


def test_latin_words_are_lower_cased_before_they_are_looked_up(monkeypatch):
    encoder = tokens.WordEncoder(PATH)
    units, made = asked(encoder, monkeypatch)
    own = ["straße Ünder STRASSE Straße, ÉTÉ", "River Été ÜNDER. straße River."]
    got = encoder.encode(own)
    assert not made and {"strasse", "river", "."} < set(units)
    assert got == encoder._ids(own)
    units.clear(), made.clear()
    encoder.encode(["STRASSE... under été; river ünder, RIVER"])  # letters met before, with other marks behind them
    assert not made and sorted(units) == ["...", ";", "under"]


def test_words_met_before_are_not_encoded_again(monkeypatch):
    encoder = tokens.WordEncoder(PATH)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = [" ".join(f"{a}{b}{c}{d}" for b in letters for c in letters for d in letters) for a in letters[:14]]  # 246,064 words
    before = [encoder.encode([t])[0] for t in own]
    units, made = asked(encoder, monkeypatch)
    assert [encoder.encode([t])[0] for t in own] == before
    assert not units and not made


@pytest.mark.parametrize("size, known", [(1, 600_000), (50, 20), (4_000_000, 0)])
def test_slices_and_forgotten_words_change_no_ids(monkeypatch, size, known):
    monkeypatch.setattr(tokens, "SLICE_CHARS", size)
    monkeypatch.setattr(tokens, "KNOWN_WORDS", known)
    encoder = tokens.WordEncoder(PATH)
    # white space of every kind, cases that change with their neighbours, marks that join the letter before, names in capitals
    odd = [f"Ab{c}Cd {c} e{c}" for c in "\t\n\v\f\r\x00\x1c\x1f\x85\xa0\xad\u1680\u180e\u2003\u2028\u3000\ufeffΣİẞ\u0301ǅ\u212a\U0001f600"]
    odd += ["x <|ENDOFTEXT|> y", "Ü <|ENDOFTEXT|>", "日 <|EndOfText|>", "<|endoftext|> Ü", "e\u0301 E\u0301", "ΑΣ ΑΣ."]
    own = [*texts(), *odd, *PLAIN_WORDS]
    assert encoder.encode(own) == [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch([t or "" for t in own], add_special_tokens=False)]
    assert encoder.encode([]) == [] and encoder.encode([None, "", " "]) == [b""] * 3


def test_ranks_code_one_to_four_bytes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1001):
        ranks = (rng.integers(0, 2 ** 32, n) >> rng.integers(0, 32, n)).astype("<u4")
        control, data = idfiles.encode_ranks(ranks)
        assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(r).bit_length() // 8)) for r in ranks)
        left = [data]

        def read(size, left=left):
            out, left[0] = left[0][:size], left[0][size:]
            return out
        assert (idfiles.decode_ranks(np.frombuffer(control, np.uint8), n, read) == ranks).all()


@pytest.mark.parametrize("limit", [16_000_000, 3000])
def test_id_files(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(idfiles, "FILE_IDS", limit)
    monkeypatch.setattr(idfiles, "SLICE", 64)
    plain = Tokenizer.from_file(PATH)
    ids = {t: plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts() + ["t"]}
    written = idfiles.write_ids(docs, PATH)
    got = sorted(idfiles.read_ids(written).collect(), key=lambda r: r.start)
    at, want = 0, sorted(given(docs), key=lambda r: first_null(r["doc_id"]))
    assert len(got) == len(want)
    for r, w in zip(got, want, strict=True):
        assert r.doc_id == w["doc_id"] and r.start == at
        at += r.n_tokens
    crc = lambda i: zlib.crc32(np.array(i, "<u4").tobytes())
    assert sorted((first_null(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((first_null(w["doc_id"]), len(ids[w["text"]]), crc(ids[w["text"]])) for w in want)
    counts = spark.read.parquet(f"{written.folder}/ranks").orderBy("rank").collect()
    flat = np.concatenate([ids[w["text"]] for w in want])
    assert [(r.id, r["count"]) for r in counts] == sorted(((int(i), int(n)) for i, n in zip(*np.unique(flat, return_counts=True), strict=True)), key=lambda x: (-x[1], x[0]))
    if limit < 10_000:
        assert written.files.groupBy("part").count().agg(F.max("count")).head()[0] > 1
    again = idfiles.open_ids(spark, written.folder)
    assert idfiles.read_ids(again).agg(F.sum("n_tokens")).head()[0] == at == len(flat)


def test_id_files_of_nothing(spark, docs):
    written = idfiles.write_ids(docs.limit(0), PATH)
    assert written.files.count() == 0 and idfiles.read_ids(written).count() == 0 and len(written.ids) == 0


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def beside(levels, place):
    for level in levels[:-1]:
        run = place // 16 * 16
        yield level[run:place], level[place + 1:run + 16]
        place //= 16


def test_merkle(docs):
    def leaf(r):
        values = ["-" if r[c] is None else str(r[c]) for c in LEAF]
        return sha(*[v if r[c] is None else f"{len(v.encode())}:{v}" for v, c in zip(values, LEAF, strict=True)])

    rows, by = given(docs), {}
    for r in rows:
        by.setdefault(r["source"], []).append((first_null(r["doc_id"]), leaf(r), leaf({**r, "text": ("x" if r["text"] is None else r["text"]).upper()}), r["doc_id"]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[1] for x in sorted(by[s])]) for s in order}
    over = levels_of([trees[s][-1][0] for s in order])
    want = []
    for k, s in enumerate(order):
        for place, (_, own, found, doc_id) in enumerate(sorted(by[s])):
            path = [*beside(trees[s], place), *beside(over, k)]
            folded = found
            for left, right in path:
                folded = sha(*left, folded, *right)
            proof = sha(*[x for left, right in path for x in left + right])
            want.append((first_null(doc_id), own, trees[s][-1][0], over[-1][0], proof, folded, folded == over[-1][0]))
    changed = {"text": F.upper(F.coalesce(F.col("text"), F.lit("x")))}
    got = merkle.manifest(docs, LEAF, changed).withColumn("proof", merkle.proof(F.col("path"))).collect()
    assert sorted((first_null(r.doc_id), r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in got) == sorted(want)
    assert {r.verified for r in got} == {True, False} and max(len(t) for t in trees.values()) > 2
    assert all(r.verified for r in merkle.manifest(docs, LEAF).collect())


def test_merkle_of_nothing_and_of_one(spark, docs):
    assert merkle.manifest(docs.limit(0), LEAF).count() == 0
    one = merkle.manifest(docs.limit(1), LEAF).head()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.path == [] and one.verified


def test_merkle_ranks_are_spread_over_ranges(spark):
    """A source that holds everything, and copies of one row, are cut into many ranges."""
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, F.col("id")).otherwise(7).alias("id"), F.lit("s").alias("tree"))
    placed = merkle.ranked(rows, "tree", ["id"])
    assert [r.low for r in placed.orderBy("low").collect()] == list(range(3000))
    assert placed.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).head()[0] < 2000


def reference_fim(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("piece", [16_384, 1, 7])
def test_fim(docs, monkeypatch, piece):
    monkeypatch.setattr(fim, "PIECE", piece)
    if piece < 10:
        docs = docs.filter("length(text) < 1500 or text is null")
    want = []
    for r in given(docs):
        text = r["text"] or ""
        want.append((first_null(r["doc_id"]), len(text), *reference_fim(r["doc_id"], text), hashlib.sha256(text.encode()).hexdigest()))
    some = lambda x: -1 if x is None else x
    key = lambda form, p, m: (form, some(p), some(m))
    got = fim.transform_digests(docs).collect()
    assert (sorted((first_null(r.doc_id), r.n, *key(r.form, r.prefix_chars, r.middle_chars), r.output_sha256, r.restored_sha256) for r in got)
            == sorted((d, n, *key(form, p, m), hashlib.sha256(out.encode()).hexdigest(), sha) for d, n, form, p, m, out, sha in want))
    texts_out = fim.transform(docs).collect()
    assert sorted((first_null(r.doc_id), r.form, r.output) for r in texts_out) == sorted((d, form, out) for d, _, form, _, _, out, _ in want)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_of_nothing(docs):
    assert fim.transform_digests(docs.limit(0)).count() == 0 and fim.transform(docs.limit(0)).count() == 0


def test_marks_over_pieces():
    text = "<P>a<<S<S>s<<M>m<M"
    for size in range(1, len(text) + 1):
        parts = {"<P>": "", "<S>": "", "<M>": ""}
        for mark, piece in fim.split_marks((text[i:i + size] for i in range(0, len(text), size)), ("<P>", "<S>", "<M>")):
            parts[mark] += piece
        assert parts == {"<P>": "a<<S", "<S>": "s<", "<M>": "m<M"}
