"""Round trips, held-out accuracy and recall."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partita.llm import language, media, minhash, mixing, neighbours, sentencepiece_codec, toxicity
from partita.llm.shingles import labelled, shingle_hashes


def _library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)


@pytest.fixture(scope="module")
def docs(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet").cache()


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 384 * 7, 384 * 4095 + 5])
def test_jpeg_gives_every_byte_back(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    image = media.Image(media.encode_jpeg(payload))
    assert image.payload() == payload
    assert image.rgb().shape == (image.height, image.width, 3)


class _Writer:
    """Bits of a hand-made scan."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += f"{value:0{n}b}" if n else ""

    def body(self):
        padded = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(padded[k : k + 8], 2) for k in range(0, len(padded), 8))


def test_sparse_progressive_scans():
    """A file with zeros, runs and new coefficients in refinement: what other encoders write."""
    rng = np.random.default_rng(8)
    coefs = np.zeros((6, 64), int)
    for b in range(6):
        for k in rng.choice(np.arange(1, 64), 9, replace=False):
            coefs[b, k] = int(rng.choice([-7, -3, -2, -1, 1, 2, 3, 6]))
    coefs[4] = 0
    coefs[:, 0] = rng.integers(-60, 60, 6)
    lengths = {s: 8 for s in [0, *[r << 4 | n for r in range(16) for n in (1, 2, 3)], *[r << 4 for r in range(1, 16)]]}
    codes = media._codes(lengths)
    put = lambda w, s: w.put(*codes[s])
    dc, first, refine = _Writer(), _Writer(), _Writer()
    dc_codes, last = media._codes(media.DC_LENGTHS), 0
    for v in coefs[:, 0]:
        d, last = int(v) - last, int(v)
        size = abs(d).bit_length()
        dc.put(*dc_codes[size])
        dc.put(d if d > 0 else d + (1 << size) - 1, size)
    low = np.sign(coefs) * (np.abs(coefs) >> 1)
    for b in range(6):
        run = 0
        for k in range(1, 64):
            v = int(low[b, k])
            if v == 0:
                run += 1
                continue
            while run > 15:
                put(first, 0xF0)
                run -= 16
            size = abs(v).bit_length()
            put(first, run << 4 | size)
            first.put(v if v > 0 else v + (1 << size) - 1, size)
            run = 0
        if run:
            put(first, 0)
    for b in range(6):
        run, pending = 0, ""
        new = [k for k in range(1, 64) if abs(coefs[b, k]) == 1]
        for k in range(1, (new[-1] if new else 0) + 1):
            if abs(coefs[b, k]) > 1:
                pending += str(abs(int(coefs[b, k])) & 1)
            elif abs(coefs[b, k]) == 1:
                put(refine, run << 4 | 1)
                refine.put(int(coefs[b, k] > 0), 1)
                refine.bits += pending
                run, pending = 0, ""
            else:
                run += 1
                if run == 16:
                    put(refine, 0xF0)
                    refine.bits += pending
                    run, pending = 0, ""
        put(refine, 0)
        refine.bits += pending + "".join(str(abs(int(coefs[b, k])) & 1) for k in range((new[-1] if new else 0) + 1, 64) if abs(coefs[b, k]) > 1)
    frame = bytes([8, 0, 16, 0, 24, 1, 1, 0x11, 0])
    data = b"".join([
        b"\xff\xd8", media._segment(0xDB, bytes([0]) + bytes([1] * 64)), media._segment(0xC2, frame), media._table(0, 0, media.DC_LENGTHS), media._table(1, 0, lengths),
        media._scan(1, 0, 0, 0, 0, 0, dc.body()), media._scan(1, 0, 1, 63, 0, 1, first.body()), media._scan(1, 0, 1, 63, 1, 0, refine.body()), b"\xff\xd9",
    ])
    image = media.Image(data)
    assert (image.coefs[0] == coefs).all()
    y, x, v, u = np.mgrid[0:8, 0:8, 0:8, 0:8]
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) * np.where(u, 0.5, 8**-0.5) * np.where(v, 0.5, 8**-0.5)
    square = np.zeros((6, 64))
    square[:, media._zigzag()] = coefs
    want = np.einsum("yxvu,bvu->byx", basis, square.reshape(6, 8, 8)) + 128
    assert np.allclose(image.samples(0).reshape(2, 8, 3, 8).transpose(0, 2, 1, 3).reshape(6, 8, 8), want, atol=1e-2)


def test_media_columns(spark, docs):
    some = docs.limit(40).unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "", None, None, None)], docs.schema))
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in media.load(media.store(some)).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw)
        assert bytes(r.payload) == raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert len(r.rgb) == r.height * r.width * 3


def test_sentencepiece_equals_the_library(spark, docs):
    library = _library()
    odd = ["", " ", "   a   b ", "漢字 and 😀\n\n\ttabs", "x" * 500, "a" * 97, " " * 40, "%%%%%", "don't. stop, \"now\""]
    rows = docs.limit(150).select("doc_id", "text").union(spark.createDataFrame([(-k, t) for k, t in enumerate([None, *odd], 1)], "doc_id long, text string"))
    for r in sentencepiece_codec.decode(sentencepiece_codec.encode(rows)).collect():
        assert r.ids == (None if r.text is None else library.encode(r.text))
        assert r.decoded == r.text


def test_streaming_pass_commits_where_paths_meet():
    library = _library()
    known = sentencepiece_codec._Vocabulary(sentencepiece_codec.read_vocabulary())
    ids = lambda t: np.frombuffer(known.encode([t])[0], np.int32).tolist()
    rng = np.random.default_rng(21)
    pieces = [*"ab th\n\t\r.,;e▁éin漢", "  ", "   ", "the", "er", " " * 14, " " * 16, "\r\n", "😀"]
    for _ in range(600):
        text = "".join(rng.choice(pieces, int(rng.integers(1, 40))))
        assert ids(text) == library.encode(text)
    for text in ("abcdefghij" * 100_000, " " * 5000, "x" * 5000, "nostops,but;meetings:everywhere" * 3000):
        known.meetings = known.widest = 0
        assert ids(text) == library.encode(text)
        assert known.meetings > len(text) / 100 and known.widest <= 2 * known.window
    known.meetings, text = 0, "one two three"
    known.known.clear()
    assert ids(text) == library.encode(text) and known.meetings >= 3


def test_remembered_parts_and_states_are_bounded(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 50)
    monkeypatch.setattr(sentencepiece_codec, "TRANSITIONS", 300)
    library = _library()
    known = sentencepiece_codec._Vocabulary(sentencepiece_codec.read_vocabulary())
    rng = np.random.default_rng(22)
    for _ in range(60):
        text = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(30))
        assert np.frombuffer(known.encode([text])[0], np.int32).tolist() == library.encode(text)
        assert len(known.known) <= 50 and len(known.older) <= 50


def test_decoding_replaces_a_column_of_its_name(spark):
    rows = spark.createDataFrame([(1, "a b", [1], "old"), (1, "a b", [1], "old"), (2, None, None, "old")], "doc_id long, text string, ids array<int>, decoded string")
    coded = sentencepiece_codec.encode(rows).withColumn("decoded", F.lit(5))
    assert sorted((r.doc_id, r.decoded) for r in sentencepiece_codec.decode(coded).collect()) == [(1, "a b"), (1, "a b"), (2, None)]
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(rows.limit(0))).count() == 0


def test_language_of_held_out_rows(spark, docs):
    said = language.identify(docs, sample=60).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out")
    row = said.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert row.n > 20 and row.right > 0.95
    none = spark.createDataFrame([(2, None, "en"), (6, " 12 !", "en"), (10, "", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(none).collect()} == {"und"}


def test_language_learns_a_bounded_sample(spark, monkeypatch):
    """Repeated ids teach one text, and the bound on all languages is shared; the salt changes nothing."""
    rows = [(1, f"mot {k}", "fr") for k in range(40)] + [(k, f"wort {k}", "de") for k in range(2, 42)]
    rows += [(90, "slovo", "cs"), (90, "slovo", "cs"), (91, None, "cs"), (92, "", "pl"), (None, "ord", "sv")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rank", F.lit("clash"))
    seen = []
    monkeypatch.setattr(language, "Model", lambda names, x, y: seen.append({g: int((y == k).sum()) for k, g in enumerate(names)}))
    language.fit(df)
    assert seen[-1] == {"cs": 1, "de": 40, "fr": 1}
    monkeypatch.setattr(language, "TOTAL", 15)
    for salts in ((1,), (7, 1), (7, 3, 1)):
        monkeypatch.setattr(language, "SALTS", salts)
        language.fit(df)
        assert seen[-1] == {"cs": 1, "de": 3, "fr": 1}


def test_levenshtein_trie_against_distances():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    rng = np.random.default_rng(6)
    terms = ["scum", "idiot", "stupid", "disgusting", "worthless", "loweiä"]
    words = sorted({"".join(c for c in (list(t[:k]) + [str(rng.choice(list("abcdeist")))] + list(t[k + int(rng.integers(3)) :]))) for t in terms for k in range(len(t)) for _ in range(8)} | set(terms) | {"a", "x" * 60})
    found = toxicity.Trie(terms).search(words)
    for w in words:
        near = sorted((distance(w, t), k) for k, t in enumerate(terms) if distance(w, t) <= toxicity.edits(t))
        assert found.get(w) == ((near[0][1], near[0][0]) if near else None)


def test_toxicity_finds_misspellings_and_spares_quotations(spark):
    rng = np.random.default_rng(2)
    clean = lambda: " ".join("".join(rng.choice(list("mnoprsu"), 5)) for _ in range(40))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"{clean()} you stupid idiot {clean()}" if bad else clean()))
        labels.append((i, int(bad)))
    rows += [(1000, f"{clean()} you stupd idi0t stupiid idioot {clean()}"), (1001, None), (1002, ""), (1003, clean())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    said = {r.doc_id: r for r in toxicity.rate(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(said[i].predicted == int(i % 4 == 0) for i in range(400))
    assert said[1000].score > said[1003].score and said[1001].predicted == said[1002].predicted == 0
    model = toxicity.Model(["idiot"], np.array([3.0]))
    abuse, quoted = model.features(["you idiot go away", 'they called someone an "idiot" then'])
    assert abuse[0] > 0 and quoted[0] == 0 and quoted[2] > 0
    untaught = toxicity.rate(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(untaught) == 404 and {r.predicted for r in untaught} == {0}


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(12, size=900)] + 0.6 * rng.normal(size=(900, 16)), np.tile(rng.normal(size=16), (300, 1))])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("clash"))
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    unit = x / np.sqrt((x**2).sum(1, keepdims=True))
    assert sorted(got) == list(range(0, 1200, 50))
    hit = 0
    for q, found in got.items():
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(len(s)), -s))[:5]
        hit += len(set(want) & {v for v, _ in found})
        assert len(found) == 5 and [v for _, v in found] == sorted((v for _, v in found), reverse=True)
        if q >= 900:
            assert [v for v, _ in found] == [v for v in range(900, 907) if v != q][:5]
    assert hit >= 0.9 * 5 * len(got)
    assert neighbours.search(df.where("vec_id >= 5000"), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(60, 8))
    x[1:9] = x[0] + 0.01 * np.arange(1, 9)[:, None] * rng.normal(size=(8, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(60) for _ in range(6 if i < 9 else 1)]
    rows += [(1, [float(v) for v in x[0] + 1e-4 * (k + 1) * x[20]]) for k in range(10)]  # one id, several vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r["rank"], r.score) for r in neighbours.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    unit = lambda v: np.array(v) / np.sqrt((np.array(v) ** 2).sum())
    best = {}
    for i, v in rows:
        if i:
            best[i] = max(best.get(i, -9), float(unit(v) @ unit(x[0])))
    want = sorted(best, key=lambda i: -best[i])[:5]
    assert [i for i, _, _ in got] == want and [r for _, r, _ in got] == [1, 2, 3, 4, 5]
    assert np.allclose([s for _, _, s in got], [best[i] for i in want])


def test_every_stage_against_a_plain_version(spark, data_dir, docs):
    """What each stage keeps of what the one before it kept, by scores, edit distances, alignments, budgets and the library."""
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    docs = docs.limit(120)
    kept = corpus_pipeline.drop_toxic(spark, docs, data_dir).cache()
    scores = {r.doc_id: r.score for r in toxicity.rate(docs, labels).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    before = sorted(kept.collect())
    kept = corpus_pipeline.drop_repeated_lines(spark, kept, data_dir).cache()
    seen, want = [], {}
    for r in before:
        lines = []
        for line in (r.text or "").split("\n"):
            if not line.strip(" "):
                lines.append(line)
                continue
            if not any(abs(len(line) - len(o)) <= 1 and near(line, o) for o in seen):
                lines.append(line)
            seen.append(line)
        want[r.doc_id] = "\n".join(lines)
    assert {r.doc_id: r.text for r in kept.collect()} == want

    before = sorted(kept.collect())
    kept = corpus_pipeline.drop_near_copies(spark, kept, data_dir).cache()
    shingles = {r.doc_id: labelled(shingle_hashes(r.text or "")) for r in before}
    named = {i: i for i in shingles}
    for i in shingles:
        for j in shingles:
            if j < i and len(shingles[i]) and minhash.similar(shingles[i], shingles[j]):
                a, b = sorted((named[i], named[j]))
                named = {k: a if v == b else v for k, v in named.items()}
    assert {r.doc_id for r in kept.collect()} == {i for i, v in named.items() if i == v}

    budget = {}
    for r in mixing.mix(kept).collect():
        budget[r.source] = budget.get(r.source, 0) + r.whole * r["size"] + r.extra
    mixed = corpus_pipeline.mix_sources(spark, kept, data_dir).cache()
    texts, words = {r.doc_id: r.text for r in kept.collect()}, {}
    for r in mixed.collect():
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        words[r.source] = words.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == {s: n for s, n in budget.items() if n}

    library = _library()
    got = sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.encode(spark, mixed, data_dir).collect())
    assert got == sorted((r.doc_id, library.encode(r.text)) for r in mixed.collect())


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"word{k}" for k in range(60))
    near, other = text.replace("word7 ", "word7 more "), " ".join(f"other{k}" for k in range(30))
    rows = [(1, text, "b"), (1, text, "a"), (2, near, "a"), (3, text, "a"), (2, other, "a"), (4, None, "a"), (5, "", "a"), (4, None, "a"), (None, other, "z")]
    kept = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("class", F.lit("clash"))).collect()
    said = sorted((r.doc_id, r.text or "", r.source) for r in kept)
    assert said == sorted([(1, text, "a"), (4, "", "a"), (5, "", "a"), (4, "", "a")] + [(r.doc_id, other, r.source) for r in kept if r.text == other])
    assert minhash.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_broken_files_and_clashing_columns_of_media(spark):
    good = media.encode_jpeg(b"abc" + b"\xff" * 573)
    rows = spark.createDataFrame([(1, good, "x"), (2, good[:40], "x"), (3, b"", "x"), (4, b"no file", "x"), (5, None, "x")], "doc_id long, media binary, feature string")
    got = {r.doc_id: r for r in media.load(rows).collect()}
    assert bytes(got[1].payload)[:3] == b"abc" and got[1].feature != "x"
    assert all(got[k].payload is None and got[k].feature is None for k in (2, 3, 4, 5))
    assert media.load(media.store(spark.createDataFrame([], "doc_id long, text string, media string"))).count() == 0


def test_labels_that_disagree_and_clashing_score(spark):
    docs = spark.createDataFrame([(k, "you stupid idiot" if k % 2 else "a fine day out") for k in range(60)], "doc_id long, text string").withColumn("toxicity", F.lit(7))
    labels = spark.createDataFrame([(k, int(k % 2 == 1 and k % 3 > 0)) for k in range(60)], "doc_id long, toxic int")
    first, again = [sorted((r.doc_id, r.score) for r in toxicity.rate(d, labels).collect()) for d in (docs, docs.repartition(5))]
    assert first == again
    assert toxicity.score(docs, toxicity.trained(docs, labels)).columns == ["doc_id", "text", "toxicity"]


def test_last_stage_decodes_what_it_encodes(spark):
    texts = ["plain words", "", None, "  a \u2581 b ", "\u6f22\u5b57 \U0001f600\n\ttabs"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    said = corpus_pipeline.encode(spark, rows, "").collect()
    assert len(said) == len(texts) and all(r.round_trip for r in said)
    want = {r.doc_id: r.ids for r in sentencepiece_codec.encode(rows).collect()}
    assert {r.doc_id: (r.ids, r.n_ids) for r in said} == {k: (v, len(v or [])) for k, v in want.items()}
