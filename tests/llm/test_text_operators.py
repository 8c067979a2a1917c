"""Exact results against brute force on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.llm import lines, minhash, mixing, queries, secrets, substrings
from partita.llm.shingles import labelled, shingle_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, line string, h long, kept string"


def table(spark, texts, ids=None, sources=None):
    rows = [(ids[k] if ids else k, t, "en", sources[k] if sources else f"s{k % 3}", len(t or ""), 1, "x", 5, "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    base = [words(rng, int(rng.integers(20, 120))) for _ in range(30)]
    shared = words(rng, 25)
    near = [b.replace(" a", " zz", 1) for b in base[:8]]
    mixed = [f"{words(rng, 10)} {shared} {words(rng, 12)}" for _ in range(12)]
    return [*base, *near, *mixed, base[3], base[3], None, "", "é" * 70, "é" * 71, "short", " ".join(["word"] * 3000), None, ""]


def brute_substrings(texts, ids, length=50):
    first = {}
    raw = [(t or "").encode() for t in texts]
    for i, b in sorted(zip(ids, raw, strict=True)):
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    for i, b in zip(ids, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()


@pytest.mark.parametrize("shard_bytes", [1500, 1 << 22])
def test_substrings(spark, texts, monkeypatch, shard_bytes):
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 4 * shard_bytes)
    ids = list(range(len(texts)))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.dedup_substrings(table(spark, texts)).collect())
    assert got == sorted(brute_substrings(texts, ids))


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[:400]
    order, at = substrings.suffix_array(data, 64)
    raw = data.tobytes()
    assert [raw[i : i + 64] for i in order] == sorted(raw[i : i + 64] for i in range(len(raw)))
    lcp = substrings.common_prefixes(order, at, 64)
    for r in range(1, len(order)):
        a, b = raw[order[r - 1] :][:64], raw[order[r] :][:64]
        assert lcp[r] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def edit_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_lines(spark):
    rng = np.random.default_rng(9)
    pool = [words(rng, 6) for _ in range(25)] + ["aaaaaaaaaaaaaaaaaaaa", "short one", "", "a", "b", "ab", "xyz", "é", "two", "1.", "12"]
    texts = []
    for _ in range(60):
        picked = []
        for _ in range(int(rng.integers(1, 6))):
            s = pool[int(rng.integers(len(pool)))]
            if s and rng.random() < 0.6:
                k = int(rng.integers(len(s)))
                s = [s[:k] + "q" + s[k:], s[:k] + s[k + 1 :], s[:k] + "q" + s[k + 1 :]][int(rng.integers(3))]
            picked.append(s)
        texts.append("\n".join(picked))
    texts += [None, "", "\n\n", texts[0]]
    first = {}
    for i, t in enumerate(texts):
        for k, s in enumerate((t or "").split("\n")):
            if s.strip(" "):
                first.setdefault(s, (i, k))
    near = {s for s in first if any(first[o] < first[s] and edit_one(s, o) for o in first if o != s)}
    assert {"b"} < {s for s in near if len(s) < 16}
    assert len(near) > 20
    for r in lines.dedup_lines(table(spark, texts)).collect():
        if texts[r.doc_id] is None:
            assert (r.text, r.n_lines, r.n_removed) == (None, 0, 0)
            continue
        every = texts[r.doc_id].split("\n")
        kept = [s for k, s in enumerate(every) if not s.strip(" ") or (first[s] == (r.doc_id, k) and s not in near)]
        assert (r.text, r.n_lines, r.n_removed) == ("\n".join(kept), len(every), len(every) - len(kept))


def test_lines_are_built_in_functions_only(spark, texts):
    plan = lines.dedup_lines(table(spark, texts))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_minhash_finds_every_link(spark, texts):
    shingles = [labelled(shingle_hashes(t or "")) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(shingles[i]) and (texts[i] == texts[j] or minhash.similar(shingles[i], shingles[j])):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in minhash.classes(table(spark, texts)).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert len(set(got.values())) < len(texts) - 5


def test_minhash_links_short_texts(spark):
    rng = np.random.default_rng(12)
    texts = []
    for n in [*range(1, 15)] * 3:
        text = words(rng, n)
        texts += [text, f"{text} {words(rng, 1)}", f"{words(rng, 1)} {text}", f"{words(rng, 1)} {text} {words(rng, 1)}", " ".join([*text.split()[1:], *words(rng, 1).split()])]
    shingles = [labelled(shingle_hashes(t)) for t in texts]
    pairs = [(j, i) for i in range(len(texts)) for j in range(i) if texts[i] == texts[j] or minhash.similar(shingles[i], shingles[j])]
    assert {(len(shingles[j]), len(shingles[i])) for j, i in pairs} >= {(4, 5), (5, 6), (8, 10), (9, 9), (10, 10)}
    for j, i in pairs:
        assert set(minhash.sketch(shingles[i])) & set(minhash.sketch(shingles[j]))
    want = {k: k for k in range(len(texts))}
    for j, i in pairs * 8:
        want[i] = want[j] = min(want[i], want[j])
    assert {r.doc_id: r.class_id for r in minhash.classes(table(spark, texts)).collect()} == want


def test_minhash_keeps_drifting_families_whole(spark):
    rng = np.random.default_rng(30)
    texts = []
    for _ in range(30):  # each version moves on by ten of its 110 words
        long = words(rng, 110 + 10 * 23).split(" ")
        texts += [" ".join(long[10 * k : 10 * k + 110]) for k in range(24)]
    order = rng.permutation(len(texts))
    shingles = [labelled(shingle_hashes(t)) for t in texts]
    assert all(minhash.similar(shingles[k], shingles[k + 1]) for k in range(len(texts) - 1) if k % 24 < 23)
    for ids in (list(range(len(texts))), [int(k) for k in order]):
        got = {r.doc_id: r.class_id for r in minhash.classes(table(spark, texts, ids=ids)).collect()}
        assert got == {i: min(ids[k // 24 * 24 : k // 24 * 24 + 24]) for k, i in enumerate(ids)}


def test_minhash_of_forms_with_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "MANY", 1)
    rng = np.random.default_rng(31)
    form = words(rng, 70)  # most of every text, yet no two of different fillings are similar
    texts = []
    for _ in range(60):
        own = words(rng, 40).split(" ")
        texts += [f"{form} {' '.join(own)}", f"{form} {' '.join(own[:-2])} {words(rng, 2)}"]
    want = {k: k // 2 * 2 for k in range(len(texts))}
    counts = np.zeros(minhash.CELLS, np.int64)
    shingles = [labelled(shingle_hashes(t)) for t in texts]
    for s in shingles:
        counts += np.bincount((s % np.uint64(minhash.CELLS)).astype(int), minlength=minhash.CELLS)
    firsts = [set(minhash.first_shingles(s, counts)) for s in shingles]
    assert not any(minhash.similar(shingles[i], shingles[j]) for i in range(0, 40, 2) for j in range(i))
    assert sum(bool(firsts[i] & firsts[j]) for i in range(len(texts)) for j in range(i)) < 80
    nodes = spark.createDataFrame([(k, [7]) for k in range(len(texts))], "node long, bands array<long>")
    found = minhash.components(minhash.links(nodes, table(spark, texts)))
    assert {r.node: r["class"] for r in found.collect()} == want


@pytest.mark.parametrize("block", [2, 256])
def test_minhash_exhausts_a_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "MANY", 1)
    rng = np.random.default_rng(4)
    first = words(rng, 40)
    second = f"{first} {words(rng, 4)}"
    texts = [first, second, f"{second} {words(rng, 6)}"]  # neighbours in this order are alike, the ends are not
    for _ in range(5):
        texts.append(words(rng, 40))
    texts += [f"{t} {words(rng, 2)}" for t in texts[3:]]
    nodes = spark.createDataFrame([(k, [7]) for k in range(len(texts))], "node long, bands array<long>")
    found = minhash.components(minhash.links(nodes, table(spark, texts)))
    assert {r.node: r["class"] for r in found.collect()} == {0: 0, 1: 0, 2: 0} | {k + d: k for k in range(3, 8) for d in (0, 5)}


def test_similarity_is_that_of_a_full_alignment():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = labelled(rng.integers(0, 40, int(rng.integers(1, 60))).astype(np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, 9))):
            k = int(rng.integers(len(b)))
            b = np.delete(b, k) if rng.random() < 0.5 and len(b) > 1 else np.insert(b, k, rng.integers(1 << 60))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        m = best[-1, -1]
        assert minhash.similar(a, b) == (m / (len(a) + len(b) - m) >= 0.8)


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "first long, node long")
    got = {r.node: r["class"] for r in minhash.components(pairs).collect()}
    assert set(got.values()) == {0, 100} and all(got[i] == 0 for i in range(41))


def test_classes_joined_by_new_links_are_those_of_all_links(spark):
    rng = np.random.default_rng(41)
    links = [tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(45)]
    old, new = (spark.createDataFrame(some, "first long, node long") for some in (links[:25], links[25:]))
    nothing = old.limit(0)
    rows = lambda t: sorted(map(tuple, t.select("node", "class").collect()))
    named = minhash.components(old)
    assert rows(minhash._joined(named, new)) == rows(minhash.components(old.union(new)))
    assert rows(minhash._joined(named, nothing)) == rows(named)
    assert rows(minhash._joined(minhash.components(nothing), new)) == rows(minhash.components(new))


def test_secrets(spark):
    rng = np.random.default_rng(3)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(60)]
    texts = [f"{words(rng, 30)} password={h[:18]} and token = \"{h}\" {words(rng, 5)}" for h in hexes]
    hidden = "".join(rng.choice(list("0123456789abcdef"), 28))
    texts += [f"plain {words(rng, 20)} {hidden} tail", "AKIA" + "A" * 12 + " AKIAB", "secret: abc password=token: abcdefgh12", None, "", 'API_KEY:"' + "x" * 9 + '" é apikey=zzzzzzzz', " ".join("a" * 17 for _ in range(600))]
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        want = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
    at = texts[60].index(hidden)
    assert got[60].spans == f"markov:{at}:{at + 28}"
    assert got[66].spans == ""


def test_secrets_that_are_rare_still_train_the_model(spark):
    rng = np.random.default_rng(6)
    digits = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    last = max(range(200), key=lambda k: hashlib.md5(str(k).encode()).hexdigest()[:15])
    texts = [f"{words(rng, 30)} {digits(28) if k == 7 else ''}" for k in range(200)]
    texts[last] = " ".join(f"password={digits(24)} {digits(40)}" for _ in range(60))
    got = {r.doc_id: r.spans for r in secrets.scan(table(spark, texts), sample=20).collect()}
    assert [s.kind for s in got[7]] == [3]
    missing = secrets.scan(table(spark, texts, ids=[None if k == last else k + 1 for k in range(200)]), sample=20).where("doc_id = 8").first()
    assert [s.kind for s in missing.spans] == [3]


def test_secrets_are_built_in_functions_only(spark, texts):
    plan = secrets.digest(secrets.scan(table(spark, texts)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing_keeps_to_targets(spark, texts):
    sources = [["a", "b", None, "c", "c", "c", "c"][k % 7] for k in range(len(texts))]
    rows = mixing.mix(table(spark, texts, sources=sources)).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        taken = r.whole * r["size"] + r.extra
        assert taken <= 3 * r["size"]
        by.setdefault(r.source, []).append((taken, r.target, r.source_size))
    for got in by.values():
        assert int(got[0][1]) - 1 <= sum(t for t, _, _ in got) <= got[0][1] + 1e-6
        assert got[0][1] <= 3 * got[0][2] + 1e-6
    assert sum(x[0][1] for x in by.values()) == pytest.approx(total)
    mixed = mixing.mixed_rows(table(spark, texts, sources=sources))
    counted = mixed.select("source", F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    assert {r.source: r.n for r in counted} == {s: sum(t for t, _, _ in x) for s, x in by.items()}
    assert mixed.columns == table(spark, texts).columns


@pytest.mark.parametrize("op", [lambda d: substrings.dedup_substrings(d), lambda d: lines.dedup_lines(d), lambda d: minhash.classes(d), lambda d: secrets.scan(d), lambda d: mixing.mix(d)])
def test_empty_tables_and_missing_ids(spark, op):
    assert op(table(spark, [])).count() == 0
    assert op(table(spark, ["a b c d e f g", None, "a b c d e f g", "x"], ids=[None, None, 1, 1])).count() == 4


def test_registered_names():
    assert [k for k in queries.QUERIES if k.startswith("op")] == sorted((k for k in queries.QUERIES if k.startswith("op")), key=lambda k: int(re.match(r"op(\d+)", k)[1]))
    assert zlib.crc32(b"x")
