"""Collocations, whitening and licences against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from partita.llm import collocations, language, licenses, lines, media, minhash, mixing, neighbours, secrets, substrings, toxicity, whitening
from partita.llm.license_rules import STEMS, rules

DOCS = "doc_id long, text string, lang string, source string, phrase string, row int"


def _phrases(rows, least, top, absorbed=100):
    words, counts = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    frequent = {p: a for p, a in counts.items() if a >= least}
    longer = defaultdict(int)
    for (lang, p), a in frequent.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    best = defaultdict(list)
    for (lang, p), a in frequent.items():
        if len(p) > 1 and not 100 * longer[lang, p] >= absorbed * a:
            cuts = [(1000 * a * words[lang] // (frequent[lang, p[:k]] * frequent[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best[lang].append((-score, -a, " ".join(p).encode(), frequent[lang, p[:k]], frequent[lang, p[k:]]))
    return {(lang, rank, p.decode(), -a, le, r, words[lang], -s) for lang, found in best.items() for rank, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)}


def _texts(n):
    rng = np.random.default_rng(n)
    vocabulary = ["new", "York", "Zürich", "of", "the", "a", "ice", "cream", "ÉA", "\x00", "x" * 50]
    rows = [(" ".join(rng.choice(vocabulary, size=int(rng.integers(0, 40)), p=None)) + rng.choice([".", ", new york; ice cream", "\ta b\x0bA  b!", ""]), str(rng.choice(["en", "de"]))) for _ in range(n)]
    return rows + rows[:5] + [(None, "en"), ("", None), ("ice cream ice cream of the", None), (". , ;", "xx"), ("a b c " * 300, "en")]


@pytest.mark.parametrize("bits", [8, 26])  # 256 bits are nearly all set: windows get longer, results stay
def test_collocations_equal_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(collocations, "CHUNK", 700)
    monkeypatch.setattr(collocations, "HELD", 300 if bits == 8 else 2_000_000)
    rows = _texts(60)
    docs = spark.createDataFrame([(k, t, lang, "s", "clash", k) for k, (t, lang) in enumerate(rows)], DOCS).repartition(3)
    got = {tuple(r) for r in collocations.collocations(docs, least=4, top=7, bits=bits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == _phrases(rows, 4, 7) and got
    part = {tuple(r) for r in collocations.collocations(docs, least=4, top=7, absorbed=60, bits=bits).collect()}
    assert len(part) <= len(got) and len({r[1] for r in part}) > 1


def test_collocations_of_little(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, "a b", "en", None, None, 1)], DOCS)).collect() == []


def test_score_is_exact_beyond_64_bits(spark):
    rows = spark.createDataFrame([(3 * 10**9, 4 * 10**12, 5 * 10**9, 7 * 10**8)], "a long, n long, l long, r long")
    exact = rows.selectExpr("cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s").first().s
    assert exact == 1000 * 3 * 10**9 * 4 * 10**12 // (5 * 10**9 * 7 * 10**8)


@pytest.mark.parametrize("make", ["gauss", "several", "deficient", "graded"])
def test_singular_values_and_directions(make):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 40))
    if make == "several":
        m = np.linalg.qr(m)[0] * np.repeat([5.0, 4, 3, 2, 1], 8)
    elif make == "deficient":
        m = m[:12]
    elif make == "graded":
        m = np.linalg.qr(m)[0] * np.logspace(0, -8, 40) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    r = np.linalg.qr(m, mode="r")
    r = np.concatenate([r, np.zeros((40 - len(r), 40))])
    a, b, v = whitening.bidiagonal(r)
    assert np.allclose(v.T @ v, np.eye(40)) and np.allclose(np.linalg.norm(r @ v, axis=0), np.linalg.norm(np.diag(a) + np.diag(b, 1), axis=0))
    values, true = np.array(whitening.squares((a * a).tolist(), (b * b).tolist())), np.linalg.svd(r, compute_uv=False) ** 2
    rank = 12 if make == "deficient" else 40
    assert len(values) == 40 and np.allclose(values[:rank], true[:rank], rtol=1e-9 if make == "graded" else 1e-12, atol=0)
    z = v @ whitening.directions(a, b, values[:rank])
    assert np.abs(z.T @ z - np.eye(rank)).max() < 1e-10
    assert np.abs(r.T @ (r @ z) - z * values[:rank]).max() < 1e-12 * values[0]


VECTORS = "vec_id long, embedding array<float>, label int, n long"


def _vectors(n=400, d=9):
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(n, d)) * np.linspace(1, 3, d)).astype(np.float32)
    x[5], x[6] = x[4], x[4]
    rows = [(int(k) if k % 11 else None, [float(v) for v in row], 0, 1) for k, row in enumerate(x)]
    odd = [(900, None, 0, 1), (901, [None] + [1.0] * (d - 1), 0, 1), (902, [float("nan")] * d, 0, 1), (903, [float("inf")] * d, 0, 1), (904, [1.0], 0, 1), (905, [], 0, 1), (7, rows[7][1], 0, 1)]
    return rows + odd, np.concatenate([x, x[7:8]]).astype(float)


@pytest.mark.parametrize("parts", [1, 70])
def test_whitening_equals_the_plain_way(spark, parts):
    rows, x = _vectors()
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(parts), components=4).toPandas()
    whole = np.floor(64 * x).astype(np.int64) + 1_000_000
    n, s = len(whole), whole.sum(0)
    assert len(out) == 4 * n and (out.n == n).all() and out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    e, vectors = np.linalg.eigh(np.cov(whole.T, bias=True))
    e, vectors = e[::-1], vectors[:, ::-1]
    deviation = sorted(int(v) for v in ((n * whole - s) ** 2).sum(1))
    assert sorted(out[out.component == 1].deviation) == deviation
    for k in range(4):
        some = out[out.component == k + 1]
        assert np.allclose(some.explained, e[k] / e.sum(), rtol=1e-9)
        mine = ((whole - s / n) @ vectors[:, k]) / np.sqrt(e[k])
        got = np.sort(some.whitened)
        assert np.allclose(got, np.sort(mine), atol=1e-7) or np.allclose(got, np.sort(-mine), atol=1e-7)
    same = out[(out.vec_id == 7) & (out.component == 1)]
    assert len(same) == 2 and same.whitened.nunique() == 1


def test_whitening_of_little(spark):
    white = lambda rows: whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert white([]) == [] and white([(1, None, 0, 1)]) == [] and white([(1, [1.0, 2.0], 0, 1)] * 3) == []
    one = white([(1, [1.0, 5.0], 0, 1), (2, [2.0, 5.0], 0, 1)])  # the second dimension never differs
    assert [(r.vec_id, r.component, r.deviation, round(abs(r.whitened), 9), round(r.explained, 9)) for r in sorted(one)] == [(1, 1, 64**2, 1.0, 1.0), (2, 1, 64**2, 1.0, 1.0)]
    vast = white([(1, [3e38, 0.0], 0, 1), (2, [-3e38, 1.0], 0, 1), (3, [0.0, 0.0], 0, 1)])
    assert {r.deviation for r in vast if r.vec_id != 3} == {None} and all(np.isfinite(r.whitened) for r in vast)


def test_a_rule_is_tried_wherever_it_matches():
    assert len(rules()) > 200
    for tier, keyword, label, regex in rules():
        assert any(s in keyword for s in STEMS), keyword
        assert tier in licenses.CONFIDENCE and label
        plain = re.sub(r"\(\?[!=].*\)$", "", regex)

        @given(st.from_regex(re.compile(plain, re.ASCII), fullmatch=True))
        @settings(max_examples=10, deadline=None, database=None, suppress_health_check=list(HealthCheck))
        def holds(found):
            assert keyword in found  # noqa: B023

        holds()


def _licences(text):
    """The same result by Python's regular expressions and all pairs of detections."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
    line = " " + "".join(w + " " for w in words)
    spot = lambda regex: [(line[: m.start()].count(" ") - 1, line[: m.end()].count(" ")) for m in re.finditer(licenses.whole_words(regex), line)]
    base = [(label, *p) for phrase, label in licenses.BASE for p in spot(phrase)]
    every = [(*p, tier, rank, label) for rank, (tier, _, label, regex) in enumerate(rules()) for p in spot(regex)]

    def holds(x, y):
        return x != y and x[0] <= y[0] and x[1] >= y[1] and x[2] <= y[2] and ((x[0], -x[1], x[2], x[3]) < (y[0], -y[1], y[2], y[3]))

    kept = [y for y in every if not any(holds(x, y) for x in every)]
    starts = [s for _, s, _ in base]
    labels = lambda found: ",".join(sorted(set(found)))
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), labels(b[0] for b in base),
        labels([b[0] for b in base] + [k[4] for k in kept]), max((licenses.CONFIDENCE[k[2]] for k in kept), default=0.0),
    )


TEXTS = [
    None, "", "...", "plain words", "Released under the MIT License.", "mit-license MIT\nLicence, the * MIT\n * License!", "SMIT License, mit licenses, MİT license",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License v2.1 or the General Public License",
    "Licensed under CC BY-NC 4.0.", "CC-BY-SA", "# SPDX-License-Identifier: GPL-2.0-or-later", "// SPDX-License-Identifier: MIT-0\n// SPDX-License-Identifier: Apache-2.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    "https://www.gnu.org/licenses/gpl-3.0.html http://www.apache.org/licenses/LICENSE-2.0", "Copyright (c) 2020, 2021 Some One and Co. All rights reserved.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. MPL 2.0", "MIT License " * 700, "mit license mit license", "Ünïcode MIT License çedilla apache\tlicense",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "https://creativecommons.org/licenses/by-nc-sa/4.0/", "the same terms as Perl itself; BSD 3-Clause License; zlib/libpng license",
]


def test_licences_equal_brute_force(spark):
    rows = [(k % 20, t, "en", "s", "clash", k) for k, t in enumerate(TEXTS)] + [(None, TEXTS[4], None, None, None, 99)]
    out = licenses.digest(licenses.scan(spark.createDataFrame(rows, DOCS).repartition(3))).collect()
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in out)
    assert got == Counter((r[0], *_licences(r[1])) for r in rows)
    assert licenses.digest(licenses.scan(spark.createDataFrame([], DOCS))).collect() == []


def test_licences_found(spark):
    texts = [TEXTS[7], TEXTS[8], TEXTS[10], TEXTS[12], "nothing of the kind " * 50]
    out = licenses.digest(licenses.scan(spark.createDataFrame([(k, t, "en", "s", "", 0) for k, t in enumerate(texts)], DOCS))).orderBy("doc_id").collect()
    assert [r.labels for r in out] == ["apache,apache-2.0", "gpl,gpl-3.0", "cc-by-nc-4.0", "gpl-2.0-or-later", ""]


def test_license_scan_has_no_python_workers(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "MIT License", "en", "s", "", 0)], DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_lines_of_rows_that_share_an_id(spark, parts):
    """A line goes if an earlier one is near, whatever the partitions: rows of one id follow by a hash of their texts."""
    texts = [(1, "first line here\nabcdefgh"), (1, "other text\nabcdefgx"), (2, "abcdefgy"), (3, "first line hero"), (4, "something new\nother texts"), (1, "first line here\nabcdefgh")]
    out = lines.dedup_lines(spark.createDataFrame([(k, t, "en", "s", "", i) for i, (k, t) in enumerate(texts)], DOCS).repartition(parts)).collect()
    keys = {t: r.k for t in {t for _, t in texts} for r in [spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t").bitwiseAND(2**31 - 1).alias("k")).first()]}
    seen, want = [], Counter()
    every = sorted((k, keys[t], n, line) for k, t in set(texts) for n, line in enumerate(t.split("\n")))
    gone = set()
    near = lambda a, b: a == b or (abs(len(a) - len(b)) <= 1 and _edits(a, b) <= 1)
    for k, key, n, line in every:
        if any(near(line, other) for other in seen):
            gone.add((k, key, n))
        seen.append(line)
    for k, t in texts:
        want[k, "\n".join(line for n, line in enumerate(t.split("\n")) if (k, keys[t], n) not in gone)] += 1
    assert Counter((r.doc_id, r.text) for r in out) == want


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("parts", [1, 5, 9])
def test_neighbours_of_a_query_with_two_vectors(spark, parts):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    rows = [(k, [float(v) for v in x[k]], 0, 1) for k in range(300)] + [(0, [float(v) for v in -x[0]], 0, 1)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n long").repartition(parts), F.col("vec_id") == 0)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.abs(unit[1:] @ unit[0])
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [int(k) + 1 for k in np.argsort(-best, kind="stable")[:5]]


@pytest.mark.parametrize("scale", [1e200, 1e-200])
def test_neighbours_of_very_large_and_small_vectors(spark, scale):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4))
    made = [neighbours.search(spark.createDataFrame([(k, [float(v * s) for v in x[k]], 0, 1) for k in range(60)], "vec_id long, embedding array<double>, label int, n long"), F.col("vec_id") % 50 == 0) for s in (1.0, scale)]
    plain, scaled = ([(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in m.orderBy("query_id", "rank").collect()] for m in made)
    assert plain == scaled and len(plain) == 10


def test_empty_tables_and_stages(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert language.identify(docs).collect() == [] and toxicity.rate(docs, labels).collect() == []
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, str(tmp_path))
        assert made.collect() == [] and made.columns == list(corpus_pipeline.COLUMNS), name


def test_repeated_rows_and_a_very_long_text(spark):
    """Equal texts get equal values, rows stay one to one, and a text of 400,000 characters is taken whole."""
    long = "Der Hund und die Katze gehen password=abcdefgh1234 in den Wald.\n" * 6000 + "token: endofthetext99"
    rows = [(1, "The quick brown fox.", "en"), (1, "The quick brown fox.", "en"), (2, "Le chat dort.\nLe chien aussi.", "fr"), (None, "Le chat dort.\nLe chien aussi.", "fr"), (3, long, "de"), (4, None, None), (5, "", "en")]
    docs = spark.createDataFrame([(k, t, lang, "s", "", i) for i, (k, t, lang) in enumerate(rows)], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    sha = [r.payload_sha256 for r in media.digest(media.load(media.store(docs))).collect()]
    assert len(sha) == 7 and sorted(Counter(sha).values()) == [1, 2, 2, 2]  # null counts as empty
    for made, column in ((language.identify(docs), "lang_pred"), (toxicity.rate(docs, labels), "score")):
        out = made.collect()
        assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
        assert len({r[column] for r in out if r.doc_id == 1}) == 1 and len({r[column] for r in out if r.doc_id in (2, None)}) == 1
    kept = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert kept[3].n_lines == 6001 and kept[3].n_removed == 5999 and kept[3].text.endswith("endofthetext99")
    found = {r.doc_id: r for r in secrets.digest(secrets.scan(docs)).collect()}
    assert found[3].n_assign == 6001 and found[3].spans.endswith(f"assign:{len(long) - 21}:{len(long)}")
    assert len(minhash.classes(docs).collect()) == 7 and len(mixing.mix(docs).collect()) == 7 and len(substrings.dedup_substrings(docs).collect()) == 7


def test_toxicity_learns_a_bounded_number_of_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "materialise", lambda df: seen.append(df.count()) or df)
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, sample=2)
    assert seen == [2]


def test_neighbours_in_parts_of_parts(spark, monkeypatch):
    """With parts of more than 300 rows split again, recall holds on many queries, and no query lacks neighbours."""
    monkeypatch.setattr(neighbours, "LARGEST", 300)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 8))
    x = np.concatenate([centres[k % 60] + 0.3 * rng.normal(size=8) for k in range(9000)]).reshape(-1, 8)
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit[::20] @ unit.T
    s[np.arange(len(s)), np.arange(len(s)) * 20] = -2
    true = np.argpartition(-s, 4, axis=1)[:, :5]
    assert len(got) == 450 and {len(v) for v in got.values()} == {5}
    assert np.mean([len(set(got[20 * i]) & set(t)) / 5 for i, t in enumerate(true)]) >= 0.9
