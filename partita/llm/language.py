"""Language identification in two steps: the family first, then one-versus-one linear support vector machines in it.

A text is its counts of hashed character 1- to 3-grams over the whole text, normalised. One linear machine per pair of
families votes for a family, and one per pair of languages inside it for the language. The families are those of
``FAMILY``; a language that is not listed forms a family of its own.

The machines are fitted on the driver from at most ``SAMPLE`` labelled rows of each language and ``TOTAL`` in all, those
with the smallest hashes of their ids: that bound holds however large the table is. Every text is then scored whole, on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.llm.common import hash60, slices

#: Which family a language belongs to.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic", "sk": "slavic",
}

DIMENSIONS = 2048
SAMPLE = 600
#: Rows of all languages together: with more than ``TOTAL / SAMPLE`` languages each has its equal share, one at least.
TOTAL = 12000
#: Shares of a language whose ids are ranked apart, in turn: the last ranking of a language sees few of them.
SALTS = (64, 8, 1)
EPOCHS = 12
REGULARISATION = 1e-5
UNKNOWN = "und"
#: Characters whose n-grams are counted at once.
CHUNK = 1 << 20


def _counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    out = np.zeros(DIMENSIONS)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes), CHUNK):
        c = codes[max(0, at - 2) : at + CHUNK]
        new = min(at, 2)  # characters before this chunk, whose n-grams are counted already
        two = c[1:] * np.uint32(0x9E3779B1) + c[:-1]
        three = two[1:] * np.uint32(0x85EBCA6B) + c[:-2]
        for grams, n, salt in ((c, 1, 0x27D4EB2F), (two, 2, 0xC2B2AE35), (three, 3, 0x165667B1)):
            g = grams[max(0, new - n + 1) :]
            h = (g * np.uint32(salt)) >> np.uint32(21)
            out += np.bincount(h, minlength=DIMENSIONS)
    return out


def _features(text: str) -> np.ndarray:
    v = np.sqrt(_counts(text))
    return v / max(1e-12, np.sqrt((v**2).sum()))


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


class Machine:
    """A linear support vector machine fitted by averaged stochastic subgradients of the hinge loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng, w, b = np.random.default_rng(seed), np.zeros(x.shape[1]), 0.0
        mean_w, mean_b, step = np.zeros_like(w), 0.0, 0
        weight = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum()))
        weight *= len(y) / weight.sum()
        for epoch in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
                rate = 4.0 / (1 + epoch)
                wrong = y[part] * (x[part] @ w + b) < 1
                g = (y[part] * weight[part] * wrong) / max(1, len(part))
                w = w * (1 - rate * REGULARISATION) + rate * (g @ x[part])
                b += rate * 0.1 * g.sum()
                step += 1
                mean_w += (w - mean_w) / step
                mean_b += (b - mean_b) / step
        self.w, self.b = mean_w, mean_b


class Model:
    """Family machines and, inside each family, language machines; a few hundred KB at most."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.languages = languages
        self.families = sorted({FAMILY.get(g, g) for g in languages})
        self.members = {f: [g for g in languages if FAMILY.get(g, g) == f] for f in self.families}
        family = np.array([self.families.index(FAMILY.get(g, g)) for g in languages], int)[y] if len(y) else np.zeros(0, int)
        self.between = self._pairs(len(self.families), x, family)
        self.within = {f: self._pairs(len(m), x[family == k], np.array([m.index(languages[i]) for i in y[family == k]], int)) for k, (f, m) in enumerate(self.members.items())}

    @staticmethod
    def _pairs(n: int, x: np.ndarray, y: np.ndarray) -> dict[tuple[int, int], Machine]:
        return {(a, b): Machine(x[some], np.where(y[some] == a, 1.0, -1.0)) for a, b in combinations(range(n), 2) for some in [np.isin(y, (a, b))]}

    @staticmethod
    def _vote(n: int, machines: dict[tuple[int, int], Machine], v: np.ndarray) -> tuple[int, float]:
        """The winner of most pairs (then of the largest margins), and the least of its probabilities."""
        if n == 1:
            return 0, 1.0
        wins, margins, least = np.zeros(n), np.zeros(n), np.ones(n)
        for (a, b), m in machines.items():
            s = float(v @ m.w + m.b)
            wins[a if s >= 0 else b] += 1
            margins[a] += s
            margins[b] -= s
            p = 1 / (1 + np.exp(-2 * np.clip(s, -30, 30)))
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        best = max(range(n), key=lambda k: (wins[k], margins[k], -k))
        return best, float(least[best])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not _has_letter(text):
            return UNKNOWN, 0.0
        v = _features(text)
        k, p = self._vote(len(self.families), self.between, v)
        members = self.members[self.families[k]]
        i, q = self._vote(len(members), self.within[self.families[k]], v)
        return members[i], p * q


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(labelled: DataFrame, *, sample: int = SAMPLE) -> Model:
    """A model from rows with ``text`` and ``lang``; at most ``sample`` rows of each language, ``TOTAL`` of all, are used.

    Rows that share an id and a language count once, by the smallest of their texts.
    Rows with a null or letterless text, a null id or a null language teach nothing; without any row every text is ``und``.
    """
    usable = labelled.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = usable.agg(F.count_distinct("lang").alias("n")).first().n
    most = max(1, min(sample, TOTAL // max(1, languages)))
    ids = usable.select("doc_id", "lang", hash60("doc_id").alias("h")).distinct()
    # The ids are ranked without their texts, first within shares of a language, so that a frequent one is spread over
    # many groups; a language's best ids are among the best of its shares. What is broadcast is ``most`` ids of each.
    for salts in SALTS:
        first = Window.partitionBy("lang", F.pmod("h", F.lit(salts))).orderBy("h", "doc_id")
        ids = ids.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).drop("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            good = [_has_letter(t) for t in texts]
            vectors = [_features(t).astype(np.float32).tobytes() for t, g in zip(texts, good, strict=True) if g]
            yield pa.RecordBatch.from_arrays([batch.column("lang").filter(pa.array(good)), pa.array(vectors, pa.binary())], ["lang", "v"])

    # An id that many rows share teaches one text, so what is collected keeps to the bound.
    taught = usable.join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = taught.select("lang", "text").mapInArrow(run, "lang string, v binary").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.v))
    languages = sorted({r.lang for r in rows})
    x = np.array([np.frombuffer(r.v, np.float32) for r in rows], float).reshape(-1, DIMENSIONS)
    return Model(languages, x, np.array([languages.index(r.lang) for r in rows], int))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns doc_id, lang_pred, score of every row: nulls and texts without a letter are ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            said = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the rows that are not held out, applied to all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(rows.where(~held_out()), sample=sample)
    return predict(rows, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
