"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

A lexicon is learned from labelled rows: words that occur far oftener in toxic texts. Its words form a trie. The
distinct words of a text each are a Levenshtein automaton, a set of states per number of edits held as bits; all of
them walk the trie together, and a word survives below a node only while some state does. So misspelled terms are found
as well: one edit for terms of five to eight letters, two for longer ones, none for shorter ones.

Around every hit a window of ``WINDOW`` words is read: a hit between quotation marks or next to a word of reporting
counts as quotation, others as abuse, the more with further hits in the window. A logistic regression on those sums
gives the score.

Lexicon and regression are fitted from at most ``SAMPLE`` labelled rows, those with the smallest hashes of their ids;
that bound holds at any size. Every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.llm.common import hash60, materialise, slices

SAMPLE = 20_000
LEXICON = 512
LEAST_ODDS = 2.0
WINDOW = 8
REMEMBERED = 300_000
WORDS = re.compile(r"[^\W\d_]+")
#: Words that introduce what others said.
REPORTING = {
    "said", "says", "called", "calls", "quoted", "quote", "wrote", "writes", "reported", "word", "term", "slur",
    "dit", "disait", "mot", "terme", "sagte", "schrieb", "wort", "dijo", "escribió", "palabra", "término",
}
QUOTES = re.compile("[\"“”„«»]")


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Trie:
    """Lexicon terms by their letters; ``search`` intersects it with the automata of many words at once."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.longest = max((len(t) + edits(t) for t in terms), default=0)
        self.letters = {c: k for k, c in enumerate(sorted({c for t in terms for c in t}))}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.most: list[int] = [0]  # edits that any term below allows
        for k, term in enumerate(terms):
            at = 0
            self.most[0] = max(self.most[0], edits(term))
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.most.append(0)
                at = self.children[at][c]
                self.most[at] = max(self.most[at], edits(term))
            self.ends[at] = k

    def search(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """Word to (term, edits) for words within the bound of a term: fewest edits, then the first term."""
        words = [w for w in words if len(w) <= self.longest]
        if not words or not self.terms:
            return {}
        n, width = len(words), self.longest
        codes = np.zeros((n, width), np.uint32)
        lengths = np.array([len(w) for w in words])
        joined = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[np.arange(width)[None, :] < lengths[:, None]] = joined
        powers = np.uint64(2) << np.arange(width, dtype=np.uint64)
        masks = [((codes == ord(c)) * powers).sum(1, dtype=np.uint64) for c in self.letters]
        accept = np.uint64(1) << lengths.astype(np.uint64)
        valid = (accept << np.uint64(1)) - np.uint64(1)
        best = np.full((n, 2), 99)
        one = np.uint64(1)
        stack = [(0, np.arange(n), [valid & np.uint64((2 << d) - 1) for d in range(self.most[0] + 1)])]
        while stack:
            node, alive, states = stack.pop()
            if (term := self.ends[node]) >= 0:
                for d in range(edits(self.terms[term]) + 1):
                    hit = alive[(states[d] & accept[alive]) != 0]
                    better = hit[(best[hit, 0] > d) | ((best[hit, 0] == d) & (best[hit, 1] > term))]
                    best[better] = d, term
            for c, child in self.children[node].items():
                mask = masks[self.letters[c]][alive]
                after: list[np.ndarray] = []
                for d in range(self.most[child] + 1):
                    s = states[d] << one & mask
                    if d:
                        s |= states[d - 1] << one | states[d - 1] | after[d - 1] << one
                    after.append(s & valid[alive])
                some = after[-1] != 0
                if some.any():
                    stack.append((child, alive[some], [s[some] for s in after]))
        return {words[k]: (int(best[k, 1]), int(best[k, 0])) for k in np.flatnonzero(best[:, 0] < 99)}


def _context(text: str, hits: dict[str, tuple[int, int]], weights: np.ndarray) -> np.ndarray:
    """Sums over a text's hits: abuse by exact terms, by misspelled ones, quotation, the worst window, hits a word."""
    found = list(WORDS.finditer(text))
    words = [m.group() for m in found]
    at = [k for k, w in enumerate(words) if w in hits]
    marks = np.array([m.start() for m in QUOTES.finditer(text)], int)
    out, worst, near = np.zeros(3), 0.0, np.array(at)
    for k in at:
        term, d = hits[words[k]]
        value = weights[term]
        window = words[max(0, k - WINDOW) : k + WINDOW + 1]
        line = text.rfind("\n", 0, found[k].start()) + 1
        inside = (np.searchsorted(marks, found[k].start()) - np.searchsorted(marks, line)) % 2 == 1
        quoted = inside or not REPORTING.isdisjoint(window)
        out[2 if quoted else (1 if d else 0)] += value
        if not quoted:
            others = np.searchsorted(near, k + WINDOW, "right") - np.searchsorted(near, k - WINDOW) - 1
            worst = max(worst, value * (0.5 if d else 1.0) * (1 + 0.5 * others))
    return np.array([*np.log1p(out), worst, 100 * len(at) / max(1, len(words))])


class Model:
    """Lexicon, weights of its terms and the regression; a few hundred KB at most."""

    def __init__(self, terms: list[str], weights: np.ndarray):
        self.terms, self.weights = terms, weights
        self.coefs, self.mean, self.scale = np.zeros(6), np.zeros(5), np.ones(5)
        self.prepare()

    def prepare(self) -> None:
        self.trie, self.seen, self.hits = Trie(self.terms), set(), {}

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("terms", "weights", "coefs", "mean", "scale")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.prepare()

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row of context sums for each whole text; null and empty texts have zeros."""
        lowered = [(t or "").lower() for t in texts]
        distinct = [set(WORDS.findall(t)) for t in lowered]
        if len(self.seen) > REMEMBERED:
            self.seen, self.hits = set(), {}
        new = set().union(*distinct) - self.seen
        self.seen |= new
        self.hits |= self.trie.search(sorted(new))
        known, out = self.hits.keys(), np.zeros((len(texts), 5))
        for k, words in enumerate(distinct):
            if some := words & known:
                out[k] = _context(lowered[k], {w: self.hits[w] for w in some}, self.weights)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton's method with a ridge."""
        if len(y) == 0:
            self.coefs[-1] = -2.0
            return
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(y))])
        w, ridge = np.zeros(6), np.diag([*[1e-2 * max(1, len(y) ** 0.5)] * 5, 1e-6])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w -= np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
        self.coefs = w

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.coefs[:5] + self.coefs[5], -30, 30)))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """A model from the rows of ``docs`` that ``labels`` marks by ``toxic`` 0 or 1; at most ``sample`` of them.

    Null ids, texts and labels teach nothing; an id with several labels counts as toxic if one says so. Without any
    labelled row the lexicon is empty and every score is the same small value.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    chosen = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(hash60("doc_id"), "doc_id").limit(sample)
    # ``sample`` ids and flags are broadcast, no more; an id that many rows share teaches the smallest of their texts, so
    # what is collected keeps to the bound. Of equal texts with several labels, one that says toxic counts.
    each = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = materialise(each.groupBy("text").agg(F.max("toxic").alias("toxic")))
    words = rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    total = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = float(total.t or 0), float(total.n - (total.t or 0))
    counts = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    few = max(3.0, 0.005 * toxic)
    lexicon = counts.select("word", "t", odds.alias("odds")).where((F.col("odds") >= LEAST_ODDS) & (F.col("t") >= few) & (F.length("word").between(3, 40)))
    best = lexicon.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "word").limit(LEXICON).collect()
    model = Model([r.word for r in best], np.array([r.odds for r in best]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = shared.value.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(x[:, k]) for k in range(5)]], ["toxic", *[f"x{k}" for k in range(5)]])

    made = rows.mapInArrow(run, "toxic int, " + ", ".join(f"x{k} double" for k in range(5))).toPandas()
    made = made.sort_values(list(made.columns)).to_numpy(float)
    model.fit(made[:, 1:], np.minimum(1.0, made[:, 0]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` and toxicity (0 to 1) of every whole text; a column of that name is replaced.

    Null and empty texts are scored as texts without a hit; rows stay one to one.
    """
    docs = docs.drop("toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            said = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.float64())], [*batch.schema.names, "toxicity"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", toxicity double")


def trained(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return fit(rows.where(~held_out()), labels.where(~held_out()), sample=sample)


def rate(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; rows stay one to one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    said = score(rows, trained(docs, labels, sample=sample))
    return said.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
