"""Near-duplicate documents by Order MinHash.

Documents are sequences of five-word shingles, each labelled with its occurrence. For each of ``BANDS`` hash functions
the ``PICKED`` shingles with the smallest hashes are taken and kept in the order of the text: two documents have equal
sketches if they share those shingles in that order, which follows their edit similarity. Two documents are linked if a
banded alignment of their shingles matches M of them in order with M / (n1 + n2 - M) >= ``SIMILARITY``; a match further
from the diagonal than the band cannot be part of such an alignment, so the band loses nothing.

Exact copies are one text. Each text is compared with the first of one of its buckets. Buckets whose members are not in
one class by then are exhausted: each two members are compared unless they are in one class already. While a bucket has
more than ``BLOCK`` texts outside its largest class, its members meet another one of them first, as copies of one text
soon are one class so. If ``MANY`` blocks are left, as common passages make them, it is refined, without loss: of similar texts
each has at least four fifths of its shingles in common with the other, so in any one order of all shingles they share
one of the first fifth (and one more) of either. The order is from rare to common, so passages that many texts hold lead
nowhere. The rest is compared block by block, spread over tasks, the largest class of a bucket in blocks of its own. A
link is found whenever its documents share a bucket. Texts of few shingles,
which a sketch of six tells apart too well, have keys by which similar ones always share a bucket.

Linked texts form classes; a class is named by its smallest document id.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.common import LAST_ID, documents, materialise, slices
from partita.llm.shingles import labelled, mix, shingle_hashes

BANDS = 32
PICKED = 6
SIMILARITY = 0.8
#: Texts of at most so many shingles have exact keys as well.
SHORT = 12
#: Texts and bytes of a block of a bucket; each two blocks are compared in one group.
BLOCK = 256
#: Blocks of texts outside the largest class from which a bucket is refined first: up to there comparing blocks takes less
#: than the keys of a fifth of all shingles.
MANY = 4
#: Rounds in which members of large buckets meet one of them, before what is left is exhausted. They end sooner once a
#: smaller share than ``LEAST_LINKED`` of those that met are linked: what is left is exhausted in any case.
ROUNDS = 6
LEAST_LINKED = 0.1
BLOCK_BYTES = 8 << 20
#: Cells in which shingles are counted, to tell rare from common ones.
CELLS = 1 << 16
#: Shingles for which all hash functions are computed at once.
AT_ONCE = 1 << 16


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def exact_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of which a text of at most ``SHORT`` labelled shingles shares one with every similar one.

    Of n shingles a similar text has at least c = 0.8 n, so the two smallest that they have in common, by hash, are among
    the n - c + 2 smallest of either. Each two of those are a key: six at most. A single shingle is a key by itself.
    """
    n = len(shingles)
    c = int(np.ceil(SIMILARITY * n - 1e-9))
    first = mix(np.sort(shingles)[: n - c + min(2, c)] + np.uint64(BANDS))
    if c < 2:
        return first.view(np.int64)
    i, j = np.triu_indices(len(first), 1)
    return np.unique(mix(first[i] * np.uint64(3) + first[j])).view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The sketches of a text from its labelled shingles: one 64-bit number for each hash function.

    A short text has exact keys, and sketches besides only if longer ones than ``SHORT`` may be similar to it.
    """
    n, by = len(shingles), _multipliers()
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= SHORT and SIMILARITY * (n + SHORT + 1) / (1 + SIMILARITY) > n + 1e-9:
        return exact_keys(shingles)
    parts = []
    for some in np.array_split(by, 1 if n <= AT_ONCE else BANDS):
        h = some[:, None] * shingles[None, :]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        parts.append(np.argpartition(h, PICKED - 1, axis=1)[:, :PICKED])
    places = np.sort(np.concatenate(parts), axis=1)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(places.shape[1]):
        out = mix(out + shingles[places[:, k]])
    return np.concatenate([out.view(np.int64), exact_keys(shingles)]) if n <= SHORT else out.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """True if a banded alignment of two texts' labelled shingles reaches the similarity."""
    n = len(a) + len(b)
    needed = least * n / (1 + least) - 1e-9
    if not n or min(len(a), len(b)) < needed:
        return False
    _, at, of = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(at)
    at, of = at[order], of[order]
    of = of[np.abs(at - of) <= n - 2 * needed + 1]
    if len(of) < needed:
        return False
    if (np.diff(of) > 0).all():
        return True
    tails: list[int] = []  # longest increasing run of places: by length, the smallest last place
    for j in of.tolist():
        k = bisect_left(tails, j)
        tails[k : k + 1] = [j]
    return len(tails) >= needed


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (128 bits of the text) and bands (empty for a text without words) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [sketch(labelled(shingle_hashes(t or ""))) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, made)], dtype=np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *made])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h1"), batch.column("h2"), bands], ["doc_id", "h1", "h2", "bands"])

    rows = documents(docs).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).mapInArrow(run, "doc_id long, h1 long, h2 long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """first, node, linked of every pair: both texts are fetched and aligned."""
    a, b = [texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"{side}_text")) for side in ("first", "node")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known: dict[int, np.ndarray] = {}
            said = []
            for i, j, s, t in zip(*(batch.column(c).to_pylist() for c in ("first", "node", "first_text", "node_text")), strict=True):
                if i not in known:
                    known[i] = labelled(shingle_hashes(s))
                said.append(similar(known[i], labelled(shingle_hashes(t))))
            yield pa.RecordBatch.from_arrays([batch.column("first"), batch.column("node"), pa.array(said, pa.bool_())], ["first", "node", "linked"])

    return pairs.join(b, "node").join(a, "first").select("first", "node", "first_text", "node_text").mapInArrow(run, "first long, node long, linked boolean")


def _with_first(members: DataFrame) -> DataFrame:
    """bucket, node, first for buckets with several members, but for the first one itself."""
    firsts = members.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where(F.col("first") < F.col("last")).select("bucket", "first")
    return members.join(firsts, "bucket").where(F.col("node") > F.col("first"))


def _mixed(members: DataFrame) -> DataFrame:
    """bucket, n, first, last, major (its largest class) and others (texts outside it) of buckets that hold several classes.

    ``members`` has bucket, node, class. Buckets of the same members count once.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"mark{k}") for k in range(2)]
    parts = members.groupBy("bucket", "class").agg(F.count("*").alias("c"), F.min("node").alias("first"), F.max("node").alias("last"), *marks)
    most = F.max(F.struct("c", "class")).alias("most")
    sets = parts.groupBy("bucket").agg(F.count("*").alias("classes"), F.sum("c").alias("n"), most, F.min("first").alias("first"), F.max("last").alias("last"), *[F.bit_xor(f"mark{k}").alias(f"mark{k}") for k in range(2)])
    one = F.min(F.struct("bucket", F.col("most.class").alias("major"), (F.col("n") - F.col("most.c")).alias("others"))).alias("b")
    return sets.where("classes > 1").groupBy("n", "first", "last", "mark0", "mark1").agg(one).select("n", "first", "last", "b.*")


def _joined(named: DataFrame, found: DataFrame) -> DataFrame:
    """node and class of ``named`` once the links of ``found`` (first, node) join classes: of all links, only new ones are walked."""
    sides = [named.select(F.col("node").alias(side), F.col("class").alias(f"{side}_class")) for side in ("first", "node")]
    ends = [F.coalesce(f"{side}_class", side) for side in ("first", "node")]
    between = found.join(sides[0], "first", "left").join(sides[1], "node", "left").select(F.least(*ends).alias("first"), F.greatest(*ends).alias("node"))
    over = components(between.where(F.col("first") < F.col("node")))
    old = named.join(over.select(F.col("node").alias("class"), F.col("class").alias("next")), "class", "left").select("node", F.coalesce("next", "class").alias("class"))
    return materialise(old.union(over.join(named, "node", "left_anti")))


def _shared(grouped: DataFrame, known: DataFrame, named: DataFrame) -> DataFrame:
    """bucket, node, class, major, others of the buckets that still hold texts of different classes, by ``named`` (node, class).

    Two texts that ``known`` holds already do not count.
    """
    every = grouped.select("bucket", "node").union(grouped.select("bucket", F.col("first").alias("node"))).distinct()
    members = materialise(every.join(named, "node", "left").select("bucket", "node", F.coalesce("class", "node").alias("class")))
    compared = known.select(F.least("first", "node").alias("first"), F.greatest("first", "node").alias("last"), F.lit(2).cast("long").alias("n")).distinct()
    return materialise(members.join(_mixed(members).join(compared, ["first", "last", "n"], "left_anti").select("bucket", "major", "others"), "bucket"))


def _met(large: DataFrame, turn: int) -> DataFrame:
    """first, node: every member with one of another class that is the chosen one of most of its buckets in this turn."""
    chosen = large.groupBy("bucket").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), F.col("node").alias("first"), F.col("class").alias("of"))).alias("c")).select("bucket", "c.first", "c.of")
    pairs = large.join(chosen, "bucket").where(F.col("class") != F.col("of")).groupBy("first", "node").agg(F.count("*").alias("shared"))
    return _best(pairs)


def _best(pairs: DataFrame) -> DataFrame:
    best = pairs.groupBy("node").agg(F.max(F.struct("shared", (-F.col("first")).alias("first"))).alias("b"))
    return best.select((-F.col("b.first")).alias("first"), "node")


def first_shingles(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of a text's shingles, from rare to common, those of which every similar text has one among its own."""
    n = len(shingles)
    order = np.lexsort((shingles, counts[shingles % np.uint64(CELLS)]))
    return shingles[order[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]]


def _refined(members: DataFrame, texts: DataFrame) -> DataFrame:
    """bucket, node, class, major, others: texts by the rare shingles they share, for the members (node, class) of large buckets."""
    rows = materialise(texts.select(F.col("doc_id").alias("node"), "text").join(members.hint("merge"), "node"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in slices(batches):
            for t in batch.column("text").to_pylist():
                total += np.bincount((labelled(shingle_hashes(t)) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["cell", "n"])

    counts = np.zeros(CELLS, np.int64)
    for r in rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most ``CELLS`` rows
        counts[r.cell] = r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [first_shingles(labelled(shingle_hashes(t)), counts).view(np.int64) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("class"), listed], ["node", "class", "keys"])

    keyed = materialise(rows.mapInArrow(run, "node long, class long, keys array<long>").select("node", "class", F.explode("keys").alias("bucket")))
    return materialise(keyed.join(_mixed(keyed).select("bucket", "major", "others"), "bucket"))


def _compared(block: pa.Table) -> pa.Table:
    """first, node: links between two blocks of a bucket, or inside one. Each two texts that are not in one class by then are compared.

    Counts of common shingles bound the similarity, so only what may reach it is aligned.
    """
    ids, names, own, i, j = (block.column(c).to_numpy() for c in ("node", "class", "own", "i", "j"))
    made = [labelled(shingle_hashes(t)) for t in block.column("text").to_pylist()]
    sizes = np.array([len(m) for m in made])
    kinds, place = np.unique(np.concatenate(made), return_inverse=True)
    whose, ends = np.repeat(np.arange(len(made)), sizes), np.cumsum([0, *sizes])
    _, group = np.unique(names, return_inverse=True)
    within, found = i[0] == j[0], []
    for a in np.flatnonzero(own == i):
        others = (own == j) & (group != group[a])
        if within:
            others[: a + 1] = False
        if not others.any():
            continue
        has = np.zeros(len(kinds), bool)
        has[place[ends[a] : ends[a + 1]]] = True
        common = np.bincount(whose[has[place]], minlength=len(made))
        for b in np.flatnonzero(others & (common >= SIMILARITY * (sizes + sizes[a]) / (1 + SIMILARITY) - 1e-9)):
            if group[a] != group[b] and similar(made[a], made[b]):
                found.append(sorted((int(ids[a]), int(ids[b]))))
                group[group == group[b]] = group[a]
    return pa.table({"first": pa.array([x for x, _ in found], pa.int64()), "node": pa.array([x for _, x in found], pa.int64())})


def _exhausted(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """first, node: links among all texts of each bucket."""
    large = materialise(shared.where(F.col("others") > MANY * BLOCK).select("node", "class").distinct())
    small = _in_blocks(shared.where(F.col("others") <= MANY * BLOCK), texts)
    return small if large.isEmpty() else small.union(_in_blocks(_refined(large, texts), texts))


def _in_blocks(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """first, node: links among all texts of each bucket, compared in blocks.

    The largest class of a bucket and all other members are dealt into blocks of at most about ``BLOCK`` texts and
    ``BLOCK_BYTES`` bytes each, and each two blocks are one group, so a hot bucket is spread over many tasks. Two blocks
    of one and the same class have nothing to compare.
    """
    words = texts.select(F.col("doc_id").alias("node"), "text")
    is_major = F.col("class") == F.col("major")
    sized = materialise(shared.join(words.select("node", F.octet_length("text").cast("long").alias("size")), "node"))
    needed = lambda which: F.ceil(F.greatest(F.count(F.when(which, 1)) / BLOCK, F.coalesce(F.sum(F.when(which, F.col("size"))), F.lit(0)) / BLOCK_BYTES))
    parts = sized.groupBy("bucket").agg(needed(is_major).alias("p"), needed(~is_major).alias("q"))
    h = F.xxhash64("node")
    own = F.when(is_major, F.pmod(h, F.greatest("p", F.lit(1)))).otherwise(F.col("p") + F.pmod(h, F.greatest("q", F.lit(1))))
    dealt = sized.join(parts, "bucket").select("bucket", "node", "class", own.alias("own"))
    blocks = dealt.groupBy("bucket", "own").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    left, right = [blocks.select("bucket", F.col("own").alias(c), F.col("low").alias(f"{c}_low"), F.col("high").alias(f"{c}_high")) for c in ("i", "j")]
    pairs = left.join(right, "bucket").where((F.col("i") <= F.col("j")) & (F.least("i_low", "j_low") < F.greatest("i_high", "j_high"))).select("bucket", "i", "j")
    sides = pairs.withColumn("own", F.col("i")).union(pairs.where("i < j").withColumn("own", F.col("j")))
    rows = dealt.join(sides, ["bucket", "own"]).join(words, "node").select("bucket", "i", "j", "own", "node", "class", "text")
    return rows.groupBy("bucket", "i", "j").applyInArrow(_compared, "first long, node long")


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """first, node: pairs of similar texts, by the ids that stand for them. ``nodes`` has node and bands.

    Each node is first compared with the text it shares most buckets with; a bucket whose members are in one class by
    then is done, so a large class costs a comparison for each member. In all others every pair of classes is compared.
    """
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    grouped = materialise(_with_first(members))
    pairs = materialise(grouped.groupBy("first", "node").agg(F.count("*").alias("shared")))
    wanted = pairs.select("node").union(pairs.select(F.col("first").alias("node"))).distinct().withColumnRenamed("node", "doc_id")
    rows = documents(docs).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The wanted ids grow with the table, so both sides are shuffled at any size.
    texts = materialise(rows.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    known = materialise(_verified(_best(pairs), texts))
    named = components(known.where("linked").select("first", "node"))
    shared = _shared(grouped, known, named)
    for turn in range(ROUNDS):
        large = shared.where(F.col("others") > BLOCK)
        if large.isEmpty():
            break
        met = materialise(_verified(_met(large, turn), texts))
        known = known.union(met)
        if (met.agg(F.avg(F.col("linked").cast("int"))).first()[0] or 0.0) < LEAST_LINKED:
            break
        named = _joined(named, met.where("linked").select("first", "node"))
        shared = _shared(grouped, known, named)
    return known.where("linked").select("first", "node").union(materialise(_exhausted(shared, texts))).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node and class (its smallest node) for every node of ``pairs`` (first, node).

    Each round a node takes the smallest class among its neighbours and then the class of that class.
    """
    edges = materialise(pairs.select(F.col("first").alias("a"), F.col("node").alias("b")).union(pairs.select("node", "first")).distinct())
    state = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("class")))
    while True:
        near = edges.join(state.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        lower = state.join(near, "node").select("node", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        over = state.select(F.col("node").alias("class"), F.col("class").alias("next"))
        state = materialise(lower.join(over, "class", "left").select("node", "old", F.least("class", F.coalesce("next", "class")).alias("class")))
        if state.where("class < old").isEmpty():
            return state.select("node", "class")
        state = state.select("node", "class")


def _named(made: DataFrame, docs: DataFrame) -> DataFrame:
    """h1, h2, node and class of every distinct text with words: its smallest id, and that of its class."""
    worded = made.where(F.size("bands") > 0)
    distinct = materialise(worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    found = components(links(distinct.select("node", "bands"), docs))
    return distinct.select("h1", "h2", "node").join(found, "node", "left").select("h1", "h2", "node", F.coalesce("class", "node").alias("class"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every document; class_id is the smallest document id of its class.

    Null and empty texts, and texts without words, are in no class but their own, exact copies of any other text in one
    class. Rows stay one to one; a null id counts as the last and gets its class's id, or null if alone; rows that share
    an id count as one document in links, and rows with equal texts always are in one class.
    """
    made = materialise(sketches(docs))
    named = _named(made, docs).drop("node")
    joined = made.withColumn("worded", F.size("bands") > 0).drop("bands").join(named, ["h1", "h2"], "left")
    out = joined.select("doc_id", F.when(F.col("worded"), F.col("class")).otherwise(F.col("doc_id")).alias("class_id"))
    return out.select(*[F.when(F.col(c) != LAST_ID, F.col(c)).alias(c) for c in ("doc_id", "class_id")])


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text) but for copies: of each class one row stays, with its smallest id.

    Texts without words all stay. Of rows that share that id and the text, the first by their other columns stays.
    """
    made = materialise(sketches(docs))
    named = _named(made, docs)
    worded = made.where(F.size("bands") > 0).groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("n"))
    marked = materialise(worded.join(named, ["h1", "h2"]).select("doc_id", "h1", "h2", "n", ((F.col("node") == F.col("class")) & (F.col("doc_id") == F.col("node"))).alias("stays")))
    rows = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h1"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("_h2"))
    key = lambda t: t.select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    on = ["_id", "_h1", "_h2"]
    alone = rows.join(materialise(key(marked.where(~F.col("stays") | (F.col("n") > 1)))), on, "left_anti").select(docs.columns)
    several = rows.join(materialise(key(marked.where(F.col("stays") & (F.col("n") > 1)))), on, "left_semi")
    return alone.union(several.groupBy(*on).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))
