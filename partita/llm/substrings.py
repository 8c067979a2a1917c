"""Substring dedup by suffix arrays: bytes of strings that also start in an earlier document are removed.

Documents are dealt into shards of about ``SHARD_BYTES`` by id hash. A string of ``LENGTH`` bytes always contains the
same least hash of its ``GRAM``-byte grams, wherever it stands: its key. Neighbouring starts with one key are a run, and
the bytes of their strings are the run's context.

1. Each shard sends its keys, once each, to hash buckets; buckets answer which other shards have as well. What has no
   answer and is in one document of its shard only cannot be a repeated string and is set aside; nothing else is.
2. A key with several contexts in some shard is taken string by string: shards build a suffix array over its contexts
   by Larsson-Sadakane refinement (8 bytes, then doubling, ties refined only) and common prefixes by Kasai's
   recurrence; suffixes that share ``LENGTH`` bytes are one string, sent once as a fingerprint with the smallest id.
3. Of other keys a shard has one context. If it is the same in all shards, its fingerprint is sent; if not, its bytes
   are, and buckets build the same arrays over them.
4. Sorted runs of fingerprints and contexts are merged by binary search; each shard gets back the smallest id over all
   shards of what is repeated, and marks the bytes of its documents with larger ids.

A shard sends a key, context or string once, however many of its documents hold it; and the many contexts around a
passage that a third of all documents hold are spread string by string. So no task's input grows with a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.common import LAST_ID, documents
from partita.llm.shingles import mix

LENGTH = 50
DEPTH = 64
GRAM = 24
LONGEST_RUN = 64
#: Bytes of contexts over which one suffix array is built.
AT_ONCE = 1 << 18
SHARD_BYTES = 2 << 20
#: Text whose strings meet in one bucket.
BUCKET_BYTES = 2 << 20
SEPARATOR = 255  # no byte of UTF-8
#: How a key is taken.
SAME, BY_CONTEXT, BY_STRING = 0, 1, 2
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        full = np.full(max(n, 1 << 16), np.uint64(base))
        full[0] = 1
        _powers[base] = np.multiply.accumulate(full)
    return _powers[base][:n]


class _Hashes:
    """Hashes of any substrings of a buffer, from sums over its beginnings."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, self.n))])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _power(_INVERSE, self.n + 1)[starts] + (ends - starts).astype(np.uint64))

    def rolling(self, size: int) -> np.ndarray:
        """Of the ``size`` bytes from each place, as far as they reach."""
        m = self.n - size + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:-size]) * _power(_INVERSE, m) + np.uint64(size))


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` numbers from each place."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


class Shard:
    """Texts one after the other: bytes, document ids, and which places start a whole string."""

    def __init__(self, table: pa.Table):
        pa.default_memory_pool().release_unused()  # of the group before
        texts = pa.concat_arrays(table.column("text").cast(pa.large_binary()).chunks)
        self.ids = table.column("doc_id").to_numpy()
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.sizes = np.diff(offsets)
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.hashes = _Hashes(self.data)

    def starts(self) -> np.ndarray:
        """True for places from which a whole string lies in one document."""
        n = max(0, len(self.data) - LENGTH + 1)
        step = np.zeros(n + 1, np.int8)
        some = self.sizes >= LENGTH
        step[(self.ends - self.sizes)[some]] = 1
        stop = self.ends[some] - LENGTH + 1
        np.add.at(step, stop[stop <= n], -1)
        return np.cumsum(step[:n]) > 0

    def keys(self) -> np.ndarray:
        """For each place the least gram hash of the string that starts there."""
        return _window_least(self.hashes.rolling(GRAM), LENGTH - GRAM + 1)

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: high bytes, mostly equal, stand together and shrink when shuffled."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _bucketed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Sorted hashes to buckets by their highest bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(_bucketed(sorted_hashes, buckets), np.arange(buckets + 1))


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their first ``depth`` bytes (8 times a power of two), and the 8 bytes from each place."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k : k + n]
    order = np.argsort(words, kind="stable")
    fresh = np.concatenate([[True], np.diff(words[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    sorted_to = 8
    while sorted_to < depth:
        alone = fresh & np.concatenate([fresh[1:], [True]])
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        suffixes = order[at]
        after = suffixes + sorted_to
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        both = rank[suffixes] * (n + 1) + second + 1
        by = np.argsort(both, kind="stable")
        order[at], both = suffixes[by], both[by]
        fresh[at] |= np.concatenate([[True], np.diff(both) != 0])
        rank[order[at]] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))[at]
        sorted_to *= 2
    return order, words


def common_prefixes(order: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Bytes, up to ``most``, that each suffix shares with the one before it in order, by Kasai's recurrence.

    The text is cut into lanes that go through the recurrence side by side; within a lane each place starts from one
    byte less than the place before it. Suffixes that tie in the ``most`` bytes by which they are sorted say nothing
    about the order of their successors, so after a tie a place starts from none.
    """
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    out = np.zeros(n, np.int64)
    steps = 64
    first = np.arange(0, n, steps)
    h = np.zeros(len(first), np.int64)
    zero = [np.uint64(1) << np.uint64(8 * k) for k in range(8)]
    for t in range(steps):
        i = first + t
        if i[-1] >= n:
            i, h = i[:-1], h[:-1]
            first = first[:-1]
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        h = np.where(h >= most, 0, np.maximum(h - 1, 0))
        going = np.flatnonzero(r > 0)
        h[r == 0] = 0
        while len(going):
            a, b = i[going] + h[going], j[going] + h[going]
            inside = (a < n) & (b < n)
            x = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
            same = sum((x < z).astype(np.int64) for z in zero)
            same = np.where(inside, np.minimum(same, n - np.maximum(a, b)), 0)
            h[going] = np.minimum(h[going] + same, most)
            going = going[(same == 8) & (h[going] < most)]
        out[r] = h
    return out


def _runs(shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts that share a key: first place, one past the last, key. Longer ones, of repetitive text, are cut."""
    ok, keys = shard.starts(), shard.keys()
    edge = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ok[1:] != ok[:-1])]) if len(keys) else np.zeros(0, bool)
    a = np.flatnonzero(edge)
    # A document's last start and the next one's first are apart by at least one place that starts nothing.
    b = np.concatenate([a[1:], [len(keys)]]) if len(a) else a
    live = ok[a] if len(a) else np.zeros(0, bool)
    a, b = a[live], b[live]
    pieces = -(-(b - a) // LONGEST_RUN)
    run = np.repeat(np.arange(len(a)), pieces)
    start = a[run] + LONGEST_RUN * (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return start, np.minimum(start + LONGEST_RUN, b[run]), keys[start]


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Places in sorted columns where a new row of values begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))


class Contexts:
    """The distinct contexts of a shard by key: place of one run, smallest and largest id, and how many a key has."""

    def __init__(self, shard: Shard):
        a, b, keys = _runs(shard)
        ids, same = shard.ids[shard.document_of(a)], shard.hashes.of(a, b + LENGTH - 1)
        order = np.argsort(same, kind="stable")
        first = _firsts(same[order])
        least, most = [f.reduceat(ids[order], first) if len(first) else ids for f in (np.minimum, np.maximum)]
        one = order[first]
        by = np.argsort(keys[one], kind="stable")
        one, self.least, self.most = one[by], least[by], most[by]
        self.a, self.b, self.keys, self.hash = a[one], b[one], keys[one], same[one]
        self.key_first = _firsts(self.keys)
        self.per_key = np.diff(np.concatenate([self.key_first, [len(first)]]))
        self.key_of = np.repeat(np.arange(len(self.key_first)), self.per_key)
        self.several = np.zeros(0, bool)
        if len(first):
            self.several = np.minimum.reduceat(self.least, self.key_first) != np.maximum.reduceat(self.most, self.key_first)


def _code(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low 32 bits of keys, as buckets know them."""
    return _bucketed(keys, buckets).astype(np.uint64) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)


def _gathered(data: np.ndarray, a: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of several substrings one after the other, and the place each comes from."""
    ends = np.cumsum(sizes)
    source = np.repeat(a - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    return data[source], source


def _strings(data: np.ndarray, a: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every start in contexts at ``a`` with so many ``starts``: the context, the place in it, the string's number.

    Equal strings have one number; they stand together. Contexts come in order of their keys; as strings with different
    keys differ, one array is built at a time, over the keys that fill ``AT_ONCE`` bytes.
    """
    first = _firsts(keys)
    part = np.cumsum(starts + LENGTH)[np.maximum(first - 1, 0)] // AT_ONCE
    cuts = [*first[_firsts(part)].tolist(), len(a)]
    found, number = [], 0
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        context, inside, group = _sorted_strings(data, a[x:y], starts[x:y])
        found.append((context + x, inside, group + number))
        number += int(group[-1]) + 1
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _sorted_strings(data: np.ndarray, a: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = starts + LENGTH  # a byte more than the strings, for the separator
    ends = np.cumsum(sizes)
    buffer = np.full(int(ends[-1]), SEPARATOR, np.uint8)
    owner = np.repeat(np.arange(len(a)), sizes)
    inside = np.arange(len(buffer)) - (ends - sizes)[owner]
    text = inside < sizes[owner] - 1
    buffer[text] = data[(a[owner] + inside)[text]]
    order, words = suffix_array(buffer, DEPTH)
    group = np.cumsum(common_prefixes(order, words, DEPTH) < LENGTH)
    valid = (inside < starts[owner])[order]
    at = order[valid]
    return owner[at], inside[at], group[valid]


def _text_shards(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, shard; and the number of buckets for that much text."""
    rows = documents(docs).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = max(1, -(-size // SHARD_BYTES))
    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")), max(1, -(-size // BUCKET_BYTES))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the other bytes) of every document.

    A null text counts as empty; a null id as the last one; rows that share an id do not remove each other's strings.
    Rows stay one to one, and texts shorter than a string lose nothing.
    """
    rows, buckets = _text_shards(docs)
    shards = rows.groupBy("shard")

    def rows_of(table: pa.Table, kind: int, cuts: np.ndarray, columns: list) -> pa.Table:
        """A row for each bucket that gets something; ``columns`` are functions from a slice to bytes."""
        some = [(k, int(x), int(y)) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
        shard = table.column("shard")[0].as_py()
        fixed = [pa.array(v, pa.int32()) for v in ([kind] * len(some), [k for k, _, _ in some], [shard] * len(some))]
        return pa.table([*fixed, *[pa.array([f(x, y) for _, x, y in some], pa.binary()) for f in columns]], schema=sent)

    def send_keys(table: pa.Table) -> pa.Table:
        c = Contexts(Shard(table))
        keys, mixed = c.keys[c.key_first], c.per_key > 1
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        context = (c.hash[c.key_first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return rows_of(table, 0, _cuts(keys, buckets), [lambda x, y: low[x:y].tobytes(), lambda x, y: np.packbits(mixed[x:y]).tobytes(), lambda x, y: context[x:y].tobytes(), *[lambda x, y: b""] * 2])

    def meet(table: pa.Table) -> pa.Table:
        """Low bits that several shards have, and how to take them: by strings, by contexts, or as one same context."""
        lists = [np.frombuffer(x, np.uint32) for x in table.column("a").to_pylist()]
        sizes = [len(x) for x in lists]
        flags = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(table.column("b").to_pylist(), sizes, strict=True)]).astype(bool)
        every, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes)
        contexts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("c").to_pylist()])
        order = np.argsort(every, kind="stable")
        first = _firsts(every[order])
        count = np.diff(np.concatenate([first, [len(every)]]))
        twice = np.concatenate([[False], (every[order][1:] == every[order][:-1]) & (owner[order][1:] == owner[order][:-1])])
        mixed = np.logical_or.reduceat(flags[order] | twice, first)
        alike = np.minimum.reduceat(contexts[order], first) == np.maximum.reduceat(contexts[order], first)
        shared, way = np.zeros(len(every), bool), np.zeros(len(every), np.uint8)
        shared[order], way[order] = np.repeat(count > 1, count), np.repeat(np.where(mixed, BY_STRING, np.where(alike, SAME, BY_CONTEXT)), count)
        ends = np.cumsum([0, *sizes])
        out = [(x[shared[i:j]], way[i:j][shared[i:j]]) for x, i, j in zip(lists, ends[:-1], ends[1:], strict=True)]
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "keys": pa.array([x.tobytes() for x, _ in out], pa.binary()), "ways": pa.array([w.tobytes() for _, w in out], pa.binary())})

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        """What may be repeated, as contexts (kind 0), strings (kind 1) and fingerprints of same contexts (kind 2)."""
        if not left.num_rows:
            return sent.empty_table()
        shard = Shard(left)
        c = Contexts(shard)
        if not len(c.keys):
            return sent.empty_table()
        codes = [np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(k) << np.uint64(32) for x, k in zip(right.column("keys").to_pylist(), right.column("bucket").to_pylist(), strict=True)]]
        ways = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(w, np.uint8) for w in right.column("ways").to_pylist()]])
        codes = np.concatenate(codes)
        order = np.argsort(codes, kind="stable")
        codes, ways = codes[order], ways[order]
        own = _code(c.keys[c.key_first], buckets)
        place = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
        shared = codes[place] == own if len(codes) else np.zeros(len(own), bool)
        way = np.where(c.per_key > 1, BY_STRING, np.where(shared, ways[place] if len(codes) else SAME, SAME))
        live, way = (shared | c.several)[c.key_of], way[c.key_of]

        same = np.flatnonzero(live & (way == SAME))
        same = same[np.argsort(c.hash[same], kind="stable")]
        twice = (c.least != c.most)[same]
        third = rows_of(left, 2, _cuts(c.hash[same], buckets), [
            lambda x, y: _planes(c.hash[same[x:y]]), lambda x, y: b"", lambda x, y: b"", lambda x, y: _planes(c.least[same[x:y]]), lambda x, y: np.packbits(twice[x:y]).tobytes(),
        ])

        whole = np.flatnonzero(live & (way == BY_CONTEXT))  # in the order of keys
        counts = (c.b - c.a)[whole]
        text, _ = _gathered(shard.data, c.a[whole], counts + LENGTH - 1)
        ends = np.concatenate([[0], np.cumsum(counts + LENGTH - 1)])
        several = (c.least != c.most)[whole]
        first = rows_of(left, 0, _cuts(c.keys[whole], buckets), [
            lambda x, y: _planes(c.keys[whole[x:y]]), lambda x, y: counts[x:y].astype(np.uint8).tobytes(), lambda x, y: text[ends[x] : ends[y]].tobytes(),
            lambda x, y: _planes(c.least[whole[x:y]]), lambda x, y: np.packbits(several[x:y]).tobytes(),
        ])

        parts = np.flatnonzero(live & (way == BY_STRING))
        if not len(parts):
            return pa.concat_tables([first, third])
        context, inside, group = _strings(shard.data, c.a[parts], (c.b - c.a)[parts], c.keys[parts])
        begin = _firsts(group)
        least, most = np.minimum.reduceat(c.least[parts][context], begin), np.maximum.reduceat(c.most[parts][context], begin)
        places = c.a[parts][context[begin]] + inside[begin]
        prints = shard.hashes.of(places, places + LENGTH)
        by = np.argsort(prints, kind="stable")
        prints, least, several_strings = prints[by], least[by], (least != most)[by]
        second = rows_of(left, 1, _cuts(prints, buckets), [
            lambda x, y: _planes(prints[x:y]), lambda x, y: b"", lambda x, y: b"", lambda x, y: _planes(least[x:y]), lambda x, y: np.packbits(several_strings[x:y]).tobytes(),
        ])
        return pa.concat_tables([first, second, third])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # of the group before
        kind = key[0].as_py()
        return merge_prints(kind, table) if kind else merge_contexts(table)

    def merge_prints(kind: int, table: pa.Table) -> pa.Table:
        prints = [_unplanes(x) for x in table.column("a").to_pylist()]
        least = [_unplanes(x).astype(np.int64) for x in table.column("d").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(p)].astype(bool) for x, p in zip(table.column("e").to_pylist(), prints, strict=True)]
        union = np.unique(np.concatenate(prints))
        smallest, count = np.full(len(union), LAST_ID), np.zeros(len(union), np.int64)
        places = [np.searchsorted(union, p) for p in prints]
        for at, ids, more in zip(places, least, several, strict=True):
            smallest[at] = np.minimum(smallest[at], ids)
            count[at] += 1 + more
        back = []
        for p, at, ids, more in zip(prints, places, least, several, strict=True):
            useful = (count[at] > 1) & (more | (smallest[at] < ids))
            back.append((p[useful], smallest[at][useful]))
        return answer(table, kind, [_planes(p) for p, _ in back], [b""] * len(back), [_planes(i) for _, i in back])

    def answer(table: pa.Table, kind: int, a: list[bytes], b: list[bytes], d: list[bytes]) -> pa.Table:
        return pa.table({"kind": pa.array([kind] * len(a), pa.int32()), "shard": table.column("shard"), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "d": pa.array(d, pa.binary())})

    def merge_contexts(table: pa.Table) -> pa.Table:
        keys = [_unplanes(x) for x in table.column("a").to_pylist()]
        sizes = [len(k) for k in keys]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("b").to_pylist()]).astype(np.int64)
        data = np.frombuffer(b"".join(table.column("c").to_pylist()), np.uint8)
        least = np.concatenate([_unplanes(x).astype(np.int64) for x in table.column("d").to_pylist()])
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(table.column("e").to_pylist(), sizes, strict=True)]).astype(bool)
        keys, ends = np.concatenate(keys), np.cumsum(counts + LENGTH - 1)
        starts = ends - (counts + LENGTH - 1)
        same = _Hashes(data).of(starts, ends)
        order = np.lexsort((same, keys))
        first = _firsts(keys[order], same[order])
        number = np.empty(len(keys), np.int64)  # of the distinct context
        number[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(keys)]])))
        smallest = np.minimum.reduceat(least[order], first)
        repeated = (np.diff(np.concatenate([first, [len(keys)]])) > 1) | np.logical_or.reduceat(several[order], first)
        one = order[first]
        key_first = _firsts(keys[one])
        alone = np.repeat(np.diff(np.concatenate([key_first, [len(one)]])) == 1, np.diff(np.concatenate([key_first, [len(one)]])))

        # Parts of distinct contexts with the smallest id of their strings: whole ones, and those told apart by strings.
        whole = np.flatnonzero(alone & repeated)
        part = [(whole, np.zeros(len(whole), np.int64), counts[one[whole]], smallest[whole])]
        differ = np.flatnonzero(~alone)
        if len(differ):
            context, inside, group = _strings(data, starts[one[differ]], counts[one[differ]], keys[one[differ]])
            begin = _firsts(group)
            length = np.diff(np.concatenate([begin, [len(group)]]))
            ids = np.repeat(np.minimum.reduceat(smallest[differ][context], begin), length)
            often = np.repeat((length > 1) | np.logical_or.reduceat(repeated[differ][context], begin), length)
            context, inside, ids = context[often], inside[often], ids[often]
            by = np.lexsort((inside, context))
            context, inside, ids = context[by], inside[by], ids[by]
            begin = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (inside[1:] != inside[:-1] + 1) | (ids[1:] != ids[:-1])])) if len(ids) else np.zeros(0, np.int64)
            part.append((differ[context[begin]], inside[begin], np.diff(np.concatenate([begin, [len(ids)]])), ids[begin]))
        which, offset, length, ids = [np.concatenate(x) for x in zip(*part, strict=True)]
        by = np.argsort(which, kind="stable")
        which, offset, length, ids = which[by], offset[by], length[by], ids[by]

        back, at = [], np.cumsum([0, *sizes])
        for i, j in zip(at[:-1], at[1:], strict=True):
            lo, hi = np.searchsorted(which, number[i:j]), np.searchsorted(which, number[i:j], side="right")
            entry = np.repeat(np.arange(i, j), hi - lo)
            segment = np.arange(int((hi - lo).sum())) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            useful = several[entry] | (ids[segment] < least[entry])
            entry, segment = entry[useful], segment[useful]
            back.append((_planes(same[entry]), np.stack([offset[segment], length[segment]], 1).astype(np.uint8).tobytes(), _planes(ids[segment])))
        return answer(table, 0, [x for x, _, _ in back], [x for _, x, _ in back], [x for _, _, x in back])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        if not left.num_rows:
            return schema.empty_table()
        shard = Shard(left)
        told = list(zip(*(right.column(c).to_pylist() for c in ("kind", "a", "b", "d")), strict=True))
        n = len(shard.data) + 1
        gone = np.zeros(n, np.int64)

        def cover(starts: np.ndarray, lengths: np.ndarray | int) -> None:
            gone[:] += np.bincount(starts, minlength=n) - np.bincount(starts + lengths - 1 + LENGTH, minlength=n)

        prints = np.concatenate([np.zeros(0, np.uint64), *[_unplanes(a) for kind, a, _, _ in told if kind == 1]])
        least = np.concatenate([np.zeros(0, np.int64), *[_unplanes(d).astype(np.int64) for kind, _, _, d in told if kind == 1]])
        if len(prints):
            by = np.argsort(prints, kind="stable")
            prints, least = prints[by], least[by]
            there = np.zeros(1 << 22, bool)
            there[prints >> np.uint64(42)] = True
            own = shard.hashes.of(at := np.flatnonzero(shard.starts()), at + LENGTH)
            some = there[own >> np.uint64(42)]
            at, own = at[some], own[some]
            place = np.minimum(np.searchsorted(prints, own), len(prints) - 1)
            cover(at[(prints[place] == own) & (least[place] < shard.ids[shard.document_of(at)])], 1)

        some = [t for t in told if t[0] != 1]
        if some:
            same = np.concatenate([_unplanes(a) for _, a, _, _ in some])
            ids = np.concatenate([_unplanes(d).astype(np.int64) for _, _, _, d in some])
            # Of a same context every start is meant, of others those told.
            spans = np.concatenate([np.frombuffer(b, np.uint8).reshape(-1, 2).astype(np.int64) if kind == 0 else np.tile([0, LONGEST_RUN], (len(a) // 8, 1)) for kind, a, b, _ in some])
            a, b, _ = _runs(shard)
            own = shard.hashes.of(a, b + LENGTH - 1)
            by = np.argsort(own, kind="stable")
            lo, hi = np.searchsorted(own[by], same), np.searchsorted(own[by], same, side="right")
            reply = np.repeat(np.arange(len(same)), hi - lo)
            run = by[np.arange(int((hi - lo).sum())) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
            later = shard.ids[shard.document_of(a[run])] > ids[reply]
            run, reply = run[later], reply[later]
            cover(a[run] + spans[reply, 0], np.minimum(spans[reply, 1], b[run] - a[run]))

        gone = np.cumsum(gone[:-1]) > 0
        before = shard.ends - shard.sizes
        removed = np.concatenate([[0], np.cumsum(gone)])
        opens = gone & ~np.concatenate([[False], gone[:-1]])
        opens[before[shard.sizes > 0]] = gone[before[shard.sizes > 0]]
        opened = np.concatenate([[0], np.cumsum(opens)])
        kept, n_removed = shard.data[~gone].tobytes(), removed[shard.ends] - removed[before]
        cuts = np.concatenate([[0], np.cumsum(shard.sizes - n_removed)]).tolist()
        return pa.table([pa.array(x) for x in (shard.ids, shard.sizes, n_removed, opened[shard.ends] - opened[before])] + [pa.array([kept[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], schema=schema)

    sent = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("shard", pa.int32()), *[(c, pa.binary()) for c in "abcde"]])
    sent_sql = "kind int, bucket int, shard int, a binary, b binary, c binary, d binary, e binary"
    keys = shards.applyInArrow(send_keys, sent_sql)
    shared = keys.select("bucket", "shard", "a", "b", "c").groupBy("bucket").applyInArrow(meet, "shard int, bucket int, keys binary, ways binary")
    parts = shards.cogroup(shared.groupBy("shard")).applyInArrow(send, sent_sql)
    repeated = parts.groupBy("kind", "bucket").applyInArrow(merge, "kind int, shard int, a binary, b binary, d binary")
    out = shards.cogroup(repeated.groupBy("shard")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))
