"""Near duplicates by the exact similarity of sets of word shingles.

Two sets of n and m shingles of similarity t (shared over all) share o = ceil(t * max(n, m)) or more.
So, in any order of all shingles, the first n - o + l of each have l in common, and of these, in any
other order, the first n - o + 1 have one. The first order puts shingles that are common in a sample
of documents last, then goes by hash; l is one and an eighth of o, and the prefixes of that order
alone are dealt by shingle. The second goes by the number of sets that hold a shingle in those
prefixes, so that sets whose share of shingles of their own is large enough meet nobody. Orders
decide the cost alone: any two find every pair. Sets that meet, and whose sizes allow the similarity,
are chained; each connected group of them is compared in full, and only pairs that reach the
similarity are links. Operator 3 adds the pairs of its fingerprints to those chains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .simhash import bit_counts, majority
from .storage import small, written

WORDS, SIMILARITY = 5, 0.8
#: The share of the shingles that two sets must have in common by which first prefixes are longer: one in so many.
SPARE = 8
#: Documents whose shingles give the order, shingles it knows as common, and from how many documents.
SAMPLE_DOCUMENTS, MOST_COMMON, COMMON_FROM = 4096, 100_000, 3
#: Sets that a task compares at once; a group with more is cut into blocks.
BLOCK_ROWS = 4096
#: Words whose hashes a task remembers.
_REMEMBERED = 1 << 16


class Shingler:
    """Sets of shingles as sorted 64-bit hashes, each made of the hashes of its words."""

    def __init__(self, words: int):
        rng = np.random.default_rng(5)
        self.words, self.known = words, {}
        self.factors = rng.integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        """A-Z are lower-cased and words split at ASCII white space; fewer words than a shingle's are one."""
        from xxhash import xxh64_intdigest

        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > _REMEMBERED:
            known.clear()
        for p in set(parts):
            if p not in known:
                known[p] = xxh64_intdigest(p, 42)
        w = np.fromiter((known[p] for p in parts), np.uint64, len(parts))
        k = min(self.words, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h += w[i : len(w) - k + 1 + i] * self.factors[i]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return np.unique(h)


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set of which every set of that similarity holds 1 + o // SPARE in its own prefix; o: what they share."""
    n = len(shingles)
    if not n:
        return shingles
    often = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        often = np.where(common[at] == shingles, counts[at], 0)
    shared = int(np.ceil(similarity * n - 1e-9))
    return shingles[np.lexsort((shingles, often))][: n - shared + 1 + shared // SPARE]


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample of documents, sorted, and in how many of them each is."""
    step = max(1, texts.count() // SAMPLE_DOCUMENTS)
    sample = texts.where(F.expr(f"pmod(xxhash64(text, 7), {step}) = 0")).distinct()

    @F.arrow_udf("array<long>")
    def of(column: pa.Array) -> pa.Array:
        cut = Shingler(words)
        return pa.array([cut(t.as_py()).view(np.int64) for t in column], pa.list_(pa.int64()))

    found = sample.select(F.explode(of("text")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_FROM)
    found = found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _sketches(text: Column, words: int, similarity: float, common) -> Column:
    """A struct of key (equal for equal sets), n, fp (the SimHash of the set) and the prefix."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from xxhash import xxh64_intdigest

        cut = Shingler(words)
        known, counts = common.value
        for texts in batches:
            keys, sizes, prints, first = (np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int32), np.zeros(len(texts), np.uint64), [])
            for i, t in enumerate(texts):  # a set at a time: those of a batch would take much memory
                s = cut(t.as_py())
                keys[i], sizes[i], prints[i] = xxh64_intdigest(s.tobytes(), 42), len(s), majority(bit_counts(s), len(s))
                first.append(prefix(s, similarity, known, counts).view(np.int64))
            yield pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array(sizes), pa.array(prints.view(np.int64)), pa.array(first, pa.list_(pa.int64()))], ["key", "n", "fp", "first"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "key long, n int, fp long, first array<long>")(text)


def sketched(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``rows`` (rid, doc_id, text, row) with the sketch of each text in place of it, written to the shared folder; ``row`` holds the text."""
    common = rows.sparkSession.sparkContext.broadcast(_common(rows.select("text"), words))
    found = rows.select("rid", "doc_id", _sketches(F.col("text"), words, similarity, common).alias("x"), "row")
    return written(found.select("rid", "doc_id", "x.key", "x.n", "x.fp", "x.first", "row"), "rows")


def meeting(rows: DataFrame, similarity: float) -> DataFrame:
    """(h, n, key): the shingles at which sets (key, n, first) meet, those that fewest sets hold and no more than needed.

    A shingle that one set alone holds takes a place of the n - o + 1 that are needed, but goes nowhere.
    """
    held = rows.select(F.explode("first").alias("h"), "n", "key").withColumn("df", F.count("*").over(Window.partitionBy("h")))
    sets = held.where("df > 1").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"))  # a prefix at most
    sets = sets.withColumn("o", F.expr(f"cast(ceil({similarity!r}D * n - 1e-9D) as int)"))
    alone = f"n - o + 1 + cast(floor(o / {SPARE}) as int) - size(x)"
    return sets.select(F.explode(F.expr(f"slice(x, 1, greatest(n - o + 1 - ({alone}), 0))")).alias("e"), "n", "key").select("e.h", "n", "key")


def _spanning(up: dict[int, int], a: list[int], b: list[int]) -> pa.RecordBatch:
    """Those of the pairs that join what earlier ones of the task don't."""

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a, b):
        p, q = find(x), find(y)
        if p != q:
            up[p] = q
            out[0].append(x)
            out[1].append(y)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])


def chained(similarity: float):
    """A mapInArrow function over (h, n, key) sorted so: links neighbours of one shingle whose sizes allow the similarity.

    All sizes between those of two sets lie within their ratio, so the two are linked by those between.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        last = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            h, n, key = (np.concatenate((x, batch.column(i).to_numpy().astype(np.int64))) for i, x in enumerate(last))
            last = [h[-1:], n[-1:], key[-1:]]
            at = np.flatnonzero((h[1:] == h[:-1]) & (key[1:] != key[:-1]) & (n[:-1] >= similarity * n[1:] - 1e-9))
            yield _spanning(up, key[at].tolist(), key[at + 1].tolist())

    return run


def similar(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Places (i, j) of similar sets that connect all that similar pairs connect."""
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    holders = owner[np.argsort(ids, kind="stable")]
    ends = np.cumsum(np.bincount(ids))
    starts, bounds = ends - np.bincount(ids), np.append(0, np.cumsum(size))
    left, out = np.ones(len(sets), bool), ([], [])
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        frontier = [seed]
        while frontier and left.any():
            f = frontier.pop()
            own = ids[bounds[f] : bounds[f + 1]]
            shared = np.bincount(np.concatenate([holders[starts[i] : ends[i]] for i in own]), minlength=len(sets)) if len(own) else np.zeros(len(sets), np.int64)
            hit = np.flatnonzero(left & (shared >= similarity / (1 + similarity) * (size + size[f]) - 1e-9))
            left[hit] = False
            frontier.extend(hit.tolist())
            out[0].extend([f] * len(hit))
            out[1].extend(hit.tolist())
    return out


def verify(words: int, similarity: float):
    """A mapInArrow function over (root, i, j, key, text) sorted by block: emits links of similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, up = Shingler(words), {}
        block, keys, sets = None, [], []

        def compare() -> pa.RecordBatch:
            a, b = similar(sets, similarity) if len(sets) > 1 else ([], [])
            return _spanning(up, [keys[i] for i in a], [keys[i] for i in b])

        for batch in batches:
            for *place, text in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4)):
                root, i, j, key = place
                if (root, i, j) != block:
                    yield compare()
                    block, keys, sets = (root, i, j), [], []
                keys.append(key)
                sets.append(cut(text.as_py()))
        yield compare()

    return run


def links(rows: DataFrame, prints: DataFrame, proposed: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of keys that connect all that pairs of the similarity connect.

    ``rows``: rid, key, n, first and text; ``prints``: key and rid of one row of each key, for equal sets count once;
    ``proposed``: pairs of keys that are compared beside those that share a shingle of their prefixes.
    """
    met = meeting(rows.join(prints.select("rid"), "rid", "left_semi").select("first", "n", "key"), similarity)
    met = met.repartition("h").sortWithinPartitions("h", "n", "key").mapInArrow(chained(similarity), "a long, b long")
    groups = written(connected_components(met.union(proposed)).withColumnRenamed("node", "key"), "groups")
    cuts = groups.groupBy("root").agg(F.ceil(F.count("*") / (BLOCK_ROWS // 2)).cast("int").alias("cuts")).withColumn("cuts", F.expr("if(cuts <= 2, 1, cuts)"))
    members = small(groups.join(cuts, "root").join(prints, "key").select("rid", "key", "root", "cuts"), "members")
    dealt = rows.select("rid", "text").join(members, "rid")
    dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(key), cuts) as int)")).withColumn("other", F.explode(F.expr("sequence(0, cuts - 1)")))
    by = ["root", "i", "j"]
    blocks = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "text")
    return blocks.repartition(*by).sortWithinPartitions(*by).mapInArrow(verify(words, similarity), "a long, b long")
