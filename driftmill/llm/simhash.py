"""Operator 3: SimHash near-duplicates by the generalised pigeonhole principle.

All fingerprints within a Hamming radius are found as follows. Bits that go together are grouped
into m partitions. Two fingerprints within radius r differ, for any thresholds t_1..t_m (-1 or
more) that sum to r - m + 1, by at most t_i bits in at least one partition i. Dynamic programming
chooses m and the thresholds by the cost of probes and of candidates, whose counts are estimated
from statistics of all fingerprints. A fingerprint then probes each partition's value and its
variants, and what meets is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, hot_join
from .storage import small, written

#: Shingles handled at once while a text is hashed; bounds memory on very long texts.
SHINGLES_AT_ONCE = 1 << 16
#: Rows of one probed value that a task compares at once; a value with more is cut into blocks.
BLOCK_ROWS = 4096
#: Costs in microseconds that the choice of partitions weighs: a probe's row and a compared pair.
PROBE_COST, PAIR_COST = 2.0, 0.02
_SMALL = 48


# ---------------------------------------------------------------- fingerprints


def simhash(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of a whole text: majority of the XXH64 bits of its word shingles, repeats included.

    A-Z are lower-cased and words split at ASCII white space. With fewer words than a shingle has,
    the whole sequence is one shingle; null and word-less texts have fingerprint 0.
    """
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    k = min(words, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, ones = len(parts) - k + 1, np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        upto = min(n, at + SHINGLES_AT_ONCE)
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist())]
        ones += bit_counts(np.array(hashes, "<u8"))
    return majority(ones, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes whose bits were counted."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 4, seed: int = 42) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t.as_py(), words, seed) for t in texts], np.uint64).view(np.int64))

    return of(text)


# ---------------------------------------------------------------- partitions and thresholds


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, over all of them, how often bits i and j are both set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            v = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            for at in range(0, len(v), 1 << 16):
                x = np.unpackbits(v[at : at + (1 << 16)], axis=1, bitorder="little").astype(np.float32)
                total += (x.T @ x).astype(np.int64)
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097), pa.int32()), pa.array(np.append(total.ravel(), n))], ["cell", "n"])

    rows = prints.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097, np.int64)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of 64 / m bits; a group grows by the bit most correlated with it."""
    p = together.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(64)), []
    for g in range(m):
        size = 64 // m + (g < 64 % m)
        rest = sorted(free)
        group = [max(rest, key=lambda i: (corr[i, rest].max(initial=0), -i))]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda i: (corr[i, group].sum(), -i)))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def meeting_probabilities(together: np.ndarray, n: int, bits: list[int], most: int) -> np.ndarray:
    """P(two fingerprints differ in at most t of these bits), t = 0..most, under the bits' dependence tree.

    The tree joins the bits of largest mutual information; the probability follows by passing, from
    the leaves up, polynomials in the number of differing bits for each pair of values of a bit.
    """
    n = max(n, 1)
    p = (together.diagonal() + 0.5) / (n + 1)
    joint = {}
    for i, j in combinations(bits, 2):
        both = (together[i, j] + 0.25) / (n + 1)
        cell = np.array([[1 - p[i] - p[j] + both, p[j] - both], [p[i] - both, both]]).clip(1e-9)
        joint[i, j], joint[j, i] = cell, cell.T
    info = {e: float((c * np.log(c / np.outer(c.sum(1), c.sum(0)))).sum()) for e, c in joint.items()}
    parent, todo, order = {bits[0]: None}, set(bits[1:]), [bits[0]]
    while todo:
        i, j = max(((a, b) for a in order for b in todo), key=lambda e: (info[e], e))
        parent[j] = i
        order.append(j)
        todo.discard(j)
    differ = np.zeros((2, 2, most + 1))
    differ[0, 0, 0] = differ[1, 1, 0] = 1
    if most:
        differ[0, 1, 1] = differ[1, 0, 1] = 1
    inner = {i: differ.copy() for i in bits}
    for i in reversed(order[1:]):
        c = joint[parent[i], i]
        given = c / c.sum(1, keepdims=True)
        message = np.einsum("px,qy,xyd->pqd", given, given, inner[i])
        up = inner[parent[i]]
        inner[parent[i]] = np.stack([sum(up[:, :, k] * message[:, :, d - k] for k in range(d + 1)) for d in range(most + 1)], axis=2)
    root = np.array([1 - p[bits[0]], p[bits[0]]])
    return np.cumsum(np.einsum("x,y,xyd->d", root, root, inner[bits[0]]))


def choose(n: int, together: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """Partitions with thresholds of the least estimated cost; those of threshold -1 are left out."""
    best = None
    for m in range(1, min(radius + 1, 8) + 1):
        groups = group_bits(together, n, m)
        total, costs = radius - m + 1, []
        for bits in groups:
            most = min(radius, 3)
            chance = meeting_probabilities(together, n, bits, most)
            rows = [1 + sum(comb(len(bits), k) / 2 for k in range(1, t + 1)) for t in range(most + 1)]
            costs.append({-1: 0.0} | {t: n * rows[t] * PROBE_COST + n * n / 2 * chance[t] * PAIR_COST for t in range(most + 1)})
        table = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in table.items():
                for t, more in cost.items():
                    if s + t not in step or c + more < step[s + t][0]:
                        step[s + t] = (c + more, [*chosen, t])
            table = step
        if total in table and (best is None or table[total][0] < best[0]):
            best = (table[total][0], [(g, t) for g, t in zip(groups, table[total][1]) if t >= 0])
    return best[1]


# ---------------------------------------------------------------- probing and verifying


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def probes(prints: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp): a fingerprint under its own value of each partition and under its variants.

    Of two values that differ by a mask exactly one has the mask's top bit; only that one probes.
    """
    masks = []
    for part, (bits, t) in enumerate(chosen):
        keep = sum(1 << b for b in bits)
        masks.append((part, keep, 0, 0))
        for k in range(1, t + 1):
            masks += [(part, keep, sum(1 << b for b in c), 1 << max(c)) for c in combinations(bits, k)]
    listed = F.array(*(F.struct(F.lit(p).alias("part"), *(F.lit(_signed(v)).cast("long").alias(x) for x, v in (("keep", keep), ("flip", flip), ("top", top)))) for p, keep, flip, top in masks))
    rows = prints.select("fp", F.explode(listed).alias("x")).where("x.flip = 0 or (fp & x.top) <> 0")
    return rows.select("x.part", F.expr("(fp & x.keep) ^ x.flip").alias("key"), "fp")


def _linked(group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all of the group that verified links connect, at most one a member."""
    a, b, rest = [], [], group
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            f = frontier.pop()
            hit = np.bitwise_count(rest ^ f) <= radius
            if hit.any():
                new = rest[hit]
                a.append(np.full(len(new), f))
                b.append(new)
                frontier.extend(new)
                rest = rest[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (group[:0], group[:0])


def verify(radius: int):
    """A mapInArrow function over rows sorted by block: emits links that span each task's classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        def spanning(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            out = []
            for x, y in zip(a.tolist(), b.tolist()):
                p, q = find(x), find(y)
                if p != q:
                    up[p] = q
                    out.append((x, y))
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        def compare(block: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            """block: int64 (rows, 4), equal rows adjacent."""
            cut = np.flatnonzero(np.any(block[1:] != block[:-1], axis=1)) + 1
            first = np.concatenate(([0], cut))
            sizes = np.diff(np.append(first, len(fp)))
            a, b = [fp[:0]], [fp[:0]]
            small = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
            x, g = fp[small], np.repeat(np.arange(len(sizes)), sizes)[small]
            for d in range(1, int(sizes[sizes <= _SMALL].max(initial=1))):
                at = np.flatnonzero((g[d:] == g[:-d]) & (np.bitwise_count(x[d:] ^ x[:-d]) <= radius))
                a.append(x[at])
                b.append(x[at + d])
            for k in np.flatnonzero(sizes > _SMALL):
                p, q = _linked(fp[first[k] : first[k] + sizes[k]], radius)
                a.append(p)
                b.append(q)
            return spanning(np.concatenate(a), np.concatenate(b))

        held_block, held_fp = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            block = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            held_block, held_fp = np.concatenate((held_block, block)), np.concatenate((held_fp, batch.column(4).to_numpy().view(np.uint64)))
            whole = np.flatnonzero(np.any(held_block != held_block[-1], axis=1)) if len(held_fp) else []
            if len(whole):
                n = int(whole[-1]) + 1
                yield compare(held_block[:n], held_fp[:n])
                held_block, held_fp = held_block[n:], held_fp[n:]
        if len(held_fp):
            yield compare(held_block, held_fp)

    return run


def hamming_links(prints: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fp`` that connect all that links of ``radius`` bits or fewer connect.

    Every pair within the radius meets in some block; pairs that close a cycle within a task are
    left out, so a dense class of k fingerprints gives some k pairs, not k * k.
    """
    n, together = bit_statistics(prints)
    if n < 2:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    rows = probes(prints, choose(n, together, radius))
    large = written(rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS), "large")
    if large.isEmpty():
        blocks = rows.select("part", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    else:
        cuts = rows.join(large.select("part", "key", F.ceil(F.col("n") / (BLOCK_ROWS // 2)).cast("int").alias("cuts")), ["part", "key"], "left")
        dealt = cuts.withColumn("own", F.expr("cast(pmod(xxhash64(fp), coalesce(cuts, 1)) as int)")).withColumn("other", F.explode(F.expr("sequence(0, coalesce(cuts, 1) - 1)")))
        blocks = dealt.select("part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    by = ["part", "key", "i", "j"]
    return blocks.repartition(*by).sortWithinPartitions(*by).mapInArrow(verify(radius), "a long, b long")


def near_duplicates(rows: DataFrame, radius: int = 4) -> DataFrame:
    """Classes of rows (rid, doc_id, fp): adds component_id, the least doc_id of the class, and keep.

    ``rid`` is unique. A class without any doc_id has a null component_id; ``keep`` marks one row of
    each class: that of the least doc_id, null last, then of the least rid.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    prints = written(rows.groupBy("fp").agg(F.min(place).alias("least"), F.count("*").alias("n")), "prints")
    heads = written(class_heads(prints, "fp", connected_components(hamming_links(prints.select("fp"), radius))), "heads")
    found = hot_join(rows, heads, "fp", prints.select("fp", "n"), "rid")
    return found.select(*rows.columns, F.col("head.doc_id").alias("component_id"), (F.col("rid") == F.col("head.rid")).alias("keep"))


def class_heads(prints: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """(key, head) of every row of ``prints`` (key, least): the least place of its class, which ``roots`` (node, root) tells."""
    linked = written(prints.select(key, "least").join(roots.withColumnRenamed("node", key), key), "linked")
    heads = linked.groupBy("root").agg(F.min("least").alias("head"), F.count("*").alias("n"))
    moved = hot_join(linked.select(key, "root"), heads.select("root", "head"), "root", heads.select("root", "n"), key).select(key, "head")
    return prints.join(moved, key, "left").select(key, F.coalesce("head", "least").alias("head"))


def fingerprint_rows(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, fp) of every row, written to the shared folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col).cast("string"), words).alias("fp"))
    return written(rows, "rows")


def classify(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and keep for every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other; rows with null ids take part;
    repeated rows each give a row, of which at most one is kept; an empty table gives no rows;
    further columns play no part.
    """
    found = near_duplicates(fingerprint_rows(docs, words, id_col, text_col), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "keep")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each class of near duplicates, that of the least id, null last, then of the first row.

    A class is what pairs connect whose sets of word shingles have the similarity or more (shared over
    all, exactly). Fingerprints within the radius propose pairs; what they leave out comes from shared
    rare shingles (``shingles``), since at similarity 0.8 some ten of 64 bits differ and no radius that
    finds all such pairs separates them from others. Every proposal is compared exactly.

    Texts without words are one class; rows with null ids take part; of repeated rows one stays; an
    empty table gives no rows; columns of any name are kept as they are.
    """
    from . import shingles

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = shingles.sketched(rows, words, similarity)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    prints = written(rows.groupBy("key").agg(F.min(place).alias("least"), F.min("fp").alias("fp"), F.count("*").alias("n")), "prints")
    same = prints.groupBy("fp").agg(F.min("key").alias("head"), F.count("*").alias("n"))
    same = written(same, "same")
    alike = hot_join(prints.select("key", "fp"), same.select("fp", "head"), "fp", same.select("fp", "n"), "key")
    alike = alike.where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b"))
    close = hamming_links(same.select("fp"), radius)
    for end in ("a", "b"):
        close = close.join(same.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_key")), end)
    proposed = alike.union(close.select("a_key", "b_key"))
    texts = rows.select("rid", "key", "n", "first", F.col("row").getField(text_col).cast("string").alias("text"))
    found = shingles.links(texts, prints.select("key", F.col("least.rid").alias("rid")), proposed, words, similarity)
    heads = class_heads(prints, "key", connected_components(found)).select("key", F.col("head.rid").alias("head"))
    gone = hot_join(rows.select("rid", "key"), heads, "key", prints.select("key", "n"), "rid").where("rid <> head").select("rid")
    return rows.join(small(gone, "gone"), "rid", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
