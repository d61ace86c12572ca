"""Operator 9: benchmark decontamination by SimHash of item-sized windows, in DataFrame functions alone.

For each benchmark item, windows of a document as long as the item are compared with it, or the
whole document where it is shorter than the item: SimHash fingerprints of five-word shingles, found
by multi-index Hamming blocks within a radius, then the exact similarity of the two multisets of
shingles (sum of minima over sum of maxima). An item or document of fewer words is one shingle of
all its words, so a short item is found where a document is just that item.

Multisets of N and K shingles reach similarity t only if they share s >= (N + K)t / (1 + t) of them.
So a window counts only if that many of its positions hold a shingle of some item of the length it
is meant for; other windows are never fingerprinted. The test is lossless, needs no shuffle, and leaves few documents.
"""

from __future__ import annotations

import json
from itertools import combinations
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

WORDS, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 24, 9
#: Distinct shingles of the items that one pass over the documents looks for; more items, more passes.
PASS_SHINGLES = 100_000


def _with_shingles(rows: DataFrame, text: str, words: int) -> DataFrame:
    """Adds ``s``, the hashes of the shingles of words (runs of letters and digits, lower case), and ``nw``, the number of words.

    Fewer words than a shingle has are one shingle.

    Each step is a column of its own, which later steps name more than once, so that Catalyst keeps
    it and doesn't work it out again for every element.
    """
    rows = rows.withColumn("plain", F.expr(f"trim(regexp_replace(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"))
    rows = rows.withColumn("w", F.expr("transform(filter(split(plain, ' '), x -> plain <> ''), x -> xxhash64(x))"))
    each = ", ".join(f"w[i + {k}]" for k in range(words))
    few = "array(aggregate(w, cast(size(w) as bigint), (a, x) -> xxhash64(a, x)))"
    shingles = f"case when size(w) = 0 then cast(array() as array<bigint>) when size(w) < {words} then {few} else transform(sequence(0, greatest(size(w) - {words}, 0)), i -> xxhash64({each})) end"
    return rows.withColumn("s", F.expr(shingles)).withColumn("nw", F.size("w")).drop("plain", "w")


def _with_fingerprint(rows: DataFrame) -> DataFrame:
    """Adds ``fp``, the SimHash of the hashes ``s``, repeats included; each long counts two bits."""
    rows = rows.withColumn("ones", F.expr("transform(sequence(0, 31), b -> aggregate(s, 0L, (a, h) -> a + (shiftrightunsigned(h, b) & 4294967297L)))"))
    low = "if(2 * (ones[b] & 4294967295L) > size(s), shiftleft(1L, b), 0L)"
    high = "if(2 * shiftrightunsigned(ones[b], 32) > size(s), shiftleft(1L, b + 32), 0L)"
    return rows.withColumn("fp", F.expr(f"aggregate(sequence(0, 31), 0L, (f, b) -> f | {low} | {high})")).drop("ones")


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def hamming_blocks(blocks: int, radius: int) -> list[tuple[int, list[int]]]:
    """(mask, masks of up to radius // blocks bits in it) of each block of the 64 bits.

    Two fingerprints within the radius differ by at most radius // blocks bits in some block.
    """
    out, at = [], 0
    for b in range(blocks):
        bits = range(at, at := at + 64 // blocks + (b < 64 % blocks))
        flips = [sum(1 << x for x in c) for k in range(radius // blocks + 1) for c in combinations(bits, k)]
        out.append((sum(1 << x for x in bits), flips))
    return out


def _membership(hashes: list[int]):
    """A test whether a Column is one of the hashes: a hash table that folds to one constant.

    A list of literals would do, but each is a node of the plan, through which every rule walks.
    """
    size = 1 << max(4, len(hashes).bit_length())
    buckets: list[list[int]] = [[] for _ in range(size)]
    for h in hashes:
        buckets[h & (size - 1)].append(h)
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<bigint>>")
    return lambda h: F.array_contains(F.get(table, h.bitwiseAND(F.lit(size - 1)).cast("int")), h)


def _needed(sizes: str, similarity: float) -> str:
    """How many shingles two multisets of so many in all must share."""
    return f"cast(ceil({similarity / (1 + similarity)!r}D * ({sizes}) - 1e-9D) as int)"


def contaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item whose best window reaches the similarity.

    Columns: doc_id, text_md5 (of the document), item_id, similarity, start_word (the best window's
    first word, the earliest on ties), n_words (the window's), distance (of fingerprints, in bits). Items and
    documents without a word match nothing; nulls count as empty; null ids stay null; repeated rows
    give a row each; empty tables give no rows; further columns play no part.
    """
    known = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    # As below, the row's number keeps the filter above what it filters by.
    known = _with_shingles(known, "text", words).select(F.monotonically_increasing_id().alias("item"), "item_id", "s", F.size("s").alias("k"))
    known = written(known.where("k > 0"), "items")
    total = known.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    passes = max(1, -(-total // PASS_SHINGLES))
    out = None
    for p in range(passes):
        part = known.where(F.expr(f"pmod(xxhash64(item), {passes}) = {p}"))
        found = _one_pass(docs, part, words, similarity, radius, blocks, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    return out


def _one_pass(docs: DataFrame, items: DataFrame, words: int, similarity: float, radius: int, blocks: int, id_col: str, text_col: str) -> DataFrame:
    shingles = items.select("k", F.explode("s").alias("h")).distinct()
    hashes = [r["h"] for r in shingles.select("h").distinct().collect()]  # PASS_SHINGLES and one item's more at most
    sizes = [r["k"] for r in items.select("k").distinct().collect()]
    least = min((ceil(similarity / (1 + similarity) * 2 * k - 1e-9) for k in sizes), default=1)
    least, shortest, longest = max(1, least), min(sizes, default=1), max(sizes, default=1)

    # Documents with enough shingles of items within a window's reach; no shuffle.
    text = F.col(text_col).cast("string")
    rows = _with_shingles(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")), "text", words)
    # The row's number keeps the filter above this projection: below it, p would be worked out for each element.
    among = _membership(hashes)
    found = F.filter(F.expr("sequence(0, greatest(size(s) - 1, 0))"), lambda i: among(F.get("s", i))).alias("p")
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "s", "nw", found)
    within = f"size(p) >= {least} and exists(sequence(0, greatest(size(p) - {least}, 0)), i -> get(p, i + {least - 1}) - get(p, i) < {longest})"
    near = f"if(size(s) < {shortest}, size(p) >= {_needed(f'size(s) + {shortest}', similarity)}, {within})"  # a shorter document is a window as it is
    suspects = rows.where(near).select("rid", "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "s", "nw", "p")
    suspects = written(suspects, "suspects")

    # Windows for each item length k, of n = k shingles or the whole document's fewer, that hold enough of its shingles.
    hits = suspects.select("rid", F.size("s").alias("m"), F.explode(F.expr("transform(p, i -> struct(i as pos, s[i] as h))")).alias("x")).select("rid", "m", "x.pos", "x.h")
    hits = hits.join(shingles, "h").groupBy("rid", "m", "k").agg(F.sort_array(F.collect_set("pos")).alias("p"))  # a document's own positions
    hits = hits.withColumn("n", F.least("m", "k")).withColumn("need", F.expr(_needed("n + k", similarity))).where("size(p) >= need")
    firsts = F.expr("filter(p, (x, i) -> get(p, i + need - 1) - x < n)")
    starts = F.expr("explode(array_distinct(flatten(transform(f, x -> sequence(greatest(x - (n - need), 0), x)))))")
    windows = hits.withColumn("f", firsts).where("size(f) > 0").select("rid", "k", "n", starts.alias("start"))
    windows = windows.join(suspects.select("rid", "s"), "rid").where("start + n <= size(s)").select("rid", "k", "n", "start", F.expr("slice(s, start + 1, n)").alias("s"))
    windows = written(_with_fingerprint(windows), "windows")

    # Multi-index Hamming blocks: an item under all variants of each block, a window under its own value.
    layout = hamming_blocks(blocks, radius)
    prints = _with_fingerprint(items)
    entries = F.array(*(F.struct(F.lit(b).alias("block"), F.lit(_signed(mask)).alias("mask"), F.array(*(F.lit(_signed(f)) for f in flips)).alias("flips")) for b, (mask, flips) in enumerate(layout)))
    table = prints.select("item", "k", "fp", F.explode(entries).alias("e")).select("item", "k", "fp", "e.block", "e.mask", F.explode("e.flips").alias("flip"))
    table = table.select("item", "k", F.col("fp").alias("item_fp"), "block", F.expr("(fp & mask) ^ flip").alias("value"))
    masks = F.array(*(F.struct(F.lit(b).alias("block"), F.lit(_signed(mask)).alias("mask")) for b, (mask, _) in enumerate(layout)))
    # Distinct fingerprints ask: a passage that a third of all documents share asks once.
    asked = windows.select("k", "fp").distinct().select("k", "fp", F.explode(masks).alias("e")).select("k", "fp", "e.block", F.expr("fp & e.mask").alias("value"))
    pairs = asked.join(table, ["k", "block", "value"]).withColumn("distance", F.expr("bit_count(fp ^ item_fp)")).where(F.col("distance") <= radius)
    pairs = pairs.select("k", "fp", "item", "distance").distinct()

    # Exact similarity of the multisets.
    counted = items.select("item", "item_id", F.explode("s").alias("h")).groupBy("item", "item_id", "h").agg(F.count("*").alias("c")).groupBy("item", "item_id").agg(F.collect_list(F.struct("h", "c")).alias("counts"))
    both = windows.select("rid", "k", "n", "start", "s", "fp").join(pairs, ["k", "fp"]).join(counted, "item")
    shared = F.expr("aggregate(counts, 0L, (a, x) -> a + least(x.c, cast(size(filter(s, h -> h = x.h)) as bigint)))")
    scored = both.select("rid", "k", "n", "start", "item", "item_id", "distance", shared.alias("shared")).where(F.col("shared") >= F.expr(_needed("n + k", similarity)))
    scored = scored.withColumn("similarity", F.expr("shared / (1D * (n + k) - shared)"))
    best = scored.groupBy("rid", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n", "distance", "item_id")).alias("b"))
    found = best.join(suspects.select("rid", "doc_id", "text_md5", "nw"), "rid")
    return found.select("doc_id", "text_md5", F.col("b.item_id").alias("item_id"), F.col("b.similarity").alias("similarity"), (-F.col("b.back")).cast("long").alias("start_word"), F.least(F.col("b.n") + (words - 1), "nw").cast("long").alias("n_words"), F.col("b.distance").cast("int").alias("distance"))


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` in which no item is found; equal texts fare alike."""
    bad = written(contaminated(docs, items, text_col=text_col, **settings).select("text_md5").distinct(), "contaminated")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("text_md5"))
    return rows.join(bad, "text_md5", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def oracle(words: int = WORDS, similarity: float = SIMILARITY) -> str:
    """SQL of all windows that overlap a shared shingle, by exact similarity alone."""
    last = words - 1
    shingled = "CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - {l}), lambda i: array_to_string(w[i + 1 : i + {n}], ' ')) END".format(l=last, n=words)
    plain = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
    return f"""
WITH d AS (SELECT rid, doc_id, len(w) AS nw, {shingled} AS s FROM (SELECT row_number() OVER () AS rid, doc_id, {plain} AS w FROM documents) WHERE w <> ['']),
b AS (SELECT item, item_id, {shingled} AS s FROM (SELECT row_number() OVER () AS item, item_id, {plain} AS w FROM benchmark) WHERE w <> ['']),
dp AS (SELECT rid, doc_id, nw, unnest(s) AS h, unnest(range(len(s))) AS pos, len(s) AS m FROM d),
bp AS (SELECT item, item_id, unnest(s) AS h, len(s) AS k FROM b),
bc AS (SELECT item, item_id, k, h, count(*) AS c FROM bp GROUP BY ALL),
hit AS (SELECT DISTINCT rid, doc_id, nw, m, least(m, k) AS n, pos, item, item_id, k FROM dp JOIN bc USING (h)),
win AS (SELECT DISTINCT rid, doc_id, nw, item, item_id, k, n, unnest(range(greatest(pos - n + 1, 0), least(pos, m - n) + 1)) AS start FROM hit),
cnt AS (
  SELECT win.rid, win.doc_id, win.nw, win.item, win.item_id, win.k, win.n, win.start, dp.h, count(*) AS c
  FROM win JOIN dp ON dp.rid = win.rid AND dp.pos >= win.start AND dp.pos < win.start + win.n GROUP BY ALL
),
sim AS (
  SELECT cnt.rid, cnt.doc_id, cnt.nw, cnt.item, cnt.item_id, cnt.k, cnt.n, cnt.start, sum(least(cnt.c, bc.c))::DOUBLE AS shared
  FROM cnt JOIN bc ON bc.item = cnt.item AND bc.h = cnt.h GROUP BY ALL
),
ok AS (SELECT *, shared / (n + k - shared) AS similarity FROM sim WHERE shared / (n + k - shared) >= {similarity})
SELECT doc_id, item_id, round(similarity, 9) AS similarity, start::BIGINT AS start_word, least(n + {last}, nw)::BIGINT AS n_words
FROM (SELECT *, row_number() OVER (PARTITION BY rid, item ORDER BY similarity DESC, start) AS r FROM ok) WHERE r = 1
"""
