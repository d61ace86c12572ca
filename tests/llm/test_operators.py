"""Operators against brute force, round trips and held-out labels, with nulls, ties, repeats, odd columns and empty tables."""

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from driftmill.llm import components, crc32c, decontam, html, langid, mtree, packing, records, shards, shingles, simhash, storage, tokens, toxicity, urls
from driftmill.llm import queries as Q

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    (5, "The quick brown fox"), (1, None), (3, ""), (2, "  two  spaces\n\n and <|endoftext|> Élan ñ 漢字 3.14"), (None, "no id"), (3, "again three"), (3, "again three"), (9, "word " * 5000), (7, "x" * 9000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, i, "c") for i, t in TEXTS], "doc_id long, text string, start long, fp string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# ---------------------------------------------------------------- tokens, records and packing


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_remembered_words_equal_the_library(path):
    e, full = tokens.WordMemoEncoder(path, entries=50), Tokenizer.from_file(path)
    assert e.kind
    rng = random.Random(3)
    alphabet = list(" \n\tab'sT1²é,.́ßİ漢Σ-_ ") + ["<|endoftext|>", "  ", "don't "]
    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(e(t), "<u4").tolist() == full.encode(t, add_special_tokens=False).ids, repr(t)


def test_common_units_outlast_new_ones():
    """A unit that stands in every text is worked out once, however many others come and go; ids stay the library's."""
    e, full, seen = tokens.WordMemoEncoder(BYTE, entries=40), Tokenizer.from_file(BYTE), []

    class Counted:
        def tokenize(self, shown):
            seen.append(shown)
            return full.model.tokenize(shown)

    e.model = Counted()
    for i in range(200):
        e(f"a commonest {'xyz'[i % 3]}{i} w{i}, it's")
    assert seen.count("Ġcommonest") == 1


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_of_texts_cut_together(path):
    """Units that are cut in one go keep the ids of the library on whole texts."""
    r = random.Random(5)
    e, full = tokens.WordMemoEncoder(path, entries=60), Tokenizer.from_file(path)
    parts = ["a", "word", "größe", "ªb", "don't", "'s", "x\ny", "end\n", "\nstart", "\n\n", "...", "12a", "3.5", "$$$", "ñ,", "", " ", "\t", "漢字", "é\u0301", "<|endoftext|>", "q<|endoftext|>r", "AB-cd", "\x7f", "Σ", "²³", "\xa0"]
    for _ in range(1500):
        t = " ".join(r.choice(parts) + r.choice(["", "", r.choice(parts), str(r.randrange(99))]) for _ in range(r.randrange(9)))
        assert np.frombuffer(e(t), "<u4").tolist() == full.encode(t, add_special_tokens=False).ids, repr(t)



def test_crc32c():
    assert crc32c.crc32c([b"123456789", b"", b"\0" * 32, bytes(range(32)), b"\xff" * 32]).tolist() == [0xE3069283, 0, 0x8A9136AA, 0x46DD794E, 0x62A8AB43]
    assert crc32c.masked([b"123456789"]).tolist() == [((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF]
    big = bytes(random.Random(1).randbytes(5000))
    assert crc32c.crc32c([big[:n] for n in (1, 63, 64, 65, 4999)]).tolist() == [slow_crc(big[:n]) for n in (1, 63, 64, 65, 4999)]


def slow_crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_records_round_trip(spark, docs, empty, tmp_path):
    full = Tokenizer.from_file(BYTE)
    index = records.write_records(docs, BYTE, end_id=2, path=f"file://{tmp_path}/records")
    got = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in records.read_records(index).collect()]
    got.sort(key=lambda r: r[1])
    expected = sorted(((i, full.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in TEXTS), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert sorted(map(str, ((g[0], g[2]) for g in got))) == sorted(map(str, expected))
    assert [g[1] for g in got] == np.cumsum([0, *(len(g[2]) for g in got)])[:-1].tolist()
    row = index.where("doc_id = 5").first()
    assert records.read_record(row["folder"], row["file"], row["offset"])[1].tolist() == full.encode(TEXTS[0][1]).ids + [2]
    assert records.read_records(records.write_records(empty, BYTE, 2)).count() == 0


def test_damaged_records_are_found(spark, docs, tmp_path):
    index = records.write_records(docs, BYTE, end_id=2, path=f"file://{tmp_path}/records")
    victim = next((tmp_path / "records").glob("*.rec"))
    data = bytearray(victim.read_bytes())
    data[30] ^= 1
    victim.write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum|cut off"):
        records.read_records(index).collect()


def test_packing(docs, empty):
    full = Tokenizer.from_file(WORD)
    rows = packing.pack(docs, WORD, end_id=1).collect()
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0 for r in rows)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    whole = {}
    for r in rows:
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for i, t in TEXTS:
        ids = full.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(whole[i, len(ids)])
        if TEXTS.count((i, t)) == 1:
            assert [x for _, p in pieces for x in p] == ids
    assert packing.pack(empty, WORD, 1).count() == 0
    written = packing.write_buckets(packing.pack(docs, WORD, end_id=1), storage.fresh_path(docs.sparkSession, "test"))
    key = lambda x: sorted(str(tuple(r)) for r in x)
    assert key(written.collect()) == key(packing.pack(docs, WORD, end_id=1).collect())
    assert packing.write_buckets(packing.pack(empty, WORD, end_id=1), storage.fresh_path(docs.sparkSession, "test")).count() == 0
    assert packing.decompose(2048 * 2 + 5, 2048) == [(0, 2048), (2048, 2048), (4096, 4), (4100, 1)]


# ---------------------------------------------------------------- pages


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""),
        ("", ""),
        ("<nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two  <b>bold</b></p><script>var t='</p>'</script><aside>side</aside><p>three</p></article><footer>f</footer>", "A & B\n\none two bold\n\nthree"),
        ("<body><div class='cookie-notice'>We use cookies</div><main><p>Text&#8212;here</p><form><p>Sign up</p></form><div class='comments'><article class='comment'>Nice!</article></div></main></body>", "Text—here"),
        ("<article><p>cut off &amp", "cut off &"),
        ("<div id='sidebar'><p>no end<article><p>kept</p></article>", "kept"),
        ("<header>Site</header><div>" + "<p>" + "long text " * 30 + "</p></div><div><a href='/'>home</a></div>", ("long text " * 30).strip()),
        ("<article><p>a</p><!-- <p>hidden</p> --><p>b</p></article>", "a\n\nb"),
        ('<article><p class="ad">Ad<p>Real.<p>Two.</article>', "Real.\n\nTwo."),
        ("<article><ul><li class=promo>Buy<li>one<li>two</ul><table><tr><td class='ad'>x<td>y</table></article>", "one\n\ntwo\n\ny"),
        ('<article><p class="social-science">S</p><section class="related-work">R</section><details class="notice-of-death">N</details><div class="cookieBanner">C</div></article>', "S\n\nR\n\nN"),
        ("<div class='layout-sidebar-right'><nav>n</nav><main><h1>T</h1><p>kept</p></main></div>", "T\n\nkept"),
        ("<article><p>kept</p><div class='related'><article class='card'>other</article></div></article>", "kept"),
        ('<article><p title="a>b">one</p><p title="x>two</p></article>', "one\n\ntwo"),
        ("<div><h1>Title</h1><p>" + "some words " * 12 + "</p><p>End.</p></div><div><a href=/>home</a></div>", "Title\n\n" + ("some words " * 12).strip() + "\n\nEnd."),
        ("<div><p>short page</p><p>two</p></div>", "short page\n\ntwo"),
        ("<main>Loading</main><div>" + "<p>" + "real text " * 40 + "</p></div>", "Loading\n\n" + ("real text " * 40).strip()),
        ("a < b &amp; <3 <![CDATA[c < d &amp;]]>", "a < b & <3 c < d &amp;"),
    ],
)
def test_main_text(page, expected):
    assert html.main_text(page) == expected


def slow_between(lengths, surge, joined, window=3):
    """The kept lines by the rule alone: a line is kept if, without a silent window between, a surge lies before it (or is joined behind it)."""
    n, kept = len(lengths), set()
    start = 0
    while start < n:
        if not sum(lengths[start : start + window]):
            start += 1
            continue
        stop = next((e for e in range(start, n) if not sum(lengths[e : e + window])), n)
        points = [i for i in range(start, stop) if lengths[i] and sum(lengths[i : i + window]) > surge]
        if points:
            first = points[0]
            while first > start and lengths[first - 1] and joined[first - 1]:
                first -= 1
            kept |= set(range(first, 1 + max(i for i in range(first, stop) if lengths[i])))
        start = stop
    return kept


def test_line_blocks_equal_brute_force():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randint(0, 25)
        lengths = [rng.choice([0, 0, 0, 1, 5, 40, 90, 300]) for _ in range(n)]
        joined, surge = [rng.random() < 0.4 for _ in range(n)], rng.choice([0, 20, 86])
        got = html.between_points(lengths, surge, joined)
        assert {i for a, b in got for i in range(a, b)} == slow_between(lengths, surge, joined), (lengths, surge, joined)


@pytest.mark.parametrize("article", [True, False])
def test_generated_pages(article):
    """Paragraphs of an article between boilerplate of all kinds, with and without an element that marks it."""
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 8))) for _ in range(n))
    for _ in range(300):
        body = [say(5)] + [say(rng.randint(20, 60)) for _ in range(rng.randint(1, 8))]
        inner = f"<h1>{body[0]}</h1>" + "".join(f"<p>{t[:9]}<b>{t[9:]}</b>" + rng.choice(["</p>", ""]) + rng.choice(["", "<!-- x -->", "<script>var a='<p>';</script>"]) for t in body[1:])
        tag = rng.choice(["article", "main"]) if article else "div"
        junk = [f"<nav><ul><li><a href='/'>{say(2)}</a></ul></nav>", f"<div class='ad-slot-3'>{say(9)}</div>", f"<aside>{say(30)}</aside>", f"<form>{say(5)}<input></form>", f"<section id=comments><p>{say(40)}</section>", f"<div role=dialog>{say(30)}</div>"]
        page = f"<html><head><title>{say(9)}</title></head><body>" + "".join(rng.sample(junk, 3)) + f"<{tag}>{inner}</{tag}>" + "".join(rng.sample(junk, 3)) + f"<footer>{say(12)}</footer></body></html>"
        assert html.main_text(page) == "\n\n".join(body), page


@pytest.mark.parametrize("piece, tail", [("<a ", '"'), ('<a x="', ""), ("<p class=ad>", ""), ("<", ""), ("<b>", "</i>" * 9000), ("<li><ul>", "</li>" * 9000), ("<div class=ad><article class=comment>", ""), ("<!--", ""), ("&", ""), ("=" , "<a" + " " * 9000 + '"' * 9000), ("<![CDATA[", "")])
def test_malformed_pages_take_linear_time(piece, tail):
    import time

    began = time.process_time()
    for n in (9000, 36000):
        html.main_text(piece * n + tail)
    assert time.process_time() - began < 8


def test_long_pages_and_odd_tables(spark, empty):
    page = "<article>" + "<p>paragraph of words</p>" * 200_000 + "</article>"  # 5 MB
    assert html.main_text(page).count("paragraph") == 200_000
    df = spark.createDataFrame([(1, page[:90]), (1, page[:90]), (2, None), (3, "")], "page_id long, html string")
    got = df.select("page_id", html.extract(F.col("html")).alias("text")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got)[2:] == [(2, ""), (3, "")] and len({r["text"] for r in got}) == 2
    assert empty.select(html.extract(F.col("text")).alias("t")).count() == 0


def test_pages_query(spark):
    rows = Q.op2_main_text(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) > 0 and "©" not in r["text"] for r in rows)


# ---------------------------------------------------------------- near duplicates


def slow_simhash(text, words=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs, radius=4):
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(pairs):
        for j in range(i):
            if bin(a ^ pairs[j][1]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(pairs))]


def test_simhash_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(i, slow_simhash(t)) for i, t in rows]
    expected = {i: (f"{f:016x}", c) for (i, f), c in zip(prints, slow_components(prints))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.op3_simhash(spark, SF).collect()}
    assert got == expected


def test_simhash_edge_cases(docs, empty):
    rows = simhash.classify(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {(r["doc_id"], r["fingerprint"]): r for r in rows}
    assert by[1, "0" * 16]["component_id"] == by[3, "0" * 16]["component_id"] == 1
    assert by[None, f"{slow_simhash('no id'):016x}"]["component_id"] is None
    assert sum(r["keep"] for r in rows if r["fingerprint"] == f"{slow_simhash('again three'):016x}") == 1
    assert simhash.classify(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("text = 'again three'").count() == 1
    assert kept.where("doc_id = 3").count() == 1 and kept.where("doc_id is null").count() == 1  # the empty text goes with the null one


@pytest.mark.parametrize("n, radius", [(400, 4), (300, 7), (2, 4)])
def test_all_links_are_found(spark, n, radius):
    """Dense classes, chains and values with more rows than a block."""
    rng = random.Random(n)
    prints = set()
    while len(prints) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            for _ in range(rng.randint(0, radius)):
                base ^= 1 << rng.randrange(64)
            prints.add(base)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    old, simhash.BLOCK_ROWS = simhash.BLOCK_ROWS, 16
    try:
        roots = {r["node"]: r["root"] for r in components.connected_components(simhash.hamming_links(df, radius)).collect()}
    finally:
        simhash.BLOCK_ROWS = old
    expected = slow_components([(simhash._signed(p), p) for p in prints], radius)
    assert [roots.get(simhash._signed(p), simhash._signed(p)) for p in prints] == expected


def test_thresholds_sum_as_the_principle_asks():
    rng = np.random.default_rng(0)
    bits = (rng.random((5000, 64)) < np.linspace(0.05, 0.5, 64)).astype(np.float32)
    together = (bits.T @ bits).astype(np.int64)
    for radius in (2, 4, 6):
        chosen = simhash.choose(10**6, together, radius)
        m = next(m for m in range(1, 9) if sum(len(g) for g, _ in chosen) <= 64 and {tuple(g) for g, _ in chosen} <= {tuple(g) for g in simhash.group_bits(together, 10**6, m)})
        dropped = m - len(chosen)
        assert sum(t for _, t in chosen) - dropped == radius - m + 1


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 2000 + i) for i in range(300)]
    df = spark.createDataFrame([*chain, *hub, (5, 5), (None, 7), (1, 0)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert all(roots[i] == 0 for i in range(201)) and all(roots[2000 + i] == 1000 for i in range(300))


def slow_similar(texts, t=0.8):
    """Places of the texts that stay: the first of each class that five-word similarity connects."""
    cut = lambda w: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [cut((x or "").lower().split()) for x in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= t * len(a | b) - 1e-9:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return [i for i in range(len(sets)) if find(i) == i]


@pytest.mark.parametrize("block", [4096, 8])
def test_stage_keeps_one_of_texts_of_similarity(spark, block):
    """Near copies at more than four bits, chains, a passage that many share, and pairs just under and at 0.8."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    texts = [None, "", "one two", "One  two", "la " * 30, "la " * 90]
    for k in range(30):
        w = [word() for _ in range(rng.randint(60, 220))] + (passage if k % 2 else [])
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 6)):  # each copy of the last: a chain
            for _ in range(rng.randint(1, 5)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    base = [word() for _ in range(94)]  # 90 shingles; 80 of them, and 72 of those 80
    texts += [" ".join(base[:84]), " ".join(base), " ".join(base[:76])]
    exact = [word() for _ in range(104)]
    texts += [" ".join(exact), " ".join(exact[:84])]  # 80 of 100 shingles: 0.8
    under = [word() for _ in range(104)]
    texts += [" ".join(under), " ".join(under[:83])]  # 79 of 100
    order = list(range(len(texts)))
    df = spark.createDataFrame([(i, texts[i], 1) for i in rng.sample(order, len(order))], "doc_id long, text string, key int").repartition(3)
    old, shingles.BLOCK_ROWS = shingles.BLOCK_ROWS, block
    try:
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == slow_similar(texts)
    finally:
        shingles.BLOCK_ROWS = old
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_pipeline_stage_removes_all_similar_texts(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    kept = corpus_pipeline.near_dedup_stage(spark, docs, sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == [rows[i][0] for i in slow_similar([t for _, t in rows])]


# ---------------------------------------------------------------- classifiers


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in Q.op4_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    test = [(rows[i]["score"], y) for i, y in labels.items() if rows[i]["held_out"]]
    good = sum(p > q for p, y in test if y for q, z in test if not z) / max(1, sum(y for _, y in test) * sum(1 - y for _, y in test))
    assert good > 0.95  # area under the curve
    assert sum((p >= 0.5) == y for p, y in test) / len(test) > 0.95


def test_toxicity_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([(5, 1), (9, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(toxicity.classify(docs, model).collect()) == len(TEXTS)
    assert toxicity.classify(empty, toxicity.train(empty, labels.limit(0))).count() == 0
    texts = ["you idiot " * 3, "kind words here", "idiot again", "nothing bad at all"] * 10
    model = toxicity.fit(texts, [1, 0, 1, 0] * 10, least_chi=5)
    assert toxicity.score_text(model, toxicity.lookup(model), "what an idiot") > 0.5 > toxicity.score_text(model, toxicity.lookup(model), "kind and nothing")
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q.op10_language(spark, sf).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    test = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(test) / len(test) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark, empty):
    rows = [(i, "the and of is " * 30, "en") for i in range(12)] + [(50 + i, "und der die das ist " * 30, "de") for i in range(12)] + [(100, None, None), (101, "12 34 !!", "en"), (None, "x", "fr"), (102, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in langid.classify(df, model).collect()}
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == got[102]["lang_pred"] == "und" and got[100]["score"] == 0
    assert got[0]["lang_pred"] == "en" and got[50]["lang_pred"] == "de" and got[50]["accepted"]
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and kept.where("doc_id in (100, 101, 102)").count() == 0
    nothing = langid.train(empty.withColumn("lang", F.lit(None).cast("string")))
    assert langid.classify(df, nothing).where("lang_pred <> 'und'").count() == 0
    assert b"".join(langid.segments(b"ab " * 5000)) == b"ab " * 5000


def test_language_by_length(spark):
    """Snippets of held-out texts of all lengths, in dictionaries alone, and sizes worked out again."""
    import zstandard

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    of = langid.Classifier(langid.train(docs))
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if r["text"] and r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0][:400]
    rng, right = random.Random(1), {}
    for r in rows:
        words = langid.words_only(r["text"]).decode().split()
        for n in (4, 8, 16, 40, 160):
            if len(words) >= n:
                at = rng.randrange(len(words) - n + 1)
                right.setdefault(n, []).append(of(" ".join(words[at : at + n]))[0] == r["lang"])
    assert all(sum(x) / len(x) > (0.9 if n < 8 else 0.95) for n, x in right.items()), {n: sum(x) / len(x) for n, x in right.items()}
    model = langid.Model(["a", "b"], [b"the and of " * 50, b"und der die " * 50])
    for text in ("x", "the and", "und der " * 900):
        raw = langid.words_only(text)
        for d, size in zip(model.dictionaries, langid.Classifier(model).sizes(text)):
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            assert abs(sum(len(c.compress(x + langid.RUN)) for x in langid.segments(raw)) - size) <= 4 * len(langid.segments(raw))


def test_language_is_learned_from_whole_texts(spark):
    """Texts that open with the same boilerplate, and more texts without letters than a language has places."""
    rng = random.Random(6)
    words = {"en": "the and of is with house water people".split(), "de": "und der die das ist haus wasser leute".split()}
    say = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    rows = [(i, "lorem ipsum dolor sit amet " * 25 + say(x, 200), x) for x, start in (("en", 0), ("de", 500)) for i in range(start, start + 30)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [all(w.encode() in d for w in words[x]) for x, d in zip(model.languages, model.dictionaries)] == [True, True]
    of = langid.Classifier(model)
    assert all(of(say(x, n))[0] == x for x in words for n in (30, 300))
    blank = [(1000 + i, (None, "", "12 !!")[i % 3], "en") for i in range(400)]
    few = langid.train(spark.createDataFrame(rows + blank, "doc_id long, text string, lang string"), langid.Sample(documents=8))
    assert few.dictionaries[1].count(b"lorem") > 8


# ---------------------------------------------------------------- URLs and shards


def test_url_rules_and_aliases(spark):
    page = lambda link: f'<html><head><link rel="canonical" href="{link}"></head></html>'
    rows = [
        (0, "https://a.com/en/1", ""), (1, "https://X.example.com/en/77?q=://", ""), (2, "http://b.net/de/9", ""), (3, "http://example.net/de/80", ""), (4, None, None), (5, "nothing", ""),
        (6, "http://p.info/1", page("https://a.com/en/1")), (7, "http://q.info/1", '<META http-equiv="refresh" content="0; url=http://p.info/1#x">'), (8, "http://r.info/1", page("/2")),
        (9, "http://s.info/1", page("http://t.info/1")), (10, "http://t.info/1", page("http://b.net/de/1")), (11, "http://u.info/", page("http://s.info/1") + page("https://a.com/en/2")), (7, "http://q.info/1", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["row"]["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df.select("page_id", "url"), urls.page_links(df), Q.URL_RULES).collect()]
    verdicts = {}
    for g in got:
        verdicts.setdefault(g[0], set()).add(g[4])
    assert len(got) == len(rows)
    assert {k: v.pop() for k, v in verdicts.items()} == {0: "block", 1: "allow", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "allow", 11: "allow"} | {}
    by = {g[0]: g for g in got}
    assert by[1][1:4] == ("x.example.com", "/en/77", "example.com/en/7") and by[4][1:4] == ("", "", None)
    assert urls.judge(df.limit(0).select("url"), urls.page_links(df.limit(0)), Q.URL_RULES).count() == 0


def test_shard_table():
    names = shards.shard_names(7)
    owner = shards.fill(names, 701)
    counts = np.bincount(owner, minlength=7)
    assert counts.min() >= 100 and counts.max() <= 101
    fewer = shards.fill(names[:-1], 701)
    moved = sum(1 for a, b in zip(owner, fewer) if a != b and a != 6)
    assert moved < 0.25 * 701
    with pytest.raises(ValueError):
        shards.fill(names, 700)


def test_shards_place_every_row(docs, empty):
    rows = shards.place(docs, "doc_id", shards.shard_names(3), 307).collect()
    assert len(rows) == len(TEXTS)
    assert len({r["shard"] for r in rows if r["row"]["doc_id"] == 3}) == 1
    assert shards.place(empty, "doc_id", shards.shard_names(3), 307).count() == 0


# ---------------------------------------------------------------- search


def slow_top_k(rows, k, is_query):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in good:
        if is_query(q):
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(heapq.nsmallest(k, scores))}
    return out


@pytest.mark.parametrize("cell, page", [(64, 8), (4096, 256)])
def test_top_k_equals_brute_force(spark, cell, page):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in (centers[i % 6] + rng.normal(size=8) * 0.05) * (1 + i % 3)]) for i in range(500)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)]  # equal vectors: ties
    rows += [(3000 + i, [float(e) for e in v]) for i, v in enumerate([[2.0**21] + [0.0] * 7, [-(2.0**38)] + [0.25] * 7, [0.0] * 7 + [2.0**38], [2.0**21] * 8, [1e-3] * 8, [0.0, 2.0**38] + [0.0] * 6])]
    rows += [(2000, None), (2010, [None] * 8), (2020, [float("nan")] * 8), (2030, [1.0, 2.0]), (2040, []), (None, [0.1] * 8), (2050, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, dim int, cell int").repartition(5)
    old = mtree.CELL_ROWS, mtree.PAGE_ENTRIES
    mtree.CELL_ROWS, mtree.PAGE_ENTRIES = cell, page
    try:
        got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_k(df, F.expr("vec_id % 10 = 0"), k=7).collect()}
    finally:
        mtree.CELL_ROWS, mtree.PAGE_ENTRIES = old
    expected = slow_top_k(rows, 7, lambda q: q % 10 == 0)
    assert max(abs(e[3]) for e in expected) > 2**53
    assert got == expected
    assert mtree.top_k(df.limit(0), F.expr("vec_id % 10 = 0")).count() == 0


def test_a_score_beyond_a_long_is_an_error(spark):
    df = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        mtree.top_k(df, F.expr("vec_id = 0"), k=1).collect()
    assert [(r["vec_id"], r["score"]) for r in mtree.top_k(df, F.expr("vec_id = 2"), k=1).collect()] == [(0, 2**60)]


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-20, 20, size=(200, 6)) + 1000 * c for c in rng.integers(-3, 3, size=(10, 6))])
    longest = float((v.astype(float) ** 2).sum(1).max())
    old, mtree.PAGE_ENTRIES = mtree.PAGE_ENTRIES, 16
    try:
        tree = mtree.Tree(mtree.build_pages(np.arange(len(v)), v, longest), longest)
    finally:
        mtree.PAGE_ENTRIES = old
    _, done = tree.search(v[5], 5, 3, None)
    assert done < 0.7 * len(v)


# ---------------------------------------------------------------- decontamination


def slow_contaminated(docs, items, t=0.8):
    import regex
    from collections import Counter

    cut = lambda x: regex.findall(r"[\p{L}\p{N}]+", (x or "").lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    out = []
    for d, x in docs:
        g = grams(cut(x))
        for i, y in items:
            h = grams(cut(y))
            c, best = Counter(h), None
            n = min(len(g), len(h))
            for s in range(len(g) - n + 1) if n else ():
                shared = sum((Counter(g[s : s + n]) & c).values())
                sim = shared / (n + len(h) - shared)
                if sim >= t and (best is None or sim > best[0]):
                    best = (sim, s)
            if best:
                out.append((d, i, round(best[0], 9), best[1]))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 60)))) for i in range(8)] + [(8, "too short here"), (12, "One"), (13, "a b c d"), (9, None), (None, " ".join(word() for _ in range(20))), (11, "la " * 30)]
    docs = [(0, None), (1, ""), (2, " ".join(word() for _ in range(300))), (3, "la " * 100), (None, f"a {items[1][1]} b"), (5, "few words"), (6, "Too short, here!"), (7, "and too short here it is"), (8, "one"), (9, "a b c")]
    for k in range(40):
        i, t = rng.choice(items[:8] + items[10:11])
        w = t.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = word()
        docs.append((10 + k, " ".join(word() for _ in range(rng.randint(0, 80))) + " " + " , ".join(w).upper() + " " + " ".join(word() for _ in range(rng.randint(0, 80)))))
    docs.append(docs[-1])
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, k int, start int").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, s string")
    got = [(r["doc_id"], r["item_id"], round(r["similarity"], 9), r["start_word"]) for r in decontam.contaminated(d, b).collect()]
    assert sorted(got, key=str) == slow_contaminated(docs, items)
    kept = decontam.keep_clean(d, b)
    bad = {g[0] for g in got}
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)
    old, decontam.PASS_SHINGLES = decontam.PASS_SHINGLES, 60
    try:
        assert decontam.contaminated(d, b).count() == len(got)
    finally:
        decontam.PASS_SHINGLES = old
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0


def test_documents_shorter_than_an_item_are_found(spark):
    """Items with a word or their last tenth left out; at 0.8 exactly and just under it."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    items = [(k, [word() for _ in range(k + 4)]) for k in (12, 20, 40, 200)]
    docs = []
    for k, w in items:
        docs += [(k, w[1:], 1 - 1 / k), (k, w[:-1], 1 - 1 / k), (k, w[: -(len(w) // 10)], 1 - len(w) // 10 / k), (k, w[: len(w) // 2], None)]
    docs += [(20, items[1][1][:20], 0.8), (20, items[1][1][:19], None), (40, ["extra", *items[2][1][4:]], 36 / 41)]
    middle = items[3][1][:100] + items[3][1][101:]  # five shingles lost, four new
    docs.append((200, middle, 195 / 204))
    d = spark.createDataFrame([(n, " ".join(w)) for n, (_, w, _) in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contaminated(d, b).collect()}
    expected = {n: (k, round(t, 9), 0, len(w)) for n, (k, w, t) in enumerate(docs) if t}
    assert {n: (r["item_id"], round(r["similarity"], 9), r["start_word"], r["n_words"]) for n, r in got.items()} == expected
    assert sorted(r["doc_id"] for r in decontam.keep_clean(d, b).collect()) == [n for n in range(len(docs)) if n not in expected]


@pytest.mark.parametrize("k", [27, 54, 63])
def test_a_match_at_exactly_the_similarity_passes_the_filter(spark, k):
    word = lambda i: f"w{i}"
    item = [word(i) for i in range(k + 4)]
    lost = k // 9  # 8 of 9 shingles shared: 0.8
    text = [*item[: k + 4 - lost], *(word(1000 + i) for i in range(100))]
    d = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    b = spark.createDataFrame([(2, " ".join(item))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in decontam.contaminated(d, b).collect()] == [(1, 2, 0.8)]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = Q.queries()[name](spark, sf)
    cursor = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, cursor.fetchall()))


@pytest.mark.parametrize("name, path, end", [("op1_token_records", BYTE, 2), ("op5_pack", WORD, 1)])
def test_token_queries_equal_the_library(spark, name, path, end):
    full, at = Tokenizer.from_file(path), 0
    rows = {(r["doc_id"], r["start"]): r for r in Q.queries()[name](spark, SF).collect()}
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    expected = {}
    for doc, text in texts:
        ids = np.array(full.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        if name == "op1_token_records":
            expected[doc, at] = (len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
        else:
            for start, length in packing.decompose(len(ids), 2048):
                expected[doc, start] = (len(ids), length, zlib.crc32(ids[start : start + length].tobytes()))
    columns = ("n_tokens", "ids_crc32") if name == "op1_token_records" else ("doc_tokens", "length", "ids_crc32")
    assert {k: tuple(r[c] for c in columns) for k, r in rows.items()} == expected


def test_shared_folder_needs_a_setting_on_a_cluster(spark):
    class Cluster:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        storage.shared_root(Cluster())
