"""Text analyzers: char filters, a tokenizer and token filters as one array Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Refused
from .text import TOKEN

#: The English stop words and the articles that elision drops.
ENGLISH_STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
ELISION = "l m t qu n s j d c jusqu quoiqu lorsqu puisqu".split()

BUILT_IN = {
    "standard": {"tokenizer": "standard", "filter": ["lowercase"]},
    "simple": {"tokenizer": "lowercase"},
    "whitespace": {"tokenizer": "whitespace"},
    "keyword": {"tokenizer": "keyword"},
    "stop": {"tokenizer": "lowercase", "filter": ["stop"]},
    "pattern": {"tokenizer": "pattern", "filter": ["lowercase"]},
}


def _named(kind: str, name, settings: dict) -> dict:
    if isinstance(name, dict):
        return name
    return settings.get(kind, {}).get(name, {"type": name})


def char_filter(c: Column, o: dict) -> Column:
    match o["type"]:
        case "html_strip":
            c = F.regexp_replace(c, r"(?s)<!--.*?-->|<[^>]*>", "")
            for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
                c = F.replace(c, F.lit(entity), F.lit(char))
            return c
        case "mapping":
            for m in o["mappings"]:
                a, b = (x.strip() for x in m.split("=>"))
                c = F.replace(c, F.lit(a), F.lit(b))
            return c
        case "pattern_replace":
            return F.regexp_replace(c, o["pattern"], o.get("replacement", ""))
    raise Refused(f"char filter {o['type']!r} isn't supported")


def grams(t: Column, least: int, most: int, edge: bool) -> Column:
    """Substrings of least to most characters, at the start only or anywhere."""
    n = F.length(t)
    starts = F.array(F.lit(1)) if edge else F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    made = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(least), F.lit(most)), lambda k: F.when(s + k - 1 <= n, F.substring(t, s, k)))))
    return F.filter(made, lambda g: g.isNotNull())


def tokenizer(c: Column, o: dict) -> Column:
    every = lambda rx: F.regexp_extract_all(c, F.lit(f"({rx})"), F.lit(1))
    match o["type"]:
        case "standard":
            return F.filter(every(TOKEN), lambda t: t.rlike(r"[\p{L}\p{N}]"))
        case "whitespace":
            return every(r"\S+")
        case "letter":
            return every(r"\p{L}+")
        case "lowercase":
            return F.transform(every(r"\p{L}+"), F.lower)
        case "keyword":
            return F.array(c)
        case "pattern":
            group = int(o.get("group", -1))
            rx = o.get("pattern", r"\W+")
            if group >= 0:
                return F.regexp_extract_all(c, F.lit(rx), F.lit(group))
            return F.filter(F.split(c, rx), lambda t: t != "")
        case "char_group":
            kinds = {"whitespace": r"\s", "letter": r"\p{L}", "digit": r"\d", "punctuation": r"\p{Punct}", "symbol": r"\p{S}"}
            cls = "".join(kinds.get(x, re.escape(x)) for x in o["tokenize_on_chars"])
            return F.filter(F.split(c, f"[{cls}]"), lambda t: t != "")
        case "ngram" | "edge_ngram":
            return grams(c, int(o.get("min_gram", 1)), int(o.get("max_gram", 2)), o["type"] == "edge_ngram")
        case "path_hierarchy":
            sep = o.get("delimiter", "/")
            parts = F.split(c, re.escape(sep))
            heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))
            return F.filter(heads, lambda t: t != "")
    raise Refused(f"tokenizer {o['type']!r} isn't supported")


_FOLD = ("àáâãäåÀÁÂÃÄÅçÇèéêëÈÉÊËìíîïÌÍÎÏñÑòóôõöøÒÓÔÕÖØùúûüÙÚÛÜýÿÝ", "aaaaaaAAAAAAcCeeeeEEEEiiiiIIIInNooooooOOOOOOuuuuUUUUyyY")


def token_filter(ts: Column, o: dict) -> Column:
    match o["type"]:
        case "lowercase":
            return F.transform(ts, F.lower)
        case "uppercase":
            return F.transform(ts, F.upper)
        case "trim":
            return F.transform(ts, F.trim)
        case "reverse":
            return F.transform(ts, F.reverse)
        case "asciifolding":
            fold = lambda t: F.replace(F.replace(F.replace(F.translate(t, *_FOLD), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
            return F.transform(ts, fold)
        case "unique":
            return F.array_distinct(ts)
        case "truncate":
            return F.transform(ts, lambda t: F.substring(t, 1, int(o.get("length", 10))))
        case "length":
            return F.filter(ts, lambda t: F.length(t).between(int(o.get("min", 0)), int(o.get("max", 2**31 - 1))))
        case "stop":
            words = o.get("stopwords", "_english_")
            words = ENGLISH_STOP if words == "_english_" else [] if words == "_none_" else words
            fold = F.lower if o.get("ignore_case") else (lambda t: t)
            return F.filter(ts, lambda t: ~fold(t).isin([*words])) if words else ts
        case "ngram" | "edge_ngram":
            return F.flatten(F.transform(ts, lambda t: grams(t, int(o.get("min_gram", 1)), int(o.get("max_gram", 2)), o["type"] == "edge_ngram")))
        case "pattern_replace":
            return F.transform(ts, lambda t: F.regexp_replace(t, o["pattern"], o.get("replacement", "")))
        case "elision":
            articles = "|".join(re.escape(a) for a in o.get("articles", ELISION))
            return F.transform(ts, lambda t: F.regexp_replace(t, f"(?i)^(?:{articles})['’]", ""))
        case "synonym" | "synonym_graph":
            known: dict[str, list[str]] = {}
            for rule in o["synonyms"]:
                left, arrow, right = rule.partition("=>")
                sources, targets = ([w.strip() for w in x.split(",")] for x in (left, right if arrow else left))
                for s in sources:
                    known[s] = known.get(s, []) + [t for t in (targets if arrow else [s, *(t for t in targets if t != s)]) if t not in known.get(s, [])]
            table = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.array(*(F.lit(t) for t in v)))))
            return F.flatten(F.transform(ts, lambda t: F.coalesce(F.try_element_at(table, t), F.array(t))))
        case "stemmer" | "porter_stem" | "snowball" | "kstem":
            if o["type"] == "stemmer" and o.get("language", "english") not in ("english", "porter2", "light_english", "minimal_english"):
                raise Refused(f"stemmer {o['language']!r} isn't supported")
            return F.transform(ts, plural_stem)
    raise Refused(f"token filter {o['type']!r} isn't supported")


def plural_stem(t: Column) -> Column:
    """English plurals and past forms cut off: an approximation of the stemmers, which have more steps."""
    t = F.regexp_replace(t, "(?:ss)es$", "ss")
    t = F.when(t.rlike("[^aeiou]ies$"), F.regexp_replace(t, "ies$", "i")).when(t.rlike("[^su]s$"), F.regexp_replace(t, "s$", "")).otherwise(t)
    return F.when(t.rlike("[aeiouy].*[^e]ed$"), F.regexp_replace(t, "ed$", "")).when(t.rlike("[aeiouy].*ing$"), F.regexp_replace(t, "ing$", "")).otherwise(t)


def analyze(c: Column, analyzer: str | dict, settings: dict | None = None) -> Column:
    """The tokens that an analyzer (by name, or given in place) makes of a text column."""
    settings = settings or {}
    o = analyzer if isinstance(analyzer, dict) else settings.get("analyzer", {}).get(analyzer) or BUILT_IN.get(analyzer)
    if o is None:
        raise Refused(f"unknown analyzer {analyzer!r}")
    if o.get("type", "custom") in BUILT_IN:
        base = BUILT_IN[o["type"]]
        o = {**base, **({"filter": [*base.get("filter", []), {"type": "stop", "stopwords": o["stopwords"]}]} if "stopwords" in o and o["type"] == "standard" else {})} | ({"tokenizer": {"type": "pattern", "pattern": o["pattern"]}} if "pattern" in o else {})
    listed = lambda v: v if isinstance(v, list) else [v] if v else []
    for f in listed(o.get("char_filter")):
        c = char_filter(c, _named("char_filter", f, settings))
    ts = tokenizer(c, _named("tokenizer", o["tokenizer"], settings))
    for f in listed(o.get("filter")):
        ts = token_filter(ts, _named("filter", f, settings))
    return ts


def has_all(ts: Column, words: list[str]) -> Column:
    return F.size(F.array_except(F.array(*(F.lit(w) for w in words)), ts)) == 0


def has_any(ts: Column, words: list[str]) -> Column:
    return F.arrays_overlap(ts, F.array(*(F.lit(w) for w in words)))


def has_run(ts: Column, words: list[str]) -> Column:
    """Whether the words stand one after the other."""
    wanted = F.array(*(F.lit(w) for w in words))
    return F.exists(F.sequence(F.lit(1), F.greatest(F.size(ts), F.lit(1))), lambda i: F.slice(ts, i, len(words)) == wanted)
