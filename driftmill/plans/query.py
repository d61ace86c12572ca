"""Search clauses to boolean Columns.

A compiled clause may be null where a field is absent, which a filter and a condition read as false, and
which leaves plain comparisons to be pushed to the scan. Negations and counts turn null into false first.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig, Refused
from ..functions import kql, lucene, text
from .fields import Field, Resolver, moment_literal
from ..functions import dates

DEPTH = 128
#: Metres; fixed values of the mean earth radius and of the unit names.
EARTH = 6371008.7714
UNITS = {"": 1, "m": 1, "meters": 1, "km": 1000, "kilometers": 1000, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "miles": 1609.344, "yd": 0.9144, "yards": 0.9144, "ft": 0.3048, "feet": 0.3048, "in": 0.0254, "inch": 0.0254, "nmi": 1852, "NM": 1852, "nauticalmiles": 1852}

#: Keys that a clause may hold; any other is refused. The second set has no bearing on which rows match.
OPTIONS = {
    "bool": {"must", "filter", "should", "must_not", "minimum_should_match", "adjust_pure_negative"},
    "exists": {"field"},
    "ids": {"values"},
    "nested": {"path", "query", "score_mode", "ignore_unmapped", "inner_hits"},
    "constant_score": {"filter"},
    "dis_max": {"queries", "tie_breaker"},
    "boosting": {"positive", "negative", "negative_boost"},
    "function_score": {"query", "functions", "score_mode", "boost_mode", "max_boost", "script_score", "random_score", "field_value_factor", "weight"},
    "script_score": {"query", "script"},
    "script": {"script"},
    "multi_match": {"query", "fields", "type", "operator", "minimum_should_match", "tie_breaker", "fuzziness", "slop", "lenient", "zero_terms_query", "prefix_length"},
    "combined_fields": {"query", "fields", "operator", "minimum_should_match", "zero_terms_query"},
    "query_string": {"query", "fields", "default_field", "default_operator", "analyze_wildcard", "lenient", "time_zone", "type", "allow_leading_wildcard"},
    "simple_query_string": {"query", "fields", "default_operator", "flags", "lenient", "analyze_wildcard"},
    "kql": {"query"},
    "match_all": set(),
    "match_none": set(),
}
FIELD_OPTIONS = {
    "term": {"value", "case_insensitive"},
    "range": {"gt", "gte", "lt", "lte", "from", "to", "include_lower", "include_upper", "format", "time_zone", "relation"},
    "prefix": {"value", "case_insensitive", "rewrite"},
    "wildcard": {"value", "wildcard", "case_insensitive", "rewrite"},
    "regexp": {"value", "flags", "case_insensitive", "max_determinized_states", "rewrite"},
    "fuzzy": {"value", "fuzziness", "prefix_length", "transpositions", "max_expansions", "rewrite"},
    "match": {"query", "operator", "minimum_should_match", "zero_terms_query", "fuzziness", "prefix_length", "fuzzy_transpositions", "max_expansions", "lenient", "analyzer"},
    "match_phrase": {"query", "slop", "zero_terms_query", "analyzer"},
    "match_phrase_prefix": {"query", "slop", "max_expansions", "zero_terms_query", "analyzer"},
    "match_bool_prefix": {"query", "operator", "minimum_should_match", "fuzziness"},
}
SCORING = {"boost", "_name"}


def matches_needed(spec, n: int) -> int:
    """How many of n clauses minimum_should_match asks for: an integer or a share, negative ones may miss."""
    if isinstance(spec, str) and "<" in spec:
        best = None
        for part in spec.split():
            low, rule = part.split("<")
            if n > int(low):
                best = rule
        return n if best is None else matches_needed(best, n)
    s = str(spec).strip()
    if s.endswith("%"):
        share = float(s[:-1])
        k = int(n * abs(share) / 100)
        k = n - k if share < 0 else k
    else:
        k = int(s)
        k = n + k if k < 0 else k
    return max(0, min(n, k)) if int(float(s.rstrip("%"))) < 0 or s.endswith("%") else k


def all_of(parts: list[Column]) -> Column:
    return reduce(and_, parts) if parts else F.lit(True)


def any_of(parts: list[Column]) -> Column:
    return reduce(or_, parts) if parts else F.lit(False)


def at_least(parts: list[Column], k: int) -> Column:
    if k <= 0:
        return F.lit(True)
    if k > len(parts):
        return F.lit(False)
    if k == 1:
        return any_of(parts)
    if k == len(parts):
        return all_of(parts)
    return reduce(lambda a, b: a + b, (known(p).cast("int") for p in parts)) >= k


def known(c: Column) -> Column:
    """A clause with null read as false."""
    return F.coalesce(c, F.lit(False))


class QueryCompiler:
    """Compiles clauses against one DataFrame's fields."""

    def __init__(self, df: DataFrame, config: EngineConfig):
        self.config, self.fields = config, Resolver(df, config)
        self.now = config.moment()

    def compile(self, clause: dict, depth: int = 0) -> Column:
        if depth > DEPTH:
            raise Refused("query is nested too deeply")
        if not isinstance(clause, dict) or len(clause) != 1:
            raise Refused(f"a clause must have exactly one name: {clause!r}"[:200])
        (name, body), = clause.items()
        if name in OPTIONS:
            self.allow(name, body, OPTIONS[name] | SCORING)
        made = getattr(self, f"q_{name}", None)
        if made is None:
            raise Refused(f"unknown query {name!r}")
        return made(body, depth + 1)

    def allow(self, name: str, body: dict, known: set[str]) -> None:
        if not isinstance(body, dict):
            raise Refused(f"{name} must be an object")
        if unknown := set(body) - known:
            raise Refused(f"{name} doesn't know {sorted(unknown)}")

    def one(self, name: str, body: dict, short: str) -> tuple[Field, dict]:
        """The field and options of a clause with a single field, in its short or long form."""
        named = {k: v for k, v in body.items() if k not in SCORING}
        if len(named) != 1:
            raise Refused(f"{name} takes exactly one field")
        (field, options), = named.items()
        options = dict(options) if isinstance(options, dict) else {short: options}
        self.allow(name, options, FIELD_OPTIONS[name] | SCORING)
        return self.fields.find(field), options

    # ------------------------------------------------------------ compound clauses

    def q_match_all(self, body, depth):
        return F.lit(True)

    def q_match_none(self, body, depth):
        return F.lit(False)

    def q_bool(self, body, depth):
        listed = {k: v if isinstance(v, list) else [v] for k, v in body.items() if k in ("must", "filter", "should", "must_not")}
        made = {k: [self.compile(c, depth) for c in v] for k, v in listed.items()}
        parts = [*made.get("must", []), *made.get("filter", []), *(~known(c) for c in made.get("must_not", []))]
        if should := made.get("should"):
            spec = body.get("minimum_should_match")
            parts.append(at_least(should, matches_needed(spec, len(should)) if spec is not None else 0 if made.get("must") or made.get("filter") else 1))
        return all_of(parts)

    def q_constant_score(self, body, depth):
        return self.compile(body["filter"], depth)

    def q_dis_max(self, body, depth):
        return any_of([self.compile(c, depth) for c in body["queries"]])

    def q_boosting(self, body, depth):
        return self.compile(body["positive"], depth)

    def q_function_score(self, body, depth):
        return self.compile(body.get("query", {"match_all": {}}), depth)

    q_script_score = q_function_score

    def q_nested(self, body, depth):
        """One and the same element must pass the whole inner query."""
        path = body["path"]
        holder = self.fields.get(path)
        if not holder.array:
            return self.compile(body["query"], depth)

        def inner(element: Column) -> Column:
            self.fields.bound[path] = (element, holder.dtype)
            try:
                return self.compile(body["query"], depth)
            finally:
                del self.fields.bound[path]

        return F.exists(holder.column, inner)

    def q_script(self, body, depth):
        from ..functions.painless import compile_expression

        return compile_expression(body["script"], self.fields, self.now)

    # ------------------------------------------------------------ terms and ranges

    def q_term(self, body, depth):
        f, o = self.one("term", body, "value")
        value = o["value"]
        if f.text:
            return f.any_value(lambda c: c.rlike(text.word_regex(str(value))))
        if f.kind == "date":
            lo, hi = (dates.moment(value, self.now, up, None, None) for up in (False, True))
            if hi > lo and not isinstance(value, (int, float)):
                return f.any_value(lambda c: (c >= moment_literal(lo, f.dtype)) & (c <= moment_literal(hi, f.dtype)))
        if o.get("case_insensitive") and f.kind == "string":
            return f.any_value(lambda c: text.ascii_lower(c) == text.ascii_lower(F.lit(str(value))))
        try:
            wanted = f.literal(value, now=self.now)
        except ValueError:
            return F.lit(False)
        return F.array_contains(f.column, wanted.cast(f.dtype)) if f.array else f.column == wanted

    def q_terms(self, body, depth):
        named = {k: v for k, v in body.items() if k not in SCORING}
        if len(named) != 1:
            raise Refused("terms takes exactly one field")
        (name, values), = named.items()
        if not isinstance(values, list):
            raise Refused("terms lookup isn't supported")
        f = self.fields.find(name)
        if f.text:
            return any_of([f.any_value(lambda c, v=v: c.rlike(text.word_regex(str(v)))) for v in values])
        wanted = []
        for v in values:
            try:
                wanted.append(f.literal(v, now=self.now).cast(f.dtype))
            except ValueError:
                continue
        if not wanted:
            return F.lit(False)
        return F.arrays_overlap(f.column, F.array(*wanted)) if f.array else f.column.isin(*wanted)

    def q_range(self, body, depth):
        f, o = self.one("range", body, "gte")
        if o.get("relation", "intersects").lower() != "intersects":
            raise Refused("range relation isn't supported")
        bounds = {k: o[k] for k in ("gt", "gte", "lt", "lte") if o.get(k) is not None}
        if o.get("from") is not None:
            bounds["gte" if o.get("include_lower", True) else "gt"] = o["from"]
        if o.get("to") is not None:
            bounds["lte" if o.get("include_upper", True) else "lt"] = o["to"]
        tests = []
        for kind, value in bounds.items():
            v = f.literal(value, up=kind in ("gt", "lte"), now=self.now, tz=o.get("time_zone") or self.config.timezone, fmt=o.get("format"))
            tests.append({"gt": lambda c, v=v: c > v, "gte": lambda c, v=v: c >= v, "lt": lambda c, v=v: c < v, "lte": lambda c, v=v: c <= v}[kind])
        if not tests:
            return f.present()
        return f.any_value(lambda c: all_of([t(c) for t in tests]))

    def q_exists(self, body, depth):
        return self.fields.find(body["field"]).present()

    def q_ids(self, body, depth):
        return self.q_terms({self.config.id_field: body["values"]}, depth)

    # ------------------------------------------------------------ patterns

    def pattern(self, f: Field, regex: str, anchored: str) -> Column:
        """A regular expression on whole values, on a text field on any one token."""
        if f.text:
            return f.any_value(lambda c: F.exists(text.tokens(c), lambda t: t.rlike(anchored)))
        return f.any_value(lambda c: c.cast("string").rlike(regex))

    def q_prefix(self, body, depth):
        f, o = self.one("prefix", body, "value")
        value = str(o["value"])
        if f.text:
            return f.any_value(lambda c: c.rlike(text.word_regex(value, prefix=True)))
        if o.get("case_insensitive"):
            return f.any_value(lambda c: text.ascii_lower(c).startswith(text.ascii_lower(F.lit(value))))
        return f.any_value(lambda c: c.cast("string").startswith(value))

    def q_wildcard(self, body, depth):
        f, o = self.one("wildcard", body, "value")
        value = str(o.get("value", o.get("wildcard")))
        if set(value) == {"*"}:
            return f.present()
        regex = text.wildcard_regex(value, bool(o.get("case_insensitive")))
        return self.pattern(f, regex, text.wildcard_regex(value.lower() if o.get("case_insensitive") else value))

    def q_regexp(self, body, depth):
        f, o = self.one("regexp", body, "value")
        value = str(o["value"])
        if re.search(r"(?<!\\)[@#&~<>]", value) and str(o.get("flags", "ALL")).upper() != "NONE":
            raise Refused("Lucene's own regexp operators aren't supported")
        regex = f"(?{'i' if o.get('case_insensitive') else ''}s)^(?:{value})$"
        return self.pattern(f, regex, regex)

    def q_fuzzy(self, body, depth):
        f, o = self.one("fuzzy", body, "value")
        return self.fuzzy(f, str(o["value"]), o.get("fuzziness"), int(o.get("prefix_length", 0)), bool(o.get("transpositions", True)))

    def fuzzy(self, f: Field, word: str, fuzziness, prefix_length: int, transpositions: bool) -> Column:
        edits = text.auto_fuzziness(fuzziness, word) if prefix_length < len(word) else 0

        def near(c: Column) -> Column:
            close = text.within_edits(c, word, edits, transpositions)
            return close & c.startswith(word[:prefix_length]) if prefix_length else close

        return f.any_value(lambda c: F.exists(text.tokens(c), near) if f.text else near(c))

    # ------------------------------------------------------------ full text

    def words(self, f: Field, words: list[str], operator: str, needed, prefix_last: bool = False, fuzziness=None, prefix_length: int = 0) -> Column:
        parts = []
        for i, w in enumerate(words):
            if fuzziness is not None and not (prefix_last and i == len(words) - 1):
                parts.append(self.fuzzy(f, w, fuzziness, prefix_length, True))
            else:
                regex = text.word_regex(w, prefix=prefix_last and i == len(words) - 1)
                parts.append(f.any_value(lambda c, r=regex: c.rlike(r)))
        if needed is not None and operator != "and":
            return at_least(parts, matches_needed(needed, len(parts)))
        return all_of(parts) if operator == "and" else any_of(parts)

    def match(self, f: Field, o: dict, kind: str) -> Column:
        query = o["query"]
        if not f.text:
            if kind in ("match_phrase_prefix", "match_bool_prefix") and f.kind == "string":
                return f.any_value(lambda c: c.startswith(str(query)))
            if o.get("fuzziness") is not None and f.kind == "string":
                return self.fuzzy(f, str(query), o["fuzziness"], int(o.get("prefix_length", 0)), True)
            return self.q_term({f.name: query}, 0)
        words = text.tokens_of(query)
        if not words:
            return F.lit(str(o.get("zero_terms_query", "none")).lower() == "all")
        if kind in ("match_phrase", "match_phrase_prefix"):
            return f.any_value(lambda c: c.rlike(text.phrase_regex(words, int(o.get("slop", 0)), kind == "match_phrase_prefix")))
        return self.words(f, words, str(o.get("operator", "or")).lower(), o.get("minimum_should_match"), kind == "match_bool_prefix", o.get("fuzziness"), int(o.get("prefix_length", 0)))

    def q_match(self, body, depth):
        return self.match(*self.one("match", body, "query"), "match")

    def q_match_phrase(self, body, depth):
        return self.match(*self.one("match_phrase", body, "query"), "match_phrase")

    def q_match_phrase_prefix(self, body, depth):
        return self.match(*self.one("match_phrase_prefix", body, "query"), "match_phrase_prefix")

    def q_match_bool_prefix(self, body, depth):
        return self.match(*self.one("match_bool_prefix", body, "query"), "match_bool_prefix")

    def named(self, names: list[str] | None) -> list[Field]:
        """Fields by name or glob, boosts dropped; by default the text fields."""
        from fnmatch import fnmatchcase

        wanted = [n.split("^")[0] for n in names or sorted(self.config.text_fields)]
        known = [*self.fields.schema]
        out = []
        for n in wanted:
            out += [k for k in known if fnmatchcase(k, n) and isinstance(self.fields.schema[k], T.StringType)] if "*" in n else [n]
        return [self.fields.find(n) for n in dict.fromkeys(out)]

    def q_multi_match(self, body, depth):
        kind, fields = body.get("type", "best_fields"), self.named(body.get("fields"))
        single = {"phrase": "match_phrase", "phrase_prefix": "match_phrase_prefix", "bool_prefix": "match_bool_prefix"}.get(kind, "match")
        operator = str(body.get("operator", "or")).lower()
        if kind == "cross_fields" and (operator == "and" or "minimum_should_match" in body):
            parts = [any_of([self.words(f, [w], "or", None) for f in fields]) for w in text.tokens_of(body["query"])]
            return all_of(parts) if operator == "and" else at_least(parts, matches_needed(body["minimum_should_match"], len(parts)))
        if kind not in ("best_fields", "most_fields", "cross_fields", "phrase", "phrase_prefix", "bool_prefix"):
            raise Refused(f"multi_match type {kind!r} isn't known")
        return any_of([self.match(f, body, single) for f in fields])

    def q_combined_fields(self, body, depth):
        return self.q_multi_match({**body, "type": "cross_fields"}, depth) if str(body.get("operator", "or")).lower() == "and" or "minimum_should_match" in body else self.q_multi_match(body, depth)

    def q_query_string(self, body, depth):
        names = body.get("fields") or ([body["default_field"]] if body.get("default_field") not in (None, "*") else [])
        names = names or sorted(self.config.text_fields)
        tree = lucene.parse(str(body["query"]), body.get("default_operator", "or"))
        return self.compile(lucene.with_fields(tree, [f.name for f in self.named(names)]), depth)

    def q_simple_query_string(self, body, depth):
        fields = [f.name for f in self.named(body.get("fields"))]
        return self.compile(lucene.with_fields(lucene.parse_simple(str(body["query"]), body.get("default_operator", "or")), fields), depth)

    def q_kql(self, body, depth):
        return self.compile(kql.parse(body["query"]), depth)

    # ------------------------------------------------------------ places

    def q_geo_distance(self, body, depth):
        known = {"distance", "distance_type", "validation_method", "ignore_unmapped"} | SCORING
        named = [k for k in body if k not in known]
        if len(named) != 1:
            raise Refused("geo_distance takes exactly one field")
        within, center = metres(body["distance"]), point(body[named[0]])
        field = self.fields.find(named[0])
        return F.lit(False) if field.kind == "string" else self.distance(field, center) <= within

    def distance(self, f: Field, to: tuple[float, float]) -> Column:
        """Metres along a great circle between a (lat, lon) and a field of lon and lat."""
        lat, lon = (F.radians(f.column.getField(x)) for x in ("lat", "lon"))
        lat2, lon2 = (F.radians(F.lit(float(x))) for x in to)
        h = F.pow(F.sin((lat2 - lat) / 2), F.lit(2)) + F.cos(lat) * F.cos(lat2) * F.pow(F.sin((lon2 - lon) / 2), F.lit(2))
        return 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def metres(distance) -> float:
    m = re.fullmatch(r"\s*([\d.]+)\s*([A-Za-z]*)\s*", str(distance))
    if not m or m[2] not in UNITS:
        raise Refused(f"unknown distance {distance!r}")
    return float(m[1]) * UNITS[m[2]]


def point(value) -> tuple[float, float]:
    """(lat, lon) of an object, a [lon, lat] list or a 'lat,lon' text."""
    if isinstance(value, dict):
        return float(value["lat"]), float(value["lon"])
    if isinstance(value, list):
        return float(value[1]), float(value[0])
    lat, lon = str(value).split(",")
    return float(lat), float(lon)
