"""The query_string and simple_query_string languages, read into clause dicts."""

from __future__ import annotations

import re

from ..config import Refused

DEPTH = 64
_SPECIAL = r'+-!(){}[]^"~*?:\/&|'
_TOKEN = re.compile(
    r"""\s*(?:(?P<op>&&|\|\||AND\b|OR\b|NOT\b|[!+\-](?=\S)|\(|\))
    |(?P<field>(?:\\.|[^\s+\-!(){}\[\]^"~*?:\\/&|<>=])(?:\\.|[^\s(){}\[\]^"~:\\/<>=])*|_exists_):
    |(?P<phrase>"(?:\\.|[^"\\])*")(?:~(?P<slop>\d+))?(?:\^[\d.]+)?
    |(?P<regex>/(?:\\.|[^/\\])*/)(?:\^[\d.]+)?
    |(?P<range>[\[{]\s*(?P<lo>"[^"]*"|\S+)\s+TO\s+(?P<hi>"[^"]*"|[^\s\]}]+)\s*[\]}])(?:\^[\d.]+)?
    |(?P<cmp>[<>]=?)\s*(?P<bound>"[^"]*"|[^\s()]+)
    |(?P<term>(?:\\.|[^\s()\[\]{}"^~:\\])+)(?:~(?P<fuzzy>\d*(?:\.\d+)?))?(?:\^[\d.]+)?)""",
    re.X,
)


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


class _Parser:
    def __init__(self, text: str, default_operator: str):
        self.items, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise Refused(f"query syntax error at {text[at:at + 20]!r}")
            self.items.append(m)
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        self.at, self.default = 0, default_operator.lower()

    def peek(self, *ops: str) -> bool:
        return self.at < len(self.items) and self.items[self.at]["op"] in ops

    def either(self, field: str | None, depth: int) -> dict:
        """A sequence of clauses: + or AND makes one required, - or NOT excludes it."""
        if depth > DEPTH:
            raise Refused("query is nested too deeply")
        must, should, must_not, last, joined = [], [], [], None, None
        while self.at < len(self.items) and not self.peek(")"):
            if self.peek("AND", "&&", "OR", "||"):
                if last is None:
                    raise Refused("query starts with an operator")
                joined = "and" if self.items[self.at]["op"] in ("AND", "&&") else "or"
                self.at += 1
                if self.at >= len(self.items):
                    raise Refused("query ends with an operator")
                if joined == "and" and last is should:
                    must.append(should.pop())
                    last = must
                continue
            prefix = ""
            while self.peek("+", "-", "!", "NOT"):
                prefix = self.items[self.at]["op"]
                self.at += 1
            clause = self.leaf(field, depth)
            if prefix in ("-", "!", "NOT"):
                last = must_not
            elif prefix == "+" or joined == "and" or joined is None and self.default == "and":
                last = must
            else:
                last = should
            last.append(clause)
            joined = None
        if not must and not must_not and len(should) == 1:
            return should[0]
        body = {k: v for k, v in (("must", must), ("should", should), ("must_not", must_not)) if v}
        return {"bool": body} if body else {"match_none": {}}

    def leaf(self, field: str | None, depth: int) -> dict:
        if self.at >= len(self.items):
            raise Refused("query ends where a term is expected")
        m = self.items[self.at]
        self.at += 1
        if m["op"] == "(":
            inner = self.either(field, depth + 1)
            if not self.peek(")"):
                raise Refused("query misses a closing parenthesis")
            self.at += 1
            return inner
        if m["op"]:
            raise Refused(f"query has {m['op']!r} where a term is expected")
        if m["field"]:
            return self.leaf(_plain(m["field"]), depth)
        if m["phrase"]:
            return {"#": "phrase", "field": field, "value": _plain(m["phrase"][1:-1]), "slop": int(m["slop"] or 0)}
        if m["regex"]:
            return {"#": "regexp", "field": field, "value": m["regex"][1:-1].replace("\\/", "/")}
        if m["range"]:
            bounds = {}
            for side, kind in (("lo", "gte" if m["range"][0] == "[" else "gt"), ("hi", "lte" if m["range"][-1] == "]" else "lt")):
                if (v := m[side].strip('"')) != "*":
                    bounds[kind] = v
            return {"#": "range", "field": field, "bounds": bounds}
        if m["cmp"]:
            return {"#": "range", "field": field, "bounds": {{">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[m["cmp"]]: m["bound"].strip('"')}}
        term = m["term"]
        if field == "_exists_":
            return {"exists": {"field": _plain(term)}}
        if term == "*":
            return {"exists": {"field": field}} if field and field != "*" else {"match_all": {}}
        if m["fuzzy"] is not None:
            return {"#": "fuzzy", "field": field, "value": _plain(term), "fuzziness": m["fuzzy"] or "AUTO"}
        if re.search(r"(?<!\\)[*?]", term):
            return {"#": "wildcard", "field": field, "value": term}
        return {"#": "match", "field": field, "value": _plain(term)}


def parse(text: str, default_operator: str = "or") -> dict:
    """A clause tree; leaves with '#' still lack their fields."""
    p = _Parser(text, default_operator)
    if not p.items:
        return {"match_none": {}}
    tree = p.either(None, 0)
    if p.at < len(p.items):
        raise Refused("query has an unmatched closing parenthesis")
    return tree


def parse_simple(text: str, default_operator: str = "or") -> dict:
    """simple_query_string: + | - " * ( ) ~N, read from left to right; what makes no sense is left out."""
    items = re.findall(r'"[^"]*"(?:~\d+)?|[()|+]|-(?=\S)|[^\s()|+"]+', text)
    at = 0

    def group(depth: int) -> dict | None:
        nonlocal at
        now, op = None, default_operator.lower()
        negative = False
        while at < len(items):
            t = items[at]
            at += 1
            if t == ")":
                if depth:
                    break
                continue
            if t in "+|":
                op = "and" if t == "+" else "or"
                continue
            if t == "-":
                negative = True
                continue
            if t == "(":
                clause = group(depth + 1)
            elif t.startswith('"'):
                body, _, slop = t.rpartition("~") if t[-1] != '"' else (t, "", "0")
                clause = {"#": "phrase", "field": None, "value": body.strip('"'), "slop": int(slop or 0)}
            elif len(t) > 1 and t.endswith("*"):
                clause = {"#": "prefix", "field": None, "value": t[:-1]}
            elif m := re.fullmatch(r"(.+)~(\d*)", t):
                clause = {"#": "fuzzy", "field": None, "value": m[1], "fuzziness": m[2] or "AUTO"}
            else:
                clause = {"#": "match", "field": None, "value": t}
            if clause is None:
                continue
            if negative:
                clause, negative = {"bool": {"must_not": [clause]}}, False
            now = clause if now is None else {"bool": {"must": [now, clause]}} if op == "and" else {"bool": {"should": [now, clause], "minimum_should_match": 1}}
            op = default_operator.lower()
        return now

    return group(0) or {"match_none": {}}


def with_fields(tree: dict, fields: list[str]) -> dict:
    """The tree with each leaf spread over its field or the default fields."""
    if "bool" in tree:
        return {"bool": {k: [with_fields(c, fields) for c in v] if isinstance(v, list) else v for k, v in tree["bool"].items()}}
    if "#" not in tree:
        return tree
    names = [tree["field"]] if tree["field"] else fields
    if not names:
        raise Refused("a term without field needs default fields")

    def one(f: str) -> dict:
        v = tree.get("value")
        match tree["#"]:
            case "phrase":
                return {"match_phrase": {f: {"query": v, "slop": tree["slop"]}}}
            case "match":
                return {"match": {f: {"query": v, "operator": "and"}}}
            case "fuzzy":
                return {"fuzzy": {f: {"value": v.lower(), "fuzziness": tree["fuzziness"]}}}
            case "range":
                return {"range": {f: tree["bounds"]}}
            case "wildcard":
                return {"wildcard": {f: {"value": v, "case_insensitive": False}}}
        return {tree["#"]: {f: {"value": v}}}

    return one(names[0]) if len(names) == 1 else {"bool": {"should": [one(f) for f in names], "minimum_should_match": 1}}
