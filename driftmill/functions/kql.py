"""KQL, read into clause dicts."""

from __future__ import annotations

import re

from ..config import Refused

_TOKEN = re.compile(r'\s*(?:(?P<p>[(){}:]|<=|>=|<|>)|(?P<q>"(?:\\.|[^"\\])*")|(?P<w>(?:\\.|[^\s(){}:<>"\\])+))')


class _Parser:
    def __init__(self, text: str):
        self.items, at, text = [], 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise Refused(f"KQL syntax error at {text[at:at + 20]!r}")
            self.items.append(("p", m["p"]) if m["p"] else ("q", re.sub(r"\\(.)", r"\1", m["q"][1:-1])) if m["q"] is not None else ("w", m["w"]))
            at = m.end()
        self.at = 0

    def is_word(self, word: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] == "w" and self.items[self.at][1].lower() == word

    def take(self, mark: str) -> bool:
        if self.at < len(self.items) and self.items[self.at] == ("p", mark):
            self.at += 1
            return True
        return False

    def many(self, next_level, word: str, wrap, *args) -> dict:
        parts = [next_level(*args)]
        while self.is_word(word):
            self.at += 1
            parts.append(next_level(*args))
        return parts[0] if len(parts) == 1 else wrap(parts)

    def either(self, field=None, path="") -> dict:
        return self.many(self.both, "or", lambda p: {"bool": {"should": p, "minimum_should_match": 1}}, field, path)

    def both(self, field, path) -> dict:
        return self.many(self.negated, "and", lambda p: {"bool": {"filter": p}}, field, path)

    def negated(self, field, path) -> dict:
        if self.is_word("not"):
            self.at += 1
            return {"bool": {"must_not": [self.negated(field, path)]}}
        return self.leaf(field, path)

    def leaf(self, field, path) -> dict:
        if self.take("("):
            inner = self.either(field, path)
            if not self.take(")"):
                raise Refused("KQL misses a closing parenthesis")
            return inner
        kind, text = self.value()
        if field is not None:
            return self.test(field, kind, text)
        name = path + re.sub(r"\\(.)", r"\1", text)
        if self.take(":"):
            if self.take("{"):
                inner = self.either(None, name + ".")
                if not self.take("}"):
                    raise Refused("KQL misses a closing brace")
                return {"nested": {"path": name, "query": inner}}
            if self.take("("):
                inner = self.either(name, path)
                if not self.take(")"):
                    raise Refused("KQL misses a closing parenthesis")
                return inner
            return self.test(name, *self.value())
        for mark, bound in (("<=", "lte"), (">=", "gte"), ("<", "lt"), (">", "gt")):
            if self.take(mark):
                return {"range": {name: {bound: self.value()[1]}}}
        return self.test(None, kind, text)

    def value(self) -> tuple[str, str]:
        if self.at >= len(self.items) or self.items[self.at][0] == "p":
            raise Refused("KQL misses a value")
        kind, text = self.items[self.at]
        self.at += 1
        while kind == "w" and self.at < len(self.items) and self.items[self.at][0] == "w" and self.items[self.at][1].lower() not in ("and", "or", "not"):
            text += " " + self.items[self.at][1]
            self.at += 1
        return kind, text

    def test(self, field, kind, text) -> dict:
        if kind == "w" and text == "*":
            return {"exists": {"field": field}} if field else {"match_all": {}}
        if kind == "w" and re.search(r"(?<!\\)\*", text):
            return {"query_string": {"query": re.sub(r"\s", r"\\ ", text), "fields": [field] if field else []}}
        text = re.sub(r"\\(.)", r"\1", text) if kind == "w" else text
        if not field:
            return {"multi_match": {"query": text, "type": "phrase" if kind == "q" else "best_fields"}}
        return {"match_phrase" if kind == "q" else "match": {field: text}}


def parse(text: str) -> dict:
    p = _Parser(text)
    if not p.items:
        return {"match_all": {}}
    tree = p.either()
    if p.at < len(p.items):
        raise Refused(f"KQL can't be read at {p.items[p.at][1]!r}")
    return tree
