"""Painless scripts: a parser, and a compiler to Columns for scripts without loops."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Refused

STEPS = 500
_TOKEN = re.compile(
    r"""\s+|//[^\n]*|/\*.*?\*/
    |(?P<num>0x[\da-fA-F]+[lL]?|\d+\.\d*(?:[eE][+-]?\d+)?[fFdD]?|\.\d+[fFdD]?|\d+(?:[eE][+-]?\d+)?[fFdDlL]?)
    |(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
    |(?P<id>[A-Za-z_]\w*)
    |(?P<op>\?\.|\?:|==~|=~|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%]=|->|::|>>>|<<|>>|[-+*/%<>=!?:;,.(){}\[\]&|^~])""",
    re.X | re.S,
)
_TYPES = {"def", "int", "long", "double", "float", "boolean", "String", "byte", "short", "char", "ZonedDateTime", "Instant", "List", "Map", "ArrayList", "HashMap", "Integer", "Long", "Double", "Boolean", "Object", "var"}


@dataclass
class Node:
    kind: str
    value: object = None
    parts: list = field(default_factory=list)


class Parser:
    def __init__(self, source: str):
        self.items, at = [], 0
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise Refused(f"script can't be read at {source[at:at + 20]!r}")
            if m.lastgroup:
                self.items.append((m.lastgroup, m[0]))
            at = m.end()
        self.items.append(("end", ""))
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.items[self.at][0] != "str" and self.items[self.at][1] in texts

    def take(self, text: str) -> bool:
        if self.peek(text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise Refused(f"script needs {text!r} before {self.items[self.at][1]!r}")

    def program(self) -> list[Node]:
        out = []
        while self.items[self.at][0] != "end":
            out += self.statement()
        return out

    def block(self) -> list[Node]:
        if self.take("{"):
            out = []
            while not self.take("}"):
                out += self.statement()
            return out
        return self.statement()

    def generic(self) -> None:
        if self.take("<"):
            depth = 1
            while depth:
                depth += 1 if self.peek("<") else -1 if self.peek(">") else 0
                self.at += 1

    def declares(self) -> bool:
        kind, word = self.items[self.at]
        if kind != "id" or word not in _TYPES and not word[0].isupper():
            return False
        save = self.at
        self.at += 1
        if self.peek("<") and word in ("List", "Map", "ArrayList", "HashMap"):
            self.generic()
        while self.peek("[") and self.items[self.at + 1][1] == "]":
            self.at += 2
        ok = self.items[self.at][0] == "id" and self.items[self.at + 1][1] in ("=", ";", ":", ",")
        if not ok:
            self.at = save
        return ok

    def statement(self) -> list[Node]:
        if self.take(";"):
            return []
        if self.take("if"):
            self.need("(")
            test = self.expr()
            self.need(")")
            then = self.block()
            other = self.block() if self.take("else") else []
            return [Node("if", None, [test, then, other])]
        if self.take("return"):
            value = None if self.peek(";", "}") or self.items[self.at][0] == "end" else self.expr()
            self.take(";")
            return [Node("return", None, [value])]
        if self.take("for"):
            self.need("(")
            if self.declares():
                name = self.items[self.at][1]
                self.at += 1
                if self.take(":"):
                    over = self.expr()
                    self.need(")")
                    return [Node("each", name, [over, self.block()])]
                first = []
                if self.take("="):
                    first = [Node("let", name, [self.expr()])]
                self.need(";")
            else:
                first = [] if self.peek(";") else [self.simple()]
                self.need(";")
            test = Node("lit", True) if self.peek(";") else self.expr()
            self.need(";")
            step = [] if self.peek(")") else [self.simple()]
            self.need(")")
            return [Node("for", None, [first, test, step, self.block()])]
        if self.take("while"):
            self.need("(")
            test = self.expr()
            self.need(")")
            return [Node("for", None, [[], test, [], self.block()])]
        if self.take("try"):
            body = self.block()
            handler = []
            while self.take("catch"):
                self.need("(")
                while not self.take(")"):
                    self.at += 1
                handler = handler or self.block()
            return [Node("try", None, [body, handler])]
        for word in ("break", "continue"):
            if self.take(word):
                self.take(";")
                return [Node(word)]
        if self.take("throw"):
            value = self.expr()
            self.take(";")
            return [Node("throw", None, [value])]
        if self.declares():
            out = []
            while True:
                name = self.items[self.at][1]
                self.at += 1
                out.append(Node("let", name, [self.expr() if self.take("=") else Node("lit", None)]))
                if not self.take(","):
                    break
            self.take(";")
            return out
        s = self.simple()
        if not self.take(";") and self.items[self.at][0] != "end" and not self.peek("}"):
            raise Refused(f"script needs ';' before {self.items[self.at][1]!r}")
        return [s]

    def simple(self) -> Node:
        left = self.expr()
        for op in ("=", "+=", "-=", "*=", "/=", "%="):
            if self.take(op):
                right = self.expr()
                return Node("assign", None, [left, right if op == "=" else Node("bin", op[0], [left, right])])
        for op in ("++", "--"):
            if self.take(op):
                return Node("assign", None, [left, Node("bin", op[0], [left, Node("lit", 1)])])
        return Node("do", None, [left])

    _LEVELS = [("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "===", "!==", "=~", "==~"), ("<", "<=", ">", ">=", "instanceof"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%")]

    def expr(self) -> Node:
        test = self.binary(0)
        if self.take("?:"):
            return Node("elvis", None, [test, self.expr()])
        if self.take("?"):
            a = self.expr()
            self.need(":")
            return Node("cond", None, [test, a, self.expr()])
        return test

    def binary(self, level: int) -> Node:
        if level == len(self._LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek(*self._LEVELS[level]):
            op = self.items[self.at][1]
            self.at += 1
            left = Node("bin", op, [left, self.binary(level + 1)])
        return left

    def unary(self) -> Node:
        for op in ("!", "-", "+", "~"):
            if self.take(op):
                return Node("un", op, [self.unary()])
        if self.peek("(") and self.items[self.at + 1][1] in _TYPES and self.items[self.at + 2][1] == ")":
            kind = self.items[self.at + 1][1]
            self.at += 3
            return Node("cast", kind, [self.unary()])
        return self.postfix(self.primary())

    def args(self) -> list[Node]:
        out = []
        while not self.take(")"):
            out.append(self.lambda_or_expr())
            self.take(",")
        return out

    def lambda_or_expr(self) -> Node:
        save = self.at
        names = []
        if self.items[self.at][0] == "id" and self.items[self.at + 1][1] == "->":
            names = [self.items[self.at][1]]
            self.at += 2
        elif self.peek("("):
            self.at += 1
            while self.items[self.at][0] == "id":
                names.append(self.items[self.at][1])
                self.at += 1
                if not self.take(","):
                    break
            if not (self.take(")") and self.take("->")):
                names, self.at = [], save
        if names:
            return Node("lambda", names, [self.block() if self.peek("{") else [Node("return", None, [self.expr()])]])
        return self.expr()

    def primary(self) -> Node:
        kind, word = self.items[self.at]
        self.at += 1
        if kind == "num":
            w = word.rstrip("lLfFdD") if not word.startswith("0x") else word.rstrip("lL")
            is_float = "." in w or "e" in w.lower() and not w.startswith("0x") or word[-1] in "fFdD" and not word.startswith("0x")
            return Node("lit", float(w) if is_float else int(w, 0))
        if kind == "str":
            return Node("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), word[1:-1]))
        if word == "(":
            inner = self.expr()
            self.need(")")
            return inner
        if word == "[":
            if self.take(":"):
                self.need("]")
                return Node("map", None, [])
            parts, pairs = [], []
            while not self.take("]"):
                v = self.expr()
                if self.take(":"):
                    pairs.append((v, self.expr()))
                else:
                    parts.append(v)
                self.take(",")
            return Node("map", None, pairs) if pairs else Node("list", None, parts)
        if word == "/":  # a regular expression runs on to the next slash; tokens are joined as they stand
            raise Refused("regex literals are read through grok, matches() or replaceAll() with texts")
        if word in ("true", "false", "null"):
            return Node("lit", {"true": True, "false": False, "null": None}[word])
        if word == "new":
            name = self.items[self.at][1]
            self.at += 1
            self.generic()
            self.need("(")
            return Node("new", name, self.args())
        if kind != "id":
            raise Refused(f"script has {word!r} where a value is expected")
        return Node("id", word)

    def postfix(self, left: Node) -> Node:
        while True:
            if self.peek(".", "?."):
                self.at += 1
                name = self.items[self.at][1]
                self.at += 1
                left = Node("call", name, [left, *self.args()]) if self.take("(") else Node("dot", name, [left])
            elif self.take("["):
                key = self.expr()
                self.need("]")
                left = Node("index", None, [left, key])
            elif left.kind == "id" and self.peek("("):
                self.at += 1
                left = Node("fn", left.value, self.args())
            else:
                return left


def parse(source: str) -> list[Node]:
    return Parser(source).program()


@dataclass
class Value:
    """A Column with what the compiler knows of its type: int, float, string, bool, date, list or other."""

    column: Column
    kind: str = "other"
    field: object = None


_PLUS = {"Seconds": "SECOND", "Minutes": "MINUTE", "Hours": "HOUR", "Days": "DAY", "Weeks": "WEEK", "Months": "MONTH", "Years": "YEAR"}
_PARTS = {"getHour": F.hour, "getMinute": F.minute, "getSecond": F.second, "getDayOfMonth": F.dayofmonth, "getDayOfYear": F.dayofyear, "getMonthValue": F.month, "getYear": F.year}
_DOTS = {"hour": "getHour", "minute": "getMinute", "second": "getSecond", "dayOfMonth": "getDayOfMonth", "dayOfYear": "getDayOfYear", "monthValue": "getMonthValue", "year": "getYear"}
_MATH = {"abs": F.abs, "sqrt": F.sqrt, "log": F.log, "log10": F.log10, "exp": F.exp, "signum": F.signum, "pow": F.pow, "min": F.least, "max": F.greatest}


class Compiler:
    """Turns a script into one Column over a resolver's fields."""

    def __init__(self, fields, params: dict | None = None, now=None):
        self.fields, self.params, self.now, self.steps = fields, params or {}, now, 0

    def field(self, name: str) -> Value:
        f = self.fields.find(name)
        return Value(f.column, "list" if f.array else f.kind, f)

    def literal(self, v) -> Value:
        if isinstance(v, Value):
            return v
        if isinstance(v, (list, tuple)):
            return Value(F.array(*(self.literal(x).column for x in v)), "list")
        kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "string" if isinstance(v, str) else "other"
        return Value(F.lit(v), kind)

    # ---------------------------------------------------------- statements

    def run(self, body: list[Node], env: dict[str, Value], rest: list[Node] = ()) -> Value | None:
        """The value of return or emit, or of the last expression; branches fork, what follows goes into each."""
        self.steps += 1
        if self.steps > STEPS:
            raise Refused("script has too many steps")
        todo, env = [*body, *rest], dict(env)
        for i, s in enumerate(todo):
            after = todo[i + 1 :]
            match s.kind:
                case "return":
                    return self.value(s.parts[0], env) if s.parts[0] else None
                case "let":
                    env[s.value] = self.value(s.parts[0], env)
                case "assign":
                    if s.parts[0].kind != "id":
                        raise Refused("only variables can be assigned in a query script")
                    env[s.parts[0].value] = self.value(s.parts[1], env)
                case "if":
                    test = self.value(s.parts[0], env).column
                    a, b = self.run(s.parts[1], env, after), self.run(s.parts[2], env, after)
                    if a is None and b is None:
                        return None
                    out = F.when(F.coalesce(test, F.lit(False)), (a or self.literal(None)).column).otherwise((b or self.literal(None)).column)
                    return Value(out, (a or b).kind)
                case "do":
                    e = s.parts[0]
                    if e.kind == "fn" and e.value == "emit":
                        return self.value(e.parts[0], env)
                    if not after:
                        return self.value(e, env)
                case _:
                    raise Refused(f"{s.kind} isn't supported in query scripts")
        return None

    # ---------------------------------------------------------- expressions

    def value(self, n: Node, env: dict[str, Value]) -> Value:
        made = getattr(self, f"e_{n.kind}", None)
        if made is None:
            raise Refused(f"{n.kind} isn't supported in query scripts")
        return made(n, env)

    def constant(self, n: Node):
        """What is known while compiling: literals and params."""
        if n.kind == "lit":
            return n.value
        if n.kind == "dot" and n.parts[0].kind == "id" and n.parts[0].value == "params":
            return self.params[n.value]
        if n.kind == "index" and n.parts[0].kind == "id" and n.parts[0].value == "params":
            return self.params[self.constant(n.parts[1])]
        raise Refused("a constant is needed here")

    def e_lit(self, n, env):
        return self.literal(n.value)

    def e_list(self, n, env):
        return Value(F.array(*(self.value(p, env).column for p in n.parts)), "list")

    def e_id(self, n, env):
        if n.value in env:
            return env[n.value]
        if n.value == "_value" and "_value" in self.params:
            return self.literal(self.params["_value"])
        raise Refused(f"unknown variable {n.value!r}")

    def doc_field(self, n: Node) -> str | None:
        """The name in doc['x'], doc.x, ctx._source.x or params._source.x."""
        if n.kind == "index" and n.parts[0].kind == "id" and n.parts[0].value == "doc":
            return str(self.constant(n.parts[1]))
        if n.kind == "call" and n.value == "get" and n.parts[0].kind == "id" and n.parts[0].value == "doc":
            return str(self.constant(n.parts[1]))
        if n.kind in ("dot", "index"):
            base = n.parts[0]
            name = n.value if n.kind == "dot" else self.constant(n.parts[1]) if n.parts[1].kind == "lit" else None
            if name is None:
                return None
            if base.kind == "dot" and base.value == "_source" and base.parts[0].kind == "id":
                return str(name)
            if base.kind in ("dot", "index") and (outer := self.doc_field(base)) and self._source(base):
                return f"{outer}.{name}"
        return None

    def _source(self, n: Node) -> bool:
        return n.kind == "dot" and n.value == "_source" or n.kind in ("dot", "index") and self._source(n.parts[0])

    def e_index(self, n, env):
        if name := self.doc_field(n):
            return self.field(name)
        try:
            return self.literal(self.constant(n))
        except (Refused, KeyError):
            base, key = self.value(n.parts[0], env), self.value(n.parts[1], env)
            if base.kind == "list":
                return Value(F.get(base.column, key.column.cast("int")), "other")
            raise Refused("this index isn't supported in query scripts") from None

    def e_dot(self, n, env):
        base = n.parts[0]
        if name := self.doc_field(n):
            return self.field(name)
        if base.kind == "id" and base.value == "params":
            return self.literal(self.params[n.value])
        if name := self.doc_field(base):
            f = self.field(name)
            if n.value == "value":
                return Value(F.element_at(F.array_sort(f.column), 1) if f.kind == "list" else f.column, f.field.kind if f.field else f.kind, f.field)
            if n.value == "values":
                return f
            if n.value == "empty":
                return Value(f.field.missing(), "bool")
            if n.value == "length":
                return Value(F.size(f.column) if f.kind == "list" else F.when(f.field.missing(), 0).otherwise(1), "int")
        v = self.value(base, env)
        if n.value == "length":
            return Value(F.size(v.column) if v.kind == "list" else F.length(v.column), "int")
        if n.value in _DOTS:
            return Value(_PARTS[_DOTS[n.value]](v.column), "int")
        if n.value in ("millis",):
            return Value(F.unix_millis(v.column.cast("timestamp")), "int")
        raise Refused(f".{n.value} isn't supported in query scripts")

    def e_cast(self, n, env):
        v = self.value(n.parts[0], env)
        kinds = {"int": ("int", "int"), "long": ("bigint", "int"), "double": ("double", "float"), "float": ("float", "float"), "String": ("string", "string"), "boolean": ("boolean", "bool"), "short": ("smallint", "int"), "byte": ("tinyint", "int")}
        if n.value not in kinds:
            return v
        to, kind = kinds[n.value]
        return Value(v.column.try_cast(to), kind)

    def e_un(self, n, env):
        v = self.value(n.parts[0], env)
        if n.value == "!":
            return Value(~F.coalesce(v.column, F.lit(False)), "bool")
        return Value(-v.column if n.value == "-" else F.bitwise_not(v.column) if n.value == "~" else v.column, v.kind)

    def e_cond(self, n, env):
        t, a, b = (self.value(p, env) for p in n.parts)
        return Value(F.when(F.coalesce(t.column, F.lit(False)), a.column).otherwise(b.column), a.kind if a.kind != "other" else b.kind)

    def e_elvis(self, n, env):
        a, b = (self.value(p, env) for p in n.parts)
        return Value(F.coalesce(a.column, b.column), a.kind if a.kind != "other" else b.kind)

    def e_bin(self, n, env):
        op = n.value
        a, b = self.value(n.parts[0], env), self.value(n.parts[1], env)
        x, y = a.column, b.column
        kind = "int" if a.kind == b.kind == "int" else "float"
        match op:
            case "&&":
                return Value(F.coalesce(x, F.lit(False)) & F.coalesce(y, F.lit(False)), "bool")
            case "||":
                return Value(F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)), "bool")
            case "==" | "===":
                return Value(x.eqNullSafe(y), "bool")
            case "!=" | "!==":
                return Value(~x.eqNullSafe(y), "bool")
            case "<" | "<=" | ">" | ">=":
                return Value({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")
            case "+":
                if "string" in (a.kind, b.kind):
                    return Value(F.concat(*(F.coalesce(v.column.cast("string"), F.lit("null")) for v in (a, b))), "string")
                return Value(x + y, kind)
            case "-":
                return Value(x - y, kind)
            case "*":
                return Value(x * y, kind)
            case "/":
                if kind == "int":  # towards zero, as in Java; exact beyond 2**53
                    return Value(F.try_divide(x - F.try_mod(x, y), y).cast("bigint"), "int")
                return Value(F.try_divide(x, y), "float")
            case "%":
                return Value(F.try_mod(x, y), kind)
            case "&" | "|" | "^":
                made = {"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op] if kind == "int" else {"&": x & y, "|": x | y, "^": x != y}[op]
                return Value(made, "int" if kind == "int" else "bool")
            case "=~":
                return Value(x.rlike(str(self.constant(n.parts[1]))), "bool")
            case "==~":
                return Value(x.rlike(f"^(?:{self.constant(n.parts[1])})$"), "bool")
        raise Refused(f"operator {op} isn't supported")

    def e_fn(self, n, env):
        if n.value in ("grok", "dissect"):
            return Value(F.lit(None), "pattern", (n.value, str(self.constant(n.parts[0]))))
        raise Refused(f"function {n.value} isn't supported")

    def e_call(self, n, env):
        base, name, args = n.parts[0], n.value, n.parts[1:]
        if base.kind == "id" and base.value not in env:
            if made := self.static(base.value, name, args, env):
                return made
        if doc := self.doc_field(base):
            f = self.field(doc).field
            if name == "size":
                return Value(F.size(F.coalesce(f.column, F.array())) if f.array else F.when(f.missing(), 0).otherwise(1), "int")
            if name == "isEmpty" and f.kind != "string":
                return Value(f.missing(), "bool")
            if name == "getValue":
                return self.e_dot(Node("dot", "value", [base]), env)
        v = self.value(base, env)
        if v.kind == "pattern" and name == "extract":
            return Value(self.value(args[0], env).column, "extract", v.field)
        return self.method(v, name, args, env)

    def static(self, owner: str, name: str, args: list[Node], env) -> Value | None:
        values = lambda: [self.value(a, env) for a in args]
        match owner, name:
            case "Math", ("floor" | "ceil" | "round"):
                v = values()[0].column
                made = {"floor": F.floor, "ceil": F.ceil}[name](v) if name != "round" else F.floor(v + 0.5)
                return Value(made.cast("double" if name != "round" else "bigint"), "float" if name != "round" else "int")
            case "Math", _ if name in _MATH:
                vs = values()
                return Value(_MATH[name](*(v.column for v in vs)), "int" if name in ("abs", "min", "max") and all(v.kind == "int" for v in vs) else "float")
            case ("Integer" | "Long" | "Double" | "Float" | "Boolean"), ("parseInt" | "parseLong" | "parseDouble" | "parseFloat" | "parseBoolean" | "valueOf"):
                to, kind = {"Integer": ("int", "int"), "Long": ("bigint", "int"), "Double": ("double", "float"), "Float": ("float", "float"), "Boolean": ("boolean", "bool")}[owner]
                v = values()[0]
                return Value(F.lower(v.column.cast("string")) == "true" if owner == "Boolean" else v.column.try_cast(to), kind)
            case ("String", "valueOf") | (("Integer" | "Long" | "Double"), "toString"):
                return Value(values()[0].column.cast("string"), "string")
            case "String", "join":
                a, b = values()
                return Value(F.array_join(b.column, str(self.constant(args[0]))), "string")
            case "Objects", ("isNull" | "nonNull"):
                v = values()[0].column
                return Value(v.isNull() if name == "isNull" else v.isNotNull(), "bool")
            case "Objects", "equals":
                a, b = values()
                return Value(a.column.eqNullSafe(b.column), "bool")
            case "Instant", ("ofEpochMilli" | "ofEpochSecond"):
                v = values()[0].column
                return Value(F.timestamp_millis(v) if name == "ofEpochMilli" else F.timestamp_seconds(v), "date")
            case "ZonedDateTime", ("parse" | "ofInstant"):
                v = values()[0]
                return Value(v.column.try_cast("timestamp"), "date")
            case "ZoneId", "of":
                return Value(F.lit(self.constant(args[0])), "zone", self.constant(args[0]))
            case "DateTimeFormatter", "ofPattern":
                return Value(F.lit(self.constant(args[0])), "format", self.constant(args[0]))
            case "doc", "containsKey":
                try:
                    self.fields.get(str(self.constant(args[0])))
                    return self.literal(True)
                except KeyError:
                    return self.literal(False)
            case "params", ("get" | "containsKey"):
                key = str(self.constant(args[0]))
                return self.literal(key in self.params if name == "containsKey" else self.params.get(key))
        return None

    def method(self, v: Value, name: str, args: list[Node], env) -> Value:
        c = v.column
        arg = lambda i=0: self.value(args[i], env)
        if name == "between" and len(args) == 2:
            raise Refused("ChronoUnit is read as ChronoUnit.UNIT.between(a, b)")
        if name in _PARTS:
            return Value(_PARTS[name](c), "int")
        match name:
            case "getDayOfWeek" | "getDayOfWeekEnum":
                return Value(F.weekday(c) + 1, "int" if name == "getDayOfWeek" else "weekday", c)
            case "getValue" if v.kind == "weekday":
                return Value(c, "int")
            case "getDisplayName" if v.kind == "weekday":
                return Value(F.date_format(v.field, "EEEE"), "string")
            case "toInstant" | "toZonedDateTime" | "toLocalDateTime":
                return Value(c, "date")
            case "toLocalDate":
                return Value(c.cast("date"), "date")
            case "toEpochMilli" | "getMillis":
                return Value(F.unix_millis(c.cast("timestamp")), "int")
            case "toEpochSecond":
                return Value(F.unix_seconds(c.cast("timestamp")), "int")
            case "withZoneSameInstant" | "atZone":
                zone = arg().field or self.constant(args[0])
                return Value(F.from_utc_timestamp(c, zone), "date")
            case "format":
                return Value(F.date_format(c, arg().field or str(self.constant(args[0]))), "string")
            case "isAfter" | "isBefore" | "isEqual":
                o = arg().column
                return Value({"isAfter": c > o, "isBefore": c < o, "isEqual": c == o}[name], "bool")
            case "truncatedTo":
                unit = args[0].value.rstrip("S").lower()
                return Value(F.date_trunc(unit, c), "date")
            case "toLowerCase":
                return Value(F.lower(c), "string")
            case "toUpperCase":
                return Value(F.upper(c), "string")
            case "trim":
                return Value(F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), "string")
            case "length":
                return Value(F.length(c), "int")
            case "isEmpty":
                return Value(F.size(c) == 0 if v.kind == "list" else c == "", "bool")
            case "size":
                return Value(F.size(c), "int")
            case "substring":
                start = arg().column
                length = arg(1).column - start if len(args) > 1 else F.length(c) - start
                return Value(F.substring(c, start + 1, length), "string")
            case "indexOf":
                return Value((F.instr(c, str(self.constant(args[0]))) if args[0].kind == "lit" else F.locate(arg().column, c)) - 1, "int")
            case "contains":
                return Value(F.array_contains(c, arg().column) if v.kind == "list" else c.contains(arg().column), "bool")
            case "startsWith":
                return Value(c.startswith(arg().column), "bool")
            case "endsWith":
                return Value(c.endswith(arg().column), "bool")
            case "equals":
                return Value(c.eqNullSafe(arg().column), "bool")
            case "equalsIgnoreCase":
                return Value(F.lower(c) == F.lower(arg().column), "bool")
            case "compareTo":
                o = arg().column
                return Value(F.when(c < o, -1).when(c > o, 1).otherwise(0), "int")
            case "replace":
                return Value(F.replace(c, arg().column, arg(1).column), "string")
            case "replaceAll":
                return Value(F.regexp_replace(c, str(self.constant(args[0])), str(self.constant(args[1]))), "string")
            case "replaceFirst":
                rx = str(self.constant(args[0]))
                return Value(F.regexp_replace(c, f"(?s)^(.*?)(?:{rx})", "$1" + str(self.constant(args[1]))), "string")
            case "matches":
                return Value(c.rlike(f"^(?:{self.constant(args[0])})$"), "bool")
            case "splitOnToken" | "split":
                rx = str(self.constant(args[0]))
                return Value(F.split(c, re.escape(rx) if name == "splitOnToken" else rx), "list")
            case "charAt":
                return Value(F.substring(c, arg().column + 1, F.lit(1)), "string")
            case "toString":
                return Value(c.cast("string"), "string")
            case "get":
                return Value(F.get(c, arg().column), "other")
            case "intValue" | "longValue":
                return Value(c.try_cast("bigint"), "int")
            case "doubleValue":
                return Value(c.try_cast("double"), "float")
        m = re.fullmatch(r"(plus|minus)(Seconds|Minutes|Hours|Days|Weeks|Months|Years)", name)
        if m:
            n = arg().column.cast("int")
            return Value(F.timestamp_add(_PLUS[m[2]], n if m[1] == "plus" else -n, c), "date")
        raise Refused(f"method {name} isn't supported in query scripts")


def script_of(script) -> tuple[str, dict]:
    if isinstance(script, str):
        return script, {}
    if script.get("lang", "painless") not in ("painless", "expression"):
        raise Refused(f"script language {script['lang']!r} isn't supported")
    if "id" in script:
        raise Refused("stored scripts aren't supported")
    return script.get("source", script.get("inline", "")), script.get("params", {})


class _Compiler(Compiler):
    def e_call(self, n, env):
        base = n.parts[0]
        if base.kind == "dot" and base.parts[0].kind == "id" and base.parts[0].value == "ChronoUnit" and n.value == "between":
            a, b = (self.value(p, env).column for p in n.parts[1:])
            return Value(F.timestamp_diff(base.value.rstrip("S"), a.cast("timestamp"), b.cast("timestamp")), "int")
        return super().e_call(n, env)

    def e_dot(self, n, env):
        base = n.parts[0]
        if base.kind == "call" and base.value == "extract":
            from .grok import extractor

            v = self.value(base, env)
            if v.kind == "extract":
                how, pattern = v.field
                return Value(extractor(how, pattern)(v.column).getItem(n.value), "string")
        return super().e_dot(n, env)


def compile_expression(script, fields, now=None, params: dict | None = None) -> Column:
    """A script's value as a Column; ``params`` adds named Columns (of bucket scripts) to the script's own."""
    source, own = script_of(script)
    made = _Compiler(fields, {**own, **{k: Value(v, "float") if isinstance(v, Column) else v for k, v in (params or {}).items()}}, now).run(parse(source), {})
    return made.column if made is not None else F.lit(None)
