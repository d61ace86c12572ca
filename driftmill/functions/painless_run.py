"""Runs scripts that no Column can express (loops, lambdas, streams) on one event at a time."""

from __future__ import annotations

import math
import re

from .painless import Node, parse

#: Turns of a script's loops, and calls within calls, before it is stopped.
LOOPS, DEPTH = 1024, 64


class ScriptError(Exception):
    """What a script throws, or what it does that isn't supported."""


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


class _Return(Exception):
    def __init__(self, value):
        self.value = value


def text_of(v) -> str:
    """A value as Java writes it."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e7:
        return f"{v:.1f}"
    if isinstance(v, list):
        return "[" + ", ".join(map(text_of, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{k}={text_of(x)}" for k, x in v.items()) + "}"
    return str(v)


class Interpreter:
    """One script; ``run`` changes a ctx dict in place and gives what the script returns."""

    def __init__(self, source: str, params: dict | None = None):
        self.body, self.params = parse(source), params or {}

    def run(self, ctx: dict):
        self.turns = 0
        try:
            self.block(self.body, {"ctx": ctx, "params": self.params})
        except _Return as r:
            return r.value
        return None

    # ------------------------------------------------------------ statements

    def block(self, body: list[Node], env: dict) -> None:
        for s in body:
            self.statement(s, env)

    def turn(self) -> None:
        self.turns += 1
        if self.turns > LOOPS:
            raise ScriptError("The maximum number of statements that can be executed in a loop has been reached.")

    def statement(self, s: Node, env: dict) -> None:
        match s.kind:
            case "let":
                env[s.value] = self.value(s.parts[0], env)
            case "assign":
                self.assign(s.parts[0], self.value(s.parts[1], env), env)
            case "do":
                self.value(s.parts[0], env)
            case "if":
                self.block(s.parts[1] if self.value(s.parts[0], env) else s.parts[2], env)
            case "return":
                raise _Return(self.value(s.parts[0], env) if s.parts[0] else None)
            case "each":
                over = self.value(s.parts[0], env)
                for v in list(over):
                    self.turn()
                    env[s.value] = v
                    try:
                        self.block(s.parts[1], env)
                    except _Continue:
                        continue
                    except _Break:
                        break
            case "for":
                first, test, step, body = s.parts
                self.block(first, env)
                while self.value(test, env):
                    self.turn()
                    try:
                        self.block(body, env)
                    except _Continue:
                        pass
                    except _Break:
                        break
                    self.block(step, env)
            case "break":
                raise _Break
            case "continue":
                raise _Continue
            case "throw":
                v = self.value(s.parts[0], env)
                raise ScriptError(text_of(v))
            case "try":
                try:
                    self.block(s.parts[0], env)
                except (ScriptError, TypeError, ValueError, KeyError, IndexError, ZeroDivisionError, AttributeError):
                    self.block(s.parts[1], env)
            case _:
                raise ScriptError(f"{s.kind} isn't supported")

    def assign(self, target: Node, value, env: dict) -> None:
        if target.kind == "id":
            env[target.value] = value
            return
        holder = self.value(target.parts[0], env)
        if target.kind == "dot":
            holder[target.value] = value
        elif target.kind == "index":
            holder[self.value(target.parts[1], env)] = value
        else:
            raise ScriptError("this can't be assigned")

    # ------------------------------------------------------------ expressions

    def value(self, n: Node, env: dict):
        match n.kind:
            case "lit":
                return n.value
            case "id":
                if n.value in env:
                    return env[n.value]
                return ("class", n.value)
            case "list":
                return [self.value(p, env) for p in n.parts]
            case "map":
                return {self.value(k, env) if k.kind != "id" or k.value in env else k.value: self.value(v, env) for k, v in n.parts}
            case "new":
                args = [self.value(p, env) for p in n.parts]
                if n.value in ("ArrayList", "LinkedList", "HashSet", "LinkedHashSet", "TreeSet"):
                    return list(dict.fromkeys(args[0])) if "Set" in n.value and args and isinstance(args[0], list) else list(args[0]) if args and isinstance(args[0], list) else []
                if n.value in ("HashMap", "TreeMap", "LinkedHashMap"):
                    return dict(args[0]) if args else {}
                if n.value in ("StringBuilder", "StringBuffer"):
                    return [text_of(a) for a in args]
                return args[0] if args else None
            case "dot":
                base = self.value(n.parts[0], env)
                if isinstance(base, dict):
                    return base.get(n.value)
                if n.value == "length" and isinstance(base, (str, list)):
                    return len(base)
                if isinstance(base, tuple) and base[0] == "class":
                    return self.constant(base[1], n.value)
                if base is None and n.parts[0].kind != "id":
                    return None
                raise ScriptError(f"no field {n.value} of {text_of(base)}")
            case "index":
                base, key = self.value(n.parts[0], env), self.value(n.parts[1], env)
                return base.get(key) if isinstance(base, dict) else base[key]
            case "un":
                v = self.value(n.parts[0], env)
                return not v if n.value == "!" else -v if n.value == "-" else ~v if n.value == "~" else v
            case "cast":
                v = self.value(n.parts[0], env)
                return v if v is None else int(v) if n.value in ("int", "long", "short", "byte") else float(v) if n.value in ("double", "float") else text_of(v) if n.value == "String" else v
            case "cond":
                return self.value(n.parts[1] if self.value(n.parts[0], env) else n.parts[2], env)
            case "elvis":
                v = self.value(n.parts[0], env)
                return self.value(n.parts[1], env) if v is None else v
            case "lambda":
                return n
            case "bin":
                return self.binary(n, env)
            case "call":
                return self.call(n, env)
        raise ScriptError(f"{n.kind} isn't supported")

    def constant(self, owner: str, name: str):
        known = {("Integer", "MAX_VALUE"): 2**31 - 1, ("Integer", "MIN_VALUE"): -(2**31), ("Long", "MAX_VALUE"): 2**63 - 1, ("Math", "PI"): math.pi, ("Math", "E"): math.e}
        if (owner, name) in known:
            return known[owner, name]
        return ("class", f"{owner}.{name}")

    def binary(self, n: Node, env: dict):
        op = n.value
        a = self.value(n.parts[0], env)
        if op == "&&":
            return bool(a) and bool(self.value(n.parts[1], env))
        if op == "||":
            return bool(a) or bool(self.value(n.parts[1], env))
        b = self.value(n.parts[1], env)
        match op:
            case "+":
                return text_of(a) + text_of(b) if isinstance(a, str) or isinstance(b, str) else a + b
            case "-":
                return a - b
            case "*":
                return a * b
            case "/":
                if isinstance(a, int) and isinstance(b, int):
                    q = abs(a) // abs(b)
                    return q if (a < 0) == (b < 0) else -q
                return a / b
            case "%":
                return int(math.fmod(a, b)) if isinstance(a, int) and isinstance(b, int) else math.fmod(a, b)
            case "==" | "===":
                return a == b
            case "!=" | "!==":
                return a != b
            case "<" | "<=" | ">" | ">=":
                return {"<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()
            case "&":
                return a & b
            case "|":
                return a | b
            case "^":
                return a ^ b
            case "<<":
                return a << b
            case ">>" | ">>>":
                return a >> b
            case "instanceof":
                kind = b[1] if isinstance(b, tuple) else str(b)
                return isinstance(a, {"String": str, "List": list, "Map": dict, "Integer": int, "Long": int, "Number": (int, float), "Double": float, "Boolean": bool}.get(kind, object))
        raise ScriptError(f"operator {op} isn't supported")

    def function(self, f: Node, env: dict):
        if not isinstance(f, Node):
            raise ScriptError("a lambda is needed")

        def call(*args):
            self.turn()
            inner = {**env, **dict(zip(f.value, args))}
            try:
                self.block(f.parts[0], inner)
            except _Return as r:
                return r.value

        return call

    def call(self, n: Node, env: dict):
        base = self.value(n.parts[0], env)
        args = [self.value(p, env) for p in n.parts[1:]]
        name = n.value
        if isinstance(base, tuple) and base and base[0] == "class":
            return self.static(base[1], name, args, env)
        if base is None:
            raise ScriptError(f"cannot invoke {name} on null")
        made = {str: self.on_text, list: self.on_list, dict: self.on_map}.get(type(base))
        if made:
            return made(base, name, args, env)
        if name in ("intValue", "longValue"):
            return int(base)
        if name == "doubleValue":
            return float(base)
        if name == "toString":
            return text_of(base)
        if name == "equals":
            return base == args[0]
        if name == "compareTo":
            return (base > args[0]) - (base < args[0])
        raise ScriptError(f"method {name} isn't supported")

    def static(self, owner: str, name: str, args: list, env: dict):
        if owner == "Math":
            f = {"abs": abs, "floor": lambda v: float(math.floor(v)), "ceil": lambda v: float(math.ceil(v)), "round": lambda v: math.floor(v + 0.5), "sqrt": math.sqrt, "pow": lambda a, b: float(a) ** b, "min": min, "max": max, "log": math.log, "log10": math.log10, "exp": math.exp}.get(name)
            if f:
                return f(*args)
        if owner in ("Integer", "Long") and name in ("parseInt", "parseLong", "valueOf"):
            return int(args[0], *args[1:]) if isinstance(args[0], str) else int(args[0])
        if owner in ("Double", "Float"):
            return float(args[0])
        if owner == "Boolean":
            return str(args[0]).lower() == "true"
        if owner == "String" and name == "join":
            return args[0].join(map(text_of, args[1]))
        if name in ("valueOf", "toString") and args:
            return text_of(args[0])
        if owner == "Objects":
            return {"isNull": lambda: args[0] is None, "nonNull": lambda: args[0] is not None, "equals": lambda: args[0] == args[1]}[name]()
        if owner in ("Arrays", "List", "Set", "Collections"):
            if name in ("asList", "of"):
                return list(args[0]) if len(args) == 1 and isinstance(args[0], list) else list(args)
            if name == "sort":
                args[0].sort()
                return None
            if name == "reverse":
                args[0].reverse()
                return None
            if name in ("max", "min"):
                return (max if name == "max" else min)(args[0])
        if owner == "Collectors":
            return ("collector", name, args)
        raise ScriptError(f"{owner}.{name} isn't supported")

    def on_text(self, s: str, name: str, args: list, env: dict):
        match name:
            case "toLowerCase":
                return s.lower()
            case "toUpperCase":
                return s.upper()
            case "trim":
                return s.strip("".join(map(chr, range(33))))
            case "length":
                return len(s)
            case "isEmpty":
                return not s
            case "substring":
                return s[args[0] :] if len(args) == 1 else s[args[0] : args[1]]
            case "indexOf":
                return s.find(*args)
            case "lastIndexOf":
                return s.rfind(*args)
            case "contains":
                return args[0] in s
            case "startsWith":
                return s.startswith(args[0])
            case "endsWith":
                return s.endswith(args[0])
            case "equals":
                return s == args[0]
            case "equalsIgnoreCase":
                return args[0] is not None and s.lower() == args[0].lower()
            case "compareTo":
                return (s > args[0]) - (s < args[0])
            case "replace":
                return s.replace(*args)
            case "replaceAll":
                return re.sub(args[0], re.sub(r"\$(\d)", r"\\\1", args[1]), s)
            case "replaceFirst":
                return re.sub(args[0], re.sub(r"\$(\d)", r"\\\1", args[1]), s, count=1)
            case "matches":
                return bool(re.fullmatch(args[0], s))
            case "splitOnToken":
                return s.split(args[0])
            case "split":
                parts = re.split(args[0], s)
                while parts and parts[-1] == "":
                    parts.pop()
                return parts
            case "charAt":
                return s[args[0]]
            case "toString" | "strip":
                return s
            case "concat":
                return s + args[0]
            case "chars" | "toCharArray":
                return list(s)
        raise ScriptError(f"String.{name} isn't supported")

    def on_list(self, v: list, name: str, args: list, env: dict):
        f = self.function(args[0], env) if args and isinstance(args[0], Node) else None
        match name:
            case "add":
                v.append(args[0]) if len(args) == 1 else v.insert(*args)
                return True
            case "addAll":
                v.extend(args[0])
                return True
            case "append":
                v.append(text_of(args[0]))
                return v
            case "get" | "getAt":
                return v[args[0]]
            case "set":
                v[args[0]] = args[1]
                return None
            case "remove":
                return v.pop(args[0]) if isinstance(args[0], int) else (v.remove(args[0]) or True if args[0] in v else False)
            case "removeIf":
                n = len(v)
                v[:] = [x for x in v if not f(x)]
                return len(v) < n
            case "contains":
                return args[0] in v
            case "indexOf":
                return v.index(args[0]) if args[0] in v else -1
            case "size" | "length":
                return len(v)
            case "count":
                return sum(1 for x in v if f(x)) if f else len(v)
            case "isEmpty":
                return not v
            case "clear":
                v.clear()
                return None
            case "sort":
                v.sort(key=None if not f else lambda x: x)
                return None
            case "stream" | "toArray" | "boxed" | "parallelStream" | "toList":
                return list(v)
            case "toString":
                return "".join(v) if v and all(isinstance(x, str) for x in v) else text_of(v)
            case "filter" | "findAll":
                return [x for x in v if f(x)]
            case "map" | "collect" if f:
                return [f(x) for x in v]
            case "mapToInt" | "mapToLong" | "mapToDouble" if f:
                return [f(x) for x in v]
            case "collect":
                how, extra = args[0][1], args[0][2]
                return (extra[0] if extra else "").join(map(text_of, v)) if how == "joining" else list(dict.fromkeys(v)) if how == "toSet" else list(v)
            case "distinct":
                return list(dict.fromkeys(v))
            case "sorted":
                return sorted(v)
            case "limit":
                return v[: args[0]]
            case "skip":
                return v[args[0] :]
            case "anyMatch" | "any":
                return any(f(x) for x in v)
            case "allMatch" | "every":
                return all(f(x) for x in v)
            case "noneMatch":
                return not any(f(x) for x in v)
            case "forEach" | "each":
                for x in v:
                    f(x)
                return None
            case "sum":
                return sum(v)
            case "max":
                return max(v)
            case "min":
                return min(v)
            case "findFirst" | "iterator":
                return v[0] if v else None
            case "join":
                return (args[0] if args else "").join(map(text_of, v))
        raise ScriptError(f"List.{name} isn't supported")

    def on_map(self, m: dict, name: str, args: list, env: dict):
        match name:
            case "get":
                return m.get(args[0])
            case "getOrDefault":
                return m.get(*args)
            case "put":
                old = m.get(args[0])
                m[args[0]] = args[1]
                return old
            case "putAll":
                m.update(args[0])
                return None
            case "putIfAbsent":
                return m.setdefault(*args)
            case "remove":
                return m.pop(args[0], None)
            case "containsKey":
                return args[0] in m
            case "containsValue":
                return args[0] in m.values()
            case "keySet":
                return list(m)
            case "values":
                return list(m.values())
            case "entrySet":
                return [{"key": k, "value": v} for k, v in m.items()]
            case "getKey":
                return m["key"]
            case "getValue":
                return m["value"]
            case "size":
                return len(m)
            case "isEmpty":
                return not m
            case "clear":
                m.clear()
                return None
            case "forEach":
                f = self.function(args[0], env)
                for k, v in list(m.items()):
                    f(k, v)
                return None
            case "toString":
                return text_of(m)
        raise ScriptError(f"Map.{name} isn't supported")
