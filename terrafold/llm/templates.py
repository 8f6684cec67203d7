"""A compiler for a small sandboxed template language.

Source text is parsed to a syntax tree, constants are folded, and the tree becomes nested
Python closures; no Python source is generated or evaluated. A template sees only the values
it is given: dictionary entries, list loops and the listed filters, no attributes or calls.

    {{ expression }}   {% set name = expression %}
    {% for x in expression %} ... {% endfor %}         with loop.index, .first and .last
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}           marks what a model is to learn to write

Expressions: strings, integers, true, false, none, names, x.key, x['key'], x[0], or, and, not,
== != < <= > >= in, + - * %, ~ (joins as text), | filter. Unknown names and keys are none, and
none renders as nothing. {%- and -%} trim white space on that side, as {{- and -}} do.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    arg: object


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    cases: tuple  # (test, body), ...; a last test of Const(True) is the else


@dataclass(frozen=True)
class Generation:
    body: tuple


def _text(v) -> str:
    return "" if v is None else str(v)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if v is not None else 0,
    "string": _text,
}

_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|([A-Za-z_]\w*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|<=|>=|[-+*%~<>()\[\].|]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at : at + 20]!r}")
        number, name, string, op = m.groups()
        if number:
            out.append(("const", int(number)))
        elif name:
            out.append(("name", name))
        elif string:
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)))
        else:
            out.append(("op", op))
        at = m.end()
    return out


class _Expression:
    """Recursive descent; each level binds closer than the one before."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "%"))

    def __init__(self, source: str, filters):
        self.tokens, self.at, self.filters = _tokens(source), 0, filters

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *values) -> bool:
        if self.peek()[0] in ("op", "name") and self.peek()[1] in values:
            self.at += 1
            return True
        return False

    def need(self, value):
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing at {self.peek()[1]!r}")

    def whole(self):
        tree = self.level(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def level(self, k: int):
        if k == 2 and self.take("not"):
            return Op("not", (self.level(2),))
        if k == len(self.LEVELS):
            return self.postfix()
        tree = self.level(k + 1)
        while self.peek()[0] in ("op", "name") and self.peek()[1] in self.LEVELS[k]:
            op = self.peek()[1]
            self.at += 1
            tree = Op(op, (tree, self.level(k + 1)))
        return tree

    def postfix(self):
        tree = self.atom()
        while True:
            if self.take("."):
                kind, name = self.peek()
                if kind != "name":
                    raise TemplateError("a key must follow the dot")
                self.at += 1
                tree = Item(tree, Const(name))
            elif self.take("["):
                tree = Item(tree, self.level(0))
                self.need("]")
            elif self.take("|"):
                kind, name = self.peek()
                if kind != "name" or name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                self.at += 1
                tree = Filter(name, tree)
            else:
                return tree

    def atom(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "const":
            return Const(value)
        if kind == "name" and value not in ("or", "and", "not", "in"):
            named = {"true": True, "false": False, "none": None}
            return Const(named[value]) if value in named else Name(value)
        if kind == "op" and value == "(":
            tree = self.level(0)
            self.need(")")
            return tree
        raise TemplateError(f"unexpected {value!r}")


class _Parser:
    def __init__(self, source: str, filters):
        self.filters = filters
        self.parts: list[tuple[str, str]] = []
        at, strip = 0, False
        for m in _TAG.finditer(source):
            text = source[at : m.start()]
            text = text.lstrip() if strip else text
            text = text.rstrip() if m[0][2:3] == "-" else text
            self.parts.append(("text", text))
            if m[1] is not None:
                self.parts.append(("out", m[1].strip()))
            elif m[2] is not None:
                self.parts.append(("tag", m[2].strip()))
            strip, at = m[0][-3:-2] == "-", m.end()
        self.parts.append(("text", source[at:].lstrip() if strip else source[at:]))
        self.at = 0

    def expression(self, source: str):
        return _Expression(source, self.filters).whole()

    def body(self, *ends: str) -> tuple[tuple, str]:
        nodes = []
        while self.at < len(self.parts):
            kind, value = self.parts[self.at]
            self.at += 1
            if kind == "text":
                if value:
                    nodes.append(Out(Const(value)))
                continue
            if kind == "out":
                nodes.append(Out(self.expression(value)))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return tuple(nodes), value
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"cannot read {value!r}")
                inner, _ = self.body("endfor")
                nodes.append(For(m[1], self.expression(m[2]), inner))
            elif word == "if":
                cases, test = [], self.expression(rest)
                while True:
                    inner, end = self.body("elif", "else", "endif")
                    cases.append((test, inner))
                    if end.startswith("elif"):
                        test = self.expression(end[4:])
                    elif end == "else":
                        test = Const(True)
                    else:
                        break
                nodes.append(If(tuple(cases)))
            elif word == "set":
                name, eq, e = rest.partition("=")
                if not eq or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError(f"cannot read {value!r}")
                nodes.append(Set(name.strip(), self.expression(e)))
            elif word == "generation":
                inner, _ = self.body("endgeneration")
                nodes.append(Generation(inner))
            else:
                raise TemplateError(f"no tag {word!r}")
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(nodes), ""


def _apply(op: str, a, b=None):
    if op == "not":
        return not a
    if op == "~":
        return _text(a) + _text(b)
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if op == "in":
        return a in b if b is not None else False
    if op == "*" and (isinstance(a, str) or isinstance(b, str)):
        raise TemplateError("text cannot be multiplied")
    if op == "%" and isinstance(a, str):
        raise TemplateError("text has no remainder")
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()


def fold(node, filters=FILTERS):
    """The tree with constant parts evaluated, dead branches gone and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for n in map(lambda n: fold(n, filters), node):
            for n in n if isinstance(n, tuple) else (n,):
                if isinstance(n, Out) and isinstance(n.value, Const):
                    text = _text(n.value.value)
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                        out[-1] = Out(Const(out[-1].value.value + text))
                    elif text:
                        out.append(Out(Const(text)))
                else:
                    out.append(n)
        return tuple(out)
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Filter):
        arg = fold(node.arg, filters)
        return Const(filters[node.name](arg.value)) if isinstance(arg, Const) else Filter(node.name, arg)
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op not in ("and", "or") and all(isinstance(a, Const) for a in args):
            return Const(_apply(node.op, *(a.value for a in args)))
        return Op(node.op, args)
    if isinstance(node, Out):
        return Out(fold(node.value, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):
        cases = []
        for test, body in node.cases:
            test = fold(test, filters)
            if isinstance(test, Const) and not test.value:
                continue
            cases.append((test, fold(body, filters)))
            if isinstance(test, Const):
                break
        if not cases:
            return ()
        return cases[0][1] if isinstance(cases[0][0], Const) else If(tuple(cases))
    return node


class _Sink:
    __slots__ = ("parts", "size", "marks")

    def __init__(self):
        self.parts, self.size, self.marks = [], 0, []

    def put(self, text: str):
        self.parts.append(text)
        self.size += len(text)


def _value(node, filters) -> Callable[[dict], object]:
    if isinstance(node, Const):
        v = node.value
        return lambda env: v
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(env):
            x, k = of(env), key(env)
            if isinstance(x, dict):
                return x.get(k)
            if isinstance(x, (list, tuple)) and isinstance(k, int):
                return x[k] if -len(x) <= k < len(x) else None
            return None

        return item
    if isinstance(node, Filter):
        f, arg = filters[node.name], _value(node.arg, filters)
        return lambda env: f(arg(env))
    a = _value(node.args[0], filters)
    op = node.op
    if op == "not":
        return lambda env: not a(env)
    b = _value(node.args[1], filters)
    if op == "and":
        return lambda env: a(env) and b(env)
    if op == "or":
        return lambda env: a(env) or b(env)
    if op == "==":
        return lambda env: a(env) == b(env)
    return lambda env: _apply(op, a(env), b(env))


def _emit(nodes: tuple, filters) -> Callable[[dict, _Sink], None]:
    steps = [_step(n, filters) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env, sink):
        for s in steps:
            s(env, sink)

    return run


def _step(node, filters) -> Callable[[dict, _Sink], None]:
    if isinstance(node, Out):
        if isinstance(node.value, Const):
            text = _text(node.value.value)
            return lambda env, sink: sink.put(text)
        value = _value(node.value, filters)
        return lambda env, sink: sink.put(_text(value(env)))
    if isinstance(node, Set):
        name, value = node.name, _value(node.value, filters)

        def assign(env, sink):
            env[name] = value(env)

        return assign
    if isinstance(node, For):
        name, over, body = node.name, _value(node.over, filters), _emit(node.body, filters)

        def loop(env, sink):
            items = over(env) or []
            inner = dict(env)
            for i, x in enumerate(items):
                inner[name] = x
                inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1}
                body(inner, sink)

        return loop
    if isinstance(node, If):
        cases = [(_value(t, filters), _emit(b, filters)) for t, b in node.cases]

        def choose(env, sink):
            for test, body in cases:
                if test(env):
                    body(env, sink)
                    return

        return choose
    body = _emit(node.body, filters)

    def generation(env, sink):
        start = sink.size
        body(env, sink)
        sink.marks.append((start, sink.size))

    return generation


class Template:
    """render(values) gives the text and the (begin, end) code points of generation blocks."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        self.filters = FILTERS | (filters or {})
        self.tree = fold(_Parser(source, self.filters).body()[0], self.filters)
        self._run = _emit(self.tree, self.filters)

    def render(self, values: dict) -> tuple[str, list[tuple[int, int]]]:
        sink = _Sink()
        self._run(dict(values), sink)
        return "".join(sink.parts), sink.marks
