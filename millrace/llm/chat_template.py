"""A small sandboxed language of chat templates, compiled to Python closures.

Text, ``{{ expression }}``, ``{# comment #}`` and the statements if / elif / else / endif, one
``for name in messages`` loop, ``set`` (for the turn it stands in) and generation / endgeneration, which mark what a model
is trained to say. ``-`` inside a tag strips the white space beside it. Expressions know strings, whole numbers,
true, false, none, the message's fields, ``loop`` (index, index0, first, last, previtem, nextitem), given
constants, operators, inline ``if`` and filters. There are no calls, no other attributes and no other loops, so a
template ends and reaches nothing but its message and its two neighbours.

A template is parsed to a tree whose constant parts are folded, then turned into closures. Conversations are rendered
as they stream by, a turn at a time with its neighbours, so one of any length needs no more memory than three turns.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any, NamedTuple

#: Longest value that a template may build, in code points.
LONGEST = 1 << 28


class TemplateError(ValueError):
    """A template that does not parse, or leaves the sandbox."""


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Field(NamedTuple):
    of: Any
    name: str


class Op(NamedTuple):
    name: str
    args: tuple


class Output(NamedTuple):
    value: Any


class If(NamedTuple):
    test: Any
    yes: tuple
    no: tuple


class Set(NamedTuple):
    name: str
    value: Any


class Loop(NamedTuple):
    name: str
    body: tuple


class Generation(NamedTuple):
    body: tuple


Piece = tuple[str, bool]
FIELDS = ("role", "text", "index", "index0", "first", "last", "previtem", "nextitem")


def _text(x: Any) -> str:
    return "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def _joined(*parts: Any) -> str:
    out = [_text(p) for p in parts]
    if sum(map(len, out)) > LONGEST:
        raise TemplateError("a template's value is too long")
    return "".join(out)


def _number(f: Callable) -> Callable:
    def run(*args: Any) -> Any:
        if any(not isinstance(a, int) for a in args):
            raise TemplateError("arithmetic needs whole numbers")
        return f(*args)

    return run


def _plus(a: Any, b: Any) -> Any:
    return _joined(a, b) if isinstance(a, str) and isinstance(b, str) else _number(operator.add)(a, b)


def _replaced(x: Any, old: str, new: str) -> str:
    x = _text(x)
    if old == "" or x.count(old) * len(new) > LONGEST:
        raise TemplateError("a template's value is too long")
    return x.replace(old, new)


#: What operators and filters do; escape is added by each template.
CALLS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "not": operator.not_, "~": _joined, "+": _plus,
    "-": _number(operator.sub), "*": _number(operator.mul), "//": _number(operator.floordiv), "%": _number(operator.mod), "neg": _number(operator.neg),
    "|trim": lambda x: _text(x).strip(), "|lower": lambda x: _text(x).lower(), "|upper": lambda x: _text(x).upper(), "|length": lambda x: len(_text(x)),
    "|default": lambda x, y: y if x is None else x, "|replace": _replaced,
}
LAZY = {"and", "or", "if"}
_LEVELS = [("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "//", "%")]
_TOKEN = re.compile(r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<int>\d+)|(?P<op>not\s+in\b|(?:or|and|not|in|if|else)\b|==|!=|<=|>=|//|[-<>~+*%|.,()\[\]])|(?P<name>[A-Za-z_]\w*))""", re.S)
_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """One expression, by precedence."""

    def __init__(self, text: str, known: Mapping[str, Any], calls: Mapping[str, Callable]):
        self.tokens, self.known, self.calls, at = [], known, calls, 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, re.sub(r"\s+", " ", m[m.lastgroup]) if m.lastgroup == "op" else m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return value if kind == "op" else None

    def take(self, *ops: str) -> str | None:
        found = self.peek()
        if found in ops:
            self.at += 1
            return found
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise TemplateError(f"{op!r} expected")

    def whole(self) -> Any:
        found = self.ternary()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def made(self, name: str, *args: Any) -> Any:
        """An operation, folded if its operands are constant."""
        if name == "if" and isinstance(args[0], Const):
            return args[1] if args[0].value else args[2]
        if name in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (name == "and") else args[0]
        if name not in LAZY and all(isinstance(a, Const) for a in args):
            try:
                return Const(self.calls[name](*[a.value for a in args]))
            except (TypeError, ZeroDivisionError) as wrong:
                raise TemplateError(str(wrong)) from wrong
        return Op(name, args)

    def ternary(self) -> Any:
        value = self.level(0)
        if not self.take("if"):
            return value
        test = self.level(0)
        return self.made("if", test, value, self.ternary() if self.take("else") else Const(None))

    def level(self, k: int) -> Any:
        if k == len(_LEVELS):
            return self.postfix()
        if _LEVELS[k] == ("not",):
            return self.made("not", self.level(k)) if self.take("not") else self.level(k + 1)
        left = self.level(k + 1)
        while op := self.take(*_LEVELS[k]):
            left = self.made(op, left, self.level(k + 1))
        return left

    def postfix(self) -> Any:
        if self.take("-"):
            return self.made("neg", self.postfix())
        value = self.primary()
        while op := self.take(".", "[", "|"):
            if op == "[":
                value = self.field(value, self.ternary())
                self.need("]")
            elif op == ".":
                value = self.field(value, Const(self.name()))
            else:
                name, args = "|" + self.name(), []
                if name not in self.calls:
                    raise TemplateError(f"no filter {name[1:]!r}")
                if self.take("("):
                    args = [self.ternary()]
                    while self.take(","):
                        args.append(self.ternary())
                    self.need(")")
                value = self.made(name, value, *args)
        return value

    def field(self, of: Any, name: Any) -> Any:
        if not isinstance(name, Const) or name.value not in FIELDS:
            raise TemplateError(f"no field {name}; there are {', '.join(FIELDS)}")
        return Field(of, name.value)

    def name(self) -> str:
        if self.at == len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def primary(self) -> Any:
        if self.take("("):
            value = self.ternary()
            self.need(")")
            return value
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        fixed = {"true": True, "false": False, "none": None}
        if value.lower() in fixed:
            return Const(fixed[value.lower()])
        return Const(self.known[value]) if value in self.known else Name(value)


class _Parser:
    """The template's statements, as a tree."""

    def __init__(self, source: str, known: Mapping[str, Any], calls: Mapping[str, Callable]):
        self.known, self.calls = known, calls
        self.parts, self.at, self.looped, self.inside = [], 0, False, []
        at, strip = 0, False
        for m in _TAG.finditer(source):
            tag, text = m[0], source[at : m.start()]
            text = text.lstrip() if strip else text
            self.parts.append(("text", text.rstrip() if tag[2] == "-" else text))
            self.parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()) if m[2] is not None else ("text", ""))
            at, strip = m.end(), tag[-3] == "-"
        self.parts.append(("text", source[at:].lstrip() if strip else source[at:]))

    def expression(self, text: str) -> Any:
        return _Expression(text, self.known, self.calls).whole()

    def body(self, *ends: str) -> tuple[tuple, str]:
        """Nodes up to a tag that begins with one of the ends, and that tag."""
        nodes: list = []
        while self.at < len(self.parts):
            kind, text = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes += [Output(Const(text))] if text else []
            elif kind == "out":
                nodes.append(Output(self.expression(text)))
            elif (word := (text.split(None, 1) or [""])[0]) in ends:
                return _merged(nodes), text
            else:
                nodes += self.statement(word, text[len(word) :].strip())
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return _merged(nodes), ""

    def statement(self, word: str, rest: str) -> list:
        if word == "if":
            return self.branches(rest)
        if word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=(.*)", rest, re.S)):
            return [Set(m[1], self.expression(m[2]))]
        if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest)) and not self.looped and not self.inside:
            self.looped = True
            self.inside.append(word)
            body, _ = self.body("endfor")
            self.inside.pop()
            return [Loop(m[1], body)]
        if word == "generation" and not rest and word not in self.inside:
            self.inside.append(word)
            body, _ = self.body("endgeneration")
            self.inside.pop()
            return [Generation(body)]
        raise TemplateError(f"cannot use {word} {rest} here")

    def branches(self, test: str) -> list:
        wanted = self.expression(test)
        self.inside.append("if")
        yes, tag = self.body("elif", "else", "endif")
        if tag.startswith("elif"):
            no = _merged(self.branches(tag[4:]))
        else:
            no = self.body("endif")[0] if tag == "else" else ()
        self.inside.pop()
        if isinstance(wanted, Const):
            return list(yes if wanted.value else no)
        return [If(wanted, yes, no)]


def _merged(nodes: Iterable[Any]) -> tuple:
    """Neighbouring constant texts as one."""
    out: list = []
    for node in nodes:
        if isinstance(node, Output) and isinstance(node.value, Const):
            text = _text(node.value.value)
            if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                text = out.pop().value.value + text
            if text:
                out.append(Output(Const(text)))
        else:
            out.append(node)
    return tuple(out)


def escaping(controls: Iterable[str]) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """(escape, unescape): no control string stands in an escaped text, and unescape gives every text back.

    A backslash goes behind a control string's first character, one more where there are some already. The first
    characters must not stand elsewhere in a control string, so that none can begin inside another or run from a text into a mark.
    """
    controls = sorted(set(controls))
    firsts = {c[0] for c in controls}
    if any(len(c) < 2 or firsts & set(c[1:]) or c[1] == "\\" for c in controls):
        raise TemplateError("control strings must begin with characters that they hold nowhere else")
    by = [f"{re.escape(f)}(?:{{}})(?={'|'.join(re.escape(c[1:]) for c in controls if c[0] == f)})" for f in sorted(firsts)]
    if not by:
        return (lambda x: x), (lambda x: x)
    into, back = (re.compile("|".join(b.replace("{}", marks) for b in by)) for marks in (r"\\*", r"\\+"))
    return (lambda x: into.sub(lambda m: m[0] + "\\", x)), (lambda x: back.sub(lambda m: m[0][:-1], x))


Env = dict[str, Any]


def _value(node: Any, calls: Mapping[str, Callable]) -> Callable[[Env], Any]:
    """A closure that evaluates an expression."""
    if isinstance(node, Const):
        return lambda env, value=node.value: value
    if isinstance(node, Name):
        def named(env: Env, name: str = node.name) -> Any:
            if name not in env:
                raise TemplateError(f"nothing is called {name!r}")
            return env[name]

        return named
    if isinstance(node, Field):
        of = _value(node.of, calls)

        def field(env: Env, name: str = node.name) -> Any:
            found = of(env)
            return found.get(name) if isinstance(found, dict) else None

        return field
    args = [_value(a, calls) for a in node.args]
    if node.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.name == "or":
        return lambda env: args[0](env) or args[1](env)
    if node.name == "if":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    call = calls[node.name]
    if len(args) == 1:
        return lambda env, a=args[0]: call(a(env))
    return lambda env: call(*[a(env) for a in args])


Write = Callable[[Env, list[Piece], bool], None]


def _writer(nodes: Iterable[Any], calls: Mapping[str, Callable]) -> Write:
    """A closure that writes nodes' output; the flag says whether it is generated."""
    steps = [_step(n, calls) for n in nodes]

    def write(env: Env, out: list[Piece], mask: bool) -> None:
        for step in steps:
            step(env, out, mask)

    return write


def _step(node: Any, calls: Mapping[str, Callable]) -> Write:
    if isinstance(node, Output):
        value = _value(node.value, calls)
        return lambda env, out, mask: out.append((_text(value(env)), mask))
    if isinstance(node, Generation):
        body = _writer(node.body, calls)
        return lambda env, out, mask: body(env, out, True)
    if isinstance(node, Set):
        value = _value(node.value, calls)
        return lambda env, out, mask: env.__setitem__(node.name, value(env))
    test, yes, no = _value(node.test, calls), _writer(node.yes, calls), _writer(node.no, calls)
    return lambda env, out, mask: (yes if test(env) else no)(env, out, mask)


class Template:
    """A compiled template; ``tree`` is its folded syntax tree."""

    def __init__(self, source: str, controls: Iterable[str] = (), constants: Mapping[str, Any] | None = None):
        """controls: strings that the filter escape keeps out of texts. constants: names with fixed values, folded."""
        self.escape, self.unescape = escaping(controls)
        calls = CALLS | {"|escape": lambda x: self.escape(_text(x))}
        self.tree, _ = _Parser(source, dict(constants or {}), calls).body()
        at = next((k for k, n in enumerate(self.tree) if isinstance(n, Loop)), len(self.tree))
        loop = self.tree[at] if at < len(self.tree) else Loop("", ())
        self._name = loop.name
        self._head, self._body, self._tail = (_writer(nodes, calls) for nodes in (self.tree[:at], loop.body, self.tree[at + 1 :]))

    def turn(self, message: dict, before: dict | None, after: dict | None, index: int) -> list[Piece]:
        """What one turn adds: its own text, behind the template's head if it is first, before its tail if it is last."""
        out: list[Piece] = []
        if before is None:
            self._head({}, out, False)
        loop = {"index": index + 1, "index0": index, "first": before is None, "last": after is None, "previtem": before, "nextitem": after}
        self._body({self._name: message, "loop": loop}, out, False)
        if after is None:
            self._tail({}, out, False)
        return out

    def render(self, messages: Iterable[dict]) -> Iterator[list[Piece]]:
        """The pieces of each turn, as messages stream by; the flag says whether a piece is generated."""
        before = now = None
        index = -1
        for after in messages:
            if now is not None:
                yield self.turn(now, before, after, index)
            before, now, index = now, after, index + 1
        if now is not None:
            yield self.turn(now, before, None, index)
