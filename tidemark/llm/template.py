"""A small sandboxed template language, compiled to Python closures.

Text stands for itself. ``{{ expression }}`` writes a value, ``{# ... #}`` is dropped, and statements are

    {% for name in expression %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}

A ``-`` beside a delimiter drops the white space next to it. Expressions have strings, integers,
``true``, ``false``, ``none``, names, ``x.field``, ``x['field']``, ``x[0]``, ``x | filter``,
``x if c else y``, ``or and not``, comparisons, ``in``, ``not in``, ``~`` (joins as text), ``+`` and ``-``.
Inside a loop ``loop`` has ``index``, ``index0``, ``first`` and ``last``.

There are no calls, and fields are read from dictionaries only, so a template reaches nothing
but the values it is given. What depends on constants only is computed when the template is
compiled. Names that cannot be set, unknown filters and unclosed blocks are errors then, too.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field

MOST_DEPTH = 40


class TemplateError(ValueError):
    """A template that does not parse, or a value that does not suit it."""


# --- syntax tree -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Constant:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    key: object


@dataclass(frozen=True)
class Filtered:
    of: object
    filter: str


@dataclass(frozen=True)
class Unary:
    op: str
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Choice:
    """An inline ``if``, whose parts are expressions, or a block ``if``, whose parts are bodies."""

    test: object
    then: object
    other: object


@dataclass(frozen=True)
class Write:
    value: object


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def as_text(value) -> str:
    if value is None:
        return ""
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} cannot be written")


def _read(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError(f"a {type(of).__name__} has no {key!r}")


def _within(left, right):
    if isinstance(right, str):
        return as_text(left) in right
    if isinstance(right, (list, dict)):
        return left in right
    raise TemplateError(f"nothing is in a {type(right).__name__}")


def _added(left, right):
    if isinstance(left, str) != isinstance(right, str):
        raise TemplateError("+ needs two texts or two numbers")
    return left + right


BINARY: dict[str, Callable] = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "in": _within,
    "not in": lambda left, right: not _within(left, right),
    "~": lambda left, right: as_text(left) + as_text(right),
    "+": _added,
    "-": operator.sub,
}
UNARY: dict[str, Callable] = {"not": operator.not_, "-": operator.neg}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: as_text(v).strip(),
    "upper": lambda v: as_text(v).upper(),
    "lower": lambda v: as_text(v).lower(),
    "length": len,
    "string": as_text,
}

# --- parser ------------------------------------------------------------------------------------

_PARTS = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.DOTALL)
_LEXEMES = re.compile(
    r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"""
    r"""|(?P<sign>==|!=|<=|>=|[<>|.\[\]()~+=-]))""",
    re.DOTALL,
)
_WORDS = {"true": True, "false": False, "none": None}
_RESERVED = {*_WORDS, "and", "or", "not", "in", "if", "else", "loop"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _lexemes(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        found = _LEXEMES.match(source, at)
        if found is None:
            raise TemplateError(f"unexpected {source[at:].lstrip()[:10]!r}")
        out.append((found.lastgroup, found.group(found.lastgroup)))
        at = found.end()
    return out


class _Expression:
    """Recursive descent over the lexemes of one tag."""

    def __init__(self, source: str, names: set[str], filters: dict[str, Callable]):
        self.lexemes, self.at, self.depth = _lexemes(source), 0, 0
        self.names, self.filters = names, filters

    def peek(self) -> str | None:
        return self.lexemes[self.at][1] if self.at < len(self.lexemes) else None

    def take(self, *wanted: str) -> str | None:
        kind = self.lexemes[self.at][0] if self.at < len(self.lexemes) else None
        if kind in ("name", "sign") and self.peek() in wanted:
            self.at += 1
            return self.lexemes[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if self.take(wanted) is None:
            raise TemplateError(f"{wanted!r} expected, not {self.peek()!r}")

    def name(self) -> str:
        if self.at >= len(self.lexemes) or self.lexemes[self.at][0] != "name":
            raise TemplateError(f"a name expected, not {self.peek()!r}")
        self.at += 1
        return self.lexemes[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.lexemes):
            raise TemplateError(f"unexpected {self.peek()!r}")

    def whole(self):
        value = self.choice()
        self.end()
        return value

    def choice(self):
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("an expression is nested too deeply")
        value = self.any_of()
        if self.take("if"):
            test = self.any_of()
            self.need("else")
            value = Choice(test, value, self.choice())
        self.depth -= 1
        return value

    def any_of(self):
        value = self.all_of()
        while self.take("or"):
            value = Binary("or", value, self.all_of())
        return value

    def all_of(self):
        value = self.negation()
        while self.take("and"):
            value = Binary("and", value, self.negation())
        return value

    def negation(self):
        times = 0
        while self.take("not"):
            times += 1
        value = self.comparison()
        if times == 0:
            return value
        value = Unary("not", value)
        return value if times % 2 else Unary("not", value)

    def comparison(self):
        value = self.joined()
        while True:
            op = self.take("==", "!=", "<=", ">=", "<", ">", "in")
            if op is None and self.take("not"):
                self.need("in")
                op = "not in"
            if op is None:
                return value
            value = Binary(op, value, self.joined())

    def joined(self):
        value = self.postfix()
        while op := self.take("~", "+", "-"):
            value = Binary(op, value, self.postfix())
        return value

    def postfix(self):
        value = Unary("-", self.operand()) if self.take("-") else self.operand()
        while op := self.take(".", "[", "|"):
            if op == ".":
                value = Field(value, Constant(self.name()))
            elif op == "[":
                value = Field(value, self.choice())
                self.need("]")
            else:
                name = self.name()
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                value = Filtered(value, name)
        return value

    def operand(self):
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if self.at >= len(self.lexemes):
            raise TemplateError("an expression ends early")
        kind, lexeme = self.lexemes[self.at]
        self.at += 1
        if kind == "text":
            return Constant(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), lexeme[1:-1], flags=re.DOTALL))
        if kind == "number":
            return Constant(int(lexeme))
        if kind == "name" and lexeme in _WORDS:
            return Constant(_WORDS[lexeme])
        if kind == "name" and lexeme in self.names:
            return Name(lexeme)
        raise TemplateError(f"{lexeme!r} is not known here")


def _split(source: str) -> list[tuple[str, str]]:
    """``(text | write | statement, content)`` in order, white space next to a ``-`` dropped."""
    out, at, strip = [], 0, False
    for found in _PARTS.finditer(source):
        tag, text = found.group(), source[at : found.start()]
        text = text.lstrip() if strip else text
        out.append(("text", text.rstrip() if tag[2] == "-" else text))
        if found[1] is not None:
            out.append(("write", found[1]))
        elif found[2] is not None:
            out.append(("statement", found[2]))
        at, strip = found.end(), tag[-3] == "-"
    rest = source[at:]
    out.append(("text", rest.lstrip() if strip else rest))
    stray = re.search(r"\{[{%#]", "".join(text for kind, text in out if kind == "text"))
    if stray:
        raise TemplateError(f"{stray.group()!r} is not closed")
    return [part for part in out if part != ("text", "")]


class _Parser:
    def __init__(self, source: str, names: set[str], filters: dict[str, Callable]):
        self.parts, self.at, self.depth, self.filters = _split(source), 0, 0, filters
        self.source_names = names

    def parse(self) -> tuple:
        body, end = self.body(set(self.source_names), ())
        if end is not None:
            raise TemplateError(f"{end!r} closes nothing")
        return body

    def expression(self, source: str, names: set[str]) -> _Expression:
        return _Expression(source, names, self.filters)

    def body(self, names: set[str], ends: tuple[str, ...]):
        """Nodes up to a statement of ``ends``, and that statement's content."""
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("blocks are nested too deeply")
        nodes = []
        while self.at < len(self.parts):
            kind, content = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Write(Constant(content)))
            elif kind == "write":
                nodes.append(Write(self.expression(content, names).whole()))
            else:
                word = content.split(None, 1)[0] if content.strip() else ""
                if word in ends or word.startswith("end") or word in ("elif", "else"):
                    if word not in ends:
                        raise TemplateError(f"{word!r} closes nothing")
                    self.depth -= 1
                    return tuple(nodes), content
                nodes.append(self.statement(word, content, names))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        self.depth -= 1
        return tuple(nodes), None

    def statement(self, word: str, content: str, names: set[str]):
        tag = self.expression(content, names)
        if word not in ("for", "if", "set", "generation"):
            raise TemplateError(f"no statement {word!r}")
        tag.need(word)
        if word == "if":
            return self.choices(tag, names)
        if word == "generation":
            tag.end()
            return Generation(self.body(set(names), ("endgeneration",))[0])
        name = tag.name()
        if name in _RESERVED:
            raise TemplateError(f"{name!r} cannot be set")
        tag.need("in" if word == "for" else "=")
        value = tag.whole()
        if word == "for":
            return Loop(name, value, self.body({*names, name, "loop"}, ("endfor",))[0])
        names.add(name)
        return Assign(name, value)

    def choices(self, tag: _Expression, names: set[str]):
        test = tag.whole()
        then, end = self.body(set(names), ("elif", "else", "endif"))
        other: tuple = ()
        if end.split()[0] == "elif":
            tag = self.expression(end, names)
            tag.need("elif")
            other = (self.choices(tag, names),)
        elif end.split()[0] == "else":
            other, _ = self.body(set(names), ("endif",))
        return Choice(test, then, other)


# --- constant folding --------------------------------------------------------------------------


def fold(node, filters: dict[str, Callable] = FILTERS):
    """The same expression with constant parts computed; one that would fail is left to run time."""
    match node:
        case Field(of, key):
            node = Field(fold(of, filters), fold(key, filters))
            parts, compute = (node.of, node.key), _read
        case Filtered(of, name):
            node = Filtered(fold(of, filters), name)
            parts, compute = (node.of,), filters[name]
        case Unary(op, of):
            node = Unary(op, fold(of, filters))
            parts, compute = (node.of,), UNARY[op]
        case Choice(test, then, other):
            test = fold(test, filters)
            if isinstance(test, Constant):
                return fold(then if test.value else other, filters)
            return Choice(test, fold(then, filters), fold(other, filters))
        case Binary("and" | "or" as op, left, right):
            left, right = fold(left, filters), fold(right, filters)
            if isinstance(left, Constant):
                return right if bool(left.value) == (op == "and") else left
            return Binary(op, left, right)
        case Binary(op, left, right):
            node = Binary(op, fold(left, filters), fold(right, filters))
            parts, compute = (node.left, node.right), BINARY[op]
        case _:
            return node
    if all(isinstance(p, Constant) for p in parts):
        try:
            return Constant(compute(*(p.value for p in parts)))
        except Exception:  # noqa: BLE001 - the same error comes when the value is needed
            return node
    return node


def fold_body(body: tuple, filters: dict[str, Callable] = FILTERS) -> tuple:
    """Folded statements: decided branches are spliced in, and neighbouring constant texts are one."""
    out: list = []

    def add(node):
        if isinstance(node, Write) and isinstance(node.value, Constant):
            text = as_text(node.value.value)
            if out and isinstance(out[-1], Write) and isinstance(out[-1].value, Constant):
                text = out.pop().value.value + text
            if text:
                out.append(Write(Constant(text)))
        else:
            out.append(node)

    for node in body:
        match node:
            case Write(value):
                add(Write(fold(value, filters)))
            case Assign(name, value):
                add(Assign(name, fold(value, filters)))
            case Generation(inner):
                add(Generation(fold_body(inner, filters)))
            case Loop(name, over, inner):
                add(Loop(name, fold(over, filters), fold_body(inner, filters)))
            case Choice(test, then, other):
                test = fold(test, filters)
                if isinstance(test, Constant):
                    # A branch is a scope of its own; without a set it can be spliced in.
                    chosen = fold_body(then if test.value else other, filters)
                    if any(isinstance(n, Assign) for n in chosen):
                        add(Choice(test, chosen, ()) if test.value else Choice(test, (), chosen))
                    else:
                        for n in chosen:
                            add(n)
                else:
                    add(Choice(test, fold_body(then, filters), fold_body(other, filters)))
    return tuple(out)


# --- closures ----------------------------------------------------------------------------------


@dataclass
class Output:
    """Text written so far, and the stretches of it that a generation block wrote."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node, filters: dict[str, Callable]) -> Callable[[dict], object]:
    """A closure from the names' values to the expression's."""
    match node:
        case Constant(value):
            return lambda env: value
        case Name(name):
            return lambda env: env[name]
        case Field(of, Constant(key)):
            of = _value(of, filters)
            return lambda env: _read(of(env), key)
        case Field(of, key):
            of, key = _value(of, filters), _value(key, filters)
            return lambda env: _read(of(env), key(env))
        case Filtered(of, name):
            of, apply = _value(of, filters), filters[name]
            return lambda env: apply(of(env))
        case Unary(op, of):
            of, apply = _value(of, filters), UNARY[op]
            return lambda env: apply(of(env))
        case Choice(test, then, other):
            test, then, other = (_value(n, filters) for n in (test, then, other))
            return lambda env: then(env) if test(env) else other(env)
        case Binary("and", left, right):
            left, right = _value(left, filters), _value(right, filters)
            return lambda env: left(env) and right(env)
        case Binary("or", left, right):
            left, right = _value(left, filters), _value(right, filters)
            return lambda env: left(env) or right(env)
        case Binary(op, left, right):
            left, right, apply = _value(left, filters), _value(right, filters), BINARY[op]
            return lambda env: apply(left(env), right(env))
    raise TypeError(node)


def _run(body: tuple, filters: dict[str, Callable]) -> Callable[[dict, Output], None]:
    """A closure that writes a body."""
    steps = tuple(_step(node, filters) for node in body)
    if len(steps) == 1:
        return steps[0]

    def run(env, out):
        for step in steps:
            step(env, out)

    return run


def _step(node, filters: dict[str, Callable]) -> Callable[[dict, Output], None]:
    match node:
        case Write(Constant(text)):
            return lambda env, out: out.write(text)
        case Write(value):
            value = _value(value, filters)
            return lambda env, out: out.write(as_text(value(env)))
        case Assign(name, value):
            value = _value(value, filters)

            def assign(env, out):
                env[name] = value(env)

            return assign
        case Choice(test, then, other):
            test, then, other = _value(test, filters), _run(then, filters), _run(other, filters)
            return lambda env, out: (then if test(env) else other)(dict(env), out)
        case Generation(body):
            run = _run(body, filters)

            def generation(env, out):
                start = out.length
                run(dict(env), out)
                out.spans.append((start, out.length))

            return generation
        case Loop(name, over, body):
            over, run = _value(over, filters), _run(body, filters)

            def loop(env, out):
                items = over(env)
                if not isinstance(items, list):
                    raise TemplateError(f"a loop needs a list, not a {type(items).__name__}")
                for k, item in enumerate(items):
                    place = {"index": k + 1, "index0": k, "first": k == 0, "last": k == len(items) - 1}
                    run({**env, name: item, "loop": place}, out)

            return loop
    raise TypeError(node)


def names_in(node) -> set[str]:
    """Names that an expression or body reads."""
    if isinstance(node, Name):
        return {node.name}
    if isinstance(node, tuple):
        return set().union(*map(names_in, node))
    if hasattr(node, "__dataclass_fields__"):
        return set().union(*(names_in(getattr(node, f)) for f in node.__dataclass_fields__))
    return set()


@dataclass(frozen=True)
class Template:
    """A compiled template over the named values."""

    body: tuple
    filters: dict[str, Callable]
    run: Callable[[dict, Output], None]

    def render(self, **values) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the code point ranges that generation blocks wrote."""
        out = Output()
        self.run(dict(values), out)
        return "".join(out.parts), out.spans


def compile_template(source: str, names: tuple[str, ...] = ("messages",), filters: dict[str, Callable] | None = None) -> Template:
    """Parse, fold and compile. ``filters`` adds to the built-in ones."""
    known = {**FILTERS, **(filters or {})}
    body = fold_body(_Parser(source, set(names), known).parse(), known)
    return Template(body, known, _run(body, known))
