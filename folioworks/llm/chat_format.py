r"""Chat formatting: a compiler for a small sandboxed template language.

A template is parsed into a syntax tree, constants are folded (joined texts, filters of
constants, branches whose condition is known) and the rest becomes Python closures.
There is no attribute access, call or import: only the names that the closures
are given, fields of a message, a few operators and a fixed set of filters.

    {{ expr }}                                  a value, as text
    {% for m in messages %} ... {% endfor %}    loop.index0, loop.first are known within
    {% if expr %} ... {% elif %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}    what it writes is under the loss mask
    expr: 'text' | number | true | false | none | name | m.field | ( expr )
          a + b, a == b, a != b, a in b, not a, a and b, a or b, a | filter
    filters: escape, trim, upper, lower, length

``escape`` makes a text free of control strings, reversibly: ``\`` becomes ``\\``, ``<``
becomes ``\l``, ``[`` becomes ``\b``, a line break (within a role) ``\n`` only for
``escape_line``.  The production template's marks all begin with ``<`` or ``[``, so what
a user writes can't look like one.

Conversations are rendered turn by turn as rows come, sorted by (turn, role, text).
Null texts and roles are empty.  Equal turns and repeated rows stay, in that order.  A
null conv_id is a conversation of its own.  Other columns aren't looked at; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = (
    "{% for m in messages %}<s>[INST]{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}[/INST]</s>{% endfor %}"
)
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_ESCAPE = str.maketrans(_ESCAPES)
_ESCAPE_LINE = str.maketrans(_ESCAPES | {"\n": "\\n"})
_BACK = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: text_of(x).translate(_ESCAPE),
    "escape_line": lambda x: text_of(x).translate(_ESCAPE_LINE),
    "trim": lambda x: text_of(x).strip(),
    "upper": lambda x: text_of(x).upper(),
    "lower": lambda x: text_of(x).lower(),
    "length": lambda x: len(text_of(x)),
}


def text_of(x: Any) -> str:
    return "" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x)


def unescape(x: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], x, flags=re.S)


class TemplateError(ValueError):
    pass


# ------------------------------------------------------------------ syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: str
    field: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Out:
    expr: Any


@dataclass(frozen=True)
class For:
    var: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body); Const(True) for else


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|().]))", re.S)
_WORDS = {"true": True, "false": False, "none": None}


class _Expr:
    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            kind = m.lastindex
            self.tokens.append((("text", "number", "name", "mark")[kind - 1], m[kind]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i = 0

    def peek(self) -> str:
        return self.tokens[self.i][1] if self.tokens[self.i][0] in ("name", "mark") else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        t = self.tokens[self.i]
        if want is not None and (t[1] != want or t[0] == "text"):
            raise TemplateError(f"{want!r} is missing before {t[1]!r}")
        self.i += 1
        return t

    def whole(self):
        e = self.either()
        if self.tokens[self.i][0] != "end":
            raise TemplateError(f"{self.tokens[self.i][1]!r} isn't expected")
        return e

    def either(self):
        e = self.both()
        while self.peek() == "or":
            self.take()
            e = Op("or", (e, self.both()))
        return e

    def both(self):
        e = self.negated()
        while self.peek() == "and":
            self.take()
            e = Op("and", (e, self.negated()))
        return e

    def negated(self):
        if self.peek() == "not":
            self.take()
            return Op("not", (self.negated(),))
        return self.compared()

    def compared(self):
        e = self.added()
        if self.peek() in ("==", "!=", "in"):
            op = self.take()[1]
            e = Op(op, (e, self.added()))
        return e

    def added(self):
        e = self.filtered()
        while self.peek() == "+":
            self.take()
            e = Op("+", (e, self.filtered()))
        return e

    def filtered(self):
        e = self.single()
        while self.peek() == "|":
            self.take()
            kind, name = self.take()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            e = Op("|" + name, (e,))
        return e

    def single(self):
        kind, x = self.take()
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), x[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(x))
        if kind == "mark" and x == "(":
            e = self.either()
            self.take(")")
            return e
        if kind != "name" or x in ("and", "or", "not", "in"):
            raise TemplateError(f"{x!r} isn't expected")
        if x in _WORDS:
            return Const(_WORDS[x])
        if self.peek() == ".":
            self.take()
            kind, field = self.take()
            if kind != "name" or field.startswith("_"):
                raise TemplateError(f"no field {field!r}")
            return Field(x, field)
        return Name(x)


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        parts += [("text", source[at : m.start()])] * (m.start() > at)
        parts += [("out", m[1])] if m[1] is not None else [("tag", m[2].strip())] if m[2] is not None else []
        at = m.end()
    parts += [("text", source[at:])] * (at < len(source))
    i = 0

    def body(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal i
        nodes = []
        while i < len(parts):
            kind, x = parts[i]
            i += 1
            if kind == "text":
                nodes.append(Text(x))
            elif kind == "out":
                nodes.append(Out(_Expr(x).whole()))
            else:
                word, _, rest = x.partition(" ")
                if word in ends:
                    return tuple(nodes), x
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"can't read {x!r}")
                    nodes.append(For(m[1], _Expr(m[2]).whole(), body(("endfor",))[0]))
                elif word == "if":
                    branches, condition = [], _Expr(rest).whole()
                    while True:
                        inner, end = body(("elif", "else", "endif"))
                        branches.append((condition, inner))
                        if end == "endif":
                            break
                        condition = Const(True) if end == "else" else _Expr(end.partition(" ")[2]).whole()
                    nodes.append(If(tuple(branches)))
                elif word == "generation":
                    nodes.append(Generation(body(("endgeneration",))[0]))
                else:
                    raise TemplateError(f"unknown tag {x!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(nodes), ""

    return body(())[0]


def apply(op: str, *x: Any) -> Any:
    if op == "+":
        return x[0] + x[1] if isinstance(x[0], int) and isinstance(x[1], int) else text_of(x[0]) + text_of(x[1])
    if op == "==":
        return x[0] == x[1]
    if op == "!=":
        return x[0] != x[1]
    if op == "in":
        return text_of(x[0]) in text_of(x[1])
    if op == "not":
        return not x[0]
    return FILTERS[op[1:]](x[0])


def fold(node: Any) -> Any:
    """The same tree with everything computed that needs no message; bodies come back as tuples."""
    if isinstance(node, tuple):
        out: list = []
        for n in node:
            n = fold(n)
            for k in n if isinstance(n, tuple) else (n,):
                if isinstance(k, Out) and isinstance(k.expr, Const):
                    k = Text(text_of(k.expr.value))
                if isinstance(k, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + k.value)
                elif not (isinstance(k, Text) and not k.value):
                    out.append(k)
        return tuple(out)
    if isinstance(node, Out):
        return Out(fold(node.expr))
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.op in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
            return Op(node.op, args)
        if all(isinstance(a, Const) for a in args):
            return Const(apply(node.op, *(a.value for a in args)))
        return Op(node.op, args)
    if isinstance(node, For):
        return For(node.var, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        kept = []
        for c, b in node.branches:
            c = fold(c)
            if isinstance(c, Const):
                if c.value:
                    if not kept:
                        return fold(b)
                    kept.append((c, fold(b)))
                    break
                continue
            kept.append((c, fold(b)))
        return If(tuple(kept)) if kept else ()
    return node


# ------------------------------------------------------------------ closures


def _value(e: Any) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        return lambda env, v=e.value: v
    if isinstance(e, Name):
        return lambda env, n=e.name: env.get(n)
    if isinstance(e, Field):
        return lambda env, n=e.of, f=e.field: (env.get(n) or {}).get(f)
    args = [_value(a) for a in e.args]
    if e.op == "and":
        return lambda env, a=args[0], b=args[1]: a(env) and b(env)
    if e.op == "or":
        return lambda env, a=args[0], b=args[1]: a(env) or b(env)
    if len(args) == 1:
        return lambda env, a=args[0], op=e.op: apply(op, a(env))
    return lambda env, a=args[0], b=args[1], op=e.op: apply(op, a(env), b(env))


Piece = tuple[str, bool]


def _writer(nodes: tuple, masked: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step(n, masked) for n in nodes]

    def run(env: dict) -> Iterator[Piece]:
        for s in steps:
            yield from s(env)

    return run


def _step(node: Any, masked: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Text):
        one = ((node.value, masked),)
        return lambda env: one
    if isinstance(node, Out):
        value = _value(node.expr)
        return lambda env: ((text_of(value(env)), masked),)
    if isinstance(node, Generation):
        return _writer(node.body, True)
    if isinstance(node, If):
        branches = [(_value(c), _writer(b, masked)) for c, b in node.branches]

        def choose(env: dict) -> Iterator[Piece]:
            for c, b in branches:
                if c(env):
                    return b(env)
            return iter(())

        return choose
    over, body, var = _value(node.over), _writer(node.body, masked), node.var

    def loop(env: dict) -> Iterator[Piece]:
        inner = dict(env)
        for i, item in enumerate(over(env) or ()):
            inner[var], inner["loop"] = item, {"index0": i, "index": i + 1, "first": i == 0}
            yield from body(inner)

    return loop


def compile_template(source: str) -> Callable[[Any], Iterator[Piece]]:
    """A function from messages (dicts with role and text, read one after another) to pieces (text, under the mask)."""
    run = _writer(fold(parse(source)), False)
    return lambda messages: run({"messages": messages})


def render(source: str, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and the spans of code points under the loss mask (touching ones of two turns apart)."""
    out, spans, n = [], [], 0
    for text, masked in compile_template(source)(messages):
        if masked:
            spans.append((n, n + len(text)))
        out.append(text)
        n += len(text)
    return "".join(out), spans


class Reader:
    """Reads turns back from a formatted conversation as its text comes."""

    BEGIN, END = "<s>[INST]", "[/INST]</s>"

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        while (end := self.rest.find(self.END)) >= 0:
            turn, self.rest = self.rest[:end], self.rest[end + len(self.END) :]
            if not turn.startswith(self.BEGIN):
                raise ValueError("not a formatted conversation")
            role, _, body = turn[len(self.BEGIN) :].partition("\n")
            yield unescape(role), unescape(body)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of all turns of the production template's output."""
    reader = Reader()
    turns = list(reader.feed(formatted))
    if reader.rest:
        raise ValueError("the conversation breaks off")
    return turns


# ------------------------------------------------------------------ tables


def _sorted(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _conversations(batches) -> Iterator[tuple[Any, Iterator[dict]]]:
    """Each conversation and its messages, read as they come."""
    rows = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(*(b.column(i).to_pylist() for i in range(3))))
    import itertools

    for c, own in itertools.groupby(rows, key=lambda x: x[0]):
        yield c, (m for _, m in own)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, and spans (start, end) of code points under the loss mask."""

    def run(batches):
        compiled = compile_template(template)
        for c, messages in _conversations(batches):
            out, spans, n = [], [], 0
            for x, masked in compiled(messages):
                if masked:
                    spans.append({"start": n, "end": n + len(x)})
                out.append(x)
                n += len(x)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array(["".join(out)]), pa.array([spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "formatted", "spans"])

    return _sorted(conversations, conv_id, turn, role, text).mapInArrow(run, "conv_id long, formatted string, spans array<struct<start:long,end:long>>")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_digest(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """What is read back from each formatted conversation, a turn in memory at a time."""
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches):
        compiled = compile_template(template)
        rows: list[tuple] = []
        for c, messages in _conversations(batches):
            turns, loss, reader = hashlib.sha256(), hashlib.sha256(), Reader()
            n_turns = n_loss = n = 0
            for x, masked in compiled(messages):
                n += len(x)
                if masked:
                    plain = unescape(x)
                    n_loss += len(plain)
                    loss.update(plain.encode())
                for role, text in reader.feed(x):
                    n_turns += 1
                    turns.update(f"{role}\n{text}\n".encode())
            if reader.rest:
                raise ValueError("the conversation breaks off")
            rows.append((c, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n))
            if len(rows) == 1000:
                yield _rows(rows, names)
                rows = []
        if rows:
            yield _rows(rows, names)

    return _sorted(conversations, "conv_id", "turn", "role", "text").mapInArrow(run, DIGEST)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
