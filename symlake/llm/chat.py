"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree
becomes Python closures that yield text and generation markers. Expressions reach only the fields of
mappings that the template is given and the filters below; there are no calls and no attributes.

    {{ expression }}    {% if e %} {% elif e %} {% else %} {% endif %}    {% for x in e %} {% endfor %}
    {% generation %} {% endgeneration %}    {# comment #}
    expressions: 'text', numbers, true, false, none, name, e.field, e['field'], e|filter,
                 + ~ == != < > <= >= not and or ( )
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.llm.common import BATCH_ROWS, prepare

START, END, ASSISTANT = "<|im_start|>", "<|im_end|>", "assistant"
#: What is handed on at once of a long conversation; where it is cut changes nothing in the text.
CHUNK_CHARS = 1 << 20
CHATML = (
    "{% for m in messages %}<|im_start|>{{ m.role|line|escape }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
    "{% else %}{{ m.text|escape }}{% endif %}<|im_end|>\n{% endfor %}"
)


def escape(text: str) -> str:
    r"""Puts one backslash more between every < and |, so that no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def line(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def unline(text: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "line": line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template isn't in the language."""


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Field(NamedTuple):
    of: Any
    name: str


class Filter(NamedTuple):
    of: Any
    name: str


class Op(NamedTuple):
    name: str
    args: tuple


class Text(NamedTuple):
    value: str


class Show(NamedTuple):
    of: Any


class If(NamedTuple):
    test: Any
    then: tuple
    other: tuple


class For(NamedTuple):
    name: str
    of: Any
    body: tuple


class Generation(NamedTuple):
    body: tuple


def _show(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


_BINARY = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "~": lambda a, b: _show(a) + _show(b), "+": operator.add}
_LEXEME = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>.|()\[\]]))")
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}|\{#.*?#\}", re.S)


class _Expression:
    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            string, number, name, sign = m.groups()
            if string:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), string[1:-1])))
            elif number:
                self.tokens.append(("const", float(number) if "." in number else int(number)))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def next_is(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.next_is(value):
            raise TemplateError(f"{value!r} is missing")

    def whole(self) -> Any:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} wasn't expected")
        return tree

    def either(self) -> Any:
        tree = self.both()
        while self.next_is("or"):
            tree = Op("or", (tree, self.both()))
        return tree

    def both(self) -> Any:
        tree = self.negated()
        while self.next_is("and"):
            tree = Op("and", (tree, self.negated()))
        return tree

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.next_is("not") else self.compared()

    def compared(self) -> Any:
        tree = self.added()
        while sign := self.next_is("==", "!=", "<", ">", "<=", ">="):
            tree = Op(sign, (tree, self.added()))
        return tree

    def added(self) -> Any:
        tree = self.atom()
        while sign := self.next_is("+", "~"):
            tree = Op(sign, (tree, self.atom()))
        return tree

    def atom(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        if self.next_is("("):
            tree = self.either()
            self.need(")")
        else:
            kind, value = self.tokens[self.at]
            self.at += 1
            if kind == "const":
                tree = Const(value)
            elif kind == "name":
                tree = Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
            else:
                raise TemplateError(f"{value!r} wasn't expected")
        while sign := self.next_is(".", "[", "|"):
            kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            self.at += 1
            if sign == "[":
                self.need("]")
            if kind != ("const" if sign == "[" else "name") or not isinstance(value, str):
                raise TemplateError(f"{value!r} can't follow {sign!r}")
            if sign == "|":
                if value not in FILTERS:
                    raise TemplateError(f"there is no filter {value!r}")
                tree = Filter(tree, value)
            else:
                tree = Field(tree, value)
        return tree


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    stack: list[tuple[str, Any, list]] = [("", None, [])]

    def close(*kinds: str) -> tuple[str, Any, tuple]:
        kind, head, body = stack.pop()
        if kind not in kinds:
            raise TemplateError(f"{kind or 'nothing'} can't end here")
        return kind, head, tuple(body)

    def end_if(other: tuple) -> None:
        kind, head, body = close("if", "elif")
        tree = If(head, body, other)
        if kind == "elif":
            end_if((tree,))
        else:
            stack[-1][2].append(tree)

    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            stack[-1][2].append(Text(source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][2].append(Show(_Expression(m[1]).whole()))
        elif m[2] is not None:
            word, _, rest = m[2].partition(" ")
            if word in ("if", "elif"):
                if word == "elif" and stack[-1][0] not in ("if", "elif"):
                    raise TemplateError("elif without if")
                stack.append((word, _Expression(rest).whole(), []))
            elif word == "else":
                if stack[-1][0] not in ("if", "elif"):
                    raise TemplateError("else without if")
                stack.append(("else", None, []))
            elif word == "endif":
                end_if(close("else")[2] if stack[-1][0] == "else" else ())
            elif word == "for":
                if not (f := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                    raise TemplateError(f"can't read for {rest!r}")
                stack.append(("for", (f[1], _Expression(f[2]).whole()), []))
            elif word == "endfor":
                _, (name, of), body = close("for")
                stack[-1][2].append(For(name, of, body))
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word == "endgeneration":
                body = close("generation")[2]
                stack[-1][2].append(Generation(body))
            else:
                raise TemplateError(f"there is no tag {word!r}")
    if at < len(source):
        stack[-1][2].append(Text(source[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return tuple(stack[0][2])


def _operate(name: str, args: list[Any]) -> Any:
    return not args[0] if name == "not" else _BINARY[name](*args)


def fold(tree: Any) -> Any:
    """The tree with constant expressions computed, dead branches gone and neighbouring texts joined."""
    match tree:
        case tuple() if type(tree) is tuple:
            out: list = []
            for x in map(fold, tree):
                for y in x if type(x) is tuple else (x,):
                    if isinstance(y, Text) and out and isinstance(out[-1], Text):
                        out[-1] = Text(out[-1].value + y.value)
                    elif y != Text(""):
                        out.append(y)
            return tuple(out)
        case Show(of):
            of = fold(of)
            return Text(_show(of.value)) if isinstance(of, Const) else Show(of)
        case If(test, then, other):
            test = fold(test)
            return fold(then if test.value else other) if isinstance(test, Const) else If(test, fold(then), fold(other))
        case For(name, of, body):
            return For(name, fold(of), fold(body))
        case Generation(body):
            return Generation(fold(body))
        case Filter(of, name):
            of = fold(of)
            return Const(FILTERS[name](_show(of.value))) if isinstance(of, Const) else Filter(of, name)
        case Field(of, name):
            return Field(fold(of), name)
        case Op(name, args):
            args = tuple(map(fold, args))
            if name in ("and", "or") and isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (name == "and") else args[0]
            if name not in ("and", "or") and all(isinstance(a, Const) for a in args):
                return Const(_operate(name, [a.value for a in args]))
            return Op(name, args)
    return tree


Scope = dict[str, Any]


def _value(tree: Any) -> Callable[[Scope], Any]:
    match tree:
        case Const(value):
            return lambda scope: value
        case Name(name):
            return lambda scope: scope.get(name)
        case Field(of, name):
            get = _value(of)
            return lambda scope: x.get(name) if isinstance(x := get(scope), dict) else None
        case Filter(of, name):
            get, apply = _value(of), FILTERS[name]
            return lambda scope: apply(_show(get(scope)))
        case Op(name, args):
            first, *rest = map(_value, args)
            if name == "and":
                return lambda scope: first(scope) and rest[0](scope)
            if name == "or":
                return lambda scope: first(scope) or rest[0](scope)
            if name == "not":
                return lambda scope: not first(scope)
            apply = _BINARY[name]
            return lambda scope: apply(first(scope), rest[0](scope))
    raise TemplateError(f"{tree!r} has no value")


Pieces = Iterator[tuple[str, bool]]


def _render(tree: tuple) -> Callable[[Scope, bool], Pieces]:
    steps = []
    for node in tree:
        match node:
            case Text(value):
                steps.append(lambda scope, on, value=value: iter(((value, on),)))
            case Show(of):
                steps.append(lambda scope, on, get=_value(of): iter(((_show(get(scope)), on),)))
            case If(test, then, other):

                def choose(scope: Scope, on: bool, test=_value(test), then=_render(then), other=_render(other)) -> Pieces:
                    return (then if test(scope) else other)(scope, on)

                steps.append(choose)
            case For(name, of, body):

                def loop(scope: Scope, on: bool, name=name, of=_value(of), body=_render(body)) -> Pieces:
                    for x in of(scope) or ():
                        yield from body(scope | {name: x}, on)

                steps.append(loop)
            case Generation(body):
                steps.append(lambda scope, on, body=_render(body): body(scope, True))

    def run(scope: Scope, on: bool) -> Pieces:
        for step in steps:
            yield from step(scope, on)

    return run


def compile_template(source: str) -> Callable[[Scope], Pieces]:
    """A closure from variables to (text, whether under the generation mark), piece by piece: loops pull their items as they go."""
    run = _render(fold(parse(source)))
    return lambda scope: run(scope, False)


_CHUNKS = "conv_id long, chunk int, text string, spans array<struct<start: long, end: long>>"


def format_conversations(turns: DataFrame, template: str = CHATML) -> DataFrame:
    """conv_id, chunk, text, spans: the formatted conversations, in chunks.

    turns needs conv_id, turn, role and text; other columns are ignored. The template runs once over
    a conversation, whose messages it pulls as they are read; what it has said goes out as a row, a
    chunk, whenever it is over CHUNK_CHARS and not under the generation mark, so neither a
    conversation nor its text is held as a whole, and the chunks joined are the one rendering. Only
    a template that looks at the messages in any other way than by one loop over them gets a list of
    the conversation. spans are the places of the chunk under the generation mark. Null role and
    text are empty; null turns come first, equal turns by role and text; null conv_ids form one
    conversation; repeated rows are turns of their own. An empty table gives no rows.
    """
    prepare(turns.sparkSession)
    once = read_once(fold(parse(template)))  # an error shows here, not in a task
    rows = turns.select(*(F.col(c).cast(k).alias(c) for c, k in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        turns_of = ((conv_id, {"role": role or "", "text": text or ""}) for batch in batches for conv_id, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def chunks() -> Iterator[tuple]:
            for conv_id, rows in itertools.groupby(turns_of, key=lambda t: t[0]):
                messages = (m for _, m in rows)
                parts, spans, at, chunk = [], [], 0, 0
                for text, on in render({"messages": messages if once else list(messages)}):
                    if on and text:
                        if spans and spans[-1]["end"] == at:
                            spans[-1]["end"] += len(text)
                        else:
                            spans.append({"start": at, "end": at + len(text)})
                    if at > CHUNK_CHARS and not on:
                        yield conv_id, chunk, "".join(parts), spans
                        parts, spans, at, chunk = [], [], 0, chunk + 1
                    parts.append(text)
                    at += len(text)
                yield conv_id, chunk, "".join(parts), spans

        def batch(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), spans_type), strict=True)], names=["conv_id", "chunk", "text", "spans"])

        done, size = [], 0
        for c in chunks():
            done.append(c)
            size += len(c[2])
            if size > CHUNK_CHARS or len(done) >= BATCH_ROWS:
                yield batch(done)
                done, size = [], 0
        if done:
            yield batch(done)

    return rows.mapInArrow(run, _CHUNKS)


def read_once(tree: tuple) -> bool:
    """Whether the messages can be pulled as they come: the only mention of them is one loop over them that stands in no other loop."""

    def mentions(x: Any, looped: bool) -> int:
        """Loops over the messages, each other mention counted as two."""
        match x:
            case Name("messages"):
                return 2
            case For(name, of, body):
                own = (2 if looped else 1) if of == Name("messages") else mentions(of, looped)
                return own + mentions(body, True) * (name != "messages")
            case tuple():
                return sum(mentions(y, looped) for y in x)
        return 0

    return mentions(tree, False) <= 1


def read_turns(text: str) -> tuple[list[tuple[str, str]], str]:
    """The (role, text) of the turns that end in a formatted text, and what is left after the last of them."""
    *parts, rest = text.split(END + "\n")
    found = []
    for part in parts:
        role, _, said = part.removeprefix(START).partition("\n")
        found.append((unline(unescape(role)), unescape(said)))
    return found, rest


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them: one row per conversation, over the chunks in their order."""
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        rest = ""

        def rows(done: list[list]) -> pa.RecordBatch:
            done = [[c, n, a.hexdigest(), k, b.hexdigest(), size] for c, n, a, k, b, size in done]
            columns = list(zip(*done, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            done = []
            for conv_id, chunk, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not chunk:
                    if now:
                        done.append(now)
                    now, rest = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], ""
                found, rest = read_turns(rest + text)
                for role, said in found:
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    learnt = unescape(text[s["start"] : s["end"]])
                    now[3] += len(learnt)
                    now[4].update(learnt.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
            yield rows(done)
        if now:
            yield rows([now])

    return formatted.mapInArrow(run, kinds)
