"""Chat formatting with a compiled template.

The template language is closed: text, `{{ expression }}`, `{% for x in list %}`, `{% if %}` / `{% elif %}` /
`{% else %}`, and `{% generation %}` around what the model is to learn. Expressions have strings, whole numbers, names,
attributes of rows (looked up as keys, never as Python attributes), == != < <= > >=, `and` `or` `not`, + and |filters.
No call, index or import can be written, so a template can do nothing but render.

`compile_template` parses it into a syntax tree, folds what is constant (neighbouring texts, operations on literals,
branches of a constant condition) and turns the tree into nested Python closures that append to a list of strings and
record the spans of generation blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import groups

# Strings that steer a model, which must not appear unescaped inside a text.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROLS = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + r")[<\[]|\\")
_CODES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_BACK = {v[1]: k for k, v in _CODES.items()}

TEMPLATE = (
    "{% for m in messages %}" + TURN + "{{ m.role | escape }}" + BODY + '{% if m.role == "assistant" %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}' + END + "{% endfor %}"
)


def escape(text: str) -> str:
    """The text with backslashes doubled and the first character of each control string replaced by a code."""
    return _CONTROL.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


FILTERS: dict[str, Callable[[object], object]] = {"escape": lambda x: escape(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}


class TemplateError(ValueError):
    """The template cannot be parsed, or names something that is not there."""


# -- syntax tree ------------------------------------------------------------------------------------------------------
@dataclass
class Node:
    kind: str
    value: object = None
    parts: list = field(default_factory=list)


_TOKENS = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+|.()]))')
# A minus sign inside a tag takes the white space on that side of it with it.
_PIECES = re.compile(r"(?:\s*\{\{-|\{\{)(.*?)(?:-\}\}\s*|\}\})|(?:\s*\{%-|\{%)(.*?)(?:-%\}\s*|%\})|\{#.*?#\}", re.DOTALL)


class _Expression:
    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(next((k, x) for k, x in zip(("text", "number", "name", "sign"), m.groups()) if x is not None))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        if self.peek()[1] in wanted and self.peek()[0] in ("name", "sign"):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def parse(self) -> Node:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", parts=[node, self.both()])
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", parts=[node, self.negated()])
        return node

    def negated(self) -> Node:
        return Node("not", parts=[self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.summed()
        while sign := self.take("==", "!=", "<", "<=", ">", ">="):
            node = Node("compare", sign, [node, self.summed()])
        return node

    def summed(self) -> Node:
        node = self.filtered()
        while self.take("+"):
            node = Node("add", parts=[node, self.filtered()])
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no such filter: {name!r}")
            self.at += 1
            node = Node("filter", name, [node])
        return node

    def atom(self) -> Node:
        kind, x = self.peek()
        self.at += 1
        if kind == "text":
            return Node("constant", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), x[1:-1]))
        if kind == "number":
            return Node("constant", int(x))
        if kind == "name" and x in ("true", "false"):
            return Node("constant", x == "true")
        if kind == "name":
            node = Node("name", x)
            while self.take("."):
                kind, x = self.peek()
                if kind != "name":
                    raise TemplateError("a dot needs a name after it")
                self.at += 1
                node = Node("key", x, [node])
            return node
        if x == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return node
        raise TemplateError(f"unexpected {x!r}")


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    pieces, at = [], 0
    for m in _PIECES.finditer(source):
        pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("show", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    pieces.append(("text", source[at:]))
    place = 0

    def block(*stops: str) -> tuple[Node, str]:
        nonlocal place
        out = Node("block")
        while place < len(pieces):
            kind, x = pieces[place]
            place += 1
            if kind == "text":
                out.parts += [Node("text", x)] * bool(x)
            elif kind == "show":
                out.parts.append(Node("show", parts=[_Expression(x).parse()]))
            elif x.split(None, 1)[:1] and x.split(None, 1)[0] in stops:
                return out, x
            elif m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", x, re.DOTALL):
                body, _ = block("endfor")
                out.parts.append(Node("for", m[1], [_Expression(m[2]).parse(), body]))
            elif m := re.fullmatch(r"if\s+(.+)", x, re.DOTALL):
                out.parts.append(branch(m[1]))
            elif x == "generation":
                out.parts.append(Node("generation", parts=[block("endgeneration")[0]]))
            else:
                raise TemplateError(f"unknown tag {x!r}")
        if stops:
            raise TemplateError(f"{' or '.join(stops)} is missing")
        return out, ""

    def branch(condition: str) -> Node:
        body, stop = block("elif", "else", "endif")
        rest = Node("block")
        if stop.startswith("elif"):
            rest = branch(stop[4:])
        elif stop == "else":
            rest, _ = block("endif")
        return Node("if", parts=[_Expression(condition).parse(), body, rest])

    return block()[0]


_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def fold(node: Node) -> Node:
    """The tree with constants worked out, branches of constant conditions chosen and neighbouring texts joined."""
    parts = [fold(x) for x in node.parts]
    known = bool(parts) and all(x.kind == "constant" for x in parts)
    values = [x.value for x in parts]
    if node.kind in ("compare", "add", "not", "and", "or", "filter") and known:
        return Node("constant", _operate(node)(*values))
    if node.kind == "show" and known:
        return Node("text", str(values[0]))
    if node.kind == "if" and parts[0].kind == "constant":
        return parts[1] if values[0] else parts[2]
    if node.kind == "block":
        flat: list[Node] = []
        for x in parts:
            for y in x.parts if x.kind == "block" else [x]:
                if y.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", flat[-1].value + y.value)
                else:
                    flat.append(y)
        return Node("block", parts=flat)
    return Node(node.kind, node.value, parts)


def _operate(node: Node) -> Callable:
    return {"compare": lambda: _COMPARE[node.value], "add": lambda: lambda a, b: a + b, "not": lambda: lambda a: not a, "and": lambda: lambda a, b: a and b, "or": lambda: lambda a, b: a or b, "filter": lambda: FILTERS[node.value]}[node.kind]()


# -- closures ---------------------------------------------------------------------------------------------------------
@dataclass
class _Out:
    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(node: Node) -> Callable[[dict], object]:
    if node.kind == "constant":
        return lambda env, v=node.value: v
    if node.kind == "name":

        def name(env, key=node.value):
            if key not in env:
                raise TemplateError(f"no such name: {key!r}")
            return env[key]

        return name
    inner = [_value(x) for x in node.parts]
    if node.kind == "key":

        def look(env, get=inner[0], key=node.value):
            row = get(env)
            if not isinstance(row, dict) or key not in row:
                raise TemplateError(f"no such key: {key!r}")
            return row[key]

        return look
    if node.kind == "and":
        return lambda env: inner[0](env) and inner[1](env)
    if node.kind == "or":
        return lambda env: inner[0](env) or inner[1](env)
    act = _operate(node)
    if len(inner) == 1:
        return lambda env, f=inner[0]: act(f(env))
    return lambda env, f=inner[0], g=inner[1]: act(f(env), g(env))


def _render(node: Node) -> Callable[[dict, _Out], None]:
    if node.kind == "text":
        return lambda env, out, t=node.value: out.add(t)
    if node.kind == "show":
        return lambda env, out, f=_value(node.parts[0]): out.add(str(f(env)))
    if node.kind == "block":
        steps = [_render(x) for x in node.parts]

        def block(env, out):
            for step in steps:
                step(env, out)

        return block
    if node.kind == "if":
        test, yes, no = _value(node.parts[0]), _render(node.parts[1]), _render(node.parts[2])
        return lambda env, out: yes(env, out) if test(env) else no(env, out)
    if node.kind == "generation":
        body = _render(node.parts[0])

        def generation(env, out):
            start = out.size
            body(env, out)
            out.spans.append((start, out.size))

        return generation
    items, body = _value(node.parts[0]), _render(node.parts[1])

    def loop(env, out, name=node.value):
        rows = items(env)
        own = dict(env)
        for i, row in enumerate(rows):
            own[name] = row
            own["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(rows) - 1}
            body(own, out)

    return loop


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from names to (the rendered text, the spans of generation blocks in it, in code points)."""
    run = _render(fold(parse(source)))

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(names, out)
        return "".join(out.parts), out.spans

    return render


_BACKWARD = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.DOTALL)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a text that TEMPLATE has rendered."""
    out, at = [], 0
    for m in _BACKWARD.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"unreadable at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"unreadable at {at}")
    return out


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row for each conv_id: conv_id, formatted and loss_spans (start, stop) of what the model is to learn.

    Rows are ordered by turn (null first), then role and text, so ties have one order; repeated rows are repeated
    turns. A null role or text is empty; rows of a null conv_id are one conversation. Other columns are not read; an
    empty table gives an empty result. A conversation is one output row, so it is rendered in one task; tasks hold one
    conversation at a time.
    """

    def run(batches):
        render = compile_template(template)
        for g in groups(batches, "key"):
            text, spans = render({"messages": [{"role": r, "text": t} for r, t in zip(g["role"], g["text"])]})
            yield pd.DataFrame({"key": [g["key"].iloc[0]], "formatted": [text], "loss_spans": [[{"start": a, "stop": b} for a, b in spans]]})

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(empty("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    out = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text").mapInPandas(run, "key string, formatted string, loss_spans array<struct<start:long,stop:long>>")
    return out.select(F.when(F.col("key") != "", F.col("key")).cast("long").alias("conv_id"), "formatted", "loss_spans")


def digest(turns: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its formatted text and loss spans."""

    def run(batches):
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for pdf in batches:
            rows = []
            for text, spans in zip(pdf["formatted"], pdf["loss_spans"]):
                back = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                rows.append((len(back), sha("".join(f"{r}\n{t}\n" for r, t in back)), len(loss), sha(loss), len(text)))
            out = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    f = format_conversations(turns)
    out = f.select(F.col("conv_id").cast("string").alias("id"), "formatted", "loss_spans").mapInPandas(run, "id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.select(F.col("id").cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
