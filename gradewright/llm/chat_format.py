"""Chat formatting: a compiler from a small template language to Python closures.

The language has text, ``{{ expression }}`` with filters, ``{% if %} .. {% elif %} .. {% else %} .. {% endif %}``,
``{% for x in list %} .. {% endfor %}`` and ``{% generation %} .. {% endgeneration %}``, whose output is the text the model
learns from. Expressions have strings, integers, names, fields, ``==``, ``!=``, ``and``, ``or``, ``not``, ``+`` and
brackets. Nothing else can be named or called: fields are read from mappings only, filters come from a fixed
table, and a name that is not given is an error.

Compiling reads tokens into a syntax tree, folds what is constant (joined strings, decided branches, filters of
constants, neighbouring text), and turns every node into a closure that appends to a list.

Escaping makes control strings inside texts harmless and is undone by ``unescape``: a backslash is doubled, and ``\\.`` is
put after the first character of a control string.

Defined results: turns are ordered by turn (null first), then role, then text; repeated rows are repeated turns; a null text
or role is empty; null is a conversation of its own; an empty table gives no conversations. One conversation is one
output value, so it is formed in one task; conversations are never joined to one another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[BOT]", "[ROLE]", "[TEXT]", "[/ROLE]")
TEMPLATE = (
    "{{ '<' + 's>' }}{% for m in turns %}"
    "{% if m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'assistant' %}[BOT]{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}[SYS]{{ m.text | escape }}[/SYS]"
    "{% else %}[ROLE]{{ m.role | escape }}[TEXT]{{ m.text | escape }}[/ROLE]{% endif %}"
    "{% endfor %}"
)
_ANY = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    return _ANY.sub(lambda m: f"{m[0][0]}\\.{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\\" if m[1] == "\\" else "", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


# ---- the tree ---------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body) pairs; the condition of else is true


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_BLOCK = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|.()+]))""")


class Parser:
    """Recursive descent over the blocks of a template."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str]] = []
        at = 0
        for m in _BLOCK.finditer(source):
            self.blocks += [("text", source[at : m.start()])] if m.start() > at else []
            self.blocks.append(("output", m[1]) if m[1] is not None else ("tag", m[2].strip()))
            at = m.end()
        self.blocks += [("text", source[at:])] if at < len(source) else []
        self.at = 0

    def body(self, *ends: str) -> tuple[tuple, str]:
        """Nodes up to one of the tags, and that tag."""
        out: list = []
        while self.at < len(self.blocks):
            kind, content = self.blocks[self.at]
            self.at += 1
            if kind == "text":
                out.append(Output(Const(content)))
            elif kind == "output":
                out.append(Output(self.expression(content)))
            elif (word := content.split(None, 1)[0] if content else "") in ends:
                return tuple(out), content
            else:
                out.append(self.tag(word, content))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(out), ""

    def tag(self, word: str, content: str):
        if word == "if":
            branches, condition = [], self.expression(content[2:])
            while True:
                inner, end = self.body("elif", "else", "endif")
                branches.append((condition, inner))
                if end == "endif":
                    return If(tuple(branches))
                if end == "else":
                    inner, _ = self.body("endif")
                    return If((*branches, (Const(True), inner)))
                condition = self.expression(end[4:])
        if word == "for":
            if not (m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", content, re.DOTALL)):
                raise TemplateError(content)
            inner, _ = self.body("endfor")
            return For(m[1], self.expression(m[2]), inner)
        if content == "generation":
            return Generation(self.body("endgeneration")[0])
        raise TemplateError(f"unknown tag {content!r}")

    def expression(self, source: str):
        tokens, at, end = [], 0, len(source.rstrip())
        while at < end:
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"cannot read {source[at:]!r}")
            tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        tree, rest = self.either(tokens)
        if rest:
            raise TemplateError(f"unexpected {rest[0][1]!r}")
        return tree

    def either(self, t):
        return self.chain(t, "or", self.both)

    def both(self, t):
        return self.chain(t, "and", self.inverse)

    def chain(self, t, word, below):
        left, t = below(t)
        while t[:1] == [(3, word)]:
            right, t = below(t[1:])
            left = Op(word, (left, right))
        return left, t

    def inverse(self, t):
        if t[:1] == [(3, "not")]:
            inner, t = self.inverse(t[1:])
            return Op("not", (inner,)), t
        left, t = self.sum(t)
        if t and t[0] in ((4, "=="), (4, "!=")):
            right, rest = self.sum(t[1:])
            return Op(t[0][1], (left, right)), rest
        return left, t

    def sum(self, t):
        left, t = self.piped(t)
        while t[:1] == [(4, "+")]:
            right, t = self.piped(t[1:])
            left = Op("+", (left, right))
        return left, t

    def piped(self, t):
        left, t = self.atom(t)
        while t and t[0] in ((4, "|"), (4, ".")):
            if len(t) < 2 or t[1][0] != 3:
                raise TemplateError("a name is missing")
            if t[0][1] == "|" and t[1][1] not in FILTERS:
                raise TemplateError(f"unknown filter {t[1][1]!r}")
            left = Filter(t[1][1], left) if t[0][1] == "|" else Field(left, t[1][1])
            t = t[2:]
        return left, t

    def atom(self, t):
        if not t:
            raise TemplateError("a value is missing")
        kind, word = t[0]
        if kind == 1:
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1])), t[1:]
        if kind == 2:
            return Const(int(word)), t[1:]
        if kind == 3:
            return (Const(word == "true") if word in ("true", "false") else Name(word)), t[1:]
        if word == "(":
            inner, t = self.either(t[1:])
            if t[:1] == [(4, ")")]:
                return inner, t[1:]
        raise TemplateError(f"unexpected {word!r}")


# ---- folding ----------------------------------------------------------------

OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b, "not": lambda a: not a}


def fold(node):
    """The same expression with constant parts computed."""
    if isinstance(node, Field):
        return Field(fold(node.of), node.name)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.sign in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.sign == "and") else args[0]
        if node.sign in OPS and all(isinstance(a, Const) for a in args):
            return Const(OPS[node.sign](*[a.value for a in args]))
        return Op(node.sign, args)
    return node


def fold_body(body: tuple) -> tuple:
    """The same nodes without dead branches; neighbouring constant text is one node."""
    out: list = []
    for node in body:
        if isinstance(node, Output):
            done = [Output(fold(node.value))]
        elif isinstance(node, For):
            done = [For(node.name, fold(node.over), fold_body(node.body))]
        elif isinstance(node, Generation):
            done = [Generation(fold_body(node.body))]
        else:
            live = []
            for condition, inner in ((fold(c), fold_body(b)) for c, b in node.branches):
                if not isinstance(condition, Const) or condition.value:
                    live.append((condition, inner))
                if isinstance(condition, Const) and condition.value:
                    break
            done = list(live[0][1]) if live and isinstance(live[0][0], Const) else [If(tuple(live))] if live else []
        for d in done:
            if out and all(isinstance(x, Output) and isinstance(x.value, Const) for x in (out[-1], d)):
                d = Output(Const(f"{out.pop().value.value}{d.value.value}"))
            out.append(d)
    return tuple(out)


# ---- closures ---------------------------------------------------------------


class Out:
    """What a rendering has written: parts, their length so far, and the spans of generations."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def value_of(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda names, value=node.value: value
    if isinstance(node, Name):

        def name(names):
            if node.name not in names:
                raise TemplateError(f"{node.name} is not given")
            return names[node.name]

        return name
    if isinstance(node, Field):
        of = value_of(node.of)

        def field(names):
            whole = of(names)
            if not isinstance(whole, dict) or node.name not in whole:
                raise TemplateError(f"no field {node.name}")
            return whole[node.name]

        return field
    if isinstance(node, Filter):
        of, apply = value_of(node.of), FILTERS[node.name]
        return lambda names: apply(of(names))
    args = [value_of(a) for a in node.args]
    if node.sign == "and":
        return lambda names: args[0](names) and args[1](names)
    if node.sign == "or":
        return lambda names: args[0](names) or args[1](names)
    op = OPS[node.sign]
    return lambda names: op(*[a(names) for a in args])


def writer_of(node) -> Callable[[dict, Out], None]:
    if isinstance(node, Output):
        value = value_of(node.value)
        return lambda names, out: out.write(str(value(names)))
    if isinstance(node, If):
        branches = [(value_of(c), body_of(b)) for c, b in node.branches]

        def choose(names, out):
            for condition, body in branches:
                if condition(names):
                    return body(names, out)

        return choose
    if isinstance(node, For):
        over, body = value_of(node.over), body_of(node.body)

        def loop(names, out):
            for item in over(names):
                body({**names, node.name: item}, out)

        return loop
    body = body_of(node.body)

    def generation(names, out):
        start = out.length
        body(names, out)
        out.spans.append((start, out.length))

    return generation


def body_of(body: tuple) -> Callable[[dict, Out], None]:
    writers = [writer_of(n) for n in body]

    def write(names, out):
        for w in writers:
            w(names, out)

    return write


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from names to the rendered text and its generation spans."""
    write = body_of(fold_body(Parser(source).body()[0]))

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Out()
        write(names, out)
        return "".join(out.parts), out.spans

    return render


# ---- reading back, and the Spark side ---------------------------------------

_TURN = re.compile(
    r"\[INST\](?P<user>.*?)\[/INST\]|\[BOT\](?P<assistant>.*?)</s>|\[SYS\](?P<system>.*?)\[/SYS\]|\[ROLE\](?P<role>.*?)\[TEXT\](?P<text>.*?)\[/ROLE\]",
    re.DOTALL,
)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a conversation formatted by ``TEMPLATE``."""
    turns, at = [], len("<s>")
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        kind = m.lastgroup
        turns.append((unescape(m["role"]), unescape(m["text"])) if kind == "text" else (kind, unescape(m[kind])))
        at = m.end()
    return turns


SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
FORMATTED = StructType([StructField("formatted", StringType()), StructField("loss", ArrayType(SPAN))])


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation with its ordered ``turns``."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id``, the ``formatted`` text, and the spans of it under the ``loss`` mask."""

    @F.pandas_udf(FORMATTED)
    def rendered(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        for convs in batches:
            done = [render({"turns": [dict(role=t["role"], text=t["text"]) for t in turns]}) for turns in convs]
            yield pd.DataFrame({"formatted": [text for text, _ in done], "loss": [[{"start": s, "end": e} for s, e in spans] for _, spans in done]})

    return conversations(rows).select("conv_id", rendered("turns").alias("f")).select("conv_id", "f.*")


DIGEST = StructType(
    [StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())]
)


@F.pandas_udf(DIGEST)
def _digest(formatted: pd.Series, loss: pd.Series) -> pd.DataFrame:
    rows = []
    for text, spans in zip(formatted, loss, strict=True):
        turns = read_back(text)
        learned = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
        whole = "".join(f"{role}\n{said}\n" for role, said in turns)
        rows.append((len(turns), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=DIGEST.names)


def report(rows: DataFrame) -> DataFrame:
    """Per conversation what its formatted text holds, read back from it."""
    return format_chats(rows).select("conv_id", _digest("formatted", "loss").alias("d")).select("conv_id", "d.*")
