"""Chat formatting: a sandboxed template language, compiled to Python closures.

The language has `{{ expression }}`, `{% for name in name %}`, `{% if %}/{% elif %}/{% else %}`, `{% set name = expression %}`
and `{% generation %}` around what a model learns to say. Expressions have strings, integers, true, false, none, names,
`.field` of a turn, `loop.first`, `loop.last`, `loop.index0`, `+`, `==`, `!=`, `and`, `or`, `not`, parentheses and the
filters in FILTERS. Nothing else is reachable: no calls, attributes of Python objects or loops without end.

Cases: rows go by turn; a null turn comes first; equal turns go by role, then text, nulls first. A null role or text
is empty. Rows that repeat others are turns of their own. A null conv_id is a conversation like any other. A
conversation of any length is rendered turn by turn and read back piece by piece; a piece holds whole turns. An empty
table gives an empty table. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import bounded

CHATML = (
    "{% for turn in messages %}<|im_start|>{{ turn.role | header }}\n"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.content | escape }}{% endgeneration %}"
    "{% else %}{{ turn.content | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)
#: Characters of a piece of formatted text, after which the next turn begins a new one.
PIECE_CHARS = 1 << 20


def escape(text: str) -> str:
    """Without `<|`: a run of backslashes between `<` and `|` gets one more. Undone by unescape."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def header(text: str) -> str:
    """A role as one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unheader(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "header": header, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


# -- syntax tree --------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: str
    name: str


@dataclass(frozen=True)
class Unary:
    operand: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Filtered:
    operand: object
    name: str


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: str
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # of (condition, body)
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_BLOCK = re.compile(r"\{\{(?P<v1>-?)(?P<value>.*?)(?P<v2>-?)\}\}|\{%(?P<t1>-?)(?P<tag>.*?)(?P<t2>-?)%\}|\{#(?P<c1>-?).*?(?P<c2>-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+.|()]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else (0, "")

    def take(self, text: str | None = None) -> tuple:
        token = self.peek()
        if text is not None and token[1] != text or not token[0]:
            raise TemplateError(f"expected {text or 'a value'}, found {token[1]!r}")
        self.at += 1
        return token

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self):
        return self._left(("or",), self.both)

    def both(self):
        return self._left(("and",), self.negated)

    def negated(self):
        if self.peek() == (3, "not"):
            self.take()
            return Unary(self.negated())
        return self._left(("==", "!="), self.sum)

    def sum(self):
        return self._left(("+",), self.filtered)

    def _left(self, ops: tuple[str, ...], below: Callable):
        tree = below()
        while self.peek()[0] in (3, 4) and self.peek()[1] in ops:
            tree = Binary(self.take()[1], tree, below())
        return tree

    def filtered(self):
        tree = self.atom()
        while self.peek() == (4, "|"):
            self.take()
            if (name := self.take()[1]) not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = Filtered(tree, name)
        return tree

    def atom(self):
        kind, text = self.take()
        if kind == 1:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S))
        if kind == 2:
            return Const(int(text))
        if text == "(":
            tree = self.either()
            self.take(")")
            return tree
        if kind == 3:
            if text.lower() in ("true", "false", "none"):
                return Const({"true": True, "false": False, "none": None}[text.lower()])
            if self.peek() == (4, "."):
                self.take()
                return Field(text, self.take()[1])
            return Name(text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> tuple:
    """The template's syntax tree: a tuple of nodes. A minus inside a mark drops the white space on its side."""
    parts: list[tuple[str, str]] = []
    at, trimmed = 0, False
    for m in _BLOCK.finditer(source):
        text = source[at : m.start()]
        if trimmed:
            text = text.lstrip()
        if m["v1"] or m["t1"] or m["c1"]:
            text = text.rstrip()
        if text:
            parts.append(("text", text))
        if m["value"] is not None:
            parts.append(("value", m["value"]))
        elif m["tag"] is not None:
            parts.append(("tag", m["tag"].strip()))
        at, trimmed = m.end(), bool(m["v2"] or m["t2"] or m["c2"])
    if rest := source[at:].lstrip() if trimmed else source[at:]:
        parts.append(("text", rest))
    parts.reverse()
    body, end = _body(parts, ())
    assert end == ""
    return body


def _body(parts: list, ends: tuple[str, ...]) -> tuple[tuple, str]:
    nodes = []
    while parts:
        kind, text = parts.pop()
        if kind == "text":
            nodes.append(Output(Const(text)))
        elif kind == "value":
            nodes.append(Output(_Expression(text).whole()))
        else:
            word, _, rest = text.partition(" ")
            if word in ends:
                return tuple(nodes), text
            if word == "for":
                if not (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)", rest.strip())):
                    raise TemplateError(f"unexpected {text!r}")
                nodes.append(For(m[1], m[2], _body(parts, ("endfor",))[0]))
            elif word == "if":
                arms, other, condition, end = [], (), rest, "if"
                while not end.startswith("endif"):
                    last = end == "else"
                    body, end = _body(parts, ("endif",) if last else ("elif", "else", "endif"))
                    if last:
                        other = body
                    else:
                        arms.append((_Expression(condition).whole(), body))
                        condition = end.partition(" ")[2]
                nodes.append(If(tuple(arms), other))
            elif word == "set":
                name, equals, value = rest.partition("=")
                if not equals or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError(f"unexpected {text!r}")
                nodes.append(Assign(name.strip(), _Expression(value).whole()))
            elif word == "generation":
                nodes.append(Generation(_body(parts, ("endgeneration",))[0]))
            else:
                raise TemplateError(f"unexpected tag {text!r}")
    if ends:
        raise TemplateError(f"missing {ends[0]}")
    return tuple(nodes), ""


def _apply(op: str, left, right):
    if op == "+":
        return left + right if isinstance(left, int) and isinstance(right, int) else _text(left) + _text(right)
    return left == right if op == "==" else left != right


def _text(value) -> str:
    return "" if value is None else str(value)


def fold(tree):
    """The tree with constant expressions evaluated, dead branches gone and neighbouring constant texts joined."""
    if isinstance(tree, tuple):
        nodes: list = []
        for node in tree:
            node = fold(node)
            for x in node if isinstance(node, tuple) else (node,):
                if nodes and isinstance(x, Output) and isinstance(nodes[-1], Output) and isinstance(x.value, Const) and isinstance(nodes[-1].value, Const):
                    nodes[-1] = Output(Const(_text(nodes[-1].value.value) + _text(x.value.value)))
                else:
                    nodes.append(x)
        return tuple(nodes)
    if isinstance(tree, Unary):
        operand = fold(tree.operand)
        return Const(not operand.value) if isinstance(operand, Const) else Unary(operand)
    if isinstance(tree, Binary):
        left, right = fold(tree.left), fold(tree.right)
        if tree.op in ("and", "or") and isinstance(left, Const):
            return right if bool(left.value) == (tree.op == "and") else left
        if tree.op not in ("and", "or") and isinstance(left, Const) and isinstance(right, Const):
            return Const(_apply(tree.op, left.value, right.value))
        return Binary(tree.op, left, right)
    if isinstance(tree, Filtered):
        operand = fold(tree.operand)
        return Const(FILTERS[tree.name](_text(operand.value))) if isinstance(operand, Const) else Filtered(operand, tree.name)
    if isinstance(tree, Output):
        return Output(fold(tree.value))
    if isinstance(tree, Assign):
        return Assign(tree.name, fold(tree.value))
    if isinstance(tree, For):
        return For(tree.name, tree.over, fold(tree.body))
    if isinstance(tree, Generation):
        return Generation(fold(tree.body))
    if isinstance(tree, If):
        arms = []
        for condition, body in tree.arms:
            condition = fold(condition)
            if isinstance(condition, Const):
                if condition.value:
                    return fold(body) if not arms else If(tuple(arms), fold(body))
                continue
            arms.append((condition, fold(body)))
        return If(tuple(arms), fold(tree.other)) if arms else fold(tree.other)
    return tree


Emit = Callable[[str], None]


def _value(tree) -> Callable[[dict], object]:
    if isinstance(tree, Const):
        value = tree.value
        return lambda scope: value
    if isinstance(tree, Name):
        name = tree.name
        return lambda scope: scope.get(name)
    if isinstance(tree, Field):
        of, field = tree.of, tree.name

        def get(scope: dict):
            record = scope.get(of)
            return record.get(field) if isinstance(record, dict) else None

        return get
    if isinstance(tree, Unary):
        operand = _value(tree.operand)
        return lambda scope: not operand(scope)
    if isinstance(tree, Filtered):
        operand, change = _value(tree.operand), FILTERS[tree.name]
        return lambda scope: change(_text(operand(scope)))
    if isinstance(tree, Binary):
        op, left, right = tree.op, _value(tree.left), _value(tree.right)
        if op == "and":
            return lambda scope: left(scope) and right(scope)
        if op == "or":
            return lambda scope: left(scope) or right(scope)
        return lambda scope: _apply(op, left(scope), right(scope))
    raise TemplateError(f"no value: {tree!r}")


def _block(body: tuple) -> Callable:
    steps = [_step(node) for node in body]

    def run(scope: dict, out: "Rendered") -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node) -> Callable:
    if isinstance(node, Output):
        value = _value(node.value)
        return lambda scope, out: out.say(_text(value(scope)))
    if isinstance(node, Assign):
        name, value = node.name, _value(node.value)
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if isinstance(node, Generation):
        inner = _block(node.body)

        def learn(scope: dict, out: "Rendered") -> None:
            out.begin()
            inner(scope, out)
            out.end()

        return learn
    if isinstance(node, If):
        arms, other = [(_value(c), _block(b)) for c, b in node.arms], _block(node.other)

        def choose(scope: dict, out: "Rendered") -> None:
            for condition, body in arms:
                if condition(scope):
                    return body(scope, out)
            other(scope, out)

        return choose
    if isinstance(node, For):
        name, over, body = node.name, node.over, _block(node.body)

        def loop(scope: dict, out: "Rendered") -> None:
            items = iter(scope.get(over) or ())
            at, item = 0, next(items, None)
            while item is not None:
                following = next(items, None)
                inner = scope | {name: item, "loop": {"first": at == 0, "last": following is None, "index0": at}}
                body(inner, out)
                out.turn_done()
                at, item = at + 1, following

        return loop
    raise TemplateError(f"no statement: {node!r}")


class Rendered:
    """Takes what a template says: text, and spans [start, end) of code points under the loss mask. Holds one piece."""

    def __init__(self, flush: Callable[[int, str, list[tuple[int, int]]], None], piece_chars: int = PIECE_CHARS):
        self.flush, self.piece_chars = flush, piece_chars
        self.parts: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.at = self.begun = self.number = self.open = 0

    def say(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)

    def begin(self) -> None:
        if not self.open:
            self.begun = self.at
        self.open += 1

    def end(self) -> None:
        self.open -= 1
        if not self.open:
            self.spans.append((self.begun, self.at))

    def turn_done(self) -> None:
        """A piece ends where it is long enough, never within a span."""
        if self.at >= self.piece_chars and not self.open:
            self.close()

    def close(self) -> None:
        if self.parts or not self.number:
            self.flush(self.number, "".join(self.parts), self.spans)
            self.number += 1
        self.parts, self.spans, self.at = [], [], 0


def compile_template(source: str) -> Callable[[Iterable[dict], Rendered], None]:
    """A function of a conversation's turns (an iterable of dicts with role and content) that renders into Rendered."""
    run = _block(fold(parse(source)))

    def render(turns: Iterable[dict], out: Rendered) -> None:
        run({"messages": turns}, out)
        out.close()

    return render


# -- on Spark -----------------------------------------------------------------

FORMATTED = "conv_id long, piece long, formatted string, loss array<struct<start:long,end:long>>"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, dict]]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("_conv", "_role", "_text"))
        for conv, role, text in zip(*columns):
            yield conv, {"role": role, "content": text}


def format_conversations(rows: DataFrame, template: str = CHATML, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """conv_id, piece, formatted, loss: one row a conversation, more where it is longer than piece_chars.

    A conversation's rows meet in one task, sorted by Spark, and stream through it; none is held as a whole.
    """
    empty = F.lit("")
    named = rows.select(F.col(f"`{conv_col}`").cast("long").alias("_conv"), F.col(f"`{turn_col}`").alias("_turn"), F.coalesce(F.col(f"`{role_col}`"), empty).alias("_role"), F.coalesce(F.col(f"`{text_col}`"), empty).alias("_text"))
    laid = bounded(named.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text").select("_conv", "_role", "_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        made: list[dict] = []
        size = 0
        turns = _turns(batches)
        following = next(turns, None)

        def own(conv: int | None) -> Iterator[dict]:
            nonlocal following
            while following is not None and following[0] == conv:
                turn, following = following[1], None
                following = next(turns, None)
                yield turn

        schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        while following is not None:
            conv = following[0]

            def flush(number: int, text: str, spans: list[tuple[int, int]], conv=conv) -> None:
                nonlocal size
                size += len(text)
                made.append({"conv_id": conv, "piece": number, "formatted": text, "loss": [{"start": a, "end": b} for a, b in spans]})

            render(own(conv), Rendered(flush, piece_chars))
            if size > 8 * PIECE_CHARS:
                yield pa.RecordBatch.from_pylist(made, schema=schema)
                made, size = [], 0
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return laid.mapInArrow(run, FORMATTED)


def read_chatml(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a text that CHATML formatted."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index("<|im_end|>\n", line)
        if not text.startswith("<|im_start|>", at):
            raise ValueError(f"no turn begins at {at}")
        yield unheader(text[at + len("<|im_start|>") : line]), unescape(text[line + 1 : end])
        at = end + len("<|im_end|>\n")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def chatml_digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back, pieces in order as format_conversations leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        state: list | None = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["piece"] == 0:
                    if state:
                        out.append(state)
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, said in read_chatml(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in row["loss"]:
                    learnt = unescape(text[span["start"] : span["end"]])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(text)
            yield _digest_rows(names, out)
        if state:
            yield _digest_rows(names, [state])

    return formatted.mapInArrow(run, DIGESTS)


def _digest_rows(names: list[str], rows: list[list]) -> pa.RecordBatch:
    text = {"turns_sha256", "loss_sha256"}
    columns = {n: pa.array([r[i].hexdigest() if n in text else r[i] for r in rows], pa.string() if n in text else pa.int64()) for i, n in enumerate(names)}
    return pa.RecordBatch.from_pydict(columns)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chatml_digests(format_conversations(rows.unionByName(more)))


OP1_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, length(regexp_replace(text, '<(\\\\*)[|]', '<\\1+|', 'g')) AS escaped,
         length(regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '<(\\\\*)[|]', '<\\1+|', 'g')) AS head FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(escaped + head + 12 + 1 + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
