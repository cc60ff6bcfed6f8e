"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree becomes
Python closures that yield the rendered pieces one by one, each with a flag that says whether it lies between generation
markers. The language knows {{ expression }}, {% for x in list %} with loop.first, loop.last, loop.index0, {% if %} {% elif %} {% else %},
{% set name = expression %} and {% generation %}; expressions have literals, names, items (a.b and a['b']), comparison, and/or/not,
`~` and `+` for joining or adding, and the filters in FILTERS. There are no calls, no attributes of Python objects and no
access beyond the variables given.

Texts are escaped reversibly before they are put in: a backslash becomes two, and a control string gets a backslash
after its first character, so that no text can end a turn. Conversations are rendered as a stream, turn after turn, and
leave as segments of bounded size with the spans of the loss mask; the reader of segments is a stream too, so a conversation of any
length needs the memory of one turn.

Defined cases: null text or role is empty; a null conv_id is a conversation of its own; ties in turn go by role, then text; repeated
rows are turns of their own; an empty table gives no conversations; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, read, tidy

#: Strings that steer chat models; the first two mark this template's turns.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")
TEMPLATE = (
    "{% for m in messages %}{% set mark = '<|im_' ~ 'start|>' %}{{ mark }}{{ m.role | escape_role }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|im_end|>{{ '\\n' }}{% endfor %}"
)
_HOSTILE = re.compile("|".join(["\\\\", *(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True))]))
_ESCAPED = re.compile(r"\\(\\?)")
_ROLE_OUT = {"%": "%25", "\n": "%0A", "\\": "%5C", "<": "%3C", "[": "%5B"}
_ROLE_IN = {v: k for k, v in _ROLE_OUT.items()}


def escape(text: str) -> str:
    return _HOSTILE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return re.sub(r"[%\n\\<\[]", lambda m: _ROLE_OUT[m[0]], role)


def unescape_role(role: str) -> str:
    return re.sub("%(?:25|0A|5C|3C|5B)", lambda m: _ROLE_IN[m[0]], role)


FILTERS: dict[str, Callable] = {"escape": escape, "escape_role": escape_role, "trim": lambda s: s.strip(), "upper": lambda s: s.upper(), "lower": lambda s: s.lower(), "length": len, "string": str}


class TemplateError(ValueError):
    """The template is not in the language, or uses what it may not."""


_WORDS = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>~+\-%*|.\[\]()]))")
_PARTS = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_LEVELS = [("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("~", "+", "-"), ("*", "%")]


class _Expression:
    """Parser of one expression: tuples ('const', v), ('name', n), ('item', a, b), ('not', a), ('filter', name, a) or ('op', o, a, b)."""

    def __init__(self, source: str):
        self.words, self.at, pos = [], 0, 0
        source = source.strip()
        while pos < len(source):
            m = _WORDS.match(source, pos)
            if m is None:
                raise TemplateError(f"cannot read {source[pos:]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()

    def peek(self) -> str | None:
        return self.words[self.at][1] if self.at < len(self.words) and self.words[self.at][0] != "str" else None

    def take(self, *wanted: str) -> str | None:
        if (word := self.peek()) in wanted:
            self.at += 1
            return word
        return None

    def whole(self) -> tuple:
        tree = self.level(0)
        if self.at != len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return tree

    def level(self, depth: int) -> tuple:
        if depth == len(_LEVELS):
            return self.unary()
        left = self.level(depth + 1)
        while op := self.take(*_LEVELS[depth]):
            left = ("op", op, left, self.level(depth + 1))
        return left

    def unary(self) -> tuple:
        if self.take("not"):
            return ("not", self.level(2))
        if self.take("-"):
            return ("op", "-", ("const", 0), self.unary())
        tree = self.primary()
        while True:
            if self.take("."):
                tree = ("item", tree, ("const", self.name()))
            elif self.take("["):
                tree = ("item", tree, self.level(0))
                if not self.take("]"):
                    raise TemplateError("] is missing")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                tree = ("filter", name, tree)
            else:
                return tree

    def name(self) -> str:
        if self.at >= len(self.words) or self.words[self.at][0] != "name" or self.words[self.at][1].startswith("_"):
            raise TemplateError("a name is missing or not allowed")
        self.at += 1
        return self.words[self.at - 1][1]

    def primary(self) -> tuple:
        if self.at >= len(self.words):
            raise TemplateError("the expression ends early")
        kind, word = self.words[self.at]
        if kind == "str":
            self.at += 1
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "num":
            self.at += 1
            return ("const", float(word) if "." in word else int(word))
        if self.take("("):
            tree = self.level(0)
            if not self.take(")"):
                raise TemplateError(") is missing")
            return tree
        name = self.name()
        known = {"true": True, "false": False, "none": None}
        return ("const", known[name.lower()]) if name.lower() in known else ("name", name)


def _apply(op: str, a, b):
    if op == "~":
        return _said(a) + _said(b)
    if op == "+":
        if isinstance(a, str) != isinstance(b, str):
            raise TemplateError("+ joins texts or adds numbers; ~ joins anything")
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        if isinstance(a, str) or isinstance(b, str):
            raise TemplateError("texts can't be multiplied")
        return a * b
    if op == "%":
        if isinstance(a, str):
            raise TemplateError("% is for numbers")
        return a % b
    return {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "in": lambda: a in b}[op]()


def _said(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(tree: tuple) -> tuple:
    """The expression with every constant part computed."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "filter":
        inner = fold(tree[2])
        return ("const", FILTERS[tree[1]](inner[1])) if inner[0] == "const" else ("filter", tree[1], inner)
    if kind == "not":
        inner = fold(tree[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind == "item":
        return ("item", fold(tree[1]), fold(tree[2]))
    op, a, b = tree[1], fold(tree[2]), fold(tree[3])
    if op in ("and", "or"):
        if a[0] == "const":
            return b if bool(a[1]) == (op == "and") else a
        return ("op", op, a, b)
    return ("const", _apply(op, a[1], b[1])) if a[0] == b[0] == "const" else ("op", op, a, b)


def _value(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda scope: value
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "item":
        base, key = _value(tree[1]), _value(tree[2])

        def item(scope: dict):
            of, k = base(scope), key(scope)
            if isinstance(of, dict):
                return of.get(k)
            if isinstance(of, (list, str)) and isinstance(k, int):
                return of[k] if -len(of) <= k < len(of) else None
            return None

        return item
    if kind == "filter":
        run, inner = FILTERS[tree[1]], _value(tree[2])
        return lambda scope: run(inner(scope))
    if kind == "not":
        inner = _value(tree[1])
        return lambda scope: not inner(scope)
    op, a, b = tree[1], _value(tree[2]), _value(tree[3])
    if op == "and":
        return lambda scope: a(scope) and b(scope)
    if op == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope: _apply(op, a(scope), b(scope))


def parse(source: str) -> list[tuple]:
    """The template's syntax tree: ('text', s), ('show', e), ('set', n, e), ('if', [(e, body)], other), ('for', n, e, body), ('gen', body)."""
    parts, at = [], 0
    trim = False  # a minus inside a mark takes the white space on its side away
    for m in _PARTS.finditer(source):
        said = source[at : m.start()]
        said = said.lstrip() if trim else said
        said = said.rstrip() if m[0][2] == "-" else said
        trim = m[0][-3] == "-"
        if said:
            parts.append(("text", said))
        if m[1] is not None:
            parts.append(("show", fold(_Expression(m[1]).whole())))
        elif m[2] is not None:
            parts.append(("tag", *(m[2].strip().split(None, 1) + [""])[:2]))
        at = m.end()
    if said := source[at:].lstrip() if trim else source[at:]:
        parts.append(("text", said))
    place = 0

    def body(*ends: str) -> tuple[list[tuple], tuple]:
        nonlocal place
        nodes: list[tuple] = []
        while place < len(parts):
            part = parts[place]
            place += 1
            if part[0] != "tag":
                nodes.append(part)
                continue
            _, word, rest = part
            if word in ends:
                return nodes, part
            if word == "set":
                name, eq, said = rest.partition("=")
                if not eq or not re.fullmatch(r"\s*[A-Za-z]\w*\s*", name):
                    raise TemplateError("set needs name = expression")
                nodes.append(("set", name.strip(), fold(_Expression(said).whole())))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError("for needs name in expression")
                inner, _ = body("endfor")
                nodes.append(("for", m[1], fold(_Expression(m[2]).whole()), inner))
            elif word == "generation":
                inner, _ = body("endgeneration")
                nodes.append(("gen", inner))
            elif word == "if":
                tests, other, test = [], [], fold(_Expression(rest).whole())
                while True:
                    inner, end = body("elif", "else", "endif")
                    tests.append((test, inner))
                    if end[1] == "elif":
                        test = fold(_Expression(end[2]).whole())
                        continue
                    if end[1] == "else":
                        other, _ = body("endif")
                    break
                nodes.append(_fold_if(tests, other))
            else:
                raise TemplateError(f"no tag {word}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ()

    return _join(body()[0])


def _fold_if(tests: list[tuple], other: list[tuple]) -> tuple:
    left = []
    for test, inner in tests:
        if test[0] == "const" and not test[1]:
            continue
        if test[0] == "const":
            return ("if", left, inner) if left else ("all", inner)
        left.append((test, inner))
    return ("if", left, other) if left else ("all", other)


def _join(nodes: list[tuple]) -> list[tuple]:
    """Constant output becomes text, and neighbouring text one node; also within bodies."""
    out: list[tuple] = []
    for node in chain.from_iterable(n[1] if n[0] == "all" else (n,) for n in nodes):
        if node[0] == "all":
            node = ("if", [], node[1])
        if node[0] == "show" and node[1][0] == "const":
            node = ("text", _said(node[1][1]))
        elif node[0] == "for":
            node = ("for", node[1], node[2], _join(node[3]))
        elif node[0] == "gen":
            node = ("gen", _join(node[1]))
        elif node[0] == "if":
            node = ("if", [(t, _join(b)) for t, b in node[1]], _join(node[2]))
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        else:
            out.append(node)
    return out


Piece = tuple[str, bool]


def _body(nodes: list[tuple], masked: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step(n, masked) for n in nodes]

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def _step(node: tuple, masked: bool) -> Callable[[dict], Iterable[Piece]]:
    kind = node[0]
    if kind == "text":
        piece = ((node[1], masked),)
        return lambda scope: piece
    if kind == "show":
        shown = _value(node[1])
        return lambda scope: ((_said(shown(scope)), masked),)
    if kind == "gen":
        return _body(node[1], True)
    if kind == "set":
        name, given = node[1], _value(node[2])

        def put(scope: dict) -> tuple:
            scope[name] = given(scope)
            return ()

        return put
    if kind == "if":
        tests, other = [(_value(t), _body(b, masked)) for t, b in node[1]], _body(node[2], masked)
        return lambda scope: next((b for t, b in tests if t(scope)), other)(scope)
    name, over, inner = node[1], _value(node[2]), _body(node[3], masked)

    def loop(scope: dict) -> Iterator[Piece]:
        items, index = iter(over(scope) or ()), 0
        ahead = next(items, items)  # the iterator itself stands for the end
        while ahead is not items:
            now, ahead = ahead, next(items, items)
            yield from inner({**scope, name: now, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": ahead is items}})
            index += 1

    return loop


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """A closure that yields (text, masked) pieces for given variables; lists may be iterators, which are read as rendering goes on."""
    return _body(parse(source), False)


_SEGMENT = "conv_id long, seq long, text string, spans array<struct<a:int,b:int>>"
_SEGMENT_CHARS = 1 << 18


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, dict]]:
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            yield conv, {"role": role or "", "text": text or ""}


def _renderer(source: str):
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, rows = compile_template(source), _turns(batches)
        ready: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), (pa.int64(), pa.int64(), pa.string(), kind))], names=["conv_id", "seq", "text", "spans"])
            ready.clear()
            return out

        row = next(rows, None)
        while row is not None:
            conv, first = row

            def messages() -> Iterator[dict]:
                nonlocal row
                said = first
                while True:
                    yield said
                    row = next(rows, None)
                    if row is None or row[0] != conv:
                        return
                    said = row[1]

            seq, size, parts, spans = 0, 0, [], []
            for text, masked in chain(render({"messages": messages()}), [("", False)]):
                if masked and text:
                    if spans and spans[-1]["b"] == size:
                        spans[-1]["b"] += len(text)
                    else:
                        spans.append({"a": size, "b": size + len(text)})
                parts.append(text)
                size += len(text)
                if size > _SEGMENT_CHARS:
                    ready.append((conv, seq, "".join(parts), spans))
                    seq, size, parts, spans = seq + 1, 0, [], []
                    yield flush()
            ready.append((conv, seq, "".join(parts), spans))
            if len(ready) >= 500:
                yield flush()
        if ready:
            yield flush()

    return run


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, seq, text, spans): the rendered text of every conversation as consecutive segments, with the loss mask's spans in each."""
    parse(template)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(tidy(_renderer(template)), _SEGMENT)


_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>\n"
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reader:
    """Reads the segments of one conversation back: turns from the marks, loss text from the spans."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.rest = ""

    def feed(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for x in spans:  # a span holds whole texts: segments are cut between pieces
            said = unescape(text[x["a"] : x["b"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.rest += text
        while (end := self.rest.find(_CLOSE)) >= 0:
            turn, self.rest = self.rest[:end], self.rest[end + len(_CLOSE) :]
            if not turn.startswith(_OPEN):
                raise ValueError("a turn has no start mark")
            role, _, said = turn[len(_OPEN) :].partition("\n")
            self.turns.update(f"{unescape_role(role)}\n{unescape(said)}\n".encode())
            self.n += 1

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("a turn has no end mark")
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    reader, conv, last = None, None, -1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in _DIGEST.split(", ")])

    for batch in batches:
        done = []
        for own, seq, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            if seq == 0:
                if reader is not None:
                    done.append((conv, *reader.row()))
                reader, conv = _Reader(), own
            elif reader is None or own != conv or seq != last + 1:
                raise ValueError(f"segment {seq} of conversation {own} isn't after its predecessor")
            last = seq
            reader.feed(text, spans)
        if done:
            yield batch_of(done)
    if reader is not None:
        yield batch_of([(conv, *reader.row())])


def read_back(segments: DataFrame, as_written: bool = False) -> DataFrame:
    """One row for each conversation. Segments are brought into order first, unless they come straight from the writer (as_written); out of order they raise."""
    rows = segments.select("conv_id", "seq", "text", "spans")
    if not as_written:
        rows = rows.repartition(partitions(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.mapInArrow(tidy(_digester), _DIGEST)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(added)), as_written=True)
