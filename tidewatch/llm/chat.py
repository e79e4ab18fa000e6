"""Chat formatting by a template compiler.

A template of a sandboxed language is parsed into a syntax tree, its constant parts are folded, and closures are made of it that render a
conversation turn by turn, so that a conversation of any length streams. The language has text, ``{{ value }}``, ``{% if %}``,
``{% elif %}``, ``{% else %}``, ``{% for message in messages %}``, ``{% generation %}`` (marks what is learned) and their ends; values
are strings, ``message.role``, ``message.content``, ``loop.first``, ``loop.last``, the filters ``escape`` and ``trim``, ``+``,
``==``, ``!=``, ``not``, ``and``, ``or`` and brackets. There are no calls, no other names and no attributes, so that a template can only
read what it is given.

``escape`` makes every control string of a text harmless and can be taken back: a backslash becomes ``\\\\``, ``<`` becomes
``\\l``, ``[`` becomes ``\\b``, so that none of the characters by which control strings begin is left.

Null texts and roles are empty. Turns are ordered by turn (null first), then role and text; repeated rows are turns each. Rows without conv_id
are one conversation. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TEMPLATE = (
    "{% for message in messages %}<|{{ message.role | escape }}|>\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content | escape }}{% endgeneration %}"
    "{% else %}{{ message.content | escape }}{% endif %}<|end|>\n{% endfor %}"
)
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_BACK = {v[1]: k for k, v in ESCAPES.items()}
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_][A-Za-z_0-9.]*)|(==|!=|[|+()]))")
NAMES = ("message.role", "message.content", "loop.first", "loop.last")
#: Characters of formatted text in a row of ``formatted``, at least, unless the conversation ends.
PART = 1 << 16


def escape(text: str) -> str:
    return text.translate(_ESCAPING)


_ESCAPING = str.maketrans(ESCAPES)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip}


class TemplateError(ValueError):
    pass


def expression(source: str) -> tuple:
    """Syntax tree of an expression: ('const', x), ('name', x), ('filter', name, e), ('+', e, e), ..."""
    tokens, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        tokens.append(("const", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[1][1:-1])) if m[1] else ("name", m[2]) if m[2] else ("op", m[3]))
        at = m.end()
    place = [0]

    def take(*wanted: str) -> str | None:
        if place[0] < len(tokens) and tokens[place[0]][1] in wanted and tokens[place[0]][0] != "const":
            place[0] += 1
            return tokens[place[0] - 1][1]
        return None

    def chain(below: Callable, *ops: str) -> tuple:
        left = below()
        while op := take(*ops):
            left = (op, left, below())
        return left

    def atom() -> tuple:
        if take("("):
            inner = chain(both, "or")
            if not take(")"):
                raise TemplateError("a bracket is open")
        elif place[0] < len(tokens) and tokens[place[0]][0] != "op":
            kind, x = tokens[place[0]]
            place[0] += 1
            if kind == "name" and x not in NAMES:
                if x not in ("true", "false"):
                    raise TemplateError(f"unknown name {x}")
                kind, x = "const", x == "true"
            inner = (kind, x)
        else:
            raise TemplateError(f"a value is missing in {source!r}")
        while take("|"):
            kind, x = tokens[place[0]] if place[0] < len(tokens) else ("", "")
            if kind != "name" or x not in FILTERS:
                raise TemplateError(f"unknown filter {x}")
            place[0] += 1
            inner = ("filter", x, inner)
        return inner

    def negated() -> tuple:
        return ("not", negated()) if take("not") else chain(lambda: chain(atom, "+"), "==", "!=")

    def both() -> tuple:
        return chain(negated, "and")

    tree = chain(both, "or")
    if place[0] < len(tokens):
        raise TemplateError(f"{tokens[place[0]][1]!r} is one too many in {source!r}")
    return folded(tree)


_OPS: dict[str, Callable] = {
    "+": lambda a, b: str(a) + str(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


def folded(tree: tuple) -> tuple:
    """The tree with its constant parts computed."""
    kind, *rest = tree
    if kind in ("const", "name"):
        return tree
    below = [folded(x) if isinstance(x, tuple) else x for x in rest]
    if all(x[0] == "const" for x in below if isinstance(x, tuple)):
        return ("const", value((kind, *below))({}))
    return (kind, *below)


def value(tree: tuple) -> Callable[[dict], object]:
    """Closure that computes an expression from the names' values."""
    kind, *rest = tree
    if kind == "const":
        return lambda names, x=rest[0]: x
    if kind == "name":
        return lambda names, x=rest[0]: names[x]
    if kind == "filter":
        inner, f = value(rest[1]), FILTERS[rest[0]]
        return lambda names: f(str(inner(names)))
    if kind == "not":
        inner = value(rest[0])
        return lambda names: not inner(names)
    left, right, op = value(rest[0]), value(rest[1]), _OPS[kind]
    if kind in ("and", "or"):
        return (lambda names: left(names) and right(names)) if kind == "and" else (lambda names: left(names) or right(names))
    return lambda names: op(left(names), right(names))


def parse(template: str) -> list[tuple]:
    """Syntax tree of a template: ('text', s), ('value', e), ('if', [(e, body), ...]), ('for', body), ('generation', body)."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.DOTALL)
    at = [0]

    def body(*ends: str) -> tuple[list[tuple], str]:
        out: list[tuple] = []
        while at[0] < len(parts):
            part = parts[at[0]]
            at[0] += 1
            if part.startswith("{{"):
                tree = expression(part[2:-2])
                out.append(("text", str(tree[1])) if tree[0] == "const" else ("value", tree))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return out, f"{word} {rest}"
                out.extend(statement(word, rest.strip()))
            elif part:
                out.append(("text", part))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    def statement(word: str, rest: str) -> list[tuple]:
        if word == "for":
            if rest.split() != ["message", "in", "messages"]:
                raise TemplateError("only messages can be looped over")
            return [("for", body("endfor")[0])]
        if word == "generation":
            return [("generation", body("endgeneration")[0])]
        if word != "if":
            raise TemplateError(f"unknown statement {word}")
        cases, last = [], f"if {rest}"
        while not last.startswith("endif"):
            word, _, test = last.partition(" ")
            inner, last = body(*(("endif",) if word == "else" else ("elif", "else", "endif")))
            cases.append((("const", True) if word == "else" else expression(test), inner))
        live = [c for c in cases if c[0] != ("const", False)]
        if live and live[0][0][0] == "const" and live[0][0][1]:
            return live[0][1]
        return [("if", live)] if live else []

    return joined(body()[0])


def joined(nodes: list[tuple]) -> list[tuple]:
    """Neighbouring texts made one, at every depth."""
    out: list[tuple] = []
    for kind, x in nodes:
        if kind == "if":
            x = [(e, joined(b)) for e, b in x]
        elif kind in ("for", "generation"):
            x = joined(x)
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + x)
        else:
            out.append((kind, x))
    return out


Pieces = Iterator[tuple[str, bool]]


def block(nodes: list[tuple]) -> Callable[[dict, bool], Pieces]:
    """Closure that yields the text of nodes, each piece with whether it is to be learned."""
    steps = [_step(*n) for n in nodes]

    def run(names: dict, learned: bool) -> Pieces:
        for step in steps:
            yield from step(names, learned)

    return run


def _step(kind: str, x) -> Callable[[dict, bool], Pieces]:
    if kind == "text":
        return lambda names, learned: iter(((x, learned),))
    if kind == "value":
        get = value(x)
        return lambda names, learned: iter(((str(get(names)), learned),))
    if kind == "generation":
        inner = block(x)
        return lambda names, learned: inner(names, True)
    if kind == "if":
        cases = [(value(e), block(b)) for e, b in x]

        def choose(names: dict, learned: bool) -> Pieces:
            for test, inner in cases:
                if test(names):
                    yield from inner(names, learned)
                    return

        return choose
    inner = block(x)

    def loop(names: dict, learned: bool) -> Pieces:
        first, held = True, None
        for message in names["messages"]:
            if held is not None:
                yield from inner(names | held | {"loop.first": first, "loop.last": False}, learned)
                first = False
            held = message
        if held is not None:
            yield from inner(names | held | {"loop.first": first, "loop.last": True}, learned)

    return loop


@lru_cache(16)
def compiled(template: str) -> Callable[[Iterable[dict]], Pieces]:
    """Function from messages ({'message.role': ..., 'message.content': ...}) to pieces of formatted text."""
    run = block(parse(template))
    outside = {n: "" for n in NAMES}
    return lambda messages: run(outside | {"messages": messages}, False)


def dealt(conversations: DataFrame) -> DataFrame:
    """The turns in order, each conversation in one partition."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").drop("turn")


def rows(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, part (from 0), formatted (the part's text), learned (code point spans in it as start, end, start, end, ...)."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        out, held = [], 0
        for conv_id, turns in groupby(rows(batches, ["conv_id", "role", "text"]), key=lambda r: r[0]):
            part = 0
            for text, spans in _parts(render({"message.role": r, "message.content": t} for _, r, t in turns)):
                out.append((conv_id, part, text, spans))
                part, held = part + 1, held + len(text)
                if held > 1 << 22:
                    yield _batch(out, kinds)
                    out, held = [], 0
        yield _batch(out, kinds)

    return dealt(conversations).mapInArrow(run, "conv_id long, part long, formatted string, learned array<long>")


def _batch(out: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["conv_id", "part", "formatted", "learned"])


def _parts(found: Pieces) -> Iterator[tuple[str, list[int]]]:
    """Formatted text with the spans to learn, in parts."""
    texts, spans, size = [], [], 0
    for text, learned in found:
        if not text:
            continue
        if size >= PART:
            yield "".join(texts), spans
            texts, spans, size = [], [], 0
        if learned:
            if spans and spans[-1] == size:
                spans[-1] += len(text)
            else:
                spans += [size, size + len(text)]
        texts.append(text)
        size += len(text)
    yield "".join(texts), spans


_TURN = re.compile(r"<\|((?:[^<\\]|\\.)*?)\|>\n((?:[^<\\]|\\.)*)<\|end\|>\n", re.DOTALL)


def read_back(parts: DataFrame) -> DataFrame:
    """What the formatted conversations of ``TEMPLATE`` say: turns, what is learned, and their digests.

    Works on a stream of parts in order; of a conversation only the turn that isn't complete yet is held.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, own in groupby(rows(batches, ["conv_id", "formatted", "learned"]), key=lambda r: r[0]):
            n, loss, size, rest = 0, 0, 0, ""
            turns, learned = hashlib.sha256(), hashlib.sha256()
            for _, text, spans in own:
                size += len(text)
                for a, b in zip(spans[::2], spans[1::2]):
                    plain = unescape(text[a:b])
                    loss += len(plain)
                    learned.update(plain.encode("utf-8"))
                rest += text
                at = 0
                for m in iter(lambda: _TURN.match(rest, at), None):
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    n, at = n + 1, m.end()
                rest = rest[at:]
            assert not rest, "formatted text that isn't a turn"
            out.append((conv_id, n, turns.hexdigest(), loss, learned.hexdigest(), size))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "formatted", "learned")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
