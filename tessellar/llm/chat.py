"""Chat formatting by a compiled template.

The template language (a small, sandboxed subset of the usual one)::

    {{ expression }}   {% if e %}..{% elif e %}..{% else %}..{% endif %}   {% for name in e %}..{% endfor %}
    {% set name = e %} {% generation %}..{% endgeneration %}   {# comment #}   {%- and -%} trim blanks

Expressions: strings, integers, true/false/none, names, ``a.b``, ``a['b']``, ``+ - * ~ % == != < <= > >= in not and or``,
``is defined``, and the filters ``trim``, ``upper``, ``lower``, ``length``, ``escape``. There are no calls, no attribute
of a Python object can be reached (``.`` and ``[]`` only look up keys of mappings, lists and loop variables), and loops
only run over given lists, so that a template always ends.

``compile_template`` parses to a syntax tree of tuples, folds constants (and joins neighbouring literal text), then
generates nested Python closures. Text written inside ``{% generation %}`` is under the loss mask: rendering returns
pieces with a flag.

Control strings inside texts are escaped so that they can't be read as marks: every control string gets a ``\\`` after
its first character, and so does every one that already has backslashes there (one more). ``unescape`` takes one away. Formatted
text therefore parses back to exactly the turns it came from.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import n_parts, table, text_or_empty, tune

# ---------------------------------------------------------------- parsing

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*~%<>|.\[\]()]))""", re.S)
_ESC = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


def _tokens(src: str) -> list[tuple[str, str]]:
    out, at = [], 0
    src = src.rstrip()
    while at < len(src):
        m = _TOKEN.match(src, at)
        if not m:
            raise TemplateError(f"unreadable: {src[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expr:
    """Recursive descent over the tokens of one expression; gives tuples (kind, ...)."""

    BINARY = ({"or"}, {"and"}, {"==", "!=", "<", "<=", ">", ">=", "in"}, {"+", "-", "~"}, {"*", "%"})

    def __init__(self, tokens):
        self.t, self.at = tokens, 0

    def peek(self):
        return self.t[self.at] if self.at < len(self.t) else ("end", "")

    def take(self, value=None):
        kind, got = self.peek()
        if value is not None and (got != value or kind == "str"):
            raise TemplateError(f"expected {value!r}, got {got!r}")
        self.at += 1
        return kind, got

    def whole(self):
        out = self.binary(0)
        if self.at != len(self.t):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def binary(self, level):
        if level == 2 and self.peek() == ("name", "not"):
            self.take()
            return ("not", self.binary(2))
        if level == len(self.BINARY):
            return self.unary()
        left = self.binary(level + 1)
        while True:
            kind, op = self.peek()
            if kind in ("op", "name") and op in self.BINARY[level]:
                self.take()
                left = ("bin", op, left, self.binary(level + 1))
            elif level == 2 and (kind, op) == ("name", "not") and self.t[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                left = ("not", ("bin", "in", left, self.binary(level + 1)))
            elif level == 2 and (kind, op) == ("name", "is"):
                self.take()
                negated = self.peek() == ("name", "not") and bool(self.take())
                self.take("defined")
                left = ("not", ("defined", left)) if negated else ("defined", left)
            else:
                return left

    def unary(self):
        if self.peek() == ("op", "-"):
            self.take()
            return ("bin", "-", ("const", 0), self.unary())
        kind, got = self.take()
        if kind == "num":
            out = ("const", int(got))
        elif kind == "str":
            out = ("const", re.sub(r"\\(.)", lambda m: _ESC.get(m[1], m[1]), got[1:-1], flags=re.S))
        elif kind == "name":
            known = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            out = ("const", known[got]) if got in known else ("name", got)
        elif got == "(":
            out = self.binary(0)
            self.take(")")
        else:
            raise TemplateError(f"unexpected {got!r}")
        while self.peek() in (("op", "."), ("op", "["), ("op", "|")):
            op = self.take()[1]
            if op == "[":
                out = ("item", out, self.binary(0))
                self.take("]")
                continue
            kind, name = self.take()
            if kind != "name":
                raise TemplateError(f"a name has to follow {op!r}")
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = ("item", out, ("const", name)) if op == "." else ("filter", name, out)
        return out


def parse(source: str):
    """The syntax tree: a list of ("text", s), ("out", e), ("if", [(e, body)...]), ("for", name, e, body), ("set", name, e), ("gen", body)."""
    stack, at, trim = [("root", None, [])], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        left, body, right = next((m[i], m[i + 1], m[i + 2]) for i in (1, 4, 7) if m[i + 1] is not None)
        text = text.lstrip() if trim else text
        text = text.rstrip() if left else text
        at, trim = m.end(), bool(right)
        if text:
            stack[-1][2].append(("text", text))
        if m[8] is not None:
            continue
        if m[2] is not None:
            stack[-1][2].append(("out", _Expr(_tokens(body)).whole()))
            continue
        assign = re.match(r"\s*set\s+([A-Za-z_]\w*)\s*=(?!=)(.*)$", body, re.S)
        if assign:
            stack[-1][2].append(("set", assign[1], _Expr(_tokens(assign[2])).whole()))
            continue
        tokens = _tokens(body)
        word, rest = (tokens[0][1] if tokens else ""), tokens[1:]
        if word == "if":
            stack.append(("if", [(_Expr(rest).whole(), inner := [])], inner))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            inner = []
            stack[-1][1].append((_Expr(rest).whole() if word == "elif" else ("const", True), inner))
            stack[-1] = ("if", stack[-1][1], inner)
        elif word == "for" and len(rest) > 2 and rest[0][0] == "name" and rest[1] == ("name", "in"):
            stack.append(("for", (rest[0][1], _Expr(rest[2:]).whole()), []))
        elif word == "generation" and not rest:
            stack.append(("generation", None, []))
        elif word.startswith("end") and not rest and stack[-1][0] == word[3:]:
            kind, head, inner = stack.pop()
            node = {"if": lambda: ("if", head), "for": lambda: ("for", *head, inner), "generation": lambda: ("gen", inner)}[kind]()
            stack[-1][2].append(node)
        else:
            raise TemplateError(f"unreadable: {body!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    text = source[at:].lstrip() if trim else source[at:]
    return stack[0][2] + ([("text", text)] if text else [])


# ---------------------------------------------------------------- meaning of expressions

_MISSING = object()


def _get(x, k):
    if isinstance(x, dict):
        return x.get(k, _MISSING)
    if isinstance(x, (list, str)) and type(k) is int:
        return x[k] if -len(x) <= k < len(x) else _MISSING
    return _MISSING


def _show(x) -> str:
    return "" if x is None or x is _MISSING else x if isinstance(x, str) else str(x)


def _truth(x) -> bool:
    return x is not _MISSING and bool(x)


_OPS = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: _times(a, b), "~": lambda a, b: _show(a) + _show(b), "%": lambda a, b: _rest(a, b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}


def _times(a, b):
    if type(a) is not int or type(b) is not int:
        raise TemplateError("* takes integers")
    return a * b


def _rest(a, b):
    if type(a) is not int or type(b) is not int:
        raise TemplateError("% takes integers")
    return a % b


FILTERS = {
    "trim": lambda x: _show(x).strip(), "upper": lambda x: _show(x).upper(), "lower": lambda x: _show(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, dict)) else 0, "escape": lambda x: escape(_show(x)),
}


# ---------------------------------------------------------------- folding


def _fold_expr(e):
    if e[0] in ("const", "name"):
        return e
    e = tuple(_fold_expr(x) if isinstance(x, tuple) else x for x in e)
    parts = [x for x in e[1:] if isinstance(x, tuple)]
    if e[0] != "defined" and all(p[0] == "const" for p in parts):
        try:
            return ("const", _closure(e)({}))
        except Exception:  # noqa: BLE001  left as it is: the error belongs to rendering, if that branch is ever taken
            return e
    if e[0] == "bin" and e[1] in ("and", "or") and e[2][0] == "const":
        return e[3] if _truth(e[2][1]) == (e[1] == "and") else e[2]
    return e


def fold(body):
    """The tree with constant expressions evaluated, dead branches dropped and neighbouring text joined."""
    out = []
    for n in body:
        if n[0] == "out":
            e = _fold_expr(n[1])
            new = [("text", _show(e[1]))] if e[0] == "const" else [("out", e)]
        elif n[0] == "if":
            arms, new = [], None
            for cond, inner in n[1]:
                cond = _fold_expr(cond)
                if cond[0] == "const" and not _truth(cond[1]):
                    continue
                arms.append((cond, fold(inner)))
                if cond[0] == "const":
                    break
            new = arms[0][1] if arms and arms[0][0][0] == "const" else [("if", arms)] if arms else []
        elif n[0] == "for":
            new = [("for", n[1], _fold_expr(n[2]), fold(n[3]))]
        elif n[0] == "set":
            new = [("set", n[1], _fold_expr(n[2]))]
        elif n[0] == "gen":
            new = [("gen", fold(n[1]))]
        else:
            new = [n]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


# ---------------------------------------------------------------- closures


def _closure(e):
    kind = e[0]
    if kind == "const":
        value = e[1]
        return lambda env: value
    if kind == "name":
        name = e[1]
        return lambda env: env.get(name, _MISSING)
    if kind == "not":
        inner = _closure(e[1])
        return lambda env: not _truth(inner(env))
    if kind == "defined":
        inner = _closure(e[1])
        return lambda env: inner(env) is not _MISSING
    if kind == "item":
        a, k = _closure(e[1]), _closure(e[2])
        return lambda env: _get(a(env), k(env))
    if kind == "filter":
        f, a = FILTERS[e[1]], _closure(e[2])
        return lambda env: f(a(env))
    _, op, left, right = e
    a, b = _closure(left), _closure(right)
    if op == "and":
        return lambda env: b(env) if _truth(x := a(env)) else x
    if op == "or":
        return lambda env: x if _truth(x := a(env)) else b(env)
    f = _OPS[op]
    return lambda env: f(a(env), b(env))


def _body(nodes):
    steps = [_step(n) for n in nodes]

    def run(env, put, gen):
        for s in steps:
            s(env, put, gen)

    return run


def _step(n):
    kind = n[0]
    if kind == "text":
        text = n[1]
        return lambda env, put, gen: put(text, gen)
    if kind == "out":
        e = _closure(n[1])
        return lambda env, put, gen: put(_show(e(env)), gen)
    if kind == "set":
        name, e = n[1], _closure(n[2])

        def assign(env, put, gen):
            env[name] = e(env)

        return assign
    if kind == "gen":
        inner = _body(n[1])
        return lambda env, put, gen: inner(env, put, True)
    if kind == "if":
        arms = [(_closure(c), _body(b)) for c, b in n[1]]

        def choose(env, put, gen):
            for c, b in arms:
                if _truth(c(env)):
                    return b(env, put, gen)

        return choose
    _, name, e, inner = n
    items, inner = _closure(e), _body(inner)

    def loop(env, put, gen):
        got = items(env)
        got = got if isinstance(got, list) else []
        own = dict(env)
        for i, x in enumerate(got):
            own[name], own["loop"] = x, {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(got) - 1, "length": len(got)}
            inner(own, put, gen)

    return loop


def _checked(f):
    try:
        return f()
    except RecursionError:
        raise TemplateError("nested too deeply") from None
    except (ArithmeticError, TypeError, OverflowError, MemoryError) as e:
        raise TemplateError(str(e)) from e


def compile_template(source: str):
    """A function (**variables) -> [(text, under the loss mask)]. Whatever is wrong with a template, when it is read or when it is rendered, is a TemplateError."""
    run = _checked(lambda: _body(fold(parse(source))))

    def render(**variables):
        out = []
        _checked(lambda: run(dict(variables), lambda s, g: out.append((s, g)) if s else None, False))
        return out

    return render


# ---------------------------------------------------------------- this module's chat format

#: The marks of the default template, all escaped inside texts.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN]", "[/TURN]")
_ESCAPE = re.compile("|".join(re.escape(c[0]) + r"(?=\\*" + re.escape(c[1:]) + ")" for c in CONTROL))
_UNESCAPE = re.compile("|".join(re.escape(c[0]) + r"\\(?=\\*" + re.escape(c[1:]) + ")" for c in CONTROL))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][:-1], text)


#: One turn; a conversation is its turns in a row. Roles other than these three are written in a mark of their own.
TURN_TEMPLATE = (
    "{%- if turn.first %}<s>{% endif -%}"
    "{%- if turn.role == 'user' -%}[INST]{{ turn.text | escape }}[/INST]"
    "{%- elif turn.role == 'assistant' -%}{% generation %}{{ turn.text | escape }}{% endgeneration %}</s>"
    "{%- elif turn.role == 'system' -%}[SYS]{{ turn.text | escape }}[/SYS]"
    "{%- else -%}[TURN]{{ turn.role | escape }}[/TURN]{{ turn.text | escape }}[/TURN]{%- endif -%}"
)
_READ = re.compile(r"\[INST\](.*?)\[/INST\]|\[SYS\](.*?)\[/SYS\]|\[TURN\](.*?)\[/TURN\](.*?)\[/TURN\]|(.*?)</s>", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, or of a stretch of it that begins and ends between turns."""
    at, out = 3 if formatted.startswith("<s>") else 0, []
    while at < len(formatted):
        m = _READ.match(formatted, at)
        if not m:
            raise ValueError("not a conversation of this format")
        role, text = ("user", m[1]) if m[1] is not None else ("system", m[2]) if m[2] is not None else (unescape(m[3]), m[4]) if m[3] is not None else ("assistant", m[5])
        out.append((role, unescape(text)))
        at = m.end()
    return out


def format_turns(rows: DataFrame, template: str = TURN_TEMPLATE) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) formatted: conv_id, turn, formatted, loss_spans (array of struct<begin, end>,
    code points within the row's formatted text), first.

    A conversation's formatted text is that of its rows in order of turn (ties: role, text; null turns first); a null
    text is empty, a null role the empty role; null conv_ids are one conversation. Rendering goes turn by turn in sorted partitions, so that a
    conversation of any length needs one turn's memory.
    """
    tune(rows.sparkSession)

    def run(batches):
        render, last = compile_template(template), ()
        for b in batches:
            conv, turn, role, text = (c.to_pylist() for c in b.columns)
            out, spans, firsts = [], [], []
            for c, r, t in zip(conv, role, text, strict=True):
                first = (c,) != last
                last = (c,)
                at, own, s = 0, [], []
                for piece, masked in render(turn={"first": first, "role": r, "text": t}):
                    if masked:
                        own.append({"begin": at, "end": at + len(piece)})
                    at += len(piece)
                    s.append(piece)
                out.append("".join(s))
                spans.append(own)
                firsts.append(first)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(firsts, pa.bool_())], ["conv_id", "turn", "formatted", "loss_spans", "first"])

    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text_or_empty().alias("text"))
    rows = rows.repartition(n_parts(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, "conv_id bigint, turn bigint, formatted string, loss_spans array<struct<begin:int,end:int>>, first boolean")


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read back from :func:`format_turns`'s rows (in their order): see the query.

    Hashes run along the rows of a conversation, which the formatter leaves together and in order."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches):
        key, state = None, None

        def row():
            conv, n, turns, chars, loss, total = state
            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total}

        names = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for b in batches:
            out = []
            for conv, _, text, spans, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if first or state is None or key != (conv,):
                    if state:
                        out.append(row())
                    key, state = (conv,), [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    plain = unescape(text[s["begin"] : s["end"]])
                    state[3] += len(plain)
                    state[4].update(plain.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, names)
        if state:
            yield pa.RecordBatch.from_pylist([row()], names)

    return formatted.mapInArrow(run, schema)


def op9_chat_template(spark, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation of ``conversations`` and of conversation -7, whose texts hold control strings; read back from
    the formatted text.

    A null text is empty, a null role the empty role, null turns come first; repeated rows are turns of their own; rows with a null conv_id are one conversation; an
    empty table leaves conversation -7 alone; other columns are ignored."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return digests(format_turns(rows))
