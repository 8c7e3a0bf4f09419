"""Prompt templates compiled to one Column.

A template is read into statements and expressions, and these become Columns with the types of the rows' schema: a loop
is a transform() of an array, a condition a when(). What can't be read, and names, filters and tests that aren't there,
raise when the template is compiled, before any row is read.

    {{ value }}   {# comment #}   {% if c %} {% elif c %} {% else %} {% endif %}   {% for x in xs %} {% else %} {% endfor %}

A `-` inside a mark drops the blanks beside it. Values, from loose to tight: `a if c else b`, `or`, `and`, `not`,
comparisons with `in`, `not in` and `is [not] defined|none|string|number|sequence`, `~`, then fields, subscripts and
filters (upper, lower, trim, length, default, join, first, last, replace). Names: row, choices, loop variables and
loop.index, index0, first, last, length. A missing or null value renders as nothing and counts as false, as do empty
texts and arrays, and 0. Texts and numbers are never equal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, NullType, NumericType, StringType, StructType

_MARK = re.compile(r"\{#.*?#\}|\{\{.*?\}\}|\{%.*?%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>~|.,()\[\]]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Value:
    column: Column
    type: DataType

    @property
    def text(self) -> Column:
        return F.coalesce(self.column.cast("string"), F.lit(""))

    @property
    def truth(self) -> Column:
        c, t = self.column, self.type
        holds = c if isinstance(t, BooleanType) else c != "" if isinstance(t, StringType) else c != 0 if isinstance(t, NumericType) else F.size(c) > 0 if isinstance(t, ArrayType) else c.isNotNull()
        return F.coalesce(holds, F.lit(False))


def _nothing() -> Value:
    return Value(F.lit(None).cast("string"), NullType())


def _is(x: Value, kind: type) -> bool:
    return isinstance(x.type, kind)


class _Reader:
    """Expressions as nested tuples, by precedence."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source.strip(), [], 0
        while at < len(self.source):
            m = _TOKEN.match(self.source, at)
            if not m:
                raise TemplateError(f"can't read {self.source!r} at {self.source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "sign") and self.tokens[self.at][1] in wanted

    def take(self, *wanted: str) -> str | None:
        if not self.peek(*wanted):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def need(self, kind: str, *wanted: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind or wanted and self.tokens[self.at][1] not in wanted:
            raise TemplateError(f"can't read {self.source!r}: {' or '.join(wanted) or kind} is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"can't read {self.source!r} from {self.tokens[self.at][1]!r} on")
        return out

    def choice(self) -> tuple:
        out = self.either()
        if self.take("if"):
            condition = self.either()
            out = ("choice", condition, out, self.choice() if self.take("else") else ("literal", None))
        return out

    def either(self) -> tuple:
        out = self.both()
        while self.take("or"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.negated()
        while self.take("and"):
            out = ("and", out, self.negated())
        return out

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        out = self.joined()
        while True:
            if sign := self.take(*_COMPARISONS):
                out = ("compare", sign, out, self.joined())
            elif self.take("is"):
                negative = self.take("not")
                out = ("test", self.need("name"), out)
                out = ("not", out) if negative else out
            elif self.take("in"):
                out = ("in", out, self.joined())
            elif self.peek("not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                out = ("not", ("in", out, self.joined()))
            else:
                return out

    def joined(self) -> tuple:
        out = self.reached()
        while self.take("~"):
            out = ("join", out, self.reached())
        return out

    def reached(self) -> tuple:
        out = self.single()
        while True:
            if self.take("."):
                out = ("field", out, self.need("name"))
            elif self.take("["):
                kind, word = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind not in ("text", "number"):
                    raise TemplateError(f"can't read {self.source!r}: a subscript is a text or a number")
                out = ("field", out, _literal(kind, word))
                self.at += 1
                self.need("sign", "]")
            elif self.take("|"):
                name, given = self.need("name"), []
                if self.take("("):
                    while not self.take(")"):
                        given.append(self.choice())
                        if not self.peek(")"):
                            self.need("sign", ",")
                out = ("filter", name, out, given)
            else:
                return out

    def single(self) -> tuple:
        if self.take("("):
            out = self.choice()
            self.need("sign", ")")
            return out
        if self.at >= len(self.tokens) or self.tokens[self.at][0] == "sign":
            raise TemplateError(f"can't read {self.source!r}: a value is missing")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind != "name":
            return ("literal", _literal(kind, word))
        if word.lower() in ("true", "false", "none"):
            return ("literal", {"true": True, "false": False, "none": None}[word.lower()])
        return ("name", word)


def _literal(kind: str, word: str) -> str | int | float:
    if kind == "number":
        return float(word) if "." in word else int(word)
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S)


def _equal(a: Value, b: Value) -> Column:
    if _is(a, NumericType) and _is(b, NumericType) or a.type == b.type and not _is(a, NullType):
        return F.coalesce(a.column == b.column, F.lit(False))
    return a.column.isNull() & b.column.isNull()


def _less(a: Value, b: Value) -> Column:
    if not (_is(a, NumericType) and _is(b, NumericType) or _is(a, StringType) and _is(b, StringType)):
        raise TemplateError("only two numbers or two texts have an order")
    return F.coalesce(a.column < b.column, F.lit(False))


_TESTS = {"defined": lambda x: x.column.isNotNull(), "none": lambda x: x.column.isNull(), "string": lambda x: x.column.isNotNull() & F.lit(_is(x, StringType)), "number": lambda x: x.column.isNotNull() & F.lit(_is(x, NumericType)), "sequence": lambda x: x.column.isNotNull() & F.lit(_is(x, ArrayType))}


def _list(x: Value, what: str) -> Value:
    if not _is(x, ArrayType):
        raise TemplateError(f"{what} needs an array")
    return x


def _filtered(name: str, x: Value, given: list[Value]) -> Value:
    least, most = {"default": (1, 1), "replace": (2, 2), "join": (0, 1)}.get(name, (0, 0))
    if not least <= len(given) <= most:
        raise TemplateError(f"{name} takes {least} to {most} values")
    text = StringType()
    if name in ("upper", "lower", "trim"):
        return Value(getattr(F, name)(x.text), text)
    if name == "replace":
        return Value(F.replace(x.text, given[0].text, given[1].text), text)
    if name == "length":
        return Value((F.size(x.column) if _is(x, ArrayType) else F.length(x.text)).cast("long"), LongType())
    if name == "default":
        if x.type == given[0].type:
            return Value(F.coalesce(x.column, given[0].column), x.type)
        return Value(F.coalesce(x.column.cast("string"), given[0].text), text)
    if name == "join":
        parts = F.transform(_list(x, name).column, lambda c: F.coalesce(c.cast("string"), F.lit("")))
        between = given[0].text if given else F.lit("")
        return Value(F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.coalesce(F.get(parts, F.lit(0)), F.lit("")), lambda s, c: F.concat(s, between, c)), text)
    if name in ("first", "last"):
        c = _list(x, name).column
        return Value(F.get(c, F.lit(0) if name == "first" else F.size(c) - 1), x.type.elementType)
    raise TemplateError(f"there is no filter {name}")


def _value(e: tuple, scope: dict[str, object]) -> Value:
    kind = e[0]
    truth = lambda c: Value(c, BooleanType())
    if kind == "literal":
        v = e[1]
        return _nothing() if v is None else Value(F.lit(v), BooleanType() if isinstance(v, bool) else StringType() if isinstance(v, str) else DoubleType() if isinstance(v, float) else LongType())
    if kind == "name":
        if e[1] not in scope:
            raise TemplateError(f"there is no {e[1]}")
        if not isinstance(scope[e[1]], Value):
            raise TemplateError(f"{e[1]} has no value of its own")
        return scope[e[1]]
    if kind == "field":
        inner = scope.get(e[1][1]) if e[1][0] == "name" else None
        if isinstance(inner, dict):  # the row, or the loop
            return inner[e[2]] if e[2] in inner else _nothing()
        x = _value(e[1], scope)
        if _is(x, ArrayType) and isinstance(e[2], int):
            return Value(F.get(x.column, F.lit(e[2])), x.type.elementType)
        if _is(x, StructType) and e[2] in x.type.names:
            return Value(x.column.getField(e[2]), x.type[e[2]].dataType)
        return _nothing()
    if kind == "filter":
        return _filtered(e[1], _value(e[2], scope), [_value(g, scope) for g in e[3]])
    if kind == "test":
        if e[1] not in _TESTS:
            raise TemplateError(f"there is no test {e[1]}")
        return truth(_TESTS[e[1]](_value(e[2], scope)))
    if kind == "not":
        return truth(~_value(e[1], scope).truth)
    if kind == "choice":
        condition, a, b = (_value(x, scope) for x in e[1:])
        return Value(F.when(condition.truth, a.column).otherwise(b.column), a.type) if a.type == b.type else Value(F.when(condition.truth, a.text).otherwise(b.text), StringType())
    if kind == "compare":
        sign, a, b = e[1], _value(e[2], scope), _value(e[3], scope)
        return truth({"==": lambda: _equal(a, b), "!=": lambda: ~_equal(a, b), "<": lambda: _less(a, b), ">": lambda: _less(b, a), "<=": lambda: _less(a, b) | _equal(a, b), ">=": lambda: _less(b, a) | _equal(a, b)}[sign]())
    a, b = _value(e[1], scope), _value(e[2], scope)
    if kind in ("and", "or"):
        return truth(a.truth & b.truth if kind == "and" else a.truth | b.truth)
    if kind == "join":
        return Value(F.concat(a.text, b.text), StringType())
    if _is(b, ArrayType):
        return truth(F.coalesce(F.exists(b.column, lambda c: _equal(a, Value(c, b.type.elementType))), F.lit(False)))
    return truth(F.coalesce(F.contains(b.text, a.column.cast("string")), F.lit(False)))


def _parts(template: str) -> list[str]:
    """Texts and marks in turn; blanks beside a mark with `-` are dropped."""
    parts, at = [], 0
    for m in _MARK.finditer(template):
        parts += [template[at : m.start()], m[0]]
        at = m.end()
    parts.append(template[at:])
    for i in range(0, len(parts), 2):
        if any(x in parts[i] for x in ("{{", "{%", "{#", "}}", "%}")):
            raise TemplateError("a mark is not closed")
        if i and parts[i - 1][-3] == "-":
            parts[i] = parts[i].lstrip()
        if i + 1 < len(parts) and parts[i + 1][2] == "-":
            parts[i] = parts[i].rstrip()
    return parts


def _statements(parts: list[str], at: int, until: tuple[str, ...]) -> tuple[list[tuple], int, str]:
    """Statements up to a mark whose word is in `until`: (statements, the place after it, its text)."""
    out: list[tuple] = []
    while at < len(parts):
        part = parts[at]
        at += 1
        if at % 2:
            out += [("text", part)] if part else []
        elif part.startswith("{{"):
            out.append(("show", _Reader(part[2:-2].strip("-")).whole()))
        elif part.startswith("{%"):
            said = part[2:-2].strip("-").strip()
            word, _, rest = said.partition(" ")
            if word in until:
                return out, at, said
            if word == "if":
                cases, other, said = [], [], rest
                while True:
                    body, at, mark = _statements(parts, at, ("elif", "else", "endif"))
                    cases.append((_Reader(said).whole(), body))
                    if not mark.startswith("elif"):
                        break
                    said = mark.partition(" ")[2]
                if mark == "else":
                    other, at, _ = _statements(parts, at, ("endif",))
                out.append(("if", cases, other))
            elif m := re.match(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)$", said, re.S):
                body, at, mark = _statements(parts, at, ("else", "endfor"))
                other = []
                if mark == "else":
                    other, at, _ = _statements(parts, at, ("endfor",))
                out.append(("for", m[1], _Reader(m[2]).whole(), body, other))
            else:
                raise TemplateError(f"{part} is not supported")
    if until:
        raise TemplateError(f"{' or '.join(until)} is missing")
    return out, at, ""


def _rendered(statements: list[tuple], scope: dict[str, object]) -> Column:
    out = [F.lit("")]
    for s in statements:
        if s[0] == "text":
            out.append(F.lit(s[1]))
        elif s[0] == "show":
            out.append(_value(s[1], scope).text)
        elif s[0] == "if":
            told = _rendered(s[2], scope)
            for condition, body in reversed(s[1]):
                told = F.when(_value(condition, scope).truth, _rendered(body, scope)).otherwise(told)
            out.append(told)
        else:
            out.append(_looped(s, scope))
    return F.concat(*out)


def _looped(s: tuple, scope: dict[str, object]) -> Column:
    _, name, source, body, other = s
    items = _value(source, scope)
    if _is(items, NullType):
        return _rendered(other, scope)
    size = F.size(_list(items, "a loop").column)

    def one(item: Column, index: Column) -> Column:
        number = lambda c: Value(c.cast("long"), LongType())
        loop = {"index": number(index + 1), "index0": number(index), "first": Value(index == 0, BooleanType()), "last": Value(index == size - 1, BooleanType()), "length": number(size)}
        return _rendered(body, scope | {name: Value(item, items.type.elementType), "loop": loop})

    told = F.array_join(F.transform(items.column, one), "")
    return F.when(items.truth, told).otherwise(_rendered(other, scope))


def compiled(template: str, schema: StructType, choices: str | None = None) -> Column:
    """The prompt as a Column over rows of a schema; `choices` names their array of label and text."""
    scope: dict[str, object] = {"row": {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields}}
    if choices is not None:
        scope["choices"] = scope["row"][choices]
    return _rendered(_statements(_parts(template), 0, ())[0], scope)


def render(rows: DataFrame, template: str, choices: str | None = None, name: str = "prompt") -> DataFrame:
    return rows.withColumn(name, compiled(template, rows.schema, choices))


def biomedical_prompt(question: Column, context: Column) -> Column:
    """The built-in prompt of the yes/no/maybe evaluation, in our own words."""
    return F.concat(F.lit("Read the context and answer the biomedical question with one word: yes, no or maybe.\n\nQuestion: "), question, F.lit("\n\nContext: "), context, F.lit("\n\nAnswer (yes, no or maybe):"))
