"""Chat templates compiled to one Column expression.

A template is the language of chat templates: text, ``{{ value }}``, ``{% if %}`` with
``elif`` and ``else``, ``{% for m in messages %}`` over an array column, ``{% set %}``,
comments, and ``-`` to strip white space. Like in a model's tokenizer, the first newline
after a block is dropped, so is the white space before a block at the start of a line, and
a single newline at the template's end. ``{language}`` stands for the variable ``language``,
in text and inside quoted strings.

The template is read once, on the driver; rows are rendered by Spark expressions: ``for``
is ``transform`` over the array, ``if`` is ``when``, ``set`` gives a column a name. A name
set inside a loop is gone after it; one set inside ``if`` holds its branch's value.

Values know their type from the table's schema. Null and unknown names are empty and false.
Values: names, ``a.b``, ``a['b']``, ``a[0]``, ``a[1:]``, strings, numbers, ``true``, ``false``,
``none``; ``== != < <= > >= in and or not + % -``, ``x if c else y``, ``is [not] defined``,
``is [not] none``; ``loop.index, index0, first, last, length``; the filters ``trim, upper,
lower, length, first, last, default(x), join(x)``; ``.strip() .upper() .lower() .startswith(x)
.endswith(x)`` and ``raise_exception(x)``. Anything else raises ValueError at once.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.functions.text import strip_ws

_TOKEN = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_STRING, _BOOL, _INT = T.StringType(), T.BooleanType(), T.LongType()


class Value:
    """A column and its type; ``kind`` None is an unknown name."""

    def __init__(self, col: Column | None, kind: T.DataType | None):
        self.col, self.kind = col, kind

    def text(self) -> Column:
        if self.kind is None:
            return F.lit("")
        if isinstance(self.kind, T.BooleanType):
            return F.when(self.col, "True").when(~self.col, "False").otherwise("")
        if isinstance(self.kind, (T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.to_json(self.col), F.lit(""))
        return F.coalesce(self.col.cast("string"), F.lit(""))

    def true(self) -> Column:
        if self.kind is None:
            return F.lit(False)
        if isinstance(self.kind, T.BooleanType):
            return F.coalesce(self.col, F.lit(False))
        if isinstance(self.kind, T.StringType):
            return F.coalesce(F.length(self.col) > 0, F.lit(False))
        if isinstance(self.kind, T.ArrayType):
            return F.coalesce(F.size(self.col) > 0, F.lit(False))
        if isinstance(self.kind, T.NumericType):
            return F.coalesce(self.col != 0, F.lit(False))
        return self.col.isNotNull()


def _string(col: Column) -> Value:
    return Value(col, _STRING)


# ---- values --------------------------------------------------------------------------


class _Values(ast.NodeVisitor):
    """Compiles a value of the template; ``names`` are the known ones."""

    def __init__(self, names: dict[str, Value], source: str):
        self.names, self.source = names, source

    def generic_visit(self, node):
        raise ValueError(f"not supported in a template: {ast.get_source_segment(self.source, node) or self.source!r}")

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_Constant(self, node):
        v = node.value
        if isinstance(v, str):
            parts = v.split("{language}")
            out = [F.lit(parts[0])]
            for p in parts[1:]:
                out += [self.names.get("language", Value(None, None)).text(), F.lit(p)]
            return _string(F.concat(*out) if len(out) > 1 else out[0])
        if v is None:
            return Value(None, None)
        return Value(F.lit(v), _BOOL if isinstance(v, bool) else _INT if isinstance(v, int) else T.DoubleType())

    def visit_Name(self, node):
        fixed = {"true": True, "false": False, "none": None}
        if node.id in fixed:
            return self.visit_Constant(ast.Constant(fixed[node.id]))
        return self.names.get(node.id, Value(None, None))

    def _field(self, of: Value, name: str) -> Value:
        if isinstance(of.kind, dict):  # ``loop``
            return of.kind.get(name, Value(None, None))
        if isinstance(of.kind, T.StructType) and name in of.kind.names:
            return Value(of.col.getField(name), of.kind[name].dataType)
        if isinstance(of.kind, T.MapType):
            return Value(F.try_element_at(of.col, F.lit(name)), of.kind.valueType)
        return Value(None, None)

    def visit_Attribute(self, node):
        return self._field(self.visit(node.value), node.attr)

    def visit_Subscript(self, node):
        of, at = self.visit(node.value), node.slice
        if isinstance(at, ast.Constant) and isinstance(at.value, str):
            return self._field(of, at.value)
        if not isinstance(of.kind, T.ArrayType):
            return self.generic_visit(node)
        if isinstance(at, ast.Slice):
            if at.step or at.upper or not isinstance(at.lower, ast.Constant) or at.lower.value < 0:
                return self.generic_visit(node)
            n = at.lower.value
            return Value(F.slice(of.col, n + 1, F.greatest(F.size(of.col) - n, F.lit(0))), of.kind)
        negative = isinstance(at, ast.UnaryOp) and isinstance(at.op, ast.USub) and isinstance(at.operand, ast.Constant)
        i = F.size(of.col) - at.operand.value if negative else self.visit(at).col.cast("int")
        return Value(F.get(of.col, i), of.kind.elementType)

    def visit_BoolOp(self, node):
        """The value that decides, as a truth value."""
        parts = [self.visit(v).true() for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return Value(out, _BOOL)

    def visit_UnaryOp(self, node):
        if isinstance(node.op, ast.Not):
            return Value(~self.visit(node.operand).true(), _BOOL)
        v = self.visit(node.operand)
        return Value(-v.col, v.kind) if isinstance(node.op, ast.USub) else self.generic_visit(node)

    def visit_IfExp(self, node):
        return _either(self.visit(node.test).true(), self.visit(node.body), self.visit(node.orelse))

    def visit_Compare(self, node):
        if len(node.ops) != 1:
            return self.generic_visit(node)
        op, right = node.ops[0], node.comparators[0]
        left = self.visit(node.left)
        if isinstance(op, (ast.Is, ast.IsNot)) and isinstance(right, ast.Name) and right.id in ("defined", "none"):
            known = F.lit(False) if left.kind is None else F.lit(True) if isinstance(left.kind, dict) else left.col.isNotNull()
            return Value(known if (right.id == "defined") == isinstance(op, ast.Is) else ~known, _BOOL)
        other = self.visit(right)
        if isinstance(op, (ast.In, ast.NotIn)):
            if other.kind is None or left.kind is None:
                found = F.lit(False)
            elif isinstance(other.kind, T.ArrayType):
                found = F.coalesce(F.array_contains(other.col, left.col), F.lit(False))
            else:
                found = F.contains(other.text(), left.text())
            return Value(found if isinstance(op, ast.In) else ~found, _BOOL)
        if left.kind is None or other.kind is None:
            null = [v.col.isNull() for v in (left, other) if v.kind is not None]
            same = null[0] if null else F.lit(True)
        elif isinstance(op, (ast.Eq, ast.NotEq)):
            same = left.col.eqNullSafe(other.col)
        else:
            how = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}.get(type(op))
            return Value(F.coalesce(getattr(left.col, how)(other.col), F.lit(False)), _BOOL) if how else self.generic_visit(node)
        if isinstance(op, (ast.Eq, ast.NotEq)):
            return Value(same if isinstance(op, ast.Eq) else ~same, _BOOL)
        return Value(F.lit(False), _BOOL)

    def visit_BinOp(self, node):
        if isinstance(node.op, ast.BitOr):  # a filter, which binds to the operands next to it only
            if isinstance(node.right, ast.BinOp):
                inner = ast.copy_location(ast.BinOp(node.left, ast.BitOr(), node.right.left), node)
                return self.visit(ast.copy_location(ast.BinOp(inner, node.right.op, node.right.right), node))
            if isinstance(node.left, ast.BinOp) and not isinstance(node.left.op, ast.BitOr) and not self._in_brackets(node.left):
                inner = ast.copy_location(ast.BinOp(node.left.right, ast.BitOr(), node.right), node.left)
                return self.visit(ast.copy_location(ast.BinOp(node.left.left, node.left.op, inner), node))
            return self._filter(self.visit(node.left), node.right)
        a, b = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Add) and not (isinstance(a.kind, T.NumericType) and isinstance(b.kind, T.NumericType)):
            return _string(F.concat(a.text(), b.text()))
        how = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Mod: "__mod__"}.get(type(node.op))
        if how is None or a.kind is None or b.kind is None:
            return self.generic_visit(node)
        return Value(getattr(a.col, how)(b.col), a.kind)

    def _in_brackets(self, node):
        return self.source[node.end_col_offset:].lstrip().startswith(")")

    def _filter(self, v: Value, how) -> Value:
        name, args = (how.id, []) if isinstance(how, ast.Name) else (how.func.id, how.args) if isinstance(how, ast.Call) else (None, [])
        array = isinstance(v.kind, T.ArrayType)
        if name in ("trim", "upper", "lower"):
            return _string({"trim": strip_ws, "upper": F.upper, "lower": F.lower}[name](v.text()))
        if name in ("length", "count"):
            return Value(F.lit(0) if v.kind is None else F.coalesce(F.size(v.col), F.lit(0)) if array else F.length(v.text()), _INT)
        if name in ("first", "last") and array:
            return Value(F.get(v.col, F.lit(0) if name == "first" else F.size(v.col) - 1), v.kind.elementType)
        if name == "default" and len(args) == 1:
            d = self.visit(args[0])
            return d if v.kind is None else Value(F.coalesce(v.col, d.col), v.kind)
        if name == "join" and array and len(args) <= 1:
            return _string(F.coalesce(F.array_join(v.col, args[0].value if args else ""), F.lit("")))
        return self.generic_visit(how)

    def visit_Call(self, node):
        args = [self.visit(a) for a in node.args]
        if isinstance(node.func, ast.Name) and node.func.id == "raise_exception" and len(args) == 1:
            return _string(F.raise_error(args[0].text()).cast("string"))
        if isinstance(node.func, ast.Attribute):
            v, name = self.visit(node.func.value).text(), node.func.attr
            if name in ("strip", "upper", "lower") and not args:
                return _string({"strip": strip_ws, "upper": F.upper, "lower": F.lower}[name](v))
            if name in ("startswith", "endswith") and len(args) == 1:
                return Value(getattr(F, name)(v, args[0].text()), _BOOL)
        return self.generic_visit(node)


def _either(test: Column, a: Value, b: Value) -> Value:
    if a.kind is None and b.kind is None:
        return a
    if a.kind is None or b.kind is None or type(a.kind) is type(b.kind):
        none = F.lit(None)
        return Value(F.when(test, none if a.kind is None else a.col).otherwise(none if b.kind is None else b.col), a.kind or b.kind)
    return _string(F.when(test, a.text()).otherwise(b.text()))


def _value(source: str, names: dict[str, Value]) -> Value:
    source = source.strip()
    try:
        return _Values(names, source).visit(ast.parse(source, mode="eval"))
    except SyntaxError:
        raise ValueError(f"not a value of a template: {source!r}") from None


# ---- blocks --------------------------------------------------------------------------


def _pieces(template: str) -> list[tuple[str, str]]:
    """(text, value or block, source), white space as told by ``-`` and the line rules."""
    if template.endswith("\n"):
        template = template[:-1]
    parts = _TOKEN.split(template)
    whole = list(parts)
    for i in range(1, len(parts), 2):
        block, before, after = not parts[i].startswith("{{"), parts[i - 1], parts[i + 1]
        if parts[i][2] == "-":
            before = before.rstrip()
        elif block and (re.search(r"\n[ \t]*$", whole[i - 1]) or i == 1 and not before.strip(" \t")):
            before = before.rstrip(" \t")
        if parts[i][-3] == "-":
            after = after.lstrip()
        elif block and after.startswith("\n"):
            after = after[1:]
        parts[i - 1], parts[i + 1] = before, after
    out = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            out += [("text", p)] if p else []
        elif not p.startswith("{#"):
            out.append(("value" if p.startswith("{{") else "block", p[2:-2].strip("-").strip()))
    return out


def _literal(text: str, names: dict[str, Value]) -> list[Column]:
    out = []
    for i, p in enumerate(text.split("{language}")):
        out += [names.get("language", Value(None, None)).text()] if i else []
        out += [F.lit(p)] if p else []
    return out


class _Compiler:
    def __init__(self, pieces):
        self.pieces, self.at = pieces, 0

    def body(self, names: dict[str, Value], ends: tuple[str, ...]) -> tuple[Column, str]:
        """The text up to one of the blocks ``ends``, and that block. ``names`` takes what is
        set on the way."""
        out: list[Column] = []
        while self.at < len(self.pieces):
            kind, source = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                out += _literal(source, names)
                continue
            if kind == "value":
                out.append(_value(source, names).text())
                continue
            word = source.split(None, 1)[0] if source else ""
            if word in ends:
                return self._joined(out), source
            rest = source[len(word):].strip()
            if word == "if":
                out.append(self._if(rest, names))
            elif word == "for":
                out.append(self._for(rest, names))
            elif word == "set" and re.match(r"\w+\s*=[^=]", rest):
                name, value = rest.split("=", 1)
                names[name.strip()] = _value(value, names)
            else:
                raise ValueError(f"not supported in a template: {{% {source} %}}")
        if ends:
            raise ValueError(f"the template ends before {ends[-1]}")
        return self._joined(out), ""

    @staticmethod
    def _joined(parts: list[Column]) -> Column:
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.lit("")

    def _if(self, source: str, names: dict[str, Value]) -> Column:
        tests, texts, scopes, rest = [], [], [], ("if " + source)
        while True:
            word = rest.split(None, 1)[0]
            tests.append(_value(rest.split(None, 1)[1], names).true() if word != "else" else None)
            own = dict(names)
            text, rest = self.body(own, ("endif",) if word == "else" else ("elif", "else", "endif"))
            texts.append(text)
            scopes.append(own)
            if rest.split(None, 1)[0] == "endif":
                break
        if tests[-1] is not None:
            tests.append(None)
            texts.append(F.lit(""))
            scopes.append(dict(names))
        out = texts[-1]
        for test, text in list(zip(tests, texts))[-2::-1]:
            out = F.when(test, text).otherwise(out)
        for name in {n for s in scopes for n, v in s.items() if names.get(n) is not v}:
            v = scopes[-1].get(name, Value(None, None))
            for test, own in list(zip(tests, scopes))[-2::-1]:
                v = _either(test, own.get(name, Value(None, None)), v)
            names[name] = v
        return out

    def _for(self, source: str, names: dict[str, Value]) -> Column:
        m = re.fullmatch(r"(\w+)\s+in\s+(.+)", source, re.S)
        if not m:
            raise ValueError(f"not supported in a template: {{% for {source} %}}")
        over, start = _value(m[2], names), self.at
        if over.kind is None:
            self.body(dict(names), ("endfor",))
            return F.lit("")
        if not isinstance(over.kind, T.ArrayType):
            raise ValueError(f"for goes over an array, not {m[2]!r}")
        n = F.size(over.col)

        def one(x, i):
            self.at = start
            loop = {"index0": Value(i, _INT), "index": Value(i + 1, _INT), "first": Value(i == 0, _BOOL),
                    "last": Value(i == n - 1, _BOOL), "length": Value(n, _INT)}
            return self.body({**names, m[1]: Value(x, over.kind.elementType), "loop": Value(None, loop)}, ("endfor",))[0]

        return F.coalesce(F.array_join(F.transform(over.col, one), ""), F.lit(""))


def template_column(template: str, names: dict[str, Value]) -> Column:
    """The template as a column over named values."""
    return _Compiler(_pieces(template)).body(dict(names), ())[0]


def render_template(df: DataFrame, template: str, variables: dict[str, str], constants: dict | None = None,
                    out: str = "rendered") -> DataFrame:
    """``df`` with the column ``out``: the template filled for each row. ``variables`` maps
    template names to columns of ``df`` (arrays and structs too), ``constants`` to strings,
    numbers or truth values."""
    names = {n: Value(F.col(f"`{c}`"), df.schema[c].dataType) for n, c in variables.items()}
    none = _Values({}, "")
    names |= {n: none.visit_Constant(ast.Constant(v)) for n, v in (constants or {}).items()}
    return df.withColumn(out, template_column(template, names))
