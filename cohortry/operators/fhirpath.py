"""A path language on typed resources, compiled to Columns. Every expression is a collection: an array without nulls.

Supported: paths with flattening, a leading type name, where, exists, first, [i], ofType, as, is, extension, resolve,
=, !=, and, + (strings), |, literals and parentheses. Operators on single values give an empty collection if a side is
empty, and an error if a side has several values; unknown functions are errors."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*')|(?P<date>@[\d\-T:.Z+]+)|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*|`[^`]*`)|(?P<op>!=|[.()\[\]=|+,]))")
REFERENCE = T.StructType([T.StructField("type", T.StringType()), T.StructField("id", T.StringType())])


class PathError(ValueError):
    """An expression that cannot be read or evaluated."""


@dataclass
class Node:
    """An array Column and the type of its elements; choice: elements with several typed fields, by their common name."""

    col: Column
    type: T.DataType
    choice: str = ""


class _Parser:
    def __init__(self, text: str) -> None:
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise PathError(f"cannot read {text[at:]!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.toks[self.at + ahead] if self.at + ahead < len(self.toks) else ("", "")

    def take(self, text: str) -> bool:
        if self.peek()[1] == text and self.peek()[0] != "str":
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise PathError(f"expected {text!r}")

    def expression(self) -> tuple:
        left = self.equality()
        while self.take("and"):
            left = ("and", left, self.equality())
        return left

    def equality(self) -> tuple:
        left = self.union()
        while self.peek()[1] in ("=", "!=", "is", "as"):
            op = self.peek()[1]
            self.at += 1
            left = (op, left, self.name() if op in ("is", "as") else self.union())
        return left

    def union(self) -> tuple:
        left = self.sum()
        while self.take("|"):
            left = ("|", left, self.sum())
        return left

    def sum(self) -> tuple:
        left = self.path()
        while self.take("+"):
            left = ("+", left, self.path())
        return left

    def name(self) -> str:
        kind, text = self.peek()
        if kind != "name":
            raise PathError(f"expected a name before {text!r}")
        self.at += 1
        name = text.strip("`")
        return self.name() if name in ("FHIR", "System") and self.take(".") else name

    def path(self) -> tuple:
        left = self.term()
        while True:
            if self.take("."):
                left = self.step(left, self.name())
            elif self.take("["):
                kind, text = self.peek()
                if kind != "num":
                    raise PathError("an index is a number")
                self.at += 1
                self.need("]")
                left = ("index", left, int(text))
            else:
                return left

    def step(self, left: tuple | None, name: str) -> tuple:
        if not self.take("("):
            return ("member", left, name)
        args = []
        while not self.take(")"):
            args.append(self.expression())
            self.take(",")
        return ("call", left, name, args)

    def term(self) -> tuple:
        kind, text = self.peek()
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        self.at += 1
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind == "num":
            return ("lit", float(text) if "." in text else int(text))
        if kind == "date":
            return ("lit", text[1:])
        if kind == "name":
            return ("lit", text == "true") if text in ("true", "false") else self.step(None, text.strip("`"))
        raise PathError(f"unexpected {text!r}")


def _one(n: Node) -> Column:
    """The value of a collection of at most one element."""
    return F.when(F.size(n.col) > 1, F.raise_error(F.lit("a single value is expected"))).otherwise(F.get(n.col, F.lit(0)))


def _single(value: Column, kind: T.DataType) -> Node:
    return Node(F.array_compact(F.array(value)), kind)


def _member(n: Node, name: str) -> Node:
    if n.choice or not isinstance(n.type, T.StructType):
        raise PathError(f"no element {name}")
    fields = {f.name: f.dataType for f in n.type.fields}
    if name in fields:
        kind = fields[name]
        inner = F.transform(n.col, lambda x: x[name])
        if isinstance(kind, T.ArrayType):
            return Node(F.array_compact(F.flatten(F.array_compact(inner))), kind.elementType)
        return Node(F.array_compact(inner), kind)
    if any(f.startswith(name) and f[len(name) : len(name) + 1].isupper() for f in fields):
        return Node(n.col, n.type, name)
    raise PathError(f"no element {name}")


def _of_type(n: Node, kind: str) -> Node:
    if n.choice:
        name = n.choice + kind[0].upper() + kind[1:]
        if name not in n.type.fieldNames():
            return Node(F.slice(F.transform(n.col, lambda x: F.lit(None).cast("string")), 1, 0), T.StringType())
        return _member(Node(n.col, n.type), name)
    if n.type == REFERENCE:
        return Node(F.filter(n.col, lambda x: x["type"] == kind), n.type)
    names = {"string": T.StringType, "boolean": T.BooleanType, "decimal": T.DecimalType, "integer": T.IntegerType}
    ok = isinstance(n.type, names[kind.lower()]) if kind.lower() in names else isinstance(n.type, T.StructType)
    return n if ok else Node(F.slice(n.col, 1, 0), n.type)


def _eval(e: tuple, here: Node, types: set[str]) -> Node:
    op = e[0]
    if op == "lit":
        kind = {bool: T.BooleanType(), int: T.IntegerType(), float: T.DoubleType(), str: T.StringType()}[type(e[1])]
        return Node(F.array(F.lit(e[1])), kind)
    if op == "member":
        if e[1] is None:
            return here if e[2] in types or e[2] in ("Resource", "$this") else _member(here, e[2])
        return _member(_eval(e[1], here, types), e[2])
    if op == "index":
        n = _eval(e[1], here, types)
        return Node(F.slice(n.col, e[2] + 1, 1), n.type, n.choice)
    if op == "and":
        a, b = (_one(_eval(x, here, types)) for x in e[1:3])
        return _single(a.cast("boolean") & b.cast("boolean"), T.BooleanType())
    if op in ("=", "!="):
        a, b = _eval(e[1], here, types), _eval(e[2], here, types)
        both = (F.size(a.col) > 0) & (F.size(b.col) > 0)
        as_text = F.to_json if isinstance(a.type, T.StructType) else lambda c: c.cast("string")
        same = F.transform(a.col, as_text) == F.transform(b.col, as_text)
        return _single(F.when(both, same if op == "=" else ~same), T.BooleanType())
    if op == "|":
        a, b = _eval(e[1], here, types), _eval(e[2], here, types)
        return Node(F.array_distinct(F.concat(a.col, b.col)), a.type)
    if op == "+":
        a, b = (_one(_eval(x, here, types)) for x in e[1:3])
        return _single(F.concat(a.cast("string"), b.cast("string")), T.StringType())
    if op == "as":
        return _of_type(_eval(e[1], here, types), e[2])
    if op == "is":
        n = _eval(e[1], here, types)
        return _single(F.when(F.size(n.col) > 0, F.size(_of_type(n, e[2]).col) > 0), T.BooleanType())
    return _call(e, here, types)


def _call(e: tuple, here: Node, types: set[str]) -> Node:
    _, source, name, args = e
    n = here if source is None else _eval(source, here, types)
    if name == "exists" and not args:
        return Node(F.array(F.size(n.col) > 0), T.BooleanType())
    if name == "first" and not args:
        return Node(F.slice(n.col, 1, 1), n.type, n.choice)
    if name == "where" and len(args) == 1:
        keep = lambda x: F.coalesce(_one(_eval(args[0], Node(F.array(x), n.type), types)).cast("boolean"), F.lit(False))
        return Node(F.filter(n.col, keep), n.type, n.choice)
    if name in ("ofType", "as", "is") and len(args) == 1 and args[0][0] == "member":
        kind = args[0][2]
        if name == "is":
            return _single(F.when(F.size(n.col) > 0, F.size(_of_type(n, kind).col) > 0), T.BooleanType())
        return _of_type(n, kind)
    if name == "extension" and len(args) == 1:
        return _call(("call", ("member", source, "extension") if source else ("member", None, "extension"), "where", [("=", ("member", None, "url"), args[0])]), here, types)
    if name == "resolve" and not args:
        ref = lambda x: x["reference"] if isinstance(n.type, T.StructType) else x
        part = lambda x, k: F.get(F.split(ref(x), "/"), F.size(F.split(ref(x), "/")) - k)
        found = F.transform(F.filter(n.col, lambda x: F.contains(ref(x), F.lit("/"))), lambda x: F.struct(part(x, 2).alias("type"), part(x, 1).alias("id")))
        return Node(found, REFERENCE)
    raise PathError(f"unknown function {name}")


def path(text: str, schema: T.StructType, type_: str = "Resource") -> Column:
    """The collection that an expression gives on rows of a schema, as an array Column."""
    parser = _Parser(text)
    tree = parser.expression()
    if parser.at < len(parser.toks):
        raise PathError(f"unexpected {parser.peek()[1]!r}")
    root = Node(F.array(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields])), schema)
    return _eval(tree, root, {type_}).col


def truth(text: str, schema: T.StructType, type_: str = "Resource") -> Column:
    """The expression as a condition: an empty collection is false."""
    return F.coalesce(F.get(path(text, schema, type_), F.lit(0)).cast("boolean"), F.lit(False))
