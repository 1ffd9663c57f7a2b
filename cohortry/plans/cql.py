"""Cohort query language to DataFrame plans.

All definitions of a library become columns of one plan: each resource type is scanned once and aggregated once by
subject. `exists` and `Count` over one type become flags and counts with map-side partial aggregation, `with` and
`without` semi- and anti-joins of rows; other retrieves become arrays per subject (a subject's own resources), of the rows
that pass their conditions. Definitions that nobody asks for are never computed. Lists of the Unfiltered context are
joined or aggregated, never collected."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions import aggregates, arithmetic, convert, intervals, lists, quantity, strings, temporal
from cohortry.functions.logic import let
from cohortry.operators.search import One
from cohortry.plans.cql_parser import CqlError, Library, parse


@dataclass
class Type:
    """A resource type: rows, the column that names the subject, and its elements.

    elements: name -> (column, kind). codes: search parameter -> column of array<struct<system, code>>. contexts: by other
    types, the column with the id of the resource of that type to which a row belongs."""

    df: DataFrame
    subject: Column | None
    elements: dict[str, tuple[Column, str]]
    codes: dict[str, Column | One] = field(default_factory=dict)
    contexts: dict[str, Column] = field(default_factory=dict)


@dataclass
class Model:
    """value_sets, code_systems: url -> (system, code)."""

    types: dict[str, Type]
    subject: str = "Patient"
    value_sets: Callable[[str], DataFrame] | None = None
    code_systems: Callable[[str], DataFrame] | None = None


@dataclass
class V:
    col: Column
    kind: str
    static: object = None


def item_kind(kind: str) -> str:
    return kind[kind.index("<") + 1 : -1] if "<" in kind else "Any"


class _NeedsSubject(Exception):
    """An expression that cannot be evaluated on a resource row alone."""


TEMPORAL = ("Date", "DateTime")
_PREV: dict[str, Callable[[Column], Column]] = {"Date": temporal.predecessor, "Integer": lambda c: c - 1, "Decimal": lambda c: c - F.lit("0.00000001").cast("decimal(28,8)")}


class Compiler:
    def __init__(self, model: Model, library: str | Library, parameters: dict[str, object] | None = None, now: str = "2020-01-01T00:00:00") -> None:
        self.model, self.lib = model, parse(library) if isinstance(library, str) else library
        self.parameters, self.now = parameters or {}, now
        for p in self.parameters:
            if p not in self.lib.parameters:
                raise CqlError(f"unknown parameter {p}")
        self.names = self._names()
        self.context = model.subject
        # By type and whose rows they are (None: the subject's own, else a key): name -> aggregate over those rows.
        self.aggs: dict[tuple[str, str | None], dict[str, Column]] = {}
        self.tests: dict[tuple[str, str | None], list[Column]] = {}  # which rows an aggregate counts, for each of them
        self.keys: dict[str, tuple[Column, Column]] = {}  # by key: its column in the plan, and that of the rows
        self.joins: dict[str, list[Callable[[DataFrame], DataFrame]]] = {}  # by type: what adds a flag to its rows
        self.flags: list[Callable[[DataFrame], DataFrame]] = []  # what adds a flag to the plan
        self.found: dict[tuple[str, int], tuple[str, Column] | None] = {}  # what _source() has found, by context and tree
        self.open: list[str] = []

    def _names(self) -> set[str]:
        """All names that occur: resources keep only the elements among them."""
        out: set[str] = {"id"}

        def walk(x) -> None:
            if isinstance(x, (tuple, list)):
                for y in x:
                    walk(y)
            elif isinstance(x, str):
                out.add(x)

        walk([*(e for _, e in self.lib.defines.values()), *(e for _, e in self.lib.functions.values())])
        return out

    # Rows.

    def _struct(self, type_: str) -> Column:
        t = self.model.types[type_]
        own = [t.elements[n][0].alias(n) for n in t.elements if n in self.names]
        return F.struct(*own, *[c.alias(f"__to_{n}") for n, c in t.contexts.items() if n in self.names])

    def _flag(self, joins: list[Callable[[DataFrame], DataFrame]], key: Column, members: DataFrame, same: Callable[[Column], Column]) -> Column:
        """A column that is true where members (their columns have names of their own) match the key."""
        flag = f"__in{sum(map(len, self.joins.values())) + len(self.flags)}"
        own = F.col(f"{flag}_key")  # a name that members have not
        joins.append(lambda df: df.withColumn(f"{flag}_key", key).withColumn(flag, members.where(same(own.outer())).exists()).drop(f"{flag}_key"))
        return F.col(flag)

    def _member(self, type_: str | None, key: Column, kind: str, codes: DataFrame) -> Column:
        """Whether a code (a text, a code, or a list of codes) is among codes (system, code). type_: of the row, None for the subject."""
        joins = self.flags if type_ is None else self.joins.setdefault(type_, [])
        members = codes.select(F.col("system").alias("__s"), F.col("code").alias("__c")).distinct()
        if kind == "String":
            return self._flag(joins, key, members, lambda k: F.col("__c") == k)
        if kind == "Code":
            return self._flag(joins, key, members, lambda k: (F.col("__c") == k["code"]) & F.col("__s").eqNullSafe(k["system"]))
        flag = f"__in{sum(map(len, self.joins.values())) + len(self.flags)}"

        def add(df: DataFrame) -> DataFrame:  # a list can have several members: the lists that have one, then the rows
            df = df.withColumn(f"{flag}_key", key)
            pairs = df.select(f"{flag}_key", F.explode(f"{flag}_key").alias("c")).join(members, F.col("c.system").eqNullSafe(F.col("__s")) & (F.col("c.code") == F.col("__c")), "left_semi")
            lists_ = pairs.select(F.col(f"{flag}_key").alias("__k")).distinct()
            return df.withColumn(flag, lists_.where(F.col("__k") == F.col(f"{flag}_key").outer()).exists()).drop(f"{flag}_key")

        joins.append(add)
        return F.col(flag)

    def _code_test(self, type_: str, prop: str | None, codes: tuple | None, env: dict) -> Column:
        if codes is None:
            return F.lit(True)
        t = self.model.types[type_]
        col = t.codes.get(prop or "code")
        if col is None:
            raise CqlError(f"{type_} has no code property {prop or 'code'}")
        if codes[0] == "ref" and codes[1] in self.lib.valuesets:
            if self.model.value_sets is None:
                raise CqlError("no terminology")
            own, kind = (col.col, "Code") if isinstance(col, One) else (col, "List<Code>")
            return self._member(type_, own, kind, self.model.value_sets(self.lib.valuesets[codes[1]]))
        wanted = self._static_codes(codes)
        if isinstance(col, One):
            return _any([(col.col["code"] == v) if s is None else (col.col["system"] == s) & (col.col["code"] == v) for s, v in wanted])
        return F.coalesce(F.exists(col, lambda c: _any([(c["code"] == v) if s is None else (c["system"] == s) & (c["code"] == v) for s, v in wanted])), F.lit(False))

    def _static_codes(self, e: tuple) -> list[tuple[str | None, str]]:
        if e[0] == "ref" and e[1] in self.lib.codes:
            return [self.lib.codes[e[1]]]
        if e[0] == "list":
            return [c for x in e[1] for c in self._static_codes(x)]
        if e[0] == "string":
            return [(None, e[1])]
        if e[0] == "call" and e[1] in ("ToConcept", "ToCode", "ToList"):
            return self._static_codes(e[2][0])
        if e[0] == "paren":
            return self._static_codes(e[1])
        if e[0] == "ref" and e[1] in self.lib.defines:
            return self._static_codes(self.lib.defines[e[1]][1])
        raise CqlError("codes of a retrieve have to be static")

    def _agg(self, type_: str, col: Column, prefix: str, test: Column, key: str | None = None) -> Column:
        own = self.aggs.setdefault((type_, key), {})
        self.tests.setdefault((type_, key), []).append(test)
        name = f"__{prefix}_{type_}_{key or ''}_{len(own)}"
        own[name] = col
        return F.col(f"`{name}`")

    # Expressions.

    def define(self, name: str) -> V:
        if name in self.open:
            raise CqlError(f"{name} refers to itself")
        if name not in self.lib.defines:
            raise CqlError(f"unknown expression {name}")
        self.open.append(name)
        before, self.context = self.context, self.lib.defines[name][0]
        try:
            return self.expr(self.lib.defines[name][1], {})
        finally:
            self.open.pop()
            self.context = before

    def parameter(self, name: str) -> V:
        kind, default = self.lib.parameters[name]
        if name in self.parameters:
            return self._value(name, self.parameters[name], kind or "")
        return V(F.lit(None), "Any") if default is None else self.expr(default, {})

    def _value(self, name: str, x: object, kind: str) -> V:
        """A value from outside: booleans, numbers, texts, dates, codes (system and code), and lists and tuples of them."""
        if isinstance(x, (list, tuple)):
            items = [self._value(name, y, item_kind(kind) if kind.startswith("List<") else kind) for y in x]
            return V(F.array(*[i.col for i in items]), f"List<{items[0].kind if items else 'Any'}>")
        if isinstance(x, dict):
            if set(x) <= {"system", "code"} and "code" in x:
                return V(F.struct(F.lit(x.get("system")).cast("string").alias("system"), F.lit(x["code"]).alias("code")), "Code")
            parts = {n: self._value(name, y, "") for n, y in x.items()}
            return V(F.struct(*[v.col.alias(n) for n, v in parts.items()]), "Tuple", {n: v.kind for n, v in parts.items()})
        if isinstance(x, str) and kind in TEMPORAL:
            return V(temporal.literal(x), "Date")
        if isinstance(x, datetime.date):
            return V(temporal.literal(x.isoformat()), "Date")
        if isinstance(x, Decimal) or kind == "Decimal" and isinstance(x, (int, float)) and not isinstance(x, bool):
            return V(F.lit(str(x)).cast("decimal(28,8)"), "Decimal")
        if not isinstance(x, (bool, int, float, str)):
            raise CqlError(f"unsupported value of parameter {name}")
        return V(F.lit(x), {bool: "Boolean", int: "Integer", float: "Decimal", str: "String"}[type(x)])

    def expr(self, e: tuple, env: dict) -> V:
        fn = getattr(self, f"_{e[0]}", None) or _OPERATORS.get(e[0])
        if fn is None:
            raise CqlError(f"unsupported: {e[0]}")
        return fn(e, env) if getattr(fn, "__self__", None) is self else fn(self, e, env)

    def _paren(self, e, env):
        return self.expr(e[1], env)

    def _null(self, e, env):
        return V(F.lit(None), "Any")

    def _boolean(self, e, env):
        return V(F.lit(e[1]), "Boolean", e[1])

    def _integer(self, e, env):
        return V(F.lit(e[1]).cast("long"), "Integer", e[1])

    def _decimal(self, e, env):
        return V(F.lit(e[1]).cast("decimal(28,8)"), "Decimal")

    def _string(self, e, env):
        return V(F.lit(e[1]), "String", e[1])

    def _date(self, e, env):
        if e[1].startswith("T"):
            return V(convert.to_time(F.lit(e[1])), "Time")
        return V(temporal.literal(e[1]), "Date")

    def _quantity(self, e, env):
        if e[2].rstrip("s") in temporal.PRECISION or e[2].rstrip("s") == "week":
            return V(F.lit(int(float(e[1]))), "Period:" + e[2].rstrip("s"))
        return V(quantity.quantity(F.lit(str(e[1])).cast("decimal(28,8)"), e[2]), "Quantity")

    def _ref(self, e, env):
        name = e[1]
        if name in env:
            return env[name]
        if env.get("$row") is not None and name in env["$row"]:
            return env["$row"][name]
        if name in self.lib.codes:
            s, c = self.lib.codes[name]
            return V(F.struct(F.lit(s).alias("system"), F.lit(c).alias("code")), "Code")
        if name in self.lib.parameters:
            return self.parameter(name)
        if name == self.model.subject:
            if env.get("$rowonly"):
                raise _NeedsSubject
            return V(F.col("__subject"), f"Row:{name}")
        if name in self.lib.defines:
            if env.get("$rowonly") and self.lib.defines[name][0] != "Unfiltered":
                raise _NeedsSubject
            if self.lib.defines[name][0] == "Unfiltered" and self._is_list(self.lib.defines[name][1]):
                return V(F.lit(None), "Unfiltered:" + name)
            if self.context == "Unfiltered" and self.lib.defines[name][0] != "Unfiltered":
                return V(F.lit(None), "Subjects:" + name)
            return self.define(name)
        raise CqlError(f"unknown name {name}")

    def _property(self, e, env):
        src = self.expr(e[1], env)
        return self.field(src, e[2])

    def field(self, src: V, name: str) -> V:
        if src.kind.startswith("Row:"):
            t = self.model.types[src.kind[4:]]
            if name not in t.elements:
                raise CqlError(f"{src.kind[4:]} has no element {name}")
            return V(src.col[name], t.elements[name][1])
        if src.kind.startswith("Interval<"):
            part = {"low": "low", "start": "low", "high": "high", "end": "high"}[name]
            return V(src.col[part], item_kind(src.kind))
        if src.kind.startswith("List<"):
            inner = item_kind(src.kind)
            probe = self.field(V(F.lit(None), inner), name) if not inner.startswith("Row:") else V(F.lit(None), self.model.types[inner[4:]].elements[name][1])
            flat = F.transform(src.col, lambda x: self.field(V(x, inner), name).col)
            if probe.kind.startswith("List<"):
                return V(F.flatten(flat), probe.kind)
            return V(lists.filter_(flat, lambda x: x.isNotNull()), f"List<{probe.kind}>")
        if src.kind == "Quantity":
            return V(src.col[name], "Decimal" if name == "value" else "String")
        if src.kind == "Tuple":
            return V(src.col[name], (src.static or {}).get(name, "String"))
        if src.kind == "Ratio":
            return V(src.col[name], "Quantity")
        if src.kind in ("Code", "Reference"):
            return V(src.col[name], "String")
        if src.kind == "Concept":
            if name == "coding":
                return V(src.col, "List<Code>")
        if name == "value":  # a primitive's own value
            return src
        raise CqlError(f"no element {name} of {src.kind}")

    def _index(self, e, env):
        a, i = self.expr(e[1], env), self.expr(e[2], env)
        if a.kind == "String":
            return V(strings.char_at(a.col, i.col.cast("int")), "String")
        return V(lists.item(a.col, i.col.cast("int")), item_kind(a.kind))

    def _list(self, e, env):
        items = [self.expr(x, env) for x in e[1]]
        kind = next((i.kind for i in items if i.kind != "Any"), "Any")
        return V(F.array(*[i.col for i in items]), f"List<{kind}>")

    def _tuple(self, e, env):
        parts = {n: self.expr(x, env) for n, x in e[1]}
        return V(F.struct(*[v.col.alias(n) for n, v in parts.items()]), "Tuple", {n: v.kind for n, v in parts.items()})

    def _instance(self, e, env):
        parts = {n: self.expr(x, env) for n, x in e[2]}
        get = lambda n: parts[n].col if n in parts else F.lit(None).cast("string")
        if e[1] == "Code":
            return V(F.struct(get("system").alias("system"), get("code").alias("code")), "Code")
        if e[1] == "Quantity":
            return V(quantity.quantity(get("value").cast("decimal(28,8)"), get("unit")), "Quantity")
        return V(F.struct(*[v.col.alias(n) for n, v in parts.items()]), "Tuple", {n: v.kind for n, v in parts.items()})

    def _interval(self, e, env):
        lo, hi = self.expr(e[1], env), self.expr(e[2], env)
        kind = lo.kind if lo.kind != "Any" else hi.kind
        if kind == "Date":
            low = F.coalesce(lo.col, temporal.literal("0001-01-01")) if lo.kind != "Any" else temporal.literal("0001-01-01")
            high = F.coalesce(hi.col, temporal.literal("9999-12-31T23:59:59.999")) if hi.kind != "Any" else temporal.literal("9999-12-31T23:59:59.999")
            low = low if e[3] else temporal.successor(low)
            high = high if e[4] else temporal.predecessor(high)
            return V(F.struct(low.alias("low"), high.alias("high")), "Interval<Date>")
        if kind == "Quantity":
            return V(F.struct(lo.col.alias("low"), hi.col.alias("high")), "Interval<Quantity>")
        step = F.lit(1) if kind == "Integer" else F.lit("0.00000001").cast("decimal(28,8)")
        low = lo.col if e[3] else lo.col + step
        high = hi.col if e[4] else hi.col - step
        return V(F.struct(low.alias("low"), high.alias("high")), f"Interval<{kind}>")

    def _if(self, e, env):
        c, a, b = (self.expr(x, env) for x in e[1:4])
        return V(F.when(c.col, a.col).otherwise(b.col), a.kind if a.kind != "Any" else b.kind)

    def _case(self, e, env):
        comparand = self.expr(e[1], env) if e[1] else None
        other = self.expr(e[3], env)
        out, kind = None, other.kind
        for w, t in e[2]:
            cond = self.compare("=", comparand, self.expr(w, env)) if comparand else self.expr(w, env).col
            then = self.expr(t, env)
            kind = then.kind if then.kind != "Any" else kind
            out = F.when(cond, then.col) if out is None else out.when(cond, then.col)
        return V(out.otherwise(other.col), kind)

    # Comparison.

    def compare(self, op: str, a: V, b: V) -> Column:
        kinds = {a.kind, b.kind}
        if "Date" in kinds and kinds <= {"Date", "Any"}:
            fn = {"=": temporal.equal, "~": temporal.equivalent, "<": temporal.less, ">": temporal.greater, "<=": temporal.less_or_equal, ">=": temporal.greater_or_equal}[op]
            return fn(a.col, b.col) if "Any" not in kinds else F.lit(None).cast("boolean")
        if "Quantity" in kinds:
            one = lambda v: v.col if v.kind == "Quantity" else quantity.quantity(v.col.cast("decimal(28,8)"))
            fn = {"=": quantity.equal, "~": quantity.equivalent, "<": quantity.less, ">": quantity.greater, "<=": quantity.less_or_equal, ">=": quantity.greater_or_equal}[op]
            return fn(one(a), one(b)) if "Any" not in kinds else F.lit(None).cast("boolean")
        if kinds == {"Time"}:
            return {"=": temporal.time_equal, "~": lambda x, y: x.eqNullSafe(y), "<": temporal.time_less, ">": lambda x, y: temporal.time_less(y, x), "<=": lambda x, y: ~temporal.time_less(y, x), ">=": lambda x, y: ~temporal.time_less(x, y)}[op](a.col, b.col)
        if kinds <= {"Code", "Concept", "List<Code>", "String"} and kinds != {"String"}:
            return self._codes_equal(a, b)
        x, y = a.col, b.col
        return {"=": lambda: x == y, "~": lambda: x.eqNullSafe(y), "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[op]()

    def _codes_equal(self, a: V, b: V) -> Column:
        def each(v: V, test: Callable[[Column, str], Column]) -> Column:
            if v.kind in ("Concept", "List<Code>"):
                return F.coalesce(F.exists(v.col, lambda c: test(c, "Code")), F.lit(False))
            return F.coalesce(test(v.col, v.kind), F.lit(False))

        def same(x: Column, kx: str, y: Column, ky: str) -> Column:
            if "String" in (kx, ky):
                return (x if kx == "String" else x["code"]) == (y if ky == "String" else y["code"])
            return x["system"].eqNullSafe(y["system"]) & (x["code"] == y["code"])

        return each(a, lambda x, kx: each(b, lambda y, ky: same(x, kx, y, ky)))

    # Queries.

    def _retrieve(self, e, env):
        _, type_, prop, codes, context = e
        if type_ not in self.model.types:
            raise CqlError(f"unknown type {type_}")
        if env.get("$rowonly"):
            raise _NeedsSubject
        if self.context == "Unfiltered":
            raise CqlError("lists of the Unfiltered context can be counted, asked for members, or aggregated")
        key = None
        if context is not None:
            key = self._related(type_, context)
        elif type_ != self.model.subject and type_ in self.model.types[self.model.subject].contexts:
            key = f"to {type_}"  # what the subject belongs to
            self.keys[key] = (F.col("__subject")[f"__to_{type_}"], self.model.types[type_].elements["id"][0])
        elif type_ == self.model.subject:
            return V(F.array(F.col("__subject")), f"List<Row:{type_}>")
        if key is None and self.model.types[type_].subject is None:
            raise CqlError(f"{type_} does not belong to {self.model.subject}")
        test = self._code_test(type_, prop, codes, env)
        return V(F.coalesce(self._agg(type_, F.collect_list(F.when(test, self._struct(type_))), "rows", test, key), F.array()), f"List<Row:{type_}>")

    def _related(self, type_: str, context: str) -> str:
        """The key of the rows that belong to the resource that another definition gives."""
        if context not in self.lib.defines:
            raise CqlError(f"unknown expression {context}")
        x, key = self.define(context), f"of {context} {type_}"
        if not x.kind.startswith("Row:"):
            raise CqlError(f"{context} is no resource")
        other, t = x.kind[4:], self.model.types[type_]
        if other == self.model.subject and t.subject is not None:
            self.keys[key] = (x.col["id"], t.subject)
        elif other in t.contexts:
            self.keys[key] = (x.col["id"], t.contexts[other])
        elif type_ in self.model.types[other].contexts:
            self.keys[key] = (x.col[f"__to_{type_}"], t.elements["id"][0])
        else:
            raise CqlError(f"{type_} does not belong to {other}")
        return key

    # Rows of one type that a condition on themselves, or on other rows of the same subject, selects.

    def _source(self, e: tuple) -> tuple[str, Column] | None:
        """(type, condition) of a retrieve, or of a query over one that returns its rows. Found once for each tree."""
        while e[0] == "paren":
            e = e[1]
        if e[0] == "retrieve":
            return self._once(e, self._retrieved)
        return self._query_rows(e) if e[0] == "query" and e[5] is None else self._source_of(e)

    def _once(self, e: tuple, find: Callable[[tuple], tuple[str, Column] | None]) -> tuple[str, Column] | None:
        key = (self.context, id(e))
        if key not in self.found:
            self.found[key] = find(e)
        return self.found[key]

    def _retrieved(self, e: tuple) -> tuple[str, Column] | None:
        _, type_, prop, codes, context = e
        whole = self.context == "Unfiltered"
        if type_ not in self.model.types or context is not None or not whole and (type_ == self.model.subject or self.model.types[type_].subject is None):
            return None
        return type_, self._code_test(type_, prop, codes, {})

    def _source_of(self, e: tuple) -> tuple[str, Column] | None:
        if e[0] == "ref" and e[1] in self.lib.defines and self.lib.defines[e[1]][0] == self.context and e[1] not in self.open:
            return self._source(self.lib.defines[e[1]][1])
        return None

    def _query_rows(self, e: tuple) -> tuple[str, Column] | None:
        """Of a query, whatever it returns: `with` and `without` are semi- and anti-joins, as flags that share one scan."""
        return self._once(e, self._queried)

    def _queried(self, e: tuple) -> tuple[str, Column] | None:
        _, source, alias, relations, where, *_ = e
        base = self._source(source)
        if base is None:
            return None
        type_, test = base
        try:
            for kind, other, name, cond in relations:
                found = self._relation_flag(type_, alias, other, name, cond)
                if found is None:
                    return None
                test = test & (found if kind == "with" else ~found)
            if where is not None:
                test = test & self.expr(where, {alias: V(self._struct(type_), f"Row:{type_}"), "$rowonly": type_}).col.cast("boolean")
        except _NeedsSubject:
            return None
        return type_, test

    def _relation_flag(self, type_: str, alias: str, other: tuple, name: str, cond: tuple) -> Column | None:
        t, before = self.model.types[type_], {k: len(v) for k, v in self.joins.items()}
        known, self.found = self.found, {}  # its flags are its own
        found = self._source(other)
        self.found = known
        if found is None or t.subject is None or self.model.types[found[0]].subject is None:
            return None
        kind, test = found
        o, flags = self.model.types[kind], self.joins.get(kind, [])[before.get(kind, 0) :]
        flag = f"__in{sum(map(len, self.joins.values())) + len(self.flags)}"  # its columns have names that the other rows have not
        env = {alias: V(F.col(f"{flag}_row").outer(), f"Row:{type_}"), name: V(F.col("__orow"), f"Row:{kind}"), "$rowonly": type_, "$pair": True}
        same = (F.col("__osubject") == F.col(f"{flag}_of").outer()) & self.expr(cond, env).col.cast("boolean")
        rows = self._rows(kind, flags).where(test).select(o.subject.alias("__osubject"), self._struct(kind).alias("__orow"))
        own = {f"{flag}_of": t.subject, f"{flag}_row": self._struct(type_)}
        self.joins.setdefault(type_, []).append(lambda df: df.withColumns(own).withColumn(flag, rows.where(same).exists()).drop(*own))
        return F.col(flag)

    def _fused(self, e: tuple, env: dict, count: bool = False) -> tuple[str, Column] | None:
        """What exists (count: Count) of a list comes down to: (type, condition)."""
        if env:
            return None
        while e[0] == "paren":
            e = e[1]
        if e[0] == "ref" and e[1] in self.lib.defines and self.lib.defines[e[1]][0] == self.context and e[1] not in self.open:
            return self._fused(self.lib.defines[e[1]][1], env, count)
        if e[0] != "query" or e[5] is None:
            return self._source(e)
        if count and e[6]:  # distinct values
            return None
        found = self._query_rows(e)
        if found is None:
            return None
        try:
            value = self.expr(e[5], {e[2]: V(self._struct(found[0]), f"Row:{found[0]}"), "$rowonly": found[0]})
        except _NeedsSubject:
            return None
        return found[0], found[1] & value.col.isNotNull()

    def _is_list(self, e: tuple) -> bool:
        while e[0] == "paren":
            e = e[1]
        return e[0] in ("retrieve", "query", "list") or e[0] == "ref" and e[1] in self.lib.defines and self._is_list(self.lib.defines[e[1]][1])

    def _relation(self, e: tuple, env: dict) -> tuple[DataFrame, str] | None:
        """(values as column v, kind) of a list that belongs to no subject: one of the Unfiltered context, or a definition over all subjects."""
        while e[0] == "paren":
            e = e[1]
        if env or e[0] == "ref" and e[1] not in self.lib.defines:
            return None
        if e[0] == "ref":
            context, tree = self.lib.defines[e[1]]
            if context != "Unfiltered":
                if self.context != "Unfiltered":
                    return None
                other = Compiler(self.model, self.lib, self.parameters, self.now)
                kind = other.define(e[1]).kind
                other = Compiler(self.model, self.lib, self.parameters, self.now)
                rows = other.plan([e[1]]).select(F.col(f"`{e[1]}`").alias("v"))
                return (rows.select(F.explode("v").alias("v")), item_kind(kind)) if kind.startswith("List<") else (rows, kind)
            before, self.context = self.context, "Unfiltered"
            try:
                return self._relation(tree, {}) if self._is_list(tree) else None
            finally:
                self.context = before
        if self.context != "Unfiltered" or e[0] not in ("retrieve", "query"):
            return None
        found = self._query_rows(e) if e[0] == "query" else self._source(e)
        if found is None:
            raise CqlError("a list of the Unfiltered context is a query over one type")
        row = V(self._struct(found[0]), f"Row:{found[0]}")
        value = row if e[0] == "retrieve" or e[5] is None else self.expr(e[5], {e[2]: row, "$rowonly": found[0]})
        out = self._rows(found[0]).where(found[1]).select(value.col.alias("v"))
        return (out.distinct() if e[0] == "query" and e[5] is not None and e[6] else out), value.kind

    def values(self, name: str) -> DataFrame:
        """(v) the values of a list definition of the Unfiltered context, as rows."""
        found = self._relation(("ref", name), {}) if name in self.lib.defines and self.lib.defines[name][0] == "Unfiltered" else None
        if found is None:
            raise CqlError(f"{name} is no list of the Unfiltered context")
        return found[0]

    def _query(self, e, env):
        _, source, alias, relations, where, returned, distinct, sort = e
        found = None if env else self._query_rows(e)
        if found is not None and self.context != "Unfiltered":  # rows are selected before they are gathered by subject
            rows = F.coalesce(self._agg(found[0], F.collect_list(F.when(found[1], self._struct(found[0]))), "rows", found[1]), F.array())
            src, relations, where = V(rows, f"List<Row:{found[0]}>"), [], None
        else:
            src = self.expr(source, env)
        single = not src.kind.startswith("List<")
        kind = src.kind if single else item_kind(src.kind)
        items = F.array_compact(F.array(src.col)) if single else src.col
        scope = lambda x: {**env, alias: V(x, kind)}

        def related(o: V, name: str, cond: tuple) -> Callable[[Column], Column]:
            inner = lambda x: lambda y: F.coalesce(self.expr(cond, {**scope(x), name: V(y, item_kind(o.kind))}).col, F.lit(False))
            return lambda x: F.exists(o.col, inner(x))

        for k, other, name, cond in relations:
            test = related(self.expr(other, env), name, cond)
            items = F.filter(items, test if k == "with" else _negated(test))
        if where is not None:
            items = F.filter(items, lambda x: F.coalesce(self.expr(where, scope(x)).col, F.lit(False)))
        out_kind = kind
        if sort is not None and returned is None:
            items = self._sorted(items, kind, sort, env)
        if returned is not None:
            # The kind of what is returned: compile once on a placeholder.
            out_kind = self.expr(returned, scope(F.lit(None))).kind if not kind.startswith("Row:") else self.expr(returned, scope(F.col("__none"))).kind
            items = F.transform(items, lambda x: self.expr(returned, scope(x)).col)
            if distinct:
                items = F.array_distinct(items)
            if sort is not None:
                items = self._sorted(items, out_kind, sort, env)
        return V(F.get(items, F.lit(0)), out_kind) if single else V(items, f"List<{out_kind}>")

    def _sorted(self, items: Column, kind: str, sort: tuple, env: dict) -> Column:
        by, descending = sort

        def key(x: Column) -> Column:
            if by is None:
                v = V(x, kind)
            else:
                elements = self.model.types[kind[4:]].elements if kind.startswith("Row:") else {}
                row = {n: V(x[n], elements[n][1]) for n in elements if n in self.names}
                v = self.expr(by, {**env, "$row": row})
            return v.col["lo"] if v.kind == "Date" else v.col["value"] if v.kind == "Quantity" else v.col

        # Ties keep the order of the input: the position is the last sort key. Nulls come first, or last if descending.
        kind_ = lambda i: -i if descending else i
        keyed = F.transform(items, lambda x, i: F.struct(key(x).isNotNull().alias("known"), key(x).alias("k"), kind_(i).alias("i")))
        return F.transform(F.sort_array(keyed, not descending), lambda s: F.get(items, F.abs(s["i"])))

    # Functions.

    def _call(self, e, env):
        name, args = e[1], e[2]
        if len(args) == 1 and name in _OVER_ROWS and (found := self._relation(args[0], env)) is not None:
            rows, kind = found
            fn, out = _OVER_ROWS[name]
            return V(rows.agg(fn(F.col("v"))).scalar(), out or kind)
        if name in ("Exists", "exists"):
            fused = self._fused(args[0], env)
            if fused:
                return V(F.coalesce(self._agg(fused[0], F.some(fused[1]), "flag", fused[1]), F.lit(False)), "Boolean")
            return V(lists.exists(self.expr(args[0], env).col), "Boolean")
        if name == "Count":
            fused = self._fused(args[0], env, True)
            if fused:
                return V(F.coalesce(self._agg(fused[0], F.count_if(fused[1]), "count", fused[1]), F.lit(0)), "Integer")
        if (name, len(args)) in self.lib.functions:
            names, body = self.lib.functions[name, len(args)]
            return self.expr(body, {**env, **{n: self.expr(a, env) for n, a in zip(names, args, strict=True)}})
        if m := re.fullmatch(r"(?:Calculate)?AgeIn(Year|Month|Week|Day|Hour|Minute|Second)s(At)?", name):
            args = list(args)
            birth = self.expr(args.pop(0), env).col if name.startswith("Calculate") else self._ref(("ref", self.model.subject), env).col["birthDate"]
            at = self.expr(args[0], env).col if m[2] else temporal.literal(self.now if m[1] in ("Hour", "Minute", "Second") else self.now[:10])
            if m[1] == "Week":
                return V(arithmetic.truncated_divide(temporal.duration_between(birth, at, "day"), F.lit(7)), "Integer")
            return V(temporal.duration_between(birth, at, m[1].lower()), "Integer")
        if name == "TimeOfDay":
            return V(convert.to_time(F.lit((self.now[11:] or "00:00:00")[:12])), "Time")
        if name == "Today":
            return V(temporal.literal(self.now[:10]), "Date")
        if name == "Now":
            return V(temporal.literal(self.now), "Date")
        vals = [self.expr(a, env) for a in args]
        fn = _FUNCTIONS.get(name)
        if fn is None:
            raise CqlError(f"unknown function {name}")
        return fn(self, *vals)

    def membership(self, x: V, name: str, env: dict) -> V:
        """x in a list of the Unfiltered context: a join of the rows' table with the list's values."""
        if env.get("$pair"):
            raise _NeedsSubject
        type_ = env.get("$rowonly")
        found = self._relation(("ref", name), {})
        if found is None:
            raise CqlError(f"{name} is no list")
        members = found[0].select(F.col("v").alias("__m")).distinct()
        joins = self.joins.setdefault(type_, []) if type_ else self.flags
        if env and not type_:
            raise CqlError(f"{name} can be used in conditions of exists and Count, and on subjects")
        return V(self._flag(joins, x.col, members, lambda k: F.col("__m") == k), "Boolean")

    # Plans.

    def _rows(self, type_: str, flags: list[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
        df = self.model.types[type_].df
        for add in self.joins.get(type_, []) if flags is None else flags:
            df = add(df)
        return df

    def plan(self, names: list[str]) -> DataFrame:
        """(id, one column for each definition) of every subject."""
        cols = [self.define(n).col.alias(n) for n in names]
        s = self.model.types[self.model.subject]
        base = s.df.select(s.elements["id"][0].alias("__id"), self._struct(self.model.subject).alias("__subject"))
        # The subjects' own rows first: keys of other resources' rows can depend on them.
        for (type_, key), aggs in sorted(self.aggs.items(), key=lambda x: (x[0][1] is not None, list(self.keys).index(x[0][1]) if x[0][1] else 0)):
            rows = self._rows(type_).where(_any(self.tests[type_, key]))  # rows that no aggregate counts are not shuffled
            own, ref = (F.col("__id"), self.model.types[type_].subject) if key is None else self.keys[key]
            per = rows.groupBy(ref.alias("__ref")).agg(*[a.alias(n) for n, a in aggs.items()])
            base = base.join(per, own == F.col("__ref"), "left").drop("__ref")
        for add in self.flags:
            base = add(base)
        return base.select(F.col("__id").alias("id"), *cols)

    def rows_plan(self, define: str, functions: list[str]) -> DataFrame:
        """Population of resources: one row for each resource that a definition returns, with stratifier functions on it."""
        tree = self.lib.defines[define][1]
        fused = self._fused(tree, {})
        if fused is None:
            v = self.define(define)
            base = self.plan([define]).select("id", F.explode(define).alias("__row"))
            row = V(F.col("__row"), item_kind(v.kind))
        else:
            base = self._rows(fused[0]).where(fused[1])
            base = base.select(self.model.types[fused[0]].subject.alias("id"), self._struct(fused[0]).alias("__row"))
            row = V(F.col("__row"), f"Row:{fused[0]}")
        cols = []
        for f in functions:
            names, body = self.lib.functions[f, 1]
            cols.append(self.expr(body, {names[0]: row, "$rowonly": row.kind[4:]}).col.alias(f))
        return base.select("id", *cols)


def _negated(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: ~test(x)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _logic(fn):
    return lambda self, e, env: V(fn(self.expr(e[1], env).col.cast("boolean"), self.expr(e[2], env).col.cast("boolean")), "Boolean")


def _compare(self: Compiler, e, env) -> V:
    a, b = self.expr(e[1], env), self.expr(e[2], env)
    if e[0] == "!=":
        return V(~self.compare("=", a, b), "Boolean")
    if e[0] == "!~":
        return V(~self.compare("~", a, b), "Boolean")
    return V(self.compare(e[0], a, b), "Boolean")


def _arith(self: Compiler, e, env) -> V:
    a, b, op = self.expr(e[1], env), self.expr(e[2], env), e[0]
    if b.kind.startswith("Period:"):
        unit, n = b.kind[7:], b.col
        if unit == "week":
            unit, n = "day", n * 7
        return V(temporal.add(a.col, -n if op == "-" else n, unit), "Date")
    if op == "&" or "String" in (a.kind, b.kind):
        if op == "&":
            return V(F.concat(F.coalesce(a.col, F.lit("")), F.coalesce(b.col, F.lit(""))), "String")
        return V(F.concat(a.col, b.col), "String")
    if a.kind == "Quantity":
        return V({"+": quantity.add, "-": quantity.subtract}[op](a.col, b.col), "Quantity")
    if op == "/":
        return V(arithmetic.divide(a.col, b.col), "Decimal")
    if op in ("div", "mod"):
        return V({"div": arithmetic.truncated_divide, "mod": arithmetic.modulo}[op](a.col, b.col), a.kind)
    if op == "^":
        return V(arithmetic.power(a.col, b.col), "Decimal")
    if a.kind == b.kind == "Integer":
        return V({"+": arithmetic.add, "-": arithmetic.subtract, "*": arithmetic.multiply}[op](a.col, b.col), "Integer")
    return V({"+": arithmetic.add_decimal, "-": arithmetic.subtract_decimal, "*": arithmetic.multiply_decimal}[op](a.col, b.col), "Decimal")


def _points(self: Compiler, v: V) -> V:
    """A point as an interval of itself."""
    return v if v.kind.startswith("Interval<") else V(F.struct(v.col.alias("low"), v.col.alias("high")), f"Interval<{v.kind}>")


def _timing(self: Compiler, e, env) -> V:
    op, a_, b_, precision = e
    a = self.expr(a_, env)
    b = self.expr(b_, env) if not (b_[0] == "ref" and b_[1] in (*self.lib.valuesets, *self.lib.codesystems)) else None
    if op in ("in", "includedin") and b is None:
        if env.get("$pair"):
            raise _NeedsSubject
        if env and not env.get("$rowonly"):
            raise CqlError("value sets and code systems can be asked for in retrieves, in conditions of exists and Count, and on subjects")
        source = self.model.value_sets if b_[1] in self.lib.valuesets else self.model.code_systems
        if source is None:
            raise CqlError("no terminology")
        codes = source((self.lib.valuesets.get(b_[1]) or self.lib.codesystems[b_[1]]))
        return V(self._member(env.get("$rowonly"), a.col, a.kind if a.kind in ("String", "Code") else "List<Code>", codes), "Boolean")
    if op == "in" and b.kind.startswith("Unfiltered:"):
        return self.membership(a, b.kind[11:], env)
    if b.kind.startswith("List<") or a.kind.startswith("List<"):
        if op in ("in", "includedin") and b.kind.startswith("List<") and not a.kind.startswith("List<"):
            if a.kind in ("Code", "Concept"):
                return V(self._codes_equal(a, V(b.col, "List<Code>")), "Boolean")
            return V(lists.contains(b.col, a.col), "Boolean")
        if op == "contains":
            return V(lists.contains(a.col, b.col), "Boolean")
        fn = {"includes": lists.includes, "includedin": lambda x, y: lists.includes(y, x), "properincludes": lists.proper_includes, "propercontains": lists.proper_contains}[op]
        return V(fn(a.col, b.col), "Boolean")
    a, b = _points(self, a), _points(self, b)
    kind = item_kind(a.kind)
    if kind == "Date":
        # Full bounds of what the ends can mean; a null end makes the answer null.
        p = precision.rstrip("s") if precision else None
        le = lambda x, y: temporal.same_or_before(x, y, p)
        lt = lambda x, y: temporal.before(x, y, p)
        eq = lambda x, y: temporal.same_as(x, y, p)
        prev = temporal.predecessor
    else:
        le, lt, eq = ((lambda x, y, o=o: self.compare(o, V(x, kind), V(y, kind))) for o in ("<=", "<", "="))
        prev = _PREV.get(kind, _PREV["Integer"])

    def build(x: Column, y: Column) -> Column:
        al, ah, bl, bh = x["low"], x["high"], y["low"], y["high"]
        return {
            "before": lambda: lt(ah, bl),
            "after": lambda: lt(bh, al),
            "sameas": lambda: eq(al, bl) & eq(ah, bh),
            "sameorbefore": lambda: le(ah, bl),
            "sameorafter": lambda: le(bh, al),
            "includedin": lambda: le(bl, al) & le(ah, bh),
            "in": lambda: le(bl, al) & le(ah, bh),
            "properincludedin": lambda: le(bl, al) & le(ah, bh) & (lt(bl, al) | lt(ah, bh)),
            "properin": lambda: lt(bl, al) & lt(ah, bh),
            "includes": lambda: le(al, bl) & le(bh, ah),
            "contains": lambda: le(al, bl) & le(bh, ah),
            "properincludes": lambda: le(al, bl) & le(bh, ah) & (lt(al, bl) | lt(bh, ah)),
            "propercontains": lambda: lt(al, bl) & lt(bh, ah),
            "overlaps": lambda: le(bl, ah) & le(al, bh),
            "overlapsbefore": lambda: lt(al, bl) & lt(bl, ah),
            "overlapsafter": lambda: lt(al, bh) & lt(bh, ah),
            "starts": lambda: eq(al, bl) & le(ah, bh),
            "ends": lambda: le(bl, al) & eq(ah, bh),
            "meetsbefore": lambda: eq(ah, prev(bl)),
            "meetsafter": lambda: eq(bh, prev(al)),
            "meets": lambda: eq(ah, prev(bl)) | eq(bh, prev(al)),
        }[op]()

    return V(let(build, a.col, b.col), "Boolean")


def _sets(self: Compiler, e, env) -> V:
    a, b = self.expr(e[1], env), self.expr(e[2], env)
    if a.kind.startswith("Interval<"):
        return V({"union": intervals.union, "intersect": intervals.intersect, "except": intervals.except_}[e[0]](a.col, b.col), a.kind)
    return V({"union": lists.union, "intersect": lists.intersect, "except": lists.except_}[e[0]](a.col, b.col), a.kind)


def _between(self: Compiler, e, env) -> V:
    a, b = self.expr(e[1], env).col, self.expr(e[2], env).col
    fn = temporal.duration_between if e[0] == "duration" else temporal.difference_between
    if e[3].rstrip("s") == "week":
        return V(arithmetic.truncated_divide(fn(a, b, "day"), F.lit(7)), "Integer")
    return V(fn(a, b, e[3].rstrip("s")), "Integer")


def _as(self: Compiler, e, env) -> V:
    v, kind = self.expr(e[1], env), {"DateTime": "Date", "CodeableConcept": "Concept"}.get(e[2], e[2])
    ok = v.kind == kind or v.kind == f"Row:{kind}"
    if e[0] == "is":
        return V(v.col.isNotNull() if ok else F.lit(False), "Boolean")
    return v if ok else V(F.lit(None), kind)


_OPERATORS: dict[str, Callable] = {
    "and": _logic(lambda a, b: a & b),
    "or": _logic(lambda a, b: a | b),
    "xor": _logic(lambda a, b: a != b),
    "implies": _logic(lambda a, b: ~a | b),
    "not": lambda self, e, env: V(~self.expr(e[1], env).col.cast("boolean"), "Boolean"),
    "isnull": lambda self, e, env: V(self.expr(e[1], env).col.isNull(), "Boolean"),
    "istrue": lambda self, e, env: V(self.expr(e[1], env).col.eqNullSafe(F.lit(True)), "Boolean"),
    "isfalse": lambda self, e, env: V(self.expr(e[1], env).col.eqNullSafe(F.lit(False)), "Boolean"),
    "negate": lambda self, e, env: (lambda v: V(arithmetic.negate(v.col), v.kind))(self.expr(e[1], env)),
    "component": lambda self, e, env: V(temporal.component(self.expr(e[1], env).col, e[2]), "Integer"),
    "duration": _between,
    "difference": _between,
    "as": _as,
    "is": _as,
}
_OPERATORS |= dict.fromkeys(("=", "!=", "~", "!~", "<", ">", "<=", ">="), _compare)
_OPERATORS |= dict.fromkeys(("+", "-", "*", "/", "div", "mod", "&", "^"), _arith)
_OPERATORS |= dict.fromkeys(("union", "intersect", "except"), _sets)
_OPERATORS |= dict.fromkeys(
    [
        "before", "after", "sameas", "sameorbefore", "sameorafter", "includedin", "in", "properincludedin", "properin", "includes", "contains", "properincludes", "propercontains", "overlaps", "overlapsbefore", "overlapsafter",
        "starts", "ends", "meetsbefore", "meetsafter", "meets",
    ],
    _timing,
)


def _list_fn(fn, kind=None):
    return lambda self, a, *rest: V(fn(a.col, *[r.col for r in rest]), kind or item_kind(a.kind))


#: Aggregates over the values of a list that belongs to no subject, and the kind of the result (None: that of the values).
_OVER_ROWS: dict[str, tuple[Callable[[Column], Column], str | None]] = {
    "Exists": (lambda v: F.count(v) > 0, "Boolean"),
    "exists": (lambda v: F.count(v) > 0, "Boolean"),
    "Count": (aggregates.count, "Integer"),
    "Sum": (F.sum, None),
    "Min": (F.min, None),
    "Max": (F.max, None),
    "Avg": (aggregates.avg, "Decimal"),
    "Median": (aggregates.median, "Decimal"),
    "Mode": (aggregates.mode, None),
    "Product": (aggregates.product, "Decimal"),
    "GeometricMean": (lambda v: F.nullif(aggregates.geometric_mean(v), F.lit(float("nan"))), "Decimal"),
    "Variance": (aggregates.variance, "Decimal"),
    "StdDev": (aggregates.stddev, "Decimal"),
    "PopulationVariance": (aggregates.population_variance, "Decimal"),
    "PopulationStdDev": (aggregates.population_stddev, "Decimal"),
    "AllTrue": (lambda v: F.coalesce(F.every(v), F.lit(True)), "Boolean"),
    "AnyTrue": (lambda v: F.coalesce(F.some(v), F.lit(False)), "Boolean"),
}


def _sum(self: Compiler, a: V) -> V:
    """Of quantities: in the unit of the first, null if a unit does not convert."""
    if item_kind(a.kind) == "Quantity":
        sized = lambda q: F.struct(q["value"].cast("decimal(28,8)").alias("value"), q["unit"].cast("string").alias("unit"))
        items = F.transform(F.filter(a.col, lambda q: q["value"].isNotNull()), sized)
        return V(F.reduce(F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), F.get(items, F.lit(0)), lambda x, y: sized(quantity.add(x, y))), "Quantity")
    return V(lists.sum_(a.col, "long" if item_kind(a.kind) == "Integer" else "decimal(28,8)"), item_kind(a.kind))


def _flatten(self: Compiler, a: V) -> V:
    """Lists of any depth; items that are no lists stay."""
    inner = item_kind(a.kind)
    return _flatten(self, V(F.flatten(a.col), inner)) if inner.startswith("List<") else a


def _converts(kind: str) -> Callable[..., V]:
    own = {"Date": ("Date",), "DateTime": ("Date",), "Quantity": ("Quantity",), "Time": ("Time",), "Ratio": ("Ratio",)}

    def run(self: Compiler, a: V) -> V:
        if a.kind in own.get(kind, ()):
            return V(F.when(a.col.isNotNull(), F.lit(True)), "Boolean")
        if kind == "String":
            known = a.kind in ("Boolean", "Integer", "Long", "Decimal", "String", "Date", "Time", "Quantity", "Ratio")
            return V(F.when(a.col.isNotNull(), F.lit(known)), "Boolean")
        if a.kind in ("Date", "Time", "Quantity", "Ratio", "Code", "Concept", "Tuple") or "<" in a.kind or ":" in a.kind:
            return V(F.when(a.col.isNotNull(), F.lit(False)), "Boolean")
        return V(convert.converts_to(a.col, kind), "Boolean")

    return run


_FUNCTIONS: dict[str, Callable[..., V]] = {
    "First": _list_fn(lists.first),
    "Last": _list_fn(lists.last),
    "Count": _list_fn(lists.count, "Integer"),
    "Sum": _sum,
    "Slice": lambda self, a, s, e=None: V(lists.slice_(a.col, s.col, e.col if e else None), a.kind),
    "Skip": lambda self, a, n: V(lists.slice_(a.col, n.col), a.kind),
    "Tail": lambda self, a: V(lists.slice_(a.col, F.lit(1)), a.kind),
    "Take": lambda self, a, n: V(lists.slice_(a.col, F.lit(0), F.coalesce(n.col, F.lit(0))), a.kind),
    "ToList": lambda self, a: V(lists.to_list(a.col), f"List<{a.kind}>"),
    "ToChars": lambda self, a: V(strings.to_chars(a.col), "List<String>"),
    "ToLong": lambda self, a: V(convert.to_long(a.col), "Integer"),
    "ToTime": lambda self, a: a if a.kind == "Time" else V(convert.to_time(a.col), "Time"),
    "Time": lambda self, *a: V(temporal.time(*[x.col for x in a]), "Time"),
    "ToRatio": lambda self, a: a if a.kind == "Ratio" else V(convert.to_ratio(a.col), "Ratio"),
    "ConvertQuantity": lambda self, a, u: V(quantity.convert(a.col, u.static), "Quantity"),
    "CanConvertQuantity": lambda self, a, u: V(F.when(a.col.isNotNull(), F.coalesce(quantity.can_convert(a.col, u.static), F.lit(False))), "Boolean"),
    "Children": lambda self, a: V(F.when(a.col.isNotNull(), F.array(a.col["code"], F.lit(None).cast("string"), a.col["system"], F.lit(None).cast("string"))), "List<String>"),
    "Descendents": lambda self, a: V(F.when(a.col.isNotNull(), F.array(a.col["code"], F.lit(None).cast("string"), a.col["system"], F.lit(None).cast("string"))), "List<String>"),
    "Avg": lambda self, a: V(lists.avg(a.col), "Decimal"),
    "Min": _list_fn(lists.min_),
    "Max": _list_fn(lists.max_),
    "Median": _list_fn(lists.median, "Decimal"),
    "Mode": _list_fn(lists.mode),
    "AllTrue": _list_fn(lists.all_true, "Boolean"),
    "AnyTrue": _list_fn(lists.any_true, "Boolean"),
    "Product": lambda self, a: V(lists.product(a.col), "Decimal"),
    "GeometricMean": _list_fn(lists.geometric_mean, "Decimal"),
    "Variance": _list_fn(lists.variance, "Decimal"),
    "StdDev": _list_fn(lists.stddev, "Decimal"),
    "PopulationVariance": _list_fn(lists.population_variance, "Decimal"),
    "PopulationStdDev": _list_fn(lists.population_stddev, "Decimal"),
    "Distinct": lambda self, a: V(lists.distinct(a.col), a.kind),
    "Flatten": _flatten,
    "SingletonFrom": _list_fn(lists.singleton_from),
    "IndexOf": _list_fn(lists.index_of, "Integer"),
    "Length": lambda self, a: V(F.coalesce(F.size(a.col), F.lit(0)) if a.kind.startswith("List<") else strings.length(a.col), "Integer"),
    "Collapse": lambda self, a: V(intervals.collapse(a.col), a.kind),
    "StartOf": lambda self, a: V(a.col["low"], item_kind(a.kind)),
    "EndOf": lambda self, a: V(a.col["high"], item_kind(a.kind)),
    "WidthOf": lambda self, a: V(intervals.width(a.col), item_kind(a.kind)),
    "PointFrom": lambda self, a: V(intervals.point_from(a.col), item_kind(a.kind)),
    "DateFrom": lambda self, a: V(temporal.date_from(a.col), "Date"),
    "SuccessorOf": lambda self, a: V(temporal.successor(a.col) if a.kind == "Date" else arithmetic.successor(a.col, a.kind), a.kind),
    "PredecessorOf": lambda self, a: V(temporal.predecessor(a.col) if a.kind == "Date" else arithmetic.predecessor(a.col, a.kind), a.kind),
    "Coalesce": lambda self, *a: V(F.coalesce(*[x.col for x in a]) if len(a) > 1 else F.get(F.array_compact(a[0].col), F.lit(0)), a[0].kind if len(a) > 1 else item_kind(a[0].kind)),
    "Date": lambda self, *a: V(temporal.construct(*[x.col for x in a]), "Date"),
    "DateTime": lambda self, *a: V(temporal.construct(*[x.col for x in a[:7]]), "Date"),
    "Abs": lambda self, a: V(arithmetic.absolute(a.col), a.kind),
    "Ceiling": lambda self, a: V(arithmetic.ceiling(a.col), "Integer"),
    "Floor": lambda self, a: V(arithmetic.floor(a.col), "Integer"),
    "Truncate": lambda self, a: V(arithmetic.truncate(a.col), "Integer"),
    "Round": lambda self, a, n=None: V(arithmetic.round_(a.col, n.static if n else 0), "Decimal"),
    "Ln": lambda self, a: V(arithmetic.ln(a.col), "Decimal"),
    "Exp": lambda self, a: V(arithmetic.exp(a.col), "Decimal"),
    "Log": lambda self, a, b: V(arithmetic.log(a.col, b.col), "Decimal"),
    "Power": lambda self, a, b: V(arithmetic.power(a.col, b.col), "Decimal"),
    "Combine": lambda self, a, s=None: V(strings.combine(a.col, s.static if s else ""), "String"),
    "Split": lambda self, a, s: V(strings.split(a.col, s.static), "List<String>"),
    "Upper": lambda self, a: V(strings.upper(a.col), "String"),
    "Lower": lambda self, a: V(strings.lower(a.col), "String"),
    "StartsWith": lambda self, a, b: V(strings.starts_with(a.col, b.col), "Boolean"),
    "EndsWith": lambda self, a, b: V(strings.ends_with(a.col, b.col), "Boolean"),
    "Matches": lambda self, a, b: V(strings.matches(a.col, b.static), "Boolean"),
    "ReplaceMatches": lambda self, a, b, c: V(strings.replace_matches(a.col, b.static, c.static), "String"),
    "Substring": lambda self, a, s, n=None: V(strings.substring(a.col, s.col.cast("int"), n.col.cast("int") if n else None), "String"),
    "PositionOf": lambda self, p, a: V(strings.position_of(p.col, a.col), "Integer"),
    "LastPositionOf": lambda self, p, a: V(strings.last_position_of(p.col, a.col), "Integer"),
    "ToString": lambda self, a: V(temporal.to_string(a.col) if a.kind == "Date" else quantity.to_string(a.col) if a.kind == "Quantity" else a.col.cast("string"), "String"),
    "ToInteger": lambda self, a: V(convert.to_integer(a.col), "Integer"),
    "ToDecimal": lambda self, a: V(convert.to_decimal(a.col), "Decimal"),
    "ToBoolean": lambda self, a: V(convert.to_boolean(a.col), "Boolean"),
    "ToDate": lambda self, a: a if a.kind == "Date" else V(convert.to_date(a.col), "Date"),
    "ToDateTime": lambda self, a: a if a.kind == "Date" else V(convert.to_datetime(a.col), "Date"),
    "ToQuantity": lambda self, a: a if a.kind == "Quantity" else V(convert.to_quantity(a.col), "Quantity"),
    "ToConcept": lambda self, a: a if a.kind == "Concept" else V(F.array(a.col), "Concept"),
    "ToCode": lambda self, a: V(F.get(a.col, F.lit(0)), "Code") if a.kind in ("Concept", "List<Code>") else a,
    "ToInterval": lambda self, a: a if a.kind.startswith("Interval<") else _points(self, a),
    **{f"ConvertsTo{k}": _converts(k) for k in ("Boolean", "Date", "DateTime", "Decimal", "Long", "Integer", "Quantity", "Ratio", "String", "Time")},
}
