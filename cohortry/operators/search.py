"""Typed search: parameters become Column predicates, chains become semi-joins, pages become keyset filters.

A registry maps each resource type to its parameters. A parameter's extractor gives an array of values per resource:
token struct(system, code); string text; date struct(lo, hi) in seconds; number decimal; quantity struct(value, unit,
system, code); reference struct(type, id); uri text; near struct(lat, lon)."""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.strings import normalized, phonetic
from cohortry.operators.lineage import cut

PREFIX = re.compile(r"^(eq|ne|gt|lt|ge|le|sa|eb|ap)(.*)$", re.S)
PAGE_SIZE, MAX_PAGE_SIZE, MAX_INCLUDES, MAX_STACK = 50, 10_000, 10_000, 10


class SearchError(ValueError):
    """A query that cannot be answered."""


def split_prefix(text: str) -> tuple[str, str]:
    m = PREFIX.match(text)
    return (m[1], m[2]) if m else ("eq", text)


# Values of parameters, parsed on the driver.


def split_escaped(text: str, separator: str) -> list[str]:
    """Parts between separators that no backslash escapes; escapes stay."""
    parts, at = [""], 0
    while at < len(text):
        c = text[at]
        if c == "\\" and at + 1 < len(text):
            parts[-1] += text[at : at + 2]
            at += 2
            continue
        if c == separator:
            parts.append("")
        else:
            parts[-1] += c
        at += 1
    return parts


def unescape(text: str) -> str:
    """Text without the backslashes that escape a separator or a backslash."""
    return re.sub(r"\\([,$|\\])", r"\1", text)


def date_range(text: str) -> tuple[int, int]:
    """First and last second that a date text of any precision can mean, in UTC."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?)?)?", text)
    if not m:
        raise SearchError(f"not a date: {text}")
    y, mo, d, h, mi, s, z = m.groups()
    try:
        start = datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), tzinfo=timezone.utc)
    except ValueError as e:
        raise SearchError(f"not a date: {text}") from e
    if z and z != "Z":
        start -= timedelta(minutes=int(z[:3]) * 60 + int(z[0] + z[4:]))
    if s:
        size = 1
    elif mi:
        size = 60
    elif d:
        size = 86400
    elif mo:
        size = 86400 * calendar.monthrange(int(y), int(mo))[1]
    else:
        size = 86400 * (366 if calendar.isleap(int(y)) else 365)
    lo = int((start - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds())
    return lo, lo + size - 1


def half_unit(text: str) -> Decimal:
    """Half a unit of the last digit given."""
    return Decimal(5).scaleb(Decimal(text).as_tuple().exponent - 1)


# Predicates on arrays of values. A resource matches if any of its values does.


@dataclass(frozen=True)
class One:
    """The value of a parameter that has one value at most: its tests are plain comparisons, which reach the scan.

    key (references): the target's id as the table has it, for joins and comparisons without a cast."""

    col: Column
    key: Column | None = None


def any_(values: Column | One, test: Callable[[Column], Column]) -> Column:
    """Some value passes; for one value, the test itself (null, like false, selects nothing)."""
    if isinstance(values, One):
        return test(values.col)
    return F.coalesce(F.exists(values, test), F.lit(False))


def token(values: Column | One, text: str) -> Column:
    """code | system|code | |code (no system) | system| (any code)."""
    *systems, code = split_escaped(text, "|")
    system, code = unescape("|".join(systems)), unescape(code)
    if not systems:
        return any_(values, lambda v: v["code"] == code)
    if not system:
        return any_(values, lambda v: v["system"].isNull() & (v["code"] == code))
    if not code:
        return any_(values, lambda v: v["system"] == system)
    return any_(values, lambda v: (v["system"] == system) & (v["code"] == code))


def string(values: Column | One, text: str) -> Column:
    """Prefix match of normalised text."""
    return any_(values, lambda v: F.startswith(normalized(v), normalized(F.lit(text))))


def sounds_like(values: Column | One, text: str) -> Column:
    return any_(values, lambda v: phonetic(v) == phonetic(F.lit(text)))


def uri(values: Column | One, text: str, below: bool = False) -> Column:
    if not below:
        return any_(values, lambda v: (v == text) | (F.split_part(v, F.lit("|"), F.lit(1)) == text))
    return any_(values, lambda v: (v == text) | F.startswith(v, F.lit(text + ".")) | F.startswith(v, F.lit(text + "|")) | F.startswith(v, F.lit(text.rstrip("/") + "/")))


def date_test(op: str, lo: int, hi: int) -> Callable[[Column], Column]:
    """The test of a value [v.lo, v.hi] against [lo, hi]; `eq` means that the value lies within."""
    tests: dict[str, Callable[[Column], Column]] = {
        "eq": lambda v: (v["lo"] >= lo) & (v["hi"] <= hi),
        "ne": lambda v: ~((v["lo"] >= lo) & (v["hi"] <= hi)),
        "gt": lambda v: v["hi"] > hi,
        "lt": lambda v: v["lo"] < lo,
        "ge": lambda v: (v["hi"] >= hi) | (v["lo"] >= lo),
        "le": lambda v: (v["lo"] <= lo) | (v["hi"] <= hi),
        "sa": lambda v: v["lo"] >= hi,
        "eb": lambda v: v["hi"] <= lo,
        "ap": lambda v: (v["lo"] <= hi) & (v["hi"] >= lo),
    }
    return tests[op]


def date(values: Column | One, text: str) -> Column:
    op, rest = split_prefix(text)
    return any_(values, date_test(op, *date_range(rest)))


def _number_test(text: str) -> Callable[[Column], Column]:
    op, rest = split_prefix(text)
    try:
        n, half = Decimal(rest), half_unit(rest)
    except ArithmeticError as e:
        raise SearchError(f"not a number: {rest}") from e
    lit = lambda d: F.lit(str(d)).cast("decimal(28,8)")
    tests: dict[str, Callable[[Column], Column]] = {
        "eq": lambda v: (v >= lit(n - half)) & (v <= lit(n + half)),
        "gt": lambda v: v > lit(n),
        "lt": lambda v: v < lit(n),
        "ge": lambda v: v >= lit(n),
        "le": lambda v: v <= lit(n),
    }
    if op not in tests:
        raise SearchError(f"unsupported prefix {op}")
    return tests[op]


def number(values: Column | One, text: str) -> Column:
    return any_(values, _number_test(text))


def quantity_test(text: str) -> Callable[[Column], Column]:
    """[prefix]value[|[system]|unit]: the unit is matched as a code of the system, or as code or unit without one."""
    value, *unit = map(unescape, split_escaped(text, "|"))
    test = _number_test(value)
    if not unit or not unit[-1]:
        return lambda v: test(v["value"])
    if len(unit) == 2 and unit[0]:
        return lambda v: test(v["value"]) & (v["system"] == unit[0]) & (v["code"] == unit[1])
    return lambda v: test(v["value"]) & (F.coalesce(v["code"] == unit[-1], F.lit(False)) | F.coalesce(v["unit"] == unit[-1], F.lit(False)))


def quantity(values: Column | One, text: str) -> Column:
    return any_(values, quantity_test(text))


def reference(values: Column | One, text: str, target: str | None = None) -> Column:
    """Type/id, or an id alone."""
    type_, slash, id_ = text.rpartition("/")
    kind = type_.rpartition("/")[2] if slash else target
    if isinstance(values, One) and values.key is not None:
        # Integers are compared as such, so that the test reaches the scan; other texts name no row.
        same = values.key == F.lit(int(id_)) if re.fullmatch(r"0|-?[1-9]\d{0,17}", id_) else F.lit(False)
        return same & (values.col["type"] == kind) if kind else same
    if kind:
        return any_(values, lambda v: (v["type"] == kind) & (v["id"] == id_))
    return any_(values, lambda v: v["id"] == id_)


def haversine_km(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(lat0))) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def near(values: Column | One, text: str) -> Column:
    """lat|lon[|distance[|km or m]], 1 km by default."""
    lat, lon, *rest = text.split("|")
    far = float(rest[0]) if rest and rest[0] else 1.0
    if len(rest) > 1 and rest[1] == "m":
        far /= 1000
    return any_(values, lambda v: haversine_km(v["lat"], v["lon"], float(lat), float(lon)) <= far)


def composite(elements: Column | One, first: Callable[[Column], Column], second: Callable[[Column], Column]) -> Column:
    """Both tests hold in the same element."""
    return any_(elements, lambda e: first(e) & second(e))


# Extractors for common element shapes.


def codings(concept: Column) -> Column:
    return F.transform(concept["coding"], lambda c: F.struct(c["system"].alias("system"), c["code"].alias("code")))


def code(value: Column, system: str | None = None) -> One:
    """A code element: one token."""
    return One(F.struct(F.lit(system).cast("string").alias("system"), value.cast("string").alias("code")))


def reference_value(ref: Column) -> Column:
    text = ref["reference"]
    n = F.size(F.split(text, "/"))
    return F.when(text.contains("/"), F.array(F.struct(F.get(F.split(text, "/"), n - 2).alias("type"), F.get(F.split(text, "/"), n - 1).alias("id"))))


def seconds(value: Column) -> Column:
    """A partial date (struct lo, hi, p) as a date value."""
    unix = lambda c: F.unix_seconds(c.cast("timestamp"))
    return F.when(value.isNotNull(), F.array(F.struct(unix(value["lo"]).alias("lo"), unix(value["hi"]).alias("hi"))))


def instant(ts: Column, unit: str | None = None) -> One:
    """A timestamp as a date value: itself, or the day, month or year that it stands for."""
    lo = F.unix_seconds(ts.cast("timestamp"))
    if unit is None:
        return One(F.struct(lo.alias("lo"), lo.alias("hi")))
    start = F.date_trunc(unit, ts)
    return One(F.struct(F.unix_seconds(start.cast("timestamp")).alias("lo"), (F.unix_seconds(F.timestamp_add(unit.upper(), F.lit(1), start).cast("timestamp")) - 1).alias("hi")))


@dataclass(frozen=True)
class Param:
    """kind: token, string, date, number, quantity, reference, uri, near, phonetic or composite.

    targets: types that a reference can have. parts (composite): kinds and names of the fields of an element.
    identifier (reference): the identifier tokens of a reference, for `:identifier`."""

    kind: str
    values: Callable[[], Column | One]
    targets: tuple[str, ...] = ()
    parts: tuple[tuple[str, str], ...] = ()
    identifier: Callable[[], Column | One] | None = None


MODIFIERS = {"token": {"in"}, "reference": {"identifier"}, "uri": {"below"}}


@dataclass
class Registry:
    """tables: a DataFrame by type, with a column `id`. compartment: by type, the parameter that holds the subject.

    native: by type, the column that holds the id as the keys of references do. at: the registry of another time t, of
    the newest where t is None; t: the time that this one shows."""

    tables: Mapping[str, DataFrame]
    params: dict[str, dict[str, Param]]
    compartment: dict[str, str] = field(default_factory=dict)
    subject: str = "Patient"
    value_sets: Callable[[str], DataFrame] | None = None  # url -> (system, code)
    last_updated: dict[str, str] = field(default_factory=dict)  # by type, a timestamp column
    native: dict[str, str] = field(default_factory=dict)
    at: Callable[[int | None], Registry] | None = None
    t: int | None = None

    def param(self, type_: str, code_: str) -> Param:
        if code_ == "_id":
            return Param("token", lambda: code(F.col("id")))
        if code_ == "_lastUpdated" and type_ in self.last_updated:
            return Param("date", lambda: instant(F.col(self.last_updated[type_])))
        p = self.params.get(type_, {}).get(code_)
        if p is None:
            raise SearchError(f"unknown parameter {code_} of {type_}")
        return p

    def predicate(self, type_: str, name: str, values: list[str]) -> Column:
        """One clause: the values are alternatives."""
        code_, _, modifier = name.partition(":")
        p = self.param(type_, code_)
        if modifier and modifier not in MODIFIERS.get(p.kind, set()) and not (p.kind == "reference" and modifier in p.targets):
            raise SearchError(f"unsupported modifier {modifier} of {code_}")
        cols = p.values()
        simple = {"token": token, "string": string, "date": date, "number": number, "quantity": quantity, "near": near, "phonetic": sounds_like}
        out = F.lit(False)
        for v in values:
            if p.kind == "reference" and modifier == "identifier":
                if p.identifier is None:
                    raise SearchError(f"{code_} of {type_} has no identifiers")
                out = out | token(p.identifier(), v)
            elif p.kind == "reference":
                out = out | reference(cols, unescape(v), modifier or (p.targets[0] if len(p.targets) == 1 else None))
            elif p.kind == "uri":
                out = out | uri(cols, unescape(v), modifier == "below")
            elif p.kind == "composite":
                tests = []
                for (kind, name_), text in zip(p.parts, split_escaped(v, "$"), strict=True):
                    if kind == "token":
                        tests.append(lambda e, n=name_, t=text: token(One(e[n]) if isinstance(cols, One) else e[n], t))
                    else:
                        tests.append(lambda e, n=name_, q=quantity_test(text): q(e[n]))
                out = out | composite(cols, *tests)
            else:
                out = out | simple[p.kind](cols, v if p.kind in ("token", "quantity", "near") else unescape(v))
        return out

    def search(self, type_: str, clauses: list[tuple[str, list[str]]], lenient: bool = False) -> DataFrame:
        """Resources that match all clauses. Simple clauses are one filter; each hop of a chain is one semi-join."""
        df = self.tables[type_]
        joins: list[tuple[str, list[str]]] = []
        keep = None
        for name, values in clauses:
            if name.startswith("_has:") or "." in name or name == "_list" or name.endswith(":in"):
                joins.append((name, values))
                continue
            known = name.startswith("_") or name.partition(":")[0] in self.params.get(type_, {})
            if lenient and not known:
                continue
            test = self.predicate(type_, name, values)
            keep = test if keep is None else keep & test
        df = df if keep is None else df.where(keep)
        for name, values in joins:
            df = self._join(df, type_, name, values)
        return df

    def refs(self, df: DataFrame, type_: str, code_: str) -> DataFrame:
        """(id, ref_type, ref_id) of a reference parameter."""
        values = self.param(type_, code_).values()
        if isinstance(values, One):
            return df.select("id", values.col["type"].alias("ref_type"), values.col["id"].alias("ref_id")).where("ref_id is not null")
        return df.select("id", F.explode(values).alias("r")).select("id", F.col("r.type").alias("ref_type"), F.col("r.id").alias("ref_id"))

    def _join(self, df: DataFrame, type_: str, name: str, values: list[str]) -> DataFrame:
        if name == "_list":
            members = self.refs(self.tables["List"].where(F.col("id").isin(values)), "List", "item").where(F.col("ref_type") == type_)
            return df.join(members.select(F.col("ref_id").alias("id")).distinct(), "id", "left_semi")
        if name.startswith("_has:"):
            _, source, ref, rest = name.split(":", 3)
            return self._referred(df, type_, self.search(source, [(rest, values)]), source, ref)
        if name.endswith(":in"):
            return self._in_value_sets(df, self.param(type_, name[:-3]).values(), values)
        head, _, rest = name.partition(".")
        code_, _, target = head.partition(":")
        p = self.param(type_, code_)
        target = target or (p.targets[0] if len(p.targets) == 1 else "")
        if not target:
            raise SearchError(f"the chain {name} needs a type")
        found = self.search(target, [(rest, values)])
        ref = p.values()
        if isinstance(ref, One):  # one semi-join of the table itself
            native = ref.key is not None and target in self.native
            found = found.select(F.col(self.native[target] if native else "id").alias("__ref"))
            return df.join(found, (ref.col["type"] == target) & ((ref.key if native else ref.col["id"]) == F.col("__ref")), "left_semi")
        hop = self.refs(df, type_, code_).where(F.col("ref_type") == target).join(found.select(F.col("id").alias("ref_id")), "ref_id", "left_semi")
        return df.join(hop.select("id"), "id", "left_semi")

    def _referred(self, df: DataFrame, type_: str, found: DataFrame, source: str, code_: str) -> DataFrame:
        """Those of df that resources of a type refer to."""
        ref = self.param(source, code_).values()
        if isinstance(ref, One) and ref.key is not None and type_ in self.native:
            ids = found.where(ref.col["type"] == type_).select(ref.key.alias("__ref"))
            return df.join(ids, F.col(self.native[type_]) == F.col("__ref"), "left_semi")
        ids = self.refs(found, source, code_).where(F.col("ref_type") == type_).select(F.col("ref_id").alias("id"))
        return df.join(ids, "id", "left_semi")

    def _in_value_sets(self, df: DataFrame, values: Column | One, urls: list[str]) -> DataFrame:
        """Those of df with a code in one of the value sets."""
        if self.value_sets is None:
            raise SearchError("no value sets")
        codes = None
        for url in urls:
            part = self.value_sets(url).select(F.col("system").alias("__s"), F.col("code").alias("__c"))
            codes = part if codes is None else codes.union(part)
        codes = codes.distinct()
        same = lambda v: v["system"].eqNullSafe(F.col("__s")) & (v["code"] == F.col("__c"))
        if isinstance(values, One):  # one semi-join of the table itself
            return df.join(codes, same(values.col), "left_semi")
        hits = df.select("id", F.explode(values).alias("__v")).join(codes, same(F.col("__v")), "left_semi")
        return df.join(hits.select("id"), "id", "left_semi")

    def compartment_search(self, subject_id: str, type_: str, clauses: list[tuple[str, list[str]]] = ()) -> DataFrame:
        own = reference(self.param(type_, self.compartment[type_]).values(), f"{self.subject}/{subject_id}")
        return self.search(type_, list(clauses)).where(own)

    def system_search(self, clauses: list[tuple[str, list[str]]]) -> DataFrame:
        """(type, id) over all types that know the parameters."""
        out = None
        for t in self.tables:
            if all(n.startswith("_") or n.partition(":")[0] in self.params.get(t, {}) for n, _ in clauses):
                part = self.search(t, clauses).select(F.lit(t).alias("type"), F.col("id").cast("string").alias("id"))
                out = part if out is None else out.unionByName(part)
        if out is None:
            raise SearchError("no type knows these parameters")
        return out

    def include(self, df: DataFrame, type_: str, spec: str, iterate: bool = False) -> DataFrame:
        """(type, id) that the resources refer to by `Type:param[:Target]`; iterate: also from what was found, until nothing is new."""
        source, code_, *target = spec.split(":")
        found = self._targets(df, source, code_, target)
        if not iterate:
            return found
        frontier = found
        while True:
            again = frontier.where(F.col("type") == source).select(F.col("id"))
            step = self._targets(self.tables[source].join(again, "id", "left_semi"), source, code_, target)
            frontier = cut(step.join(found, ["type", "id"], "left_anti"))
            if frontier.isEmpty():
                return found
            found = found.union(frontier).distinct()

    def _targets(self, df: DataFrame, source: str, code_: str, target: list[str]) -> DataFrame:
        refs = self.refs(df, source, code_).select(F.col("ref_type").alias("type"), F.col("ref_id").alias("id")).distinct()
        return refs.where(F.col("type") == target[0]) if target else refs

    def rev_include(self, df: DataFrame, type_: str, spec: str) -> DataFrame:
        """Resources of `Source:param` that refer to the given ones."""
        source, code_, *_ = spec.split(":")
        ref = self.param(source, code_).values()
        if isinstance(ref, One):  # one semi-join of the table itself
            native = ref.key is not None and type_ in self.native and self.native[type_] in df.columns
            ids = df.select(F.col(self.native[type_]) if native else F.col("id").cast("string")).toDF("__ref")
            return self.tables[source].join(ids, (ref.col["type"] == type_) & ((ref.key if native else ref.col["id"]) == F.col("__ref")), "left_semi")
        refs = self.refs(self.tables[source], source, code_).where(F.col("ref_type") == type_)
        hits = refs.join(df.select(F.col("id").cast("string").alias("ref_id")), "ref_id", "left_semi").select("id")
        return self.tables[source].join(hits, "id", "left_semi")

    def includes(self, df: DataFrame, type_: str, direct: list[tuple[str, str]], iterate: list[tuple[str, str]]) -> DataFrame | None:
        """(type, id) of what comes along with the matches, which are not among it.

        Directives are (`_include` or `_revinclude`, spec). The iterated ones are applied to what has been found, again
        and again, until nothing is new; each round visits the newly found only."""
        matches = df.select(F.lit(type_).alias("type"), F.col("id").cast("string").alias("id"))

        def step(frontier: DataFrame, directives: list[tuple[str, str]]) -> DataFrame | None:
            out = None
            for kind, spec in directives:
                source, code_, *target = spec.split(":")
                known = [source] if kind == "_include" else target or list(self.param(source, code_).targets)
                for t in known:
                    own = self.tables[t].join(frontier.where(F.col("type") == t).select("id"), "id", "left_semi")
                    part = self._targets(own, source, code_, target) if kind == "_include" else self.rev_include(own, t, spec).select(F.lit(source).alias("type"), F.col("id").cast("string").alias("id"))
                    out = part.select("type", F.col("id").cast("string").alias("id")) if out is None else out.union(part)
            return out

        found = step(matches, direct)
        if found is None:
            return None
        found = frontier = cut(found.distinct())
        while iterate and (more := step(frontier, iterate)) is not None:
            frontier = cut(more.distinct().join(found, ["type", "id"], "left_anti"))
            if frontier.isEmpty():
                break
            found = found.union(frontier)
        return found.join(matches, ["type", "id"], "left_anti")


@dataclass
class Page:
    """matches: the page's resources; next_id: where the next page starts; total: only if asked for; included: (type, id).

    next and previous give the query strings of the neighbouring pages (None at the ends), at the same time t."""

    matches: DataFrame
    next_id: Callable[[], object]
    total: int | None = None
    included: DataFrame | None = None
    next: Callable[[], str | None] = lambda: None
    previous: Callable[[], str | None] = lambda: None


def _query(query: str, **changes: str | None) -> str:
    """A query string with some of its parameters replaced, or left out."""
    names = {f"__{k.replace('_', '-')}": v for k, v in changes.items()}
    pairs = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True) if k not in names]
    return urlencode([*pairs, *((k, v) for k, v in names.items() if v is not None)])


def search_page(reg: Registry, type_: str, query: str, sort_columns: dict[str, str] | None = None, lenient: bool = True) -> Page:
    """Answer a query string: clauses, _sort, _count, _total, _summary, _elements, _include, _revinclude (also :iterate), and
    where a page starts (__page-id or, if sorted, __page-offset; __page-stack has the starts of the pages before it).

    All pages of a search show one time: __t, or the registry's newest."""
    clauses, result = parse_query(query)
    if reg.at is not None:
        reg = reg.at(int(result["__t"][0]) if "__t" in result else None)
    found = reg.search(type_, clauses, lenient)
    size = min(int(result.get("_count", [str(PAGE_SIZE)])[0]), MAX_PAGE_SIZE)
    count_only = size == 0 or result.get("_summary") == ["count"]
    total = found.count() if count_only or result.get("_total") == ["accurate"] else None
    if count_only:
        return Page(found.limit(0), lambda: None, total)
    by_offset = "_sort" in result and result["_sort"][0] != "_id"
    start = result.get("__page-offset" if by_offset else "__page-id", [""])[0]
    if by_offset:
        rows, following = offset_page(sort(found, result["_sort"][0], sort_columns or {}), size, int(start or 0))
    else:
        if "_sort" in result:
            sort(found, result["_sort"][0], {})  # refuses what it cannot do
        rows, following = page(found, size, start or None)
    split = lambda suffix: [(n.partition(":")[0], s) for n, specs in result.items() if n.startswith(("_include", "_revinclude")) and n.endswith(":iterate") == suffix for s in specs]
    included = reg.includes(rows, type_, split(False), split(True))
    if included is not None and included.limit(MAX_INCLUDES + 1).count() > MAX_INCLUDES:
        if size == 1:
            raise SearchError(f"more than {MAX_INCLUDES} included resources")
        smaller = re.sub(r"(^|&)_count=[^&]*", "", query) + f"&_count={size // 2}"
        return search_page(reg, type_, smaller.lstrip("&"), sort_columns, lenient)
    if "_elements" in result:
        rows = rows.select("id", *[F.col(c) for c in result["_elements"][0].split(",") if c in rows.columns and c != "id"])
    stack = split_escaped(result["__page-stack"][0], ",") if "__page-stack" in result else []
    here = "page_offset" if by_offset else "page_id"
    pinned = {"t": None if reg.t is None else str(reg.t)}

    def next_query() -> str | None:
        to = following()
        return None if to is None else _query(query, **pinned, **{here: str(to)}, page_stack=",".join([*stack, start.replace("\\", "\\\\").replace(",", "\\,")][-MAX_STACK:]))

    def previous_query() -> str | None:
        return _query(query, **pinned, **{here: unescape(stack[-1]) or None}, page_stack=",".join(stack[:-1]) if len(stack) > 1 else None) if stack else None

    return Page(rows, following, total, included, next_query, previous_query)


def parse_query(query: str) -> tuple[list[tuple[str, list[str]]], dict[str, list[str]]]:
    """Clauses, and result parameters (_sort, _count, _include, _revinclude, _summary, _elements, _total, where a page starts)."""
    clauses, result = [], {}
    for name, value in parse_qsl(query, keep_blank_values=True):
        if name in ("_sort", "_count", "_summary", "_elements", "_total", "__page-id", "__page-offset", "__page-stack", "__t") or name.startswith(("_include", "_revinclude")):
            result.setdefault(name, []).append(value)
        else:
            clauses.append((name, split_escaped(value, ",")))
    if len(result.get("_sort", [])) > 1 or any("," in s for s in result.get("_sort", [])):
        raise SearchError("more than one sort parameter")
    return clauses, result


def sort(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """By _id, or by a column (ties by id); `-` reverses, which _id does not support."""
    name = key.lstrip("-")
    if name == "_id":
        if key.startswith("-"):
            raise SearchError("unsupported sort -_id")
        return df.orderBy("id")
    if name not in columns:
        raise SearchError(f"unknown sort parameter {name}")
    c = F.col(columns[name])
    return df.orderBy(c.desc() if key.startswith("-") else c.asc(), "id")


def page(df: DataFrame, size: int = PAGE_SIZE, from_id=None) -> tuple[DataFrame, Callable[[], object]]:
    """A page in id order from an id on, and a function that gives the id of the next page (None at the end)."""
    size = min(size, MAX_PAGE_SIZE)
    rows = df if from_id is None else df.where(F.col("id") >= from_id)
    ahead = rows.orderBy("id").limit(size + 1)

    def next_id():
        got = ahead.orderBy("id").select("id").collect()
        return got[size][0] if len(got) > size else None

    return ahead.orderBy("id").limit(size), next_id


def offset_page(df: DataFrame, size: int = PAGE_SIZE, offset: int = 0) -> tuple[DataFrame, Callable[[], object]]:
    """A page of a sorted DataFrame, and a function that gives the offset of the next one (None at the end)."""
    rows = df.offset(offset).limit(size)
    return rows, lambda: offset + size if not df.offset(offset + size).limit(1).isEmpty() else None


def explain(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
