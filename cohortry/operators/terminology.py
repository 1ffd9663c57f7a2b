"""Code systems and value sets as tables.

concepts(system, code, display, active), edges(system, parent, child), properties(system, code, property, value).
A value set is a composition of includes and excludes; its expansion is unions, semi-joins and an anti-join."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.lineage import cut


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(system, ancestor, descendant) of all is-a pairs, each concept with itself: path doubling, log(depth) joins."""
    pairs = edges.select("system", F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct()
    n = pairs.count()
    for _ in range(rounds):
        longer = pairs.alias("a").join(pairs.alias("b"), (F.col("a.system") == F.col("b.system")) & (F.col("a.descendant") == F.col("b.ancestor")))
        pairs = pairs.union(longer.select("a.system", "a.ancestor", "b.descendant")).distinct()
        pairs = cut(pairs)
        m = pairs.count()
        if m == n:
            break
        n = m
    nodes = edges.select("system", F.col("parent").alias("c")).union(edges.select("system", F.col("child").alias("c"))).distinct()
    return pairs.union(nodes.select("system", F.col("c").alias("ancestor"), F.col("c").alias("descendant"))).distinct()


def descendants(spark: SparkSession, edges: DataFrame, system: str, root: str, itself: bool) -> DataFrame:
    """(code) below a root: a search from the root on, which reads nothing that does not lie below it."""
    own = edges.where(F.col("system") == system).select("parent", "child").distinct()
    start = spark.range(1).select(F.lit(root).alias("code"))
    found = frontier = start
    while True:  # each concept is visited once, whatever paths and cycles lead to it
        step = own.join(frontier, own["parent"] == F.col("code"), "left_semi").select(F.col("child").alias("code")).distinct()
        frontier = cut(step.join(found, "code", "left_anti"))
        if frontier.isEmpty():
            return found if itself else found.where(F.col("code") != root)
        found = found.union(frontier)


@dataclass(frozen=True)
class Filter:
    """op: =, is-a, descendent-of, exists or regex."""

    property: str
    op: str
    value: str


@dataclass(frozen=True)
class Include:
    """All concepts of a system, those listed, or those that pass all filters; and those of all value sets named."""

    system: str | None = None
    codes: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    value_sets: tuple[str, ...] = ()


@dataclass(frozen=True)
class ValueSet:
    url: str
    include: tuple[Include, ...]
    exclude: tuple[Include, ...] = ()


@dataclass
class Terminology:
    concepts: DataFrame
    edges: DataFrame
    properties: DataFrame
    value_sets: dict[str, ValueSet] = field(default_factory=dict)
    closures: DataFrame | None = None

    def _closure(self) -> DataFrame:
        if self.closures is None:
            self.closures = closure(self.edges)
        return self.closures

    def _filter(self, system: str, f: Filter) -> DataFrame:
        own = self.concepts.where(F.col("system") == system)
        props = self.properties.where((F.col("system") == system) & (F.col("property") == f.property))
        if f.op in ("is-a", "descendent-of"):
            if self.closures is not None:
                below = self.closures.where((F.col("system") == system) & (F.col("ancestor") == f.value)).select(F.col("descendant").alias("code"))
                below = below.union(below.sparkSession.range(1).select(F.lit(f.value).alias("code"))).distinct()
                below = below if f.op == "is-a" else below.where(F.col("code") != f.value)
            else:
                below = descendants(self.edges.sparkSession, self.edges, system, f.value, f.op == "is-a")
            return own.join(below, "code", "left_semi")
        if f.op == "=":
            if f.property in ("parent", "child"):
                key, other = ("child", "parent") if f.property == "parent" else ("parent", "child")
                near = self.edges.where((F.col("system") == system) & (F.col(other) == f.value)).select(F.col(key).alias("code"))
                return own.join(near, "code", "left_semi")
            return own.join(props.where(F.col("value") == f.value), "code", "left_semi")
        if f.op == "exists":
            return own.join(props, "code", "left_semi" if f.value == "true" else "left_anti")
        if f.op == "regex":
            whole = rf"\A(?:{f.value})\z"
            if f.property == "code":
                return own.where(F.rlike("code", F.lit(whole)))
            if f.property == "display":
                return own.where(F.rlike("display", F.lit(whole)))
            return own.join(props.where(F.rlike("value", F.lit(whole))), "code", "left_semi")
        raise ValueError(f"unsupported filter {f.op}")

    def _members(self, i: Include, seen: tuple[str, ...]) -> DataFrame:
        out = None
        if i.system is not None:
            out = self.concepts.where(F.col("system") == i.system)
            if i.codes:
                out = out.where(F.col("code").isin(*i.codes))
            for f in i.filters:
                out = out.join(self._filter(i.system, f).select("system", "code"), ["system", "code"], "left_semi")
        for url in i.value_sets:
            part = self.expand(url, seen=seen)
            out = part if out is None else out.join(part.select("system", "code"), ["system", "code"], "left_semi")
        if out is None:
            raise ValueError("an include names a system or a value set")
        return out

    def expand(self, vs: str | ValueSet, active_only: bool = False, text: str | None = None, count: int | None = None, seen: tuple[str, ...] = ()) -> DataFrame:
        """(system, code, display, active) of a value set."""
        if isinstance(vs, str):
            vs = vcl(vs) if vs.startswith(VCL) else self.value_sets[vs]
        if vs.url in seen:
            raise ValueError(f"value set {vs.url} contains itself")
        seen = (*seen, vs.url)
        out = None
        for i in vs.include:
            part = self._members(i, seen)
            out = part if out is None else out.unionByName(part)
        out = out.dropDuplicates(["system", "code"])
        for x in vs.exclude:
            out = out.join(self._members(x, seen).select("system", "code"), ["system", "code"], "left_anti")
        if active_only:
            out = out.where(F.coalesce("active", F.lit(True)))
        if text:
            out = out.where(F.contains(F.lower("display"), F.lit(text.lower())))
        return out if count is None else out.orderBy("system", "code").limit(count)

    def validate_code(self, codes: DataFrame, vs: str | ValueSet) -> DataFrame:
        """codes (system, code[, display]) with result and a message: unknown code, not in the value set, wrong display, inactive."""
        members = self.expand(vs).select("system", "code", F.col("display").alias("__display"), F.col("active").alias("__active"), F.lit(True).alias("__in"))
        known = self.concepts.select("system", "code", F.lit(True).alias("__known"))
        j = codes.join(members, ["system", "code"], "left").join(known, ["system", "code"], "left")
        wrong = (F.col("display") != F.col("__display")) if "display" in codes.columns else F.lit(False)
        message = (
            F.when(F.col("__known").isNull(), F.lit("unknown code"))
            .when(F.col("__in").isNull(), F.lit("not in the value set"))
            .when(wrong, F.lit("wrong display"))
            .when(~F.coalesce("__active", F.lit(True)), F.lit("inactive"))
        )
        result = F.col("__in").isNotNull() & ~F.coalesce(wrong, F.lit(False))
        return j.select(*codes.columns, result.alias("result"), message.alias("message"))

    def lookup(self, system: str, code: str) -> DataFrame:
        """Display and properties of a concept."""
        own = self.concepts.where((F.col("system") == system) & (F.col("code") == code))
        return own.join(self.properties, ["system", "code"], "left").select("system", "code", "display", "property", "value")

    def in_value_set(self, df: DataFrame, vs: str | ValueSet, system: str = "system", code: str = "code") -> DataFrame:
        """Rows whose code is a member: a semi-join with the expansion."""
        members = self.expand(vs).select(F.col("system").alias("__s"), F.col("code").alias("__c"))
        return df.join(members, (F.col(system) == F.col("__s")) & (F.col(code) == F.col("__c")), "left_semi")


VCL = "http://fhir.org/VCL?v1="


def vcl(url: str) -> ValueSet:
    """An implicit value set: (system)item, with items *, a code, (a;b), is-a `<<`, descendent `<`, `p=v`, `p/"regex"`; comma is and."""
    m = re.fullmatch(r"\(([^)]+)\)(.+)", url.removeprefix(VCL))
    if not m:
        raise ValueError(f"cannot read {url}")
    system, rest = m[1], m[2]
    includes: list[Include] = []
    for item in re.split(r";(?![^(]*\))", rest.strip("()") if rest.startswith("(") else rest):
        filters, codes = [], []
        for part in item.split(","):
            part = part.strip()
            if part == "*":
                continue
            if part.startswith("<<"):
                filters.append(Filter("concept", "is-a", part[2:]))
            elif part.startswith("<"):
                filters.append(Filter("concept", "descendent-of", part[1:]))
            elif r := re.fullmatch(r'(\w+)/"(.*)"', part):
                filters.append(Filter(r[1], "regex", r[2]))
            elif r := re.fullmatch(r"(\w+)<<(\w+)", part):
                filters.append(Filter(r[1], "is-a", r[2]))
            elif "=" in part:
                filters.append(Filter(*(lambda a, b: (a, "=", b))(*part.split("=", 1))))
            else:
                codes.append(part)
        includes.append(Include(system, tuple(codes), tuple(filters)))
    return ValueSet(url, tuple(includes))


# Code systems that are grammars: membership is a pattern.

_UCUM_ATOM = r"(?:\[[^\[\]]+\]|\{[^{}]*\}|%|[a-zA-Z]+(?:\[[^\[\]]+\])?(?:\{[^{}]*\})?|10\*|10\^|\d+)(?:[+-]?\d+)?"
GRAMMARS = {
    "http://unitsofmeasure.org": rf"/?{_UCUM_ATOM}(?:[./]{_UCUM_ATOM})*",
    "urn:ietf:bcp:13": r"(?:application|audio|font|image|message|model|multipart|text|video)/[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]*(?:\s*;\s*[A-Za-z0-9_-]+=[^;]+)*",
    "urn:ietf:bcp:47": r"[A-Za-z]{2,3}(?:-[A-Za-z]{4})?(?:-(?:[A-Za-z]{2}|\d{3}))?(?:-[A-Za-z0-9]{5,8})*",
}


def valid_by_grammar(system: str, code):
    return F.rlike(code, F.lit(rf"\A(?:{GRAMMARS[system]})\z"))
