"""Measures: populations and stratifiers of a library as one plan, and reports as rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions import quantity
from cohortry.plans.cql import Compiler, Model
from cohortry.plans.cql_parser import CqlError


@dataclass(frozen=True)
class Stratifier:
    """One expression, or several components by code."""

    code: str
    expression: str | None = None
    components: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Group:
    """populations: code -> expression. basis: boolean, or a resource type whose rows are counted."""

    populations: dict[str, str]
    stratifiers: tuple[Stratifier, ...] = ()
    basis: str = "boolean"


@dataclass
class Measure:
    model: Model
    library: str
    groups: list[Group]
    parameters: dict[str, object] = field(default_factory=dict)
    now: str = "2020-01-01T00:00:00"

    def report(self) -> DataFrame:
        """(group, population, stratifier, stratum, count); the whole population has a null stratifier. A null value is stratum `null`.

        The values of a stratum of several components are joined by `|`; bars and backslashes in them are escaped."""
        out = None
        for i, g in enumerate(self.groups):
            part = self._group(i, g)
            out = part if out is None else out.unionByName(part)
        return out

    def _group(self, i: int, g: Group) -> DataFrame:
        """All populations of a group from one plan: each subject, or each resource, counts once for each population it is in."""
        names = list(dict.fromkeys(e for s in g.stratifiers for e in _expressions(s)))
        if g.basis == "boolean":
            compiler = Compiler(self.model, self.library, self.parameters, self.now)
            kinds = {n: compiler.define(n).kind for n in names}
            compiler = Compiler(self.model, self.library, self.parameters, self.now)
            rows = compiler.plan(list(dict.fromkeys([*g.populations.values(), *names])))
            member = F.array_compact(F.array(*[F.when(F.col(f"`{e}`").cast("boolean"), F.lit(code)) for code, e in g.populations.items()]))
            rows = rows.select(*[F.col(f"`{n}`") for n in names], F.explode(member).alias("__population"))
        else:
            kinds, rows = dict.fromkeys(names, "Any"), None
            for code, e in g.populations.items():
                compiler = Compiler(self.model, self.library, self.parameters, self.now)
                part = compiler.rows_plan(e, names).select(*[F.col(f"`{n}`") for n in names], F.lit(code).alias("__population"))
                rows = part if rows is None else rows.unionByName(part)
        # One pass over the populations for all stratifiers and the total.
        keys = {n: f"__k{k}" for k, n in enumerate(names)}
        shown = rows.select("__population", *[_shown(F.col(f"`{n}`"), kinds[n]).alias(k) for n, k in keys.items()], F.lit(1).cast("long").alias("__n"))
        # A population without members has a count, too: a row of no weight stands for each.
        zero = shown.sparkSession.createDataFrame([(code,) for code in g.populations], "__population string")
        shown = shown.unionByName(zero.select("__population", *[F.lit(None).cast("string").alias(k) for k in keys.values()], F.lit(0).cast("long").alias("__n")))
        sets = [[]] + [[keys[e] for e in _expressions(s)] for s in g.stratifiers]
        by = [["__population", *cols] for cols in dict.fromkeys(map(tuple, sets))]
        counted = shown.groupingSets(by, "__population", *keys.values()).agg(F.sum("__n").alias("count"), F.grouping_id().alias("__gid"))
        out = None
        for s, cols in zip([None, *g.stratifiers], sets, strict=True):
            gid = sum(1 << (len(keys) - 1 - k) for k, c in enumerate(keys.values()) if c not in cols)
            safe = (lambda c: F.regexp_replace(c, r"([|\\])", r"\\$1")) if len(cols) > 1 else (lambda c: c)
            text = F.concat_ws("|", *[safe(F.col(c)) for c in cols]) if s else F.lit(None).cast("string")
            name = F.struct(F.lit(s.code if s else None).cast("string").alias("stratifier"), text.alias("stratum"))
            own = F.when(F.col("__gid") == gid, F.array(name)).otherwise(F.array().cast("array<struct<stratifier:string,stratum:string>>"))
            out = own if out is None else F.concat(out, own)  # stratifiers on the same expressions share a grouping set
        found = counted.select("__population", "count", F.explode(out).alias("s"))
        found = found.where((F.col("count") > 0) | F.col("s.stratifier").isNull())
        return found.select(F.lit(i).alias("group"), F.col("__population").alias("population"), "s.stratifier", "s.stratum", "count")

    def subjects(self, group: int, code: str) -> DataFrame:
        """(id) of the subjects of a population."""
        g = self.groups[group]
        if g.basis != "boolean":
            raise CqlError("subject lists need the boolean basis")
        compiler = Compiler(self.model, self.library, self.parameters, self.now)
        return compiler.plan([g.populations[code]]).where(F.col(f"`{g.populations[code]}`").cast("boolean")).select("id")


def _expressions(s: Stratifier) -> list[str]:
    return [s.expression] if s.expression else [c[1] for c in s.components]


def _shown(c: Column, kind: str) -> Column:
    """How a stratum shows a value."""
    if kind == "Quantity":
        text = quantity.stratum(c)
    elif kind == "Code":
        text = c["code"]
    elif kind == "Concept":
        text = F.get(c, F.lit(0))["code"]
    elif kind.startswith("List<"):
        text = F.when(F.size(c) > 1, F.raise_error(F.lit("a stratifier gave several values"))).otherwise(F.get(c, F.lit(0)).cast("string"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def evaluate_expression(model: Model, expression: str, context: str = "Patient", header: str = "", parameters: dict[str, object] | None = None, now: str = "2020-01-01T00:00:00") -> DataFrame:
    """One ad-hoc expression for every subject: (id, value)."""
    text = f"{header}\ncontext {context}\ndefine value: {expression}"
    return Compiler(model, text, parameters, now).plan(["value"])


def report_resource(measure: Measure, url: str = "", start: str | None = None, end: str | None = None) -> dict:
    """The report as a resource: groups, populations with counts, and strata. Its size is that of the strata."""
    groups: dict[int, dict] = {}
    for r in measure.report().collect():
        g = groups.setdefault(r["group"], {"population": {}, "stratifier": {}})
        if r["stratifier"] is None:
            g["population"][r["population"]] = r["count"]
        else:
            g["stratifier"].setdefault(r["stratifier"], {}).setdefault(r["stratum"], {})[r["population"]] = r["count"]
    coded = lambda counts: [{"code": {"coding": [{"code": k}]}, "count": n} for k, n in counts.items()]
    out = []
    for i in sorted(groups):
        strata = [
            {"code": [{"text": code}], "stratum": [{"value": {"text": v}, "population": coded(p)} for v, p in sorted(s.items(), key=lambda x: str(x[0]))]}
            for code, s in groups[i]["stratifier"].items()
        ]
        out.append({"population": coded(groups[i]["population"]), "stratifier": strata})
    return {"resourceType": "MeasureReport", "status": "complete", "type": "summary", "measure": url, "period": {"start": start, "end": end}, "group": out}


#: References to a List resource.
LIST_SIZE = 10_000


def subject_list_resources(measure: Measure, group: int, code: str, list_id: str, kind: str = "Patient", size: int = LIST_SIZE) -> DataFrame:
    """(type, id, content): a List resource of a population's subjects, written to a store or as files.

    Populations larger than `size` make several Lists of about that size, whose ids end in their number."""
    ids = measure.subjects(group, code).select(F.col("id").cast("string").alias("id"))
    parts = -(-ids.count() // size) or 1
    name = F.lit(list_id) if parts == 1 else F.concat(F.lit(f"{list_id}-"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("string"))
    items = ids.groupBy(name.alias("__list")).agg(F.array_sort(F.collect_list(F.concat(F.lit(f"{kind}/"), F.col("id")))).alias("refs"))
    if parts == 1:  # an empty population has a List, too
        items = items.sparkSession.range(1).select(F.lit(list_id).alias("__list")).join(items, "__list", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))
    entry = F.transform("refs", lambda r: F.struct(F.struct(r.alias("reference")).alias("item")))
    body = F.to_json(F.struct(F.lit("List").alias("resourceType"), F.col("__list").alias("id"), F.lit("current").alias("status"), F.lit("working").alias("mode"), entry.alias("entry")))
    return items.select(F.lit("List").alias("type"), F.col("__list").alias("id"), body.alias("content"))
