"""Navigation: everything about a subject, and traversal of links between resources."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.lineage import cut
from cohortry.operators.search import One, Registry, SearchError, offset_page, reference


def everything(reg: Registry, subject_ids: DataFrame, supporting: dict[str, list[str]] | None = None, dates: dict[str, Column] | None = None) -> DataFrame:
    """(subject_id, type, id) of the subjects' compartments, with the subjects themselves.

    supporting: by type, reference parameters whose targets come along. dates: by type, a condition on the resources."""
    subjects = subject_ids.select(F.col("id").cast("string").alias("subject_id"))
    out = subjects.select("subject_id", F.lit(reg.subject).alias("type"), F.col("subject_id").alias("id"))
    shared = None
    for type_, code in reg.compartment.items():
        df = reg.tables[type_]
        if dates and type_ in dates:
            df = df.where(dates[type_])
        refs = reg.refs(df, type_, code).where(F.col("ref_type") == reg.subject)
        own = refs.join(subjects, refs["ref_id"] == subjects["subject_id"]).select("subject_id", F.lit(type_).alias("type"), F.col("id").cast("string").alias("id"), F.col("id").alias("__key"))
        if not isinstance(reg.param(type_, code).values(), One):  # several references to one subject
            own = own.distinct()
        out = out.unionByName(own.drop("__key"))
        for param in (supporting or {}).get(type_, []):
            more = reg.refs(df, type_, param).withColumnRenamed("id", "__key")
            more = own.select("subject_id", "__key").join(more, "__key").select("subject_id", F.col("ref_type").alias("type"), F.col("ref_id").cast("string").alias("id"))
            more = more.where(~F.col("type").isin(reg.subject, *reg.compartment))  # those are in a compartment themselves
            shared = more if shared is None else shared.unionByName(more)
    if shared is not None:  # only what several resources refer to can repeat
        out = out.unionByName(shared.distinct())
    return out


#: Resources that everything_page() gives without a page size.
MAX_EVERYTHING = 10_000


def everything_page(reg: Registry, subject_id: str, count: int | None = None, offset: int = 0, supporting: dict[str, list[str]] | None = None, dates: dict[str, Column] | None = None) -> tuple[DataFrame, Callable[[], int | None]]:
    """(type, id) of everything about one subject, in order, and a function that gives the next page's offset (None at the
    end). Without a count all is one page, which is refused if it is too large."""
    one = reg.tables[reg.subject].where(F.col("id") == subject_id).select("id")
    found = everything(reg, one, supporting, dates).select("type", "id").orderBy("type", "id")
    if count is None:
        if found.limit(MAX_EVERYTHING + 1).count() > MAX_EVERYTHING:
            raise SearchError(f"more than {MAX_EVERYTHING} resources: ask for pages")
        return found, lambda: None
    return offset_page(found, count, offset)


@dataclass(frozen=True)
class Link:
    """From a node to a node, by a reference parameter of the source (forward) or of the target (backward)."""

    source: str
    target: str
    param: str
    backward: bool = False


def graph(reg: Registry, start: DataFrame, start_type: str, links: list[Link], most_rounds: int = 100) -> DataFrame:
    """(type, id) reached from the start (id) by the links: a frontier loop that visits each resource once."""
    found = start.select(F.lit(start_type).alias("type"), F.col("id").cast("string").alias("id")).distinct()
    frontier = found
    for _ in range(most_rounds):
        step = None
        for link in links:
            ids = frontier.where(F.col("type") == link.source).select(F.col("id").alias("__id"))
            holder, kind = (link.target, link.source) if link.backward else (link.source, link.target)
            refs = reg.refs(reg.tables[holder], holder, link.param).where(F.col("ref_type") == kind).select(F.col("id").cast("string").alias("h"), F.col("ref_id").cast("string").alias("r"))
            key, other = ("r", "h") if link.backward else ("h", "r")
            part = refs.join(ids, refs[key] == F.col("__id"), "left_semi").select(F.lit(link.target).alias("type"), F.col(other).alias("id"))
            step = part if step is None else step.unionByName(part)
        frontier = cut(step.distinct().join(found, ["type", "id"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    raise ValueError("the graph is deeper than allowed")


def graphql_list(reg: Registry, type_: str, fields: dict[str, Callable[[], Column]], clauses: list[tuple[str, list[str]]]) -> DataFrame:
    """A list query: resources that match, with the fields asked for."""
    return reg.search(type_, clauses).select(*[f().alias(name) for name, f in fields.items()])


_GRAPHQL = re.compile(r'\s*(?:query\s*\w*\s*)?\{\s*(?:(\w+)\s*:\s*)?(\w+)List\s*(?:\(([^)]*)\))?\s*\{([\w\s,:]+)\}\s*\}\s*', re.S)


def graphql(reg: Registry, text: str, fields: dict[str, dict[str, Callable[[], Column]]]) -> DataFrame:
    """A query text such as `{ PatientList(gender: "male") { id city } }` over the fields known of each type.

    Arguments are search parameters (with _ for -), fields can have aliases."""
    m = _GRAPHQL.fullmatch(text)
    if not m or m[2] not in fields:
        raise SearchError(f"cannot answer: {text}")
    args = re.findall(r'(\w+)\s*:\s*(?:"((?:[^"\\]|\\.)*)"|([\w.+-]+))', m[3] or "")
    asked: dict[str, Callable[[], Column]] = {}
    for alias, name in re.findall(r"(?:(\w+)\s*:\s*)?(\w+)", m[4]):
        if name not in fields[m[2]]:
            raise SearchError(f"{m[2]} has no field {name}")
        asked[alias or name] = fields[m[2]][name]
    return graphql_list(reg, m[2], asked, [(k.replace("_", "-") if not k.startswith("_") else k, [(quoted or plain).replace(",", "\\,")]) for k, quoted, plain in args])


def compartment_edges(reg: Registry) -> DataFrame:
    """(subject_id, type, id) of every compartment."""
    out = None
    for type_, code in reg.compartment.items():
        refs = reg.refs(reg.tables[type_], type_, code).where(F.col("ref_type") == reg.subject)
        part = refs.select(F.col("ref_id").alias("subject_id"), F.lit(type_).alias("type"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def in_compartment(reg: Registry, type_: str, subject_id: str) -> Column:
    return reference(reg.param(type_, reg.compartment[type_]).values(), f"{reg.subject}/{subject_id}")
