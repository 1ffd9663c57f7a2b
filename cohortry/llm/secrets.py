"""Secret scans with a trigram inverted index, in DataFrame operations only.

Each rule's pattern gives a Boolean trigram query: an AND of ORs of trigram sets, one OR for each stretch of the
pattern that has finitely many spellings. Posting lists of the trigrams that some rule asks for are intersected by
document; only candidates are verified with the rule's pattern. Rules without a mandatory trigram scan every text."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import fresh, materialize, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. pattern: as Java and Python read it alike. A match counts if `group` has `least` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    prefilter: str = ""  # a pattern that every text with a counted match has, for rules that scan every text


#: The base kinds, in the order in which spans of equal start are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16, prefilter=r"[0-9a-f]{16}"),
)
#: Further kinds, listed after the base ones.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Stretches with more spellings than this are cut: they ask for less, never for too much.
SPELLINGS = 64


def _spellings(node) -> set[str] | None:
    """All lower-case spellings of a pattern node, None if they are too many."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for o, a in arg:
            if o is sre.LITERAL:
                out.add(chr(a).lower())
            elif o is sre.RANGE and a[1] - a[0] < 8:
                out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out
    if op is sre.SUBPATTERN:
        return _all(arg[3])
    if op is sre.BRANCH:
        parts = [_all(b) for b in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        one = _all(body)
        if one is None or high is sre.MAXREPEAT or high > 8:
            return None
        out, power = set(), {""}
        for k in range(high + 1):
            if k >= low:
                out |= power
            power = {a + b for a in power for b in one}
            if len(power | out) > SPELLINGS:
                return None
        return out
    return None


def _all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        one = _spellings(node)
        if one is None or len(out) * len(one) > SPELLINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of ORs of trigram sets that every lower-cased text with a match has; [] asks for nothing (scan fully)."""
    ands: list[list[frozenset[str]]] = []
    run = {""}

    def close() -> None:
        nonlocal run
        if min(map(len, run)) >= 3:
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            least = sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)
            ands.append(least)
        run = {""}

    def walk(nodes) -> None:
        nonlocal run
        for node in nodes:
            one = _spellings(node)
            if one is not None and len(run) * len(one) <= SPELLINGS:
                run = {a + b for a in run for b in one}
            elif one is not None:
                close()
                run = one
            elif node[0] is sre.SUBPATTERN:
                walk(node[1][3])
            elif node[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT) and node[1][0] >= 1:
                close()
                walk(node[1][2])  # at least one turn is there
                close()
            else:
                close()

    walk(list(parser.parse(pattern)))
    close()
    return ands


def index(df: DataFrame, text: Column, key: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """Posting entries (trigram, *key), of the trigrams that some rule asks for."""
    names = sorted({t for r in rules for ors in trigram_query(r.pattern) for s in ors for t in s})
    low = df.select(*key, F.lower(text).alias("__low"))
    has = F.array(*[F.when(F.contains("__low", F.lit(t)), F.lit(t)) for t in names])
    return low.select(*key, has.alias("__has")).select(F.explode(F.array_compact("__has")).alias("trigram"), *key)


def candidates(postings: DataFrame, key: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """(*key, one Boolean per indexed rule): posting lists intersected by document. Documents of no rule are left out."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    names = sorted({t for q in queries.values() for ors in q for s in ors for t in s})
    words = [names[i : i + 62] for i in range(0, len(names), 62)]
    masks = [
        F.bit_or(F.coalesce(*[F.when(F.col("trigram") == t, F.lit(1 << i).cast("long")) for i, t in enumerate(w)], F.lit(0).cast("long"))).alias(f"__m{k}")
        for k, w in enumerate(words)
    ]

    def asks(s: frozenset[str]) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(words):
            if bits := sum(1 << i for i, t in enumerate(w) if t in s):
                ok = ok & (F.col(f"__m{k}").bitwiseAND(F.lit(bits).cast("long")) == bits)
        return ok

    def either(ors: list[frozenset[str]]) -> Column:
        out = F.lit(False)
        for s in ors:
            out = out | asks(s)
        return out

    got = postings.groupBy(*key).agg(*masks)
    cols, any_ = [], F.lit(False)
    for kind, ands in queries.items():
        c = F.lit(True)
        for ors in ands:
            c = c & either(ors)
        cols.append(c.alias(f"__is_{kind}"))
        any_ = any_ | F.col(f"__is_{kind}")
    return got.select(*key, *cols).where(any_)


def spans_of(rule: Rule, rank: int, text: Column) -> Column:
    """array<struct<start, rank, kind, end>> of one rule's matches: what split() leaves between them gives the offsets."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(whole.alias("m"), part.alias("g"), F.slice(gaps, 1, F.size(whole)).alias("b"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, first, step, lambda acc: acc["out"])


def scan(df: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, *, id_col: str = "doc_id", text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """df with an array of spans (start, rank, kind, end; code points, end exclusive), by start, then rule order.

    Null and empty texts have no spans. Rows that share id and text share their index entry and each get the spans;
    null ids are fine. Other columns pass through (one named out_col is replaced); an empty table stays empty."""
    th = fresh(df, "__hash")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != out_col.lower()]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.select(*kept, F.xxhash64(text).alias(th))
    keyed = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(th).alias("__th"), F.col(f"`{text_col}`").alias("__text"))
    postings = materialize(index(keyed, F.coalesce("__text", F.lit("")), ["__id", "__th"], rules), "postings")
    found = materialize(candidates(postings, ["__id", "__th"], rules), "candidates")
    joined = docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col(th) == F.col("__th")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    lists = []
    for i, r in enumerate(rules):
        if trigram_query(r.pattern):
            when = F.coalesce(F.col(f"__is_{r.kind}"), F.lit(False))
        else:
            when = F.rlike(text, F.lit(r.prefilter)) if r.prefilter else F.lit(True)
        lists.append(F.when(when, spans_of(r, i, text)).otherwise(none))
    return joined.select(*kept, F.array_sort(F.flatten(F.array(*lists))).alias(out_col))


def redact(df: DataFrame, *, text_col: str = "text", spans_col: str = "secrets", mark: str = "[REDACTED]") -> DataFrame:
    """df with every span of its texts replaced by the mark; overlapping spans become one. Null texts stay null."""
    text = F.col(f"`{text_col}`")
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = F.array_append(acc["out"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], apart).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    clean = F.when(F.size(spans_col) > 0, F.aggregate(F.col(spans_col), first, step, finish)).otherwise(text)
    return df.withColumn(text_col, clean)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[of(r.kind) for r in BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
