"""Main text of web pages by a maximum-scoring run of tokens.

Words score positive and tags negative. Both the tags' costs and the roles of elements come from labelled pages: the
author's own outermost <article> or <main> labels a page's tokens as content or not. A tag costs the log-odds of being
outside, relative to a word's and within bounds; the pages' counts are added to those of a prior by structural class, so
tags that no labelled page has cost what their class does. The words of class, id and role get log-odds of being outside
in the same way, beside those known for what they hold; elements far outside (menus, adverts, comments, ...) score nothing and are never
returned, unless they wrap the content itself. One linear scan finds the best contiguous run; its words, block by block,
are the text."""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import bounded_sample, table, with_arrow_columns

#: Comments and declarations, or a tag: attributes are names with an optional value in either quotes or none.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|
    <(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|=*+[^\s/>=]++(?>\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>]++|(?=>)))?|=)*+)(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s/>=]++)(?>\s*+=\s*+(?>"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""", re.S)
#: Fixed values of HTML: elements whose content is not markup, other elements that hold no text of the page, void
#: elements, elements inside a block, and elements that end where another one starts.
RAW = {"script", "style", "noscript", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
NEVER = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "template", "svg", "object", "math", "audio", "video", "canvas"} | RAW
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "figcaption", "caption", "td", "th", "summary", "address", "br"}
CONTENT = {"article", "main"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words of class, id and role that say that an element holds no article text; and words that may stand beside them.
OUTSIDE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
BESIDE = {
    "area", "articles", "bar", "block", "bottom", "box", "buttons", "container", "content", "form", "global", "group", "header", "icons", "inner", "item", "items", "left", "links", "list", "main", "outer", "page", "panel",
    "post", "posts", "primary", "right", "secondary", "section", "signup", "site", "stories", "thread", "top", "wrap", "wrapper",
}
#: Costs in words by structural class, and the pages that such a prior counts as; the bounds of a cost.
PRIOR = {"inline": 0.02, "link": 0.6, "textual": 0.05, "grouping": 0.1, "edge": 25.0}
PRIOR_PAGES, LEAST, MOST = 20.0, 0.02, 1.0
#: Log-odds from which a word's elements are left out; times that it must be seen outside.
FAR, SEEN = 2.0, 20


def structure(name: str) -> str:
    return "link" if name == "a" else "inline" if name in INLINE else "textual" if name in TEXTUAL else "grouping"


def role_words(attrs: str) -> Iterable[str]:
    """The words of class, id and role, as they stand."""
    for m in _ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id", "role"):
            yield from (m[2] or m[3] or m[4] or "").lower().split()


def known_outside(word: str) -> bool:
    """Whether a word consists of words for what stands outside, alone or beside neutral ones: `ad-box`, not `ad-free`."""
    parts = [p for p in re.split(r"[^a-z]+", word) if p]
    return parts in (["site", "header"], ["global", "header"]) or any(p in OUTSIDE for p in parts) and all(p in OUTSIDE or p in BESIDE for p in parts)


@dataclass
class Model:
    """costs: of tags, in words. outside: log-odds of words of class, id and role, where labelled pages have them."""

    costs: dict[str, float] = field(default_factory=dict)
    outside: dict[str, float] = field(default_factory=dict)

    def cost(self, name: str) -> float:
        return self.costs.get(name) or PRIOR[structure(name)]

    def leaves_out(self, attrs: str) -> bool:
        return any(known_outside(w) or self.outside.get(w, 0.0) >= FAR for w in role_words(attrs))


@dataclass(slots=True)
class Element:
    name: str
    attrs: str
    start: int  # of the opening tag among the tokens
    end: int  # of the closing tag, or where the element ends without one
    within: bool  # a content element is open around it


@dataclass(slots=True)
class Page:
    """tokens: (tag, "") or ("", text) in page order; closed: of tags, whether they close; elements in order of their start."""

    tokens: list[tuple[str, str]]
    elements: list[Element]


def parse(page: str) -> Page:
    tokens: list[tuple[str, str]] = []
    elements: list[Element] = []
    open_: list[Element] = []
    names: Counter[str] = Counter()
    at = pos = 0

    def end(until: Element) -> None:
        while True:
            e = open_.pop()
            names[e.name] -= 1
            e.end = len(tokens)
            if e is until:
                return

    while m := _TOKEN.search(page, pos):
        if m.start() > at:
            tokens.append(("", page[at : m.start()]))
        pos = at = max(m.end(), m.start() + 1)
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if names[name]:
                end(next(e for e in reversed(open_) if e.name == name))
            tokens.append((name, ""))
            continue
        # Elements that nobody closed end where one starts that they cannot hold.
        if open_ and (open_[-1].name in ENDS.get(name, ()) or open_[-1].name == "p" and name not in INLINE and name not in VOID):
            end(open_[-1])
        e = Element(name, m[3], len(tokens), len(tokens), any(names[c] for c in CONTENT))
        elements.append(e)
        tokens.append((name, ""))
        if name in VOID or m[3].rstrip().endswith("/") and name not in INLINE | TEXTUAL | CONTENT:
            continue
        if name in RAW:  # its content is no markup
            last = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, pos)
            pos = at = last.end() if last else len(page)
            tokens.append((name, ""))
            e.end = len(tokens) - 1
            continue
        open_.append(e)
        names[name] += 1
    if at < len(page):
        tokens.append(("", page[at:]))
    for e in open_:
        e.end = len(tokens)
    return Page(tokens, elements)


def wrappers(page: Page) -> list[bool]:
    """For each element, whether an outermost content element lies within it; for a form, also whether a page's heading does."""
    outermost = [e.start for e in page.elements if e.name in CONTENT and not e.within]
    headings = [e.start for e in page.elements if e.name == "h1"]
    holds = lambda at, e: (k := bisect_right(at, e.start)) < len(at) and at[k] < e.end
    return [holds(outermost, e) or e.name == "form" and holds(headings, e) for e in page.elements]


def usable(page: Page, model: Model) -> list[bool]:
    """For each token, whether it is outside all elements that are left out."""
    ok = [True] * len(page.tokens)
    done = -1
    for e, wraps in zip(page.elements, wrappers(page), strict=True):
        if e.start <= done or wraps or e.name in ("html", "body") or e.name in VOID:
            continue
        if e.name in NEVER or e.name == "header" and not e.within or e.attrs and model.leaves_out(e.attrs):
            done = min(e.end, len(ok) - 1)
            last = done + 1 if done > e.start and page.tokens[done][0] == e.name else max(e.start + 1, e.end)
            ok[e.start : last] = [False] * (min(last, len(ok)) - e.start)
            done = last - 1
    return ok


def scores(page: Page, model: Model) -> tuple[list[float], list[bool]]:
    """The score of each token, and whether it may be returned. The tags of outermost content elements are edges of the text."""
    ok = usable(page, model)
    out = [float(len(text.split())) if keep and not tag else -model.cost(tag) if keep else 0.0 if not tag else -LEAST for (tag, text), keep in zip(page.tokens, ok, strict=True)]
    for e in page.elements:
        if e.name in CONTENT and not e.within and ok[e.start]:
            out[e.start] = -PRIOR["edge"]
            if e.end < len(out) and page.tokens[e.end][0] == e.name:
                out[e.end] = -PRIOR["edge"]
    return out, ok


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum (Kadane): the first and shortest of equals; (0, 0) if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def extract_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    parsed = parse(page)
    score, ok = scores(parsed, model)
    blocks, now = [], []
    s, e = best_run(score)
    for (tag, text), keep in zip(parsed.tokens[s:e], ok[s:e], strict=True):
        if not tag:
            if keep:
                now.append(entities.unescape(text) if "&" in text else text)
        elif tag not in INLINE:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return " ".join(t for b in blocks if (t := " ".join(b.split())))


def train(pages: list[str]) -> Model:
    """Roles and costs from pages that label their own content; pages without a label teach nothing.

    The tags of outermost content elements are neither inside nor outside, and elements around them have no role."""
    seen_in, seen_out = Counter(), Counter()
    labelled = []
    for text in sorted(pages):
        page = parse(text)
        spans = [(e.start, e.end) for e in page.elements if e.name in CONTENT and not e.within]
        if not spans:
            continue
        inside = [False] * len(page.tokens)
        for s, e in spans:
            inside[s + 1 : e] = [True] * (min(e, len(inside)) - s - 1)
        labelled.append((page, inside, {x for s, e in spans for x in (s, e)}))
        for e, wraps in zip(page.elements, wrappers(page), strict=True):
            if e.attrs and not wraps and not (e.name in CONTENT and not e.within):
                (seen_in if inside[e.start] else seen_out).update(set(role_words(e.attrs)))
    outside = {}
    for w in sorted(seen_in.keys() | seen_out.keys()):
        if not known_outside(w):  # known words keep their role: articles hold adverts and comments too
            outside[w] = math.log((seen_out[w] + 0.5) / (seen_in[w] + 0.5)) if seen_out[w] >= SEEN else 0.0
    model = Model({}, outside)
    n_in, n_out = Counter(), Counter()
    for page, inside, edges in labelled:
        ok = usable(page, model)
        for i, (tag, text) in enumerate(page.tokens):
            if ok[i] and i not in edges and tag not in ("html", "body"):
                (n_in if inside[i] else n_out)[tag] += 1 if tag else len(text.split())
    # A word's odds of being inside are the unit; a tag costs how much worse its own are, on top of its class.
    word = math.log((n_in[""] + 1) / (n_out[""] + 1))
    for tag in sorted((n_in.keys() | n_out.keys()) - {""}):
        seen = n_in[tag] + n_out[tag]
        worse = (word - math.log((n_in[tag] + 1) / (n_out[tag] + 1))) / max(1.0, abs(word))
        share = seen / (seen + PRIOR_PAGES)
        model.costs[tag] = min(MOST, max(LEAST, (1 - share) * PRIOR[structure(tag)] + share * max(0.0, worse) * PRIOR[structure(tag)]))
    return model


def fit(df: DataFrame, *, html_col: str = "html", key_col: str = "page_id", sample_rows: int = 400) -> Model:
    """Fit on about `sample_rows` whole pages, chosen by a hash of the key (bounded, the same in every run)."""
    usable_ = df.where(F.col(f"`{html_col}`").isNotNull())
    return train([r[0] for r in bounded_sample(usable_, F.col(f"`{key_col}`"), sample_rows).select(F.col(f"`{html_col}`")).collect()])


def extract(df: DataFrame, model: Model, html_col: str = "html", out_col: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all by default) with the main text of each whole page. Null and empty pages, and pages
    without words, give an empty text.

    Broken markup is read as far as it goes; rows are independent; a column named out_col is replaced; other columns
    pass through; an empty table stays empty."""

    def fn(pages: list) -> list[pa.Array]:
        return [pa.array([extract_text(p, model) for p in pages], pa.string())]

    return with_arrow_columns(df, html_col, [T.StructField(out_col, T.StringType())], fn, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages), keep=["page_id", "url"]).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
