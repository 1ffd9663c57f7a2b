"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from cohortry.llm import bpe, embeddings, html, langid, neardup, packing, quality, secrets, suffix, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_suffix_dedup": suffix.query,
    "op2_byte_bpe": bpe.query,
    "op3_secret_scan": secrets.query,
    "op4_html_extract": html.query,
    "op5_toxicity": toxicity.query,
    "op6_embedding_dedup": embeddings.query,
    "op7_language_id": langid.query,
    "op8_minhash_dedup": neardup.query,
    "op9_quality_rules": quality.query,
    "op10_packing": packing.query,
}

def _any_case(pattern: str) -> str:
    """Letters of the keyword group in either case, spelt out: the (?i) of SQL engines goes beyond ASCII."""
    head, words, tail = re.fullmatch(r"(\()\(\?i:([^)]*)\)(.*)", pattern, re.S).groups()
    return head + re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words) + tail


def _secrets_sql() -> str:
    parts = []
    for rank, rule in enumerate(secrets.BASE + secrets.MORE):
        pattern = (_any_case(rule.pattern) if "(?i:" in rule.pattern else rule.pattern).replace("'", "''")
        parts.append(f"""
        SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, start, start + length(m[i]) AS stop FROM (SELECT doc_id, m, g, i,
          list_sum(list_transform(gaps[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS start
          FROM (SELECT doc_id, m, g, gaps, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS gaps FROM d)))
        WHERE length(g[i]) >= {rule.least}""")
    n = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    span = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)}),
    a AS (SELECT doc_id, {n}, string_agg({span}, ',' ORDER BY start, rank) FILTER (rank < {len(secrets.BASE)}) AS base, string_agg({span}, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


#: Components as the closure of links (x, y) from every id of n.
_CLOSURE = "r(id, c) AS (SELECT id, id FROM n UNION SELECT r.id, l.y FROM r JOIN l ON r.c = l.x), k AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)"

SQL: dict[str, str] = {
    "op1_suffix_dedup": """
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    w AS (SELECT doc_id, p, md5(b[p:p + 99]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS p FROM d)),
    f AS (SELECT h, min({'k': doc_id, 'p': p}) AS first FROM w GROUP BY h HAVING count(*) > 1),
    r AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w JOIN f USING (h) WHERE {'k': doc_id, 'p': p} <> first),
    s AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM r),
    g AS (SELECT doc_id, min(p) AS lo, max(p) + 99 AS hi FROM s GROUP BY doc_id, g),
    a AS (SELECT doc_id, count(*) AS n, sum(hi - lo + 1) AS gone, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM g GROUP BY doc_id),
    k AS (SELECT doc_id, b, n, gone, los, his FROM d LEFT JOIN a USING (doc_id)),
    e AS (SELECT doc_id, b, n, gone, CASE WHEN n IS NULL THEN b ELSE list_reduce(list_transform(range(0, n + 1), lambda i: b[CASE WHEN i = 0 THEN 1 ELSE his[i] + 1 END:CASE WHEN i = n THEN octet_length(b) ELSE los[i + 1] - 1 END]), lambda x, y: x || y) END AS kept FROM k)
    SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(kept) AS kept_sha256 FROM e""",
    "op3_secret_scan": _secrets_sql(),
    "op6_embedding_dedup": f"""
    WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS s FROM v),
    l AS (SELECT a.id AS x, b.id AS y FROM n a JOIN n b ON a.id <> b.id WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.95), {_CLOSURE}, c AS (SELECT x AS id, count(*) AS n_links FROM l GROUP BY x)
    SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM k LEFT JOIN c USING (id)""",
    "op8_minhash_dedup": rf"""
    WITH RECURSIVE t AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda w: w <> '') AS w FROM documents),
    u AS (SELECT id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM t), n AS (SELECT id, len(s) AS n FROM u), e AS (SELECT id, unnest(s) AS s FROM u),
    i AS (SELECT a.id AS x, b.id AS y, count(*) AS shared FROM e a JOIN e b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2), j AS (SELECT x, y FROM i JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
    l AS (SELECT x, y FROM j UNION ALL SELECT y, x FROM j), {_CLOSURE}
    SELECT k.id AS doc_id, n.n AS n_shingles, component_id, k.id = component_id AS kept FROM k JOIN n ON n.id = k.id""",
}
