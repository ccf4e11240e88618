"""DuckDB SQL for the queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

from .secrets import BASE, RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
  least AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN least USING (h) WHERE first < doc_id),
  cut AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
  link AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 75 * (a.n + b.n - m)),
  step AS (SELECT x AS a, y AS b FROM link UNION SELECT y, x FROM link),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, step.b FROM reach JOIN step ON step.a = reach.b),
  least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)"""

#: The rules' patterns as plain ones: kind to (pattern, group that must be long enough, its least length).
_SECRETS = {
    "assign": ("""(?:(?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
    "pem": ("-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 0),
    "forge": ("gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "chat": ("xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "jwt": ("eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}", 0, 0),
}


def _spans(rank: int, kind: str) -> str:
    """(start, rank, kind, end) of one kind's matches: the gaps and matches before each add up to its start."""
    pattern, group, least = _SECRETS[kind]
    found = f"regexp_extract_all(t, '{pattern}')"
    sizes = f"list_transform({found}, lambda x: length(x))"
    gaps = f"list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x))"
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + size AS stop FROM (
      SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0))) AS start, unnest(m) AS size, unnest(k) AS part
      FROM (SELECT doc_id, {sizes} AS m, {gaps} AS g, list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x)) AS k FROM d)) WHERE part >= {least}"""


def _listed(only: str) -> str:
    return f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER ({only}), '')"


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  f AS ({" UNION ALL ".join(_spans(k, r.name) for k, r in enumerate(RULES))}),
  g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, {_listed(f"kind IN {BASE}")} AS base, {_listed("true")} AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": SUBSTRINGS, "op4_secret_ledger": SECRETS, "op5_jaccard_join": JACCARD}
