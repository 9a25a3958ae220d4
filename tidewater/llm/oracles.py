"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from tidewater.llm.exact_dedup import LOWER, UPPER
from tidewater.llm.secrets import KINDS, MIXED, SCOPE, WIDE


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secrets_sql() -> str:
    text = "coalesce(text, '')"
    parts = []
    for i, k in enumerate(KINDS):
        long = f"len(regexp_extract(m, {_quoted(k.pattern)}, {k.group})) >= {k.least}" if k.group else "true"
        holds = " AND ".join([long, *(f"regexp_matches(m, {_quoted(p)})" for p in k.holds)])
        parts.append(f"SELECT doc_id, {i} AS kind, '{k.name}' AS name, {k.weak} AS weak, '{'secret' if k.role == 'secret' else 'other'}' AS part, e - len(m) AS s, e FROM (SELECT doc_id, m, sum(len(gap) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(gaps[1:len(ms)]) AS gap, unnest(ms) AS m FROM (SELECT doc_id, string_split_regex({text}, {_quoted(k.pattern)}) AS gaps, regexp_extract_all({text}, {_quoted(k.pattern)}) AS ms FROM documents))) WHERE {holds}")
    wide = ", ".join(map(str, WIDE))
    found = "a AS (" + " UNION ALL ".join(parts) + f"), f AS (SELECT * FROM a WHERE kind <> {MIXED} OR NOT EXISTS (SELECT 1 FROM a o WHERE o.doc_id = a.doc_id AND o.kind IN ({wide}) AND o.s <= a.s AND o.e >= a.e))"
    linked = f"l AS (SELECT * FROM f WHERE NOT weak UNION ALL SELECT * FROM f WHERE weak AND EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.part <> f.part AND (g.e <= f.s OR f.e <= g.s) AND abs(g.s - f.s) <= {SCOPE}))"
    said = "name || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = {i}) AS BIGINT) AS n_{k.name}" for i, k in enumerate(KINDS[:3]))
    return f"WITH {found}, {linked} SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({said}, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg({said}, ',' ORDER BY s, kind) FILTER (kind IS NOT NULL), '') AS spans FROM documents d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id"


def substring_sql(length: int = 35) -> str:
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + {length - 1}], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {length} + 2, 1))) AS s FROM w)),
twice AS (SELECT t, min((doc_id, s)) AS f FROM win GROUP BY t HAVING count(*) > 1),
again AS (SELECT doc_id, s, f[1] AS d, f[2] AS p FROM win JOIN twice USING (t)),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM (SELECT doc_id, s FROM win WHERE t IN (SELECT t FROM twice)), range(0, {length}) r(k)),
each AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
heads AS (SELECT doc_id, count(*) AS n_heads FROM again g WHERE NOT EXISTS (SELECT 1 FROM again b WHERE b.doc_id = g.doc_id AND b.s = g.s - 1 AND b.d = g.d AND b.p = g.p - 1) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, CAST(coalesce(n_heads, 0) AS BIGINT) AS n_repeats FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN heads USING (doc_id)"""


EMBEDDING_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id WHERE r.c < l.b),
lowest AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, CAST(count(l.b) AS BIGINT) AS n_links, any_value(component_id) AS component_id, vec_id = any_value(component_id) AS kept FROM lowest LEFT JOIN l ON l.a = vec_id GROUP BY vec_id"""

EXACT_SQL = f"""WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM n"""

SEARCH_SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM benchmark),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(ts) AS term FROM b) GROUP BY ALL),
total AS (SELECT count(*) FILTER (len(ts) > 0) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
m AS (SELECT doc_id, 75 + (25 * len(ts) * n) // l AS m FROM d, total),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20"""

NEGATIVES_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.y = b.y AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10"""

ORACLE_SQL = {
    "op1_secret_scans": secrets_sql(),
    "op3_substring_dedup": substring_sql(),
    "op5_embedding_near_dedup": EMBEDDING_SQL,
    "op11_exact_dedup": EXACT_SQL,
    "op12_ranked_lexical_search": SEARCH_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
