"""SQL of the numbered queries that SQL can express on whole tables."""

from __future__ import annotations

from . import centroids
from .quality import GUARD, MIN_ROWS, RATIOS, SPREAD_FACTOR

_WORDS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(20) AS t(j)),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS s FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_ASCII_LOWER.format('text'))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON o.x = p.doc_id JOIN n q ON o.y = q.doc_id WHERE 100 * c >= 90 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT DISTINCT x AS d, x AS t FROM e UNION SELECT r.d, e.y FROM r JOIN e ON r.t = e.x),
c AS (SELECT d, min(t) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.d
"""

SNAPSHOTS = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, role, text FROM conversations),
p AS (SELECT conv_id, pos, role, text, string_agg(role || chr(1) || text || chr(2), '') OVER (PARTITION BY conv_id ORDER BY pos) AS s, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT conv_id, n, s FROM p WHERE pos = n),
k AS (SELECT min(conv_id) AS conv_id, n, s FROM w GROUP BY n, s),
kept AS (SELECT conv_id FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos = k.n AND p.n > k.n AND p.s = k.s))
SELECT p.conv_id, pos AS turn_index, n AS n_turns, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered FROM p JOIN kept ON p.conv_id = kept.conv_id
"""


def _limit(r: str) -> str:
    def at(level: str, q: float) -> str:
        return f"{level}_{r}[greatest(ceil({q} * len({level}_{r})), 1)::INT]"

    def spread(level: str) -> str:
        return f"({at(level, 0.9)} - {at(level, 0.5)})"

    def fence(level: str, width: str) -> str:
        return f"{at(level, 0.5)} + {SPREAD_FACTOR} * greatest({width}, {RATIOS[r]})"

    own = f"least({spread('o')}, {GUARD} * greatest({spread('l')}, {RATIOS[r]}))"
    return f"CASE WHEN o_n >= {MIN_ROWS} THEN {fence('o', own)} WHEN l_n >= {MIN_ROWS} THEN {fence('l', spread('l'))} ELSE {fence('c', spread('c'))} END"


def _sorted(level: str) -> str:
    return ", ".join(f"list_sort(list({r})) AS {level}_{r}" for r in RATIOS)


QUALITY = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS.format('text')} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
h AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g), range(3) AS t(j) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
m AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (length(text) - length(replace(text, '!', '')))::BIGINT AS bangs, len(regexp_extract_all(text, '\\p{{Lu}}'))::BIGINT AS upper,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
r AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_symbols / greatest(word_chars, 1)::DOUBLE AS symbol_ratio, (len(lines) - len(list_distinct(lines))) / greatest(len(lines), 1)::DOUBLE AS dup_line_ratio,
  n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_ratio, upper / greatest(word_chars, 1)::DOUBLE AS upper_ratio, bangs / greatest(word_chars, 1)::DOUBLE AS bang_ratio, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
o AS (SELECT lang, source, count(*) AS o_n, {_sorted('o')} FROM r WHERE NOT base_failed GROUP BY 1, 2),
l AS (SELECT lang, count(*) AS l_n, {_sorted('l')} FROM r WHERE NOT base_failed GROUP BY 1),
c AS (SELECT {_sorted('c')} FROM r WHERE NOT base_failed),
lim AS (SELECT o.lang, o.source, {', '.join(f'{_limit(r)} AS max_{r}' for r in RATIOS)} FROM o JOIN l ON o.lang = l.lang, c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(f'{r} <= coalesce(max_{r}, 1e9)' for r in RATIOS)} AS kept
FROM r LEFT JOIN lim ON r.lang = lim.lang AND r.source = lim.source
"""


def _clusters() -> str:
    near = "list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x)"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({centroids.SCALE} * e::DOUBLE)) AS x FROM embeddings WHERE len(embedding) = {centroids.DIM} AND len(list_filter(embedding, lambda e: isfinite(e))) = {centroids.DIM})",
        f"c0 AS MATERIALIZED (SELECT k, x FROM (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id), x) - 1 AS k, x FROM v) WHERE k < {centroids.CLUSTERS})",
    ]
    for i in range(centroids.ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.r, c.k, {near} AS d FROM v, c{i} AS c) GROUP BY r)")
        if i < centroids.ROUNDS:
            parts += [
                f"s{i} AS (SELECT k, j, sum(x[j])::HUGEINT AS t, count(*) AS n FROM a{i} JOIN v ON a{i}.r = v.r, range(1, {centroids.DIM + 1}) AS g(j) GROUP BY 1, 2)",
                f"m{i} AS (SELECT k, list(((t - ((t % n) + n) % n) // n)::DOUBLE ORDER BY j) AS x FROM s{i} GROUP BY k)",
                f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m{i}.x, c.x) AS x FROM c{i} AS c LEFT JOIN m{i} ON c.k = m{i}.k)",
            ]
    last = centroids.ROUNDS
    return f"""
WITH {', '.join(parts)}
SELECT vec_id, a.k::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda e: e::BIGINT), ',')) AS centroid_sha256
FROM a{last} AS a JOIN v ON a.r = v.r JOIN c{last} AS c ON a.k = c.k
"""


ORACLE = {
    "op1_quality_rules": QUALITY,
    "op4_snapshot_collapse": SNAPSHOTS,
    "op8_substring_dedup": SUBSTRING,
    "op10_ngram_jaccard": JACCARD,
    "op13_scalar_tables": _clusters(),
}
