"""DuckDB SQL of the operators that SQL can express, each computed another way
than the Spark operator does."""

from __future__ import annotations

from tokenflow.llm import centroid_clusters as C, mixing, quality_rules as Q, url_filter as U, vector_codes as V

_SPLIT = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
        THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.r) AS component_id
FROM documents d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1
"""

LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE text <> ''),
w AS (SELECT *, sum(len({_SPLIT.format('line')})) OVER (PARTITION BY doc_id ORDER BY ln) AS upto,
             coalesce(sum(len({_SPLIT.format('line')})) OVER (PARTITION BY doc_id ORDER BY ln
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
blocks AS (SELECT s.doc_id, s.ln AS a, min(e.ln) AS b FROM w s JOIN w e ON e.doc_id = s.doc_id AND e.ln >= s.ln
             AND e.upto - s.before >= 50 GROUP BY 1, 2
           UNION SELECT e.doc_id, max(s.ln), e.ln FROM w e JOIN w s ON e.doc_id = s.doc_id AND s.ln <= e.ln
             AND e.upto - s.before >= 50 GROUP BY e.doc_id, e.ln),
body AS (SELECT k.doc_id, k.a, k.b, md5(string_agg(l.line, chr(10) ORDER BY l.ln)) AS h
         FROM blocks k JOIN l ON l.doc_id = k.doc_id AND l.ln BETWEEN k.a AND k.b GROUP BY 1, 2, 3),
later AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, a) AS r FROM body) WHERE r > 1),
gone AS (SELECT DISTINCT l.doc_id, l.ln FROM l JOIN later ON later.doc_id = l.doc_id AND l.ln BETWEEN later.a AND later.b),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (WHERE gone.ln IS NULL) AS t, count(*) AS n, count(gone.ln) AS k
         FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.ln = l.ln GROUP BY 1)
SELECT d.doc_id, CASE WHEN kept.k > 0 THEN coalesce(kept.t, '') ELSE d.text END AS text,
  CAST(coalesce(kept.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(kept.k, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def _stated() -> str:
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'"
        for h, p, _ in sorted(U.RULES, key=lambda r: -len(r[0] + r[1])))
    return f"CASE {cases} END"


_VERDICT = "CASE " + " ".join(f"WHEN rule = '{h + p}' THEN '{v}'" for h, p, v in U.RULES) + " END"

URLS = f"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {_stated()} AS rule, string_split(host, '.') AS lab FROM h),
t AS (SELECT *, {_VERDICT} AS known, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_filter(list_concat(
    ['tld=' || lab[len(lab)], CASE WHEN len(lab) >= 2 THEN 'domain=' || array_to_string(lab[greatest(len(lab) - 2, 1):], '.') END,
     CASE WHEN len(lab) >= 4 THEN 'sub=' || lab[1] END,
     CASE WHEN string_split(path, '/')[2] <> '' THEN 'dir=' || regexp_replace(string_split(path, '/')[2], '[0-9]+', '#', 'g') END],
    CASE WHEN len(lab) >= 3 THEN list_transform(list_filter(string_split(lab[len(lab) - 2], '-'), lambda x: x <> ''), lambda x: 'name=' || x) ELSE [] END,
    list_transform(list_filter(string_split(regexp_extract(coalesce(url, ''), '\\?([^#]*)', 1), '&'), lambda x: x <> ''),
                   lambda x: 'param=' || string_split(x, '=')[1])), lambda x: x IS NOT NULL))) END AS tok FROM r),
total AS (SELECT count(*) AS n FROM t WHERE len(tok) > 0),
sub AS (SELECT page_id, known, rule, array_to_string(list_filter(tok, lambda x, i: (m >> (i - 1)) & 1 = 1), ' ') AS body, bit_count(m) AS size
        FROM t, LATERAL (SELECT unnest(range(1, CAST(1 << len(tok) AS BIGINT))) AS m)),
al AS (SELECT body, count(*) AS n FROM sub GROUP BY 1),
by_v AS (SELECT body, any_value(size) AS size, known, count(*) AS n FROM sub WHERE known IS NOT NULL GROUP BY body, known
         HAVING count(*) >= ceil({U.MIN_SUPPORT} * (SELECT n FROM total))),
lab AS (SELECT body, sum(n) AS k FROM by_v GROUP BY 1),
rules AS (SELECT by_v.*, CAST(by_v.n AS DOUBLE) / k AS conf FROM by_v JOIN lab USING (body) JOIN al USING (body)
          WHERE CAST(by_v.n AS DOUBLE) / k >= {U.MIN_CONFIDENCE} AND k >= {U.MIN_LABELLED} * al.n),
best AS (SELECT page_id, body, known AS v FROM (
    SELECT sub.page_id, rules.*, row_number() OVER (PARTITION BY sub.page_id
      ORDER BY conf DESC, n DESC, rules.size DESC, rules.body DESC, rules.known DESC) AS k
    FROM sub JOIN rules ON rules.body = sub.body WHERE sub.rule IS NULL) WHERE k = 1)
SELECT t.page_id, t.host, t.path, t.rule, coalesce(t.known, best.v, 'allow') AS verdict, best.body AS mined_rule
FROM t LEFT JOIN best ON best.page_id = t.page_id
"""


def _quality() -> str:
    r = len(Q.RULES)
    votes = ", ".join(f"CASE WHEN {x.bad} THEN {Q.BAD} WHEN {x.good} THEN {Q.GOOD} ELSE {Q.ABSTAIN} END" for x in Q.RULES)
    prior = {k: "[" + ", ".join(f"{x}::DOUBLE" for x in v) + "]" for k, v in Q.PRIOR.items()}

    def cells(kind: str, weight: str) -> str:
        return (f"list_transform(range(0, {3 * r}), lambda k: ln((list_sum(list_transform(range(1, len(pn) + 1), lambda i: "
                f"CASE WHEN pv[i][(k // 3) + 1] = k % 3 THEN pn[i] * {weight} ELSE 0.0 END)) + "
                f"(list_sum(list_transform(range(1, len(pn) + 1), lambda i: pn[i] * {weight})) + 1.0) * {prior[kind]}[(k % 3) + 1]) "
                f"/ (2.0 * list_sum(list_transform(range(1, len(pn) + 1), lambda i: pn[i] * {weight})) + 1.0)))")
    return f"""
WITH RECURSIVE a AS (SELECT doc_id, coalesce(text, '') AS t, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT doc_id, t, w, regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g') AS bare,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
        list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' ')) AS g FROM a),
win AS (SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM b),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
c AS (SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(bare) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(bare, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        len(l) AS n_lines, length(regexp_replace(bare, '[^A-Z]', '', 'g')) AS n_upper, len(list_distinct(w)) AS n_distinct
      FROM b LEFT JOIN cov ON cov.doc_id = b.doc_id),
v AS (SELECT *, [{votes}] AS v, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
pat AS (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY v),
ps AS (SELECT list(v ORDER BY v) AS pv, list(n ORDER BY v) AS pn FROM pat),
em AS (SELECT 0 AS it, list_transform(pv, lambda x: CASE WHEN list_contains(x, {Q.BAD}) THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END) AS q FROM ps
  UNION ALL
  SELECT it + 1, list_transform(pv, lambda x: 1.0 / (1.0 + exp(-greatest(-500.0, least(500.0,
    list_sum(list_transform(range(0, {r}), lambda j: g[CAST(3 * j + x[j + 1] + 1 AS BIGINT)] - b[CAST(3 * j + x[j + 1] + 1 AS BIGINT)]))))))) AS q
  FROM (SELECT it, pv, {cells('good', 'q[i]')} AS g, {cells('bad', '(1.0 - q[i])')} AS b FROM em, ps WHERE it <= {Q.EM_ROUNDS})),
post AS (SELECT unnest(pv) AS v, unnest(q) AS p FROM em, ps WHERE it = {Q.EM_ROUNDS + 1})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept,
  round(p, 6) AS p_good
FROM v JOIN post ON post.v = v.v
"""


VECTORS = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM e UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.component_id = c.vec_id AS kept
FROM c LEFT JOIN n ON n.a = c.vec_id
"""

_WHOLE = "v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_FLOOR_MEAN = "CAST((sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def _clusters() -> str:
    """One row per component, the distances by a join on the component."""
    steps = []
    for n in range(C.ROUNDS + 1):
        steps.append(f"""a{n} AS (SELECT r, k, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, k) AS place FROM (
  SELECT x.r, c.k, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{n} c ON c.i = x.i GROUP BY x.r, c.k)) WHERE place = 1)""")
        if n < C.ROUNDS:
            steps.append(f"""c{n + 1} AS (SELECT c.k, c.i, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
  SELECT a.k, x.i, {_FLOOR_MEAN} AS v FROM x JOIN a{n} a ON a.r = x.r GROUP BY a.k, x.i) m ON m.k = c.k AND m.i = c.i)""")
    last = C.ROUNDS
    return f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT row_number() OVER () AS r, vec_id, v FROM e WHERE {_WHOLE} AND len(v) = {C.WIDTH}),
x AS (SELECT r, i, CAST(floor({C.SCALE} * v[i]) AS BIGINT) AS v FROM ok, (SELECT unnest(range(1, {C.WIDTH + 1})) AS i)),
starts AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k FROM ok),
c0 AS (SELECT s.k, x.i, x.v FROM starts s JOIN x ON x.r = s.r WHERE s.k < {C.K}),
{", ".join(steps)},
digests AS (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS h FROM c{last} GROUP BY k)
SELECT ok.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{last} a JOIN ok ON ok.r = a.r JOIN digests ON digests.k = a.k
"""


def _codes() -> str:
    """Direct squared distances, one row per component."""
    steps = []
    for n in range(V.ROUNDS + 1):
        steps.append(f"""a{n} AS (SELECT r, p, k, d FROM (SELECT *, row_number() OVER (PARTITION BY r, p ORDER BY d, k) AS place FROM (
  SELECT x.r, x.p, c.k, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{n} c ON c.p = x.p AND c.i = x.i GROUP BY x.r, x.p, c.k))
  WHERE place = 1)""")
        if n < V.ROUNDS:
            steps.append(f"""c{n + 1} AS (SELECT c.k, c.p, c.i, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
  SELECT a.k, x.p, x.i, {_FLOOR_MEAN} AS v FROM x JOIN a{n} a ON a.r = x.r AND a.p = x.p GROUP BY a.k, x.p, x.i) m
  ON m.k = c.k AND m.p = c.p AND m.i = c.i)""")
    last = V.ROUNDS
    return f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT row_number() OVER () AS r, vec_id, label, v FROM e WHERE {_WHOLE}),
w AS (SELECT CAST(ceil(max(len(v)) / {V.PARTS}) AS BIGINT) AS w FROM ok),
x AS (SELECT r, (i - 1) // w AS p, (i - 1) % w AS i, CAST(floor({V.SCALE} * coalesce(v[i], 0)) AS BIGINT) AS v
      FROM (SELECT r, v, w, unnest(range(1, {V.PARTS} * w + 1)) AS i FROM ok, w)),
starts AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS k FROM ok),
c0 AS (SELECT s.k, x.p, x.i, x.v FROM starts s JOIN x ON x.r = s.r WHERE s.k < {V.ENTRIES}),
{", ".join(steps)},
coded AS (SELECT r, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY r),
digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, k, i)) AS h FROM c{last})
SELECT ok.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM digest) AS codebooks_sha256
FROM coded JOIN ok ON ok.r = coded.r
"""


ORACLE = {
    "op11_centroid_clusters": _clusters(),
    "op12_vector_codes": _codes(),
    "op1_jaccard_join": JACCARD,
    "op4_line_dedup": LINES,
    "op5_url_filter": URLS,
    "op7_quality_rules": _quality(),
    "op8_embedding_dedup": VECTORS,
    "op9_mixing": mixing.SQL,
}
