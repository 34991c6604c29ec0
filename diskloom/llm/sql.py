"""DuckDB SQL of the queries that SQL can express, written apart from the Spark code."""

from __future__ import annotations

from diskloom.llm import linededup, secrets, urlfilter


def op2(min_sites: int = linededup.MIN_SITES, min_chars: int = linededup.MIN_CHARS) -> str:
    return f"""
WITH parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines, text FROM documents),
l AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts WHERE text IS NOT NULL),
b AS (SELECT line AS k, min(doc_id) AS first_doc FROM l WHERE length(line) >= {min_chars} GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
m AS (SELECT doc_id, pos, line, coalesce(doc_id <> first_doc, false) AS gone FROM l LEFT JOIN b ON line = k),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, text FROM a
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL"""


def op5() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rules = sorted(urlfilter.HOST_RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = lambda h, p: f"((host = {quote(h)} OR ends_with(host, {quote('.' + h)})) AND starts_with(path, {quote(p)}))"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN {quote(h + p)}" for _, h, p in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN {quote(v)}" for v, h, p in rules) + " END"
    ids = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(u, {quote(p)}) THEN {k} END" for k, (_, p, _) in enumerate(urlfilter.PATTERN_RULES)) + "], lambda x: x IS NOT NULL)"
    allows = "[" + ", ".join(str(k) for k, r in enumerate(urlfilter.PATTERN_RULES) if r[0] == "allow") + "]"
    return f"""
WITH p AS (SELECT page_id, lower(url) AS u, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, coalesce(contains(url, '://'), false) AS ok FROM pages),
q AS (SELECT page_id, u, CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host, CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p),
r AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS ruled, coalesce({ids}, []) AS ids FROM q)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN len(ids) > 0 AND len(list_intersect(ids, {allows})) = 0 THEN 'block' ELSE 'allow' END) AS verdict, array_to_string(ids, ',') AS matched FROM r"""


def _spans(pattern: str, kind: str) -> str:
    """List of structs (start, stop, kind, value) of the matches of a pattern in column t."""
    p = pattern.replace("'", "''")
    return f"""list_transform(list_zip(regexp_extract_all(t, '{p}'), range(0, len(regexp_extract_all(t, '{p}')))), lambda z: {{'s': list_sum(list_transform(list_slice(regexp_split_to_array(t, '{p}'), 1, z[2] + 1), lambda g: length(g))) + coalesce(list_sum(list_transform(list_slice(regexp_extract_all(t, '{p}'), 1, z[2]), lambda m: length(m))), 0), 'v': z[1], 'k': '{kind}'}})"""


def op8() -> str:
    """Spans by cumulated lengths, then the three tests and the step-up thresholds, in rows rather than in arrays."""
    logistic = lambda z: f"(1 + exp(1.5976 * {z} + 0.07056 * {z} * {z} * {z}))"
    alphabet = "CASE encoding " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in secrets.ALPHABETS.items()) + " END"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED (
  SELECT rid, 0 AS r, unnest({_spans(secrets.ASSIGN, "assign")}) AS m FROM d WHERE regexp_matches(t, '{secrets.ASSIGN.replace("'", "''")}')
  UNION ALL SELECT rid, 1, unnest({_spans(secrets.ACCESS, "access")}) FROM d WHERE regexp_matches(t, '{secrets.ACCESS}')
  UNION ALL SELECT rid, 2, unnest({_spans(secrets.HEX, "hex")}) FROM d WHERE regexp_matches(t, '{secrets.HEX}')
  UNION ALL SELECT rid, 3, unnest({_spans(secrets.TOKEN, "random")}) FROM d WHERE regexp_matches(t, '{secrets.TOKEN}')),
b AS (SELECT rid, r, m.k AS kind, m.s AS a, m.s + length(m.v) AS z FROM s WHERE r IN (1, 2) OR (r = 0 AND length(regexp_extract(m.v, '{secrets.ASSIGN.replace("'", "''")}', 2)) >= 8)),
tok AS (SELECT row_number() OVER () AS tid, rid, m.s AS a, m.v AS v FROM s WHERE r = 3 AND regexp_matches(m.v, '[0-9]') AND regexp_matches(m.v, '[A-Za-z]')),
enc AS (SELECT *, CASE WHEN length(bare) < 16 THEN 'base64' WHEN regexp_full_match(bare, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(bare, '[A-Z2-7]+') THEN 'base32' WHEN regexp_full_match(bare, '[0-9a-z]+|[0-9A-Z]+') THEN 'base36' ELSE 'base64' END AS encoding FROM (SELECT *, translate(v, '-_', '') AS bare FROM tok)),
cls AS (SELECT tid, rid, a, v, encoding, {alphabet} AS al, length(v) AS len, CASE WHEN encoding IN ('hex', 'base36') THEN lower(translate(v, '-_', '+/')) ELSE translate(v, '-_', '+/') END AS f, CASE WHEN length(v) < 20 THEN 0 WHEN length(v) < 24 THEN 1 WHEN length(v) < 32 THEN 2 WHEN length(v) < 48 THEN 3 WHEN length(v) < 96 THEN 4 ELSE 5 END AS size FROM enc),
pos AS (SELECT * FROM (SELECT tid, length(al) AS k, i, strpos(al, substr(f, i, 1)) - 1 AS x FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM cls)) WHERE x >= 0),
dim AS (SELECT tid, n, k, least(k, greatest(2, n // 5)) AS g FROM (SELECT tid, count(*) AS n, any_value(k) AS k FROM pos GROUP BY tid)),
ch AS (SELECT tid, n, k, g, i, x FROM pos JOIN dim USING (tid, k)),
mom AS (SELECT tid, any_value(n) AS n, sum(x)::DOUBLE / any_value(n) AS mean, sum((x * 2 >= k)::INT)::INT AS n1 FROM ch GROUP BY tid),
nxt AS (SELECT ch.*, lead(x) OVER (PARTITION BY tid ORDER BY i) AS y FROM ch),
ser AS (SELECT nxt.tid, sum((x - mean) * (x - mean)) AS var, sum((x - mean) * (y - mean)) AS cov, 1 + sum(((x * 2 >= k) <> (y * 2 >= k))::INT) AS runs, any_value(mom.n) AS n, any_value(n1) AS n1, any_value(mom.n) - any_value(n1) AS n0 FROM nxt JOIN mom USING (tid) GROUP BY nxt.tid),
obs AS (SELECT tid, (x * g) // k AS grp, count(*) AS o FROM ch GROUP BY ALL),
cells AS (SELECT tid, n, k, g, unnest(range(0, g)) AS grp FROM dim),
chi AS (SELECT c.tid, any_value(g) AS g, sum(pow(coalesce(o, 0) - e, 2) / e) AS chi FROM (SELECT *, n * (((grp + 1) * k + g - 1) // g - (grp * k + g - 1) // g)::DOUBLE / k AS e FROM cells) c LEFT JOIN obs USING (tid, grp) GROUP BY c.tid),
zs AS (SELECT tid, (pow(chi / (g - 1), 1.0 / 3) - (1 - 2.0 / (9 * (g - 1)))) / sqrt(2.0 / (9 * (g - 1))) AS zc,
  n0, n1, abs(runs - (1 + 2.0 * n1 * n0 / n)) / sqrt(greatest(2.0 * n1 * n0 * (2.0 * n1 * n0 - n) / (n * n * (n - 1.0)), 1e-9)) AS zr, var, abs((cov / nullif(var, 0) + 1.0 / n) * sqrt(n)) AS zl FROM chi JOIN ser USING (tid)),
ps AS (SELECT tid, floor(least(1.0, 3 * least(1 / {logistic("zc")}, CASE WHEN n0 = 0 OR n1 = 0 THEN 0 ELSE 2 / {logistic("zr")} END, CASE WHEN var <= 0 THEN 0 ELSE 2 / {logistic("zl")} END)) * {secrets.GRID})::INT AS p FROM zs),
al AS (SELECT tid, rid, a, len, encoding, size, p FROM cls JOIN ps USING (tid)),
cnt AS (SELECT encoding, size, p, count(*) AS c FROM al GROUP BY ALL),
tot AS (SELECT encoding, size, sum(c) AS m, coalesce(sum(c) FILTER (p <= {secrets.LAMBDA}), 0) AS low FROM cnt GROUP BY ALL),
cand AS (SELECT encoding, size, p, sum(c) OVER (PARTITION BY encoding, size ORDER BY p) AS upto FROM cnt UNION ALL SELECT encoding, size, -1, 0 FROM tot),
bh AS (SELECT encoding, size, max(p) AS p FROM cand JOIN tot USING (encoding, size) WHERE (p + 1) * m <= {secrets.FDR * secrets.GRID} * upto GROUP BY ALL),
few AS (SELECT encoding, size, min(p) AS p FROM cand JOIN tot USING (encoding, size) WHERE p <= {secrets.LAMBDA} AND (low - upto) * {secrets.GRID - secrets.LAMBDA} - (m - low) * ({secrets.LAMBDA - 1} - p) <= round((m - upto) * {(secrets.GRID - secrets.LAMBDA) * secrets.FDR}) GROUP BY ALL),
cut AS (SELECT encoding, size, greatest(few.p, coalesce(bh.p, -1)) AS p FROM few LEFT JOIN bh USING (encoding, size)),
extra AS (SELECT rid, 3 AS r, 'random' AS kind, a, a + len AS z FROM al JOIN cut USING (encoding, size) WHERE al.p > cut.p),
every AS (SELECT * FROM b UNION ALL SELECT * FROM extra),
agg AS (SELECT rid, count(*) FILTER (r = 0) AS n_assign, count(*) FILTER (r = 1) AS n_access, count(*) FILTER (r = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, r) FILTER (r < 3) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, r) AS spans FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN agg USING (rid)"""
