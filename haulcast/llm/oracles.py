"""DuckDB SQL of the numbered operators, where SQL can say what they compute."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT r, i, array_to_string(ws[i : i + 7], ' ') AS g
  FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)
),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r
),
m AS (
  SELECT w.r, doc_id, source, len(ws) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.r = cov.r
),
t AS (
  SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM m
),
f AS (
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeats,
    100 * n_symbols > 25 * n_words AS symbols, 100 * n_dup_lines > 50 * n_lines AS dup_lines
  FROM t
),
h AS (
  SELECT source, rule, count(*) AS n, sum(bad::INT) AS failed FROM (
    SELECT source, unnest(['short', 'repeats', 'symbols', 'dup_lines']) AS rule,
      unnest([short, repeats, symbols, dup_lines]) AS bad FROM f)
  GROUP BY source, rule
),
p AS (SELECT rule, avg(failed / n) AS mu, var_pop(failed / n) AS v FROM h GROUP BY rule),
s AS (
  SELECT source, CASE WHEN v > 0 THEN (failed + mu * k) / (n + k) ELSE mu END AS rate FROM (
    SELECT h.*, mu, v, CASE WHEN v > 0 THEN greatest(mu * (1 - mu) / v - 1, 10) END AS k FROM h JOIN p USING (rule))
),
hv AS (SELECT source, max(rate) > 0.5 AS host_failed FROM s GROUP BY source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, short OR repeats AS base_failed, host_failed,
  NOT (short OR repeats OR symbols OR host_failed) AS kept
FROM f JOIN hv ON f.source IS NOT DISTINCT FROM hv.source
"""

_UNIT = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0"
_KEY = "coalesce(doc_id::VARCHAR, 'null')"


def _shard(n: int) -> str:
    u = _UNIT.format(f"{_KEY} || '|shard|' || i::VARCHAR")
    return f"""(SELECT r, arg_max(i, (-1.0 / ln(({u}) + power(2.0, -53)), -i)) AS shard
      FROM d, (SELECT unnest(generate_series(0, {n - 1})) AS i) GROUP BY r)"""


ORACLES["op7_rendezvous_shards"] = f"""
WITH c AS (
  SELECT list_reduce(generate_series(1, 8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b) AS t, b
  FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS b)
),
tab AS (SELECT list(t ORDER BY b) AS tab FROM c),
d AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text FROM documents
),
crc AS (
  SELECT r, xor(list_reduce(
      list_transform(generate_series(1, 2 * strlen(text), 2), lambda j: ('0x' || substr(hex(encode(text)), j, 2))::BIGINT),
      lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM d, tab
),
a AS {_shard(8)},
b AS {_shard(9)},
p AS (
  SELECT d.r, doc_id, size, text_crc32, a.shard::INTEGER AS shard, b.shard::INTEGER AS grown_shard,
    floor(({_UNIT.format(f"coalesce({_KEY} || '|' || text_crc32::VARCHAR, 'null') || '|slot'")}) * 512) AS part
  FROM d JOIN crc USING (r) JOIN a USING (r) JOIN b USING (r)
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY part, doc_id) - 1 AS slot
FROM p
"""

ORACLES["op10_mix_sources"] = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT count(*) AS k, sum(n) AS total FROM n),
r AS (SELECT source, total::DOUBLE * 1.0 / k::DOUBLE / n AS rate FROM n, t),
ks AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT)) AS k FROM r),
pt AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1.0)) AS p FROM ks),
cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS p FROM pt),
d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5,
    {_UNIT.format(f"{_KEY} || '|42|mix'")} AS u
  FROM documents
),
c AS (
  SELECT d.doc_id, d.source, d.text_md5, x.rate, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND d.u >= cdf.p) AS times
  FROM d JOIN r AS x ON d.source IS NOT DISTINCT FROM x.source
),
e AS (SELECT *, unnest(generate_series(0, times - 1)) AS copy FROM c WHERE times > 0)
SELECT doc_id, source, copy::INTEGER AS copy, rate, md5({_KEY} || '|' || copy::VARCHAR || '|42') AS mix_order, text_md5
FROM e
"""

ORACLES["op1_near_duplicates"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
sh AS (
  SELECT doc_id, ws[i] || ' ' || ws[i + 1] AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 2)
  UNION
  SELECT doc_id, ws[1] FROM d WHERE len(ws) = 1
),
c AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
f AS (SELECT s, count(*) AS df FROM sh GROUP BY s),
o AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS k FROM sh JOIN f USING (s) JOIN c USING (doc_id)),
pre AS (SELECT * FROM o WHERE k <= n - ceil(0.8 * n) + 1),
cand AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM pre x JOIN pre y
  ON x.s = y.s AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
),
lnk AS (
  SELECT a, b FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.s = x.s
  GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))
),
e AS (SELECT a, b FROM lnk UNION ALL SELECT b, a FROM lnk),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON r.other = e.a)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN c USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""

ORACLES["op9_remove_repeats"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM d WHERE len(ws) >= 20)
),
bad AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS j FROM bad)),
w AS (SELECT doc_id, ws[j] AS w, j FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS j FROM d)),
k AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.j) AS kept, count(*) AS n
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.j = gone.j WHERE gone.j IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLES["op5_repeated_lines"] = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, i - 1 AS no, array_to_string(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), ' ') AS t
  FROM (SELECT doc_id, unnest(xs) AS x, unnest(generate_series(1, len(xs))) AS i
    FROM (SELECT doc_id, string_split(lower(coalesce(text, '')), chr(10)) AS xs FROM documents))
),
k AS (SELECT * FROM l WHERE t <> ''),
u AS (SELECT t, row_number() OVER (ORDER BY t) AS id FROM (SELECT DISTINCT t FROM k)),
sh AS (
  SELECT DISTINCT id, substr(t, i, 8) AS s
  FROM (SELECT id, t, unnest(generate_series(1, greatest(length(t) - 7, 1))) AS i FROM u)
),
c AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
f AS (SELECT s, count(*) AS df FROM sh GROUP BY s),
o AS (SELECT id, s, n, row_number() OVER (PARTITION BY id ORDER BY df, s) AS r FROM sh JOIN f USING (s) JOIN c USING (id)),
pre AS (SELECT * FROM o WHERE r <= n - ceil(0.8 * n) + 1),
cand AS (
  SELECT DISTINCT x.id AS a, y.id AS b, x.n AS na, y.n AS nb FROM pre x JOIN pre y
  ON x.s = y.s AND x.id < y.id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
),
lnk AS (
  SELECT a, b FROM cand JOIN sh x ON x.id = a JOIN sh y ON y.id = b AND y.s = x.s
  GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))
),
e AS (SELECT a, b FROM lnk UNION ALL SELECT b, a FROM lnk),
reach AS (SELECT id, id AS other FROM u UNION SELECT r.id, e.b FROM reach r JOIN e ON r.other = e.a),
m AS (SELECT id, min(other) AS root FROM reach GROUP BY id),
p AS (SELECT doc_id, no, row_number() OVER (PARTITION BY root ORDER BY doc_id, no) AS r FROM k JOIN u USING (t) JOIN m USING (id)),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE r > 1) AS n_removed,
    string_agg(no::VARCHAR, ',' ORDER BY no) FILTER (WHERE r > 1) AS removed_lines FROM p GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN g USING (doc_id)
"""


def _clusters(k: int = 40, rounds: int = 5) -> str:
    near = """a{i} AS (
  SELECT r, min(dist) AS dist, arg_min(c, (dist, c)) AS c
  FROM (SELECT r, c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS dist FROM v JOIN c{i} m USING (d) GROUP BY r, c) GROUP BY r
)"""
    moved = """s{i} AS (SELECT c, d, sum(v.x)::BIGINT AS t, count(*) AS n FROM a{i} JOIN v USING (r) GROUP BY c, d),
c{j} AS (
  SELECT c, d, coalesce((t - ((t % n) + n) % n) // n, m.x) AS x FROM c{i} m LEFT JOIN s{i} USING (c, d)
)"""
    steps = [near.format(i=0)]
    for i in range(rounds):
        steps += [moved.format(i=i, j=i + 1), near.format(i=i + 1)]
    chain = ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
v AS (
  SELECT r, d, floor(256 * e[d]::DOUBLE)::BIGINT AS x FROM (SELECT r, e, unnest(generate_series(1, 64)) AS d FROM kept)
),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, e) - 1 AS c FROM kept),
c0 AS (SELECT c, d, x FROM f JOIN v USING (r) WHERE c < {k}),
{chain},
t AS (SELECT c, sum(dist)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY c),
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, dist AS distance, cluster_inertia,
  (SELECT sum(cluster_inertia)::BIGINT FROM t) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN t USING (c) JOIN h USING (c)
"""


ORACLES["op13_vector_clusters"] = _clusters()


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
