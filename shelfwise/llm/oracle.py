"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

#: The ten kinds written out again, independent of the operator: kind, pattern, group, least length.
_SECRET_KINDS = """
    (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
    (1, 'access', 'AKIA[A-Z0-9]+', 0, 18),
    (2, 'hex', '[0-9a-f]+', 0, 16),
    (3, 'pem', '-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\\x20\\t\\r\\n]*', 0, 40),
    (4, 'github', 'gh[opsru]_[A-Za-z0-9]{20,}', 0, 24),
    (5, 'slack', 'xox[abprs]-[A-Za-z0-9-]{10,}', 0, 15),
    (6, 'google', 'AIza[A-Za-z0-9_-]{30,}', 0, 34),
    (7, 'stripe', '[rs]k_live_[A-Za-z0-9]{16,}', 0, 24),
    (8, 'jwt', 'eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}', 0, 29),
    (9, 'url', '://[A-Za-z0-9_.%-]+:([A-Za-z0-9_.%+!$-]+)@', 1, 8)
"""


def _matches() -> str:
    """One SELECT for each kind: DuckDB wants constant patterns."""
    import ast

    one = []
    for no, kind, pattern, group, least in ast.literal_eval(f"[{_SECRET_KINDS.replace(chr(92), chr(92) * 2).replace(chr(39) * 2, chr(92) + chr(39))}]"):
        p = pattern.replace("'", "''")
        one.append(
            f"SELECT rid, {no} AS no, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}') AS ms, "
            f"regexp_extract_all(t, '{p}', {group}) AS gs, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')"
        )
    return " UNION ALL ".join(one)


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({_matches()}),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (
  SELECT rid, no, kind, least, gs[i] AS value,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT
         + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)::BIGINT AS b, length(ms[i]) AS n
  FROM i),
c AS (SELECT rid, no, kind, b, b + n AS e, value FROM s WHERE length(value) >= least),
o AS (
  SELECT value, count(DISTINCT coalesce(source, '')) AS owners,
         count(DISTINCT (coalesce(source, ''), coalesce(doc_id::VARCHAR, ''))) AS repos,
         len(list_distinct(regexp_extract_all(value, '(?s).'))) >= 6
         AND NOT regexp_matches(value, '(?i)example|sample|placeholder|changeme|change_me|your_|xxxx|dummy|0123456789|123456789|abcdefgh') AS looks
  FROM c JOIN d USING (rid) GROUP BY value),
v AS (SELECT c.*, o.owners < 3 AND o.repos < 10 AND o.looks AS live, o.owners >= 3 OR o.repos >= 10 AS copied FROM c JOIN o USING (value)),
g AS (
  SELECT rid, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, no) FILTER (no < 3) AS base,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, no) FILTER (no < 3 OR live) AS spans,
         count(DISTINCT value) FILTER (live) AS n_live, count(DISTINCT value) FILTER (copied) AS n_copied
  FROM v GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (rid)
"""

#: As of the fetch day, by the last entry of each pattern up to that day instead of intervals.
URLS = r"""
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 365)::INTEGER AS fetched_on,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
f AS (SELECT host, min(page_id) AS k, arg_min(path, page_id) AS path FROM c WHERE host <> '' GROUP BY host),
l AS (
  SELECT k, (k % 3)::INTEGER AS kind, ['spam', 'malware', 'adult', 'piracy', 'phishing'][(k % 5)::INTEGER + 1] AS category,
         CASE k % 3 WHEN 0 THEN host WHEN 1 THEN regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1)
              ELSE host || regexp_extract(path, '^/+([^/]+)', 0) END AS pattern
  FROM f),
log AS (
  SELECT kind, pattern, category, 1 AS listed, k * 7 % 300 AS day FROM l WHERE pattern <> ''
  UNION SELECT kind, pattern, category, 0, k * 7 % 300 + 60 FROM l WHERE kind > 0 AND pattern <> ''
  UNION SELECT kind, pattern, category, 1, k * 7 % 300 + 120 FROM l WHERE kind = 1 AND pattern <> ''),
p AS (SELECT DISTINCT kind, pattern FROM log),
m AS (
  SELECT c.page_id, p.kind, p.pattern FROM c JOIN p ON
    (p.kind = 0 AND c.host = p.pattern)
    OR (p.kind = 1 AND (c.host = p.pattern OR suffix(c.host, '.' || p.pattern)))
    OR (p.kind = 2 AND (c.host || c.path = p.pattern OR starts_with(c.host || c.path, p.pattern || '/')))),
s AS (
  SELECT m.page_id, m.kind, m.pattern, log.category, arg_max(log.listed, log.day * 2 + (1 - log.listed)) AS listed
  FROM m JOIN log USING (kind, pattern) JOIN c USING (page_id)
  WHERE DATE '2024-01-01' + log.day::INTEGER <= c.fetched_on GROUP BY ALL),
g AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM s WHERE listed = 1 GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched_on, coalesce(g.n, 0) > 0 AS blocked, coalesce(g.n, 0) AS n_entries, coalesce(g.categories, '') AS categories
FROM c LEFT JOIN g USING (page_id)
"""

def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, half a byte at a time; the table follows from the polynomial."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    halves = (
        f"flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), "
        "lambda h: [strpos('0123456789ABCDEF', h[2])::BIGINT - 1, strpos('0123456789ABCDEF', h[1])::BIGINT - 1]))"
    )
    step = f"lambda c, x: xor(({table}::BIGINT[])[(xor(c, x) & 15) + 1], c >> 4)"
    return f"xor(list_reduce({halves}, {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _words(text: str) -> str:
    return (
        f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )


#: Every feature hashed once, buckets counted, gains joined back, one ordered window for the draw.
RESAMPLING = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT {_words('text')} AS w FROM benchmark),
df AS (
  SELECT rid, unnest(w) AS f FROM d
  UNION ALL SELECT rid, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM d WHERE len(w) > 1),
bf AS (
  SELECT unnest(w) AS f FROM b
  UNION ALL SELECT unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM b WHERE len(w) > 1),
k AS MATERIALIZED (SELECT f, {_crc32('f')} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
db AS MATERIALIZED (SELECT rid, bucket, count(*) AS n FROM df JOIN k USING (f) GROUP BY ALL),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM db GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM bf JOIN k USING (f) GROUP BY bucket),
a AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS s_all, coalesce((SELECT sum(t) FROM t), 0) AS t_all),
g AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.t, 0) + 1) * (s_all + 10000) / ((s.s + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), a),
m AS (SELECT rid, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM db JOIN g USING (bucket) GROUP BY rid),
r AS (
  SELECT d.rid, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
         ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM d LEFT JOIN m USING (rid)),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
o AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM x WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM o) // 100 THEN place END AS rank
FROM x LEFT JOIN o USING (rid)
"""

ORACLE: dict[str, str] = {
    "op2_url_filters": URLS,
    "op10_secret_scans": SECRETS,
    "op12_importance_resampling": RESAMPLING,
}
