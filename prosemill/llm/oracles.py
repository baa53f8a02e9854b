"""SQL with the results of those queries that SQL can express, for small tables."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NONSPACE = r"[^\x20\x09-\x0D]+"


def _words(table: str, key: str, pattern: str, lower: bool = True) -> str:
    text = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')" if lower else "coalesce(text, '')"
    return f"SELECT {key}, regexp_extract_all({text}, '{pattern}') AS w FROM {table}"


OP3 = f"""WITH d AS ({_words('documents', 'doc_id', _ALNUM)}), b AS ({_words('benchmark', 'item_id', _ALNUM)}),
win AS (SELECT item_id::VARCHAR AS item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item, dw.n, i FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id"""

_NIBBLE = "(strpos('0123456789abcdef', substr(h, {}, 1)) - 1)"
OP4 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT h, max(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((({_NIBBLE.format('1 + (5 * i) // 4')} * 16 + {_NIBBLE.format('2 + (5 * i) // 4')}) >> (3 - (5 * i) % 4)) & 31)::INTEGER, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN m USING (h)"""

_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
OP5 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, w FROM (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{_NONSPACE}') AS w FROM documents)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols FROM d),
line AS (SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_NONSPACE}') GROUP BY 1, 2),
lines AS (SELECT doc_id, sum(c - 1) AS n, sum((c - 1) * list_sum(list_transform(regexp_extract_all(l, '{_NONSPACE}'), lambda x: length(x)))) AS chars FROM line GROUP BY 1),
gram AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest(range(5, 11)) AS n) WHERE len(w) >= n)),
twice AS (SELECT doc_id, n, i FROM (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, g) AS c FROM gram) WHERE c > 1),
cov AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM twice),
share AS (SELECT cov.doc_id, cov.n, count(*) AS words, sum(length(x)) AS chars FROM cov JOIN word ON word.doc_id = cov.doc_id AND word.i = cov.i GROUP BY 1, 2),
bad AS (SELECT DISTINCT s.doc_id FROM share s JOIN base b ON b.doc_id = s.doc_id WHERE s.chars > CASE n {' '.join(f'WHEN {n} THEN {x}' for n, x in _LIMITS.items())} END * greatest(word_chars, 1)),
f AS (SELECT b.*, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(l.chars, 0) AS line_chars, coalesce(s.words, 0)::BIGINT AS n_repeat_words FROM base b LEFT JOIN lines l ON l.doc_id = b.doc_id LEFT JOIN share s ON s.doc_id = b.doc_id AND s.n = 5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND line_chars <= 0.20 * greatest(word_chars, 1) AND n_symbols <= 0.05 * greatest(word_chars, 1) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f"""

_TWO = "('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'or.jp', 'ne.jp', 'ac.jp', 'go.jp', 'com.br', 'com.cn', 'com.mx', 'co.in', 'co.kr', 'co.za')"
# Outcomes of groups under their parents with the sums for moments; the prior strength of a level about its parents' rates.
_SUMS = "coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(k), 0)::BIGINT AS k, count(*) FILTER (WHERE n > 0) AS g, sum(n * n)::DOUBLE AS nn, coalesce(sum(k * k / n::DOUBLE) FILTER (WHERE n > 0), 0) AS kk"
_STRENGTH = """(SELECT CASE WHEN coalesce(room, 0) <= 0 OR excess <= 0 THEN 1000.0 ELSE least(greatest(room / excess - 1, 2.0), 1000.0) END FROM
(SELECT sum(kk - k * r - r * (1 - r) * (g - 1)) AS excess, sum(r * (1 - r) * (n - nn / n - (g - 1))) AS room FROM (SELECT *, k / n::DOUBLE AS r FROM {} WHERE n > 0 AND g > 1)))"""
_PRIOR = "least({0}, {1} - n)"
OP7 = f"""WITH p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), '{_UP}', '{_LOW}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages)),
o AS (SELECT page_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM (SELECT page_id, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,15}})[^0-9/]*/?$', 1), '') AS BIGINT) AS doc_id FROM p) x JOIN labels USING (doc_id) GROUP BY 1),
hosts AS (SELECT host, array_to_string(w[CASE WHEN array_to_string(w[-2:], '.') IN {_TWO} THEN -3 ELSE -2 END:], '.') AS domain, CASE WHEN array_to_string(w[-2:], '.') IN {_TWO} THEN array_to_string(w[-2:], '.') ELSE w[-1] END AS suffix, n, k FROM (SELECT host, string_split(host, '.') AS w, count(bad) AS n, count(*) FILTER (WHERE bad) AS k FROM p LEFT JOIN o USING (page_id) GROUP BY 1)),
domains AS (SELECT suffix, domain, {_SUMS} FROM hosts GROUP BY 1, 2), suffixes AS (SELECT suffix, {_SUMS} FROM domains GROUP BY 1), total AS (SELECT {_SUMS} FROM suffixes),
c AS (SELECT g AS total_g, (k + 1) / (n + 2)::DOUBLE AS base, n + 2.0 AS everything, {_STRENGTH.format('total')} AS a, {_STRENGTH.format('suffixes')} AS b, {_STRENGTH.format('domains')} AS h FROM total),
sm AS (SELECT suffix, g AS sg, CASE WHEN n > 0 AND total_g = 1 THEN base ELSE (k + {_PRIOR.format('a', 'everything')} * base) / (n + {_PRIOR.format('a', 'everything')}) END AS s, CASE WHEN n > 0 AND total_g = 1 THEN everything ELSE n + {_PRIOR.format('a', 'everything')} END AS sw FROM suffixes, c),
dm AS (SELECT domain, g AS dg, CASE WHEN n > 0 AND sg = 1 THEN s ELSE (k + {_PRIOR.format('b', 'sw')} * s) / (n + {_PRIOR.format('b', 'sw')}) END AS d, CASE WHEN n > 0 AND sg = 1 THEN sw ELSE n + {_PRIOR.format('b', 'sw')} END AS dw FROM domains JOIN sm USING (suffix), c),
hm AS (SELECT host, CASE WHEN n > 0 AND dg = 1 THEN d ELSE (k + {_PRIOR.format('h', 'dw')} * d) / (n + {_PRIOR.format('h', 'dw')}) END AS m, CASE WHEN n > 0 AND dg = 1 THEN dw ELSE n + {_PRIOR.format('h', 'dw')} END AS hw FROM hosts JOIN dm USING (domain), c),
v AS (SELECT p.page_id, p.host, p.path, m - 1.645 * sqrt(m * (1 - m) / (hw + 1)) > 0.3 AS blocked,
CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7' WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/' WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p LEFT JOIN hm USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL OR blocked THEN 'block' ELSE 'allow' END AS verdict FROM v"""

OP10 = f"""WITH RECURSIVE d AS ({_words('documents', 'doc_id', _NONSPACE)}),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m AS component_id, m = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(o) AS m FROM r GROUP BY 1) c ON c.doc_id = d.doc_id"""

ORACLES = {"op3_decontaminate": OP3, "op4_warc": OP4, "op5_quality": OP5, "op7_url_reputation": OP7, "op10_near_duplicates": OP10}
