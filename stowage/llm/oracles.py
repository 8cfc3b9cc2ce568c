"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from stowage.llm.url_filter import HREF, UNREAD

OP1 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(0.1::DOUBLE + 0.9::DOUBLE * (1 - least(1.0::DOUBLE, 4.0::DOUBLE * len(regexp_extract_all(text, '[!-@\[-`{-~]')) / greatest(length(text), 1))), 1.0::DOUBLE) AS w,
         (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / w AS key, coalesce(doc_id::VARCHAR, '') AS tie FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS sw FROM s),
q AS (SELECT *, 2.0::DOUBLE * source_size / sw AS ratio FROM r),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(sw) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
m AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level < ratio),
t AS (
  SELECT source, source_size, round(least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM m) * sw, 2.0::DOUBLE * source_size)), 6) AS target FROM q),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS epochs FROM t),
p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest, k.key, k.tie,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.tie, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN rest > 0 AND 2 * (running - rest) <= size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM p
"""


def op6(rounds: int = 120, damping: float = 0.85) -> str:
    host = lambda c: f"coalesce(translate(regexp_extract({c}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    fit = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rules = [("block", "example.org", "/en/1"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("allow", "org", "/")]
    cases = " ".join(f"WHEN {fit(h, p)} THEN '{v} {h}{p}'" for v, h, p in rules)
    href, unread = (t.replace("'", "''") for t in (HREF, UNREAD))
    leads = lambda c, relative: f"CASE WHEN regexp_matches({c}, '(?i)^[a-z][a-z0-9+.-]*://') THEN {host(c)} WHEN starts_with({c}, '//') THEN {host(f"('x:' || {c})")} WHEN regexp_matches({c}, '(?i)^[a-z][a-z0-9+.-]*:') THEN '' ELSE {relative} END"
    # a round's additions alone: their sum over all rounds is the score
    series = lambda name, edges, kind: f"""{name}_k AS (
  SELECT 0 AS k, host, {1 - damping}::DOUBLE AS score FROM h WHERE 2 * {kind} > n UNION ALL
  SELECT k + 1, dst, sum({damping}::DOUBLE * share * score) FROM {name}_k JOIN {edges} ON src = host WHERE k < {rounds} GROUP BY k, dst),
{name} AS (SELECT host, sum(score) AS score FROM {name}_k GROUP BY host)"""  # noqa: E731
    return f"""WITH RECURSIVE j AS (SELECT page_id, {host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, regexp_replace(coalesce(html, ''), '{unread}', ' ', 'g') AS html FROM pages),
f AS (SELECT *, CASE {cases} END AS found FROM j),
h AS (SELECT host, count(*) AS n, count(*) FILTER (found LIKE 'allow %') AS good, count(*) FILTER (found LIKE 'block %') AS bad FROM f WHERE host <> '' GROUP BY host),
x AS (SELECT host AS src, regexp_extract(html, '(?i)<base{href}', 1) AS base, unnest(regexp_extract_all(html, '(?i)<a(?:rea)?{href}', 1)) AS link FROM j),
y AS (SELECT src, {leads('link', leads('base', 'src'))} AS dst FROM x),
e AS (SELECT src, dst, count(*) AS n FROM y WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
fw AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM e),
bw AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM e),
{series('t', 'fw', 'good')},
{series('b', 'bw', 'bad')}
SELECT page_id, f.host, path, substr(found, 7) AS rule,
       coalesce(substr(found, 1, 5), CASE WHEN coalesce(b.score, 0) > coalesce(t.score, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN t ON f.host = t.host LEFT JOIN b ON f.host = b.host
"""


OP7 = r"""
WITH c AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
l AS (SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS last FROM c),
w AS (
  SELECT conv_id AS pair_id, turns[1:last] AS a, last, turns[last] AS answer,
         ('0x' || substr(md5(conv_id::VARCHAR), 1, 8))::BIGINT % (SELECT greatest(1, ceil(count(*) / 4096)::BIGINT) FROM conversations WHERE conv_id IS NOT NULL AND role = 'assistant') AS ring
  FROM l WHERE last IS NOT NULL),
x AS (SELECT *, CASE WHEN answer <> lag(answer) OVER (PARTITION BY ring ORDER BY pair_id) THEN answer END AS begins FROM w),
y AS (
  SELECT *, first_value(begins IGNORE NULLS) OVER (PARTITION BY ring ORDER BY pair_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following,
         first_value(answer) OVER (PARTITION BY ring ORDER BY pair_id) AS lowest,
         first_value(begins IGNORE NULLS) OVER (PARTITION BY ring ORDER BY pair_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
  FROM x),
z AS (SELECT *, coalesce(following, CASE WHEN lowest <> answer THEN lowest END, CASE WHEN second <> answer THEN second END) AS other FROM y),
p AS (SELECT pair_id, a, CASE WHEN other IS NULL THEN a[1:last - 1] ELSE list_append(a[1:last - 1], other) END AS b FROM z),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, len(a))::INT AS n_common FROM p),
r AS (
  SELECT pair_id, n_common,
         list_transform(a, lambda t: '<|' || t.role || E'|>\n' || t.text || E'<|end|>\n') AS ra, list_transform(b, lambda t: '<|' || t.role || E'|>\n' || t.text || E'<|end|>\n') AS rb,
         list_transform(a, lambda t: CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END) AS ma, list_transform(b, lambda t: CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END) AS mb
  FROM n)
SELECT pair_id, n_common,
       coalesce(array_to_string(ra[1:n_common], ''), '') AS prompt,
       coalesce(array_to_string(ra[n_common + 1:], ''), '') AS chosen,
       coalesce(array_to_string(rb[n_common + 1:], ''), '') AS rejected,
       coalesce(array_to_string(list_transform(range(n_common + 1, len(ra) + 1), lambda i: length(ra[i])::VARCHAR || ma[i]), ' '), '') AS chosen_mask,
       coalesce(array_to_string(list_transform(range(n_common + 1, len(rb) + 1), lambda i: length(rb[i])::VARCHAR || mb[i]), ' '), '') AS rejected_mask
FROM r
"""

OP8 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, md5(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) ELSE [array_to_string(words, ' ')] END) AS s
    FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT u, v FROM l JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (
  SELECT doc_id, doc_id AS other FROM w UNION
  SELECT r.doc_id, e.v FROM r JOIN e ON r.other = e.u),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.doc_id = w.doc_id
"""


#: Windows of 100 bytes as 200 hexadecimal digits; of equal ones all but the first by (doc_id, start) mark their bytes.
OP5 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
n AS (SELECT r, doc_id, h, (length(h) // 2)::BIGINT AS n FROM d),
w AS (SELECT r, doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS m FROM (SELECT r, doc_id, h, unnest(range(0, n - 99)) AS s FROM n WHERE n >= 100 AND doc_id IS NOT NULL)),
m AS (SELECT r, s FROM w QUALIFY (doc_id, s) > first_value((doc_id, s)) OVER (PARTITION BY m ORDER BY doc_id, s)),
g AS (SELECT r, s, CASE WHEN s > lag(s) OVER (PARTITION BY r ORDER BY s) + 100 THEN 1 ELSE 0 END AS new FROM m),
i AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS run FROM g),
p AS (SELECT r, run, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY ALL),
k AS (SELECT r, a AS cut, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS begin, a AS stop FROM p
  UNION ALL SELECT p.r, any_value(n.n), max(b), any_value(n.n) FROM p JOIN n ON n.r = p.r GROUP BY p.r),
t AS (SELECT k.r, string_agg(substr(n.h, 2 * k.begin + 1, 2 * (k.stop - k.begin)), '' ORDER BY k.begin) AS kept FROM k JOIN n ON n.r = k.r GROUP BY k.r),
c AS (SELECT r, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM p GROUP BY r)
SELECT n.doc_id, n.n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN t ON t.r = n.r LEFT JOIN c ON c.r = n.r
"""


#: crc32 of an ASCII string by a table of 256 that its rule gives.
CRC_TABLE = "c AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc)"


def crc32(s: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i, 1))::BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])))"


#: A row's step (keep, rerole, delete) after insertions that lead from one grammar state to another.
OP11 = rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT d.*, {crc32('key')} % 20 AS draw FROM d, c),
w AS (
  SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt,
         unnest(CASE draw WHEN 3 THEN [1, 2] ELSE [1] END) AS time FROM k WHERE draw <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt) AS i FROM w),
f AS (
  SELECT *, left(role, 1) AS ini, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair,
         CASE WHEN NOT regexp_matches(txt, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 THEN 'duplicate'
              WHEN regexp_extract(txt, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
g AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(src, ini, dst)),
n AS (
  SELECT src, dst, letters, length(letters) * 3 AS cost, added
  FROM (VALUES (0, 0, '', []::VARCHAR[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']),
               (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])) v(src, dst, letters, added)),
e AS (
  SELECT conv_id, i, s.src, s.src AS dst, 4 AS cost, 'D' AS letter, []::VARCHAR[] AS line FROM f, (SELECT DISTINCT dst AS src FROM n) s
  UNION ALL SELECT conv_id, i, src, dst, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', [role || ':' || txt] FROM f JOIN g ON f.ini = g.ini WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, i, src, dst, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', [CASE g.ini WHEN 'u' THEN 'user:' ELSE 'assistant:' END || txt] FROM f, g WHERE fault IN ('', 'truncated') AND g.ini <> 's'),
p AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT p.conv_id, e.i, e.dst, min({{'cost': p.best.cost + n.cost + e.cost, 'audit': p.best.audit || n.letters || e.letter, 'lines': p.best.lines || n.added || e.line}})
  FROM p JOIN n ON n.src = p.state JOIN e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1 AND e.src = n.dst GROUP BY p.conv_id, e.i, e.dst),
q AS (
  SELECT p.conv_id, p.i, min({{'cost': p.best.cost + n.cost, 'audit': p.best.audit || n.letters, 'lines': p.best.lines || n.added}}) AS best FROM p JOIN n ON n.src = p.state AND n.dst IN (0, 3) GROUP BY p.conv_id, p.i),
z AS (
  SELECT conv_id, max(i) AS i, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.cost::BIGINT AS cost, best.audit AS audit, sha256(coalesce(array_to_string(best.lines, E'\n'), '')) AS repaired_sha256
FROM q LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM q.conv_id WHERE q.i = coalesce(z.i, 0)
"""


#: A run repeats each of its stretches of five words a period later: pairs of equal stretches, then islands of them.
OP12 = rf"""
WITH {CRC_TABLE},
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS txt, doc_id::VARCHAR AS key FROM documents),
h AS (SELECT r, doc_id, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') AS v, {crc32('key')} AS h FROM t, c),
a AS (SELECT *, len(v) AS n, CASE WHEN h % 10 = 0 AND len(v) > 0 THEN (h // 10) % len(v) END AS a FROM h),
b AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
w AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN v ELSE list_transform(range(0, n), lambda i: v[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS v FROM b),
s AS (SELECT r, n, i, md5_number(array_to_string(v[i + 1:i + 5], ' ')) AS s FROM (SELECT r, n, v, unnest(range(0, n - 4)) AS i FROM w WHERE n >= 6)),
m AS (SELECT x.r, x.i, y.i - x.i AS q FROM s x JOIN s y ON x.r = y.r AND x.s = y.s AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
l AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM g GROUP BY r, q, island),
u AS (SELECT r, start, length, min(q) AS period FROM l WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
z AS (
  SELECT r, count(*) AS n_runs, arg_max({{'start': start, 'length': length, 'period': period}}, (length, -start, -period)) AS best, string_agg(start || ',' || length || ',' || period || E'\n', '' ORDER BY start, period) AS listed,
         list({{'a': start + period, 'b': start + length}}) AS spans FROM u GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length::BIGINT AS length, best.period AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(coalesce(array_to_string(CASE WHEN spans IS NULL THEN v ELSE list_transform(list_filter(range(0, n), lambda i: len(list_filter(spans, lambda x: x.a <= i AND i < x.b)) = 0), lambda i: v[i + 1]) END, ' '), '')) AS collapsed_sha256
FROM w LEFT JOIN z USING (r)
"""


OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS v FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS v FROM benchmark),
w AS (SELECT DISTINCT item_id, least(10, len(v)) AS k, array_to_string(v[i:i + 9], ' ') AS s FROM (SELECT item_id, v, unnest(range(1, greatest(len(v) - 9, 1) + 1)) AS i FROM b WHERE len(v) > 0)),
x AS (SELECT r, k, i, array_to_string(v[i:i + k - 1], ' ') AS s FROM (SELECT r, v, k, unnest(range(1, len(v) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w) WHERE len(v) >= k)),
m AS (SELECT r, i, x.k, item_id FROM x JOIN w ON w.k = x.k AND w.s = x.s),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM m)) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(v)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN q ON q.r = d.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1, "op3_minhash_near_dedup": OP3, "op5_suffix_dedup": OP5, "op6_url_filter": op6(), "op7_format_preferences": OP7, "op8_exact_topk": OP8, "op11_repair_conversations": OP11, "op12_periodic_runs": OP12, "op13_decontaminate": OP13}
