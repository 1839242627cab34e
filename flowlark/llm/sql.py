"""SQL that checks the queries of this subpackage, for DuckDB."""

from __future__ import annotations

from flowlark.llm.warc import ENTITIES, LINE_ENDS, TAGS, UNSEEN


def _render(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '')"


def _spans(turns: str) -> str:
    before = f"coalesce(list_sum(list_transform({turns}[1:i-1], lambda t: length(t.role) + length(t.text) + 24)), 0)"
    start = f"({before} + 13 + length({turns}[i].role))"
    return (
        f"array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'),"
        f" lambda i: CAST(CAST({start} AS BIGINT) AS VARCHAR) || '-' || CAST(CAST({start} + length({turns}[i].text) + 10 AS BIGINT) AS VARCHAR)), ',')"
    )


OP1 = f"""
WITH conv AS (
  SELECT conv_id, list_sort(list_distinct(list({{'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}}))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
shared AS (SELECT turns[1].role AS r, turns[1].text AS t, min(conv_id) AS chosen_id FROM conv GROUP BY ALL HAVING count(*) > 1),
replies AS (SELECT *, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS spot FROM conv),
pairs AS (
  SELECT 'reply' AS kind, conv_id AS chosen_id, conv_id AS rejected_id, turns AS a,
    CASE WHEN len(spot) = 0 THEN turns ELSE list_append(turns[1:spot[-1]-1], {{'turn': turns[spot[-1]].turn, 'role': 'assistant',
      'text': CASE WHEN len(spot) > 1 THEN turns[spot[1]].text ELSE '' END}}) END AS b
  FROM replies
  UNION ALL
  SELECT 'opening', c.conv_id, x.conv_id, c.turns, x.turns
  FROM conv x JOIN shared s ON x.turns[1].role = s.r AND x.turns[1].text = s.t AND x.conv_id <> s.chosen_id JOIN conv c ON c.conv_id = s.chosen_id),
same AS (SELECT *, list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i].role = b[i].role AND a[i].text = b[i].text) AS eq FROM pairs),
cut AS (SELECT *, CAST(CASE WHEN list_contains(eq, false) THEN list_position(eq, false) - 1 ELSE len(eq) END AS BIGINT) AS n FROM same),
parts AS (SELECT kind, chosen_id, rejected_id, n, a[1:n] AS p, a[n+1:] AS ra, b[n+1:] AS rb FROM cut)
SELECT kind, chosen_id, rejected_id, n AS n_prompt_turns, {_render('p')} AS prompt,
  {_render('ra')} AS chosen_completion, {_spans('ra')} AS chosen_spans, {_render('rb')} AS rejected_completion, {_spans('rb')} AS rejected_spans,
  len(ra) = 0 AND len(rb) = 0 AS identical
FROM parts"""


def _plain(html: str) -> str:
    text = f"regexp_replace(regexp_replace({html}, '[\\x00\\r]', '', 'g'), '{UNSEEN}', ' ', 'g')"
    text = f"regexp_replace(regexp_replace(regexp_replace({text}, '[\\n\\t\\x0B\\f ]+', ' ', 'g'), '{LINE_ENDS}', chr(10), 'g'), '{TAGS}', '', 'g')"
    for name, sign in ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, name, sign.replace("'", "''"))
    return f"regexp_replace(regexp_replace(regexp_replace({text}, '[ \\x{{A0}}]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


def _urn(name: str) -> str:
    h = f"md5({name})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substring({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_CRLF = "chr(13) || chr(10)"
OP2 = f"""
WITH r AS (SELECT page_id AS source_id, coalesce(url, '') AS uri, '2024-01-01T00:00:00Z' AS d, 'text/html; charset=utf-8' AS kind, coalesce(html, '') AS payload FROM pages),
i AS (SELECT *, {_urn("'response:' || coalesce(CAST(source_id AS VARCHAR), '') || ':' || uri")} AS rid FROM r),
j AS (SELECT *, {_urn("'metadata:' || rid")} AS mid, {_urn("'conversion:' || rid")} AS cid FROM i),
k AS (
  SELECT 'metadata' AS warc_type, mid AS record_id, 'application/warc-fields' AS content_type, source_id, rid, uri, d,
    'source-content-type: ' || kind || {_CRLF} || 'source-content-length: ' || strlen(payload) || {_CRLF} || 'source-payload-digest: sha256:' || sha256(payload)
    || {_CRLF} || 'derived-conversion: ' || cid || {_CRLF} AS block FROM j
  UNION ALL
  SELECT 'conversion', cid, 'text/plain; charset=utf-8', source_id, rid, uri, d, {_plain('payload')} FROM j),
l AS (SELECT *, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM k)
SELECT record_id, warc_type, source_id, rid AS refers_to, uri AS refers_to_target_uri, d AS refers_to_date, content_type, content_length, block_digest, block,
  array_to_string(['WARC/1.1', 'WARC-Type: ' || warc_type, 'WARC-Record-ID: ' || record_id, 'WARC-Date: ' || d, 'WARC-Target-URI: ' || uri, 'WARC-Refers-To: ' || rid,
    'WARC-Refers-To-Target-URI: ' || uri, 'WARC-Refers-To-Date: ' || d, 'WARC-Block-Digest: ' || block_digest, 'Content-Type: ' || content_type,
    'Content-Length: ' || content_length, {_CRLF}], {_CRLF}) AS header
FROM l"""


_TOKENS = "trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
OP6 = f"""
WITH d AS (SELECT doc_id, string_split({_TOKENS}, ' ') AS ws FROM documents WHERE {_TOKENS} <> ''),
b AS (SELECT item_id, string_split({_TOKENS}, ' ') AS ws FROM benchmark WHERE {_TOKENS} <> ''),
dt AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
bt AS (SELECT item_id, len(ws) AS n, least(20, len(ws)) AS w, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM b),
m AS (SELECT doc_id, item_id, n, w, i - j AS start, j FROM dt JOIN bt USING (word)),
a AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, start) AS n_aligned FROM m
      QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, start) >= w - w // 10),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, start ORDER BY j RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS inside FROM a),
e AS (SELECT doc_id, item_id, start, max(n) AS n, max(w) AS w, max(inside) AS best, max(n_aligned) AS n_aligned FROM c GROUP BY ALL HAVING max(inside) >= max(w) - max(w) // 10)
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS item_tokens, CAST(max(best) AS BIGINT) AS best_matched, CAST(max(n_aligned) AS BIGINT) AS n_aligned, count(*) AS n_places
FROM e GROUP BY doc_id, item_id"""

OP7 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM d WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win FROM w),
m AS (SELECT win, min(doc_id) AS least FROM k GROUP BY win HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM k JOIN m USING (win) WHERE least < doc_id),
r AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ')
    ELSE array_to_string(list_filter(ws, lambda x, p: NOT list_contains(gone, p)), ' ') END) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""

OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, i, substring(h, 2 * i - 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d WHERE length(h) >= 100)),
m AS (SELECT win, min(doc_id) AS least FROM k GROUP BY win HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM k JOIN m USING (win) WHERE least < doc_id),
s AS (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM g),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < j - 1) AS n_spans FROM s GROUP BY doc_id),
b AS (SELECT doc_id, j, substring(h, 2 * j - 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS j FROM d)),
r AS (SELECT doc_id, string_agg(x, '' ORDER BY j) AS x FROM b ANTI JOIN g USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(x, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)"""


OP11 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
    embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
  FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.good AND b.good AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.w, r.root FROM reached r JOIN links l ON l.u = r.vec_id AND l.w > r.root),
least AS (SELECT vec_id, min(root) AS component_id FROM reached GROUP BY vec_id),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least USING (vec_id) LEFT JOIN n ON n.u = v.vec_id"""


def _bits(steps: int = 8) -> str:
    """The check value of each byte: `steps` divisions by the reversed polynomial 0xEDB88320."""
    out = "SELECT range AS i, range AS c FROM range(256)"
    for _ in range(steps):
        out = f"SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END AS c FROM ({out})"
    return out


_CRC_TABLE = f"crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM ({_bits()}))"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, beside the one-row table crc."""
    pairs = f"list_transform(range(0, octet_length(encode({text}))), lambda k: CAST('0x' || substring(hex(encode({text})), 2 * k + 1, 2) AS BIGINT))"
    return f"xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {pairs}), lambda p, q: xor(p >> 8, crc.t[xor(p, q) % 256 + 1])))"


OP12 = f"""
WITH {_CRC_TABLE},
d AS (
  SELECT doc_id, CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc32('CAST(doc_id AS VARCHAR)')} END AS h,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents, crc),
e AS (SELECT *, row_number() OVER () AS r, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e),
t AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE w[1:a] || list_transform(range(0, n - a), lambda k: w[a + k % (1 + (n - a) // (3 + g % 8)) + 1]) END AS w FROM f),
word AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(w) AS x FROM t),
same AS (SELECT a.r, b.i - a.i AS q, a.i FROM word a JOIN word b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
isle AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same) GROUP BY r, q, k),
run AS (SELECT r, start, length, min(q) AS period FROM isle WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
left_ AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.i) AS kept FROM word ANTI JOIN gone ON word.r = gone.r AND word.i = gone.i GROUP BY word.r),
found AS (
  SELECT r, count(*) AS n_runs, min({{'n': -length, 's': start, 'p': period}}) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM run GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(-best.n AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period,
  CAST(1000 * -best.n // best.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN found USING (r) LEFT JOIN left_ USING (r)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FEATURES = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP13 = f"""
WITH {_CRC_TABLE},
s AS (SELECT row_number() OVER () AS r, doc_id, {_FEATURES} AS w FROM documents),
sw AS (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM s) GROUP BY r, x),
tw AS (SELECT x, count(*) AS n FROM (SELECT unnest({_FEATURES}) AS x FROM benchmark) GROUP BY x),
b AS (SELECT x, {_crc32('x')} % 10000 AS bucket FROM (SELECT x FROM sw UNION SELECT x FROM tw), crc),
sb AS (SELECT bucket, sum(n) AS n FROM sw JOIN b USING (x) GROUP BY bucket),
tb AS (SELECT bucket, sum(n) AS n FROM tw JOIN b USING (x) GROUP BY bucket),
whole AS (SELECT coalesce((SELECT sum(n) FROM sb), 0) AS s, coalesce((SELECT sum(n) FROM tb), 0) AS t),
gain AS (
  SELECT k AS bucket, floor(1000 * ln(CAST((coalesce(tb.n, 0) + 1) * (whole.s + 10000) AS DOUBLE) / CAST((coalesce(sb.n, 0) + 1) * (whole.t + 10000) AS DOUBLE))) AS g
  FROM range(10000) x(k), whole LEFT JOIN sb ON sb.bucket = k LEFT JOIN tb ON tb.bucket = k),
weighed AS (SELECT r, sum(n * g) AS weight FROM sw JOIN b USING (x) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM s LEFT JOIN weighed USING (r)),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank FROM scored WHERE n_features >= 20 AND doc_id IS NOT NULL),
wanted AS (SELECT 10 * count(*) // 100 AS k FROM drawn)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN CAST(rank AS BIGINT) END AS rank
FROM scored LEFT JOIN drawn USING (r), wanted"""
