"""DuckDB texts that the queries are checked with, written apart from the operators."""

PLAIN = "coalesce(html, '')"
for _pattern, _new in (
        ("(?is)<script[^>]*>.*?</script>", " "), ("(?is)<style[^>]*>.*?</style>", " "), ("(?s)<!--.*?-->", " "),
        ("(?i)<(?:/p|br|/h[1-6]|/li|/div|/article|/title|/footer)[^>]*>", "\n"), ("<[^>]*>", ""), ("&nbsp;", " "),
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"),
        ("&amp;", "&"), ("[ \t\r]+", " "), (" ?\n[ \n]*", "\n"), ("^[ \n]+|[ \n]+$", "")):
    PLAIN = f"regexp_replace({PLAIN}, '{_pattern}', '{_new}', 'g')"


def _uuid(name: str) -> str:
    h = f"md5({name})"
    return (f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' ||"
            f" {h}[21:32] || '>'")


WARC = f"""
WITH s AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, {PLAIN} AS plain,
             {_uuid("concat_ws('|', 'response', coalesce(page_id::varchar, ''), coalesce(url, ''))")} AS refers_to FROM pages),
b AS (SELECT page_id, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS kind, refers_to, target_uri, plain AS text
      FROM s UNION ALL
      SELECT page_id, 'metadata', 'application/warc-fields', refers_to, target_uri, 'source-record: ' || refers_to ||
        E'\\r\\nsource-payload-digest: sha256:' || sha256(payload) || E'\\r\\nsource-length: ' || strlen(payload) ||
        E'\\r\\nsource-header: HTTP/1.1 200 OK\\r\\nsource-header: Content-Type: text/html; charset=utf-8' ||
        E'\\r\\nsource-header: Content-Length: ' || strlen(payload) || E'\\r\\n' FROM s),
r AS (SELECT *, {_uuid("concat_ws('|', record_type, refers_to)")} AS record_id,
        strlen(text)::bigint AS content_length, 'sha256:' || sha256(text) AS block_digest FROM b)
SELECT page_id, record_type, record_id, refers_to, target_uri, content_length, block_digest,
  sha256(E'WARC/1.1\\r\\nWARC-Type: ' || record_type || E'\\r\\nWARC-Record-ID: ' || record_id ||
    E'\\r\\nWARC-Refers-To: ' || refers_to || E'\\r\\nWARC-Target-URI: ' || target_uri ||
    E'\\r\\nWARC-Date: 2026-01-01T00:00:00Z\\r\\nWARC-Block-Digest: ' || block_digest ||
    E'\\r\\nContent-Type: ' || kind || E'\\r\\nContent-Length: ' || content_length || E'\\r\\n\\r\\n' || text) AS record_sha256,
  text FROM r"""


def _crc32(name: str) -> str:
    """CRC-32 of a column's decimal text, bit by bit."""
    steps = f"flatten(list_transform(string_split({name}::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    return (f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], {steps}),"
            " lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))))")


#: A node is the chain of its turns' digests; what a subtree holds is summed along the path of each node's least member.
PREFIXES = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, count(*) AS n, {_crc32("conv_id")} % 9 AS h FROM own GROUP BY conv_id),
taken AS (SELECT i.conv_id, i.h, least(i.h, coalesce(b.n, 0)) AS base_n, i.conv_id - i.conv_id % 5 AS base
  FROM ids i LEFT JOIN ids b ON b.conv_id = i.conv_id - i.conv_id % 5),
rebuilt AS (
  SELECT t.conv_id, o.k AS pos, role, text FROM taken t JOIN own o ON o.conv_id = t.base AND o.k <= t.base_n
  UNION ALL SELECT t.conv_id, o.k - t.h + t.base_n, role, text FROM taken t JOIN own o ON o.conv_id = t.conv_id AND o.k > t.h),
chained AS (SELECT conv_id, pos AS depth, strlen(text) AS bytes,
    md5(string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM rebuilt),
paths AS (SELECT conv_id, depth, bytes, node, lag(node, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS parent
  FROM chained UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM ids),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs,
    (count(*) - 1) * min(bytes) AS saved FROM paths GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (SELECT p.node, p.depth, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(x.saved) AS saved
  FROM nodes x LEFT JOIN children c ON c.node = x.node JOIN paths p ON p.conv_id = x.conv_id AND p.depth <= x.depth
  GROUP BY p.node, p.depth),
ends AS (SELECT node, depth, string_agg(conv_id::varchar, ',' ORDER BY conv_id) AS ids FROM (
    SELECT conv_id, max(depth) AS depth, arg_max(node, depth) AS node FROM paths GROUP BY conv_id) GROUP BY node, depth)
SELECT x.conv_id::bigint AS conv_id, x.depth::bigint AS depth, p.conv_id::bigint AS parent_conv_id,
  x.n_convs::bigint AS n_convs, coalesce(c.n, 0)::bigint AS n_children, s.leaves::bigint AS n_leaves,
  s.saved::bigint AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes x JOIN sums s USING (node, depth) LEFT JOIN ends e USING (node, depth)
LEFT JOIN children c ON c.node = x.node LEFT JOIN nodes p ON p.node = x.parent"""

#: Every window of 100 bytes as 200 hexadecimal digits; all but the first of equal ones are cut.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, md5_number(substr(x, 2 * s + 1, 200)) AS h FROM (
  SELECT doc_id, x, unnest(range(n - 99)) AS s FROM d WHERE n >= 100)),
again AS (SELECT doc_id, s FROM (
  SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
islands AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM again)),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM islands GROUP BY doc_id, island),
gaps AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b, b - a AS cut FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), d.n, NULL FROM d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id, d.n)
SELECT d.doc_id, d.n::bigint AS n_bytes, coalesce(sum(g.cut), 0)::bigint AS n_removed, count(g.cut)::bigint AS n_spans,
  sha256(unhex(string_agg(substr(d.x, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a))) AS kept_sha256
FROM d JOIN gaps g USING (doc_id) GROUP BY d.doc_id, d.n"""
