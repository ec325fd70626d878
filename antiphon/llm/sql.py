"""SQL for the queries of this folder that SQL can express (DuckDB)."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op10_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
m AS (SELECT hex, max(page_id) AS largest FROM d GROUP BY hex),
b AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' ORDER BY k) AS digest
  FROM (
    SELECT hex, k, list_reduce(list_transform(range(5), lambda j: ((('0x' || substr(hex, (k * 5 + j) // 4 + 1, 1))::INT >> (3 - (k * 5 + j) % 4)) & 1) << (4 - j)), lambda x, y: x + y) AS v
    FROM m, range(32) r(k))
  GROUP BY hex)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM d JOIN m USING (hex) JOIN b USING (hex)
"""


# Windows of 50 words, joined by blanks (words have none).
ORACLE["op5_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
hit AS (SELECT DISTINCT doc_id, i FROM g JOIN f USING (h) WHERE least < doc_id),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w),
c AS (SELECT u.doc_id, word, j, coalesce(max(hit.i) OVER (PARTITION BY u.doc_id ORDER BY j) >= j - 49, false) AS covered FROM u LEFT JOIN hit ON hit.doc_id = u.doc_id AND hit.i = u.j),
k AS (SELECT doc_id, count(*) AS n_words, count_if(covered) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT covered) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

# Every set of tokens of every labelled url is counted, as FP-growth would find it.
ORACLE["op7_url_rules"] = r"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
b AS (SELECT page_id, url, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
given(kind, rule_host, rule_path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (SELECT page_id, url, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule, first(kind ORDER BY length(rule_host || rule_path) DESC) AS kind
  FROM b JOIN given ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id, url),
t AS (SELECT DISTINCT url, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '')), '[^a-z0-9]+'), lambda x: x <> ''))) AS items FROM pages WHERE url IS NOT NULL),
bad AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id HAVING bad IS NOT NULL),
basket AS (SELECT row_number() OVER () AS k, items, bad FROM pages JOIN t USING (url) JOIN bad USING (page_id)),
n AS (SELECT count(*) AS n, sum(bad) AS n_bad, ceil(greatest(0.002, 20 / greatest(1, count(*))) * count(*)) AS least FROM basket),
one AS (SELECT item FROM (SELECT unnest(items) AS item FROM basket) GROUP BY item HAVING count(*) >= (SELECT least FROM n)),
few AS (SELECT k, bad, list_sort(list(item)) AS items FROM (SELECT k, bad, unnest(items) AS item FROM basket) JOIN one USING (item) GROUP BY k, bad),
sub AS (SELECT bad, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items FROM (SELECT bad, items, unnest(range(1, 1 << len(items))) AS m FROM few)),
mined AS (SELECT items FROM sub, n GROUP BY items, n.n, n_bad, least HAVING sum(bad) >= least AND sum(bad) / count(*) >= 0.6 AND sum(bad) / count(*) / (n_bad / n.n) >= 1.5),
held AS (SELECT DISTINCT url FROM t JOIN mined ON list_has_all(t.items, mined.items))
SELECT b.page_id, host, path, rule, coalesce(kind, CASE WHEN held.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, rule IS NULL AND held.url IS NOT NULL AS mined
FROM b LEFT JOIN fit ON fit.page_id = b.page_id AND fit.url = b.url LEFT JOIN held ON held.url = b.url
"""

# Terms are those of the whole text; impacts and weights as in the operator, scores summed over the item's terms with repeats.
ORACLE["op11_lexical_search"] = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
a AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, a GROUP BY term, n_docs),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), a GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
"""

# Two rounds over whole numbers; the floor of a mean is taken in whole numbers as well.
_ROUND = """
d{0} AS (SELECT x.vec_id, x.part, e.entry, (x.c0 - e.c0) ** 2 + (x.c1 - e.c1) ** 2 + (x.c2 - e.c2) ** 2 + (x.c3 - e.c3) ** 2 AS d FROM x JOIN e{0} e USING (part)),
a{0} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best FROM d{0} GROUP BY vec_id, part)"""
_MOVE = """
s{0} AS (SELECT part, best.entry AS entry, count(*) AS n, sum(c0) AS c0, sum(c1) AS c1, sum(c2) AS c2, sum(c3) AS c3 FROM a{0} JOIN x USING (vec_id, part) GROUP BY part, best.entry),
e{1} AS MATERIALIZED (SELECT part, entry, """ + ", ".join(f"coalesce((s.c{j} - ((s.c{j} % n) + n) % n) // n, e.c{j})::BIGINT AS c{j}" for j in range(4)) + """ FROM e{0} e LEFT JOIN s{0} s USING (part, entry))"""
ORACLE["op13_vector_codes"] = (
    """
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT vec_id, p AS part, v[4 * p + 1] AS c0, v[4 * p + 2] AS c1, v[4 * p + 3] AS c2, v[4 * p + 4] AS c3 FROM k, range(16) r(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 64),
e0 AS MATERIALIZED (SELECT part, entry, c0, c1, c2, c3 FROM x JOIN first USING (vec_id)),"""
    + _ROUND.format(0)
    + ","
    + _MOVE.format(0, 1)
    + ","
    + _ROUND.format(1)
    + ","
    + _MOVE.format(1, 2)
    + ","
    + _ROUND.format(2)
    + """,
c AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(concat_ws(',', c0, c1, c2, c3), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e2)
SELECT c.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h
"""
)

_SKETCH = r"list_sort(list_distinct(list_transform(range(1, greatest(1, len({0}) - 4) + 1), lambda i: left(md5(array_to_string({0}[i : i + 4], ' ')), 16))))[:64]"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_UNION = "list_sort(list_distinct(list_concat({}, {})))[:64]"
# Every document's sketch, that of its edited text, and that of the document after it.
ORACLE["op12_fingerprints"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS next FROM documents WINDOW w AS (ORDER BY doc_id)),
e AS (SELECT doc_id, text, n, next, left(text, n - n // 2) || left(next, n // 2) AS edited FROM d),
w AS (SELECT doc_id, n, sha256(edited) AS edited_sha256, {_WORDS.format('text')} AS a, {_WORDS.format('edited')} AS b, {_WORDS.format('next')} AS c FROM e),
s AS (SELECT doc_id, n, edited_sha256, """ + ", ".join(f"CASE WHEN len({x}) = 0 THEN [] ELSE {_SKETCH.format(x)} END AS s{x}" for x in "abc") + f""" FROM w),
u AS (SELECT *, {_UNION.format('sa', 'sb')} AS uab, {_UNION.format('sa', 'sc')} AS uac FROM s)
SELECT doc_id, n AS n_chars, edited_sha256, array_to_string(sa, '') AS fingerprint, array_to_string(sb, '') AS edited_fingerprint,
  CASE WHEN len(uab) = 0 THEN 1 ELSE len(list_filter(uab, lambda x: list_contains(sa, x) AND list_contains(sb, x))) / len(uab) END::DOUBLE AS near_edited,
  CASE WHEN len(uac) = 0 THEN 1 ELSE len(list_filter(uac, lambda x: list_contains(sa, x) AND list_contains(sc, x))) / len(uac) END::DOUBLE AS near_next,
  CASE WHEN len(sa) = 0 THEN 1 WHEN len(list_filter(uab, lambda x: list_contains(sa, x))) > 0 THEN len(list_filter(uab, lambda x: list_contains(sa, x) AND list_contains(sb, x))) / len(list_filter(uab, lambda x: list_contains(sa, x))) END::DOUBLE AS held_by_edited,
  CASE WHEN len(sa) < 64 THEN len(sa) ELSE 63 / (('0x' || left(sa[64], 13))::BIGINT / 4503599627370496) END::DOUBLE AS n_shingles FROM u
"""
