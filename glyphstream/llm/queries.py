"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from glyphstream.llm import warc
from glyphstream.llm.erasure import op11_erasure
from glyphstream.llm.language import op2_language_crf
from glyphstream.llm.lloyd import op13_delta_lloyd
from glyphstream.llm.mixing import op8_mixing
from glyphstream.llm.nearest import op4_inverted_multi_index
from glyphstream.llm.packing import op1_packing
from glyphstream.llm.pieces import op12_sentencepiece
from glyphstream.llm.quality import op6_co_training
from glyphstream.llm.secrets import op7_secret_scans
from glyphstream.llm.similar import op9_jaccard_join
from glyphstream.llm.substrings import op3_substring_dedup
from glyphstream.llm.telephony import op5_telephony
from glyphstream.llm.warc import op10_warc_fixity

QUERIES = {f.__name__: f for f in (op1_packing, op2_language_crf, op3_substring_dedup, op4_inverted_multi_index, op5_telephony, op6_co_training, op7_secret_scans, op8_mixing, op9_jaccard_join, op10_warc_fixity, op11_erasure, op12_sentencepiece, op13_delta_lloyd)}

def _lloyd_sql(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """Rounds of assignment and exact floors of means, one after another."""
    out = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256(concat('1:', vec_id))) - 1 AS INTEGER) AS c, q FROM v QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min(struct_pack(d := d, c := c)) AS m FROM (
  SELECT vec_id, v.q, c, CAST(list_sum(list_transform(list_zip(v.q, k.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r} k) x GROUP BY vec_id)""")
        if r < rounds:
            out.append(f"""s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(q) AS x, unnest(range(1, {dim + 1})) AS i FROM a{r}) x GROUP BY c, i),
n{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.q, o.q) AS q FROM c{r} o LEFT JOIN n{r} n USING (c))""")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, m.c AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} k ON k.c = m.c"""


_SPLIT = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "op13_delta_lloyd": _lloyd_sql(),
    "op3_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_SPLIT.format(text="coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, ws FROM d),
w AS (SELECT doc_id, s, array_to_string(ws[s:s+19], ' ') AS k FROM p),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM w),
g AS (SELECT DISTINCT doc_id, s + j AS i FROM (SELECT doc_id, s, unnest(range(0, 20)) AS j FROM f WHERE rn > 1) x),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS kept, count(*) AS n FROM t ANTI JOIN g ON t.doc_id = g.doc_id AND t.i = g.i GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op9_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o WHERE 100 * c >= 75 * (na + nb - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS v, b AS w FROM u UNION SELECT r.v, u.b FROM r JOIN u ON r.w = u.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.w, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT v, min(w) AS w FROM r GROUP BY v) m ON m.v = s.doc_id""",
    "op10_warc_fixity": f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10), 'WARC-Date: {warc.DATE}', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10))) AS rec FROM pages),
h AS (SELECT page_id, url, CAST(octet_length(rec) AS BIGINT) AS length, sha256(rec) AS digest, sha256(CASE WHEN page_id % {warc.FAULT_EVERY} = 0 THEN rec[1:octet_length(rec) - 1] || '\\x00'::BLOB ELSE rec END) AS copy_digest FROM p),
g AS (SELECT page_id, url, length, digest, copy_digest, count(*) AS copies FROM h GROUP BY ALL),
n AS (SELECT greatest(1, CAST(ceil(count(*) / {warc.PER_ARCHIVE}) AS BIGINT)) AS n FROM pages),
a AS (SELECT g.*, CAST('0x' || substr(sha256(concat(page_id, '|', url, '|', digest)), 1, 12) AS BIGINT) % n.n AS archive FROM g, n)
SELECT page_id, url, archive, row_number() OVER w - 1 AS seq, CAST(sum(length) OVER w - length AS BIGINT) AS record_offset, length, digest, copies, CASE WHEN digest = copy_digest THEN 'ok' ELSE 'changed' END AS status, copy_digest
FROM a WINDOW w AS (PARTITION BY archive ORDER BY page_id, url, digest ROWS UNBOUNDED PRECEDING)""",
}
