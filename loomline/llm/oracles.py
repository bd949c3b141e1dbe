"""SQL for the queries of this package that SQL can express over the same tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(13, len(w)) AS n,
          unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT DISTINCT dw.doc_id, s, dw.n, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h
  FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""

_DIGITS = ", ".join(
    f"(('0x' || substr(h, {5 * part + 1}, 5))::INT >> {shift}) & 31"
    for part in range(8) for shift in (15, 10, 5, 0)
)

WARC = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform([{_DIGITS}],
    lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN g USING (h)
"""

MIXTURE = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(text, '')) AS name,
    row_number() OVER (PARTITION BY source, doc_id, coalesce(text, '')) - 1 AS copy
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST(([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS BIGINT) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source) AS k,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
      ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS DOUBLE) AS words_left,
    CAST(sum(w) OVER () - coalesce(sum(w) OVER (
      ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS DOUBLE) AS weight_left
  FROM s),
share AS (
  SELECT words_left / weight_left AS v FROM o
  WHERE 3 * source_size >= w * (words_left / weight_left) ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), w * (SELECT v FROM share)) AS target
  FROM o),
e AS (
  SELECT d.doc_id, d.source, d.size, d.name, d.copy, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0e0 END AS ratio,
    (CAST('0x' || substr(md5(concat('mix-1:', doc_id, ':', d.name, ':', d.copy)), 1, 13) AS BIGINT) + 0.5e0)
      / 4503599627370496e0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (
  SELECT *, floor(ratio) AS whole, target - floor(ratio) * source_size AS missing,
    ratio - floor(ratio) AS chance FROM e),
g AS (
  SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank FROM f),
h AS (
  SELECT *, rank IS NOT NULL
    AND sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, name, copy) <= missing AS chosen
  FROM g),
gap AS (
  SELECT *, missing - coalesce(sum(CASE WHEN chosen THEN size END) OVER (PARTITION BY source), 0)
    AS gap FROM h),
fill AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
      CASE WHEN NOT chosen AND rank IS NOT NULL AND abs(size - gap) < gap THEN 0 ELSE 1 END,
      abs(size - gap), rank, doc_id, name, copy) = 1
    AND NOT chosen AND rank IS NOT NULL AND abs(size - gap) < gap AS filled
  FROM gap)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN chosen OR filled THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM fill
"""

FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t FROM documents),
k AS (
  SELECT *, len(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(t) + 1) AS one,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(t) + 1) AS two,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS three, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS four
  FROM d),
p AS (
  SELECT *, array_to_string(t[1:least(one, two)], '') AS prefix,
    array_to_string(t[least(one, two) + 1:greatest(one, two)], '') AS middle,
    array_to_string(t[greatest(one, two) + 1:n], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR three >= 90 THEN 'plain' WHEN four < 20 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
    ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

EXACT_DUPLICATES = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY chars DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY bare) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.w, b.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
