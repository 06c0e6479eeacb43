"""The same results in SQL, for DuckDB, where SQL can express them."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

EXACT_DEDUP = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM n WINDOW same AS (PARTITION BY norm)
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
           FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest(generate_series(0, 7)) AS j) GROUP BY doc_id),
e AS (SELECT doc_id, source, t, unnest(ls) AS l FROM d),
f AS (SELECT doc_id, source, t, trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS form,
             len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS lw FROM e),
h AS (SELECT source, count(DISTINCT t) AS host_texts FROM d GROUP BY source),
q AS (SELECT f.source, form FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source
      GROUP BY f.source, form, host_texts HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > 0.02 * host_texts),
x AS (SELECT doc_id, sum(lw) AS removed, list(f.form) AS forms FROM f JOIN q ON f.source IS NOT DISTINCT FROM q.source AND f.form = q.form GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             CAST(coalesce(removed, 0) AS BIGINT) AS removed_words,
             sha256(array_to_string(list_transform(list_filter(ls, lambda l: NOT list_contains(coalesce(forms, []),
               trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')))), lambda l: left(sha256(l), 32)), '')) AS left_sha256
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND removed_words <= 0.5 * n_words AS kept
FROM s
"""
