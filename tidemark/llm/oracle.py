"""DuckDB SQL for the queries that compare whole texts: windows of words and bytes, shingle sets, lines as sets."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LEADS = ", ".join(["word", *(f"lead(word, {k}) OVER d" for k in range(1, 13))])

#: Windows of 13 words; a word goes if it is in one that also starts in a document of smaller doc_id.
SUBSTRING = f"""
    WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
    t AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
    g AS (
        SELECT doc_id, word, i, CASE WHEN lead(word, 12) OVER d IS NOT NULL THEN concat_ws(' ', {_LEADS}) END AS said
        FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    ),
    m AS (SELECT said, min(doc_id) AS least FROM g WHERE said IS NOT NULL GROUP BY said),
    b AS (SELECT doc_id, word, i, CASE WHEN least < doc_id THEN 1 ELSE 0 END AS later FROM g LEFT JOIN m USING (said)),
    c AS (SELECT doc_id, word, i, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM b),
    k AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
    SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets of five-word shingles, links at 85 of 100, components by what links reach.
NEAR = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
    t AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
    g AS (
        SELECT doc_id, n, CASE WHEN n < 5 THEN NULL WHEN lead(word, 4) OVER d IS NOT NULL
               THEN concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d) END AS shingle
        FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    ),
    s AS (
        SELECT DISTINCT doc_id, shingle FROM g WHERE shingle IS NOT NULL
        UNION ALL SELECT doc_id, concat(len(words), ':', array_to_string(words, ' ')) FROM w WHERE len(words) BETWEEN 1 AND 4
    ),
    n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (
        SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
        WHERE 100 * both_have >= 85 * (a.n_shingles + b.n_shingles - both_have)
    ),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.seen = e.x)
    SELECT w.doc_id, coalesce(n_shingles, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
    FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) c ON w.doc_id = c.doc_id
"""

#: Lines as sets of words; one goes if its set, or one similar at 80 of 100, has an earlier first line. The join is on the
#: rarest words of each set, as many as a similar set must share one of.
LINES = r"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
    l AS (SELECT doc_id, unnest(own) AS line, unnest(range(1, len(own) + 1)) AS i FROM d),
    s AS (SELECT doc_id, line, i, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS words FROM l),
    f AS (SELECT words, min(struct_pack(doc_id := doc_id, i := i)) AS first_at, row_number() OVER () AS set_id FROM s WHERE len(words) > 0 GROUP BY words),
    t AS (SELECT set_id, len(words) AS n, unnest(words) AS word FROM f),
    c AS (SELECT word, count(*) AS often FROM t GROUP BY word),
    o AS (SELECT set_id, n, word, row_number() OVER (PARTITION BY set_id ORDER BY often, word) AS place FROM t JOIN c USING (word)),
    x AS (SELECT set_id, n, word FROM o WHERE place <= n - (80 * n + 99) // 100 + 1),
    p AS (SELECT DISTINCT a.set_id AS x, b.set_id AS y FROM x a JOIN x b ON a.word = b.word AND a.set_id <> b.set_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
    h AS (
        SELECT DISTINCT x AS set_id FROM (
            SELECT x, a.words AS u, b.words AS v, len(list_intersect(a.words, b.words)) AS both_have
            FROM p JOIN f a ON a.set_id = x JOIN f b ON b.set_id = y WHERE b.first_at < a.first_at
        ) WHERE 100 * both_have >= 80 * (len(u) + len(v) - both_have)
    ),
    g AS (
        SELECT s.doc_id, s.line, s.i, coalesce(h.set_id IS NOT NULL OR f.first_at <> struct_pack(doc_id := s.doc_id, i := s.i), false) AS gone
        FROM s LEFT JOIN f ON s.words = f.words LEFT JOIN h ON f.set_id = h.set_id
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM g GROUP BY doc_id
"""

#: Strings of 200 bytes, as pieces of the text's bytes in hexadecimal digits; a byte goes if it is in one that starts twice.
STRINGS = """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, encode(coalesce(text, '')) AS raw FROM documents),
    z AS (SELECT r, raw, octet_length(raw) AS n FROM d),
    w AS (SELECT r, i, md5(raw[i + 1:i + 200]) AS h FROM (SELECT r, raw, unnest(range(0, n - 199)) AS i FROM z WHERE n >= 200)),
    a AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
    s AS (SELECT r, i FROM w JOIN a USING (h)),
    q AS (SELECT r, i, i - lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) > 200 AS fresh FROM s),
    u AS (SELECT r, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS span FROM q),
    v AS (SELECT r, span, min(i) AS low, max(i) + 200 AS high FROM u GROUP BY r, span),
    k AS (
        SELECT r, low, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS since FROM v
        UNION ALL SELECT z.r, n, coalesce(max(high), 0) FROM z LEFT JOIN v ON z.r = v.r GROUP BY z.r, n
    ),
    e AS (SELECT k.r, string_agg(hex(raw[since + 1:low]), '' ORDER BY low) FILTER (WHERE low > since) AS kept FROM k JOIN z ON k.r = z.r GROUP BY k.r),
    m AS (SELECT r, sum(high - low) AS n_removed, count(*) AS n_spans FROM v GROUP BY r)
    SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM d LEFT JOIN m ON d.r = m.r LEFT JOIN e ON d.r = e.r
"""

#: The text of the article element, as all pages of the tables have one, block by block, with the character references that
#: they use. The query itself knows nothing of this: it judges blocks by their features.
PAGES = r"""
    WITH a AS (
        SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<!--.*?-->', '', 'gs') AS own FROM pages
    ),
    b AS (SELECT page_id, url, regexp_replace(regexp_replace(own, '<br\s*/?>', ' ', 'g'), '</?(?:p|h1|h2|h3|ul|li|div|table|tr|td|pre|blockquote)\b[^>]*>', chr(1), 'g') AS own FROM a),
    c AS (
        SELECT page_id, url, list_transform(string_split(regexp_replace(own, '<[^>]+>', '', 'g'), chr(1)),
               lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS own FROM b
    ),
    d AS (SELECT page_id, url, coalesce(array_to_string(list_filter(own, lambda x: x <> ''), chr(10)), '') AS text FROM c)
    SELECT page_id, url, text, length(text) AS n_chars FROM d
"""
