"""SQL of the registered queries, where SQL can say the same."""

from __future__ import annotations

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(LOWER.format("text"))

ORACLE: dict[str, str] = {
    "op3_decontamination": f"""
        WITH doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
        item AS (SELECT item_id::VARCHAR AS item_id, {WORDS} AS w FROM benchmark),
        starts AS (
            SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p
            FROM item WHERE len(w) > 0
        ),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM starts),
        doc_starts AS (
            SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
            FROM doc, (SELECT DISTINCT n FROM windows)
        ),
        hits AS (
            SELECT doc_id, item_id, n, p
            FROM (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k FROM doc_starts)
            JOIN windows USING (n, k)
        ),
        covered AS (
            SELECT doc_id, count(DISTINCT word) AS n_hit
            FROM (SELECT doc_id, unnest(range(p, p + n)) AS word FROM hits) GROUP BY doc_id
        ),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
            FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op6_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h
            FROM documents
        ),
        sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
        ranked AS (
            SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
                   [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
            FROM sources
        ),
        levels AS (
            SELECT a.source, a.source_size, a.cap, a.weight,
                   (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)
                    - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0))
                   / (sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight)) AS level
            FROM ranked a CROSS JOIN ranked b GROUP BY ALL
        ),
        targets AS (
            SELECT source, source_size,
                   round(least(cap, coalesce((SELECT min_by(level, cap / weight) FROM levels
                                              WHERE cap / weight > level) * weight, cap)), 6) AS target
            FROM levels
        ),
        planned AS (
            SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::INT AS whole
            FROM targets
        ),
        missing AS (SELECT *, target - whole * source_size AS missing FROM planned),
        sums AS (
            SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS running
            FROM docs GROUP BY source, h
        ),
        borders AS (
            SELECT s.source, min(s.h) AS h, min_by(running, s.h) AS running, min_by(words, s.h) AS words
            FROM sums s JOIN missing m ON s.source IS NOT DISTINCT FROM m.source
            WHERE missing > 0 AND running >= missing GROUP BY s.source
        ),
        plans AS (
            SELECT m.*, b.h AS border,
                   running - missing < missing - (running - words) AS inclusive
            FROM missing m LEFT JOIN borders b ON m.source IS NOT DISTINCT FROM b.source
        )
        SELECT doc_id, size, source_size, target,
               (size * (whole + coalesce(d.h < border OR (inclusive AND d.h = border), false)::INT))::BIGINT AS taken
        FROM docs d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source
    """,
    "op8_revisits": r"""
        WITH base AS (
            SELECT page_id, url, '"' || md5(html) || '"' AS tag, '"' || md5(html || '2') || '"' AS second,
                   'day ' || (page_id % 1000) AS modified, 'day ' || ((page_id + 1) % 1000) AS later,
                   octet_length(encode(html))::VARCHAR AS length,
                   1700000000 + page_id AS moment, 86400 AS day, 86400 * 365 AS year, 'http://all.example/' AS common,
                   regexp_extract(url, '^[^/]*//[^/]*') AS front, regexp_replace(url, '^[^/]*//[^/]*', '') AS back
            FROM pages
        ),
        captures AS (
            SELECT page_id * 16 AS record_id, page_id, url, moment AS ts, 'response' AS type, 200 AS status, tag AS etag,
                   modified, length, 'text/html' AS content, 'max-age=60' AS cache, NULL::VARCHAR AS age FROM base
            UNION ALL
            SELECT page_id * 16 + 1, page_id, upper(front) || back || '#again', moment + year, 'revisit', 304, 'W/' || tag,
                   NULL, '0', NULL, 'max-age=3600', NULL FROM base
            UNION ALL
            SELECT page_id * 16 + 2, page_id, url, moment + 2 * year, 'revisit', 304, 'x' || tag, NULL, '0', NULL, NULL, NULL
            FROM base WHERE page_id % 3 = 0
            UNION ALL
            SELECT page_id * 16 + 3, page_id, url, moment - year, 'revisit', 304, tag, NULL, NULL, NULL, NULL, NULL
            FROM base WHERE page_id % 5 = 0
            UNION ALL
            SELECT page_id * 16 + 4, page_id, url, moment + 3 * year, 'revisit', 304, NULL, modified, NULL, NULL, NULL, '9'
            FROM base WHERE page_id % 7 = 0
            UNION ALL
            SELECT page_id * 16 + 5, page_id, url, moment + 4 * year, 'revisit', 304, NULL, NULL, NULL, NULL, NULL, '9'
            FROM base WHERE page_id % 11 = 0
            UNION ALL
            SELECT page_id * 16 + 6, page_id, url, moment + 182 * day, 'response', 200, second, later, length, 'text/html',
                   'max-age=120', NULL FROM base WHERE page_id % 2 = 0
            UNION ALL
            SELECT page_id * 16 + 7, page_id, url, moment + 200 * day, 'response', 200, tag, modified, length, 'text/html',
                   NULL, NULL FROM base WHERE page_id % 4 = 0
            UNION ALL
            SELECT page_id * 16 + 8, page_id, url, moment + 190 * day, 'revisit', 304, second, NULL, '0', NULL, NULL, NULL
            FROM base WHERE page_id % 2 = 0
            UNION ALL
            SELECT page_id * 16 + 9, page_id, url, moment + 5 * day, 'revisit', 200, tag, NULL, '0', 'text/html', NULL, NULL
            FROM base WHERE page_id % 13 = 0
            UNION ALL
            SELECT page_id * 16 + 10, page_id, url, moment + 6 * day, 'revisit', 404, tag, NULL, '0', NULL, NULL, NULL
            FROM base WHERE page_id % 17 = 0
            UNION ALL
            SELECT page_id * 16 + 11, page_id, common, moment, 'response', 200, tag, NULL, length, 'text/html', NULL, NULL
            FROM base WHERE page_id % 3 = 1
            UNION ALL
            SELECT page_id * 16 + 12, page_id, common, moment + 1, 'revisit', 304, tag, NULL, '0', NULL, NULL, NULL
            FROM base WHERE page_id % 3 = 1
            UNION ALL
            SELECT page_id * 16 + 13, page_id, common, moment + 2, 'revisit', 304, second, NULL, '0', NULL, NULL, NULL
            FROM base WHERE page_id % 3 = 1
        ),
        split AS (
            SELECT *, regexp_replace(trim(url), '#.*$', '') AS plain FROM captures
        ),
        cut AS (
            SELECT *, lower(regexp_extract(plain, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
                   lower(regexp_extract(plain, '^[^:/]*://([^/?]*)', 1)) AS host,
                   regexp_extract(plain, '^[^:/]*://[^/?]*([^?]*)', 1) AS path,
                   array_to_string(list_sort(list_filter(
                       string_split(regexp_extract(plain, '[?](.*)$', 1), '&'),
                       lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS query
            FROM split
        ),
        named AS (
            SELECT *, scheme || '://'
                   || CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '')
                                  WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
                   || CASE path WHEN '' THEN '/' ELSE path END
                   || CASE query WHEN '' THEN '' ELSE '?' || query END AS canonical_url
            FROM cut
        ),
        joined AS (
            SELECT v.*, s.record_id AS found, s.etag AS s_etag, s.modified AS s_modified, s.length AS s_length,
                   s.content AS s_content, s.cache AS s_cache
            FROM named v LEFT JOIN named s
              ON s.canonical_url = v.canonical_url AND s.type = 'response' AND s.ts < v.ts AND v.type = 'revisit'
            QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY s.ts DESC, s.record_id DESC) = 1
        ),
        judged AS (
            SELECT *, coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(s_etag, '^W/', ''),
                               modified = s_modified) AS same
            FROM joined
        ),
        outcomes AS (
            SELECT *, CASE WHEN type = 'response' THEN 'full' WHEN status <> 304 THEN 'not a 304' WHEN found IS NULL THEN 'no earlier response'
                           WHEN same THEN 'resolved' WHEN same IS NULL THEN 'no validator' ELSE 'mismatch' END AS outcome
            FROM judged
        )
        SELECT record_id, page_id, canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN found END AS source_id,
               CASE WHEN outcome = 'resolved' THEN 200 ELSE status END AS status,
               concat_ws(chr(10), 'age: ' || age,
                   'cache-control: ' || CASE WHEN outcome = 'resolved' THEN coalesce(cache, s_cache) ELSE cache END,
                   'content-length: ' || CASE WHEN outcome = 'resolved' THEN s_length ELSE length END,
                   'content-type: ' || CASE WHEN outcome = 'resolved' THEN s_content ELSE content END,
                   'etag: ' || CASE WHEN outcome = 'resolved' THEN coalesce(etag, s_etag) ELSE etag END,
                   'last-modified: ' || CASE WHEN outcome = 'resolved' THEN coalesce(modified, s_modified) ELSE modified END
               ) AS headers
        FROM outcomes
    """,
    "op9_exact_dedup": f"""
        WITH digests AS (SELECT doc_id, sha256({LOWER.format("text")}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, text_sha256
        FROM digests WINDOW same AS (PARTITION BY text_sha256)
    """,
}
