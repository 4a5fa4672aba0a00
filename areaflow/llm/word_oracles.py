"""Checking SQL for DuckDB of the operators on words, written apart from the Spark plans."""

# CRC-32 by its usual table of 256 entries, made from the polynomial.
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
        lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) AS v FROM range(256) t(i)))"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a non-empty text; `tab` is in scope."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), "
            "4294967295)")


# Words that stand again q further on form islands; the smallest period of a stretch names it.
PERIODIC_RUNS = rf"""
WITH {_CRC_TABLE},
    d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32("doc_id::VARCHAR")} AS h FROM documents, crc_table),
    e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
    f AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM e WHERE h % 10 = 0 AND n > 0),
    t AS (SELECT doc_id, list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) AS w, n FROM f
        UNION ALL SELECT doc_id, w, n FROM e WHERE NOT (h % 10 = 0 AND n > 0)),
    x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM t WHERE n >= 24),
    m AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND 3 * (r.i - l.i) <= l.n),
    s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (
        SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island
        HAVING count(*) + q >= greatest(24, 3 * q)),
    r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
    best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
    texts AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
        FROM r GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM x ANTI JOIN gone USING (doc_id, i)
        WHERE doc_id IN (SELECT doc_id FROM r) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(CASE WHEN n_runs > 0 THEN words ELSE array_to_string(w, ' ') END) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN texts USING (doc_id) LEFT JOIN kept USING (doc_id)"""

# Near words meet over all texts with one letter deleted; forms are followed one at a time.
SPELLING_VARIANTS = rf"""
WITH RECURSIVE {_CRC_TABLE},
    r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM (
        SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
    h AS (SELECT run, times, {_crc32("(doc_id || ':' || run)")} AS h FROM r, crc_table),
    v AS (SELECT word, sum(times)::BIGINT AS n FROM (SELECT times, CASE WHEN h % 97 = 0
            THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h)
        WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
    cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
    pairs AS (SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
        UNION SELECT word, near, near_n FROM (SELECT c.word, v.word AS near, v.n AS near_n FROM cut c JOIN v ON c.rest = v.word)
        UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON c.rest = v.word),
    b AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
    f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN top END AS form_n,
        CASE WHEN top >= 2 * v.n THEN (SELECT min(near) FROM pairs p WHERE p.word = v.word AND p.near_n = top) END AS form
        FROM v LEFT JOIN b USING (word)),
    walk AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL
        SELECT walk.word, f.form, steps + 1 FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, max_by(root, steps) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n
FROM walk JOIN f USING (word) GROUP BY word, form"""

# Every stretch of a document as long as some window is compared with the windows.
DECONTAMINATION = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM low),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, array_to_string(w[i + 1:i + 10], ' ') AS phrase, least(len(w), 10) AS size FROM (
        SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
    st AS (SELECT r, size, i, array_to_string(w[i + 1:i + size], ' ') AS phrase FROM (
        SELECT r, w, size, unnest(range(n - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM win) WHERE n >= size)),
    m AS (SELECT r, i, st.size, item_id FROM st JOIN win ON st.phrase = win.phrase AND st.size = win.size),
    hit AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + size)) AS k FROM m) GROUP BY r),
    items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (
        SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS item FROM m) GROUP BY r)
SELECT doc_id, d.n AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

ORACLES = {"op11_decontamination": DECONTAMINATION, "op13_spelling_variants": SPELLING_VARIANTS, "op12_periodic_runs": PERIODIC_RUNS}
