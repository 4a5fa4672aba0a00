"""Checking SQL for DuckDB of the queries that SQL can express, written apart from the Spark plans."""

from areaflow.llm.quality_rules import COMMON_WORDS, MAX_CLASS_DISTANCE, MAX_COMMON_DISTANCE, MIN_JUDGED_WORDS

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
    doc_id = first_value(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)"""

# Every seat of every source competes, and every block of every document is counted.
MIXING = f"""
WITH f AS (SELECT doc_id, source, len({_WORDS}) AS size, md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '')) AS key
        FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk FROM f GROUP BY source),
    w AS (SELECT *, rk % 3 + 1 AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s),
    o AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
    g AS (SELECT *, least(weight * (SELECT level FROM o WHERE cap / weight >= level ORDER BY cap / weight, rk LIMIT 1), cap)::DOUBLE AS target,
            (source_size + 63) // 64 AS blocks FROM o),
    seats AS (SELECT rk, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, rk) AS place
        FROM (SELECT rk, target, unnest(range(3 * blocks)) AS i FROM g WHERE target > 0)),
    q AS (SELECT rk, count(*) AS quota FROM seats WHERE place <= (SELECT (max(total) + 32) // 64 FROM g) GROUP BY rk),
    plan AS (SELECT g.*, coalesce(quota, 0) AS quota, CASE WHEN blocks > 0
        THEN ('0x' || substr(md5('17:' || coalesce(source, '')), 1, 8))::BIGINT % blocks END AS first_block FROM g LEFT JOIN q USING (rk)),
    r AS (SELECT f.*, (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS begin FROM f),
    b AS (SELECT doc_id, size, source_size, target, begin, blocks, quota, first_block,
            unnest(CASE WHEN size > 0 THEN range(begin // 64, (begin + size - 1) // 64 + 1) ELSE [0::BIGINT] END) AS j
        FROM r JOIN plan ON r.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(sum((least(begin + size, 64 * j + 64) - greatest(begin, 64 * j))
    * (quota // blocks + CASE WHEN ((j - first_block) % blocks + blocks) % blocks < quota % blocks THEN 1 ELSE 0 END))
    FILTER (size > 0), 0)::BIGINT AS taken
FROM b GROUP BY doc_id, size, source_size, target"""

_LISTS = " ".join(f"WHEN '{lang}' THEN {words!r}" for lang, words in COMMON_WORDS.items())


def _part(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists."""
    both = f"list_transform(list_zip({p}, {q}), lambda x: {_part('x[1]', 'x[2]')} + {_part('x[2]', 'x[1]')})"
    return f"sqrt(greatest(list_sum({both}) / 2, 0))"


_REFS = ", ".join(f"round(avg(cs[{i}]), 6)" for i in range(1, 6))
_WREFS = ", ".join(f"round(avg(ws[{i}]), 6)" for i in range(1, 12))

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS.replace("t,", "coalesce(text, ''),")} AS w FROM documents),
    triples AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1], w[i + 2], w[i + 3]) AS n FROM (
        SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM triples, (VALUES (0), (1), (2)) v(k) WHERE triples.n > 1 GROUP BY doc_id),
    lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    c AS (SELECT d.doc_id, lang, length(t) AS l, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
        len(regexp_extract_all(t, '\p{{Lu}}')) AS up, len(regexp_extract_all(t, '[0-9]')) AS dg,
        len(regexp_extract_all(t, '[^\p{{L}}0-9\x20\x09-\x0D]')) AS mk,
        list_transform(CASE lang {_LISTS} END, lambda y: len(list_filter(w, lambda x: lower(x) = y))) AS common
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
    s AS (SELECT *, CASE WHEN lang IN {tuple(COMMON_WORDS)} THEN lang ELSE '' END AS known,
        [up / greatest(l, 1), dg / greatest(l, 1), mk / greatest(l, 1), (l - word_chars) / greatest(l, 1), (word_chars - up - dg - mk) / greatest(l, 1)] AS cs,
        list_append(list_transform(common, lambda x: x / greatest(n_words, 1)), (n_words - list_sum(common)) / greatest(n_words, 1)) AS ws FROM c),
    ref AS (SELECT known, [{_REFS}] AS rc, [{_WREFS}] AS rw FROM s WHERE n_words >= {MIN_JUDGED_WORDS} GROUP BY known),
    j AS (SELECT s.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CASE WHEN n_words >= {MIN_JUDGED_WORDS} THEN round({_distance("cs", "rc")}, 6) END AS class_distance,
        CASE WHEN n_words >= {MIN_JUDGED_WORDS} AND known <> '' THEN round({_distance("ws", "rw")}, 6) END AS common_distance
        FROM s LEFT JOIN ref USING (known))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(class_distance, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(common_distance, 0) <= {MAX_COMMON_DISTANCE} AS kept,
    class_distance, common_distance FROM j"""

ORACLES = {"op2_exact_dedup": EXACT_DEDUP, "op5_mixing": MIXING, "op10_quality_rules": QUALITY_RULES}
