"""The queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, html_text, langid, license, media, packing, pii, simhash, substring, topk, turns, vptree, whiten
from ledgerloom.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def packed(docs: DataFrame) -> DataFrame:
    return packing.op1_pack(docs, _vocabulary("byte_bpe_50k.json"), _vocabulary("byte_bpe_50k.tiktoken"), _split_pattern())


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.op2_substring(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op3_bpe(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.op4_license(table(spark, sf_dir, "documents"))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op5_tiff(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op6_langid(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op7_html(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op8_simhash(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op9_pii(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op10_topk(table(spark, sf_dir, "embeddings"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.op11_whiten(table(spark, sf_dir, "embeddings"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.op12_repair(table(spark, sf_dir, "conversations"))


def op13_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.op13_vptree(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_substring": op2_substring,
    "op3_bpe": op3_bpe,
    "op4_license": op4_license,
    "op5_tiff": op5_tiff,
    "op6_langid": op6_langid,
    "op7_html": op7_html,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_topk": op10_topk,
    "op11_whiten": op11_whiten,
    "op12_repair": op12_repair,
    "op13_vptree": op13_vptree,
}

_NOTICES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in n)) for n in license.notices())
_COMMON = ", ".join(f"'{w}'" for w in license.COMMON)
_TERMS = f"list_filter(string_split_regex(lower({{}}), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ({_COMMON}))"
_KNOWN = ", ".join(f"('{k.lower()}', '{k}')" for k in license.NAMES)
_COMMENTS = license.COMMENT.replace("(?md)", "")

ORACLES: dict[str, str] = {
    "op4_license": rf"""
        WITH notices(license, notice) AS (VALUES {_NOTICES}), laid AS (
            SELECT doc_id, coalesce(doc_id, 0) AS d, coalesce(source, '') AS src, coalesce(text, '') AS text,
                coalesce(doc_id, 0) % 2 = 0 AND contains(lower(coalesce(text, '')), 'licens') AS by_name, row_number() OVER () AS file
            FROM documents
        ), files AS (
            SELECT doc_id, file, text AS whole, regexp_replace(text, '{license.TAG_LINE}', '', 'g') AS text, '/' || src || '/' || CAST(d // 1000 AS VARCHAR) || CASE WHEN by_name AND d % 4 = 0 THEN '' ELSE '/' || CAST(d // 50 AS VARCHAR) END
                || '/' || CASE WHEN by_name THEN 'LICENSE-' ELSE '' END || coalesce(CAST(doc_id AS VARCHAR), '') AS path, by_name
            FROM laid
        ), marked AS (
            SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '{_COMMENTS}', chr(1), 'gm'), '^([^
][^
]*)
', '' || chr(10) || chr(10) || chr(1), 'gm'),
                '^([^
]*)
([^
])', '' || chr(10) || chr(10) || '', 'gm') AS marked
            FROM files
        ), units AS (
            SELECT file, path, unnest(list_concat(list_concat(string_split(text, chr(10)), list_filter(string_split_regex(marked, '
[ 	
]*
'), lambda p: contains(p, chr(10)))),
                CASE WHEN by_name THEN [text] ELSE [] END)) AS unit
            FROM marked
        ), numbered AS (SELECT file, path, {_TERMS.format("unit")} AS terms, row_number() OVER () AS u FROM units),
        held AS (SELECT license, notice, term, count(*) AS tf FROM (SELECT license, notice, unnest({_TERMS.format("notice")}) AS term FROM notices) GROUP BY ALL),
        hits AS (
            SELECT file, path, u, n, term, count(*) AS tf FROM (SELECT file, path, u, len(terms) AS n, unnest(terms) AS term FROM numbered)
            WHERE term IN (SELECT term FROM held) GROUP BY ALL
        ), total AS (SELECT count(*) AS total FROM documents),
        df AS (SELECT term, count(DISTINCT file) AS df FROM hits GROUP BY term),
        own AS (SELECT license, notice, term, tf * (ln((1.0::DOUBLE + total) / (1 + coalesce(df, 0))) + 1) AS v FROM held LEFT JOIN df USING (term), total),
        norms AS (SELECT license, notice, sqrt(sum(v * v)) AS norm FROM own GROUP BY ALL),
        w AS (SELECT file, path, u, n, term, tf, tf * (ln((1.0::DOUBLE + total) / (1 + df)) + 1) AS w FROM hits JOIN df USING (term), total),
        lengths AS (
            SELECT u, sqrt(sum(w * w) + power(ln((1.0::DOUBLE + any_value(total)) / (1 + sqrt(any_value(total)))) + 1, 2) * (any_value(n) - sum(tf))) AS length
            FROM w, total GROUP BY u
        ), known(id, license) AS (VALUES {_KNOWN}),
        tags AS (SELECT path, row_number() OVER () AS tag, expression FROM (SELECT path, unnest(regexp_extract_all(whole, '{license.TAG}', 1)) AS expression FROM files)),
        words AS (SELECT path, tag, t AS word, p FROM (SELECT path, tag, unnest(ts) AS t, generate_subscripts(ts, 1) AS p FROM (SELECT path, tag, list_filter(string_split_regex(regexp_replace(expression, '{license.EXCEPTION}', '', 'g'), '[ ()]+'), lambda t: t <> '') AS ts FROM tags))),
        exact AS (
            SELECT path, string_agg(CASE WHEN upper(word) IN ('AND', 'OR') THEN upper(word) ELSE license END, ' ' ORDER BY p) AS license
            FROM words LEFT JOIN known ON id = lower(regexp_replace(word, '{license.VERSIONS}', '')) GROUP BY path, tag HAVING bool_and(upper(word) IN ('AND', 'OR') OR license IS NOT NULL)
        ), found AS (
            SELECT path, license, round(sum(w * v / norm) / any_value(length), 6) AS score
            FROM w JOIN own USING (term) JOIN norms USING (license, notice) JOIN lengths USING (u) GROUP BY path, u, license, notice
            HAVING score >= {license.LEAST}
            UNION ALL SELECT path, license, 1.0::DOUBLE FROM exact
        ), best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
        homes AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS home FROM files),
        grants AS (
            SELECT home AS dir, path AS from_path, license AS from_license, score AS from_score FROM best JOIN (SELECT DISTINCT path, home FROM homes WHERE by_name) USING (path)
            QUALIFY row_number() OVER (PARTITION BY home ORDER BY score DESC, path) = 1
        ), nearest AS (
            SELECT home, from_path, from_license, from_score FROM (SELECT DISTINCT home FROM homes) JOIN grants ON home = dir OR starts_with(home, dir || '/')
            QUALIFY row_number() OVER (PARTITION BY home ORDER BY length(dir) DESC) = 1
        )
        SELECT doc_id, path, coalesce(license, from_license) AS license, coalesce(score, from_score) AS score,
            CASE WHEN license IS NOT NULL AND by_name THEN 'file' WHEN license IS NOT NULL THEN 'header' WHEN from_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
            CASE WHEN license IS NOT NULL THEN path ELSE from_path END AS licensed_by
        FROM homes LEFT JOIN best USING (path) LEFT JOIN nearest USING (home)
    """,
    "op10_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20
    """,
    "op12_repair": r"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
        ), marked AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda p: CAST(ascii(k[p]) AS BIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS crc
            FROM keyed
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN crc = 4 THEN 'user' ELSE role END AS role,
                CASE crc WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE crc WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM marked
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM damaged
        ), turns AS (
            SELECT conv_id, i, turn, role, text, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair,
                CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM numbered
        ), told AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
                count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM turns GROUP BY conv_id
        ), ids AS (SELECT DISTINCT conv_id FROM conversations),
        -- state: what the last turn left is (0 none, 1 system, 2 user, 3 assistant); filled: the state after so many inserted turns
        fills(state, inserts, filled, added) AS (VALUES
            (0, 0, 0, []::VARCHAR[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
            (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])
        ), edits(edit, filled, initial, state, price) AS (VALUES
            ('D', 0, NULL, 0, 4), ('D', 1, NULL, 1, 4), ('D', 2, NULL, 2, 4), ('D', 3, NULL, 3, 4), ('R', 0, NULL, 2, 3), ('R', 1, NULL, 2, 3), ('R', 2, NULL, 3, 3), ('R', 3, NULL, 2, 3),
            ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 2, 'a', 3, 0), ('K', 3, 'u', 2, 0)
        ), best AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS kept FROM ids
            UNION ALL
            SELECT conv_id, i, state, cost, audit, kept FROM (
                SELECT b.conv_id, t.i, e.state, b.cost + 3 * f.inserts + e.price + CASE WHEN t.fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END AS cost, b.audit || repeat('I', f.inserts) || e.edit AS audit,
                    list_concat(list_concat(b.kept, f.added), CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [CASE e.state WHEN 2 THEN 'user:' ELSE 'assistant:' END || t.text] END) AS kept
                FROM best b JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i + 1 JOIN fills f ON f.state = b.state
                    JOIN edits e ON e.filled = f.filled AND (e.initial IS NULL OR e.initial = t.initial) AND (e.edit = 'D' OR t.fault IN ('', 'truncated'))
            ) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
        ), ended AS (
            SELECT b.conv_id, b.cost + 3 * f.inserts AS cost, b.audit || repeat('I', f.inserts) AS audit, list_concat(b.kept, f.added) AS kept
            FROM best b LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM b.conv_id JOIN fills f ON f.state = b.state AND f.filled IN (0, 3)
            WHERE b.i = coalesce(told.n, 0) QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + 3 * f.inserts, b.audit || repeat('I', f.inserts)) = 1
        )
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(kept, chr(10))) AS repaired_sha256
        FROM ended e LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
}
