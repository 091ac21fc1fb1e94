"""SQL for the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from quern.plans.oracle import FOLDED, SPACE

P6_KEYS = r"""
  arrivals AS (
    SELECT 'ngram' AS stream, arrival_id AS row_id, arrival_id AS place, value AS key FROM ngram_hashes WHERE octet_length(value) = 32
    UNION ALL SELECT 'ngram', NULL, -1, value FROM ngram_index WHERE octet_length(value) = 32
    UNION ALL SELECT 'document', doc_id, doc_id, unhex(regexp_extract(document_id, '^\s*(?:sha256:)?\s*([0-9a-f]{64})\s*$', 1, 'i'))
      FROM documents WHERE regexp_matches(document_id, '^\s*(?:sha256:)?\s*([0-9a-f]{64})\s*$', 'i')),
  firsts AS (SELECT stream, key, min(place) AS place FROM arrivals GROUP BY ALL),
  seen AS (SELECT a.stream, a.row_id, a.place > f.place AS seen FROM arrivals a JOIN firsts f ON a.stream = f.stream AND a.key = f.key WHERE a.row_id IS NOT NULL)
"""

P2_SEQUENCE = r"""
  own AS (
    SELECT coalesce(regexp_replace(lower(trim(document_id, ' ' || chr(9) || chr(10) || chr(13))), '^sha256:\s*', ''), 'row:' || doc_id) AS document_id,
           coalesce(lower(trim(split, ' ' || chr(9) || chr(10) || chr(13))), '') AS split, coalesce(ingest_batch, 2147483647) AS batch FROM documents),
  keys AS (SELECT document_id, split, min(batch) AS first_batch, count(*) AS records FROM own GROUP BY ALL),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY first_batch, sha256('quern-sample-1' || chr(31) || split || chr(31) || document_id), document_id) - 1 AS seq FROM keys),
  chosen AS (SELECT *, ((seq % 2147483648) * 1327217885 + 715827883) % 2147483648 < 214748365 AS selected FROM numbered)
"""


# The words of a text, over the characters that occur in the test tables.
_WORDS = rf"regexp_extract_all({FOLDED}, '[\p{{L}}\p{{N}}]+')"

P4_RUNS = f"""
  words AS (SELECT doc_id AS id, true AS doc, {_WORDS} AS w FROM documents WHERE text IS NOT NULL UNION ALL SELECT item_id, false, {_WORDS} FROM benchmark WHERE text IS NOT NULL),
  runs AS (SELECT DISTINCT id, doc, array_to_string(w[i : i + 12], ' ') AS run FROM (SELECT id, doc, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
  hits AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM runs d JOIN runs i ON d.run = i.run AND d.doc AND NOT i.doc)"""

P1_PAIRS = f"""
  texts AS (SELECT doc_id, lower(trim(split, ' ' || chr(9) || chr(10) || chr(13))) AS split, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
  sets AS (SELECT doc_id, split = 'train' AS train, split, list_distinct([array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)]) AS s FROM texts WHERE len(w) >= 20 AND split IN ('train', 'validation', 'test')),
  grams AS (SELECT doc_id, train, unnest(s) AS g FROM sets),
  common AS (SELECT a.doc_id AS t, b.doc_id AS e, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.train AND NOT b.train GROUP BY ALL),
  pairs AS (SELECT t, e, n, len(a.s) + len(b.s) - n AS u FROM common JOIN sets a ON a.doc_id = t JOIN sets b ON b.doc_id = e WHERE n * 5 >= (len(a.s) + len(b.s) - n) * 3)"""


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


_NAMED = "len(k) BETWEEN 1 AND 30 AND NOT regexp_matches(k, '[:=|;{}]') AND len(v) > 0"
P3_GROUPS = rf"""
  texts AS (SELECT doc_id, text, {_stripped('text')} AS s FROM documents WHERE text IS NOT NULL),
  lined AS (SELECT *, list_filter(string_split_regex(s, '\r\n|\r|\n'), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM texts),
  parts AS (
    SELECT doc_id, {_stripped('e.key')} AS k, {_stripped("e.value ->> '$'")} AS v, json_type(e.value) = 'VARCHAR' AS ok FROM lined, json_each(CASE WHEN s LIKE '{{%}}' AND json_valid(s) THEN s ELSE '{{}}' END) AS e
    UNION ALL
    SELECT doc_id, {_stripped("split_part(p, sign, 1)")}, {_stripped("substr(p, instr(p, sign) + 1)")}, contains(p, sign)
    FROM (SELECT doc_id, unnest(CASE WHEN len(lines) >= 2 THEN lines ELSE string_split_regex(s, '[;|]') END) AS p, CASE WHEN len(lines) >= 2 THEN ':' ELSE '=' END AS sign FROM lined WHERE s NOT LIKE '{{%')),
  records AS (SELECT doc_id FROM parts GROUP BY doc_id HAVING count(*) >= 2 AND bool_and(ok AND {_NAMED})),
  leaves AS (
    SELECT doc_id, kind, array_to_string({_WORDS}, '') AS leaf
    FROM (SELECT doc_id, 'r' AS kind, k || ' ' || v AS text FROM parts SEMI JOIN records USING (doc_id) UNION ALL SELECT doc_id, 't', text FROM texts ANTI JOIN records USING (doc_id))),
  shapes AS (SELECT doc_id, any_value(kind) || array_to_string(list_sort(list(leaf)), chr(31)) AS shape FROM leaves GROUP BY doc_id HAVING string_agg(leaf, '') <> ''),
  keeps AS (SELECT shape, min(doc_id) AS keep_id, count(*) AS copies FROM shapes GROUP BY shape HAVING count(*) > 1)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {P1_PAIRS} SELECT least(t, e) AS doc_id_a, greatest(t, e) AS doc_id_b FROM pairs",
        "p1_report": f"""WITH {P1_PAIRS} SELECT s.split AS eval_split, lower(trim(d.source)) AS train_source, count(*) AS pairs, count(DISTINCT t) AS train_documents, count(DISTINCT e) AS eval_documents, count(*) FILTER (n = u) AS same_sets
          FROM pairs JOIN sets s ON s.doc_id = e JOIN documents d ON d.doc_id = t GROUP BY ALL""",
        "p3_found": f"WITH {P3_GROUPS} SELECT keep_id, doc_id FROM shapes JOIN keeps USING (shape) WHERE doc_id <> keep_id",
        "p3_copies": f"WITH {P3_GROUPS} SELECT keep_id, copies FROM keeps",
        "p4_found": f"WITH {P4_RUNS} SELECT doc_id, item_id FROM hits",
        "p4_word_spans": f"""WITH {P4_RUNS},
          placed AS (SELECT doc_id, pos FROM (SELECT id AS doc_id, w, unnest(range(len(w) - 12)) AS pos FROM words WHERE doc) WHERE array_to_string(w[pos + 1 : pos + 13], ' ') IN (SELECT run FROM runs WHERE NOT doc)),
          islands AS (SELECT doc_id, pos, sum(apart) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, coalesce((pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 13)::INT, 1) AS apart FROM placed))
          SELECT doc_id, CAST(min(pos) AS INT) AS first, CAST(max(pos) + 12 AS INT) AS last FROM islands GROUP BY doc_id, island""",
        "p4_items": f"WITH {P4_RUNS} SELECT item_id, count(*) AS documents FROM hits GROUP BY item_id",
        "p2_sample": f"WITH {P2_SEQUENCE} SELECT document_id, split, first_batch, records, seq FROM chosen WHERE selected",
        "p2_growth": f"""WITH {P2_SEQUENCE}, each AS (SELECT split, first_batch, count(*) AS new_keys, count(*) FILTER (selected) AS new_selected FROM chosen GROUP BY ALL)
          SELECT *, CAST(sum(new_keys) OVER (PARTITION BY split ORDER BY first_batch) AS BIGINT) AS keys, CAST(sum(new_selected) OVER (PARTITION BY split ORDER BY first_batch) AS BIGINT) AS selected FROM each""",
        "p2_stability": """WITH own AS (
            SELECT coalesce(regexp_replace(lower(trim(document_id, ' ' || chr(9) || chr(10) || chr(13))), '^sha256:\\s*', ''), 'row:' || doc_id) AS document_id, coalesce(lower(trim(split, ' ' || chr(9) || chr(10) || chr(13))), '') AS split,
                   coalesce(ingest_batch, 2147483647) AS batch, (coalesce(ingest_batch, 0) + (doc_id % 7 = 0)::INT)::INT AS comes FROM documents),
          firsts AS (SELECT *, min(comes) OVER (PARTITION BY document_id, split) AS came FROM own),
          keys AS (SELECT document_id, split, came, min(batch) AS batch FROM firsts WHERE comes = came GROUP BY ALL),
          numbered AS (SELECT came, row_number() OVER (PARTITION BY split ORDER BY came, batch, sha256('quern-sample-1' || chr(31) || split || chr(31) || document_id), document_id) - 1 AS seq FROM keys),
          deliveries AS (SELECT DISTINCT comes AS delivery FROM own)
          SELECT delivery, count(*) AS keys, count(*) FILTER (((seq % 2147483648) * 1327217885 + 715827883) % 2147483648 < 214748365) AS selected, CAST(0 AS BIGINT) AS lost FROM deliveries JOIN numbered ON came <= delivery GROUP BY delivery""",
        "p5_totals": """WITH items AS (SELECT seq, max(len(ids)) AS n FROM token_docs WHERE seq IS NOT NULL AND len(ids) > 0 GROUP BY seq), limits AS (SELECT DISTINCT max_tokens FROM size_limits WHERE max_tokens > 0)
          SELECT max_tokens, count(*) AS items, CAST(sum((n + max_tokens - 1) // max_tokens) AS BIGINT) AS parts, CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER (n > max_tokens) AS items_cut,
            CAST(0 AS BIGINT) AS over_tokens, CAST(0 AS BIGINT) AS over_places, CAST(0 AS BIGINT) AS over_cost, CAST(0 AS BIGINT) AS misstated FROM items, limits GROUP BY max_tokens""",
        "p7_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents",
        "p6_found": f"WITH {P6_KEYS} SELECT stream, row_id FROM seen WHERE seen",
        "p6_totals": f"WITH {P6_KEYS} SELECT stream, count(*) AS arrivals, count(*) FILTER (seen) AS seen, CAST(0 AS BIGINT) AS wrong_new FROM seen GROUP BY stream",
        "p9_checks": "SELECT limit_name, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS other_overlap, true AS texts_match FROM size_limits WHERE max_tokens >= 1",
        "p8_checks": r"""WITH there AS (SELECT DISTINCT lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS source FROM documents WHERE length(text) > 0),
          wanted AS (SELECT lower(trim(source)) AS source, sum(weight) AS weight FROM mix_targets GROUP BY 1)
          SELECT source, weight, CAST(0 AS BIGINT) AS over_cap, coalesce(source IN (FROM there WHERE source IS NOT NULL), false) AS met FROM wanted""",
    }
