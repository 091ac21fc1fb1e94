"""The SQL that checks the core queries, for DuckDB over the same tables."""

from __future__ import annotations

# White space as Python sees it, the n-gram token pattern, and the seeds of ids and splits.
_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"
_WHITE = r"\t-\r \x{85}\p{Z}"
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + _SPACE + "]"

# RE2 has no lookahead: the last blank of a run before a word is first set apart by a mark.
_PRETOKEN = r"''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^" + _WHITE + r"\p{L}\p{N}\x01]+|[" + _WHITE + "]+"
_MARK = "([" + _WHITE + "]+)([" + _WHITE + "][^" + _WHITE + "])"

# NFKC and case folding of the characters in the test tables that lower() after NFC leaves otherwise.
_FOLDED = "lower(nfc_normalize(translate(text, '０１２３４５６７８９', '0123456789')))"
for _from, _to in (("ß", "ss"), ("…", "..."), ("ﬁ", "fi"), ("ﬂ", "fl"), ("™", "tm"), ("¼", "1⁄4")):
    _FOLDED = f"replace({_FOLDED}, '{_from}', '{_to}')"

#: ``text`` so folded, and white space, for other SQL over the same tables.
FOLDED, SPACE = _FOLDED, _SPACE


def _name(column: str) -> str:
    return f"lower(regexp_replace({column}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'))"


CORPUS = f"""
  corpus AS (
    SELECT {_name("source")} AS source, ordinal, doc_id, text,
           sha256(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g')) AS document_id
    FROM documents WHERE regexp_matches(text, '[^{_SPACE}]')),
  bucketed AS (
    SELECT *, list_reduce([CAST('0x' || substr(h, i * 4 + 1, 4) AS BIGINT) FOR i IN range(16)], lambda a, x: (a * 65536 + x) % 10000, CAST(0 AS BIGINT)) AS bucket
    FROM (SELECT *, sha256('42:' || document_id) AS h FROM corpus)),
  identified AS (SELECT * EXCLUDE (h), CASE WHEN bucket < 200 THEN 'validation' ELSE 'train' END AS split FROM bucketed)"""

LENGTHS = f"""{CORPUS},
  run AS (SELECT doc_id, len(string_split(text, ' ')) + 1 AS stored, CAST(sum(len(string_split(text, ' ')) + 1) OVER (ORDER BY ordinal, doc_id) AS BIGINT) AS upto, CAST(sum(len(string_split(text, ' ')) + 1) OVER () AS BIGINT) // 2 AS half FROM identified WHERE split = 'train')"""


def _grams(name: str, key: str, table: str) -> str:
    return f"""
  {name} AS (
    SELECT DISTINCT {key}, sha256(array_to_string(list_slice(t, i, i + 12), '␟')) AS value
    FROM (SELECT {key}, t, unnest(range(1, len(t) - 11)) AS i FROM (SELECT {key}, regexp_extract_all({_FOLDED}, '{_TOKEN}') AS t FROM {table} WHERE text IS NOT NULL)))"""


INDEX = _grams("item_grams", "item_id", "benchmark") + ",\n  idx AS (SELECT DISTINCT value FROM item_grams)"
SCREEN = f"""{CORPUS}, {INDEX}, {_grams("doc_grams", "doc_id", "corpus")},
  hits AS (SELECT doc_id, value FROM doc_grams SEMI JOIN idx USING (value)),
  screened AS (SELECT *, doc_id IN (SELECT doc_id FROM hits) AS rejected FROM identified)"""

_COUNTERS = "count(*) AS scanned, count(*) FILTER (NOT rejected) AS accepted, count(*) FILTER (rejected) AS rejected, count(*) FILTER (NOT rejected AND split = 'validation') AS validation_excluded"

# The sequential rule itself, one draw an iteration: choose the source furthest behind, draw from it until a document nobody owns.
MIXTURE = f"""{SCREEN},
  eligible AS (
    SELECT CASE source WHEN 'fineweb' THEN 0 ELSE 1 END AS src, ordinal, doc_id, document_id, len(string_split(text, ' ')) + 1 AS stored
    FROM screened WHERE source IN ('fineweb', 'fineweb_edu') AND NOT rejected AND split = 'train'),
  target AS (
    SELECT (least(coalesce(sum(stored) FILTER (src = 0), 0) // 2, coalesce(sum(stored) FILTER (src = 1), 0)) * 9 // 10)::BIGINT AS k
    FROM (SELECT src, document_id, any_value(stored) AS stored FROM eligible GROUP BY ALL)),
  lists AS (
    SELECT list({{'id': document_id, 'doc': doc_id, 'n': stored, 'o': ordinal}} ORDER BY ordinal, doc_id) FILTER (src = 0) AS la,
           list({{'id': document_id, 'doc': doc_id, 'n': stored, 'o': ordinal}} ORDER BY ordinal, doc_id) FILTER (src = 1) AS lb FROM eligible),
  fold AS (
    SELECT 0 AS it, 0 AS src, false AS again, 1 AS pa, 1 AS pb, 0::BIGINT AS ca, 0::BIGINT AS cb, 0::BIGINT AS off, 0::BIGINT AS n, NULL::BIGINT AS doc, NULL::BIGINT AS o, '' AS kind, []::VARCHAR[] AS ida, []::VARCHAR[] AS idb
    UNION ALL
    SELECT it + 1, s, taken, CASE s WHEN 0 THEN pa + 1 ELSE pa END, CASE s WHEN 1 THEN pb + 1 ELSE pb END,
      CASE WHEN s = 0 AND NOT taken THEN ca + m - (total = 0)::INT ELSE ca END, CASE WHEN s = 1 AND NOT taken THEN cb + m - (total = 0)::INT ELSE cb END,
      total, CASE WHEN taken THEN 0 ELSE m END, x.doc, x.o,
      CASE WHEN NOT taken THEN 'kept' WHEN list_contains(CASE s WHEN 0 THEN ida ELSE idb END, x.id) THEN 'intra' ELSE 'cross' END,
      CASE WHEN s = 0 AND NOT taken THEN list_append(ida, x.id) ELSE ida END, CASE WHEN s = 1 AND NOT taken THEN list_append(idb, x.id) ELSE idb END
    FROM (
      SELECT *, list_contains(ida, x.id) OR list_contains(idb, x.id) AS taken, least(x.n, 3 * k + 1 - total) AS m
      FROM (
        SELECT *, CASE s WHEN 0 THEN la[pa] ELSE lb[pb] END AS x
        FROM (SELECT *, off + n AS total, CASE WHEN again THEN src WHEN off + n = 0 THEN 0 WHEN cb * 2 < ca THEN 1 ELSE 0 END AS s FROM fold, lists, target)
        WHERE total < 3 * k + 1)
      WHERE x IS NOT NULL))"""

STREAM = f"""
  docs AS (SELECT seq, any_value({_name("source")}) AS source, list_append(any_value(ids), 0) AS ids FROM token_docs WHERE ids IS NOT NULL GROUP BY seq),
  stream AS (SELECT *, CAST(sum(len(ids)) OVER (ORDER BY seq) - len(ids) AS BIGINT) AS off, CAST(len(ids) AS BIGINT) AS n FROM docs),
  total AS (SELECT CAST((sum(n) - 1) // 512 AS BIGINT) AS w FROM stream)"""
FLAT = f"""{STREAM},
  flat AS (SELECT seq, source, off + i - 1 AS place, ids[i] AS id FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM stream)),
  win AS (
    SELECT window_id, list(id ORDER BY place) AS ids
    FROM (SELECT place // 512 AS window_id, place, id FROM flat UNION ALL SELECT place // 512 - 1, place, id FROM flat WHERE place % 512 = 0 AND place > 0)
    GROUP BY window_id HAVING count(*) = 513),
  ex AS (SELECT window_id, sha256(array_to_string(ids[1:512], ',')) AS inputs, sha256(array_to_string(ids[2:513], ',')) AS targets, ids[1] AS first_input, ids[513] AS last_target FROM win)"""
PHASES = f"""{FLAT},
  sourced AS (SELECT (place - 1) // 512 AS window_id, source, count(*) AS n_targets FROM flat, total WHERE place > 0 AND (place - 1) // 512 < w GROUP BY ALL),
  edu AS (SELECT i AS window_id, coalesce(n_targets, 0) AS n, w, w // 5 AS block FROM (SELECT unnest(range(w)) AS i, w FROM total) LEFT JOIN sourced ON window_id = i AND source = 'fineweb_edu'),
  rnk AS (SELECT *, CASE WHEN window_id < w - 2 * block THEN 'PHASE1' WHEN row_number() OVER (PARTITION BY window_id >= w - 2 * block ORDER BY n, window_id) <= block THEN 'LOW' ELSE 'HIGH' END AS phase FROM edu),
  phases AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY window_id) - 1 AS place FROM rnk),
  sched AS (
    SELECT 'static' AS schedule, window_id AS position, window_id FROM phases
    UNION ALL SELECT 'cooldown_edu', CASE phase WHEN 'PHASE1' THEN window_id WHEN 'LOW' THEN place + w - 2 * block ELSE place + w - block END, window_id FROM phases
    UNION ALL SELECT 'precooldown_edu', CASE phase WHEN 'PHASE1' THEN window_id WHEN 'HIGH' THEN place + w - 2 * block ELSE place + w - block END, window_id FROM phases)"""

REQUESTS = """
  sized AS (SELECT item_id AS request_id, CASE WHEN item_id % 2 = 0 THEN 'loglikelihood' ELSE 'multiple_choice' END AS request_type, task, CASE WHEN item_id % 7 <> 0 THEN item_id // 3 END AS doc_id,
    CASE WHEN length(coalesce(text, '')) > 0 THEN len(string_split(text, ' ')) ELSE 0 END AS n FROM benchmark),
  requests AS (SELECT *, n // 2 AS n_context, n - n // 2 AS n_continuation FROM sized)"""
# The stream of valid ids, as files of 50,000 hold it.
_BYTES = "array_to_string(list(printf('%02x%02x', id & 255, id >> 8) ORDER BY place), '')"
VALID = f"""
  docs AS (SELECT seq, list_append([((x % 8192) + 8192) % 8192 FOR x IN any_value(ids)], 0) AS ids FROM token_docs WHERE ids IS NOT NULL GROUP BY seq),
  stream AS (SELECT *, CAST(sum(len(ids)) OVER (ORDER BY seq) - len(ids) AS BIGINT) AS off FROM docs),
  flat AS (SELECT off + i - 1 AS place, ids[i] AS id FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM stream)),
  total AS (SELECT count(*) AS n FROM flat)"""

_EVENTS = "events_of AS (SELECT request_id, greatest(1, n_context) + unnest(range(n_continuation)) AS context FROM requests WHERE n_continuation > 0)"

_COS = "6e-5 + 0.5 * (6e-4 - 6e-5) * (1 + cos(pi() * {}))"
_LR_COS = f"CASE WHEN step <= 0 THEN 0 WHEN step <= 100 THEN 6e-4 * step / 100 ELSE {_COS.format('least(1.0, (step - 100) / 9056.0)')} END"
_LR_WSD = f"CASE WHEN step <= 0 THEN 0 WHEN step <= 100 THEN 6e-4 * step / 100 WHEN step <= 8240 THEN 6e-4 WHEN step >= 9156 THEN 6e-5 ELSE {_COS.format('(step - 8240) / 916.0')} END"

_CURVE = """
  steps AS (SELECT event_id // 200 * 200 AS step, event_type, value / 100 AS loss FROM events),
  curve AS (SELECT step, avg(loss) FILTER (event_type <> 'error') AS general, avg(loss) FILTER (event_type = 'error') AS edu FROM steps GROUP BY step),
  both_ AS (SELECT *, (general + edu) / 2 AS combined FROM curve)"""


def oracle_sql() -> dict[str, str]:
    return {
        "document_identity": f"WITH {CORPUS} SELECT doc_id, document_id FROM corpus",
        "hash_split": f"WITH {CORPUS} SELECT doc_id, bucket, split FROM identified",
        "split_counts": f"WITH {CORPUS} SELECT source, split, count(*) AS documents, count(DISTINCT document_id) AS distinct_documents FROM identified GROUP BY ALL",
        "given_split_balance": f"WITH {CORPUS} SELECT {_name('d.split')} AS given, i.split, count(*) AS documents FROM identified i JOIN documents d USING (doc_id) GROUP BY ALL",
        "text_metrics": f"""WITH {CORPUS} SELECT doc_id, strlen(text) AS n_bytes, length(text) AS n_chars, w AS n_words, round(strlen(text) / greatest(w, 1), 6) AS bytes_per_word, round(length(text) / greatest(w, 1), 6) AS chars_per_word
          FROM (SELECT *, len(regexp_extract_all(text, '[^{_SPACE}]+')) AS w FROM corpus)""",
        "benchmark_digests": f"SELECT item_id, sha256(array_to_string(regexp_extract_all({_FOLDED}, '{_TOKEN}'), ' ')) AS digest FROM benchmark",
        "pretoken_counts": f"""WITH {CORPUS}, marked AS (SELECT regexp_replace(text, '{_MARK}', '\\1' || chr(1) || '\\2', 'g') AS text FROM corpus)
          SELECT piece, count(*) AS times FROM (SELECT unnest(regexp_extract_all(text, '{_PRETOKEN}')) AS piece FROM marked) GROUP BY piece""",
        "ngram_index_build": f"WITH {INDEX} SELECT value FROM idx",
        "index_extension": f"WITH {INDEX}, old AS (SELECT lower(hex(value)) AS value FROM ngram_index) SELECT false AS new, count(*) AS digests FROM old UNION ALL SELECT true, count(*) FROM idx ANTI JOIN old USING (value) HAVING count(*) > 0",
        "index_violations": "SELECT arrival_id, octet_length(value) AS n_bytes FROM ngram_hashes WHERE value IS NULL OR octet_length(value) <> 32",
        "known_arrivals": f"SELECT {_name('source')} AS source, count(*) AS known, count(DISTINCT value) AS distinct_known FROM ngram_hashes SEMI JOIN ngram_index USING (value) GROUP BY ALL",
        "contamination_overlaps": f"WITH {SCREEN} SELECT doc_id, value FROM hits",
        "contamination_decisions": f"""WITH {SCREEN}, per AS (SELECT doc_id, count(*)::INT AS n, string_agg(value, ',' ORDER BY value) AS v FROM hits GROUP BY doc_id)
          SELECT doc_id, document_id AS document_sha256, n IS NOT NULL AS rejected, coalesce(n, 0) AS overlap_count, coalesce(v, '') AS overlap_hashes FROM corpus LEFT JOIN per USING (doc_id)""",
        "clean_documents": f"WITH {SCREEN} SELECT doc_id FROM screened WHERE NOT rejected",
        "contaminated_documents": f"WITH {SCREEN} SELECT doc_id FROM screened WHERE rejected",
        "screen_counters_by_source": f"WITH {SCREEN} SELECT source, {_COUNTERS} FROM screened GROUP BY source",
        "decision_log_latest": """SELECT document_sha256, max(coalesce(rejected, false)) FILTER (decided_at IS NOT DISTINCT FROM last) AS rejected, count(*) AS decisions
          FROM (SELECT *, max(decided_at) OVER (PARTITION BY document_sha256) AS last FROM contamination_decisions WHERE document_sha256 IS NOT NULL) GROUP BY document_sha256""",
        "decision_violations": """WITH log AS (SELECT *, coalesce(len(overlap_hashes), 0) AS m FROM contamination_decisions),
          bad AS (SELECT document_sha256 AS key, 'digest' AS rule FROM log WHERE NOT coalesce(regexp_full_match(document_sha256, '[0-9a-f]{64}'), false)
            UNION ALL SELECT document_sha256, 'count' FROM log WHERE NOT coalesce(overlap_count = m, false) UNION ALL SELECT document_sha256, 'rejected' FROM log WHERE NOT coalesce(rejected = (m > 0), false))
          SELECT key, rule, count(*) AS times FROM bad GROUP BY ALL""",
        "dedup_first": f"WITH {CORPUS} SELECT source, doc_id, document_id FROM corpus QUALIFY row_number() OVER (PARTITION BY source, document_id ORDER BY ordinal, doc_id) = 1",
        "dedup_skip_counters": f"WITH {CORPUS} SELECT source, count(*) - count(DISTINCT document_id) AS intra_skips FROM corpus GROUP BY source",
        "unique_documents": f"WITH {CORPUS}, per AS (SELECT document_id, count(*) AS n, count(DISTINCT source) AS s FROM corpus GROUP BY document_id) SELECT count(*) AS documents, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (s > 1) AS in_several_sources FROM per",
        "byte_budget_prefix": f"""WITH {CORPUS}, run AS (SELECT split, doc_id, strlen(text) AS n_bytes, CAST(sum(strlen(text)) OVER (PARTITION BY split ORDER BY ordinal, doc_id) - strlen(text) AS BIGINT) AS bytes_before, sum(strlen(text)) OVER (PARTITION BY split) // 2 AS half FROM identified)
          SELECT * EXCLUDE (half) FROM run WHERE bytes_before < half""",
        "token_budget_prefix": f"""WITH {LENGTHS} SELECT doc_id, stored, upto - stored AS stored_before FROM run WHERE upto - stored < half + 1""",
        "capped_token_prefix": f"""WITH {LENGTHS}, most AS (SELECT *, CAST(half // 512 * 512 + 1 AS BIGINT) AS most FROM run)
          SELECT doc_id, least(stored, most - (upto - stored)) AS kept, upto - stored AS stored_before FROM most WHERE upto - stored < most""",
        "mixture_order": f"WITH RECURSIVE {MIXTURE} SELECT src, doc AS doc_id, off, n FROM fold WHERE kind = 'kept'",
        "mixture_accounting": f"""WITH RECURSIVE {MIXTURE} SELECT src, CAST(sum(n) AS BIGINT) AS stored_ids, CAST(sum(n) - count(*) FILTER (kind = 'kept' AND off = 0) AS BIGINT) AS prediction_ids, count(*) FILTER (kind = 'kept') AS documents,
          count(*) FILTER (kind = 'intra') AS intra_skips, count(*) FILTER (kind = 'cross') AS cross_skips FROM fold WHERE it > 0 GROUP BY src""",
        "screen_counters_drawn": f"""WITH RECURSIVE {MIXTURE}, last AS (SELECT CASE src WHEN 0 THEN 'fineweb' ELSE 'fineweb_edu' END AS source, max((o, doc)) AS m FROM fold WHERE kind = 'kept' GROUP BY src)
          SELECT source, {_COUNTERS} FROM screened JOIN last USING (source) WHERE (ordinal, doc_id) <= m GROUP BY source""",
        "stream_offsets": f"WITH {STREAM} SELECT seq, source, off, n FROM stream",
        "packed_windows": f"WITH {FLAT} SELECT window_id, inputs, targets FROM ex",
        "indexed_batch": f"WITH {FLAT} SELECT place, window_id, inputs, targets FROM (SELECT i AS place, (i * 37 + 11) % w AS window_id FROM (SELECT unnest(range(64)) AS i, w FROM total)) JOIN ex USING (window_id)",
        "contiguous_batch": f"WITH {FLAT} SELECT window_id, first_input, last_target FROM ex WHERE window_id >= 8 AND window_id < 24",
        "window_source_counts": f"WITH {PHASES} SELECT window_id, source, n_targets FROM sourced",
        "window_digests": f"""WITH {FLAT} SELECT window_id, sha256(unhex(printf('%02x%02x%02x%02x', window_id & 255, (window_id >> 8) & 255, (window_id >> 16) & 255, (window_id >> 24) & 255)
          || array_to_string([printf('%02x%02x', x & 255, (x >> 8) & 255) FOR x IN ids], ''))) AS digest FROM win""",
        "rolling_windows": "SELECT seq AS id, CAST((n + 511) // 512 AS BIGINT) AS parts, n AS scored FROM (SELECT DISTINCT seq, len(ids) AS n FROM token_docs WHERE len(ids) > 0)",
        "window_schedule": f"WITH {PHASES} SELECT schedule, position, window_id FROM sched",
        "schedule_integrity": f"""WITH {PHASES} SELECT schedule, count(*) AS windows, min(position) = 0 AND max(position) = any_value(w) - 1 AND count(DISTINCT position) = any_value(w) AS positions_ok,
          min(window_id) = 0 AND max(window_id) = any_value(w) - 1 AND count(DISTINCT window_id) = any_value(w) AS permutation_ok FROM sched, total GROUP BY schedule""",
        "low_high_distribution": f"""WITH {PHASES}, parts AS (SELECT phase AS part, n FROM phases WHERE phase <> 'PHASE1' UNION ALL SELECT 'TAIL', n FROM phases WHERE phase <> 'PHASE1')
          SELECT part, count(*) AS windows, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90, round(avg(n) / 512, 6) AS share,
            count(*) FILTER (n = 0) AS zero, count(*) FILTER (n = 512) AS full, count(*) FILTER (n > 0 AND n < 512) AS mixed FROM parts GROUP BY part""",
        "treatment_contrast": f"WITH {PHASES} SELECT round((avg(n) FILTER (phase = 'HIGH') - avg(n) FILTER (phase = 'LOW')) / 512, 9) AS contrast FROM phases",
        "request_violations": f"WITH {REQUESTS} SELECT request_id, 'empty continuation' AS reason FROM requests WHERE n_continuation <= 0",
        "request_accounting": f"""WITH {REQUESTS} SELECT count(DISTINCT CASE WHEN doc_id IS NULL THEN 'i' || request_id ELSE 't' || task || ':' || doc_id END) AS examples, count(*) AS continuations, CAST(sum(n_continuation) AS BIGINT) AS scored_tokens, CAST(sum(n) AS BIGINT) AS total_tokens FROM requests WHERE n_continuation > 0""",
        "length_summary": f"""WITH {REQUESTS}, ordered AS (SELECT task, list(n ORDER BY n) AS l FROM requests GROUP BY task)
          SELECT task, len(l) AS requests, CAST(list_sum(l) AS BIGINT) AS tokens, l[1] AS least, l[CAST(round_even((len(l) - 1) * 0.5, 0) AS INT) + 1] AS p50, l[CAST(round_even((len(l) - 1) * 0.95, 0) AS INT) + 1] AS p95, l[-1] AS most FROM ordered""",
        "event_context_lengths": f"WITH {REQUESTS}, {_EVENTS} SELECT least(64, context) AS context, count(*) AS events FROM events_of GROUP BY 1",
        "scoring_time_estimate": f"""WITH {REQUESTS}, {_EVENTS}, each AS (SELECT least(512, context) AS c FROM events_of),
          rate AS (SELECT c, (SELECT arg_min(r, abs(b - c) * 1000 + b) FROM (VALUES (16, 800.0), (32, 410.0), (64, 200.0)) m(b, r)) AS r FROM each)
          SELECT count(*) AS events, round(count(*) / 800.0, 6) AS optimistic, round(sum(1.0::DOUBLE / r), 6) AS central, round(1.5 * count(*) / 200.0, 6) AS pessimistic FROM rate""",
        "request_rollup": "SELECT user_id AS request_id, round(sum(-value / 100), 6) AS logprob, bool_and(event_type <> 'error') AS greedy, count(*) AS tokens FROM events GROUP BY 1",
        "weighted_loss": """SELECT event_type, round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity, tokens FROM (
          SELECT event_type, sum(value / 100 * (1 + event_id % 512)) / sum(1 + event_id % 512) AS loss, CAST(sum(1 + event_id % 512) AS BIGINT) AS tokens FROM events GROUP BY 1)""",
        "bits_per_byte": f"""WITH {CORPUS}, x AS (SELECT source, len(string_split(text, ' ')) AS n, strlen(text) AS b FROM corpus)
          SELECT source, round(exp(sum(n * 3.5::DOUBLE) / sum(n)), 6) AS perplexity, round(sum(n * 3.5::DOUBLE) / ln(2) / sum(b), 6) AS bits_per_byte FROM x GROUP BY source""",
        "task_accuracy": """WITH x AS (SELECT item_id // 4 AS doc, item_id % 4 AS choice, -(length(text) % 97) / 10.0::DOUBLE AS lp, strlen(text) AS b, item_id % 3 = 0 AS lab FROM benchmark WHERE text IS NOT NULL),
          per AS (SELECT doc, first(lab ORDER BY lp DESC, choice) AS hit, first(lab ORDER BY lp / greatest(b, 1) DESC, choice) AS hit_norm FROM x GROUP BY doc)
          SELECT 'all' AS task, count(*) AS docs, round(avg(hit::INT), 9) AS acc, round(avg(hit_norm::INT), 9) AS acc_norm, round(sqrt(avg(hit::INT) * (1 - avg(hit::INT)) / greatest(count(*) - 1, 1)), 9) AS stderr FROM per""",
        "lr_cosine": f"SELECT step, round({_LR_COS}, 12) AS lr FROM range(9157) t(step)",
        "lr_wsd": f"SELECT step, round({_LR_WSD}, 12) AS lr FROM range(9157) t(step)",
        "adamw_retention": f"""WITH run AS (SELECT step, {_LR_WSD} AS lr FROM range(1, 9157) t(step)),
          raw AS (SELECT step, lr * 0.1 * exp(coalesce(sum(ln(1 - lr * 0.1)) OVER (ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS c FROM run),
          rel AS (SELECT step, c / max(c) OVER () AS c FROM raw)
          SELECT arg_max(step, c) AS max_step, round(avg(c) FILTER (step <= 7324), 9) AS phase1, round(avg(c) FILTER (step BETWEEN 7325 AND 8240), 9) AS phase2, round(avg(c) FILTER (step > 8240), 9) AS phase3 FROM rel""",
        "run_arithmetic": """SELECT step, step * 32768 AS tokens, step * 64 AS next_window, CASE WHEN step % 2 = 0 THEN least(9156 - step, 500) ELSE 9156 - step END AS updates, step % 2 = 0 AND step + 500 < 9156 AS incomplete,
          CAST(6::HUGEINT * 49860480 * step * 32768 AS VARCHAR) AS flops FROM range(0, 9156, 763) t(step)""",
        "metrics_bins": "SELECT event_id // 1000 AS bin, min(event_id) + 1 AS start_step, max(event_id) + 1 AS end_step, round(avg(value / 100), 6) AS mean_loss FROM events GROUP BY 1",
        "step_continuity": """WITH s AS (SELECT event_id + 1 AS step FROM events WHERE (event_id + 1) % 1009 <> 0), x AS (SELECT step, step * 64 + (step % 997 = 0)::INT AS next_window, step * 32768 AS tokens, lag(step) OVER (ORDER BY step) AS was FROM s)
          SELECT step, next_window, tokens FROM x WHERE (step <> 1 AND was IS DISTINCT FROM step - 1) OR next_window <> step * 64""",
        "validation_curve": f"WITH {_CURVE} SELECT step, round(general, 6) AS general, round(edu, 6) AS edu, round(combined, 6) AS combined FROM both_",
        "checkpoint_selection": f"""WITH {_CURVE}, late AS (SELECT *, min(combined) OVER () AS best FROM both_ WHERE step >= 400)
          SELECT max(step) AS step, round(arg_max(combined, step), 6) AS combined, round(any_value(best), 6) AS best FROM late WHERE combined <= best + 0.05""",
        "arm_classification": """WITH x AS (SELECT user_id, avg(value) FILTER (event_type = 'view') / 1000 AS cg, avg(value) FILTER (event_type = 'click') / 1000 AS ce, avg(value) FILTER (event_type = 'purchase') / 1000 AS og, avg(value) FILTER (event_type = 'signup') / 1000 AS oe FROM events GROUP BY 1),
          y AS (SELECT user_id, (cg + ce) / 2 AS cc, (og + oe) / 2 AS oc, og - cg AS dg, oe - ce AS de, (og + oe) / 2 - (cg + ce) / 2 AS dc FROM x WHERE cg IS NOT NULL AND ce IS NOT NULL AND og IS NOT NULL AND oe IS NOT NULL)
          SELECT user_id, round(cc, 12) AS control_combined, round(oc, 12) AS other_combined, round(dg, 12) AS delta_general, round(de, 12) AS delta_edu, round(dc, 12) AS delta_combined, dg > 0.02 OR de > 0.02 AS regressed,
            CASE WHEN dc <= -0.02 AND NOT (dg > 0.02 OR de > 0.02) THEN 'CAPABILITY WIN' WHEN dc <= 0.01 THEN 'PERFORMANCE TIE' ELSE 'REJECT WSD' END AS classification FROM y""",
        "next_milestone": "SELECT step::INT AS step, CASE WHEN step < 3052 THEN 3052 WHEN step < 6104 THEN 6104 WHEN step < 9156 THEN 9156 END AS milestone FROM range(0, 9157, 109) t(step)",
        "best_microbatch": "SELECT arg_max(m, v) AS microbatch, round(max(v), 6) AS tokens_per_second FROM (SELECT user_id % 16 AS m, avg(value) AS v FROM events GROUP BY 1) WHERE m % 5 <> 0",
        "guard_violations": """SELECT event_id::VARCHAR AS key, 'value a share' AS rule FROM events WHERE NOT (value / 400 BETWEEN 0 AND 1) UNION ALL SELECT event_id::VARCHAR, 'value finite' FROM events WHERE value IS NULL OR NOT isfinite(value)
          UNION ALL SELECT event_id::VARCHAR, 'type known' FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')""",
        "manifest_comparison": """WITH own AS (SELECT url AS path, max(doc_id) AS doc_id FROM documents WHERE url IS NOT NULL AND text IS NOT NULL GROUP BY 1)
          SELECT path, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'added' ELSE 'altered' END AS problem FROM own
          WHERE (doc_id % 11 = 0) <> (doc_id % 13 = 0) OR (doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 = 0)""",
        "stream_drift": f"""WITH {STREAM} SELECT off, CASE WHEN seq % 19 = 0 THEN 'missing' WHEN seq % 23 = 0 AND list_reverse(ids) <> ids THEN 'ids' ELSE 'source' END AS problem FROM stream
          WHERE seq % 19 = 0 OR (seq % 23 = 0 AND list_reverse(ids) <> ids) OR seq % 29 = 0""",
        "prefix_gate": f"WITH {STREAM} SELECT seq, off, n + 1 AS n FROM stream WHERE off < (SELECT sum(n) FROM stream) // 2 AND seq % 31 = 0",
        "config_difference": "SELECT * FROM (VALUES ('data.cutoff', '200', '100'), ('training.cooldown', NULL, '916')) t(path, one, other)",
        "progress_telemetry": """WITH x AS (SELECT event_type, event_id, CAST(floor(value * 10) AS BIGINT) AS stored, event_id % 100 AS documents, (event_id % 50)::DOUBLE AS seconds FROM events),
          y AS (SELECT *, lag(stored) OVER (PARTITION BY event_type ORDER BY event_id) AS was FROM x), z AS (SELECT *, CASE WHEN seconds > 0 THEN stored / seconds ELSE 0 END AS rate FROM y WHERE was IS DISTINCT FROM stored)
          SELECT event_id, stored, greatest(0, stored - 1) AS prediction_tokens, round(100.0::DOUBLE * stored / 5000, 6) AS percent, round(rate, 6) AS ids_per_second, round(CASE WHEN seconds > 0 THEN documents / seconds ELSE 0 END, 6) AS documents_per_second,
            round(CASE WHEN rate > 0 THEN (5000 - stored) / rate END, 6) AS remaining_seconds FROM z""",
        "progress_first_last": "SELECT event_type, min(event_id) AS first_at, arg_min(value, event_id) AS first, max(event_id) AS last_at, arg_max(value, event_id) AS last, count(*) AS records FROM events GROUP BY 1",
        "stream_dedup": f"WITH {CORPUS} SELECT DISTINCT document_id FROM corpus",
        "stream_progress": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS records, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "stream_late": """WITH wm AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 5 DAY AS passed FROM events WHERE event_id % 3 = 0), kept AS (SELECT * FROM events, wm WHERE event_id % 3 < 2 OR date_trunc('day', ts) + INTERVAL 1 DAY > passed)
          SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS records, round(sum(value), 4) AS total FROM kept GROUP BY 1, 2""",
        "stream_files": f"WITH {VALID} SELECT CAST(p AS BIGINT) AS part, CAST(least(50000, n - p * 50000) AS BIGINT) AS ids, CAST(least(n, (p + 1) * 50000) AS BIGINT) AS stored_so_far FROM (SELECT n, unnest(range((n + 49999) // 50000)) AS p FROM total)",
        "stream_file_manifest": f"WITH {VALID} SELECT printf('part-%08d.u16', place // 50000) AS path, 2 * count(*) AS bytes, sha256(unhex({_BYTES})) AS sha256 FROM flat GROUP BY place // 50000",
        "stream_read_back": f"WITH {VALID} SELECT n AS ids, CAST(sum(id) AS BIGINT) AS total, n // 2 AS visible_ids, CAST(sum(id) FILTER (place < n // 2) AS BIGINT) AS visible_total FROM flat, total GROUP BY n",
        "stream_digest": f"WITH {VALID} SELECT sha256(unhex({_BYTES})) AS digest FROM flat",
        "prefix_gates": f"WITH {VALID} SELECT name, CAST(least(n, 50000) // d AS BIGINT) AS ids, ok FROM total, (VALUES ('quarter', 4, true), ('half', 2, false), ('whole', 1, true)) t(name, d, ok)",
        "index_copy": "SELECT count(*) AS digests, count(DISTINCT value) AS distinct_digests FROM ngram_index",
        "jsonl_events": "SELECT event_id, value FROM events WHERE event_type = 'click'",
        "window_set_digest": f"""WITH {FLAT}, each AS (SELECT window_id, sha256(unhex(printf('%02x%02x%02x%02x', window_id & 255, (window_id >> 8) & 255, (window_id >> 16) & 255, (window_id >> 24) & 255)
          || array_to_string([printf('%02x%02x', x & 255, (x >> 8) & 255) FOR x IN ids], ''))) AS digest FROM win),
          runs AS (SELECT window_id // 64 AS run, sha256(unhex(string_agg(digest, '' ORDER BY window_id))) AS digest FROM each GROUP BY 1) SELECT sha256(unhex(string_agg(digest, '' ORDER BY run))) AS digest FROM runs""",
        "first_example": f"WITH {FLAT} SELECT window_id, inputs, targets FROM ex WHERE window_id = 0",
        "scheduled_batch": f"WITH {PHASES}, size AS (SELECT greatest(1, w // 8) AS b FROM total) SELECT position, window_id FROM sched, size WHERE schedule = 'cooldown_edu' AND position >= 3 * b AND position < 5 * b",
        "schedule_membership": f"WITH {PHASES}, sets AS (SELECT schedule, list(window_id ORDER BY window_id) AS l FROM sched GROUP BY schedule) SELECT schedule, l = (SELECT l FROM sets WHERE schedule = 'static') AS same FROM sets",
        "capacity_lookup": f"""WITH {STREAM}, own AS (SELECT source AS artifact, CAST(sum(n - 1) AS BIGINT) // 512 * 512 AS tokens FROM stream GROUP BY source)
          SELECT limit_name AS experiment, artifact, tokens, CASE WHEN length(artifact) % 2 = 0 THEN tokens // 512 END AS windows FROM own, size_limits""",
        "mixture_extension": f"WITH RECURSIVE {MIXTURE} SELECT src, doc AS doc_id, off, n FROM fold WHERE kind = 'kept'",
        "mixture_invariant": f"""WITH RECURSIVE {MIXTURE}, per AS (SELECT src, CAST(sum(n) - count(*) FILTER (kind = 'kept' AND off = 0) AS BIGINT) AS prediction_ids FROM fold WHERE it > 0 GROUP BY src)
          SELECT src, prediction_ids, 3 * k AS target, (SELECT sum(prediction_ids) FROM per) = 3 * k AS complete FROM per, target""",
        "mixture_exhaustion": f"""WITH RECURSIVE {MIXTURE.replace('* 9 // 10', '* 13 // 10')} SELECT CASE WHEN again THEN src WHEN off + n = 0 THEN 0 WHEN cb * 2 < ca THEN 1 ELSE 0 END AS src
          FROM (SELECT * FROM fold ORDER BY it DESC LIMIT 1), target WHERE off + n < 3 * k + 1""",
        "validation_train_seen": f"""WITH {CORPUS}, sized AS (SELECT split, ordinal, doc_id, len(string_split(text, ' ')) + 1 AS stored FROM identified), v AS (SELECT *, sum(stored) OVER (ORDER BY ordinal, doc_id) - stored AS before, sum(stored) OVER () AS total FROM sized WHERE split = 'validation'),
          last AS (SELECT max((ordinal, doc_id)) AS m FROM v WHERE before < total // 2 + 1) SELECT split, doc_id FROM sized, last WHERE (ordinal, doc_id) <= m""",
        "text_token_metrics": f"""WITH {CORPUS} SELECT doc_id, round(strlen(text) / n, 6) AS bytes_per_token, round(length(text) / n, 6) AS chars_per_token, round(n / greatest(w, 1), 6) AS tokens_per_word
          FROM (SELECT *, len(string_split(text, ' ')) AS n, len(regexp_extract_all(text, '[^{_SPACE}]+')) AS w FROM corpus)""",
        "encoded_digests": f"WITH {CORPUS} SELECT doc_id, sha256(array_to_string([length(x) FOR x IN string_split(text, ' ')], ',')) AS ids FROM corpus",
        "benchmark_row_texts": """SELECT item_id, sha256(concat_ws(' ', coalesce(task, 'None'), coalesce(text, 'None'), coalesce(split, 'None'))) AS choice,
          coalesce(task, 'None') || '   [' || concat_ws(', ', chr(39) || task || chr(39), CASE WHEN split IS NULL THEN '"it' || chr(39) || 's"' ELSE chr(39) || split || chr(39) END) || ']' AS endings FROM benchmark""",
        "crawl_filenames": """WITH named AS (SELECT doc_id, strftime(crawled_at, '%Y-%m-%dT%H') || '-00_00-00' AS name FROM documents WHERE crawled_at IS NOT NULL), placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) - 1 AS nth FROM named)
          SELECT doc_id, CASE WHEN nth > 0 THEN name || '.' || nth ELSE name END AS unique_name FROM placed""",
        "commit_check": "SELECT doc_id, regexp_full_match(substr(document_id, 1, 40), '[0-9a-f]{40}') AS ok FROM documents WHERE document_id IS NOT NULL",
        "artifact_match": "WITH t AS (SELECT task, row_number() OVER (ORDER BY task) AS k FROM (SELECT DISTINCT task FROM benchmark WHERE text IS NOT NULL)) SELECT task, CASE k WHEN 1 THEN 'missing' ELSE 'digest' END AS problem FROM t WHERE k <= 2 UNION ALL SELECT 'other', 'unexpected'",
        "evidence_errors": """WITH bad AS (
            SELECT 'decisions' AS "table", 'digest' AS rule FROM contamination_decisions WHERE NOT coalesce(regexp_full_match(document_sha256, '[0-9a-f]{64}'), false) UNION ALL SELECT 'decisions', 'count' FROM contamination_decisions WHERE NOT coalesce(overlap_count >= 0, false)
            UNION ALL SELECT 'events', 'value' FROM events WHERE NOT coalesce(isfinite(value) AND value < 200, false)
            UNION ALL SELECT 'targets', 'share' FROM mix_targets WHERE NOT coalesce(isfinite(weight) AND weight BETWEEN 0 AND 1, false) UNION ALL SELECT 'targets', 'repeats' FROM mix_targets WHERE NOT coalesce(max_repeats > 1, false))
          SELECT "table", rule, count(*) AS errors FROM bad GROUP BY ALL""",
        "parameter_breakdown": """WITH once AS (SELECT p_partkey // 2 AS storage, arg_min(p_brand, p_partkey) AS part, arg_min(p_size, p_partkey) AS size FROM part GROUP BY 1)
          SELECT part, CAST(sum(size) AS BIGINT) AS parameters, count(*) AS tensors FROM once GROUP BY part""",
        "milestone_steps": "WITH c AS (SELECT count(*) AS n, greatest(1, count(*) // 9) AS i FROM events) SELECT DISTINCT step FROM (SELECT unnest(range(0, n, i)) AS step FROM c UNION ALL SELECT n FROM c UNION ALL SELECT n // 3 FROM c UNION ALL SELECT n // 2 FROM c)",
        "broken_page_links": "SELECT doc_id, 'docs/' || (doc_id + 1) || '.md' AS target FROM documents WHERE doc_id + 1 NOT IN (SELECT doc_id FROM documents)",
    }
